"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Kinds: email, ip, card (Luhn), phone, iban (length by country, mod 97), ssn-like national
numbers, and secret (long strings of letters and digits, as keys and tokens are). The first
four kinds have a fixed base form that is always reported when its own test passes; beyond
those a span is added only where its score, raised or lowered by the whole words on either
side, is at least ``THRESHOLD``.

The patterns are written so that no text costs more than time in proportion to its length:
emails start from each @ and walk back over the local part, and digit runs are entered at
their start only.

Edge cases: a null or empty text has no spans; very long texts and runs of digits are read
whole; offsets count code points, end exclusive; spans of one kind never overlap, those of
different kinds may; repeated rows get equal results; an empty table gives an empty result;
ties don't arise; a null doc_id stays null; other columns, whatever their names, are not used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from recallery.llm import kernels as K
from recallery.llm.common import small_batches, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
THRESHOLD = 0.5

# The base forms.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Further forms, checked and scored.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}")

# How long the account numbers of each country are.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Words within so many code points of a span that speak for or against each scored kind.
NEAR = 40
FOR = {
    "iban": frozenset(("iban", "account", "konto", "kontonummer", "compte", "cuenta", "bank", "banque", "banco")),
    "ssn": frozenset(("ssn", "social", "security", "tax")),
    "secret": frozenset(("token", "key", "apikey", "secret", "password", "passwd", "bearer", "auth", "credential", "credentials")),
}
AGAINST = frozenset(("version", "order", "isbn", "serial", "part", "ticket", "commit", "checksum", "digest", "sha", "md"))
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def near_words(text: str, start: int, end: int) -> set[str]:
    """Lower-case words that lie whole within NEAR code points of a span, on either side."""
    a, b = max(0, start - NEAR - 1), min(len(text), end + NEAR + 1)
    before = [m[0].lower() for m in _WORD.finditer(text[a:start]) if m.start() or not a]
    after = [m[0].lower() for m in _WORD.finditer(text[end:b]) if end + m.end() < b or b == len(text)]
    return {*before, *after}


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = near_words(text, start, end)
    score = 0.4 + 0.4 * bool(near & FOR[kind]) - 0.3 * bool(near & AGAINST)
    return score + 0.2 * (kind == "iban")  # its checksum speaks for it


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of the length of their country that pass mod 97."""
    done = 0
    for m in IBAN.finditer(text):
        left, end = IBAN_LENGTH.get(m[0][:2], 0) - 4, m.end()
        while left > 0 and (step := IBAN_REST.match(text, end)):
            left, end = left - 1, step.end()
        whole = left == 0 and m.start() >= done and not re.match("[A-Za-z0-9]", text[end : end + 1])
        if whole and mod97(text[m.start() : end].replace(" ", "")):
            done = end
            yield m.start(), end


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans, by kind as listed and then by start."""
    if not text:
        return []
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    number = CARD.search(text)
    if number or "." in text:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or "0") <= 255 for q in m[0].split("."))]
    cards = []
    if number:
        for m in CARD.finditer(text, number.start()):
            if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                cards.append(("card", *m.span()))
        found += cards
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    if number:
        found += [("iban", *at) for at in ibans(text) if _score("iban", text, *at) >= THRESHOLD]
        if "-" in text:
            found += [("ssn", *m.span()) for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][:1] != "9" and _score("ssn", text, *m.span()) >= THRESHOLD]
        mixed = (m for m in SECRET.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and len(set(m[0])) >= 10)
        found += [("secret", *m.span()) for m in mixed if _score("secret", text, *m.span()) >= THRESHOLD]
    return found


def _row(text: str | None) -> tuple:
    spans = find(text)
    named = [f"{kind}:{a}:{b}" for kind, a, b in spans]
    base = ",".join(n for n, s in zip(named, spans, strict=True) if s[0] in KINDS[:4])
    return (*(sum(s[0] == kind for s in spans) for kind in KINDS[:4]), len(spans), hashlib.sha256(base.encode()).hexdigest(), ",".join(named))


_NAMES = ("n_email", "n_ip", "n_card", "n_phone", "n_spans", "base_sha256", "spans")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(t.as_py()) for t in batch.column("text")]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *_NAMES])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_spans (of all kinds), base_sha256 and spans of each text."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(K.tidy(_batches), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_spans long, base_sha256 string, spans string")


def redact(text: str | None, spans: list[tuple[str, int, int]] | None = None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest wins."""
    if text is None:
        return None
    out, done = [], 0
    for kind, a, b in sorted(find(text) if spans is None else spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
            done = b
    return "".join([*out, text[done:]])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
