"""Entity extraction: a pluggable extractor, the tolerant parser of model answers, and clean-up of what they give."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallery.functions.text import digest, entity_type, entity_value
from recallery.operators.clients import WINDOW, in_order
from recallery.schema import ENTITY_TYPES, ITEM
from recallery.sources.ship import ship

#: Length from which the rule extractor takes a token for an entity.
LEAST_LENGTH = 9


def rule_items(text: Column, least: int = LEAST_LENGTH) -> Column:
    """The offline extractor: distinct long ASCII tokens as What, years as When."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    picked = F.filter(tokens, lambda t: (F.length(t) >= least) | t.rlike("^(19|20)[0-9]{2}$"))
    return F.transform(picked, lambda t: F.struct(t.alias("value"), F.when(t.rlike("^(19|20)[0-9]{2}$"), "When").otherwise("What").alias("type")))


def cleaned(df: DataFrame, column: str = "items") -> DataFrame:
    """``column`` with items of a legal type and a value only; of equal values (in any case) the longest,
    else the first; Who first, then longer values, then by lower case. Null becomes empty."""
    given = F.coalesce(F.col(column), F.array().cast(ITEM))
    shown = F.transform(given, lambda x, i: F.struct(entity_value(x["value"]).alias("value"), entity_type(x["type"]).alias("type"), i.alias("at")))
    # ordered so that the item to keep of equal values comes first
    ordered = F.array_sort(F.transform(shown, lambda x: F.struct(F.lower(x["value"]).alias("low"), (-F.length(x["value"])).alias("b"), x["at"].alias("at"), x["value"].alias("value"), x["type"].alias("type"))))
    step = df.withColumn("_sorted", F.filter(ordered, lambda x: x["type"].isNotNull() & (x["value"] != "")))
    # the item before each, so that a repeat shows
    low = F.transform("_sorted", lambda x: x["low"])
    step = step.withColumn("_before", F.concat(F.array(F.lit(None).cast("string")), low))
    pairs = F.zip_with("_sorted", F.slice("_before", 1, F.size("_sorted")), lambda x, p: F.when(p.isNull() | (p != x["low"]), F.struct((x["type"] != "Who").alias("a"), x["b"].alias("b"), x["low"].alias("c"), x["value"].alias("value"), x["type"].alias("type"))))
    step = step.withColumn("_best", F.array_sort(F.filter(pairs, lambda x: x.isNotNull())))
    return step.withColumn(column, F.transform("_best", lambda x: F.struct(x["value"].alias("value"), x["type"].alias("type")))).drop("_sorted", "_before", "_best")


# ------------------------------------------------------------ answers of models

_PAIR = re.compile(r"""\{[^{}]*?"value"\s*:\s*"((?:[^"\\]|\\.)*)"[^{}]*?"type"\s*:\s*"((?:[^"\\]|\\.)*)"[^{}]*?\}""", re.S)
_NOISE = ((re.compile(r"/\*.*?\*/", re.S), ""), (re.compile(r"//[^\n]*"), ""), (re.compile(r",(\s*[\]}])"), r"\1"))


def _unfenced(answer: str) -> str:
    """An answer without fences, wherever they stand; what was in them stays."""
    return re.sub("```(?:json)?", "", answer).strip()


def _listed(value: object) -> object:
    """What a JSON value says of entities: a list itself, an object its ``entities``, anything else nothing."""
    return value if isinstance(value, list) else value.get("entities") if isinstance(value, dict) else None


def _readings(text: str, raw: str) -> Iterator[Callable[[], object]]:
    """Ways to read an answer, strictest first."""
    yield lambda: json.loads(text)
    begin = re.search(r"[\[{]", text)
    if text[:1] in ("[", "{"):
        yield lambda: json.JSONDecoder().raw_decode(text)[0]
    if begin and "[" in text and "]" in text:
        yield lambda: json.loads(text[text.index("[") : text.rindex("]") + 1])

    def pairs():
        found = [{"value": json.loads(f'"{v}"'), "type": json.loads(f'"{t}"')} for v, t in _PAIR.findall(raw)]
        if not found:
            raise ValueError("no entities in the answer")
        return found

    yield pairs


def parse_answer(answer: str | None) -> list[tuple[str, str]]:
    """(value, type) of each entity in a model's answer. An unknown type becomes What, an empty
    value is dropped. A reading that fails, or that is neither a list nor an object with entities, gives way to the
    next; ValueError where none is left or an entry lacks a field."""
    raw = _unfenced(str(answer or ""))
    text = raw
    for pattern, put in _NOISE:
        text = pattern.sub(put, text)
    value, last = None, None
    for read in _readings(text, raw):
        try:
            value = _listed(read())
        except (ValueError, RecursionError) as e:
            last = e
        if value is not None:
            break
    else:
        raise ValueError(f"answer can't be read: {last}")
    if not isinstance(value, list):
        raise ValueError("answer is no list of entities")
    out = []
    for item in value:
        if not isinstance(item, dict) or "value" not in item or "type" not in item:
            raise ValueError("an entity lacks its value or type")
        v, t = " ".join(str(item["value"] or "").split()), str(item["type"] or "").strip()
        if v:
            out.append((v, t if t in ENTITY_TYPES else "What"))
    return out


_ITEMS = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("type", T.StringType())]))


@F.pandas_udf(T.StructType([T.StructField("items", _ITEMS), T.StructField("error", T.StringType())]))
def parsed(answers: pd.Series) -> pd.DataFrame:
    """Answers read by ``parse_answer``: the items, or the error."""
    rows = []
    for a in answers:
        try:
            rows.append(([{"value": v, "type": t} for v, t in parse_answer(a)], None))
        except ValueError as e:
            rows.append((None, str(e)[:200]))
    return pd.DataFrame(rows, columns=["items", "error"])


def model_extractor(make_client: Callable[[], Callable[[str], str]], retries: int = 3, tokens: int = 2500, temperature: float = 0.3, window: int = WINDOW, rate: float | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """An extractor over a text model: ``make_client`` is called once for each task and gives a
    function from prompt (and tokens and temperature, if it takes them) to answer, which up to ``window`` threads call at a time,
    at most ``rate`` times a second. Distinct texts are asked once; where an answer can't be read or the call fails, the text is
    asked for again, and failed texts get null items. If all calls of a batch fail, the last failure is raised."""

    def run(df: DataFrame, text: str) -> DataFrame:
        def ask(batches):
            client = make_client()

            def one(prompt: str) -> list[dict]:
                for k in range(retries):
                    try:
                        return [{"value": v, "type": t} for v, t in parse_answer(ask_client(client, prompt, tokens=tokens, temperature=temperature))]
                    except Exception:  # of the model or of its answer
                        if k + 1 == retries:
                            raise
                return []

            for pdf in batches:
                told = list(in_order(one, pdf["_prompt"], window, rate))
                broken = [e for _, e in told if e is not None and not isinstance(e, ValueError)]
                if told and len(broken) == len(told):
                    raise broken[-1]
                yield pd.DataFrame({"_text": pdf["_text"], "items": [items for items, _ in told]})

        from recallery.functions.text import extraction_prompt
        from recallery.operators.clients import ask as ask_client

        ship(df.sparkSession)
        texts = df.select(F.col(text).alias("_text")).where("_text is not null").distinct()
        answers = texts.withColumn("_prompt", extraction_prompt("_text")).mapInPandas(ask, f"_text string, items {ITEM}")
        return df.join(answers, df[text] == answers["_text"], "left").drop("_text")

    return run


def cached(extractor: Callable[[DataFrame, str], DataFrame], cache, model: str = "rule", version: str = "1") -> Callable[[DataFrame, str], DataFrame]:
    """An extractor that keeps what it finds in a ``store.entity_cache`` under its version and model: known texts are
    not read again, distinct ones once; failed ones (null items) are not kept. ``extractor.added`` counts the new ones."""

    def run(df: DataFrame, text: str) -> DataFrame:
        texts = df.select(F.col(text).alias("_text")).where("_text is not null").distinct()
        keyed = texts.select("_text", F.lit(version).alias("version"), F.lit(model).alias("model"), digest("_text").alias("text_digest"))
        made = extractor(cache.misses(keyed), "_text")
        run.added += cache.add(made.where("items is not null"))
        known = keyed.join(cache.get(keyed), ["version", "model", "text_digest"]).select("_text", "items")
        return df.join(known, df[text] == known["_text"], "left").drop("_text")

    run.added = 0
    return run


def rule_extractor(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("items", rule_items(F.col(text)))
