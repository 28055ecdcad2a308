"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text is its characters, spaces written as ``MARK`` and one MARK put before it. An agenda of
adjacent symbol pairs, ordered by the score of the piece that they make and then from left to
right, joins the best pair until no neighbours make a piece. Symbols that are no piece are spelled by their bytes.

Two characters that stand side by side in no piece of the vocabulary can't be joined by any
merge, so a text is cut between them first, before spaces above all: what one word does leaves the
others alone. The words of a batch that the task hasn't met before then go through their agendas side by side: in each
round every word joins its best pair, and only the pairs next to it are looked up anew. Long words, cut
further, have agendas of their own, as heaps, in which a pair that has changed since it was put there is passed over.

With ``check`` (as the query has it) the sentencepiece library works along in each Arrow batch: it
encodes every word that the task has not met before and the batch's first text as a whole, and decodes the ids of
all texts; anything that differs stops the job.

The vocabulary file is read once, on the driver, and its bytes (half a megabyte, at most
MOST_BYTES) are broadcast, so executors need no file of their own. Normalisation other than by
the rules above, pieces given by users, unused pieces and vocabularies without byte pieces
raise ValueError.

Edge cases: a null text is empty, an empty text has no ids and decodes to the empty text; a
MARK in a text is a space afterwards, as in the library; very long texts are taken whole, one in a task;
repeated rows get equal results, so ties don't arise; an empty table gives an empty result; columns beside the text
are carried as they are, but ids and decoded are those of the result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import add

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.llm import kernels as K
from recallery.llm.common import table, through_arrow

#: The sign for a space, and what stands for bytes that are no text and for an unknown piece.
MARK, REPLACEMENT, UNKNOWN = "▁", "�", " ⁇ "
#: The rank of a pair that makes no piece; characters that are no piece are numbered from here, behind all pieces.
NEVER, CHARACTERS = 1 << 30, 1 << 21
#: Kinds of pieces in a vocabulary file.
NORMAL, UNKNOWN_KIND, CONTROL, BYTE = 1, 2, 3, 6
#: Words that a task remembers; characters of a short word; bytes of text that go at a time.
REMEMBERED, SHORT, PIECE = 400_000, 64, 1 << 20
#: Bytes of a vocabulary file at most, as it is broadcast.
MOST_BYTES = 64 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message: whole numbers, or bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class _Spelled(dict):
    """The ids of the bytes of characters, by symbol, made when first asked for."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, symbol: int) -> list[int]:
        return self.setdefault(symbol, [self.ids[f"<0x{b:02X}>"] for b in chr(symbol - CHARACTERS).encode()])


class Vocabulary:
    """A merge-type vocabulary: scores and ids of its pieces."""

    def __init__(self, model: bytes):
        self.shown: list[bytes] = []
        self.kind: list[int] = []
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        trainer, normalizer = {}, {}
        for field, value in _fields(model):
            if field == 1:
                one = {1: b"", 2: bytes(4), 3: NORMAL} | dict(_fields(value))
                self._add(one[1].decode(), float(np.frombuffer(one[2], "<f4")[0]), one[3])
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("the vocabulary must be of the merge type and have byte pieces")
        if trainer.get(24, 0) or normalizer.get(2) or normalizer.get(4, 1) or not (normalizer.get(3, 1) and normalizer.get(5, 1)):
            raise ValueError("the vocabulary must leave texts as they are, but for spaces and one put before")
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        # where no piece has a MARK behind another character, texts fall into words with the spaces before them
        self.words = re.compile(f"{MARK}+[^{MARK}]*" if all(p[1] != MARK or p[0] == MARK for p in self.pairs) else "(?s).+")
        self._tables()
        self.control = np.array(self.kind) == CONTROL
        self.known: dict[str, bytes] = {}

    def _add(self, piece: str, score: float, kind: int) -> None:
        if kind not in (NORMAL, UNKNOWN_KIND, CONTROL, BYTE):
            raise ValueError(f"pieces of kind {kind} are not supported")
        if kind == NORMAL:
            self.score[piece] = score
        if kind != NORMAL or piece not in self.ids:
            self.ids[piece] = len(self.kind)
        self.shown.append({NORMAL: piece.replace(MARK, " ").encode(), BYTE: bytes([int(piece[3:5], 16)]) if kind == BYTE else b"", UNKNOWN_KIND: UNKNOWN.encode(), CONTROL: b""}[kind])
        self.kind.append(kind)

    def _symbol(self, part: str) -> int | None:
        """The number of a symbol: a piece, or else a single character."""
        return self.ids[part] if part in self.score else CHARACTERS + ord(part) if len(part) == 1 else None

    def _tables(self) -> None:
        """The symbol of each character, and for the pairs of symbols that make a piece its rank by score and its number, sorted by pair."""
        self.spelled = _Spelled(self.ids)
        self.character = np.arange(CHARACTERS, CHARACTERS + 0x110000, dtype=np.int64)
        for p in self.score:
            if len(p) == 1:
                self.character[ord(p)] = self.ids[p]
        ranks = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        rows = []
        for p, score in self.score.items():
            for i in range(1, len(p)):
                left, right = self._symbol(p[:i]), self._symbol(p[i:])
                if left is not None and right is not None:
                    rows.append((left << 22 | right, ranks[score], self.ids[p]))
        table = np.array(sorted(rows) or [(0, NEVER, 0)], np.int64)
        self.pair_key, self.pair_rank, self.pair_piece = (np.ascontiguousarray(c) for c in table.T)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs of symbols."""
        key = left << 22 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER), self.pair_piece[at]

    def side_by_side(self, words: list[str]) -> list[bytes]:
        """The ids of words, each joined by an agenda of its own; all take their best pair in each round."""
        size = np.array([len(w) for w in words])
        symbol = self.character[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, piece = np.full(len(symbol), NEVER), np.zeros(len(symbol), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], piece[inner] = self._ranked(symbol[inner], symbol[inner + 1])
        while len(word):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(word))))
            over = best == NEVER
            if over.any():
                done.append((word[over], symbol[over]))
                live = ~over
                word, symbol, rank, piece, best = word[live], symbol[live], rank[live], piece[live], best[live]
                if not len(word):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]  # the first of equals
            symbol[at] = piece[at]
            left = np.ones(len(word), bool)
            left[at + 1] = False
            at = at - np.arange(len(at))  # each word before has lost a symbol
            word, symbol, rank, piece = word[left], symbol[left], rank[left], piece[left]
            # the pairs that the new symbol is part of
            for i in (at, at[at > 0] - 1):
                same = (i + 1 < len(word)) & (word[np.minimum(i + 1, len(word) - 1)] == word[i])
                rank[i[~same]] = NEVER
                i = i[same]
                rank[i], piece[i] = self._ranked(symbol[i], symbol[i + 1])
        word, symbol = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        end = np.searchsorted(word, np.arange(1, len(words) + 1))
        data, edge = symbol.astype(np.int32).tobytes(), [0, *(4 * end).tolist()]
        out = [data[a:b] for a, b in zip(edge, edge[1:])]  # noqa: B905, RUF007
        for w in np.unique(word[symbol >= CHARACTERS]).tolist():
            mine = symbol[edge[w] // 4 : edge[w + 1] // 4].tolist()
            out[w] = array("i", chain.from_iterable([x] if x < CHARACTERS else self.spelled[x] for x in mine)).tobytes()
        return out

    def agenda(self, segment: str) -> list[int]:
        """The ids of a segment, its symbols joined in the order of scores."""
        symbol, score = list(segment), self.score
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        pairs: list[tuple[float, int, int, int]] = []

        def propose(a: int, b: int) -> None:
            joined = symbol[a] + symbol[b]
            at = score.get(joined)
            if at is not None:
                heapq.heappush(pairs, (-at, a, b, len(joined)))

        for i in range(len(symbol) - 1):
            propose(i, i + 1)
        while pairs:
            _, a, b, size = heapq.heappop(pairs)
            if not symbol[a] or not symbol[b] or len(symbol[a]) + len(symbol[b]) != size:
                continue  # one of the two has been joined since
            symbol[a] += symbol[b]
            symbol[b] = ""
            after[a] = after[b]
            if after[a] < len(symbol):
                before[after[a]] = a
                propose(a, after[a])
            if before[a] >= 0:
                propose(before[a], a)
        return self._spelled(s for s in symbol if s)

    def _spelled(self, symbols: Iterable[str]) -> list[int]:
        """The ids of symbols, those of their bytes where a symbol is no piece."""
        out: list[int] = []
        for s in symbols:
            at = self.ids.get(s)
            out += [at] if at is not None else [self.ids[f"<0x{b:02X}>"] for b in s.encode()]
        return out

    def long(self, word: str) -> bytes:
        """The ids of a long word, cut further where no piece holds two neighbours."""
        edge = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in self.pairs]
        return array("i", chain.from_iterable(self.agenda(word[a:b]) for a, b in zip([0, *edge], [*edge, len(word)], strict=True))).tobytes()

    def encode_all(self, texts: list[str]) -> tuple[list[np.ndarray], dict[str, bytes]]:
        """The ids of texts, and those of the words that were not remembered."""
        split = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        fresh = list(set().union(*split) - self.known.keys())
        short = [w for w in fresh if len(w) <= SHORT]
        new = dict(zip(short, self.side_by_side(short), strict=True)) if short else {}
        self.known |= new
        new |= {w: self.long(w) for w in fresh if len(w) > SHORT}
        known = self.known if len(new) == len(short) else {**self.known, **new}
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)), np.int32) for ws in split], new

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return self.encode_all([text])[0][0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. One space that was put before a text goes; bytes that are no text become REPLACEMENT each."""
        pieces = list(map(self.shown.__getitem__, ids.tolist()))
        k = 0
        while k < len(pieces) and self.kind[ids[k]] == CONTROL:
            k += 1
        if k < len(pieces) and self.kind[ids[k]] == NORMAL and pieces[k][:1] == b" ":
            pieces[k] = pieces[k][1:]
        try:
            if not self.control[ids].any():  # bytes on the two sides of such a piece make no character
                return b"".join(pieces).decode()
        except UnicodeDecodeError:
            pass
        return self._repaired(ids, pieces)

    def _repaired(self, ids: np.ndarray, pieces: list[bytes]) -> str:
        out, held = [], b""
        for i, piece in zip([*ids.tolist(), -1], [*pieces, b""], strict=True):
            if i >= 0 and self.kind[i] == BYTE:
                held += piece
                continue
            while held:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(held[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append(REPLACEMENT)
                held = held[n:]
            out.append(piece.decode())
        return "".join(out)


_vocabularies: dict[str, tuple[Vocabulary, sentencepiece.SentencePieceProcessor]] = {}


def _vocabulary(model: bytes) -> tuple[Vocabulary, sentencepiece.SentencePieceProcessor]:
    """A vocabulary and the library's, made once for each worker process."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _vocabularies:
        _vocabularies[name] = Vocabulary(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    return _vocabularies[name]


def _checked(library: sentencepiece.SentencePieceProcessor, texts: list[str], ids: list[np.ndarray], fresh: dict[str, bytes], shown: list[str]) -> None:
    """ValueError where the library reads a new word, the first text as a whole, or the ids of any text otherwise."""
    pairs = [*((w[1:], x) for w, x in fresh.items() if w != MARK), (texts[0], ids[0].tobytes())]  # the library puts the first MARK
    for (word, x), y in zip(pairs, library.encode([w for w, _ in pairs], num_threads=1), strict=True):
        if x != array("i", y).tobytes():
            raise ValueError(f"the library reads {word[:80]!r} otherwise")
    for text, s, z in zip(texts, shown, library.decode(ids, num_threads=1), strict=True):
        if s != z:
            raise ValueError(f"the library decodes {text[:80]!r} otherwise")


def _encoded(model, check: bool):
    def run(column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        own, library = _vocabulary(model.value)
        _, at = K.texts(column)
        for i, j in K.pieces(at, PIECE):
            texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
            ids, fresh = own.encode_all(texts)
            shown = [own.decode(x) for x in ids]
            if check:
                _checked(library, texts, ids, fresh, shown)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))
            yield i, j - i, [lists, pa.array(shown, pa.string())]

    return run


def encode(docs: DataFrame, model: str, text: str = "text", check: bool = True) -> DataFrame:
    """All columns of ``docs``, with ids array<int> and decoded string."""
    spark = docs.sparkSession
    with open(model, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"a vocabulary file of more than {MOST_BYTES} bytes")
    Vocabulary(data)  # what is not supported shows here
    return through_arrow(docs, text, _encoded(spark.sparkContext.broadcast(data), check), [("ids", "array<int>"), ("decoded", "string")])


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
