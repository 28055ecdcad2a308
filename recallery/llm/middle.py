"""Fill-in-the-middle transformation by a parallel automaton scan.

A text is a row of units (runs of ASCII letters, and every other character alone). It is cut
after two numbers of units, and its parts are put in another order between sentinels, so that a
model learns to write the middle from what surrounds it. One automaton over the bytes of UTF-8
finds both where units begin and whether a sentinel stands in the text:

1. A piece of text emits, for every state that it may be entered in, the state that it leaves
   and the number of units that begin in it. Within a piece, lanes of LANE bytes do so side by side.
2. These functions compose associatively, (f then g): state s goes to g[f[s]], with f's count at s
   and g's at f[s]. A scan in log n steps gives the state that each piece is really entered in.
3. With the states known, the units before each piece are known, and the piece that holds a
   cut finds its place.

Texts of up to ``chunk`` bytes go through that within a task, many at a time: a byte that no text
has sets the automaton back between them. Longer texts are dealt over the tasks in chunks; the
chunks' functions, some hundred bytes each, meet by text and compose; only the chunks that hold a cut
are looked at again. The parts are cut and joined in the JVM.

Edge cases: a null text is empty; an empty text is plain; texts that hold a sentinel are plain, so that
every output can be read back; very long texts as said above; a null key counts as the text "null";
repeated rows get equal results, so ties don't arise; both cuts may fall together or on an end of the text, and parts
may be empty; an empty table gives an empty result; columns beside key and text are carried as they are, but
those named n, form, prefix_chars, middle_chars and output are those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.llm import kernels as K
from recallery.llm.common import cut, small_batches, table, through_arrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, how many are changed, and how many of those have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: Bytes of a chunk of a text that is dealt over the tasks; bytes of a lane; bytes of short texts at a time.
CHUNK, LANE, PIECE = 1 << 16, 128, 1 << 18
#: Rows up to which a table of cuts is broadcast.
BROADCAST_ROWS = 400_000
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")

#: What a byte is to the automaton. Continuation bytes of UTF-8 move nothing but end a letter run; BREAK stands between texts; NOTHING fills a lane.
LETTER, MARKED, OPEN, CLOSE, OTHER, CONTINUED, BREAK, NOTHING = range(8)
#: A state is 4 for inside a run of letters, plus how much of a sentinel is there: 0, "<", "<" with its letter, or 3 once a whole one was.
STATES, FOUND = 8, 3


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each byte, and by state and class the next state and whether a unit begins."""
    kind = np.full(256, OTHER, np.uint8)
    for c in range(256):
        if chr(c).isascii() and chr(c).isalpha():
            kind[c] = MARKED if chr(c) in PREFIX + SUFFIX + MIDDLE else LETTER
    kind[ord("<")], kind[ord(">")], kind[0x80:0xC0], kind[0xFF] = OPEN, CLOSE, CONTINUED, BREAK
    after, begins = np.zeros((STATES, 8), np.uint8), np.zeros((STATES, 8), np.uint8)
    for state in range(STATES):
        inside, seen = state >= 4, state % 4
        for c in range(8):
            letter = c in (LETTER, MARKED)
            step = 1 if c == OPEN else 2 if c == MARKED and seen == 1 else FOUND if c == CLOSE and seen == 2 else 0
            step = FOUND if seen == FOUND else step
            begins[state, c] = not inside if letter else c in (OPEN, CLOSE, OTHER)
            after[state, c] = {BREAK: 0, NOTHING: state}.get(c, 4 * letter + step)
    return kind, after, begins


KIND, AFTER, BEGINS = _automaton()


def then(f: np.ndarray, fc: np.ndarray, g: np.ndarray, gc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transition functions f, then g, and their counts; rows are pieces, columns entry states."""
    return np.take_along_axis(g, f, 1), fc + np.take_along_axis(gc, f, 1)


def composed(f: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the function and counts of all pieces up to it, in log n steps."""
    f, counts = f.astype(np.int64), counts.astype(np.int64)
    step = 1
    while step < len(f):
        g, c = then(f[:-step], counts[:-step], f[step:], counts[step:])
        f, counts = np.concatenate([f[:step], g]), np.concatenate([counts[:step], c])
        step *= 2
    return f, counts


def _lanes(data: np.ndarray) -> np.ndarray:
    """The classes of bytes, a lane to each column."""
    kind = KIND[data]
    kind = np.concatenate([kind, np.full(-len(kind) % LANE, NOTHING, np.uint8)])
    return np.ascontiguousarray(kind.reshape(-1, LANE).T)


def functions(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each lane's state after it, and units that begin in it, for every state before it."""
    state = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (lanes.shape[1], STATES))
    counts = np.zeros(state.shape, np.int32)
    after, begins = AFTER.ravel(), BEGINS.ravel()
    for kind in lanes:
        at = state * 8 + kind[:, None]
        counts += begins[at]
        state = after[at]
    return state, counts


def scanned(data: np.ndarray, entry: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Whether a unit begins at each byte, and the state after it."""
    if not len(data):
        return np.zeros(0, bool), np.zeros(0, np.uint8)
    lanes = _lanes(data)
    whole = composed(*functions(lanes))[0]
    state = np.concatenate([[entry], whole[:-1, entry]]).astype(np.uint8)
    begins, states = np.empty(lanes.shape, np.uint8), np.empty(lanes.shape, np.uint8)
    for i, kind in enumerate(lanes):
        at = state * 8 + kind
        begins[i] = BEGINS.ravel()[at]
        state = AFTER.ravel()[at]
        states[i] = state
    return begins.T.ravel()[: len(data)].astype(bool), states.T.ravel()[: len(data)]


def characters(data: np.ndarray) -> np.ndarray:
    """How many characters begin before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _short(column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """Units, characters at both cuts, and whether a sentinel is there, of texts in a batch. A row is text and two draws."""
    draws = [column.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)]
    data, at = K.texts(column.field(0))
    for i, j in K.pieces(at, PIECE):
        # the texts with a break after each
        size = np.diff(at[i : j + 1])
        end = np.cumsum(size + 1) - 1
        body = np.full(int(size.sum()) + len(size), 0xFF, np.uint8)
        body[np.delete(np.arange(len(body)), end)] = data[at[i] : at[j]]
        begins, states = scanned(body)
        first, chars = np.flatnonzero(begins), characters(body)
        start = end - size
        units = np.searchsorted(first, np.concatenate([start, end[-1:]]))
        n = np.diff(units)
        marked = np.where(size > 0, states[np.maximum(end - 1, 0)] % 4 == FOUND, False)
        cuts = np.sort(np.stack([d[i:j] % (n + 1) for d in draws]), axis=0)
        first = np.append(first, len(body))
        places = [chars[np.where(c == n, end, first[np.minimum(units[:-1] + c, len(first) - 1)])] - chars[start] for c in cuts]
        yield i, j - i, [pa.array(n), pa.array(places[0]), pa.array(places[1]), pa.array(marked)]


def _chunks(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, a, b, text in zip(*(batch.column(k) for k in ("key", "d1", "d2", "text")), strict=True):
                body = memoryview(text.as_buffer())
                for k, start in enumerate(range(0, len(body), chunk)):
                    columns = [pa.array([v]) for v in (key.as_py(), a.as_py(), b.as_py())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([k], pa.int32()), pa.array([bytes(body[start : start + chunk])], pa.binary())], names=["key", "d1", "d2", "chunk", "body"])

    return run


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function, counts and characters of each chunk."""
    for batch in batches:
        rows = []
        for body in batch.column("body"):
            data = np.frombuffer(body.as_buffer(), np.uint8)
            f, counts = composed(*functions(_lanes(data)))
            rows.append((f[-1].astype(np.uint8).tobytes(), counts[-1].tobytes(), int(((data & 0xC0) != 0x80).sum())))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)] if rows else [pa.array([], k) for k in (pa.binary(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("key", "d1", "d2", "chunk")), *columns], names=["key", "d1", "d2", "chunk", "f", "counts", "chars"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text, composed from its chunks: units, sentinels, and for both cuts the chunk, the state it is entered in,
    the units of it before the cut and the characters before it; chunk -1 for a cut at the end."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            parts = row["parts"]
            f = np.frombuffer(b"".join(p["f"] for p in parts), np.uint8).reshape(-1, STATES)
            counts = np.frombuffer(b"".join(p["counts"] for p in parts), np.int64).reshape(-1, STATES)
            f, counts = composed(f, counts)
            chars = np.concatenate([[0], np.cumsum([p["chars"] for p in parts])])
            state, units = np.concatenate([[0], f[:, 0]]), np.concatenate([[0], counts[:, 0]])
            n = int(units[-1])
            for which, c in enumerate(sorted((row["d1"] % (n + 1), row["d2"] % (n + 1)))):
                k = -1 if c == n else int(np.searchsorted(units, c, "right")) - 1
                rows.append((row["key"], n, bool(state[-1] % 4 == FOUND), which, k, int(state[k]), int(c - units[k]), int(chars[k])))
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "n", "marked", "which", "chunk", "entry", "skip", "before"])


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The characters before each cut: those before its chunk and those in it."""
    for batch in batches:
        places = []
        for body, entry, skip, before in zip(*(batch.column(k) for k in ("body", "entry", "skip", "before")), strict=True):
            place = before.as_py()
            if body.is_valid:
                data = np.frombuffer(body.as_buffer(), np.uint8)
                place += int(characters(data)[np.flatnonzero(scanned(data, entry.as_py())[0])[skip.as_py()]])
            places.append(place)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("key", "n", "marked", "which")), pa.array(places, pa.int64())], names=["key", "n", "marked", "which", "place"])


def _fits(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _long(rows: DataFrame, chunk: int) -> DataFrame:
    """(key, n, cut1, cut2, marked) of long texts. ``rows``: key, d1, d2, text; equal keys have equal texts."""
    chunks = cut(rows.mapInArrow(K.tidy(_chunks(chunk)), "key string, d1 long, d2 long, chunk int, body binary").repartition("key", "chunk"))
    told = chunks.mapInArrow(K.tidy(_summaries), "key string, d1 long, d2 long, chunk int, f binary, counts binary, chars long").dropDuplicates(["key", "chunk"])
    parts = told.groupBy("key", "d1", "d2").agg(F.array_sort(F.collect_list(F.struct("chunk", "f", "counts", "chars"))).alias("parts"))
    asked = cut(parts.mapInArrow(K.tidy(_asked), "key string, n long, marked boolean, which int, chunk int, entry int, skip long, before long"))
    held = chunks.select("key", "chunk", "body").join(_fits(asked.select("key", "chunk").distinct()), ["key", "chunk"], "left_semi").dropDuplicates(["key", "chunk"])
    found = asked.join(held, ["key", "chunk"], "left").select("key", "n", "marked", "which", "body", "entry", "skip", "before")
    found = found.mapInArrow(K.tidy(_selected), "key string, n long, marked boolean, which int, place long")
    return cut(found.groupBy("key").agg(F.max("n").alias("n"), F.min("place").alias("cut1"), F.max("place").alias("cut2"), F.bool_or("marked").alias("marked")))


def draw(key: Column, seed: int, part: int) -> Column:
    """The part-th draw of 32 bits of a key: eight digits of the SHA-256 of seed and key."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(named.cast("binary"), 256), 8 * part + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, chunk: int = CHUNK) -> DataFrame:
    """All columns of ``docs``, with n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in RESULTS]
    rows = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"), *(draw(F.col(key), seed, k).alias(f"d{k + 1}") for k in range(4)))
    given = rows.select("row", F.struct("body", "d1", "d2").alias("text"), "d3", "d4")
    size = F.octet_length("text.body")
    results = [("n", "long"), ("cut1", "long"), ("cut2", "long"), ("marked", "boolean")]
    done = through_arrow(given.where(size <= chunk), "text", _short, results)
    # a text with its draws, by which its cuts come back to it
    long = given.where(size > chunk).withColumn("key", F.concat_ws("/", "text.d1", "text.d2", F.sha2(F.col("text.body").cast("binary"), 256)))
    cuts = _long(long.select("key", "text.d1", "text.d2", F.col("text.body").alias("text")), chunk)
    whole = done.unionByName(long.join(_fits(cuts), "key").select("row", "text", "d3", "d4", "n", "cut1", "cut2", "marked"))
    body, a, b = F.col("text.body"), F.col("cut1").cast("int"), F.col("cut2").cast("int")
    form = F.when((F.col("n") == 0) | F.col("marked") | (F.col("d3") % 100 >= CHANGED), "plain").when(F.col("d4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    prefix, middle, suffix = F.substring(body, F.lit(1), a), F.substring(body, a + 1, b - a), F.substring(body, b + 1, F.lit(2**31 - 1) - b)
    output = F.when(F.col("form") == "plain", body).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    chars = lambda c: F.when(F.col("form") != "plain", c)
    shown = whole.withColumn("form", form)
    return shown.select("row.*", "n", "form", chars(F.col("cut1")).alias("prefix_chars"), chars(F.col("cut2") - F.col("cut1")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from."""
    first = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output, 4))
    second = F.locate(MIDDLE, output)
    rest = 2**31 - 1
    one, two, three = F.substring(output, F.lit(4), first - 4), F.substring(output, first + 3, second - first - 3), F.substring(output, second + 3, F.lit(rest) - second)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
