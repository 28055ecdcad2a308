"""Quality: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes a vector of statistics (shares of character classes, word lengths,
repetition). Random Fourier features approximate a Gaussian kernel over the standardised
vectors. Every partition sums its part of the normal equations over all labelled training
rows; their total, of a size fixed by the number of features, is solved on the driver.
Ridge scores are binned, and pooling adjacent violators over the bins calibrates them.

Edge cases: a null or empty text has statistics of 0 and a score like any other; a very long
text is read whole; without training rows, or with one class only, every score is the share of
good rows (1 without any); labels that contradict each other on one doc_id count by their mean;
repeated rows get equal scores and are learned from as often as they stand; rows without a
doc_id are scored and never trained on; ties don't arise, as nothing is ordered but bins; an empty table gives an
empty result; other columns, whatever their names, are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.llm import kernels as K
from recallery.llm.common import cut, small_batches, table
from recallery.llm.toxicity import held_out

#: Random features, width of the kernel in standard deviations, ridge, bins of the calibration.
RANDOM, WIDTH, RIDGE, BINS = 256, 4.0, 1e-3, 400


def _class(*bytes_: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(bytes_)] = True
    return out


LETTERS = _class(*range(65, 91), *range(97, 123), *range(128, 256))
_TITLE = _class(*range(65, 91))
_MARKS = _class(*[b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)])
#: Shares of these among the bytes of a text.
CLASSES = [_TITLE, _class(*range(97, 123)), _class(*range(48, 58)), _MARKS, _class(10), _class(*range(128, 256)), _class(33), _class(*b"#$%&*"), _class(124), _class(*b".,;"), _class(*b"<>{}[]=\\/_")]
LINE = np.ones(256, bool)
LINE[10] = False
NAMES = [f"share_{i}" for i in range(len(CLASSES))] + ["log_words", "word_mean", "word_spread", "long_words", "distinct_words", "distinct_pairs", "distinct_lines", "log_line_words", "marked_words", "upper_words", "letters_after"]


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of h in each row, over their number (1 for none)."""
    order = np.lexsort((h, row))
    r, s = row[order], h[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    data, at = K.texts(column)
    out = np.zeros((len(column), len(NAMES)))
    for i, j in K.pieces(at):
        part, edge, n = data[at[i] : at[j]], at[i : j + 1] - at[i], j - i
        size = np.maximum(np.diff(edge), 1)
        columns = []
        for c in CLASSES:
            total = np.concatenate([[0], np.cumsum(c[part], dtype=np.int64)])
            columns.append((total[edge[1:]] - total[edge[:-1]]) / size)
        row, start, end = K.split(part, edge)
        h = K.word_hashes(part, start, end)
        words = np.bincount(row, minlength=n)
        some = np.maximum(words, 1)
        length = (end - start).astype(float)
        mean = np.bincount(row, length, n) / some
        spread = np.sqrt(np.maximum(np.bincount(row, length**2, n) / some - mean**2, 0))
        pair, joint = K.windows(h, row, 2)
        lrow, lstart, lend = K.split(part, edge, LINE)
        lines = np.maximum(np.bincount(lrow, minlength=n), 1)
        upper = np.concatenate([[0], np.cumsum(_TITLE[part], dtype=np.int64)])
        marks = np.concatenate([[0], np.cumsum(_MARKS[part], dtype=np.int64)])
        many = lambda total, least: np.bincount(row, (total[end] - total[start]) >= least, n) / some  # noqa: B023, E731
        columns += [np.log1p(words), mean, spread, np.bincount(row, length > 12, n) / some, _distinct(row, h, n), _distinct(row[pair], joint, n), _distinct(lrow, K.word_hashes(part, lstart, lend), n)]
        columns += [np.log1p(words / lines), many(marks, 2), many(upper, 2), np.bincount(row, LETTERS[part[end - 1]] if len(end) else None, n) / some]
        out[i:j] = np.stack(columns, 1)
    return out


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text"))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], names=["doc_id", "x"])


def statistics_of(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(K.tidy(_stat_batches), "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(NAMES)))


class Model:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w = rng.standard_normal((len(mean), RANDOM)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, RANDOM)
        self.theta = np.zeros(RANDOM + 1)
        self.at, self.value = np.array([0.0]), np.array([1.0])

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / RANDOM) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.theta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def _summing(lift):
    """Batches of (x, y) to one row for a task: the sums of f f', f y and 1 over its rows, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                f = lift(_matrix(part.column("x")))
                f = np.hstack([f, np.array(part.column("y"))[:, None]])
                total = f.T @ f if total is None else total + f.T @ f
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    return run


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for b in batch.column("s"):
            one = np.frombuffer(b.as_py())
            total = one.copy() if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])


def _sum(train: DataFrame, lift) -> np.ndarray | None:
    parts = train.select("x", "y").mapInArrow(K.tidy(_summing(lift)), "s binary").repartition(4).mapInArrow(K.tidy(_merging), "s binary")
    rows = [np.frombuffer(r.s) for r in parts.collect()]  # at most 4, each of fixed size
    if not rows:
        return None
    total = np.sum(rows, 0)
    k = int(round(np.sqrt(len(total))))
    return total.reshape(k, k)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value`` in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([[v] * n for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, train: Column) -> Model:
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    rows = cut(stats.join(known, "doc_id").select("x", "y"))
    first = _sum(rows, lambda x: np.hstack([x, np.ones((len(x), 1))]))
    d = len(NAMES)
    if first is None:
        return Model(np.zeros(d), np.ones(d))
    n, share = first[d, d], first[d, d + 1] / first[d, d]
    mean = first[d, :d] / n
    model = Model(mean, np.sqrt(np.maximum(np.diag(first)[:d] / n - mean**2, 0)) + 1e-6)
    model.value = np.array([share])
    if share in (0.0, 1.0):
        return model
    second = _sum(rows, model.lift)
    k = RANDOM + 1
    model.theta = np.linalg.solve(second[:k, :k] + RIDGE * n / k * np.eye(k), second[:k, k])
    # the calibration sees a bounded table: a row for each bin
    raw = model.raw

    def bins(batches):
        for batch in batches:
            at = np.floor((np.clip(raw(_matrix(batch.column("x"))), -1, 2) + 1) / 3 * BINS)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), batch.column("y")], names=["bin", "y"])

    counted = rows.mapInArrow(K.tidy(bins), "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    model.at = np.array([(r["bin"] + 0.5) / BINS * 3 - 1 for r in counted])
    model.value = isotonic(np.array([r["y"] for r in counted]), np.array([r["n"] for r in counted], float))
    return model


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(statistics_of(table(spark, sf_dir, "documents")))
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(stats, table(spark, sf_dir, "labels"), ~out)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], names=["doc_id", "score"])

    scored = stats.mapInArrow(K.tidy(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
