"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic documents are the positives; a sample of all documents, labelled or not, is
the unlabelled text with its unknown share of toxic ones. A linear classifier over the
presence of words and of word beginnings is trained in numpy on the risk
pi R_p(+) + max(0, R_u(-) - pi R_p(-)) with the sigmoid loss, pi the class prior.

The fit uses bounded samples: MOST_POSITIVE confirmed and MOST_UNLABELLED
documents of any label, those with the smallest hashes of their doc_id. Features are counted
over the sample in all tasks; one task then trains on the FEATURES chosen, so the driver sees
no more than their names and weights. Scores cover every whole text.

Edge cases: null and empty texts have no features and get the score of the intercept,
below 0.5; very long texts are scored whole; without confirmed toxic rows every score is 0;
labels that contradict each other on one doc_id count as toxic; of rows that repeat a doc_id
one is learned from; repeated rows get equal scores; ties don't arise, as the sample's order
ends with the doc_id and that of equally telling features with their hash; an empty table
gives an empty result; other columns are kept by ``filter_toxic``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallery.llm import kernels as K
from recallery.llm.common import cut, drop, small_batches, table

MOST_POSITIVE, MOST_UNLABELLED = 4000, 8000
#: Features kept, occurrences among the positives that one needs, epochs and step of the training.
FEATURES, LEAST, EPOCHS, STEP = 1500, 5, 250, 0.05
#: Standard errors by which a feature must be more frequent among the positives than in unlabelled text.
SURPRISE = 4.0
#: Bytes of the beginnings of words that are features beside whole words.
BEGINNINGS = (4, 5, 6)

#: Letters and digits of ASCII, and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def held_out(key: Column, folds: int, fold: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds == fold


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each piece of a text column: first row, number of rows, and (row, feature) without repeats."""
    for first, n, row, start, end, h, part in K.hashed(column, True, WORD):
        rows, names = [row], [h]
        for size in BEGINNINGS:
            long = np.flatnonzero(end - start > size)
            rows.append(row[long])
            names.append(K.mix(K.word_hashes(part, start[long], start[long] + size) + K.U(size)))
        row, name = np.concatenate(rows), np.concatenate(names) >> K.U(32)
        both = np.unique((row.astype(K.U) << K.U(32)) | name)
        yield first, n, (both >> K.U(32)).astype(np.int64), (both & K.U(0xFFFFFFFF)).astype(np.uint32)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, n, row, name in features(batch.column("text")):
            at = np.searchsorted(row, np.arange(n + 1))
            out += [name[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(out, pa.binary())], names=["doc_id", "positive", "names"])


def sample(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """(positive, names) of the documents to fit on; the ids, bounded by the parameters, are broadcast."""
    known = labels.where(train & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    positive = known.where("toxic = 1").select("doc_id").orderBy(*order).limit(MOST_POSITIVE)
    # unlabelled text stands for all text, so confirmed documents may be among it
    other = docs.where(train & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(*order).limit(MOST_UNLABELLED)
    ids = other.withColumn("positive", F.lit(False)).unionByName(positive.withColumn("positive", F.lit(True)))
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "positive", "text")
    packed = found.mapInArrow(K.tidy(_pack), "doc_id long, positive boolean, names binary")
    return packed.groupBy("doc_id", "positive").agg(F.min("names").alias("names")).select("positive", "names")


class Model:
    """Feature names in order, their weights and the intercept."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        if len(self.names):
            for first, n, row, name in features(column):
                at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
                hit = self.names[at] == name
                out[first : first + n] += np.bincount(row[hit], weights=self.weights[at[hit]], minlength=n)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def nnpu(x: np.ndarray, n: int, prior: float, epochs: int = EPOCHS, step: float = STEP) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative PU risk with the sigmoid loss, by Adam.
    ``x``: rows of 0 and 1, the first n of them positive, the others unlabelled."""
    return _nnpu(*np.nonzero(x), *x.shape, n, prior, epochs, step)


def _nnpu(row: np.ndarray, column: np.ndarray, rows: int, columns: int, n: int, prior: float, epochs: int = EPOCHS, step: float = STEP) -> tuple[np.ndarray, float]:
    """``nnpu`` with the ones of x by row and column."""
    m = rows - n
    # one more for the bias; Adam's moments
    theta = np.zeros(columns + 1)
    theta[-1] = -1.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, epochs + 1):
        z = np.bincount(row, theta[column], rows) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # the loss of calling z positive is 1 - s, of calling it negative s; both have slope s (1 - s)
        slope = s * (1 - s)
        g = np.zeros(rows)
        negative = s[n:].mean() - prior * s[:n].mean()
        if negative >= 0:
            g[:n] = -2 * prior * slope[:n] / n
            g[n:] = slope[n:] / m
        else:  # the negative risk went below what is possible: climb back on it alone
            g[:n] = prior * slope[:n] / n
            g[n:] = -slope[n:] / m
        grad = np.append(np.bincount(column, g[row], columns), g.sum()) + 1e-5 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta -= step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, p, u): in how many positive and unlabelled rows of a batch a feature stands."""
    for batch in batches:
        mark = batch.column("positive").to_pylist()
        for kind in (True, False):
            held = [np.frombuffer(b, np.uint32) for b, k in zip(batch.column("names").to_pylist(), mark, strict=True) if k is kind]
            if held:
                name, n = np.unique(np.concatenate(held), return_counts=True)
                none = np.zeros_like(n)
                yield pa.RecordBatch.from_arrays([pa.array(name.astype(np.int64)), pa.array(n if kind else none), pa.array(none if kind else n)], names=["name", "p", "u"])


def _encoding(names: np.ndarray):
    """Rows by the numbers of their chosen features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.isin(names, np.frombuffer(b, np.uint32), assume_unique=True)).astype(np.int32).tobytes() for b in batch.column("names").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.binary())], names=["positive", "at"])

    return run


def _training(columns: int, prior: float):
    """All encoded rows, at most MOST_POSITIVE + MOST_UNLABELLED of at most FEATURES numbers, to one row of weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held += zip(batch.column("positive").to_pylist(), batch.column("at").to_pylist(), strict=True)
        if held:
            # one order however the rows arrive
            held.sort(key=lambda r: (not r[0], r[1]))
            at = [np.frombuffer(b, np.int32) for _, b in held]
            row, column = np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at).astype(np.int64)
            weights, bias = _nnpu(row, column, len(at), columns, sum(k for k, _ in held), prior)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, prior: float | None = None) -> Model:
    """A model from the rows for which ``train`` holds. Without a prior, the share of toxic rows among the labels is it."""
    small_batches(docs.sparkSession)
    packed = cut(sample(docs, labels, train))
    sizes = packed.agg(F.count_if("positive").alias("n"), F.count_if(~F.col("positive")).alias("m")).first()
    n, m = sizes["n"], sizes["m"]
    if not n or not m:
        return Model(np.zeros(0, np.uint32), np.zeros(0), -60.0 if not n else 60.0)
    if prior is None:
        prior = float(labels.where(train).agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.1)
    counted = packed.mapInArrow(K.tidy(_counting), "name long, p long, u long").groupBy("name").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # how much more often among the positives than the prior explains in unlabelled text
    rated = counted.where(F.col("p") >= LEAST).select("name", (F.col("p") / F.lit(n)).alias("rp"), ((F.col("u") + 1) / F.lit(m)).alias("ru"))
    gain = rated.withColumn("gain", (F.col("rp") - F.col("ru")) / F.sqrt(F.col("ru") / F.lit(n) + 1e-12))
    best = gain.where((F.col("gain") >= SURPRISE) & (F.col("rp") >= 2 * F.col("ru"))).orderBy(F.desc("gain"), "name").limit(FEATURES)
    names = np.sort(np.array([r["name"] for r in best.select("name").collect()], np.uint32))
    encoded = packed.mapInArrow(K.tidy(_encoding(names)), "positive boolean, at binary").repartition(1)
    done = encoded.mapInArrow(K.tidy(_training(len(names), min(max(prior, 0.005), 0.9))), "weights binary, bias double").first()
    drop(packed)
    return Model(names, np.frombuffer(done["weights"]), done["bias"])


def _scorer(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.scores(batch.column("text")), pa.float64())], names=[*keep, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each text."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(K.tidy(_scorer(model, ["doc_id"])), "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~out))
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic, all columns kept; the model learns as ``op7_toxicity`` does."""
    train = ~held_out(F.col("doc_id"), 5, 0)
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), train)
    named = docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns if c not in ("doc_id", "text")})
    schema = T.StructType([*named.schema.fields, T.StructField("score", T.DoubleType())])
    kept = named.mapInArrow(K.tidy(_scorer(model, named.columns)), schema).where("score < 0.5").drop("score")
    return kept.toDF(*docs.columns)
