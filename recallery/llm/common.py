"""Shared plumbing of the training-data operators: tables, word splitting in
the JVM, lineage cuts in the shared folder, and connected components."""

from __future__ import annotations

import gc
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.llm.kernels import tidy
from recallery.sources import scratch
from recallery.sources.ship import ship

#: Separators of a plain word, as in the contracts: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of a batch that goes to a Python worker: texts of some thousand bytes make a few MB.
BATCH_ROWS = 1000

#: Edges of a file of an intermediate edge list, about; edges that a task joins at a time; share of the edges that makes a node a hub.
EDGES_OF_A_FILE, EDGES_AT_ONCE, HUB_SHARE = 100_000, 1_000_000, 1000

_cuts = itertools.count(1)


def small_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python in MB, not tens of MB: they are held on both sides, for each core."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column, separators: str = SPACE) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def cut(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: its lineage ends there,
    and the loss of an executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = f"{scratch.folder(spark)}/{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.parquet(path)
    if next(_cuts) % 8 == 0:
        release(df)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def through_arrow(docs: DataFrame, text: str, run, results: list[tuple[str, str]]) -> DataFrame:
    """All columns of ``docs`` and those of ``results`` (name, type), which replace columns of their names. ``run`` goes from
    (the text column of a batch) to an iterator of (first row, number of rows, arrays of the results)."""
    small_batches(docs.sparkSession)
    kinds = {c: k for c, k in zip(docs.columns, (f.dataType.simpleString() for f in docs.schema), strict=True)}
    place = next(i for i, c in enumerate(docs.columns) if c.lower() == text.lower())
    row = free(docs, "_row")
    inner = ",".join(f"`{c.replace('`', '``')}`:{k}" for c, k in kinds.items())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, arrays in run(batch.column(0).field(place)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *arrays], names=[row, *(name for name, _ in results)])

    packed = docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias(row))
    done = packed.mapInArrow(tidy(over), f"{row} struct<{inner}>, " + ", ".join(f"{name} {kind}" for name, kind in results))
    replaced = {name.lower() for name, _ in results}
    kept = [F.col(row)[c].alias(c) for c in docs.columns if c.lower() not in replaced]
    return done.select(*kept, *(name for name, _ in results))


def document_key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart by id and text: the id as text, told from null, and a hash of the text."""
    named = F.when(doc_id.isNull(), "-").otherwise(F.concat(F.lit("+"), doc_id.cast("string")))
    return F.concat_ws("/", named, F.hex(F.xxhash64(F.coalesce(text, F.lit("")))), F.when(text.isNull(), "null"))


def drop(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/recallery/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Let Spark delete shuffle files of queries that have ended; it does so when the driver's garbage goes.
    What Arrow and the JVM hold on the driver for those queries goes too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    df.sparkSession.sparkContext._jvm.System.gc()


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star (u, v), v the smallest node, for each set of nodes that a task's edges join, EDGES_AT_ONCE edges at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out():
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        while (label[a] != label[b]).any():
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
        leaf = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[label[leaf]])], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > EDGES_AT_ONCE:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _least(edges: DataFrame) -> tuple[DataFrame, int, bool]:
    """(u, m, d): the smallest neighbour and the number of neighbours of each u, the number of edges, and whether the edges, given both ways, are stars around their smallest nodes."""
    low = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")))
    told = low.agg(F.sum("d"), F.count_if(~((F.col("m") > F.col("u")) | (F.col("d") == 1)))).first()
    return low, told[0] or 0, not told[1]


def _to_least(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """Edges (u, v) with m, the smallest neighbour of u. The m of hubs, nodes with more than a HUB_SHARE-th of
    all edges and so at most HUB_SHARE of them, is broadcast, so their edges don't meet in one task."""
    most = max(n // HUB_SHARE, 64)
    hubs = low.where(F.col("d") > most).select("u", F.col("m").alias("hm"))
    marked = edges.join(F.broadcast(hubs), "u", "left")
    # an edge of a hub needs no partner: it goes by its other end
    known = F.col("hm").isNotNull()
    marked = marked.select("u", "v", "hm", known.alias("hub"), F.when(known, F.xxhash64("v")).otherwise(F.col("u")).alias("key"))
    rest = low.where(F.col("d") <= most).select(F.lit(False).alias("hub"), F.col("u").alias("key"), "m")
    return marked.join(rest, ["hub", "key"], "left").select("u", "v", F.coalesce("hm", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node reaches, over an edge list.

    Each task joins its edges into stars first. Then alternating large-star and small-star
    steps (Kiveris et al., 2014) until all that is left are stars around smallest nodes. Minima are
    pre-aggregated before each shuffle, and those of hubs broadcast to their edges, so a hub's edges
    stay spread over the tasks; nothing is collected. Nodes without an edge don't appear.
    """
    small_batches(edges.sparkSession)
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = cut(pairs.mapInArrow(tidy(_forests), "u long, v long"))
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        low, n, done = _least(both)
        if done:
            drop(now)
            return low.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
        # few edges need few files
        files = max(4, n // EDGES_OF_A_FILE + 1)
        large = _to_least(both, low, n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = cut(large.where("u <> v").distinct().coalesce(files))
        drop(now)
        drop(low)
        low, n, _ = _least(large)
        small = _to_least(large, low, n).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.where("u <> v").distinct().coalesce(files))
        drop(large)
        drop(low)
