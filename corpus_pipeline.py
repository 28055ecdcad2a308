"""From raw documents to shards of a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs``. A stage's operator sees the named columns only, and what it
decides is joined back by document, the id with a hash of the text: broadcast below a checked
number of rows, else shuffled.

Edge cases: null and empty texts are never toxic, never similar and never contaminated;
the mix takes no words from them, so they go there. Of rows that share a doc_id the second
stage keeps one, the first by its other columns, the same in every run; until then, and where there is no
doc_id, each row is judged by its own text. Rows without a doc_id are never duplicates, and all
else happens to them as to others. Very long texts count whole; ties don't arise, as a group
keeps its smallest doc_id. Empty tables give empty tables. Other columns may have any name; the last
stage replaces columns named shard and grown_shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.llm.common import cut, document_key, free, table
from recallery.llm.decontaminate import decontaminate
from recallery.llm.jaccard import similar
from recallery.llm.mixing import mix, sizes
from recallery.llm.sharding import assign
from recallery.llm.toxicity import filter_toxic

#: Output shards, all of one weight, and rows of a table of ids up to which it is broadcast.
SHARDS, BROADCAST_ROWS = 24, 400_000


def _join(docs: DataFrame, found: DataFrame, on: str, how: str) -> DataFrame:
    fits = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(found) if fits else found, on, how)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key by id and text, and the name of that column."""
    name = free(docs, "_document")
    return docs.withColumn(name, document_key(F.col("doc_id"), F.col("text"))), name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_toxic(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, the one with the smallest doc_id."""
    classes = cut(similar(docs.select("doc_id", "text")))
    gone = classes.where("component_id <> doc_id").select("doc_id").distinct()
    kept = _join(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    twice = cut(classes.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if twice.isEmpty():
        return kept
    row = F.struct(*docs.columns)
    first = _join(kept, twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
    return _join(kept, twice, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item."""
    keyed, key = _keyed(docs)
    found = decontaminate(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = cut(found.where("contaminated").select(F.col("doc_id").alias(key)).distinct())
    return _join(keyed, gone, key, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in whole documents: each stands as often as its share of words taken says, 0 to 3
    times, the fraction rounded by a fixed draw for the document."""
    keyed, key = _keyed(docs)
    taken = mix(sizes(keyed.select(F.col(key).alias("doc_id"), "text", "source")))
    share = taken.groupBy("doc_id").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("share"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("round-0:"), F.col("doc_id"))), 1, 8), 16, 10).cast("double") / float(2**32)
    times, copy = free(keyed, "_copies"), free(keyed, "_copy")
    copies = cut(share.select(F.col("doc_id").alias(key), F.floor(F.col("share") + draw).cast("int").alias(times)).where(F.col(times) > 0))
    return _join(keyed, copies, key, "inner").withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with shard, and grown_shard for one more shard."""
    return assign(docs, "doc_id", [1.0] * SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: Learned scores and the classes of similar texts are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
