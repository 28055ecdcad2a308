"""Sharding by weighted rendezvous hashing.

Every (record key, shard) pair has a pseudo-random draw; a record goes to the
shard with the best draw for its weight. A record's shard depends on nothing but
its key and the shards, so adding a shard only moves records into the new one.

Edge cases: a null or empty text has no bytes, a very long one all of its own; a null key is
hashed as its own value and has its shard like any other; rows that repeat a key share a
shard and have slots of their own; ties of a draw go to the lower shard, ties of the order of
slots to either row; an empty table gives an empty result; columns beside the named ones,
whatever their names, are carried as they are, but one with the name of a result
column (shard, grown_shard, the slot) gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from recallery.llm.common import free, table

#: Rows of a shard are numbered in this many independent pieces, so that no task
#: sorts a whole shard. The table of offsets has shards x PIECES rows at most.
PIECES = 256


def rendezvous(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The shard (0..n-1) with the smallest -ln(draw) / weight, by Wang-Ravishankar
    hashing in its weighted form. The draw is a hash of key, shard and seed that any system has (MD5), so a record's shard
    can be found without Spark. A weight of 0 takes nothing; ties go to the lower shard."""
    named = F.coalesce(key.cast("string"), F.lit("\x00null"))
    best = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        # 48 bits of the hash as a draw in (0, 1]
        draw = (_number(F.concat(named, F.lit(f"/{shard}/{seed}")), 12).cast("double") + 1.0) / float(2**48)
        best.append(F.struct((-F.log(draw) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    if not best:
        raise ValueError("at least one shard needs a positive weight")
    return (F.least(*best) if len(best) > 1 else best[0])["shard"]


def _number(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of the MD5 of a text as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def number(df: DataFrame, group: str, order: list[str], slot: str = "slot", pieces: int = PIECES) -> DataFrame:
    """Number the rows of each group 0, 1, ... without a gap and without sorting a group in one task.

    Rows fall into ``pieces`` by a hash of their order columns; counts by piece,
    summed up over the pieces, give where each piece starts.
    """
    piece, start, n = (free(df, name) for name in ("_piece", "_start", "_n"))
    dealt = df.withColumn(piece, F.pmod(_number(F.concat_ws("/", *(F.col(c).cast("string") for c in order)), 8), F.lit(pieces)).cast("int"))
    counts = dealt.groupBy(group, piece).agg(F.count("*").alias(n))
    before = W.Window.partitionBy(group).orderBy(piece).rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select(group, piece, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    rank = F.row_number().over(W.Window.partitionBy(group, piece).orderBy(*order)) - 1
    # groups x pieces rows at most, so the broadcast has a proven bound
    return dealt.join(F.broadcast(starts), [group, piece]).withColumn(slot, F.col(start) + rank).drop(piece, start)


def assign(df: DataFrame, key: str, weights: list[float], seed: int = 0) -> DataFrame:
    """All columns of ``df`` and shard int, grown_shard int (with one more shard of the last weight)."""
    return df.withColumns({"shard": rendezvous(F.col(key), weights, seed), "grown_shard": rendezvous(F.col(key), [*weights, weights[-1]], seed)})


def op3_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = assign(sized, "doc_id", [1.0] * shards)
    numbered = number(dealt, "shard", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
