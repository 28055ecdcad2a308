"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's text is one stream of words, its documents in a seeded order. The
streams are cut into blocks of equal length, of one word where a source holds few
blocks. Sainte-Lague apportionment (highest
quotients target / (2k + 1)) gives each source an integer number of blocks for each
output shard; it is house monotone, so the quotas of the shards are differences of
allocations that only grow. Which blocks a source gives is a seeded systematic
choice: whole passes over the stream first, then blocks spread evenly over it. The shards
share out those blocks in this order, each as many as its quota, so the repeats of a block go to
different shards wherever a pass is longer than a shard's quota. How many words of a document
the mix takes for each shard then follows from where the document lies in the stream.

Edge cases: a null or empty text has size 0 and gives nothing; the null source is a
source of its own, last in order, and differs from one named by an empty text; a null
doc_id has its place in the stream like any other; a very long text is a stretch of many blocks,
in several shards maybe; a table without words gives targets of 0, an empty table an empty result;
repeated rows count each time, ties in the stream's order break by doc_id and then size;
columns beside doc_id, text and source, whatever their names, are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from recallery.llm.common import cut, table, words

#: Words in a block, output shards, and how often a source may be repeated.
BLOCK, SHARDS, REPEATS, SEED = 32, 16, 3, "mix-0"
#: Sources below so many blocks are dealt in blocks of a word: a last block that is not full would weigh too much there.
FINE = 64


def targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """From (source, n): target words of each source.

    Weights 1, 2, 3, 1, ... by code point, null last; a source's target stops at
    ``repeats`` times its words and what it can't take is shared again. The water
    level is found from running sums over the sources in the order in which they
    fill. The windows here hold one row for each source, not for each document.
    """
    by_name = W.Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.select("source", "n", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("long").alias("w"), F.row_number().over(by_name).alias("rank"))
    fills = W.Window.orderBy((F.col("n").cast("double") * repeats / F.col("w")), "rank")
    whole = W.Window.orderBy(F.lit(0)).rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    before = fills.rowsBetween(W.Window.unboundedPreceding, -1)
    onward = fills.rowsBetween(W.Window.currentRow, W.Window.unboundedFollowing)
    level = ranked.select("*", (F.sum("n").over(whole) - repeats * F.coalesce(F.sum("n").over(before), F.lit(0))).alias("left"), F.sum("w").over(onward).alias("weights"))
    # the first source in that order that does not fill fixes the level for all after it
    level = level.withColumn("open", F.col("left") * F.col("w") < repeats * F.col("n") * F.col("weights"))
    all_fills = fills.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    found = level.withColumn("at", F.first(F.when(F.col("open"), F.struct("left", "weights")), ignorenulls=True).over(all_fills))
    share, most = F.col("at.left").cast("double") * F.col("w") / F.col("at.weights"), (repeats * F.col("n")).cast("double")
    return found.select("source", "n", "w", "rank", F.coalesce(F.least(share, most), most).alias("target"))


def apportion(votes: DataFrame, block: int = BLOCK, shards: int = SHARDS, fine: int = 0, repeats: int = REPEATS) -> DataFrame:
    """(source, shard, quota): blocks of each source in each output shard.

    Sources below ``fine`` blocks are apportioned among themselves, in blocks of a word.
    No source gets more than ``repeats`` times its blocks; further seats go to the next
    highest quotients. Two divisors around the exact one bracket the seats: rounding
    target / divisor up to the limit differs from the exact quotient by half a seat at
    most, so water levels as in targets() give them. What the larger divisor gives is
    certain; only the quotients between both, about two for each source, are ranked.
    So no row is made for each seat, however many blocks there are.
    """
    unit = F.when(F.col("n") < block * fine, 1).otherwise(block)
    whole = W.Window.partitionBy("unit")
    sized = votes.select("source", "rank", "target", unit.alias("unit"), (F.ceil(F.col("n") / unit) * repeats).cast("long").alias("most"))
    houses = sized.withColumn("total", F.sum("target").over(whole)).withColumn("house", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    houses = houses.withColumn("seats", F.floor(F.col("total") / F.col("unit") * F.col("house") / shards + 0.5).cast("long"))
    each = W.Window.partitionBy("unit", "house")
    asks = F.col("target") > 0

    def bracket(rows: DataFrame, name: str, half: float) -> DataFrame:
        """Seats at the level x where the sum of least(target x + half, most) over the sources is the number of seats."""
        full = (F.col("most") - half) / F.when(asks, F.col("target"))
        fills = each.orderBy(full.asc_nulls_last(), "rank")
        before, onward = fills.rowsBetween(W.Window.unboundedPreceding, -1), fills.rowsBetween(W.Window.currentRow, W.Window.unboundedFollowing)
        left = F.col("seats") - F.coalesce(F.sum(F.when(asks, F.col("most"))).over(before), F.lit(0)) - half * F.sum(asks.cast("long")).over(onward)
        level = rows.withColumn("_x", F.when(asks, left / F.sum(F.when(asks, F.col("target"))).over(onward))).withColumn("_open", F.col("_x") < full)
        level = level.withColumn("_at", F.first(F.when(F.col("_open"), F.col("_x")), ignorenulls=True).over(fills.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)))
        # a hair to the safe side, for rounding
        got = F.floor(F.col("target") * F.col("_at") * (1 - half * 2e-9) + 0.5)
        got = F.least(F.greatest(F.coalesce(got, F.col("most")), F.lit(0)), "most")
        return level.withColumn(name, F.when(asks, got).otherwise(0).cast("long")).drop("_x", "_open", "_at")

    based = bracket(bracket(houses, "sure", 0.5), "likely", -0.5)
    based = based.withColumn("more", F.least(F.col("likely") - F.col("sure"), "seats").cast("int")).withColumn("left", F.col("seats") - F.sum("sure").over(each))
    tried = based.where("more > 0 and left > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("more") - 1)).alias("k"))
    quotient = F.col("target") / (2 * (F.col("sure") + F.col("k")) + 1)
    ranked = tried.withColumn("place", F.row_number().over(each.orderBy(quotient.desc(), "rank")))
    extra = ranked.where("place <= left").groupBy("house", "rank").agg(F.count("*").alias("extra"))
    seats = based.join(extra, ["house", "rank"], "left").select("source", "rank", "house", (F.col("sure") + F.coalesce("extra", F.lit(0))).alias("seats"))
    grown = F.col("seats") - F.coalesce(F.lag("seats").over(W.Window.partitionBy("rank").orderBy("house")), F.lit(0))
    return seats.select("source", "rank", F.col("house").alias("shard"), grown.alias("quota"))


def mix(sized: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """From (doc_id, source, size): the same with source_size, target, taken and by_shard, an array of the words taken for each shard.

    A source's stream is summed up in 4,096 pieces of the seeded order, so no task
    orders a whole source.
    """
    # sizes are read three times, the texts behind them once
    sized = cut(sized.select("doc_id", "source", "size"))
    source, doc = F.col("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    dealt = sized.withColumns({"_key": F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)), "_h": F.md5(F.concat(F.lit(f"{seed}:"), doc))})
    dealt = dealt.withColumn("_piece", F.substring("_h", 1, 3))
    pieces = dealt.groupBy("_key", "_piece").agg(F.first("source").alias("source"), F.sum("size").alias("n"))
    order = W.Window.partitionBy("_key").orderBy("_piece").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = pieces.select("_key", "_piece", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_start"))
    votes = targets(pieces.groupBy("_key").agg(F.first("source").alias("source"), F.sum("n").alias("n")))
    quotas = apportion(votes, block, shards, FINE).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("each"))  # a row for each shard
    # blocks of the shards so far, from 0 on
    upto = F.aggregate("each", F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["quota"])))
    quotas = quotas.select("rank", upto.alias("_ends")).withColumn("q", F.element_at("_ends", -1))
    first = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long")
    unit = F.when(F.col("n") < block * FINE, 1).otherwise(block).cast("long")
    blocks = F.greatest(F.ceil(F.col("n") / unit), F.lit(1)).cast("long")
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source")))
    plan = votes.join(quotas, "rank").select(
        key.alias("_key"), F.col("n").alias("source_size"), "target", "_ends", unit.alias("_unit"), blocks.alias("_blocks"), F.pmod(first, blocks).alias("_seed"),
        F.call_function("div", F.col("q"), blocks).alias("_passes"), F.pmod("q", blocks).alias("_some"),
    )
    within = W.Window.partitionBy("_key", "_piece").orderBy("_h", "doc_id", "size")
    run = F.sum("size").over(within.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)) - F.col("size")
    # the documents are already dealt by these keys, so only the short table of starts moves
    joined = dealt.withColumn("_run", run).join(starts.join(plan, "_key"), ["_key", "_piece"])

    def partly(x):
        """Words that the last, partial pass takes of the first x: of the first b blocks it takes (b some + seed) div blocks, from a seeded one on."""
        wide = "decimal(19,0)"
        full = lambda b: F.call_function("div", b.cast(wide) * F.col("_some").cast("decimal(18,0)") + F.col("_seed").cast("decimal(18,0)"), F.col("_blocks").cast(wide))
        b = F.floor(x / F.col("_unit")).cast("long")
        return (full(b) * F.col("_unit") + F.pmod(x, F.col("_unit")) * (full(b + 1) - full(b))).cast("long")

    def first_blocks(x, rest, q):
        """Words that the first q blocks chosen take of the first x; ``rest`` is partly(x)."""
        whole = [F.when(F.col("_passes") > p, F.least(x, F.col("_unit") * F.least(F.greatest(q - F.col("_blocks") * p, F.lit(0)), "_blocks"))).otherwise(0) for p in range(REPEATS)]
        return sum(whole[1:], whole[0]) + F.least(rest, F.col("_unit") * F.greatest(q - F.col("_blocks") * F.col("_passes"), F.lit(0)))

    at = joined.withColumn("_x0", F.col("_start") + F.col("_run")).withColumn("_x1", F.col("_x0") + F.col("size"))
    at = at.withColumns({"_r0": partly(F.col("_x0")), "_r1": partly(F.col("_x1"))})
    sums = F.transform("_ends", lambda q: first_blocks(F.col("_x1"), F.col("_r1"), q) - first_blocks(F.col("_x0"), F.col("_r0"), q))
    at = at.withColumn("_sums", sums)
    by_shard = F.zip_with(F.slice("_sums", 2, shards), F.slice("_sums", 1, shards), lambda x, y: x - y)
    return at.select("doc_id", "source", "size", "source_size", "target", F.element_at("_sums", -1).alias("taken"), by_shard.alias("by_shard"))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With shard_words: shard:words of the shards that take any, from shard 1 on."""
    mixed = mix(sizes(table(spark, sf_dir, "documents")))
    named = F.transform("by_shard", lambda w, i: F.when(w > 0, F.concat_ws(":", (i + 1).cast("string"), w.cast("string"))))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.array_compact(named), ",").alias("shard_words"))
