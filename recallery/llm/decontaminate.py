"""Benchmark decontamination: a prefix-filtered set join of documents with items.

A window is WINDOW consecutive words of an item (an item with fewer words is one
window). A document that contains a window contains each of its shingles, so one
necessary shingle for each window is enough to find it: the rarest one.

1. All words of all documents are hashed once and the hashes kept.
2. Items' shingles are ordered by rarity, counted over all documents.
3. Documents are joined with the necessary shingles alone; neighbouring windows mostly
   share one, so they are few. A window then may begin only within the bounds that the
   shingle's place in the item and in the document leave it.
4. The words around each hit, as many as the windows there can have, are compared with the
   item's words, to the left and to the right as far as both agree. Hashes only propose.

Edge cases: null and empty texts have no words and hit nothing; items without words
have no windows; items with equal words are joined once and all counted; items that share
an item_id are found apart and named once; an item without an item_id hits and is not
named; repeated rows of either table don't change a document's figures; rows that share a
doc_id but not the text are judged apart, as are rows without one; very long texts cost in
proportion to their words and hits; an empty table of documents gives an empty result,
one of items no hits; ties of rarity go by the shingle's hash and place, which any choice
would do for; columns beside the named ones, whatever their names, are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from recallery.llm.common import cut, drop, table, words

WINDOW, SHINGLE = 10, 3
#: Shingles, and anchors with the words around them, up to which a join broadcasts them; beyond, it shuffles.
BROADCAST_ROWS, BROADCAST_ANCHORS = 200_000, 50_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A document row: its id, told from null, and a hash of its text, which tells apart what shares an id.
DOC = ["_d", "_h"]


def item_words(text: Column) -> Column:
    return words(F.translate(text, UPPER, LOWER), SEPARATORS)


def _keyed(docs: DataFrame) -> DataFrame:
    """(_d, _h, doc_id, text)."""
    named = F.when(F.col("doc_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("doc_id").cast("string")))
    return docs.select(named.alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), "doc_id", "text")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.hash(w))


def _tokens(hashed: DataFrame, m: int) -> DataFrame:
    """All columns, pos and token, the hash of the m words from each position on. ``hashed`` has the words' hashes as ``hs``."""
    each = hashed.select("*", F.posexplode("hs").alias("pos", "_w")).where(F.col("pos") <= F.size("hs") - m)
    return each.withColumn("token", F.xxhash64("_w", *(F.get("hs", F.col("pos") + j) for j in range(1, m)))).drop("_w", "hs")


def _join(large: DataFrame, small: DataFrame, on, most: int = 0, how: str = "inner") -> DataFrame:
    """Broadcast the item side only while it is below a checked number of rows; else shuffle."""
    most = most or BROADCAST_ROWS
    fits = small.limit(most + 1).count() <= most
    return large.join(F.broadcast(small) if fits else small, on, how)


def patterns(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gid, words, n, m) of the distinct word lists of the items, m the words of a shingle, and (gid, item_id)."""
    split = items.select("item_id", item_words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    n = F.size("words")
    kinds = cut(split.select("words").distinct().select(F.monotonically_increasing_id().alias("gid"), "words", n.alias("n"), F.least(n, F.lit(SHINGLE)).alias("m")))
    return kinds, cut(split.join(kinds, "words").select("gid", "item_id").distinct())


def anchors(kinds: DataFrame, tokens: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each shingle that is the rarest of some window: aid, m, token, the item's words before it
    (nearest first) and from it on as far as those windows go, how many of them start before and
    after its place, and the words of a window. Then (aid, gid): equal rows of several items are one."""
    ranked = tokens.join(counts, ["m", "token"], "left").withColumn("rank", F.struct(F.coalesce("count", F.lit(0)).alias("c"), "token", "pos"))
    place = W.Window.partitionBy("gid").orderBy("pos")
    window = F.least("n", F.lit(WINDOW))
    # a window of w words holds w - m + 1 shingles; one starts wherever all of it lies in the item
    best = ranked.withColumns({"best": F.min("rank").over(place.rowsBetween(0, WINDOW - SHINGLE)), "window": window}).where(F.col("pos") + F.col("window") <= F.col("n"))
    owned = best.groupBy("gid", "m", "window", F.col("best.pos").alias("o"), F.col("best.token").alias("token")).agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    o, a, b = F.col("o"), F.col("a"), F.col("b")
    rows = owned.join(kinds.select("gid", "words"), "gid").select(
        "gid", "m", "token", "window", F.reverse(F.slice("words", a + 1, o - a)).alias("left"), F.slice("words", o + 1, b - o + F.col("window")).alias("right"), (o - a).alias("before"), (b - o).alias("after")
    )
    what = ["m", "token", "window", "left", "right", "before", "after"]
    grouped = cut(rows.groupBy(*what).agg(F.collect_set("gid").alias("gids")).withColumn("aid", F.monotonically_increasing_id()))
    return grouped.drop("gids"), grouped.select("aid", F.explode("gids").alias("gid"))


def _run(found: Column, asked: Column) -> Column:
    """How many leading elements of two arrays agree."""
    same = F.zip_with(found, asked, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False).cast("int")
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def spans(docs: DataFrame, hashed: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_d, _h, start, end, aid) for each run of windows found in a document (in words, end exclusive), and
    (aid, item_id). ``docs``: _d, _h, text; ``hashed``: _d, _h, hs."""
    kinds, members = patterns(items)
    sizes = [r[0] for r in kinds.select("m").distinct().collect()]  # of 1, 2 and 3

    def each(rows: DataFrame, cut_by) -> DataFrame:
        """What ``cut_by`` gives for the tokens of each shingle length, with m."""
        out = None
        for m in sizes or [SHINGLE]:
            of = cut_by(_tokens(rows.where(F.col("m") == m) if "m" in rows.columns else rows, m), m)
            out = of if out is None else out.unionByName(of)
        return out

    tokens = cut(each(kinds.select("gid", "n", "m", _hashed(F.col("words")).alias("hs")), lambda t, _: t))
    asked = tokens.select("m", "token").distinct()

    def hits(rows: DataFrame) -> DataFrame:
        """(_d, _h, m, pos, token) of the documents' shingles that are among ``rows`` (m, token)."""
        return each(hashed.select(*DOC, "hs"), lambda t, m: _join(t, rows.where(F.col("m") == m).select("token"), "token").select(*DOC, F.lit(m).alias("m"), "pos", "token"))

    counts = hits(asked).groupBy("m", "token").agg(F.count("*").alias("count"))
    side, groups = anchors(kinds, tokens, counts)
    listed = cut(hits(side.select("m", "token").distinct()).groupBy(*DOC).agg(F.collect_list(F.struct("m", "pos", "token")).alias("hits")))
    # the words around each hit; the rows of documents repeat, their keys do not
    texts = _join(docs.select(*DOC, "text"), listed, DOC).dropDuplicates(DOC)
    at = texts.select(*DOC, item_words(F.col("text")).alias("words"), "hits").select(*DOC, "words", F.explode("hits").alias("x")).select(*DOC, "words", "x.m", "x.pos", "x.token")
    pos = F.col("pos")
    before = F.least(pos, F.lit(WINDOW))
    around = at.select(*DOC, "m", "pos", "token", F.reverse(F.slice("words", pos - before + 1, before)).alias("back"), F.slice("words", pos + 1, F.lit(2 * WINDOW)).alias("ahead"))
    run = _join(around, side, ["m", "token"], BROADCAST_ANCHORS).withColumns({"l": _run(F.col("back"), F.col("left")), "r": _run(F.col("ahead"), F.col("right"))})
    # windows that start at pos - lo .. pos + hi hold only words that agree
    run = run.withColumns({"lo": F.least("l", "before"), "hi": F.least("after", F.col("r") - F.col("window"))}).where("-lo <= hi")
    found = run.select(*DOC, (pos - F.col("lo")).alias("start"), (pos + F.col("hi") + F.col("window")).alias("end"), "aid")
    return found, groups.join(members, "gid").select("aid", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    keyed = _keyed(docs)
    hashed = cut(keyed.select(*DOC, "doc_id", _hashed(item_words(F.col("text"))).alias("hs")))
    found, members = spans(keyed, hashed, items)
    found = cut(found.distinct())
    order = W.Window.partitionBy(*DOC).orderBy("start", "end").rowsBetween(W.Window.unboundedPreceding, -1)
    runs = found.select(*DOC, "start", "end").distinct().withColumn("seen", F.coalesce(F.max("end").over(order), F.lit(0)))
    hit = runs.groupBy(*DOC).agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "seen"), F.lit(0))).alias("n_hit"))
    listed = found.select(*DOC, "aid").distinct().join(members, "aid").groupBy(*DOC).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = cut(hit.join(listed, DOC, "left"))
    sized = cut(hashed.select(*DOC, "doc_id", F.size("hs").cast("long").alias("n_words")))
    drop(hashed)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return _join(sized, both, DOC, how="left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.when(F.col("items").isNull(), none).otherwise(F.sha2(F.array_join("items", ","), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
