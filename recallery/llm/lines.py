"""Line dedup by content-defined chunks.

A rolling hash over the hashes of the last ROLL lines marks chunk boundaries, so an
insertion moves only the boundaries next to it. A chunk of two or more lines whose
bytes occur earlier (smaller doc_id, or earlier in the document) is removed; hashes
only propose, the bytes decide.

Edge cases: a null text stays null and has no lines; an empty text is one empty line; a very
long text or line is taken whole; chunks of a single line and chunks of blank lines only are
kept; repeated rows with one doc_id and text count as one document and get one result each;
rows that share a doc_id but not the text are documents of their own, as are rows without
a doc_id, which come first; of equal chunks the first by doc_id, text hash and place stays, so
ties don't arise; an empty table gives an empty result; other columns, whatever their names, are carried as
they are, but kept_text, n_lines and n_removed are those of the result.

Chunks miss repeats: a repeated line next to differing ones may stand in a chunk that
differs, or alone in one. ``op2_lines_whole`` has no chunks: every LEAST lines in a row
whose bytes occur earlier are removed, wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.llm.common import cut, document_key, table

#: Lines under the rolling hash, one boundary in so many lines, and lines of a chunk at least.
ROLL, EVERY, LEAST = 2, 3, 2
#: Rows of a table of document keys up to which a join broadcasts it.
BROADCAST_ROWS = 400_000
RESULTS = ("kept_text", "n_lines", "n_removed")
#: Constants of the rolling hash, a polynomial over 28-bit line hashes.
BASE, MODULUS = 131, 1_000_003


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunked(docs: DataFrame) -> DataFrame:
    """The same rows with n_lines (long) and chunks, an array of the chunks in order,
    each its lines joined by newlines; null for a null text.

    Every line is written behind a newline and a mark, s where a chunk starts and c
    elsewhere; so the text can be cut at newline and s, in one pass over it.
    """
    lines = docs.withColumn("_lines", F.split("text", "\n", -1))
    hashed = lines.withColumn("_h", F.transform("_lines", line_hash))
    # the rolling hash at line i is h[i] + BASE h[i-1] + ...; lines before the first count as 0
    rolled = F.col("_h")
    for j in range(1, ROLL):
        earlier = F.concat(F.array_repeat(F.lit(0).cast("long"), j), F.col("_h"))
        weight = F.lit(BASE**j)
        rolled = F.zip_with(rolled, F.slice(earlier, 1, F.size("_h")), lambda x, y: x + y * weight)  # noqa: B023
    # a line starts a chunk where the line before it ends one
    before = F.slice(F.concat(F.array(F.lit(0).cast("long")), rolled), 1, F.size("_h"))
    marked = F.zip_with("_lines", before, lambda line, r: F.concat(F.when(r % MODULUS % EVERY == 0, "\ns").otherwise("\nc"), line))
    whole = hashed.withColumn("_whole", F.substring(F.array_join(marked, ""), 3, 2**31 - 1))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    return whole.select(*docs.columns, n.alias("n_lines"), F.transform(F.split("_whole", "\ns", -1), lambda c: F.replace(c, F.lit("\nc"), F.lit("\n"))).alias("chunks"))


def _with(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Documents joined with a table of keys: broadcast while that is below a checked number of rows, else shuffled."""
    fits = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(found) if fits else found, "_key", how)


def repeated(docs: DataFrame) -> DataFrame:
    """(_key, chunk, n) of the chunks to remove. ``docs``: doc_id, text, _key."""

    def bodies(rows: DataFrame) -> DataFrame:
        each = chunked(rows).select(*[c for c in rows.columns if c != "text"], F.posexplode("chunks").alias("chunk", "body"))
        many = each.withColumn("n", F.size(F.split("body", "\n", -1))).where((F.col("n") >= LEAST) & F.col("body").rlike(r"[^\s]"))
        return many.withColumn("hash", F.xxhash64("body"))

    # hashes first, without the bytes: only chunks whose hash repeats are compared
    each = cut(bodies(docs).select("_key", "chunk", "hash"))
    counts = each.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash")
    asked = cut(each.join(counts, "hash", "left_semi").groupBy("_key").agg(F.collect_set("chunk").alias("asked")))
    some = bodies(_with(docs, asked, "inner")).where(F.array_contains("asked", F.col("chunk")))
    some = cut(some.select("doc_id", "_key", "chunk", "n", "hash", "body"))
    # the first occurrence of each byte string; hot strings shrink to a row for each task before they move
    at = F.struct("doc_id", "_key", "chunk")
    first = some.groupBy("hash", "body").agg(F.min(at).alias("first"))
    found = some.join(first, ["hash", "body"]).where(at > F.col("first"))
    return found.select("_key", "chunk", "n").distinct()


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, _key and, as _row, all columns that are to be carried."""
    return docs.select("doc_id", "text", document_key(F.col("doc_id"), F.col("text")).alias("_key"), F.struct(*[c for c in docs.columns if c.lower() not in RESULTS]).alias("_row"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with kept_text, n_lines and n_removed."""
    keyed = _packed(docs)
    gone = cut(repeated(keyed.select("doc_id", "text", "_key")).groupBy("_key").agg(F.collect_set("chunk").alias("_gone"), F.sum("n").alias("_removed")))
    whole = chunked(_with(keyed, gone, "left"))
    left = F.filter("chunks", lambda _, i: ~F.array_contains("_gone", i))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return whole.select("_row.*", kept.alias("kept_text"), "n_lines", F.coalesce("_removed", F.lit(0)).cast("long").alias("n_removed"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def _mask(at: Column) -> Column:
    """Sorted distinct places as an array of booleans, true at each of them."""
    before = F.slice(F.concat(F.array(F.lit(-1)), at), 1, F.size(at))
    return F.flatten(F.zip_with(at, before, lambda x, y: F.concat(F.array_repeat(F.lit(False), x - y - 1), F.array(F.lit(True)))))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(_key, at): where a window of LEAST lines starts that occurs earlier. ``docs``: doc_id, text, _key."""

    def bodies(rows: DataFrame) -> DataFrame:
        lines = rows.withColumn("_lines", F.split("text", "\n", -1))
        n = F.greatest(F.size("_lines") - LEAST + 1, F.lit(0))
        joined = F.slice("_lines", 1, n)
        for j in range(1, LEAST):
            joined = F.zip_with(joined, F.slice("_lines", j + 1, n), lambda x, y: F.concat(x, F.lit("\n"), y))
        each = lines.select(*[c for c in rows.columns if c != "text"], F.posexplode(joined).alias("at", "body"))
        return each.where(F.col("body").rlike(r"[^\s]")).withColumn("hash", F.xxhash64("body"))

    # as in repeated(): hashes first, then the bytes of windows whose hash repeats
    each = cut(bodies(docs).select("_key", "at", "hash"))
    counts = each.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash")
    asked = each.join(counts, "hash", "left_semi").groupBy("_key").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    asked = cut(asked.select("_key", _mask(F.col("ats")).alias("asked")))
    some = cut(bodies(_with(docs, asked, "inner")).where(F.get("asked", F.col("at"))).select("doc_id", "_key", "at", "hash", "body"))
    # all but the first occurrence of each byte string; the places are matched by document, so no hot string meets in one task
    first = some.groupBy("hash", "body").agg(F.min(F.struct("doc_id", "_key", "at")).alias("first")).select("first._key", "first.at")
    return some.select("_key", "at").distinct().join(first, ["_key", "at"], "left_anti")


def dedup_windows(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with kept_text, n_lines and n_removed; by windows of lines, not chunks."""
    keyed = _packed(docs)
    lost = repeated_windows(keyed.select("doc_id", "text", "_key")).select("_key", F.explode(F.array(*[F.col("at") + j for j in range(LEAST)])).alias("at"))
    lost = lost.groupBy("_key").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    gone = cut(lost.select("_key", _mask(F.col("ats")).alias("_gone"), F.size("ats").cast("long").alias("_removed")))
    whole = _with(keyed, gone, "left").withColumn("_lines", F.split("text", "\n", -1))
    left = F.filter("_lines", lambda _, i: ~F.coalesce(F.get("_gone", i), F.lit(False)))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    return whole.select("_row.*", kept.alias("kept_text"), n.alias("n_lines"), F.coalesce("_removed", F.lit(0)).cast("long").alias("n_removed"))


def op2_lines_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
