"""BM25 over entities: postings, statistics and soft matching of question keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recallery.functions import text as X
from recallery.functions.porter import stemmed
from recallery.schema import BM25_B, BM25_EPSILON, BM25_K1, MIN_REL_SCORE, TOP_K_PER_KEY
from recallery.sources.scratch import settle, spread
from recallery.sources.ship import ship


#: Whether a profile stems, and its stop words.
PROFILES = {"plain": (False, X.STOPWORDS), "porter": (True, X.STOPWORDS), "english": (False, X.ENGLISH_STOPWORDS), "porter_english": (True, X.ENGLISH_STOPWORDS)}


def _profile(name: str) -> tuple[bool, tuple[str, ...]]:
    if name not in PROFILES:
        raise ValueError(f"the profile is one of {', '.join(PROFILES)}")
    return PROFILES[name]


def tokens(c: Column, profile: str = "plain") -> Column:
    stems, stopwords = _profile(profile)
    out = X.search_tokens(c, stopwords)
    return stemmed(out) if stems else out


#: Documents of a block of postings, and the ratio of lengths within one; blocks of a key that are scored first.
BLOCK, RATIO, FIRST = 256, 1.5, 2
#: Keys that one product of matrices scores, and that one group takes.
KERNEL, KEYS = 256, 20_000
#: Postings of the asked terms, all keys together, up to which they are joined as they are, and those of one sample up to which this
#: sample's are: bounds would cost more than they save.
DIRECT, DIRECT_SAMPLE = 1_000_000, 100_000
#: Tokens with their stems that are broadcast at most; more are joined by a shuffle.
SENT = 400_000
#: What scores that tie after rounding may differ by.
SLACK = 1e-8


class Index:
    """Postings (sample_id, doc, term, tf, dl), term statistics, keys (sample_id, doc, norm_key) and documents by length
    (sample_id, dl, docs) of a corpus in each sample."""

    def __init__(self, postings: DataFrame, terms: DataFrame, keys: DataFrame, lengths: DataFrame):
        self.postings, self.terms, self.keys, self.lengths = postings, terms, keys, lengths


def _stems(words: DataFrame) -> DataFrame:
    """(term, stem, alone) of different tokens, each stemmed once; ``alone``: no other token has that stem."""
    stem = F.when(F.col("term") == "_empty", F.col("term")).otherwise(F.get(stemmed(F.array("term")), 0))
    each = settle(words.select("term", stem.alias("stem")))
    # settled, so its size is known: small tables are broadcast, others shuffled
    return settle(each.join(each.groupBy("stem").agg((F.count("*") == 1).alias("alone")), "stem").select("term", "stem", "alone"))


def _sent(words: DataFrame) -> DataFrame:
    """A table of tokens, sent to all tasks if it has few rows, so that the rows it is joined with stay where they are."""
    words = settle(words)
    return F.broadcast(words) if words.count() <= SENT else words


def _stem_counts(split: DataFrame, counted: DataFrame, stems: DataFrame) -> DataFrame:
    """(sample_id, term, df) of stems. The documents of a stem that one token alone has are that token's; only those of the
    others' tokens are told apart, by number. ``counted``: the df of tokens."""
    alone = counted.join(stems.where("alone"), "term").select("sample_id", F.col("stem").alias("term"), "df")
    words = split.select("sample_id", "number", F.explode(F.array_distinct("t")).alias("term"))
    several = words.join(_sent(stems.where("not alone").select("term", "stem")), "term").select("sample_id", "number", F.col("stem").alias("term")).distinct()
    return alone.unionByName(several.groupBy("sample_id", "term").agg(F.count("*").alias("df")))


def index(docs: DataFrame, profile: str = "plain", asked: DataFrame | None = None) -> Index:
    """From (sample_id, doc, text, key). A document without tokens counts as one unaskable token. With ``asked``, a table
    with qkey, the postings hold the terms of those keys only; the statistics are those of the whole corpus all the same."""
    stems, stopwords = _profile(profile)
    split = spread(docs).select("sample_id", "doc", X.search_tokens("text", stopwords).alias("t")).withColumn("t", F.when(F.size("t") > 0, F.col("t")).otherwise(F.array(F.lit("_empty"))))
    if asked is not None or stems:
        split = settle(split.withColumn("number", F.monotonically_increasing_id()))  # read several times
    known = None if asked is None else settle(asked.select(F.explode(tokens(F.col("qkey"), profile)).alias("term")).distinct())
    rows = split.select("sample_id", "doc", F.size("t").alias("dl"), F.explode("t").alias("term"))
    df = split.select("sample_id", F.explode(F.array_distinct("t")).alias("term")).groupBy("sample_id", "term").agg(F.count("*").alias("df"))
    if stems:
        df = settle(df)
        stem = _stems(df.select("term").distinct())
        df = _stem_counts(split, df, stem)
        # with ``asked``, of the tokens only those with an asked stem
        wanted = stem if known is None else stem.join(known.withColumnRenamed("term", "stem"), "stem", "left_semi")
        rows = rows.join(_sent(wanted.select("term", "stem")), "term").drop("term").withColumnRenamed("stem", "term")
    elif known is not None:
        rows = rows.join(known, "term")
    each = settle(rows.groupBy("sample_id", "doc", "term", "dl").agg(F.count("*").alias("tf")))
    if known is None and not stems:
        df = each.groupBy("sample_id", "term").agg(F.count("*").alias("df"))
    lengths = split.groupBy("sample_id", F.size("t").alias("dl")).agg(F.count("*").alias("docs"))
    sizes = lengths.groupBy("sample_id").agg(F.sum("docs").alias("n"), (F.sum(F.col("docs") * F.col("dl")) / F.sum("docs")).alias("avgdl"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = settle(df.join(sizes, "sample_id").withColumn("raw", raw))
    # the mean is over all distinct terms, negative values among them
    mean = idf.groupBy("sample_id").agg(F.avg("raw").alias("mean_idf"))
    terms = idf.join(mean, "sample_id").select("sample_id", "term", "df", "n", "avgdl", F.when(F.col("raw") < 0, BM25_EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    keys = docs.select("sample_id", "doc", X.entity_key("key").alias("norm_key"))
    return Index(each, terms, keys, lengths)


def entity_index(entity: DataFrame, profile: str = "plain") -> Index:
    key = F.when(X.blank("key"), F.lower("value")).otherwise(X.trimmed("key"))
    return index(entity.select("sample_id", F.col("entity_id").alias("doc"), X.entity_document("key", "value").alias("text"), key.alias("key")), profile)


def _impact(postings: DataFrame) -> DataFrame:
    """Postings with their sample's avgdl -> with ``imp``, what one adds to a score for each unit of its term's weight."""
    norm = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl"))
    return postings.withColumn("imp", F.col("tf") * (BM25_K1 + 1) / norm)


def blocked(found: Index) -> DataFrame:
    """(sample_id, block, doc, term, imp): postings in blocks of about BLOCK documents of like length."""
    level = F.floor(F.log(F.col("dl").cast("double")) / F.log(F.lit(RATIO))).cast("int")
    size = W.partitionBy("sample_id")
    counted = found.lengths.withColumn("avgdl", F.sum(F.col("docs") * F.col("dl")).over(size) / F.sum("docs").over(size)).withColumn("c", level)
    # where there are more documents of a length there are more blocks
    sized = counted.withColumn("parts", F.ceil(F.sum("docs").over(W.partitionBy("sample_id", "c")) / BLOCK)).select("sample_id", "dl", "c", "parts", "avgdl")
    # settled, so its size is known and the postings need not move to meet it; it is read several times
    placed = _impact(found.postings.join(settle(sized), ["sample_id", "dl"]))
    return placed.select("sample_id", (F.col("c") * F.lit(1 << 32) + F.pmod(F.xxhash64("doc"), F.col("parts"))).alias("block"), "doc", "term", "imp")


def bound_pieces(held: DataFrame, weighed: DataFrame) -> DataFrame:
    """(sample_id, kid, block, term, w, whole, place) for each term of a key and each block that has it: ``whole``, the most that
    the block's documents can score, summed from the bounds of its terms, and the block's place by that, the best first."""
    bounds = held.groupBy("sample_id", "block", "term").agg(F.max("imp").alias("bound"))
    most = F.greatest(F.col("w") * F.col("bound"), F.lit(0.0))
    pieces = bounds.join(weighed, ["sample_id", "term"]).withColumn("whole", F.sum(most).over(W.partitionBy("sample_id", "kid", "block"))).where("whole > 0")
    place = F.dense_rank().over(W.partitionBy("sample_id", "kid").orderBy(F.desc("whole"), "block"))
    return pieces.select("sample_id", "kid", "block", "term", "w", "whole", place.alias("place"))


def _scored(min_rel: float, k: int | None):
    """Scores of a block's documents for the keys that ask it, KERNEL keys at a time by a product of matrices; of each key those
    that may be within ``min_rel`` of the best and among the k best, as far as the block tells."""
    names = ["sample_id", "kid", "doc", "score"]

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = pa.schema([(names[0], pa.string()), (names[1], pa.int64()), (names[2], pa.string()), (names[3], pa.float64())])
        if not held.num_rows or not asked.num_rows:
            return kinds.empty_table()
        docs, terms = (held.column(c).combine_chunks().dictionary_encode() for c in ("doc", "term"))
        impact = np.zeros((len(terms.dictionary), len(docs.dictionary)))
        impact[terms.indices.to_numpy(), docs.indices.to_numpy()] = held.column("imp").to_numpy()
        kids, row = np.unique(asked.column("kid").to_numpy(), return_inverse=True)
        term = pc.index_in(asked.column("term"), value_set=terms.dictionary).to_numpy()
        weight = asked.column("w").to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(kids), KERNEL):
            mine = (row >= a) & (row < a + KERNEL)
            w = np.zeros((min(KERNEL, len(kids) - a), len(impact)))
            w[row[mine] - a, term[mine]] = weight[mine]
            score = w @ impact
            least = score.max(1) * min_rel
            if k is not None and k <= score.shape[1]:
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
            # scores of 0 belong to documents without the key's terms; where the best is negative nothing is found
            i, j = np.nonzero((score >= (least * (1 - SLACK))[:, None]) & (score > 0))
            out.append((kids[a + i], j, score[i, j]))
        kid, doc, score = (np.concatenate(x) for x in zip(*out, strict=True))
        sample = pa.array([held.column("sample_id")[0].as_py()] * len(kid), pa.string())
        return pa.Table.from_arrays([sample, pa.array(kid), docs.dictionary.take(pa.array(doc)), pa.array(score)], schema=kinds)

    return run


def block_scores(held: DataFrame, pieces: DataFrame, min_rel: float, k: int | None) -> DataFrame:
    """(sample_id, kid, doc, score) of the blocks that pieces (sample_id, kid, block, term, w) ask. Postings move once for all keys, not once for each; the keys
    of a block meet it in parts of about KEYS, so no group grows with their number."""
    ship(held.sparkSession)
    count = pieces.groupBy("sample_id", "block").agg(F.ceil(F.approx_count_distinct("kid") / KEYS).cast("int").alias("slices"))
    count = settle(count)
    asked = pieces.join(count, ["sample_id", "block"]).withColumn("slice", F.pmod(F.xxhash64("kid"), F.col("slices")).cast("int")).select("sample_id", "block", "slice", "kid", "term", "w")
    sent = held.join(count, ["sample_id", "block"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("sample_id", "block", "slice", "doc", "term", "imp")
    by = ["sample_id", "block", "slice"]
    return sent.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_scored(min_rel, k), "sample_id string, kid long, doc string, score double")


def needed(scored: DataFrame, min_rel: float, k: int | None) -> DataFrame:
    """(sample_id, kid, need): what a document must score, at least, to be within ``min_rel`` of the best and among the k best, as
    far as the documents scored so far tell."""
    ranked = scored.withColumn("_k", F.row_number().over(W.partitionBy("sample_id", "kid").orderBy(F.desc("score"))))
    kth = F.max(F.when(F.col("_k") == F.lit(k), F.col("score")))  # null without k, or with fewer documents
    return ranked.groupBy("sample_id", "kid").agg((F.greatest(F.max("score") * min_rel, kth) * (1 - SLACK)).alias("need"))


def alive(pieces: DataFrame, need: DataFrame) -> DataFrame:
    """The pieces of the blocks behind a key's FIRST best ones whose bounds together reach what the key needs."""
    return pieces.where(F.col("place") > FIRST).join(need, ["sample_id", "kid"], "left").where(F.col("whole") >= F.coalesce("need", F.lit(0.0)))


def bounded_scores(found: Index, weighed: DataFrame, min_rel: float, k: int | None) -> DataFrame:
    """(sample_id, kid, doc, score) of at least all documents within ``min_rel`` of the best and among the k best of a key. The FIRST
    blocks of a key by the sum of its terms' bounds are scored, which gives a threshold; blocks whose sum is below it are never joined."""
    held = blocked(found)
    pieces = settle(bound_pieces(held, weighed))
    first = settle(block_scores(held, pieces.where(F.col("place") <= FIRST), min_rel, k))
    rest = block_scores(held, alive(pieces, needed(first, min_rel, k)), min_rel, k)
    return settle(first.unionByName(rest))


def _relative(found: Index, numbered: DataFrame, profile: str, min_rel: float | None, top_k: int | None) -> DataFrame:
    """(sample_id, kid, doc, rel) of keys (qkey, kid and maybe sample_id)."""
    where = [c for c in ("sample_id",) if c in numbered.columns]
    terms = numbered.select(*where, "kid", F.explode(tokens(F.col("qkey"), profile)).alias("term")).groupBy(*where, "kid", "term").agg(F.count("*").alias("times"))
    weighed = settle(terms.join(found.terms, [*where, "term"]).select("sample_id", "kid", "term", (F.col("times") * F.col("idf")).alias("w"), "avgdl", "df"))
    small, scored = weighed, None
    if min_rel is not None and min_rel > 0:
        asks = settle(weighed.groupBy("sample_id").agg(F.sum("df").alias("hits")))
        large = asks.where(F.col("hits") > min(DIRECT, DIRECT_SAMPLE)).select("sample_id")
        if (asks.agg(F.sum("hits")).first()[0] or 0) > DIRECT and not large.isEmpty():
            small = weighed.join(large, "sample_id", "left_anti")
            held = Index(found.postings.join(large, "sample_id", "left_semi"), found.terms, found.keys, found.lengths)
            scored = bounded_scores(held, weighed.join(large, "sample_id", "left_semi").select("sample_id", "kid", "term", "w"), min_rel, max(top_k, 1) if top_k is not None else None)
    hits = _impact(found.postings.join(small, ["sample_id", "term"]))
    direct = hits.groupBy("sample_id", "kid", "doc").agg(F.sum(F.col("w") * F.col("imp")).alias("score"))
    scored = settle(direct if scored is None else direct.unionByName(scored))
    best = scored.groupBy("sample_id", "kid").agg(F.max("score").alias("best")).where("best > 0")
    scored = scored.join(best, ["sample_id", "kid"]).select("sample_id", "kid", "doc", F.round(F.col("score") / F.col("best"), 9).alias("rel"))
    return scored if min_rel is None else scored.where(F.col("rel") >= min_rel)


def _numbered(asked: DataFrame) -> DataFrame:
    """Keys with numbers (kid), which stand for them where there are many rows: keys may be long."""
    return settle(asked.withColumn("kid", F.monotonically_increasing_id()))


def relative_scores(found: Index, asked: DataFrame, profile: str = "plain", min_rel: float | None = None) -> DataFrame:
    """(sample_id, qkey, doc, rel): scores of each question key over the best one, from ``min_rel`` on; keys without a
    positive best give none. ``asked``: distinct (sample_id, qkey), or (qkey), which asks every sample."""
    numbered = _numbered(asked)
    return _relative(found, numbered, profile, min_rel, None).join(numbered.select("kid", "qkey"), "kid").select("sample_id", "qkey", "doc", "rel")


def match_keys(found: Index, asked: DataFrame, min_rel: float = MIN_REL_SCORE, top_k: int | None = TOP_K_PER_KEY, profile: str = "plain") -> DataFrame:
    """(sample_id, qkey, doc, score): for each question key the documents at or above ``min_rel`` of the
    best, equal keys lifted to 1 at least, the ``top_k`` best (null: all, negative: none).
    ``asked``: distinct (sample_id, qkey), or (qkey), normalised and not blank."""
    numbered = _numbered(asked)
    soft = _relative(found, numbered, profile, min_rel, top_k)
    where = ["sample_id"] if "sample_id" in asked.columns else []
    exact = found.keys.withColumnRenamed("norm_key", "qkey").join(numbered, [*where, "qkey"]).select("sample_id", "kid", "doc", F.lit(1.0).alias("rel"))
    both = soft.unionByName(exact).groupBy("sample_id", "kid", "doc").agg(F.max("rel").alias("score")).where(F.col("score") >= min_rel)
    if top_k is not None:
        rank = F.row_number().over(W.partitionBy("sample_id", "kid").orderBy(F.desc("score"), "doc"))
        both = both.withColumn("_k", rank).where(F.col("_k") <= max(top_k, 0))
    return both.join(numbered.select("kid", "qkey"), "kid").select("sample_id", "qkey", "doc", "score")
