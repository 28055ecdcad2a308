"""Retrieval: seeds from matched entities, neighbours, gate, fusion and ranking, for all questions at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recallery.functions import metrics as M
from recallery.functions import text as X
from recallery.operators import dense, lexical
from recallery.operators.extract import cleaned
from recallery.operators.graph import Graph, degrees
from recallery.schema import ENTITY_WEIGHT, MIN_REL_SCORE, NEIGHBOUR_SCALE, SEMANTIC_WEIGHT, TOP_K_PER_KEY, WHO_SCALE
from recallery.sources.scratch import settle

Q = ["sample_id", "qa"]
#: Memories of a block, about.
BLOCK = 64


@dataclass(frozen=True)
class Variant:
    """How one run of the ablation retrieves."""

    name: str
    we: float = ENTITY_WEIGHT
    ws: float = SEMANTIC_WEIGHT
    expand: bool = True
    gate: bool = True
    entities: bool = True


# The five variants.
VARIANTS = (
    Variant("A", 0.0, 1.0, False, False, False),
    Variant("B", 0.3, 0.7),
    Variant("B_entity", 1.0, 0.0),
    Variant("B_embed", 0.0, 1.0, gate=False),
    Variant("B_noseq", 0.3, 0.7, expand=False),
)


def question_keys(keys: DataFrame) -> DataFrame:
    """(sample_id, qa, qkey): normalised, without blanks and repeats. ``keys``: sample_id, qa, qkey."""
    return keys.select("sample_id", "qa", X.entity_key("qkey").alias("qkey")).where("qkey <> ''").distinct()


def extract_keys(questions: DataFrame, extractor: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(sample_id, qa, keys): the distinct keys of the entities an extractor finds in each question; null where it failed."""
    asked = extractor(questions.select(*Q, F.coalesce("question", F.lit("")).alias("question")), "question").withColumnRenamed("items", "found")
    keys = F.array_distinct(F.filter(F.transform("items", lambda x: X.entity_key(x["value"])), lambda k: k != ""))
    return cleaned(asked.withColumn("items", F.col("found"))).select(*Q, F.when(F.col("found").isNotNull(), keys).alias("keys"))


def matches(graph: Graph, keys: DataFrame, min_rel: float = MIN_REL_SCORE, top_k: int | None = TOP_K_PER_KEY, profile: str = "plain") -> DataFrame:
    """(sample_id, qa, qkey, entity_id, score)."""
    asked = question_keys(keys)
    found = lexical.match_keys(lexical.entity_index(graph.entity, profile), asked.select("sample_id", "qkey").distinct(), min_rel, top_k, profile)
    return asked.join(found, ["sample_id", "qkey"]).select(*Q, "qkey", F.col("doc").alias("entity_id"), "score")


def entity_strength(graph: Graph, matched: DataFrame) -> DataFrame:
    """(sample_id, qa, entity_id, is_who, who_like, degree, match, raw). A question's scores are averaged
    over the keys that matched anything. An entity is who-like if it is a Who, or if each of
    its keys also matches a Who."""
    typed = matched.join(graph.entity.select("sample_id", "entity_id", (F.col("type") == "Who").alias("is_who")), ["sample_id", "entity_id"], "left")
    typed = typed.withColumn("is_who", F.coalesce("is_who", F.lit(False)))
    by_key = W.partitionBy(*Q, "qkey")
    marked = typed.withColumn("key_is_who", F.max("is_who").over(by_key))
    count = matched.groupBy(*Q).agg(F.countDistinct("qkey").alias("n_keys"))
    each = marked.groupBy(*Q, "entity_id", "is_who").agg(F.sum("score").alias("match"), F.min("key_is_who").alias("all_who"))
    each = each.join(count, Q).join(degrees(graph.mention), ["sample_id", "entity_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(1)))
    raw = F.col("match") / F.col("n_keys") * M.degree_weight(F.col("degree"))
    return each.select(*Q, "entity_id", "is_who", (F.col("is_who") | F.col("all_who")).alias("who_like"), "degree", "match", raw.alias("raw"))


def seeds(graph: Graph, strength: DataFrame) -> DataFrame:
    """(sample_id, qa, memory_id, seed): the best content entity of a memory, or the best who-like one;
    who-like ones alone count a quarter."""
    edge = graph.mention.select("sample_id", "entity_id", "memory_id", F.when(F.coalesce(F.col("weight"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")).alias("w"))
    hits = strength.join(edge, ["sample_id", "entity_id"]).where("raw <> 0").withColumn("v", F.col("raw") * F.col("w"))
    both = hits.groupBy(*Q, "memory_id").agg(F.coalesce(F.max(F.when(~F.col("who_like"), F.col("v"))), F.lit(0.0)).alias("content"), F.coalesce(F.max(F.when(F.col("who_like"), F.col("v"))), F.lit(0.0)).alias("who"))
    return both.select(*Q, "memory_id", F.round(F.when(F.col("content") > 0, F.greatest("content", "who")).otherwise(F.col("who") * WHO_SCALE), 9).alias("seed"))


def expand(graph: Graph, seed: DataFrame, scale: float = NEIGHBOUR_SCALE) -> DataFrame:
    """(sample_id, qa, memory_id, seed, e): a memory next to a seed gets a share of it if that is more than its own. One step, from seeds only."""
    own = seed.withColumn("e", F.col("seed"))
    if scale <= 0:
        return own
    known = graph.memory.select("sample_id", "memory_id")
    edge = graph.memory_edge.select("sample_id", F.col("src_memory_id").alias("memory_id"), F.col("dst_memory_id").alias("dst"))
    edge = edge.join(known, ["sample_id", "memory_id"], "left_semi").join(known.withColumnRenamed("memory_id", "dst"), ["sample_id", "dst"], "left_semi")
    near = edge.groupBy("sample_id", "memory_id").agg(F.collect_list("dst").alias("near"))
    # a seed moves to its question with the memories beside it in one row; they are taken apart there
    sent = seed.join(near, ["sample_id", "memory_id"], "left").repartition(*Q)
    given = F.transform(F.when(F.col("seed") > 0, F.col("near")), lambda d: F.struct(d.alias("memory_id"), F.lit(None).cast("double").alias("seed"), (F.col("seed") * scale).alias("e")))
    both = F.concat(F.array(F.struct("memory_id", "seed", F.col("seed").alias("e"))), F.coalesce(given, F.array()))
    return sent.select(*Q, F.explode_outer(both).alias("_x")).select(*Q, "_x.*").groupBy(*Q, "memory_id").agg(F.max("seed").alias("seed"), F.round(F.max("e"), 9).alias("e"))


def fused(graph: Graph, questions: DataFrame, scores: DataFrame, vectors: DataFrame, we: float, ws: float, gate: bool = True) -> DataFrame:
    """(sample_id, qa, gated, rows): the pool of each question, scored, in as many rows as its sample has blocks. ``rows`` are structs of
    memory_id, dia_id, seed, e, s, score. A vector moves once for each block, not once for each pair of a question and a memory."""
    count = graph.memory.groupBy("sample_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    # settled, so its size is known: it has few rows, and where those are many they are shuffled
    large = settle(count.where("parts > 1"))
    parted = lambda df: df.join(large, "sample_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("memory_id"), F.col("parts")).cast("int").alias("part")
    member = F.struct("memory_id", "dia_id", "vec")
    held = graph.memory.select("sample_id", "memory_id", "dia_id").join(vectors.select("sample_id", "memory_id", "vec"), ["sample_id", "memory_id"], "left")
    held = parted(held).select("sample_id", part, member.alias("m")).groupBy("sample_id", "part").agg(F.collect_list("m").alias("m"))
    held = held.select("sample_id", "part", F.transform("m", lambda m: F.struct(m["memory_id"].alias("memory_id"), m["dia_id"].alias("dia_id"), M.unit(m["vec"]).alias("v"))).alias("m"))
    candidate = F.struct("memory_id", F.struct("seed", "e"))
    given = parted(scores).select(*Q, part, candidate.alias("c")).repartition(*Q).groupBy(*Q, "part").agg(F.map_from_entries(F.collect_list("c")).alias("given"))
    ids = questions.select(*Q)
    full = ids.join(scores.select(*Q).distinct(), Q, "left_anti") if gate else ids
    full = parted(full).select(*Q, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    if gate:
        full = full.withColumn("given", F.lit(None).cast(given.schema["given"].dataType))
        asked = given.withColumn("gated", F.lit(True)).unionByName(full.withColumn("gated", F.lit(False)))
    else:
        asked = full.join(given, [*Q, "part"], "left").withColumn("gated", F.lit(False))
    asked = asked.join(questions.select(*Q, "qvec"), Q, "left")

    def scored(q: Column) -> Column:
        zero = F.lit(0.0)
        found = F.filter(F.transform("m", lambda m: F.struct(m.alias("m"), F.col("given")[m["memory_id"]].alias("g"))), lambda x: ~F.col("gated") | x["g"].isNotNull())
        s = lambda x: F.round(M.clipped(M.dot(q, x["m"]["v"])), 9)
        each = F.transform(found, lambda x: F.struct(x["m"]["memory_id"].alias("memory_id"), x["m"]["dia_id"].alias("dia_id"), F.coalesce(x["g"]["seed"], zero).alias("seed"), F.coalesce(x["g"]["e"], zero).alias("e"), F.coalesce(s(x), zero).alias("s")))
        kept = F.filter(each, lambda x: ~((x["e"] <= 0) & (x["s"] <= 0)))
        return F.transform(kept, lambda x: F.struct(*(x[c].alias(c) for c in ("memory_id", "dia_id", "seed", "e", "s")), F.round(M.fused(x["e"], x["s"], we, ws), 9).alias("score")))

    # an array of one, so that the question's vector is scaled once and not for each memory
    rows = F.get(F.transform(F.array(M.unit(F.col("qvec"))), scored), F.lit(0))
    return asked.join(held, ["sample_id", "part"]).select(*Q, "gated", rows.alias("rows"))


def fuse(graph: Graph, questions: DataFrame, scores: DataFrame, vectors: DataFrame, we: float, ws: float, gate: bool = True) -> DataFrame:
    """(sample_id, qa, memory_id, dia_id, seed, e, s, score, gated): the pool of each question, scored. The pool
    is the candidates of a question that has any (unless ``gate`` is off), else all memories of its sample."""
    each = fused(graph, questions, scores, vectors, we, ws, gate)
    return each.select(*Q, "gated", F.explode_outer("rows").alias("_r")).where("_r is not null").select(*Q, "_r.*", "gated")


def rank(pool: DataFrame, k: int) -> DataFrame:
    """Best first, ties by dia_id as text, from rank 1."""
    return dense.top(pool, k, "score", "dia_id")


def seeded(graph: Graph, keys: DataFrame, profile: str = "plain") -> DataFrame:
    """The seeds of all questions, kept for the steps and variants that read them again."""
    return settle(seeds(graph, entity_strength(graph, settle(matches(graph, keys, profile=profile)))))


def retrieve(graph: Graph, questions: DataFrame, keys: DataFrame, vectors: DataFrame, k: int = 8, variant: Variant = VARIANTS[1], profile: str = "plain", seed: DataFrame | None = None) -> DataFrame:
    """The ranked memories of every question. ``questions``: sample_id, qa, qvec; ``keys``: sample_id, qa, qkey
    (a question without keys has the full pool). ``seed``: from ``seeded``, where several variants run."""
    return rank(pool(graph, questions, keys, vectors, variant, profile, seed), k)


def pool(graph: Graph, questions: DataFrame, keys: DataFrame, vectors: DataFrame, variant: Variant, profile: str = "plain", seed: DataFrame | None = None) -> DataFrame:
    if not variant.entities:
        # no keys, no seeds: the whole pool by dense scores
        seed = questions.sparkSession.createDataFrame([], "sample_id string, qa int, memory_id string, seed double")
    elif seed is None:
        seed = seeded(graph, keys, profile)
    scores = settle(expand(graph, seed) if variant.expand else seed.withColumn("e", F.col("seed")))
    return fuse(graph, questions, scores, vectors, variant.we, variant.ws, variant.gate)


def retrieve_variants(graph: Graph, questions: DataFrame, keys: DataFrame, vectors: DataFrame, k: int = 50, variants: Iterable[Variant] = VARIANTS, profile: str = "plain") -> DataFrame:
    """(variant, sample_id, qa, memory_id, dia_id, score, rank): what ``retrieve`` gives for each variant, from one pass: each pair of a
    question and a memory of its sample is scored once, and the variants differ by what they make of it."""
    variants = list(variants)
    seed = seeded(graph, keys, profile).withColumnRenamed("seed", "plain")
    grown = expand(graph, seed.withColumnRenamed("plain", "seed")).select(*Q, "memory_id", F.col("e").alias("grown")).join(seed, [*Q, "memory_id"], "left")
    gated = seed.select(*Q).distinct().withColumn("any", F.lit(True))
    pairs = questions.select(*Q).join(graph.memory.select("sample_id", "memory_id", "dia_id"), "sample_id")
    whole = pairs.join(dense.cosine(questions.select(*Q, "qvec"), vectors), [*Q, "memory_id"], "left").join(grown, [*Q, "memory_id"], "left").join(gated, Q, "left")
    rows = []
    for v in variants:
        e = F.coalesce((F.col("grown") if v.expand else F.col("plain")) if v.entities else F.lit(None).cast("double"), F.lit(0.0))
        inside = (F.col("grown").isNotNull() if v.expand else F.col("plain").isNotNull()) if v.entities else F.lit(False)
        open_ = ~F.coalesce(F.col("any"), F.lit(False)) if v.gate and v.entities else F.lit(True)
        rows.append(F.struct(F.lit(v.name).alias("variant"), e.alias("e"), (inside | open_).alias("kept"), F.lit(v.we).alias("we"), F.lit(v.ws).alias("ws")))
    each = whole.select(*Q, "memory_id", "dia_id", F.coalesce("s", F.lit(0.0)).alias("s"), F.explode(F.array(*rows)).alias("v")).select(*Q, "memory_id", "dia_id", "s", "v.*")
    pool = each.where(F.col("kept") & ~((F.col("e") <= 0) & (F.col("s") <= 0))).withColumn("score", F.round(F.col("we") * F.col("e") + F.col("ws") * F.col("s"), 9))
    ranked = pool.withColumn("rank", F.row_number().over(W.partitionBy("variant", *Q).orderBy(F.desc("score"), "dia_id")))
    return ranked.where(F.col("rank") <= max(k, 0)).select("variant", *Q, "memory_id", "dia_id", "score", "rank")


def audit(graph: Graph, questions: DataFrame, keys: DataFrame, vectors: DataFrame, k: int = 8, variant: Variant = VARIANTS[1]) -> DataFrame:
    """One row for each question: keys, matched entities with their weights, gate, pool size and the ranked rows."""
    asked = question_keys(keys).groupBy(*Q).agg(F.array_sort(F.collect_list("qkey")).alias("keys"))
    strength = settle(entity_strength(graph, settle(matches(graph, keys))))
    listed = strength.groupBy(*Q).agg(F.array_sort(F.collect_list(F.struct((-F.round("match", 6)).alias("order"), "entity_id", "degree", F.round(M.degree_weight(F.col("degree")), 6).alias("weight"), "who_like"))).alias("m"))
    entities = listed.select(*Q, F.transform("m", lambda x: F.struct(x["entity_id"].alias("entity_id"), (-x["order"]).alias("match"), x["degree"].alias("degree"), x["weight"].alias("weight"), x["who_like"].alias("who_like"))).alias("entities"))
    seed = settle(seeds(graph, strength))
    scores = settle(expand(graph, seed) if variant.expand else seed.withColumn("e", F.col("seed")))
    scored = fused(graph, questions, scores, vectors, variant.we, variant.ws, variant.gate)
    # of each block the number of rows and the k best, ordered as by rank: not a number is above all others
    order = lambda r: F.struct(~F.isnan(r["score"]), -r["score"], r["dia_id"], r.alias("r"))
    best = F.slice(F.array_sort(F.transform("rows", order)), 1, max(k, 0))
    # blocks without rows go after that: a filter before would score all rows once more
    kept = settle(scored.select(*Q, "gated", F.size("rows").alias("n"), F.transform(best, lambda x: x["r"]).alias("best"))).where("n > 0")
    size = kept.groupBy(*Q).agg(F.sum("n").alias("pool"), F.max("gated").alias("gated"))
    rows = rank(kept.select(*Q, F.explode("best").alias("_r")).select(*Q, "_r.*"), k).withColumn("via_sequence_only", (F.col("seed") <= 0) & (F.col("e") > 0))
    ranked = rows.groupBy(*Q).agg(F.array_sort(F.collect_list(F.struct("rank", "dia_id", F.round("score", 6).alias("score"), F.round("seed", 6).alias("seed"), F.round("e", 6).alias("expanded"), F.round("s", 6).alias("embedding"), "via_sequence_only"))).alias("rows"))
    out = questions.select(*Q)
    for part in (asked, entities, size, ranked):
        out = out.join(part, Q, "left")
    return out.withColumns({"pool": F.coalesce("pool", F.lit(0)), "gated": F.coalesce("gated", F.lit(False))})
