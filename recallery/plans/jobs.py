"""Composite jobs: from conversation files to graphs, rankings, answers and result tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.functions import metrics as M
from recallery.operators import dense, units
from recallery.operators import graph as G
from recallery.operators import retrieve as R
from recallery.operators.extract import rule_extractor
from recallery.plans import evaluate as E
from recallery.sources import store
from recallery.sources.scratch import settle

Q = ["sample_id", "qa"]


_FOUND = "sample_id string, memory_id string, dia_id string, ord struct<_s:bigint,_t:bigint,dia_id:string,pos:int,_i:int>, key string, value string, type string"


def extend_found(spark: SparkSession, spoken: DataFrame, path: str, extractor: Callable, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All that is extracted so far, and the memories still without anything. Only those are read, at most ``most`` of them,
    and what they give is added to the table at ``path``; so an interrupted build goes on where it stopped."""
    stored = lambda: spark.read.schema(_FOUND).parquet(path) if store.exists(spark, path) else spark.createDataFrame([], _FOUND)
    named = spoken.withColumn("memory_id", E.X.memory_id("dia_id"))
    todo = G.pending(named, stored())
    if most is not None:
        todo = todo.orderBy("sample_id", "session_num", "pos").limit(most)
    settle(G.extracted(todo.drop("memory_id"), extractor)).write.mode("append").parquet(path)
    read = E.X.extraction_text("text_normalized", "query", "blip_caption") != ""
    return stored(), G.pending(named.where(read & ~E.X.blank("speaker")), stored())


def build_graphs(spark: SparkSession, path: str, out: str, extractor: Callable = rule_extractor, memories_only: bool = False, resume: bool = False, most: int | None = None) -> G.Graph:
    """Graphs of all samples of a file, checked and stored; ValueError if an edge is broken. With ``resume`` what an earlier
    run extracted into ``out`` is kept; ``most`` ends a run after so many memories, whose graph is then marked partial in the stored stats."""
    spoken = settle(G.turns(store.dialogs(store.samples(spark, path))))
    left = None
    if memories_only:
        memory = G.memories(spoken, "last")
        none = G.extracted(spoken.limit(0))
        made = G.Graph(memory, G.entities(none), G.mentions(none), G.sequence_edges(memory))
    else:
        found = f"{out}/found"
        if not resume:
            spark.createDataFrame([], _FOUND).write.mode("overwrite").parquet(found)
        rows, left = extend_found(spark, spoken, found, extractor, most)
        memory = G.memories(spoken)
        made = G.Graph(memory, G.entities(rows), G.mentions(rows), G.sequence_edges(memory))
    store.save_graph(made, out)
    stored = store.load_graph(spark, out)
    G.stats(stored, left).write.mode("overwrite").parquet(f"{out}/stats")
    return stored


def build_index(memory: DataFrame, path: str, cache: store.Cache, encoder: dense.Encoder = dense.Encoder()) -> tuple[DataFrame, int]:
    """The stored index of embeddings of all memories, and how many texts had to be embedded for it. An index that fits
    the memories and the model is used as it is, and gives its vectors to the cache; else it is made anew,
    from the cache as far as that goes."""
    spark = memory.sparkSession
    texts = settle(dense.memory_texts(memory).withColumn("text_digest", E.X.digest("text")))
    found = store.load_index(spark, path)
    if found is not None and dense.index_matches(found, memory, encoder.model).where("not matches").isEmpty():
        one = found.select("text_digest", "model", F.lit("context").alias("role"), F.size("vec").alias("dim"), "vec")
        cache.add(one)
        return found, 0
    vec, n = dense.embed_cached(texts, "text", cache, encoder)
    index = settle(texts.join(vec, "text_digest").select("sample_id", "memory_id", F.lit(encoder.model).alias("model"), "text_digest", "vec"))
    if index.count() != texts.count():
        raise ValueError("not every memory has a vector")
    store.save_index(index, path)
    return store.load_index(spark, path), n


def embed_memories(graph: G.Graph, **how) -> DataFrame:
    """(sample_id, memory_id, model, text_digest, vec) of all memories, equal texts embedded once."""
    texts = dense.memory_texts(graph.memory).withColumn("text_digest", E.X.digest("text"))
    return texts.join(dense.embed(texts, "text", **how), "text_digest").select("sample_id", "memory_id", "model", "text_digest", "vec")


def embed_questions(questions: DataFrame, cache: store.Cache | None = None, encoder: dense.Encoder = dense.Encoder(), **how) -> DataFrame:
    """Questions with ``qvec``, equal ones embedded once, in the encoder's role for queries; with a cache only new ones."""
    keyed = questions.drop("qvec").withColumn("text_digest", E.X.digest("question"))
    if cache is not None:
        done = dense.embed_cached(questions, "question", cache, encoder, encoder.query_role)[0]
    else:
        done = dense.embed(questions, "question", role=encoder.query_role, **how)
    return keyed.join(done.select("text_digest", F.col("vec").alias("qvec")), "text_digest").drop("text_digest")


def question_keys(questions: DataFrame, path: str, extractor: Callable = rule_extractor) -> tuple[DataFrame, int, int]:
    """(sample_id, qa, qkey) of all questions, how many were extracted now, and how many failed: those with stored keys, an empty
    list too, are not read again, failed ones are by the next run."""
    cache = store.Cache(questions.sparkSession, path, "sample_id string, qa int, keys array<string>", Q)
    asked = settle(cache.misses(questions.where(~E.X.blank("question")).select(*Q, "question")))
    made = settle(R.extract_keys(asked, extractor))
    n = cache.add(made.where("keys is not null"))
    return cache.read().select(*Q, F.explode("keys").alias("qkey")), n, made.where("keys is null").count()


def run_variant(graph: G.Graph, questions: DataFrame, keys: DataFrame, vectors: DataFrame, variant: R.Variant, make_reader: Callable = lambda: E.first_line_reader, checkpoint: DataFrame | None = None, seed: DataFrame | None = None) -> DataFrame:
    """(sample_id, qa, category, k, recall_acc, hit, token_f1, prediction, context_ids) of one variant: retrieve 50, answer from
    25, score. Answers of ``checkpoint`` (sample_id, qa, context_ids, prediction, token_f1) that still hold are kept."""
    ranked = settle(R.retrieve(graph, questions, keys, vectors, 50, variant, seed=seed))
    ids = E.retrieved(ranked, 25).withColumnRenamed("ids", "context_ids")
    asked = questions.join(ids, Q, "left").withColumn("context_ids", F.coalesce("context_ids", F.array().cast("array<string>")))
    todo = asked if checkpoint is None else E.pending(asked, checkpoint)
    said = E.answer(E.prompts(todo, E.contexts(ranked, graph.memory)), make_reader).select(*Q, "prediction")
    if checkpoint is not None:
        said = said.unionByName(checkpoint.join(todo.select(*Q), Q, "left_anti").select(*Q, "prediction"))
    scored = asked.join(said, Q, "left").select(*Q, "context_ids", "prediction", F.round(M.token_f1("answer", "prediction"), 4).alias("token_f1"))
    return E.at_cutoffs(questions, E.retrieved(ranked)).join(scored, Q)


def ablation(graph: G.Graph, questions: DataFrame, keys: DataFrame, vectors: DataFrame, variants: Iterable[R.Variant] = R.VARIANTS, make_reader: Callable = lambda: E.first_line_reader) -> DataFrame:
    """(variant, k, category, ...): the rollups of several variants; entities are matched once for all."""
    seed, out = R.seeded(graph, keys), None
    for v in variants:
        one = E.rollup(settle(run_variant(graph, questions, keys, vectors, v, make_reader, seed=seed))).select(F.lit(v.name).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return settle(out)


def summarize(rolled: DataFrame) -> tuple[str, str]:
    """The comparison of variants A and B as JSON, and the table of all variants as Markdown."""
    overall = rolled.where("category is null").orderBy("variant", "k")
    return store.report_json(E.compare(rolled)), store.report_markdown(overall)


def score_frozen(predictions: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (5, 10, 25)) -> tuple[DataFrame, DataFrame]:
    """Frozen predictions with their rankings: the F1 rollup, and recall and hit by cut-off with F1 at 25. Rows without
    contexts are passed over, as are, by cut-off, those without gold; each prediction counts once, however often its question stands."""
    held = E.frozen(predictions, questions).where(F.size("ids") > 0)
    rows = settle(held.withColumn("qa", F.monotonically_increasing_id()))
    cut = E.at_cutoffs(rows.drop("ids"), rows.select(*Q, "ids"), ks, "skip").join(rows.select(*Q, "token_f1"), Q)
    return E.f1_rollup(rows), E.rollup(cut)


def retrieve_all(graph: G.Graph, questions: DataFrame, keys: DataFrame, vectors: DataFrame, k: int = 50) -> DataFrame:
    """(sample_id, qa, category, n_evidence, ids): the ranking of each question as a list."""
    found = E.retrieved(R.retrieve(graph, questions, keys, vectors, k), k)
    return questions.select(*Q, "category", F.size("evidence").alias("n_evidence")).join(found, Q, "left")


def answer_again(frozen: DataFrame, make_reader: Callable, checkpoint: DataFrame | None = None) -> DataFrame:
    """Answers anew from frozen contexts: rows with sample_id, qa, question, category, answer, context -> the same with prediction, token_f1 and,
    for all rows together, the write-up gate. Rows without a context are left out. Questions that agree in sample and
    their first 120 characters get one answer, that of the last; answers of ``checkpoint`` (sample_id, question, prediction, token_f1) that are not blank are kept."""
    rows = settle(frozen.where(~E.X.blank("context")))
    key = E.answer_key(F.col("sample_id"), F.col("question"))
    one = rows.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*[c for c in rows.columns]), "qa").alias("r")).select("_key", "r.*")
    kept = None
    if checkpoint is not None:
        kept = checkpoint.where(~E.X.blank("prediction")).select("sample_id", "question", "prediction", "token_f1")
        one = one.join(kept.select(key.alias("_key")), "_key", "left_anti")
    said = E.answer(one.withColumn("prompt", E.X.answer_prompt("question", "category", "context")), make_reader)
    answers = said.select("sample_id", "question", "prediction", F.round(M.token_f1("answer", "prediction"), 4).alias("token_f1"))
    scored = settle(E.with_answers(rows, answers if kept is None else answers.unionByName(kept)))
    overall = scored.agg(M.percent(F.avg("token_f1")).alias("f1"))
    return scored.crossJoin(F.broadcast(overall.select(E.write_up_gate(F.col("f1")).alias("gate"))))  # one row


def run_units(questions: DataFrame, rows: DataFrame, kind: str, k: int, make_reader: Callable = lambda: E.first_line_reader, **how) -> tuple[DataFrame, DataFrame]:
    """Dense retrieval over observations or summaries: (per question: ranking, prediction, token_f1, hit), and its F1 rollup."""
    made = settle(units.observations(rows) if kind == "observation" else units.summaries(rows))
    digests = made.withColumn("text_digest", E.X.digest("text"))
    vec = digests.join(dense.embed(made, "text", **how), "text_digest").select("sample_id", "unit_id", "vec")
    top = settle(units.top_units(embed_questions(questions, **how), vec, k))
    lines = top.join(made.select("sample_id", "unit_id", "text"), ["sample_id", "unit_id"])
    listed = lines.groupBy(*Q).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("l"))
    context = listed.select(*Q, F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("context"))
    said = E.answer(E.prompts(questions, context), make_reader)
    scored = said.select(*Q, "category", "prediction", F.round(M.token_f1("answer", "prediction"), 4).alias("token_f1"))
    out = settle(scored.join(units.source_hits(top, made, questions), Q, "left"))
    return out, E.f1_rollup(out)
