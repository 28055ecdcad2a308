"""The queries over the driver's tables, each with the same in DuckDB's SQL where SQL can express it.

Conversations are the samples: a turn is a memory, its role the speaker, its long tokens the
entities. Every user turn is a question: its long tokens (and the assistant for every second one)
are its keys, the next turn its gold evidence. The ``embeddings`` table gives the vectors: turn t
of conversation c has number (8 c + t) mod n, its question the number after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recallery.functions import metrics as M
from recallery.functions import porter
from recallery.functions import text as X
from recallery.operators import dense, extract, lexical, nearest, units
from recallery.operators import graph as G
from recallery.operators import retrieve as R
from recallery.plans import evaluate as E
from recallery.plans import jobs
from recallery.schema import KS
from recallery.sources.scratch import settle, spread
from recallery.sources.ship import ship
from recallery.sources.store import exists

Q = ["sample_id", "qa"]
TIME = "1:56 pm on 8 May, 2023"
LEAST = extract.LEAST_LENGTH


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ base tables


def dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(load(spark, sf_dir, "conversations"))
    none = F.lit("")
    return t.select(F.col("conv_id").cast("string").alias("sample_id"), F.lit(1).alias("session_num"), F.lit(TIME).alias("date_time"), F.col("turn").cast("int").alias("pos"), F.concat(F.lit("D1:"), F.col("turn").cast("string")).alias("dia_id"), F.col("role").alias("speaker"), F.coalesce("text", none).alias("text"), none.alias("query"), none.alias("img_url"), none.alias("blip_caption"))


#: Tables that many queries read, kept in the shared folder: (application, folder, name) -> state of the folder's files, table.
_KEPT: dict[tuple, tuple[str, DataFrame]] = {}


def forget() -> None:
    """Let every query make its own tables again, as a bench wants them timed."""
    _KEPT.clear()


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the files that the kept tables are made from."""
    out = []
    for name in ("conversations", "embeddings"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files.listStatus(path)) if files.exists(path) else []
    return "\n".join(out)


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table that is made once for the files of a folder as they are and written to the shared one."""
    key, state = (spark.sparkContext.applicationId, sf_dir, name), _state(spark, sf_dir)
    if key not in _KEPT or _KEPT[key][0] != state or not all(exists(spark, f) for f in _KEPT[key][1].inputFiles()[:1]):
        _KEPT[key] = state, settle(make())
    return _KEPT[key][1]


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "spoken", lambda: G.turns(dialog(spark, sf_dir)))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "found", lambda: G.extracted(spoken(spark, sf_dir)))


class Kept:
    """The tables of the graph of all conversations, each made when it is first read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def memory(self) -> DataFrame:
        # not kept: most steps read its ids only, which move alone
        return G.memories(spoken(self.spark, self.sf_dir))

    @property
    def entity(self) -> DataFrame:
        return kept(self.spark, self.sf_dir, "entity", lambda: G.entities(found(self.spark, self.sf_dir)))

    @property
    def mention(self) -> DataFrame:
        return kept(self.spark, self.sf_dir, "mention", lambda: G.mentions(found(self.spark, self.sf_dir)))

    @property
    def memory_edge(self) -> DataFrame:
        return kept(self.spark, self.sf_dir, "edge", lambda: G.sequence_edges(self.memory))


def graph(spark: SparkSession, sf_dir: str) -> Kept:
    return Kept(spark, sf_dir)


def _vector(df: DataFrame, spark: SparkSession, sf_dir: str, number, name: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("_n"))  # one row
    numbered = df.crossJoin(F.broadcast(n)).withColumn("_v", F.pmod(number, F.greatest("_n", F.lit(1)))).drop("_n")
    return numbered.join(e.select(F.col("vec_id").alias("_v"), F.col("embedding").alias(name)), "_v", "left").drop("_v")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dialog(spark, sf_dir).select("sample_id", X.memory_id("dia_id").alias("memory_id"), "pos")
    return _vector(d, spark, sf_dir, F.col("sample_id").cast("long") * 8 + F.col("pos"), "vec").select("sample_id", "memory_id", "vec")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = dialog(spark, sf_dir).where("speaker = 'user'")
    qa = F.row_number().over(W.partitionBy("sample_id").orderBy("pos"))
    out = asked.select("sample_id", qa.alias("qa"), F.col("text").alias("question"), F.col("text").alias("answer"), F.array(F.concat(F.lit("D1:"), (F.col("pos") + 1).cast("string"))).alias("evidence"), (F.pmod(F.col("sample_id").cast("long"), F.lit(5)) + 1).cast("int").alias("category"), "pos")
    return _vector(out, spark, sf_dir, F.col("sample_id").cast("long") * 8 + F.col("pos") + 1, "qvec")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = kept(spark, sf_dir, "questions", lambda: questions(spark, sf_dir))
    long = F.transform(extract.rule_items(F.col("question")), lambda x: x["value"])
    every = F.when(F.col("qa") % 2 == 0, F.concat(long, F.array(F.lit(" Assistant's")))).otherwise(long)
    return q.select(*Q, F.explode(every).alias("qkey"))


def _parts(spark: SparkSession, sf_dir: str):
    q = kept(spark, sf_dir, "questions", lambda: questions(spark, sf_dir))
    return graph(spark, sf_dir), q, keys(spark, sf_dir), kept(spark, sf_dir, "vectors", lambda: vectors(spark, sf_dir))


# ---------------------------------------------------------------- literal rows

ODD_VALUES = ("  Caroline's ", "Mel's.", "Support   Group", '"Paris!"', "", "  ", "A'S", "it's  's", "Who?")
SPOKEN = (
    ("I went to a LGBTQ support group", "Caroline", "Melanie"), ("You gave me your book", "Ann", "Bob"), ("I'm proud of myself", "Ann", None),
    ("Is that yours or mine?", "Ann", "Bob"), ("Is that yours?", "Ann", None), ("", "Ann", "Bob"), ("me, my and I", "", "Bob"), ("yourself and YOU", "Ann", "Bob"), ("Ivy is mine", "Ann", " "),
)
PHRASES = (*X.TIME_PHRASES, "next week", "Last  Monday")
ANCHORED = tuple((p, a) for p in PHRASES for a in ("1:56 pm on 8 May, 2023", "31 March 2023", "29 February 2024", "31 January 2023", "9:00 on 31 dec, 2023", "31 February 2023", "no date"))
ANSWERS = ("7 May 2023", "May 7, 2023", "a a b", "a", "", "x", "y")
MODEL_ANSWERS = ('```json\n[{"value":"Ann","type":"Who"},]\n```', '{"entities":[{"value":"Ann","type":"Who"}]}', '[{"value":"Ann","type":"Foo"}]', "[] trailing words", 'Sure: [{"value":"Ann","type":"Who"}] ok', '[{"value":"http://x","type":"What"}]', "[1]", '[{"value":"a"}]', "no json", "")
UNITS = (
    ("u1", '{"session_1": {"Ann": [["likes tea", "D1:1"], ["", "D1:2"], {"text": "has a cat", "dia_id": "D1:3"}, "plain"], "Bob": [["runs", ["D1:4", "D1:5"]]]}}', '{"session_1": "They met.", "session_2": "  "}'),
    ("u2", '{"session_2": {"Eve": [["sings", "D2:1"]]}}', '{"session_2": "Eve sang."}'),
)


def _quoted(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows) + f") AS v({names})"


# --------------------------------------------------------------------- queries


def text_entity_key(spark, sf_dir):
    odd = spark.createDataFrame([(v,) for v in ODD_VALUES], "raw string")
    rows = odd.unionByName(load(spark, sf_dir, "part").select(F.col("p_name").alias("raw"))).unionByName(load(spark, sf_dir, "customer").select(F.col("c_name").alias("raw")))
    return rows.select("raw", X.entity_key("raw").alias("entity_key"))


def text_entity_value(spark, sf_dir):
    odd = spark.createDataFrame([(v,) for v in ODD_VALUES], "raw string")
    rows = odd.unionByName(load(spark, sf_dir, "part").select(F.col("p_type").alias("raw")))
    return rows.select("raw", X.entity_value("raw").alias("entity_value"))


def text_tokens(spark, sf_dir):
    t = dialog(spark, sf_dir)
    return t.select("sample_id", "dia_id", F.size(X.metric_tokens("text")).alias("n_tokens"), F.array_join(X.search_tokens("text"), " ").alias("searched"))


def pronoun_normalize(spark, sf_dir):
    odd = spark.createDataFrame(list(SPOKEN), "raw string, speaker string, previous string")
    said = F.concat(F.lit("I told you: my "), "p_name", F.lit(" is yours, and mine"))
    rows = odd.unionByName(load(spark, sf_dir, "part").select(said.alias("raw"), F.col("p_brand").alias("speaker"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("previous")))
    return rows.select("raw", "speaker", "previous", X.normalized("raw", F.col("speaker"), F.col("previous"), F.lit("")).alias("normalized"))


def time_word_resolve(spark, sf_dir):
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("o_orderkey") % len(PHRASES) + 1).cast("int"))
    ordered = load(spark, sf_dir, "orders").select(phrase.alias("phrase"), F.date_format("o_orderdate", "'9:15 am on' d MMMM, y").alias("said"))
    rows = spark.createDataFrame(list(ANCHORED), "phrase string, said string").unionByName(ordered)
    return rows.select("phrase", "said", X.shown_date(X.time_word_date("phrase", X.dialog_date("said"))).alias("resolved"))


def prev_speaker(spark, sf_dir):
    return G.turns(dialog(spark, sf_dir)).select("sample_id", "dia_id", "speaker", "previous_speaker")


def search_text_digest(spark, sf_dir):
    m = dense.memory_texts(G.memories(G.turns(dialog(spark, sf_dir))))
    return m.select("sample_id", "dia_id", X.digest("text").alias("digest"))


def memory_sequence_edges(spark, sf_dir):
    return G.sequence_edges(G.memories(G.turns(dialog(spark, sf_dir)))).select("sample_id", "edge_id", "src_memory_id", "dst_memory_id", "edge_type")


def entity_merge(spark, sf_dir):
    return G.entities(found(spark, sf_dir)).select("sample_id", "entity_id", "key", "value", "type", F.size("merged_from").alias("n_merged"))


def mention_edges(spark, sf_dir):
    return G.mentions(found(spark, sf_dir)).select("sample_id", "edge_id", "entity_id", "memory_id", "weight")


def entity_degree(spark, sf_dir):
    d = G.degrees(G.mentions(found(spark, sf_dir)))
    return d.select("sample_id", "entity_id", "degree", F.round(M.degree_weight(F.col("degree")), 6).alias("degree_weight"))


def graph_stats(spark, sf_dir):
    return G.stats(graph(spark, sf_dir))


def bipartite_violations(spark, sf_dir):
    whole = graph(spark, sf_dir)
    # a damaged graph: every memory of a fourth turn is gone
    damaged = G.Graph(whole.memory.where(~F.col("dia_id").isin("D1:3", "D1:7")), whole.entity, whole.mention, whole.memory_edge)
    return G.violations(damaged)


def _corpus(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select(F.coalesce("lang", F.lit("")).alias("sample_id"), F.col("doc_id").cast("string").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("key"))


def bm25_index_stats(spark, sf_dir):
    index = lexical.index(_corpus(spark, sf_dir))
    return index.terms.groupBy("sample_id").agg(F.count("*").alias("n_terms"), F.max("n").alias("n_docs"), F.round(F.max("avgdl"), 6).alias("avgdl"), F.round(F.sum("idf"), 4).alias("sum_idf"), F.max("df").alias("max_df"))


def bm25_soft_match(spark, sf_dir):
    # every key in every sample: the benchmark has no language of its own
    asked = load(spark, sf_dir, "benchmark").select(X.entity_key("text").alias("qkey")).where("qkey <> ''").distinct()
    found = lexical.match_keys(lexical.index(_corpus(spark, sf_dir), asked=asked), asked)
    return found.select(X.digest("qkey").alias("qkey_digest"), "doc", F.round("score", 6).alias("score"))


def bm25_porter(spark, sf_dir):
    asked = load(spark, sf_dir, "benchmark").select(X.entity_key("text").alias("qkey")).where("qkey <> ''").distinct()
    found = lexical.match_keys(lexical.index(_corpus(spark, sf_dir), "porter", asked), asked, profile="porter")
    return found.select(X.digest("qkey").alias("qkey_digest"), "doc", F.round("score", 6).alias("score"))


def key_match(spark, sf_dir):
    g, k = graph(spark, sf_dir), keys(spark, sf_dir)
    return R.matches(g, k).select(*Q, "qkey", "entity_id", F.round("score", 6).alias("score"))


def _seeds(spark, sf_dir):
    g, k = graph(spark, sf_dir), keys(spark, sf_dir)
    return g, R.seeds(g, R.entity_strength(g, R.matches(g, k)))


def entity_memory_seed(spark, sf_dir):
    return _seeds(spark, sf_dir)[1].select(*Q, "memory_id", F.round("seed", 6).alias("seed"))


def sequence_expand(spark, sf_dir):
    return R.expand(*_seeds(spark, sf_dir)).select(*Q, "memory_id", F.round("e", 6).alias("e"))


def cosine_topk(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").where("embedding is not null").select(F.lit("*").alias("sample_id"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), "vec_id")
    asked = e.where("vec_id % 50 = 0").select("sample_id", F.col("vec_id").cast("int").alias("qa"), F.col("vec").alias("qvec"))
    return nearest.top_k(asked, e.drop("vec_id"), 10).select("qa", "rank", F.col("id").alias("memory_id"), F.round("s", 6).alias("s"))


def retrieve_fused(spark, sf_dir):
    return R.retrieve(*_parts(spark, sf_dir), k=8).select(*Q, "rank", "dia_id", F.round("score", 6).alias("score"))


def retrieve_ungated(spark, sf_dir):
    g, q, k, v = _parts(spark, sf_dir)
    return R.retrieve(g, q, k.limit(0), v, k=8).select(*Q, "rank", "dia_id", F.round("score", 6).alias("score"))


def retrieve_audit(spark, sf_dir):
    a = R.audit(*_parts(spark, sf_dir))
    total = F.round(F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["score"]), 4)
    return a.select(*Q, F.coalesce(F.size("keys"), F.lit(0)).alias("n_keys"), F.coalesce(F.size("entities"), F.lit(0)).alias("n_entities"), "gated", "pool", F.array_join(F.transform("rows", lambda r: r["dia_id"]), ",").alias("ranked"), F.size(F.filter("rows", lambda r: r["via_sequence_only"])).alias("via_sequence"), total.alias("total"))


def _rolled(spark, sf_dir):
    g, q, k, v = _parts(spark, sf_dir)
    by = ["variant", *Q]
    ranked = settle(R.retrieve_variants(g, q, k, v))
    asked = q.withColumn("variant", F.explode(F.array(*[F.lit(x.name) for x in R.VARIANTS])))
    rows = E.at_cutoffs(asked, E.retrieved(ranked, by=by), by=by).join(_predicted(asked, ranked, by), by, "left")
    return E.rollup(rows, by=("variant",)).where("variant is not null")


def _predicted(q, ranked, by=Q):
    """(sample_id, qa, token_f1) of an extractive prediction: the id of the best memory beside the evidence."""
    best = ranked.where("rank = 1").select(*by, F.col("dia_id").alias("prediction"))
    return q.join(best, by, "left").select(*by, M.token_f1(F.array_join("evidence", " "), "prediction").alias("token_f1"))


def variant_ablation(spark, sf_dir):
    return _rolled(spark, sf_dir).where("category is null").select("variant", "k", "n", "recall_acc", "hit_rate", "token_f1_pct")


def token_f1(spark, sf_dir):
    a = spark.createDataFrame([(v,) for v in ANSWERS], "gold string")
    odd = a.crossJoin(a.withColumnRenamed("gold", "predicted"))  # 7 x 7 literal rows
    t = dialog(spark, sf_dir)
    pair = t.select(F.col("text").alias("gold"), F.lead("text").over(W.partitionBy("sample_id").orderBy("pos")).alias("predicted")).where("predicted is not null")
    return odd.unionByName(pair).select(X.digest("gold").alias("gold"), X.digest("predicted").alias("predicted"), F.round(M.token_f1("gold", "predicted"), 6).alias("f1"))


def recall_hit_at_k(spark, sf_dir):
    g, q, k, v = _parts(spark, sf_dir)
    return E.at_cutoffs(q, E.retrieved(R.retrieve(g, q, k, v, 50)), (1, 2, 3, 5)).select(*Q, "category", "k", F.round("recall_acc", 6).alias("recall_acc"), "hit")


def eval_rollup(spark, sf_dir):
    g, q, k, v = _parts(spark, sf_dir)
    ranked = settle(R.retrieve(g, q, k, v, 50))
    return E.rollup(E.at_cutoffs(q, E.retrieved(ranked)).join(_predicted(q, ranked), Q, "left"))


#: What the reader of ``ablation_rollup`` says to everything.
SAID = "the assistant said so and the user thanked the assistant"


def ablation_rollup(spark, sf_dir):
    """The ablation as a job, every variant retrieved, answered and scored on its own."""
    g, q, k, v = _parts(spark, sf_dir)
    rolled = jobs.ablation(g, q, k, v, make_reader=lambda: lambda prompt: SAID)
    return rolled.where("category is null").select("variant", "k", "n", "recall_acc", "hit_rate", "token_f1_pct")


def publish_gate(spark, sf_dir):
    return E.compare(_rolled(spark, sf_dir))


def paper_compare(spark, sf_dir):
    g, q, k, v = _parts(spark, sf_dir)
    ranked = settle(R.retrieve(g, q, k, v, 50))
    return E.against_anchors(spark, E.rollup(E.at_cutoffs(q, E.retrieved(ranked)).join(_predicted(q, ranked), Q, "left")))


def context_assembly(spark, sf_dir):
    g, q, k, v = _parts(spark, sf_dir)
    return E.contexts(R.retrieve(g, q, k, v, 25), g.memory).select(*Q, X.digest("context").alias("context_digest"), F.length("context").alias("n_chars"))


def answer_prompt(spark, sf_dir):
    q = questions(spark, sf_dir)
    return q.select(*Q, X.digest(X.answer_prompt("question", "category", F.when(F.col("qa") > 1, F.lit("line")))).alias("prompt_digest"))


def units_flatten(spark, sf_dir):
    odd = spark.createDataFrame(list(UNITS), "sample_id string, observation string, session_summary string")
    item = F.concat(F.lit('{"session_3": {"'), "p_brand", F.lit('": [["'), "p_name", F.lit('", "D3:'), "p_size", F.lit('"], " ", "'), "p_type", F.lit('"]}}'))
    summary = F.concat(F.lit('{"session_3": " '), "p_type", F.lit('", "session_4": ""}'))
    rows = odd.unionByName(load(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("sample_id"), item.alias("observation"), summary.alias("session_summary")))
    both = units.observations(rows).unionByName(units.summaries(rows))
    return both.select("sample_id", "unit_id", "text", F.array_join("dia_ids", ",").alias("dia_ids"))


def unit_dense_topk(spark, sf_dir):
    q, v = questions(spark, sf_dir), vectors(spark, sf_dir)
    u = v.select("sample_id", F.col("memory_id").alias("unit_id"), M.unit(F.col("vec")).alias("vec"))
    return units.top_units(q.select(*Q, M.unit(F.col("qvec")).alias("qvec")), u, 5).select(*Q, "rank", "unit_id", F.round("score", 6).alias("score"))


def _stored(q):
    """A checkpoint in which answers of every third question are blank and those of every fifth are for other contexts."""
    given = F.when(F.col("qa") % 5 == 0, F.array(F.lit("D9:9"))).otherwise(F.col("evidence"))
    return q.where("qa % 7 <> 0").select(*Q, given.alias("context_ids"), F.when(F.col("qa") % 3 == 0, " ").otherwise("x").alias("prediction"), F.lit(1.0).alias("token_f1"))


def pending_resume(spark, sf_dir):
    q = questions(spark, sf_dir)
    return E.pending(q.select(*Q, F.col("evidence").alias("context_ids")), _stored(q)).select(*Q)


def cache_miss(spark, sf_dir):
    t = dialog(spark, sf_dir)
    cache = t.where("pos % 2 = 0").select(X.digest("text").alias("text_digest"), F.lit("m").alias("model"), F.lit("context").alias("role"))
    return dense.missing(t, "text", cache, "m").select("sample_id", "dia_id", "text_digest")


def llm_json_parse(spark, sf_dir):
    ship(spark)
    odd = spark.createDataFrame([(i, v) for i, v in enumerate(MODEL_ANSWERS)], "i int, answer string")
    one = lambda kind: F.concat(F.lit('{"value": "'), "p_name", F.lit(f'", "type": "{kind}"}}'))
    dressed = (
        F.concat(F.lit("```json\n["), one("Who"), F.lit(",]\n```")), F.concat(F.lit('{"entities": ['), one("Thing"), F.lit("]}")), F.concat(F.lit('{"note": "x"} ['), one("When"), F.lit("] and so on")),
        one("Where"), F.concat(F.lit("[]```json\n["), one("Who"), F.lit("]```")), F.concat(F.lit('{"found": ['), one("Why"), F.lit("]}")), F.concat(F.lit("nothing in "), "p_name"),
    )
    answers = F.element_at(F.array(*dressed), (F.col("p_partkey") % len(dressed) + 1).cast("int"))
    rows = odd.unionByName(load(spark, sf_dir, "part").select((F.col("p_partkey") + 100).cast("int").alias("i"), answers.alias("answer")))
    p = rows.select("i", extract.parsed("answer").alias("p"))
    return p.select("i", F.array_join(F.transform("p.items", lambda x: F.concat_ws("/", x["value"], x["type"])), ";").alias("items"), F.col("p.error").isNotNull().alias("failed"))


def embed_memories(spark, sf_dir):
    m = dense.memory_texts(G.memories(G.turns(dialog(spark, sf_dir))))
    done = dense.embed(m, "text")
    return done.select("text_digest", "model", "role", "dim", F.round(M.dot(F.col("vec"), F.col("vec")), 3).alias("norm"))


# ------------------------------------------------------------------ the same in SQL

CTE = {
    "t": f"SELECT conv_id::VARCHAR AS sample_id, conv_id, 'D1:' || turn AS dia_id, 'memory:D1:' || turn AS memory_id, turn::INT AS pos, role AS speaker, coalesce(text, '') AS text, '{TIME}' AS date_time FROM conversations",
    "tok": f"SELECT DISTINCT sample_id, memory_id, pos, tok FROM (SELECT *, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM t) WHERE length(tok) >= {LEAST} OR regexp_full_match(tok, '(19|20)[0-9]{{2}}')",
    "found": "SELECT sample_id, memory_id, pos, tok AS key, tok AS value, CASE WHEN regexp_full_match(tok, '(19|20)[0-9]{2}') THEN 'When' ELSE 'What' END AS type FROM tok UNION ALL SELECT sample_id, memory_id, pos, lower(speaker), speaker, 'Who' FROM t WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM tok WHERE tok.sample_id = t.sample_id AND tok.memory_id = t.memory_id AND tok.tok = lower(t.speaker))",
    "entity": "SELECT sample_id, 'entity:' || key AS entity_id, key, arg_min(value, pos) AS value, arg_min(type, pos) AS type FROM found GROUP BY sample_id, key",
    "mention": "SELECT DISTINCT sample_id, 'entity:' || key AS entity_id, memory_id FROM found",
    "degree": "SELECT sample_id, entity_id, count(*) AS degree FROM mention GROUP BY ALL",
    "q": "SELECT sample_id, conv_id, row_number() OVER (PARTITION BY sample_id ORDER BY pos)::INT AS qa, text AS question, 'D1:' || (pos + 1) AS gold, (conv_id % 5 + 1)::INT AS category, pos FROM t WHERE speaker = 'user'",
    "qk": f"SELECT DISTINCT sample_id, qa, qkey FROM (SELECT sample_id, qa, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS qkey FROM q) WHERE length(qkey) >= {LEAST} OR regexp_full_match(qkey, '(19|20)[0-9]{{2}}') UNION SELECT sample_id, qa, 'assistant' FROM q WHERE qa % 2 = 0",
    # an entity's document is its key, one token
    "n": "SELECT sample_id, count(*) AS n FROM entity GROUP BY 1",
    "idf": "SELECT sample_id, key, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY sample_id) ELSE raw END AS idf FROM (SELECT e.sample_id, key, ln(n - 1 + 0.5) - ln(1.5::DOUBLE) AS raw FROM entity e JOIN n USING (sample_id))",
    "matched": "SELECT qk.sample_id, qa, qkey, entity_id, 1.0::DOUBLE AS score FROM qk JOIN entity e ON qk.sample_id = e.sample_id AND qkey = key",
    "n_keys": "SELECT sample_id, qa, count(DISTINCT qkey) AS n_keys FROM matched GROUP BY 1, 2",
    "marked": "SELECT m.*, e.type = 'Who' AS is_who, bool_or(e.type = 'Who') OVER (PARTITION BY m.sample_id, qa, qkey) AS key_is_who FROM matched m JOIN entity e USING (sample_id, entity_id)",
    "strength": "SELECT sample_id, qa, entity_id, is_who OR all_who AS who_like, s / n_keys * (1.0 / ln(1 + greatest(degree, 1)::DOUBLE)) AS raw FROM (SELECT sample_id, qa, entity_id, is_who, sum(score) AS s, bool_and(key_is_who) AS all_who FROM marked GROUP BY ALL) JOIN n_keys USING (sample_id, qa) JOIN degree USING (sample_id, entity_id)",
    "seed": "SELECT sample_id, qa, memory_id, round(CASE WHEN c > 0 THEN greatest(c, w) ELSE w * 0.25 END, 9) AS seed FROM (SELECT sample_id, qa, memory_id, coalesce(max(raw) FILTER (WHERE NOT who_like), 0) AS c, coalesce(max(raw) FILTER (WHERE who_like), 0) AS w FROM strength JOIN mention USING (sample_id, entity_id) GROUP BY ALL)",
    "grid": "SELECT g.sample_id, g.qa, t.memory_id, t.pos, s.seed FROM (SELECT DISTINCT sample_id, qa FROM seed) g JOIN t USING (sample_id) LEFT JOIN seed s ON s.sample_id = g.sample_id AND s.qa = g.qa AND s.memory_id = t.memory_id",
    "expanded": "SELECT * FROM (SELECT sample_id, qa, memory_id, seed, round(greatest(seed, 0.5 * lag(seed) OVER w, 0.5 * lead(seed) OVER w), 9) AS e FROM grid WINDOW w AS (PARTITION BY sample_id, qa ORDER BY pos)) WHERE e IS NOT NULL",
    "plain": "SELECT sample_id, qa, memory_id, seed, seed AS e FROM seed",
    "vec": "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 1e-12)) AS v, (SELECT count(*) FROM embeddings) AS n FROM embeddings",
    "dense": "SELECT q.sample_id, qa, t.memory_id, t.dia_id, greatest(round(list_dot_product(a.v, b.v), 9), 0) AS s, round(list_dot_product(a.v, b.v), 9) AS raw FROM q JOIN t ON q.sample_id = t.sample_id JOIN vec a ON a.vec_id = (q.conv_id * 8 + q.pos + 1) % a.n JOIN vec b ON b.vec_id = (t.conv_id * 8 + t.pos) % b.n",
}
SEEDED = ["t", "tok", "found", "entity", "mention", "degree", "q", "qk", "matched", "n_keys", "marked", "strength", "seed", "grid"]
FUSED = [*SEEDED, "expanded", "plain", "vec", "dense"]


def _with(names, last: str, **more: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names) + "".join(f", {n} AS ({s})" for n, s in more.items()) + " " + last


def _pool(scores: str, we: float, ws: float, gate: bool) -> str:
    gated = f"EXISTS (SELECT 1 FROM {scores} g WHERE g.sample_id = d.sample_id AND g.qa = d.qa)" if gate else "false"
    return f"SELECT * FROM (SELECT d.sample_id, d.qa, d.memory_id, d.dia_id, coalesce(x.seed, 0) AS seed, coalesce(x.e, 0) AS e, s, {gated} AS gated, round({we}::DOUBLE * coalesce(x.e, 0) + {ws}::DOUBLE * s, 9) AS score, x.memory_id IS NOT NULL AS inside FROM dense d LEFT JOIN {scores} x ON x.sample_id = d.sample_id AND x.qa = d.qa AND x.memory_id = d.memory_id) WHERE (inside OR NOT gated) AND NOT (e <= 0 AND s <= 0)"


def _ranked(pool: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, qa ORDER BY score DESC, dia_id)::INT AS rank FROM {pool}) WHERE rank <= {k}"


NONE = "SELECT sample_id, qa, memory_id, seed, seed AS e FROM seed WHERE false"
FUSED_POOL = {"pool": _pool("expanded", 0.3, 0.7, True)}


def _variant_ctes() -> dict[str, str]:
    out = {"nothing": NONE}
    for v in R.VARIANTS:
        scores = ("expanded" if v.expand else "plain") if v.entities else "nothing"
        out[f"pool_{v.name}"] = _pool(scores, v.we, v.ws, v.gate)
        out[f"top_{v.name}"] = _ranked(f"pool_{v.name}", 50)
    ks = ", ".join(map(str, KS))
    out["every"] = " UNION ALL ".join(f"SELECT '{v.name}' AS variant, sample_id, qa, rank, dia_id FROM top_{v.name}" for v in R.VARIANTS)
    out["cut"] = f"SELECT v.variant, q.sample_id, q.qa, q.category, k, coalesce(bool_or(e.dia_id = q.gold AND e.rank <= k), false) AS hit, max(e.dia_id) FILTER (WHERE e.rank = 1) AS best, any_value(q.gold) AS gold FROM q CROSS JOIN (SELECT unnest([{', '.join(repr(v.name) for v in R.VARIANTS)}]) AS variant) v CROSS JOIN (SELECT unnest([{ks}]) AS k) k LEFT JOIN every e ON e.variant = v.variant AND e.sample_id = q.sample_id AND e.qa = q.qa GROUP BY v.variant, q.sample_id, q.qa, q.category, k"
    out["pairs"] = "SELECT *, list_distinct(regexp_extract_all(lower(gold), '[a-z0-9]+')) AS g, list_distinct(regexp_extract_all(lower(coalesce(best, '')), '[a-z0-9]+')) AS p FROM cut"
    out["scored"] = "SELECT *, " + _F1 + " AS f1 FROM pairs"
    return out


_F1 = "CASE WHEN len(g) = 0 AND len(p) = 0 THEN 1.0 WHEN len(g) = 0 OR len(p) = 0 OR len(list_intersect(g, p)) = 0 THEN 0.0 ELSE 2.0 * (len(list_intersect(g, p))::DOUBLE / len(p)) * (len(list_intersect(g, p))::DOUBLE / len(g)) / (len(list_intersect(g, p))::DOUBLE / len(p) + len(list_intersect(g, p))::DOUBLE / len(g)) END::DOUBLE"
_ROLL = "count(*) AS n, round(100 * avg(hit::INT::DOUBLE), 2) AS recall_acc, round(100 * avg(hit::INT::DOUBLE), 2) AS hit_rate, round(100 * avg(round(f1, 4)) FILTER (WHERE k = 25), 2) AS token_f1_pct"
_ROLL5 = _ROLL + ", round(100 * avg(round(f1, 4)) FILTER (WHERE k = 25 AND category <> 5), 2) AS token_f1_excl5_pct"
_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(raw), '^\s+|\s+$', '', 'g'), '''s$', ''), '\s+', ' ', 'g')"
_SEARCH = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN (" + ", ".join(map(repr, X.STOPWORDS)) + "))"
_CORPUS = {
    "d": "SELECT coalesce(lang, '') AS sample_id, doc_id::VARCHAR AS doc, CASE WHEN len(x) > 0 THEN x ELSE ['_empty'] END AS x FROM (SELECT *, " + _SEARCH.format("text") + " AS x FROM documents)",
    "p": "SELECT sample_id, doc, len(x) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(x) AS term FROM d) GROUP BY ALL",
    "sizes": "SELECT sample_id, count(*) AS n, avg(len(x)::DOUBLE) AS avgdl FROM d GROUP BY 1",
    "raw": "SELECT sample_id, term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT sample_id, term, count(*)::DOUBLE AS df FROM p GROUP BY ALL) JOIN sizes USING (sample_id)",
    "terms": "SELECT *, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY sample_id) ELSE raw END AS idf FROM raw",
}


def _spoken_sql() -> str:
    out = "raw"
    speaker, previous = "trim(speaker)", "trim(coalesce(previous, ''))"
    for name, words in ((speaker, (("I", ""), ("me", ""), ("my", "'s"), ("mine", "'s"), ("myself", ""))), (previous, (("you", ""), ("your", "'s"), ("yours", "'s"), ("yourself", "")))):
        inner = out
        for word, tail in words:
            inner = f"regexp_replace({inner}, '\\b{word}\\b', {name} || {_quoted(tail)}, 'gi')"
        out = f"CASE WHEN {name} = '' THEN {out} ELSE {inner} END"
    return out


def _time_sql() -> str:
    shifts = " ".join(f"WHEN w = '{p}' THEN a + INTERVAL ({d}) DAY" for p, d in X.DAY_SHIFTS.items())
    days = " ".join(f"WHEN w = 'last {d}' THEN a - INTERVAL ((isodow(a) - {i + 1} + 6) % 7 + 1) DAY" for i, d in enumerate(X.WEEKDAYS))
    month = "date_trunc('month', a){} + INTERVAL (least(day(a), 28) - 1) DAY"
    return (
        r"WITH v AS (SELECT * FROM " + _values(ANCHORED, "phrase, said") + f" UNION ALL SELECT ([{', '.join(map(_quoted, PHRASES))}])[o_orderkey % {len(PHRASES)} + 1], strftime(o_orderdate, '9:15 am on %-d %B, %Y') FROM orders" + r"), d AS (SELECT phrase, said, regexp_replace(trim(lower(phrase)), '\s+', ' ', 'g') AS w, try_strptime(regexp_extract(said, '([0-9]{1,2} [A-Za-z]{3})', 1) || ' ' || regexp_extract(said, '([0-9]{4})\b', 1), '%d %b %Y') AS a FROM v) "
        f"SELECT phrase, said, strftime(CASE {shifts} WHEN w = 'next month' THEN {month.format(' + INTERVAL 1 MONTH')} WHEN w IN ('a year ago', 'one year ago') THEN {month.format(' - INTERVAL 12 MONTH')} {days} END, '%-d %B %Y') AS resolved FROM d"
    )


def _units_sql() -> str:
    rows = [("u1", "obs::session_1::Ann::0", "likes tea", "D1:1"), ("u1", "obs::session_1::Ann::2", "has a cat", "D1:3"), ("u1", "obs::session_1::Ann::3", "plain", ""), ("u1", "obs::session_1::Bob::0", "runs", "D1:4,D1:5"), ("u2", "obs::session_2::Eve::0", "sings", "D2:1"), ("u1", "sum::session_1", "They met.", ""), ("u2", "sum::session_2", "Eve sang.", "")]
    made = "SELECT 'p' || p_partkey, unnest(['obs::session_3::' || p_brand || '::0', 'obs::session_3::' || p_brand || '::2', 'sum::session_3']), unnest([p_name, p_type, p_type]), unnest(['D3:' || p_size, '', '']) FROM part"
    return "SELECT * FROM " + _values(rows, "sample_id, unit_id, text, dia_ids") + " UNION ALL " + made


def _prompt_sql() -> str:
    q = f"regexp_replace(question, '^\\s+|\\s+$', '', 'g') || CASE WHEN category = 2 THEN {_quoted(X.DATE_HINT)} ELSE '' END"
    body = f"CASE WHEN category = 5 THEN replace({_quoted(X.REFUSABLE)}, '{{}}', {q}) ELSE replace({_quoted(X.SHORT_ANSWER)}, '{{}}', {q}) END"
    return f"SELECT sample_id, qa, substr(sha256(CASE WHEN qa > 1 THEN 'line' ELSE {_quoted(X.NO_CONTEXT)} END || chr(10) || chr(10) || {body}), 1, 32) AS prompt_digest FROM q"


SQL = {
    "text_entity_key": f"SELECT raw, {_KEY} AS entity_key FROM (SELECT raw FROM {_values([(v,) for v in ODD_VALUES], 'raw')} UNION ALL SELECT p_name FROM part UNION ALL SELECT c_name FROM customer)",
    "text_entity_value": rf"""SELECT raw, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '''s$', '', 'i'), '^[ .,;:!?"'']+|[ .,;:!?"'']+$', '', 'g') AS entity_value FROM (SELECT raw FROM {_values([(v,) for v in ODD_VALUES], "raw")} UNION ALL SELECT p_type FROM part)""",
    "text_tokens": _with(["t"], f"SELECT sample_id, dia_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INT AS n_tokens, array_to_string({_SEARCH.format('text')}, ' ') AS searched FROM t"),
    "pronoun_normalize": f"SELECT raw, speaker, previous, {_spoken_sql()} AS normalized FROM (SELECT * FROM {_values(SPOKEN, 'raw, speaker, previous')} UNION ALL SELECT 'I told you: my ' || p_name || ' is yours, and mine', p_brand, CASE WHEN p_partkey % 3 > 0 THEN p_type END FROM part)",
    "time_word_resolve": _time_sql(),
    "prev_speaker": _with(["t"], "SELECT sample_id, dia_id, speaker, last_value(nullif(trim(speaker), '') IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_speaker FROM t"),
    "search_text_digest": _with(["t"], r"SELECT sample_id, dia_id, substr(sha256(regexp_replace(text || ' ' || text || ' ' || speaker || '  ', '^\s+|\s+$', '', 'g')), 1, 32) AS digest FROM t"),
    "memory_sequence_edges": _with(["t"], "SELECT sample_id, 'medge:next:' || memory_id || '->' || m2 AS edge_id, memory_id AS src_memory_id, m2 AS dst_memory_id, 'next' AS edge_type FROM s WHERE m2 IS NOT NULL UNION ALL SELECT sample_id, 'medge:prev:' || m2 || '->' || memory_id, m2, memory_id, 'prev' FROM s WHERE m2 IS NOT NULL", s="SELECT *, lead(memory_id) OVER (PARTITION BY sample_id ORDER BY pos) AS m2 FROM t"),
    "entity_merge": _with(["t", "tok", "found", "entity"], "SELECT e.sample_id, entity_id, e.key, e.value, e.type, count(DISTINCT f.value)::INT AS n_merged FROM entity e JOIN found f ON e.sample_id = f.sample_id AND e.key = f.key GROUP BY ALL"),
    "mention_edges": _with(["t", "tok", "found", "mention"], "SELECT sample_id, 'edge:' || entity_id || '->' || memory_id AS edge_id, entity_id, memory_id, 1.0::DOUBLE AS weight FROM mention"),
    "entity_degree": _with(["t", "tok", "found", "mention", "degree"], "SELECT sample_id, entity_id, degree, round(1.0 / ln(1 + degree::DOUBLE), 6) AS degree_weight FROM degree"),
    "graph_stats": _with(["t", "tok", "found", "entity", "mention"], "SELECT sample_id, count(*) AS memories, (SELECT count(*) FROM entity e WHERE e.sample_id = t.sample_id) AS entities, (SELECT count(*) FROM mention m WHERE m.sample_id = t.sample_id) AS mentions, 2 * (count(*) - 1) AS memory_edges FROM t GROUP BY sample_id"),
    "bipartite_violations": _with(["t", "tok", "found", "mention"], "SELECT sample_id, 'edge:' || entity_id || '->' || memory_id AS edge_id, 'memory of mention' AS problem FROM mention WHERE memory_id IN ('memory:D1:3', 'memory:D1:7') UNION ALL SELECT sample_id, edge_id, 'source of sequence edge' FROM e WHERE src IN ('memory:D1:3', 'memory:D1:7') UNION ALL SELECT sample_id, edge_id, 'target of sequence edge' FROM e WHERE dst IN ('memory:D1:3', 'memory:D1:7')", s="SELECT *, lead(memory_id) OVER (PARTITION BY sample_id ORDER BY pos) AS m2 FROM t", e="SELECT sample_id, 'medge:next:' || memory_id || '->' || m2 AS edge_id, memory_id AS src, m2 AS dst FROM s WHERE m2 IS NOT NULL UNION ALL SELECT sample_id, 'medge:prev:' || m2 || '->' || memory_id, m2, memory_id FROM s WHERE m2 IS NOT NULL"),
    "bm25_soft_match": "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _CORPUS.items()) + ", asked AS (SELECT DISTINCT qkey FROM (SELECT " + _KEY + " AS qkey FROM (SELECT coalesce(text, '') AS raw FROM benchmark)) WHERE qkey <> ''), qt AS (SELECT qkey, term, count(*) AS times FROM (SELECT qkey, unnest(" + _SEARCH.format("qkey") + ") AS term FROM asked) GROUP BY ALL), s AS (SELECT sample_id, qkey, doc, sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS score FROM qt JOIN terms USING (term) JOIN p USING (sample_id, term) GROUP BY ALL), r AS (SELECT sample_id, qkey, doc, round(score / max(score) OVER (PARTITION BY sample_id, qkey), 9) AS rel, max(score) OVER (PARTITION BY sample_id, qkey) AS best FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, qkey ORDER BY rel DESC, doc) AS i FROM r WHERE best > 0 AND rel >= 0.5) SELECT substr(sha256(qkey), 1, 32) AS qkey_digest, doc, round(rel, 6) AS score FROM k WHERE i <= 20",
    "key_match": _with(SEEDED[:9], "SELECT sample_id, qa, qkey, entity_id, round(score, 6) AS score FROM matched"),
    "entity_memory_seed": _with(SEEDED[:13], "SELECT sample_id, qa, memory_id, round(seed, 6) AS seed FROM seed"),
    "sequence_expand": _with([*SEEDED, "expanded"], "SELECT sample_id, qa, memory_id, round(e, 6) AS e FROM expanded"),
    "cosine_topk": _with(["vec"], "SELECT qa, rank::INT AS rank, memory_id, round(s, 6) AS s FROM (SELECT *, row_number() OVER (PARTITION BY qa ORDER BY s DESC, memory_id) AS rank FROM (SELECT a.vec_id::INT AS qa, b.vec_id::VARCHAR AS memory_id, greatest(round(list_dot_product(a.v, b.v), 9), 0) AS s FROM vec a JOIN vec b ON a.vec_id % 50 = 0)) WHERE rank <= 10"),
    "retrieve_fused": _with(FUSED, "SELECT sample_id, qa, rank, dia_id, round(score, 6) AS score FROM (" + _ranked("pool", 8) + ")", **FUSED_POOL),
    "retrieve_ungated": _with(FUSED, "SELECT sample_id, qa, rank, dia_id, round(score, 6) AS score FROM (" + _ranked("pool", 8) + ")", nothing=NONE, pool=_pool("nothing", 0.3, 0.7, True)),
    "retrieve_audit": _with(FUSED, "SELECT q.sample_id, q.qa, (SELECT count(*) FROM qk WHERE qk.sample_id = q.sample_id AND qk.qa = q.qa)::INT AS n_keys, (SELECT count(*) FROM strength s WHERE s.sample_id = q.sample_id AND s.qa = q.qa)::INT AS n_entities, coalesce(p.gated, false) AS gated, coalesce(p.n, 0)::BIGINT AS pool, ranked, via_sequence::INT AS via_sequence, round(total, 4) AS total FROM q LEFT JOIN (SELECT sample_id, qa, bool_or(gated) AS gated, count(*) AS n FROM pool GROUP BY ALL) p USING (sample_id, qa) LEFT JOIN (SELECT sample_id, qa, string_agg(dia_id, ',' ORDER BY rank) AS ranked, count(*) FILTER (WHERE seed <= 0 AND e > 0) AS via_sequence, sum(round(score, 6)) AS total FROM top GROUP BY ALL) r USING (sample_id, qa)", **FUSED_POOL, top=_ranked("pool", 8)),
    "variant_ablation": _with(FUSED, f"SELECT variant, k, {_ROLL} FROM scored GROUP BY variant, k", **_variant_ctes()),
    "ablation_rollup": _with(FUSED, f"SELECT variant, k, {_ROLL} FROM scored GROUP BY variant, k", **(_variant_ctes() | {"pairs": f"SELECT cut.*, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS g, list_distinct(regexp_extract_all({_quoted(SAID)}, '[a-z0-9]+')) AS p FROM cut JOIN q USING (sample_id, qa)"})),
    "token_f1": "WITH a AS (SELECT * FROM " + _values([(v,) for v in ANSWERS], "x") + "), pairs AS (SELECT a.x AS gold, b.x AS predicted FROM a CROSS JOIN a b UNION ALL SELECT * FROM (SELECT coalesce(text, '') AS gold, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS predicted FROM conversations) WHERE predicted IS NOT NULL), s AS (SELECT *, list_distinct(regexp_extract_all(lower(gold), '[a-z0-9]+')) AS g, list_distinct(regexp_extract_all(lower(predicted), '[a-z0-9]+')) AS p FROM pairs) SELECT substr(sha256(gold), 1, 32) AS gold, substr(sha256(predicted), 1, 32) AS predicted, round(" + _F1 + ", 6) AS f1 FROM s",
    "recall_hit_at_k": _with(FUSED, "SELECT q.sample_id, q.qa, q.category, k, coalesce(bool_or(dia_id = gold AND rank <= k), false)::INT::DOUBLE AS recall_acc, coalesce(bool_or(dia_id = gold AND rank <= k), false) AS hit FROM q CROSS JOIN (SELECT unnest([1, 2, 3, 5]) AS k) LEFT JOIN top USING (sample_id, qa) GROUP BY q.sample_id, q.qa, q.category, k", **FUSED_POOL, top=_ranked("pool", 50)),
    "eval_rollup": _with(FUSED, f"SELECT k, category, {_ROLL5} FROM scored WHERE variant = 'B' GROUP BY GROUPING SETS ((k), (k, category))", **_variant_ctes()),
    "publish_gate": _with(FUSED, "SELECT f1_a, f1_b, recall_a, recall_b, round(f1_b - f1_a, 2) AS delta_f1, round(recall_b - recall_a, 2) AS delta_recall, CASE WHEN f1_a IS NULL OR f1_b IS NULL THEN 'incomplete' WHEN f1_b > f1_a AND recall_b > recall_a THEN 'publish_ok_method_helps' WHEN f1_b >= f1_a THEN 'publish_ok_f1_non_worse' ELSE 'method_weaker_on_f1_diagnose' END AS gate FROM (SELECT max(token_f1_pct) FILTER (WHERE variant = 'A') AS f1_a, max(token_f1_pct) FILTER (WHERE variant = 'B') AS f1_b, max(recall_acc) FILTER (WHERE variant = 'A') AS recall_a, max(recall_acc) FILTER (WHERE variant = 'B') AS recall_b FROM rolled)", **_variant_ctes(), rolled=f"SELECT variant, {_ROLL} FROM scored WHERE k = 25 GROUP BY variant"),
    "paper_compare": _with(FUSED, "SELECT k, recall_acc, anchor_recall, round(recall_acc - anchor_recall, 2) AS delta_pp FROM (SELECT unnest([5, 10, 25, 50]) AS k, unnest([56.7, 66.2, 76.7, 82.7])::DOUBLE AS anchor_recall) LEFT JOIN rolled USING (k)", **_variant_ctes(), rolled=f"SELECT k, {_ROLL} FROM scored WHERE variant = 'B' GROUP BY k"),
    "context_assembly": _with(FUSED, "SELECT sample_id, qa, substr(sha256(c), 1, 32) AS context_digest, length(c)::INT AS n_chars FROM (SELECT top.sample_id, qa, string_agg(date_time || ': ' || speaker || ' said, \"' || text || '\"', chr(10) ORDER BY rank) AS c FROM top JOIN t ON t.sample_id = top.sample_id AND t.dia_id = top.dia_id GROUP BY ALL)", **FUSED_POOL, top=_ranked("pool", 25)),
    "answer_prompt": _with(["t", "q"], _prompt_sql()),
    "units_flatten": _units_sql(),
    "unit_dense_topk": _with(["t", "q", "vec", "dense"], "SELECT sample_id, qa, rank::INT AS rank, memory_id AS unit_id, round(raw, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, qa ORDER BY raw DESC, memory_id) AS rank FROM dense) WHERE rank <= 5"),
    "pending_resume": _with(["t", "q"], "SELECT sample_id, qa FROM q WHERE qa % 7 = 0 OR qa % 3 = 0 OR qa % 5 = 0"),
    "cache_miss": _with(["t"], "SELECT sample_id, dia_id, substr(sha256(text), 1, 32) AS text_digest FROM t WHERE text NOT IN (SELECT text FROM t WHERE pos % 2 = 0)"),
}
def _porter_sql() -> dict[str, str]:
    """Tables p0, p1, ... from the distinct tokens (token) of ``every``: the stemmer's steps, written for this SQL; ``stems`` (token, stem) at the end."""

    def case(choices, otherwise):
        return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in choices) + f" ELSE {otherwise} END"

    d = porter.Dialect(
        when=case, ends=lambda w, s: f"suffix({w}, '{s}')", replaced=lambda w, pattern, put: f"regexp_replace({w}, '{pattern}', '\\1{put}', 'g')",
        matches=lambda w, pattern, *equal: f"(regexp_matches({w}, '{pattern}')" + (f" AND {equal[0]} = {equal[1]})" if equal else ")"),
        without=lambda w, n: f"left({w}, greatest(length({w}) - {n}, 0))", last=lambda w, back: f"substr({w}, length({w}) - {back}, 1)", joined=lambda w, tail: f"{w} || '{tail}'",
    )
    out = {"p0": "SELECT DISTINCT token, token AS w FROM every"}
    for k, step in enumerate(porter.steps(d), 1):
        out[f"p{k}"] = f"SELECT token, {step('w')} AS w FROM p{k - 1}"
    irregular = " ".join(f"WHEN token = '{a}' THEN '{b}'" for a, b in porter.IRREGULAR.items())
    out["stems"] = f"SELECT token, CASE WHEN length(token) <= 2 THEN token {irregular} ELSE replace(w, 'Y', 'y') END AS stem FROM p{k}"
    return out


def _stemmed_sql() -> str:
    """The SQL of bm25_soft_match over stems: tokens are told apart by their row, and stems joined to them."""
    asked = "SELECT DISTINCT qkey FROM (SELECT " + _KEY + " AS qkey FROM (SELECT coalesce(text, '') AS raw FROM benchmark)) WHERE qkey <> ''"
    ctes = {
        "docs": "SELECT coalesce(lang, '') AS sample_id, doc_id::VARCHAR AS doc, " + _SEARCH.format("text") + " AS x FROM documents",
        "asked": asked,
        "keys": "SELECT qkey, unnest(" + _SEARCH.format("qkey") + ") AS token FROM asked",
        "each": "SELECT sample_id, doc, unnest(x) AS token FROM docs WHERE len(x) > 0 UNION ALL SELECT sample_id, doc, '_empty' FROM docs WHERE len(x) = 0",
        "every": "SELECT token FROM keys UNION SELECT token FROM each WHERE token <> '_empty'",
        **_porter_sql(),
        "e": "SELECT sample_id, doc, coalesce(stem, token) AS term FROM each LEFT JOIN stems USING (token)",
        "lengths": "SELECT sample_id, doc, count(*) AS dl FROM e GROUP BY ALL",
        "p": "SELECT sample_id, doc, dl, term, count(*) AS tf FROM e JOIN lengths USING (sample_id, doc) GROUP BY ALL",
        "sizes": "SELECT sample_id, count(*) AS n, avg(dl::DOUBLE) AS avgdl FROM lengths GROUP BY 1",
        "raw": _CORPUS["raw"],
        "terms": _CORPUS["terms"],
        "qt": "SELECT qkey, stem AS term, count(*) AS times FROM keys JOIN stems USING (token) GROUP BY ALL",
    }
    whole = SQL["bm25_soft_match"]
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in ctes.items()) + whole[whole.index(", s AS (SELECT sample_id, qkey, doc") :]


SQL["bm25_porter"] = _stemmed_sql()
SQL["bm25_index_stats"] = "WITH " + ", ".join(f"{n} AS ({s})" for n, s in _CORPUS.items()) + " SELECT sample_id, count(*) AS n_terms, max(n) AS n_docs, round(max(avgdl), 6) AS avgdl, round(sum(idf), 4) AS sum_idf, max(df)::BIGINT AS max_df FROM terms GROUP BY sample_id"

NAMES = (*SQL, "llm_json_parse", "embed_memories")


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
