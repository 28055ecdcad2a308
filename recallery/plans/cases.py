"""Queries of sources, codecs, caches and jobs over the driver's tables, each with the same in DuckDB's SQL.

Conversation files are written from the ``conversations`` table into the shared folder and read
back as a user's files would be: sessions of four turns, with entries that must be passed over.
"""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recallery.functions import metrics as M
from recallery.functions import text as X
from recallery.operators import dense, extract, units
from recallery.operators import graph as G
from recallery.operators import retrieve as R
from recallery.plans import catalog as C
from recallery.plans import evaluate as E
from recallery.plans import jobs
from recallery.schema import DIALOG
from recallery.sources import scratch, store
from recallery.streaming import incremental

Q = C.Q
#: Turns whose state one part of a stream's state store holds, about.
TURNS_OF_A_STORE = 100_000
#: Samples of a file with an array.
SAMPLES_OF_A_FILE = 200


def _place(spark: SparkSession) -> str:
    return f"{scratch.folder(spark)}/{uuid.uuid4().hex}"


# ------------------------------------------------------------- written sources


def conversation_files(spark: SparkSession, sf_dir: str, lines: bool = False) -> str:
    """JSON arrays of samples, or a sample a line. A session also holds an entry that is no object and a turn without an id; a sample also
    a session that is no list and one without a number. Session and turn of turn t: t div 4 + 1 and t mod 4 + 1."""
    t = C.load(spark, sf_dir, "conversations")
    turn = F.to_json(F.struct(F.concat(F.lit("D"), F.floor(F.col("turn") / 4) + 1, F.lit(":"), F.col("turn") % 4 + 1).alias("dia_id"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), F.array(F.lit("u")).alias("img_url"), F.when(F.col("turn") % 5 == 0, "a cat").alias("img_caption")))
    each = t.groupBy("conv_id", (F.floor(F.col("turn") / 4) + 1).alias("n")).agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("j")))).alias("l"))
    listed = F.concat(F.lit('["junk", {"dia_id": " ", "speaker": "Zed", "text": "lost"}, '), F.array_join(F.transform("l", lambda x: x["j"]), ", "), F.lit("]"))
    session = each.select("conv_id", F.concat(F.lit('"session_'), "n", F.lit('": '), listed, F.lit(', "session_'), "n", F.lit(f'_date_time": "{C.TIME}"')).alias("s"))
    talk = session.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("s")), ", ").alias("talk"))
    asked = F.when(t["role"] == "user", F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("question"), F.col("turn").alias("answer"), F.array(F.concat(F.lit("D"), F.floor(F.col("turn") / 4) + 1, F.lit(":"), F.col("turn") % 4 + 1)).alias("evidence"), (F.col("turn") % 5 + 1).alias("category")))).otherwise('{"question": "  "}')
    qa = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", asked.alias("j")))).alias("l")).select("conv_id", F.array_join(F.transform("l", lambda x: x["j"]), ", ").alias("qa"))
    sample = talk.join(qa, "conv_id").select("conv_id", F.concat(F.lit('{"sample_id": "'), "conv_id", F.lit('", "conversation": {'), "talk", F.lit(', "session_9": "no list", "session_x": []}, "qa": ['), "qa", F.lit("]}")).alias("j"))
    path = _place(spark)
    if lines:
        sample.select("j").write.text(path)
        return path
    n = t.agg(F.ceil(F.count_distinct("conv_id") / SAMPLES_OF_A_FILE)).first()[0]
    files = sample.groupBy(F.pmod(F.xxhash64("conv_id"), F.lit(max(n, 1))).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ", "), F.lit("]")).alias("value"))
    files.write.partitionBy("file").text(path)
    return f"{path}/file=*"


# --------------------------------------------------------------------- queries


def source_dialogs(spark, sf_dir):
    return store.dialogs(store.samples(spark, conversation_files(spark, sf_dir))).where(~X.blank("dia_id")).select("sample_id", "session_num", "date_time", "dia_id", "speaker", X.digest("text").alias("text_digest"), "img_url", "blip_caption")


def source_session(spark, sf_dir):
    """One sample, one session."""
    df = store.samples(spark, conversation_files(spark, sf_dir, lines=True), "3")
    return store.dialogs(df, 2).where(~X.blank("dia_id")).select("sample_id", "session_num", "dia_id", "speaker", X.digest("text").alias("text_digest"))


def source_questions(spark, sf_dir):
    q = store.questions(store.samples(spark, conversation_files(spark, sf_dir, lines=True)))
    return q.select("sample_id", "qa", X.digest("question").alias("question_digest"), "answer", F.array_join("evidence", ",").alias("evidence"), "category")


def source_graph(spark, sf_dir):
    """A graph from files, its memories in order with the speaker before each."""
    spoken = G.turns(store.dialogs(store.samples(spark, conversation_files(spark, sf_dir))))
    return G.memories(spoken).join(spoken.select("sample_id", "dia_id", "previous_speaker"), ["sample_id", "dia_id"]).select("sample_id", "memory_id", "session_num", "speaker", "previous_speaker")


def graph_json_roundtrip(spark, sf_dir):
    back = store.from_json(store.to_json(C.graph(spark, sf_dir)))
    return back.mention.select("sample_id", "edge_id", "entity_id", "memory_id", "weight", F.col("metadata")["dia_id"].alias("dia_id"))


def graph_store_roundtrip(spark, sf_dir):
    path = _place(spark)
    store.save_graph(C.graph(spark, sf_dir), path)
    back = store.load_graph(spark, path)
    rows = back.memory.select("sample_id", F.col("memory_id").alias("id"), F.lit("memory").alias("kind")).unionByName(back.entity.select("sample_id", F.col("entity_id").alias("id"), F.lit("entity").alias("kind")))
    one = store.load_graph(spark, path, "5").memory.select("sample_id", F.col("memory_id").alias("id"), F.lit("memory of one").alias("kind"))
    return rows.unionByName(back.memory_edge.select("sample_id", F.col("edge_id").alias("id"), F.lit("edge").alias("kind"))).unionByName(one)


def graph_streamed(spark, sf_dir):
    """The graph of all conversations, fed as a stream in two parts that cut each of them in the middle."""
    source, out, d = _place(spark), _place(spark), C.dialog(spark, sf_dir)
    partitions = d.count() // TURNS_OF_A_STORE + 8
    for part in (d.where("pos < 4"), d.where("pos >= 3")):  # one turn comes twice
        part.write.mode("append").parquet(source)
        incremental.feed(spark.readStream.schema(DIALOG).parquet(source), out, partitions=partitions)
    g, none = incremental.load(spark, out), F.lit("").alias("detail")
    rows = g.memory.select("sample_id", F.col("memory_id").alias("id"), F.lit("memory").alias("kind"), none).unionByName(g.memory_edge.select("sample_id", F.col("edge_id").alias("id"), F.col("edge_type").alias("kind"), none))
    rows = rows.unionByName(g.mention.select("sample_id", F.col("edge_id").alias("id"), F.lit("mention").alias("kind"), none))
    return rows.unionByName(g.entity.select("sample_id", F.col("entity_id").alias("id"), F.lit("entity").alias("kind"), F.concat_ws("/", "type", F.size("merged_from"), "value").alias("detail")))


def entity_types(spark, sf_dir):
    given = [(v,) for v in (" Who ", "who", "How much", "", "Where", "Thing", None)]
    rows = spark.createDataFrame(given, "raw string").unionByName(C.load(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, " When ").otherwise(F.col("event_type")).alias("raw")))
    return rows.select("raw", X.entity_type("raw").alias("type"))


def time_words_found(spark, sf_dir):
    """The known phrases in every turn, with a phrase put before it."""
    said = F.element_at(F.array(*map(F.lit, (*(p.upper() for p in X.TIME_PHRASES[:5]), "last  week", "tomorrows", "next month and a year ago"))), (F.col("pos") % 8 + 1).cast("int"))
    t = C.dialog(spark, sf_dir).withColumn("said", F.concat(said, F.lit(", "), "text"))
    return t.select("sample_id", "dia_id", F.array_join(X.time_words("said"), ",").alias("phrases"))


def normalized_turns(spark, sf_dir):
    """Every turn, with words put before it that stand for people and days."""
    put = F.element_at(F.array(*map(F.lit, ("I saw you yesterday: ", "My own, and yours. ", "Tell me last monday: ", "YOU and myself, "))), (F.col("pos") % 4 + 1).cast("int"))
    t = C.dialog(spark, sf_dir).withColumn("text", F.concat(put, "text"))
    return G.turns(t).select("sample_id", "dia_id", X.digest("text_normalized").alias("digest"))


def extraction_prompts(spark, sf_dir):
    return C.dialog(spark, sf_dir).select("sample_id", "dia_id", X.digest(X.extraction_prompt(X.extraction_text("text", F.lit(" a hat "), F.lit("cap")))).alias("digest"))


def entities_cleaned(spark, sf_dir):
    """The words of every turn as items, every third upper case and of no legal type now and then."""
    words = F.split("text", r"[ \n\t]+")
    kind = lambda i: F.element_at(F.array(*map(F.lit, ("What", "Who", "Thing", "When", " Where "))), (i % 5 + 1).cast("int"))
    items = F.transform(words, lambda w, i: F.struct(F.when(i % 3 == 0, F.translate(w, LOW, LOW.upper())).otherwise(w).alias("value"), kind(i).alias("type")))
    shown = extract.cleaned(C.dialog(spark, sf_dir).withColumn("items", items))
    listed = F.transform("items", lambda x: F.concat_ws("/", x["value"], x["type"]))
    return shown.select("sample_id", "dia_id", F.size("items").alias("n"), X.digest(F.array_join(listed, ";")).alias("digest"))


class _Client:
    """A stub of a text model: names the long tokens of a turn as JSON, in odd dress; its first answer to some is junk."""

    def __init__(self):
        self.asked: set[str] = set()

    def __call__(self, prompt: str, tokens: int = 0, temperature: float = 0.0) -> str:
        turn = prompt.split("Turn: ", 1)[1]
        if len(turn) % 3 == 0 and prompt not in self.asked:
            self.asked.add(prompt)
            return "let me think"
        if len(turn) % 11 == 5:
            return "I can't"
        items = [{"value": w, "type": "Who" if len(w) % 2 else "Nonsense"} for w in re.findall("[a-z]{9,}", turn)]
        return self.dressed(items, len(turn) % 7)

    @staticmethod
    def dressed(items: list[dict], dress: int) -> str:
        """Items as models give them: within fences, closed or not, as another field of an object, behind one, before an empty fence, bare."""
        body = json.dumps(items)
        if dress == 6:  # an empty list first: it counts
            return f"[]```json\n{body}\n```"
        if dress == 5 and len(items) == 1:
            return json.dumps(items[0])
        return (f"```json\n{body[:-1]},]\n```" if items else "[]", f'{{"result": {body}}}', f'{{"note": "x"}} {body}', f"{body}\n```json\n```", f"```json\n{body}", body)[dress]


def model_extraction(spark, sf_dir):
    t = C.dialog(spark, sf_dir)
    found = extract.model_extractor(_Client)(t, "text")
    return found.select("sample_id", "dia_id", F.col("items").isNull().alias("failed"), F.array_join(F.transform("items", lambda x: F.concat_ws("/", x["value"], x["type"])), ";").alias("items"))


def extraction_cache(spark, sf_dir):
    """Turns through a cached extractor, half of them and then all: how many distinct texts each run read."""
    t, out = C.dialog(spark, sf_dir), None
    run = extract.cached(extract.rule_extractor, store.entity_cache(spark, _place(spark)))
    for k, rows in enumerate((t.where("pos % 2 = 0"), t, t)):
        before = run.added
        n = run(rows, "text").select(F.sum(F.size("items"))).first()[0]
        one = spark.createDataFrame([(k, run.added - before, n)], "run int, added long, items long")
        out = one if out is None else out.unionByName(one)
    return out


def question_key_resume(spark, sf_dir):
    """The keys of all questions, taken in two runs; the second reads only what the first did not."""
    q, path = C.questions(spark, sf_dir), _place(spark)
    n1 = jobs.question_keys(q.where("qa = 1"), path)[1]
    keys, n2, failed = jobs.question_keys(q, path)
    return keys.select(*Q, "qkey", F.lit(n1).cast("long").alias("first_run"), F.lit(n2).cast("long").alias("second_run"), F.lit(failed).cast("long").alias("failed"))


def build_resume(spark, sf_dir):
    """A build that ends after 100 memories, and one that goes on: mentions, and whether a sample was partial after the first."""
    data, out = conversation_files(spark, sf_dir), _place(spark)
    jobs.build_graphs(spark, data, out, most=100)
    first = scratch.settle(spark.read.parquet(f"{out}/stats"))
    whole = jobs.build_graphs(spark, data, out, resume=True)
    last = spark.read.parquet(f"{out}/stats").select("sample_id", F.col("partial").alias("partial_at_last"))
    return whole.mention.select("sample_id", "entity_id", "memory_id").join(last, "sample_id").join(first.select("sample_id", (F.col("mentions") >= 0).alias("seen")), "sample_id")


def index_reuse(spark, sf_dir):
    """An index built, built again, built anew after some texts have changed, and by a cache alone: texts embedded, rows, distinct digests."""
    memory = C.graph(spark, sf_dir).memory
    changed = memory.withColumn("text_normalized", F.when(F.col("dia_id") == "D1:1", F.concat("text_normalized", F.lit(" changed"))).otherwise(F.col("text_normalized")))
    cache, path, rows = store.embedding_cache(spark, _place(spark)), _place(spark), []
    for step, of, where in ((1, memory, path), (2, memory, path), (3, changed, path), (4, memory, _place(spark))):
        index, n = jobs.build_index(of, where, cache)
        told = index.agg(F.count("*"), F.count_distinct("text_digest"), F.bool_and(F.col("model") == "hashed")).first()
        fits = dense.index_matches(index, of, "hashed").agg(F.bool_and("matches")).first()[0]
        rows.append((step, n, told[0], told[1], bool(told[2] and fits)))
    return spark.createDataFrame(rows, "step int, embedded long, n_rows long, n_digests long, fits boolean")


def question_embeddings(spark, sf_dir):
    """Distinct questions by an encoder with a role of its own for them, and by one without."""
    q = C.questions(spark, sf_dir).select(*Q, "question")
    cache, out = store.embedding_cache(spark, _place(spark)), None
    for encoder in (dense.Encoder("plain"), dense.dual_encoder("dual", _letters, _letters, len(LETTERS))):
        jobs.embed_questions(q, cache, encoder)
        out = cache.read()
    return out.select("text_digest", "model", "role", "dim")


LETTERS = "aeinorst"
LOW = "abcdefghijklmnopqrstuvwxyz"


def _letters(texts: list[str], role: str = "context") -> np.ndarray:
    """A stub of a dual encoder: how often some letters stand in a text, and one."""
    return np.array([[t.count(c) + 1 for c in LETTERS] for t in texts], np.float32)


def f1_summary(spark, sf_dir):
    t = C.dialog(spark, sf_dir)
    pair = t.select(F.col("text").alias("gold"), F.lead("text").over(W.partitionBy("sample_id").orderBy("pos")).alias("said"), (F.col("pos") % 5 + 1).cast("int").alias("category")).where("said is not null")
    return E.f1_rollup(pair.select("category", M.token_f1("gold", "said").alias("token_f1")))


def _told(spark, sf_dir):
    """(sample_id, observation, session_summary): each turn as an item of its speaker, as a pair, an object or plain text in turn, and
    a summary of each session, blank for the first."""
    t = C.dialog(spark, sf_dir)
    plain = F.to_json(F.array("text"))
    item = F.when(F.col("pos") % 3 == 0, F.to_json(F.array("text", "dia_id"))).when(F.col("pos") % 3 == 1, F.to_json(F.struct("text", "dia_id"))).otherwise(F.expr("substring(j, 2, length(j) - 2)"))
    each = t.withColumn("j", plain).groupBy("sample_id", (F.floor(F.col("pos") / 4) + 1).alias("n"), "speaker").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("i")))).alias("l"))
    by_speaker = F.concat(F.lit('"'), "speaker", F.lit('": ['), F.array_join(F.transform("l", lambda x: x["i"]), ", "), F.lit("]"))
    session = each.groupBy("sample_id", "n").agg(F.array_join(F.array_sort(F.collect_list(by_speaker)), ", ").alias("s"))
    name = F.concat(F.lit('"session_'), "n", F.lit('": '))
    summary = F.concat(name, F.when(F.col("n") == 1, '"  "').otherwise(F.concat(F.lit('"They met for time '), "n", F.lit('. "'))))
    whole = session.groupBy("sample_id").agg(F.array_join(F.collect_list(F.concat(name, F.lit("{"), "s", F.lit("}"))), ", ").alias("o"), F.array_join(F.collect_list(summary), ", ").alias("y"))
    return whole.select("sample_id", F.concat(F.lit("{"), "o", F.lit("}")).alias("observation"), F.concat(F.lit("{"), "y", F.lit("}")).alias("session_summary"))


def unit_rows(spark, sf_dir):
    rows = _told(spark, sf_dir)
    both = units.observations(rows).unionByName(units.summaries(rows))
    return both.select("sample_id", "unit_id", X.digest("text").alias("digest"), F.array_join("dia_ids", ",").alias("dia_ids"))


def _by_length(texts: list[str], role: str = "context") -> np.ndarray:
    """A stub of an encoder: texts are alike if their lengths agree modulo 8."""
    return np.eye(8, dtype=np.float32)[[len(t) % 8 for t in texts]]


def unit_answers(spark, sf_dir):
    """Questions answered from the three best observations, with hits on their gold."""
    rows = jobs.run_units(C.questions(spark, sf_dir).drop("qvec"), _told(spark, sf_dir), "observation", 3, model="length", embedder=_by_length)[0]
    return rows.select(*Q, "category", X.digest("prediction").alias("prediction_digest"), "token_f1", "hit")


def unit_f1(spark, sf_dir):
    return jobs.run_units(C.questions(spark, sf_dir).drop("qvec"), _told(spark, sf_dir), "summary", 2, model="length", embedder=_by_length)[1]


def source_hit_rate(spark, sf_dir):
    """Units of two turns; a question's gold is the turn after it, and every fourth has none."""
    q, v = C.questions(spark, sf_dir), C.vectors(spark, sf_dir)
    n = (F.substring("memory_id", 11, 9).cast("int") / 2).cast("int")
    u = v.groupBy("sample_id", n.alias("n")).agg(F.min("memory_id").alias("unit_id"), F.min_by("vec", "memory_id").alias("vec"), F.sort_array(F.collect_list(F.substring("memory_id", 8, 12))).alias("dia_ids"))
    top = units.top_units(q.select(*Q, M.unit(F.col("qvec")).alias("qvec")), u.select("sample_id", "unit_id", M.unit(F.col("vec")).alias("vec")), 1)
    asked = q.withColumn("evidence", F.when(F.col("qa") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("evidence")))
    return units.source_hit_rate(units.source_hits(top, u, asked))


def write_up_gates(spark, sf_dir):
    p = C.load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 50 == 0, None).otherwise(38 + F.col("p_retailprice") % 7).alias("f1"))
    return p.select("p_partkey", E.write_up_gate(F.round("f1", 1)).alias("gate"))


def unit_gates(spark, sf_dir):
    p = C.load(spark, sf_dir, "part")
    rows = p.groupBy(F.col("p_brand").alias("variant")).agg(F.round(F.avg(F.col("p_retailprice") % 97), 4).alias("token_f1_pct"))
    low = E.unit_gate(rows.withColumn("token_f1_pct", F.col("token_f1_pct") / 2)).withColumn("scale", F.lit("half"))
    return E.unit_gate(rows).withColumn("scale", F.lit("whole")).unionByName(low).unionByName(E.unit_gate(rows.limit(0)).withColumn("scale", F.lit("none")))


def memories_only(spark, sf_dir):
    """Memories and their sequence, of turns that repeat ids: the last stands."""
    t = C.dialog(spark, sf_dir)
    again = t.where("pos % 3 = 1").withColumns({"text": F.concat(F.lit("again "), "text"), "pos": F.col("pos") + 100})
    g = G.build_memories_only(t.unionByName(again))
    edge = g.memory_edge.groupBy("sample_id", F.col("src_memory_id").alias("memory_id")).agg(F.count("*").alias("n_edges"))
    none = g.entity.agg(F.count("*").alias("n_entities"))  # one row
    return g.memory.select("sample_id", "memory_id", X.digest("text").alias("digest")).join(edge, ["sample_id", "memory_id"], "left").crossJoin(F.broadcast(none))


def _frozen(spark, sf_dir):
    """Questions of which many share their text (and only the last of them has the right gold), and predictions with their contexts."""
    q = C.questions(spark, sf_dir).select("sample_id", "qa", F.concat(F.lit("q"), F.col("qa") % 2).alias("question"), "answer", "evidence", "category")
    ids = F.transform(F.sequence(F.lit(0), (F.col("qa") * 2) % 7 + 1), lambda i: F.concat(F.lit("D1:"), i))
    return q, q.select("sample_id", "question", F.concat(F.lit("said "), "answer").alias("prediction"), F.when(F.col("qa") % 5 == 4, F.array().cast("array<string>")).otherwise(ids).alias("ids"), "qa")


def frozen_scores(spark, sf_dir):
    q, p = _frozen(spark, sf_dir)
    return jobs.score_frozen(p.drop("qa"), q)[1]


def frozen_f1(spark, sf_dir):
    q, p = _frozen(spark, sf_dir)
    return jobs.score_frozen(p.drop("qa"), q)[0]


def paper_table(spark, sf_dir):
    """The comparison table of the frozen predictions with themselves."""
    rolled = scratch.settle(frozen_scores(spark, sf_dir))
    return E.comparison_table(spark, rolled, rolled)


def retrieved_lists(spark, sf_dir):
    found = jobs.retrieve_all(*C._parts(spark, sf_dir))
    return found.select(*Q, "category", "n_evidence", F.array_join("ids", ",").alias("ids"))


def variant_answers(spark, sf_dir):
    """Variant B from retrieval to scores, with the offline reader."""
    rows = jobs.run_variant(*C._parts(spark, sf_dir), R.VARIANTS[1])
    return rows.select(*Q, "category", "k", F.round("recall_acc", 6).alias("recall_acc"), "hit", "token_f1", X.digest("prediction").alias("prediction_digest"), F.size("context_ids").alias("n_context"))


class _Reader:
    """A stub of a reader: the first word of the prompt, but nothing until it may use 1,024 tokens."""

    def __call__(self, prompt: str, tokens: int = 512, temperature: float = 1.0) -> str:
        return prompt.split()[0] if tokens >= 1024 and temperature == 0 else " "


def answers_again(spark, sf_dir):
    """Answers from frozen contexts: questions share texts, some have no context, some are answered already."""
    q = C.questions(spark, sf_dir).select(*Q, F.concat(F.lit("q"), F.col("qa") % 3).alias("question"), "category", F.concat(F.lit("Turn "), "answer").alias("answer"), F.when(F.col("qa") % 4 > 0, F.concat(F.lit("Turn "), F.col("qa"))).alias("context"))
    kept = q.where("question = 'q2'").select("sample_id", "question", F.when(F.pmod(F.col("sample_id").cast("int"), F.lit(2)) == 0, "kept").otherwise(" ").alias("prediction"), F.lit(0.25).alias("token_f1")).distinct()
    return jobs.answer_again(q, _Reader, kept).select(*Q, "prediction", "token_f1", "gate")


def report_lines(spark, sf_dir):
    """A rollup as a Markdown table, line by line."""
    rolled = f1_summary(spark, sf_dir).orderBy("category")
    lines = store.report_markdown(rolled).split("\n")
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")


# ------------------------------------------------------------------ the same in SQL

_D = C._with
_S = "SELECT sample_id, conv_id, pos // 4 + 1 AS session, 'D' || (pos // 4 + 1) || ':' || (pos % 4 + 1) AS d, 'memory:D' || (pos // 4 + 1) || ':' || (pos % 4 + 1) AS memory_id, pos, speaker, text, date_time FROM t"
_FOUND = C.CTE["found"].replace("FROM t ", "FROM s ").replace("tok.sample_id = t.sample_id AND tok.memory_id = t.memory_id", "tok.sample_id = s.sample_id AND tok.memory_id = s.memory_id").replace("lower(t.speaker)", "lower(s.speaker)")
_TOK = C.CTE["tok"].replace("FROM t)", "FROM s)")
_PHRASES = (*(p.upper() for p in X.TIME_PHRASES[:5]), "last  week", "tomorrows", "next month and a year ago")
_KEYS = f"SELECT sample_id, qa, qkey FROM (SELECT sample_id, qa, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS qkey FROM q) WHERE length(qkey) >= {C.LEAST} OR regexp_full_match(qkey, '(19|20)[0-9]{{2}}') GROUP BY ALL"
_VALUE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '''s$', '', 'i'), '^[ .,;:!?\"'']+|[ .,;:!?\"'']+$', '', 'g')".replace('\\"', '"')
_TEXT = r"regexp_replace(text || ' ' || text || ' ' || speaker || '  ', '^\s+|\s+$', '', 'g')"
_ROLLUP = "count(*) AS n, round(100 * avg(recall), 2) AS recall_acc, round(100 * avg(hit::INT::DOUBLE), 2) AS hit_rate, round(100 * avg(round(f1, 4)) FILTER (WHERE k = 25), 2) AS token_f1_pct, round(100 * avg(round(f1, 4)) FILTER (WHERE k = 25 AND category <> 5), 2) AS token_f1_excl5_pct"
_FROZEN = {
    "asked": "SELECT sample_id, qa, 'q' || (qa % 2) AS question, question AS answer, gold, category FROM q",
    "golds": "SELECT sample_id, question, arg_max(answer, qa) AS answer, arg_max(gold, qa) AS gold, arg_max(category, qa) AS category FROM asked GROUP BY ALL",
    "rows": "SELECT a.sample_id, a.qa, g.category, g.gold, 'said ' || a.answer AS prediction, g.answer, list_transform(range(0, (a.qa * 2) % 7 + 2), lambda i: 'D1:' || i) AS ids FROM asked a JOIN golds g USING (sample_id, question) WHERE a.qa % 5 <> 4",
    "pairs": "SELECT *, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS g, list_distinct(regexp_extract_all(lower(prediction), '[a-z0-9]+')) AS p FROM rows",
    "scored": f"SELECT *, {C._F1} AS f1 FROM pairs",
    "cut": "SELECT sample_id, qa, category, k, list_contains(ids[1:k], gold)::INT::DOUBLE AS recall, list_contains(ids[1:k], gold) AS hit, f1 FROM scored, (SELECT unnest([5, 10, 25]) AS k)",
    "rolled": f"SELECT k, category, {_ROLLUP} FROM cut GROUP BY GROUPING SETS ((k), (k, category))",
}
_F1ROLL = "category, count(*) AS n, round(100 * avg(round(f1, 4)), 2) AS token_f1_pct, round(100 * avg(round(f1, 4)) FILTER (WHERE category <> 5), 2) AS excl5_pct"
_SUMMARY = {
    "pairs": "SELECT (pos % 5 + 1)::INT AS category, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS g, list_distinct(regexp_extract_all(lower(said), '[a-z0-9]+')) AS p FROM (SELECT *, lead(text) OVER (PARTITION BY sample_id ORDER BY pos) AS said FROM t) WHERE said IS NOT NULL",
    "scored": f"SELECT *, {C._F1} AS f1 FROM pairs",
    "rolled": f"SELECT {_F1ROLL} FROM scored GROUP BY GROUPING SETS ((), (category))",
}
_GATE = "CASE WHEN {0} IS NULL THEN 'incomplete' WHEN {0} > 46.18 THEN 'worth_self_build_obs' ELSE 'stop_p3_main_spend' END"


_UNITS = r"SELECT * FROM (SELECT sample_id, 'obs::session_' || (pos // 4 + 1) || '::' || speaker || '::' || (row_number() OVER (PARTITION BY sample_id, pos // 4, speaker ORDER BY pos) - 1) AS unit_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, CASE WHEN pos % 3 < 2 THEN dia_id ELSE '' END AS dia_ids FROM t) WHERE text <> ''"


def _unit_ctes(rows: str, k: int) -> dict[str, str]:
    """Questions answered from the k units whose texts have a length that agrees with theirs modulo 8."""
    return {
        "un": rows,
        "r": "SELECT q.sample_id, qa, unit_id, text, dia_ids, gold, row_number() OVER (PARTITION BY q.sample_id, qa ORDER BY length(question) % 8 <> length(text) % 8, unit_id) AS rank FROM q JOIN un ON q.sample_id = un.sample_id",
        "said": f"SELECT q.sample_id, q.qa, q.category, q.question AS answer, CASE WHEN count(rank) > 0 THEN bool_or(dia_ids = q.gold) ELSE false END AS hit, coalesce(trim(substr(split_part(max(text) FILTER (WHERE rank = 1), chr(10), 1), 1, 200)), {C._quoted(X.NO_CONTEXT)}) AS prediction FROM q LEFT JOIN (SELECT * FROM r WHERE rank <= {k}) x USING (sample_id, qa) GROUP BY ALL",
        "pairs": "SELECT *, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS g, list_distinct(regexp_extract_all(lower(prediction), '[a-z0-9]+')) AS p FROM said",
        "scored": f"SELECT *, {C._F1} AS f1 FROM pairs",
    }


def _normal_sql() -> str:
    put = "CASE pos % 4 WHEN 0 THEN 'I saw you yesterday: ' WHEN 1 THEN 'My own, and yours. ' WHEN 2 THEN 'Tell me last monday: ' ELSE 'YOU and myself, ' END || text"
    spoken = C._spoken_sql().replace("previous", "prev")
    days = {p: "8 May 2023" for p in ("today", "this morning", "this afternoon", "this evening")} | {"yesterday": "7 May 2023", "tomorrow": "9 May 2023", "last week": "1 May 2023", "last weekend": "1 May 2023", "last month": "8 April 2023", "next month": "8 June 2023", "a year ago": "8 May 2022", "one year ago": "8 May 2022"}
    days |= {f"last {d}": f"{i + 1} May 2023" for i, d in enumerate(X.WEEKDAYS)}
    out = "spoken"
    for p in sorted(days, key=lambda p: (-len(p), p)):
        out = f"regexp_replace({out}, '\\b{p}\\b', '{days[p]}', 'gi')"
    return _D(["t"], f"SELECT sample_id, dia_id, substr(sha256({out}), 1, 32) AS digest FROM x", w=f"SELECT *, {put} AS raw, last_value(nullif(trim(speaker), '') IGNORE NULLS) OVER (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t", x=f"SELECT *, {spoken} AS spoken FROM w")


SQL = {
    "source_dialogs": _D(["t"], "SELECT sample_id, session::INT AS session_num, date_time, d AS dia_id, speaker, substr(sha256(text), 1, 32) AS text_digest, 'u' AS img_url, CASE WHEN pos % 5 = 0 THEN 'a cat' ELSE '' END AS blip_caption FROM s", s=_S),
    "source_session": _D(["t"], "SELECT sample_id, session::INT AS session_num, d AS dia_id, speaker, substr(sha256(text), 1, 32) AS text_digest FROM s WHERE conv_id = 3 AND session = 2", s=_S),
    "source_questions": _D(["t"], "SELECT * FROM (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY pos)::INT AS qa, CASE WHEN speaker = 'user' THEN substr(sha256(text), 1, 32) END AS question_digest, pos::VARCHAR AS answer, d AS evidence, (pos % 5 + 1)::INT AS category FROM s) WHERE question_digest IS NOT NULL", s=_S.replace("text,", "text,")),
    "source_graph": _D(["t"], "SELECT sample_id, memory_id, session::INT AS session_num, speaker, last_value(nullif(trim(speaker), '') IGNORE NULLS) OVER (PARTITION BY sample_id, session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_speaker FROM s", s=_S),
    "graph_json_roundtrip": _D(["t", "tok", "found", "mention"], "SELECT sample_id, 'edge:' || entity_id || '->' || memory_id AS edge_id, entity_id, memory_id, 1.0::DOUBLE AS weight, substr(memory_id, 8) AS dia_id FROM mention"),
    "graph_streamed": _D(["t", "tok", "found", "entity", "mention"], "SELECT sample_id, memory_id AS id, 'memory' AS kind, '' AS detail FROM t UNION ALL SELECT sample_id, 'medge:next:' || memory_id || '->' || m2, 'next', '' FROM e WHERE m2 IS NOT NULL UNION ALL SELECT sample_id, 'medge:prev:' || m2 || '->' || memory_id, 'prev', '' FROM e WHERE m2 IS NOT NULL UNION ALL SELECT sample_id, 'edge:' || entity_id || '->' || memory_id, 'mention', '' FROM mention UNION ALL SELECT e.sample_id, entity_id, 'entity', e.type || '/' || count(DISTINCT f.value) || '/' || e.value FROM entity e JOIN found f ON e.sample_id = f.sample_id AND e.key = f.key GROUP BY e.sample_id, entity_id, e.type, e.value", e="SELECT *, lead(memory_id) OVER (PARTITION BY sample_id ORDER BY pos) AS m2 FROM t"),
    "graph_store_roundtrip": _D(["t", "tok", "found", "entity"], "SELECT sample_id, memory_id AS id, 'memory' AS kind FROM t UNION ALL SELECT sample_id, entity_id, 'entity' FROM entity UNION ALL SELECT sample_id, 'medge:next:' || memory_id || '->' || m2, 'edge' FROM e WHERE m2 IS NOT NULL UNION ALL SELECT sample_id, 'medge:prev:' || m2 || '->' || memory_id, 'edge' FROM e WHERE m2 IS NOT NULL UNION ALL SELECT sample_id, memory_id, 'memory of one' FROM t WHERE conv_id = 5", e="SELECT *, lead(memory_id) OVER (PARTITION BY sample_id ORDER BY pos) AS m2 FROM t"),
    "entity_types": "SELECT raw, CASE WHEN trim(raw) IN ('Who', 'What', 'When', 'Where', 'Why', 'How', 'How much') THEN trim(raw) END AS type FROM (SELECT unnest([' Who ', 'who', 'How much', '', 'Where', 'Thing', NULL]) AS raw UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN ' When ' ELSE event_type END FROM events)",
    "time_words_found": _D(["t"], "SELECT sample_id, dia_id, array_to_string(list_filter([" + ", ".join(map(repr, X.TIME_PHRASES)) + "], lambda p: regexp_matches(said, '\\b' || p || '\\b')), ',') AS phrases FROM (SELECT *, lower(([" + ", ".join(map(repr, _PHRASES)) + "])[pos % 8 + 1] || ', ' || text) AS said FROM t)"),
    "normalized_turns": _normal_sql(),
    "extraction_prompts": _D(["t"], f"SELECT sample_id, dia_id, substr(sha256(replace({C._quoted(X.EXTRACTION_PROMPT)}, '{{text}}', trim(concat_ws(' ', nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ''), '[Image: a hat]')))), 1, 32) AS digest FROM t"),
    "entities_cleaned": _D(
        ["t"], "SELECT t.sample_id, t.dia_id, coalesce(n, 0)::INT AS n, substr(sha256(coalesce(l, '')), 1, 32) AS digest FROM t LEFT JOIN l USING (sample_id, dia_id)",
        w=r"SELECT sample_id, dia_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM (SELECT *, regexp_split_to_array(text, '[ \n\t]+') AS ws FROM t)",
        v=f"SELECT sample_id, dia_id, i, {_VALUE.format(f"CASE WHEN i % 3 = 0 THEN translate(w, '{LOW}', '{LOW.upper()}') ELSE w END")} AS value, (['What', 'Who', NULL, 'When', 'Where'])[i % 5 + 1] AS type FROM w",
        k="SELECT *, row_number() OVER (PARTITION BY sample_id, dia_id, lower(value) ORDER BY length(value) DESC, i) AS r FROM v WHERE value <> '' AND type IS NOT NULL",
        l="SELECT sample_id, dia_id, count(*) AS n, string_agg(value || '/' || type, ';' ORDER BY type <> 'Who', length(value) DESC, lower(value)) AS l FROM k WHERE r = 1 GROUP BY ALL",
    ),
    "model_extraction": _D(["t"], "SELECT sample_id, dia_id, length(text) % 11 = 5 AS failed, CASE WHEN length(text) % 11 <> 5 THEN array_to_string(list_transform(CASE WHEN length(text) % 7 = 6 THEN [] ELSE regexp_extract_all(text, '[a-z]{9,}') END, lambda w: w || '/' || CASE WHEN length(w) % 2 = 1 THEN 'Who' ELSE 'What' END), ';') END AS items FROM t"),
    "extraction_cache": _D(["t"], "SELECT 0::INT AS run, (SELECT count(DISTINCT text) FROM t WHERE pos % 2 = 0) AS added, (SELECT sum(n) FROM n WHERE pos % 2 = 0)::BIGINT AS items UNION ALL SELECT 1, (SELECT count(DISTINCT text) FROM t) - (SELECT count(DISTINCT text) FROM t WHERE pos % 2 = 0), (SELECT sum(n) FROM n)::BIGINT UNION ALL SELECT 2, 0, (SELECT sum(n) FROM n)::BIGINT", n=f"SELECT pos, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) >= {C.LEAST} OR regexp_full_match(x, '(19|20)[0-9]{{2}}'))) AS n FROM t"),
    "question_key_resume": _D(["t", "q"], "SELECT *, (SELECT count(*) FROM q WHERE qa = 1 AND trim(question) <> '') AS first_run, (SELECT count(*) FROM q WHERE qa <> 1 AND trim(question) <> '') AS second_run, 0::BIGINT AS failed FROM k", k=_KEYS),
    "build_resume": _D(["t"], "SELECT DISTINCT sample_id, 'entity:' || key AS entity_id, memory_id, false AS partial_at_last, true AS seen FROM found", s=_S, tok=_TOK, found=_FOUND),
    "index_reuse": _D(["t"], "SELECT 1::INT AS step, n AS embedded, m AS n_rows, n AS n_digests, true AS fits FROM a UNION ALL SELECT 2, 0, m, n, true FROM a UNION ALL SELECT 3, new, m, n2, true FROM a, b UNION ALL SELECT 4, 0, m, n, true FROM a", d=f"SELECT {_TEXT} AS old, CASE WHEN pos = 1 THEN regexp_replace(text || ' changed ' || text || ' ' || speaker || '  ', '^\\s+|\\s+$', '', 'g') ELSE {_TEXT} END AS new FROM t", a="SELECT count(DISTINCT old) AS n, count(*) AS m FROM d", b="SELECT count(DISTINCT new) AS n2, count(DISTINCT new) FILTER (WHERE new NOT IN (SELECT old FROM d)) AS new FROM d"),
    "question_embeddings": _D(["t", "q"], "SELECT DISTINCT substr(sha256(question), 1, 32) AS text_digest, unnest(['plain', 'dual']) AS model, unnest(['context', 'query']) AS role, unnest([64, 8])::INT AS dim FROM q"),
    "f1_summary": _D(["t"], "SELECT * FROM rolled", **_SUMMARY),
    "source_hit_rate": _D(
        ["t", "q", "vec"], "SELECT count(*) AS n, round(avg(hit::INT::DOUBLE), 4) AS hit_rate FROM (SELECT *, list_contains(ids, gold) AS hit FROM r WHERE k = 1 AND qa % 4 <> 0)",
        u="SELECT sample_id, conv_id, pos // 2 AS n, min(memory_id) AS unit_id, arg_min(pos, memory_id) AS pos, list(dia_id) AS ids FROM t GROUP BY ALL",
        r="SELECT *, row_number() OVER (PARTITION BY sample_id, qa ORDER BY s DESC, unit_id) AS k FROM (SELECT q.sample_id, qa, q.gold, ids, unit_id, round(list_dot_product(a.v, b.v), 9) AS s FROM q JOIN u ON u.sample_id = q.sample_id JOIN vec a ON a.vec_id = (q.conv_id * 8 + q.pos + 1) % a.n JOIN vec b ON b.vec_id = (u.conv_id * 8 + u.pos) % b.n)",
    ),
    "unit_rows": _D(["t"], "SELECT sample_id, unit_id, substr(sha256(text), 1, 32) AS digest, dia_ids FROM u UNION ALL SELECT sample_id, 'sum::session_' || n, substr(sha256('They met for time ' || n || '.'), 1, 32), '' FROM (SELECT DISTINCT sample_id, pos // 4 + 1 AS n FROM t) WHERE n > 1", u=_UNITS),
    "unit_answers": _D(["t", "q"], "SELECT sample_id, qa, category, substr(sha256(prediction), 1, 32) AS prediction_digest, round(f1, 4) AS token_f1, hit FROM scored", u=_UNITS, **_unit_ctes("SELECT * FROM u", 3)),
    "unit_f1": _D(["t", "q"], f"SELECT {_F1ROLL} FROM scored GROUP BY GROUPING SETS ((), (category))", **_unit_ctes("SELECT DISTINCT sample_id, 'sum::session_' || (pos // 4 + 1) AS unit_id, 'They met for time ' || (pos // 4 + 1) || '.' AS text, '' AS dia_ids FROM t WHERE pos >= 4", 2)),
    "write_up_gates": "SELECT p_partkey, CASE WHEN f1 IS NULL THEN 'incomplete' WHEN round(f1, 1) >= 43 THEN 'full_writeup' WHEN round(f1, 1) >= 41 THEN 'parity_claim_only' ELSE 'stop_large_compare' END AS gate FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 <> 0 THEN 38 + p_retailprice % 7 END AS f1 FROM part)",
    "unit_gates": "WITH r AS (SELECT p_brand AS variant, round(avg(p_retailprice % 97), 4) AS f FROM part GROUP BY 1), x AS (SELECT 'whole' AS scale, variant, f FROM r UNION ALL SELECT 'half', variant, f / 2 FROM r), b AS (SELECT scale, arg_max(variant, f) AS best, max(f) AS best_f1 FROM x GROUP BY 1 UNION ALL SELECT 'none', NULL, NULL) SELECT *, " + _GATE.format("best_f1") + " AS gate FROM b",
    "memories_only": _D(["t"], "SELECT sample_id, memory_id, substr(sha256(CASE WHEN pos % 3 = 1 THEN 'again ' || text ELSE text END), 1, 32) AS digest, nullif((pos > min(pos) OVER w)::INT + (pos < max(pos) OVER w)::INT, 0)::BIGINT AS n_edges, 0::BIGINT AS n_entities FROM t WINDOW w AS (PARTITION BY sample_id)"),
    "frozen_scores": _D(["t", "q"], "SELECT * FROM rolled", **_FROZEN),
    "frozen_f1": _D(["t", "q"], f"SELECT {_F1ROLL} FROM scored GROUP BY GROUPING SETS ((), (category))", **_FROZEN),
    "paper_table": _D(["t", "q"], "SELECT a.k::INT AS k, r.recall_acc, r.hit_rate, anchor_recall, anchor_f1, round(r.recall_acc - anchor_recall, 2) AS delta_pp, r.recall_acc AS frozen_recall, r.hit_rate AS frozen_hit, r.token_f1_pct AS frozen_f1 FROM (SELECT unnest([5, 10, 25, 50]) AS k, unnest([38.8, 39.7, 41.0, 40.5])::DOUBLE AS anchor_f1, unnest([56.7, 66.2, 76.7, 82.7])::DOUBLE AS anchor_recall) a LEFT JOIN (SELECT * FROM rolled WHERE category IS NULL) r USING (k)", **_FROZEN),
    "retrieved_lists": _D(C.FUSED, "SELECT q.sample_id, q.qa, q.category, 1::INT AS n_evidence, string_agg(dia_id, ',' ORDER BY rank) AS ids FROM q LEFT JOIN top USING (sample_id, qa) GROUP BY q.sample_id, q.qa, q.category", **C.FUSED_POOL, top=C._ranked("pool", 50)),
    "variant_answers": _D(
        C.FUSED, "SELECT sample_id, qa, category, k, coalesce(list_contains(ids[1:k], gold), false)::INT::DOUBLE AS recall_acc, coalesce(list_contains(ids[1:k], gold), false) AS hit, round(f1, 4) AS token_f1, substr(sha256(prediction), 1, 32) AS prediction_digest, n_context::INT AS n_context FROM scored, (SELECT unnest([5, 10, 25, 50]) AS k)", **C.FUSED_POOL, top=C._ranked("pool", 50),
        said=f"SELECT q.sample_id, q.qa, q.category, q.gold, q.question AS answer, list(top.dia_id ORDER BY rank) FILTER (WHERE top.dia_id IS NOT NULL) AS ids, count(top.dia_id) FILTER (WHERE rank <= 25) AS n_context, coalesce(trim(substr(split_part(max(date_time || ': ' || speaker || ' said, \"' || text || '\"') FILTER (WHERE rank = 1), chr(10), 1), 1, 200)), {C._quoted(X.NO_CONTEXT)}) AS prediction FROM q LEFT JOIN top USING (sample_id, qa) LEFT JOIN t ON t.sample_id = q.sample_id AND t.dia_id = top.dia_id GROUP BY ALL",
        pairs="SELECT *, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS g, list_distinct(regexp_extract_all(lower(prediction), '[a-z0-9]+')) AS p FROM said", scored=f"SELECT *, {C._F1} AS f1 FROM pairs",
    ),
    "answers_again": _D(
        ["t", "q"], "SELECT sample_id, qa, prediction, token_f1, CASE WHEN o >= 43 THEN 'full_writeup' WHEN o >= 41 THEN 'parity_claim_only' ELSE 'stop_large_compare' END AS gate FROM z, (SELECT round(100 * avg(token_f1), 2) AS o FROM z)",
        a="SELECT sample_id, conv_id, qa, 'q' || (qa % 3) AS asked, 'Turn ' || question AS answer FROM q WHERE qa % 4 > 0",
        l="SELECT sample_id, asked, arg_max(answer, qa) AS answer FROM a GROUP BY ALL",
        pairs="SELECT *, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS g, ['turn'] AS p FROM l", scored=f"SELECT *, {C._F1} AS f1 FROM pairs",
        z="SELECT a.sample_id, qa, CASE WHEN asked = 'q2' AND conv_id % 2 = 0 THEN 'kept' ELSE 'Turn' END AS prediction, CASE WHEN asked = 'q2' AND conv_id % 2 = 0 THEN 0.25 ELSE round(f1, 4) END AS token_f1 FROM a JOIN scored USING (sample_id, asked)",
    ),
    "report_lines": _D(["t"], "SELECT 0::INT AS i, '| category | n | token_f1_pct | excl5_pct |' AS line UNION ALL SELECT 1, '|---|---|---|---|' UNION ALL SELECT (1 + row_number() OVER (ORDER BY category NULLS FIRST))::INT, '| ' || coalesce(category::VARCHAR, '') || ' | ' || n || ' | ' || coalesce(token_f1_pct::VARCHAR, '') || ' | ' || coalesce(excl5_pct::VARCHAR, '') || ' |' FROM rolled", **_SUMMARY),
    "llm_json_parse": "SELECT i::INT AS i, items, failed = 't' AS failed FROM " + C._values([("0", "Ann/Who", "f"), ("1", "Ann/Who", "f"), ("2", "Ann/What", "f"), ("3", "", "f"), ("4", "Ann/Who", "f"), ("5", "http://x/What", "f"), ("6", None, "t"), ("7", None, "t"), ("8", None, "t"), ("9", None, "t")], "i, items, failed") + " UNION ALL SELECT (p_partkey + 100)::INT, CASE p_partkey % 7 WHEN 0 THEN p_name || '/Who' WHEN 1 THEN p_name || '/What' WHEN 2 THEN p_name || '/When' WHEN 3 THEN p_name || '/Where' WHEN 4 THEN '' WHEN 5 THEN p_name || '/Why' END, p_partkey % 7 = 6 FROM part",
    "embed_memories": _D(["t"], f"SELECT DISTINCT substr(sha256({_TEXT}), 1, 32) AS text_digest, 'hashed' AS model, 'context' AS role, 64::INT AS dim, 1.0::DOUBLE AS norm FROM t"),
}

#: Those of the catalogue, which get their SQL here.
_OTHERS = ("llm_json_parse", "embed_memories")


def queries() -> dict:
    return {name: globals()[name] for name in SQL if name not in _OTHERS}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
