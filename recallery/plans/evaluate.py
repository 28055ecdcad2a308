"""Answering and evaluation: contexts, metrics at several cut-offs, rollups, gates and comparisons."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.functions import metrics as M
from recallery.functions import text as X
from recallery.operators.clients import WINDOW, ask, in_order
from recallery.schema import KS
from recallery.sources.ship import ship

Q = ["sample_id", "qa"]

# Published anchors of the comparison, in percent: cut-off, F1, recall.
ANCHORS = ((5, 38.8, 56.7), (10, 39.7, 66.2), (25, 41.0, 76.7), (50, 40.5, 82.7))
#: The published F1 that units have to beat, and the bounds of the write-up gate.
UNIT_BAR, WRITE_UP, PARITY = 46.18, 43.0, 41.0


def contexts(ranked: DataFrame, memory: DataFrame, k: int = 25) -> DataFrame:
    """(sample_id, qa, context): the lines of the k best memories in order of rank; unknown ids are passed over."""
    known = memory.select("sample_id", "dia_id", F.concat(F.coalesce("date_time", F.lit("")), F.lit(": "), X.dialog_line("speaker", "text", "blip_caption")).alias("line"))
    lines = ranked.where(F.col("rank") <= k).select(*Q, "rank", "dia_id").join(known, ["sample_id", "dia_id"])
    listed = lines.groupBy(*Q).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return listed.select(*Q, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


def prompts(questions: DataFrame, context: DataFrame) -> DataFrame:
    return questions.join(context, Q, "left").withColumn("prompt", X.answer_prompt("question", "category", "context"))


def first_line_reader(prompt: str) -> str:
    """The offline reader: the first line of the context."""
    return prompt.split("\n", 1)[0][:200]


def answer(asked: DataFrame, make_reader: Callable[[], Callable[[str], str]] = lambda: first_line_reader, attempts: int = 4, tokens: int = 512, most_tokens: int = 2048, window: int = WINDOW) -> DataFrame:
    """With ``prediction``: the first answer that is not blank, of up to ``attempts``, each allowed twice the tokens of the one
    before. The reader is made once for each task, and up to ``window`` threads call it; tokens and temperature go to readers that take them."""

    def run(pdfs):
        reader = make_reader()

        def one(prompt: str) -> str:
            for k in range(attempts):
                said = (ask(reader, prompt, tokens=min(tokens * 2**k, most_tokens), temperature=0.0) or "").strip()
                if said:
                    return said
            return ""

        for pdf in pdfs:
            out = []
            for said, failed in in_order(one, pdf["prompt"], window):
                if failed is not None:
                    raise failed
                out.append(said)
            yield pd.DataFrame({"sample_id": pdf["sample_id"], "qa": pdf["qa"], "prediction": out})

    ship(asked.sparkSession)
    done = asked.select(*Q, "prompt").mapInPandas(run, "sample_id string, qa int, prediction string")
    return asked.join(done, Q, "left")


def pending(asked: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Questions still to answer: those without a stored answer that is not blank, has an F1 and was given for the
    same context ids. ``asked``: sample_id, qa, context_ids; ``checkpoint`` has prediction and token_f1 too."""
    valid = checkpoint.where(~X.blank("prediction") & F.col("token_f1").isNotNull()).select(*Q, "context_ids")
    return asked.join(valid, [*Q, "context_ids"], "left_anti")


def retrieved(ranked: DataFrame, k: int = 50, by: list[str] = Q) -> DataFrame:
    """(sample_id, qa, ids): the ranked dia_ids of each question as a list."""
    listed = ranked.where(F.col("rank") <= k).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "dia_id"))).alias("l"))
    return listed.select(*by, F.transform("l", lambda x: x["dia_id"]).alias("ids"))


def at_cutoffs(questions: DataFrame, found: DataFrame, ks: tuple[int, ...] = KS, empty_gold: str = "one", by: list[str] = Q) -> DataFrame:
    """(sample_id, qa, category, k, recall_acc, hit) from one ranked list for each question."""
    both = questions.join(found, by, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    each = both.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("top", F.slice("ids", F.lit(1), F.col("k")))
    out = each.select(*by, "category", "k", M.recall_at(F.col("evidence"), F.col("top"), empty_gold).alias("recall_acc"), M.hit_at(F.col("evidence"), F.col("top"), empty_gold).alias("hit"))
    return out if empty_gold == "one" else out.where("recall_acc is not null")


def rollup(rows: DataFrame, f1_at: int = 25, by: tuple[str, ...] = ()) -> DataFrame:
    """(k, category, n, recall_acc, hit_rate, token_f1_pct, token_f1_excl5_pct): for each cut-off overall
    (null category) and by category; F1 at one cut-off only. ``rows`` has token_f1. With ``by`` for each of its values."""
    out = rows.rollup(*by, "k", "category").agg(
        F.count("*").alias("n"), M.percent(F.avg("recall_acc")).alias("recall_acc"), M.percent(F.avg(F.col("hit").cast("double"))).alias("hit_rate"),
        M.percent(F.avg(F.when(F.col("k") == f1_at, F.round("token_f1", 4)))).alias("token_f1_pct"), M.percent(F.avg(F.when((F.col("k") == f1_at) & (F.col("category") != 5), F.round("token_f1", 4)))).alias("token_f1_excl5_pct"),
        F.grouping("k").alias("_g"),
    )
    return out.where("_g = 0").drop("_g")


def f1_rollup(rows: DataFrame) -> DataFrame:
    """(category, n, token_f1_pct, excl5_pct): overall (null) and by category, of rows with category and token_f1."""
    value = F.round("token_f1", 4)
    return rows.rollup("category").agg(F.count("*").alias("n"), M.percent(F.avg(value)).alias("token_f1_pct"), M.percent(F.avg(F.when(F.col("category") != 5, value))).alias("excl5_pct"))


def publish_gate(f1_a, f1_b, recall_a, recall_b):
    """What two variants' F1 and recall say about publishing."""
    better = (f1_b > f1_a) & (recall_b > recall_a)
    missing = f1_a.isNull() | f1_b.isNull() | recall_a.isNull() | recall_b.isNull()
    return F.when(missing, "incomplete").when(better, "publish_ok_method_helps").when(f1_b >= f1_a, "publish_ok_f1_non_worse").otherwise("method_weaker_on_f1_diagnose")


def write_up_gate(f1):
    return F.when(f1.isNull(), "incomplete").when(f1 >= WRITE_UP, "full_writeup").when(f1 >= PARITY, "parity_claim_only").otherwise("stop_large_compare")


def unit_gate(results: DataFrame) -> DataFrame:
    """(best, best_f1, gate) of (variant, token_f1_pct): whether the best unit variant beats the bar."""
    best = results.agg(F.max_by("variant", "token_f1_pct").alias("best"), F.max("token_f1_pct").alias("best_f1"))
    return best.withColumn("gate", F.when(F.col("best_f1").isNull(), "incomplete").when(F.col("best_f1") > UNIT_BAR, "worth_self_build_obs").otherwise("stop_p3_main_spend"))


def compare(rolled: DataFrame, a: str = "A", b: str = "B", at: int = 25) -> DataFrame:
    """One row: F1 and recall of two variants at a cut-off, their differences and the gate. ``rolled`` has variant."""
    overall = rolled.where((F.col("k") == at) & F.col("category").isNull())
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    one = overall.agg(pick(a, "token_f1_pct").alias("f1_a"), pick(b, "token_f1_pct").alias("f1_b"), pick(a, "recall_acc").alias("recall_a"), pick(b, "recall_acc").alias("recall_b"))
    return one.withColumns({"delta_f1": F.round(F.col("f1_b") - F.col("f1_a"), 2), "delta_recall": F.round(F.col("recall_b") - F.col("recall_a"), 2), "gate": publish_gate(*map(F.col, ("f1_a", "f1_b", "recall_a", "recall_b")))})


def against_anchors(spark: SparkSession, rolled: DataFrame) -> DataFrame:
    """(k, recall_acc, anchor_recall, delta_pp): overall recall at each cut-off beside the published one."""
    anchors = spark.createDataFrame(list(ANCHORS), "k int, anchor_f1 double, anchor_recall double")
    ours = rolled.where(F.col("category").isNull()).select("k", "recall_acc")
    return anchors.join(ours, "k", "left").select("k", "recall_acc", "anchor_recall", F.round(F.col("recall_acc") - F.col("anchor_recall"), 2).alias("delta_pp"))


def comparison_table(spark: SparkSession, rolled: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """(k, recall_acc, hit_rate, anchor_recall, anchor_f1, delta_pp, frozen_recall, frozen_hit, frozen_f1): each cut-off beside the
    published figures and beside frozen predictions, which hold 25 places and have their F1 there alone."""
    ours = rolled.where(F.col("category").isNull()).select("k", "hit_rate")
    out = against_anchors(spark, rolled).join(spark.createDataFrame([a[:2] for a in ANCHORS], "k int, anchor_f1 double"), "k").join(ours, "k", "left")
    held = rolled.where("false") if frozen is None else frozen
    held = held.where(F.col("category").isNull() & (F.col("k") <= 25)).select("k", F.col("recall_acc").alias("frozen_recall"), F.col("hit_rate").alias("frozen_hit"), F.col("token_f1_pct").alias("frozen_f1"))
    return out.join(held, "k", "left").select("k", "recall_acc", "hit_rate", "anchor_recall", "anchor_f1", "delta_pp", "frozen_recall", "frozen_hit", "frozen_f1")


def answer_key(sample_id, question):
    """The key by text that frozen answers use; questions with equal beginnings collapse under it."""
    return F.concat(sample_id, F.lit("::"), F.substring(question, 1, 120))


def with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows (sample_id, question, ...) with prediction and token_f1 of the answer under their key; rows that collapse
    under one key share it, and rows without one have nulls. ``answers``: sample_id, question, prediction, token_f1."""
    key = answer_key(F.col("sample_id"), F.col("question")).alias("_key")
    each = answers.select(key, "prediction", "token_f1").groupBy("_key").agg(F.min(F.struct("prediction", "token_f1")).alias("a"))
    return rows.select("*", key).join(each, "_key", "left").select(*rows.columns, "a.prediction", "a.token_f1")


def frozen(predictions: DataFrame, questions: DataFrame) -> DataFrame:
    """Frozen predictions with the gold of their question, matched by text in their sample: of repeated questions the
    last gold counts; fields that the question lacks come from the prediction. Rows: sample_id, question, prediction, ids, and
    optionally answer, evidence, category and token_f1, which is computed where it is missing."""
    gold = questions.groupBy("sample_id", "question").agg(F.max_by(F.struct("answer", "evidence", "category"), "qa").alias("g"))
    both = predictions.join(gold, ["sample_id", "question"], "left")
    have = set(predictions.columns)
    back = lambda c, kind: F.coalesce(F.col(f"g.{c}"), F.col(c)) if c in have else F.col(f"g.{c}")
    stored = F.col("token_f1") if "token_f1" in have else F.lit(None).cast("double")
    out = both.select("sample_id", "question", "prediction", "ids", back("answer", "string").alias("answer_"), back("evidence", "array").alias("evidence_"), back("category", "int").alias("category_"), stored.alias("f1_"))
    out = out.toDF("sample_id", "question", "prediction", "ids", "answer", "evidence", "category", "f1_")
    return out.withColumn("token_f1", F.coalesce("f1_", M.token_f1("answer", "prediction"))).drop("f1_")
