"""Alternative memory units: observations and session summaries, ranked by dense scores only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallery.functions import metrics as M
from recallery.functions import text as X
from recallery.operators import nearest


def observations(df: DataFrame) -> DataFrame:
    """(sample_id, unit_id, text, dia_ids) of a column ``observation`` in JSON: session -> speaker -> list of items.
    An item is [text, dia], an object with text and dia_id, or plain text; blank ones are dropped but keep their number."""
    sessions = df.select("sample_id", F.explode(F.map_entries(F.from_json("observation", "map<string,map<string,array<string>>>"))).alias("s"))
    speakers = sessions.select("sample_id", F.col("s.key").alias("session"), F.explode(F.map_entries("s.value")).alias("p"))
    items = speakers.select("sample_id", "session", F.col("p.key").alias("speaker"), F.posexplode("p.value").alias("j", "raw"))
    kind = F.substring(X.trimmed("raw"), 1, 1)
    pair = F.from_json("raw", "array<string>")
    thing = F.from_json("raw", "struct<text:string,dia_id:string>")
    text = F.when(kind == "[", F.get(pair, 0)).when(kind == "{", thing["text"]).otherwise(F.col("raw"))
    dia = F.when(kind == "[", F.get(pair, 1)).when(kind == "{", thing["dia_id"])
    read = items.select("sample_id", F.concat_ws("::", F.lit("obs"), "session", "speaker", "j").alias("unit_id"), X.trimmed(text).alias("text"), dia.alias("dia"))
    # a second field that is a list itself stays JSON
    ids = F.when(F.col("dia").startswith("["), F.from_json("dia", "array<string>")).when(~X.blank("dia"), F.array("dia")).otherwise(F.array().cast("array<string>"))
    return read.where(~X.blank("text")).select("sample_id", "unit_id", "text", ids.alias("dia_ids"))


def summaries(df: DataFrame) -> DataFrame:
    """(sample_id, unit_id, text, dia_ids) of a column ``session_summary`` in JSON: session -> text."""
    sessions = df.select("sample_id", F.explode(F.map_entries(F.from_json("session_summary", "map<string,string>"))).alias("s"))
    out = sessions.select("sample_id", F.concat(F.lit("sum::"), F.col("s.key")).alias("unit_id"), X.trimmed(F.col("s.value")).alias("text"))
    return out.where(~X.blank("text")).withColumn("dia_ids", F.array().cast("array<string>"))


def top_units(questions: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """(sample_id, qa, rank, unit_id, score): the k best by raw dot product, not clipped; ties by unit_id.
    ``questions``: sample_id, qa, qvec; ``units``: sample_id, unit_id, vec, both of length 1."""
    best = nearest.top_k(questions, units.select("sample_id", F.col("unit_id").alias("id"), "vec"), k, clip=False)
    return best.select("sample_id", "qa", F.col("id").alias("unit_id"), F.col("s").alias("score"), "rank")


def source_hit_rate(hits: DataFrame) -> DataFrame:
    """(n, hit_rate): of the questions with gold evidence, how many, and the share whose ranked units name some."""
    return hits.agg(F.count("hit").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_rate"))


def source_hits(top: DataFrame, units: DataFrame, questions: DataFrame) -> DataFrame:
    """(sample_id, qa, hit): whether a ranked unit names gold evidence; null where the question has none."""
    ids = top.join(units.select("sample_id", "unit_id", "dia_ids"), ["sample_id", "unit_id"]).groupBy("sample_id", "qa").agg(F.flatten(F.collect_list("dia_ids")).alias("ids"))
    both = questions.join(ids, ["sample_id", "qa"], "left")
    return both.select("sample_id", "qa", M.hit_at(F.col("evidence"), F.coalesce("ids", F.array().cast("array<string>")), "skip").alias("hit"))
