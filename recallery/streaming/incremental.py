"""Incremental graphs: turns come in a stream, in any split into batches, and the tables are those of one build.

Two steps, each a streaming query of its own with its checkpoint, run one after another over what is there:

1. ``turns``: keyed by sample, the last turn of each session and the last memory are state, so a turn gets its previous
   speaker and a memory the one before it from earlier batches too. State goes to Python and back with the rows, a value a sample.
2. ``found``: the entities of the new turns, by any extractor; a batch that is played again replaces its own files. What an
   entity is made of (first type, longest value, values in order) merges in any order, so ``load`` merges all batches as one build does,
   and no state is held for entities.

State lies in RocksDB beside the checkpoints. Turns of a sample come in order of session and place, those of a session that
are not behind its last one are repeats and change nothing; a memory that belongs before an earlier one stops the stream, since its edges
are out already. A batch of one sample is sorted in memory, so batches should be bounded (maxFilesPerTrigger, maxBytesPerTrigger).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recallery.functions import text as X
from recallery.operators import graph as G
from recallery.operators.extract import rule_extractor
from recallery.schema import DIALOG
from recallery.sources.ship import ship
from recallery.sources.store import exists

_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_TURN = f"{DIALOG}, previous_speaker string, fresh boolean, before string"
_FOUND = "sample_id string, dia_id string, s bigint, t bigint, pos int, i int, key string, value string, type string"


def _placed(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Turns of a sample, as JSON, with the speaker before, whether they come behind the last memory, and the memory before that. State:
    the last place and speaker of each session, and the last memory. One column each way, as every group pays for each of them."""
    turns = [json.loads(turn) for part in rows for turn in part["turn"]]
    held, last = json.loads(state.get[0]) if state.exists else ({}, None)
    out = []
    for turn in sorted(turns, key=lambda t: (t["session_num"], t["pos"])):
        number = str(turn["session_num"])
        pos, previous = held.get(number, (-1, None))
        if turn["pos"] <= pos:
            continue
        held[number] = turn["pos"], (turn.get("speaker") or "").strip() or previous
        order = [turn.pop("s"), turn.pop("t"), turn["dia_id"]]
        fresh = last is None or order > last
        out.append(json.dumps({**turn, "previous_speaker": previous, "fresh": fresh, "before": last[2] if fresh and last else None}))
        last = order if fresh else last
    state.update((json.dumps([held, last]),))
    if out:
        yield pd.DataFrame({"turn": out})


def _run(stream: DataFrame, path: str, name: str, each: Callable | None = None) -> None:
    """Process what is there: append it to the table of that name, or give each batch to a function."""
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint/{name}").trigger(availableNow=True)
    done = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", f"{path}/{name}").outputMode("append").start()
    done.awaitTermination()


def feed(dialog: DataFrame, path: str, extractor: Callable[[DataFrame, str], DataFrame] = rule_extractor, partitions: int | None = None) -> None:
    """Add the turns of a stream (``schema.DIALOG``) to the graph in ``path``; those that it has stay as they are. State lies in
    ``partitions`` parts, each a store of some hundred KB at least, from the first feed on; as many as the session shuffles to if not given."""
    spark = dialog.sparkSession
    ship(spark)
    wanted = dict([_ROCKS, ("spark.sql.shuffle.partitions", str(partitions))] if partitions else [_ROCKS])
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        session, turn, _ = X.memory_order("dia_id", F.col("session_num"))
        named = dialog.where(~X.blank("dia_id")).withColumn("dia_id", X.trimmed("dia_id")).withColumns({"s": session.cast("long"), "t": turn.cast("long")})
        said = named.select("sample_id", F.to_json(F.struct(*named.columns)).alias("turn"))
        placed = said.groupBy("sample_id").applyInPandasWithState(_placed, "turn string", "body string", "Append", GroupStateTimeout.NoTimeout)
        _run(placed.select(F.from_json("turn", _TURN).alias("turn")).select("turn.*"), path, "turns")

        def found(batch: DataFrame, number: int) -> None:
            odd = batch.where("not fresh")  # repeated ids, or memories that come too late
            if not odd.isEmpty():
                known = batch.sparkSession.read.schema(_TURN).parquet(f"{path}/turns").where("fresh").select("sample_id", "dia_id")
                late = odd.join(known, ["sample_id", "dia_id"], "left_anti").first()
                if late is not None:
                    raise ValueError(f"{late['dia_id']} of {late['sample_id']} comes after a later memory, whose edges are out already")
            rows = G.extracted(_spoken(batch), extractor)
            rows.select("sample_id", "dia_id", F.col("ord._s").alias("s"), F.col("ord._t").alias("t"), "ord.pos", F.col("ord._i").alias("i"), "key", "value", "type").write.mode("overwrite").parquet(f"{path}/found/batch={number}")

        _run(spark.readStream.schema(_TURN).parquet(f"{path}/turns"), path, "found", found)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def _spoken(turns: DataFrame) -> DataFrame:
    """Turns with their normalised text."""
    text = X.normalized("text", F.col("speaker"), F.col("previous_speaker"), F.col("date_time"), anchor=F.col("_day"))
    return turns.withColumn("_day", X.dialog_date("date_time")).withColumn("text_normalized", text).drop("_day")


def load(spark: SparkSession, path: str) -> G.Graph:
    """The graph as fed so far: memories and edges as they came, entities as they are now."""
    turns = _spoken(spark.read.schema(_TURN).parquet(f"{path}/turns").where("fresh"))
    memory = turns.select("sample_id", X.memory_id("dia_id").alias("memory_id"), "dia_id", "session_num", "date_time", "speaker", "text", "text_normalized", "query", "img_url", "blip_caption", F.create_map().cast("map<string,string>").alias("metadata"))
    edges = G.paired_edges(turns.where("before is not null").select("sample_id", X.memory_id("before").alias("memory_id"), F.col("before").alias("dia_id"), X.memory_id("dia_id").alias("m2"), F.col("dia_id").alias("d2")))
    if exists(spark, f"{path}/found"):
        rows = spark.read.schema(_FOUND).parquet(f"{path}/found/batch=*")
    else:
        rows = spark.createDataFrame([], _FOUND)
    found = rows.select("sample_id", X.memory_id("dia_id").alias("memory_id"), "dia_id", F.struct(F.col("s").alias("_s"), F.col("t").alias("_t"), "dia_id", "pos", F.col("i").alias("_i")).alias("ord"), "key", "value", "type")
    return G.Graph(memory, G.entities(found), G.mentions(found), edges)
