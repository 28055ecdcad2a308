"""Graphs from streams: any split of a conversation gives the tables of one build."""

import random

import pytest

from recallery import schema
from recallery.operators import graph as G
from recallery.streaming import incremental

rng = random.Random(4)
SAID = ["the remarkable elephants", "", "Remarkable weather in 2021", "something ELEPHANTS said yesterday", "I told you about my mountains", "fine"]


def turns():
    rows = []
    for sample in ("s1", "s2", "s3"):
        for session in (1, 2):
            for pos in range(5):
                number = 3 if (sample, pos) == ("s2", 4) else pos + 1  # a repeated dia_id
                rows.append((sample, session, "8 May 2023", pos, " " if (sample, pos) == ("s3", 2) else f"D{session}:{number}", ["Ann", "Bob", " "][rng.randrange(3)], rng.choice(SAID), "", "", "a giraffe" if pos == 3 else ""))
    return rows


def tables(g):
    out = {"memory": g.memory.drop("metadata"), "entity": g.entity.drop("metadata"), "mention": g.mention.select("sample_id", "edge_id", "entity_id", "memory_id", "metadata"), "edge": g.memory_edge}
    return {n: sorted(str(r.asDict(True)) for r in t.select(*sorted(t.columns)).collect()) for n, t in out.items()}


@pytest.mark.parametrize("cuts", [(30,), (1, 2, 13, 22)])
def test_any_split_gives_the_tables_of_one_build(spark, tmp_path, cuts):
    rows = turns()
    # in order of session within each sample, samples mixed as they come
    rows.sort(key=lambda r: (r[1], r[3], r[0]))
    whole = spark.createDataFrame(rows, schema.DIALOG)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for a, b in zip((0, *cuts), (*cuts, len(rows)), strict=True):
        if a < b:
            # the last turn before comes again with each part
            spark.createDataFrame(rows[max(a - 1, 0) : b], schema.DIALOG).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema.DIALOG).parquet(source)
            incremental.feed(stream, out)
    got = tables(incremental.load(spark, out))
    assert got == tables(G.build(whole)) and len(got["edge"]) == 2 * (len(got["memory"]) - 3)
    assert G.violations(incremental.load(spark, out)).isEmpty()
    incremental.feed(stream, out)  # nothing new
    assert tables(incremental.load(spark, out)) == got


def test_a_memory_that_comes_too_late_stops_the_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for dia in ("D2:1", "D1:1"):
        spark.createDataFrame([("s", int(dia[1]), "", 0, dia, "Ann", "hi", "", "", "")], schema.DIALOG).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema.DIALOG).parquet(source)
        if dia == "D2:1":
            incremental.feed(stream, out)
        else:
            with pytest.raises(Exception, match="edges are out already"):
                incremental.feed(stream, out)
    assert [r["dia_id"] for r in incremental.load(spark, out).memory.collect()] == ["D2:1"]


def test_state_is_a_value_a_sample_and_none_for_entities(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(turns(), schema.DIALOG).write.parquet(source)
    incremental.feed(spark.readStream.schema(schema.DIALOG).parquet(source), out, partitions=2)
    assert sorted(p.name for p in (tmp_path / "out" / "checkpoint").iterdir()) == ["found", "turns"]
    state = spark.read.format("statestore").load(f"{out}/checkpoint/turns")
    assert state.count() == 3 and not (tmp_path / "out" / "checkpoint" / "found" / "state" / "0").exists()
