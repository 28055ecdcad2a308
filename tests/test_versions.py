"""Stored caches and graphs: buckets, commits, interrupted and competing writers."""

import pytest
from pyspark.sql import functions as F

from recallery.operators import graph as G
from recallery.sources import store
from recallery.sources.versions import Versions


def cache(spark, path, **how):
    return store.Cache(spark, str(path), "k string, w int, v array<int>", ["k", "w"], **how)


def rows(spark, keys):
    return spark.createDataFrame([(f"key{i}", i % 2, [i]) for i in keys], "k string, w int, v array<int>")


def test_versions(spark, tmp_path):
    one, two = Versions(spark, str(tmp_path / "v")), Versions(spark, str(tmp_path / "v"))
    assert one.latest() == (0, None) and one.folders() == []
    assert one.commit(0, {"a": 1}) and not two.commit(0, {"a": 2}) and two.latest() == (1, {"a": 1})
    assert two.commit(1, {"a": "é"}) and one.latest() == (2, {"a": "é"}) and one.manifest(1) == {"a": 1}
    assert len(list((tmp_path / "v" / "versions").glob("*.json"))) == 2


def test_cache_reads_touched_buckets_only(spark, tmp_path):
    c = cache(spark, tmp_path / "c")
    assert c.read().count() == 0 and c.add(rows(spark, range(1000))) == 1000 and c.add(rows(spark, range(1000))) == 0
    assert c.read().count() == 1000 and c.touched == (64, 64)
    # one new key: its bucket is read, the others are not
    again = cache(spark, tmp_path / "c")
    assert again.add(rows(spark, [1000])) == 1 and again.touched == (1, 64)
    asked = rows(spark, [5, 2000])
    assert [r["k"] for r in again.misses(asked).collect()] == ["key2000"] and again.touched[0] <= 2
    assert [(r["k"], r["v"]) for r in again.get(asked).collect()] == [("key5", [5])]
    # more keys than a filter is made of
    assert again.misses(rows(spark, range(400, 1400))).count() == 399
    assert cache(spark, tmp_path / "d", buckets=40).buckets == 40 and again.get(rows(spark, [])).count() == 0


def test_cache_compacts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PARTS", 4)
    c = cache(spark, tmp_path / "c", buckets=4)
    for k in range(6):
        assert c.add(rows(spark, range(k * 10, k * 10 + 15))) == (15 if k == 0 else 10)
    parts = c._parts()[1]
    assert len(parts) == 3 and sum(p["rows"] for p in parts) == 65 and c.buckets == cache(spark, tmp_path / "c").buckets == 4
    held = c.read()
    assert c.compact() and not c.compact() and len(c._parts()[1]) == 1
    # who reads the old files goes on, until they are cleaned
    assert held.count() == 65 and c.clean() > 3 and c.read().count() == 65 and c.clean() == 0


def test_two_writers_add_a_key_once(spark, tmp_path, monkeypatch):
    one, two = cache(spark, tmp_path / "c"), cache(spark, tmp_path / "c")
    one.add(rows(spark, [0]))
    write, raced = store.Cache._written, []

    def late(self, fresh):
        part = write(self, fresh)
        if self is one and not raced:
            raced.append(two.add(rows(spark, range(3, 9))))  # between the other's write and its commit
        return part

    monkeypatch.setattr(store.Cache, "_written", late)
    assert one.add(rows(spark, range(6))) == 2 and raced == [6]
    assert sorted(r["k"] for r in one.read().collect()) == [f"key{i}" for i in range(9)]


def test_interrupted_addition_adds_nothing(spark, tmp_path, monkeypatch):
    c = cache(spark, tmp_path / "c")
    c.add(rows(spark, [1]))
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            c.add(rows(spark, [2]))
    assert c.read().count() == 1 and c.add(rows(spark, [2])) == 1 and c.clean() == 1 and c.read().count() == 2


def small(spark, n=3, broken=None):
    memory = spark.createDataFrame([("s", f"memory:D1:{i}", f"D1:{i}", 1, "", "A", f"text {i}", f"text {i}", "", "", "", {}) for i in range(1, n + 1)], store.MEMORY)
    entity = spark.createDataFrame([("s", "entity:a", "a", "a", "Who", ["a"], {})], store.ENTITY)
    mention = spark.createDataFrame([("s", "e1", "entity:b" if broken == "entity" else "entity:a", "memory:D9:9" if broken == "memory" else "memory:D1:1", "odd" if broken == "kind" else "mentions", 1.0, {})], store.MENTION)
    edge = G.sequence_edges(memory)
    if broken == "target":
        edge = edge.withColumn("dst_memory_id", F.lit("memory:none"))
    return G.Graph(memory, entity, mention, edge)


@pytest.mark.parametrize("broken", ["entity", "memory", "kind", "target"])
def test_broken_edges_never_become_visible(spark, tmp_path, broken):
    path = str(tmp_path / "g")
    with pytest.raises(FileNotFoundError):
        store.load_graph(spark, path)
    assert store.save_graph(small(spark), path) == 1
    with pytest.raises(ValueError, match="broken"):
        store.save_graph(small(spark, 5, broken), path)
    assert store.load_graph(spark, path).memory.count() == 3 and len(Versions(spark, path).folders()) == 1


def test_graph_killed_between_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    store.save_graph(small(spark), path)
    ends = store._ends

    def killed(graph, name):
        if name == "mention":
            raise KeyboardInterrupt
        return ends(graph, name)

    with monkeypatch.context() as m:
        m.setattr(store, "_ends", killed)
        with pytest.raises(KeyboardInterrupt):
            store.save_graph(small(spark, 5), path)
    # two of four new tables are there, the old version is what is read
    old = store.load_graph(spark, path)
    assert old.memory.count() == 3 and G.violations(old).isEmpty()
    assert store.save_graph(small(spark, 4), path) == 2 and store.load_graph(spark, path).memory.count() == 4
    assert old.memory.count() == 3 and store.load_graph(spark, path, version=1).memory_edge.count() == 4
    assert store.clean_graph(spark, path) == 1 and store.clean_graph(spark, path, 1) == 1 and store.load_graph(spark, path, "s").memory.count() == 4
    with pytest.raises(FileNotFoundError):
        store.load_graph(spark, path, version=7)
