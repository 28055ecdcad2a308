"""The pipeline against its stages' decisions on planted documents."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline as C
import test_native as N
import test_python as P
import xxhash


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"w{i}x" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(30)
    rows, labels = [(5000, None, "b", "en"), (5001, "", "c", "en")], []
    for i in range(600):
        bad = i % 6 == 0
        body = text(60) + (" grubly grubly" if bad else "")
        rows.append((i, body, "abc"[i % 3], "en"))
        if i < 400:
            labels.append((i, 1, int(bad)))
    base = text(80)
    rows += [(1000 + k, base + (f" tail{k}" if k else ""), "a", "en") for k in range(5)]
    rows += [(2000, text(20) + " " + item, "a", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [{r["doc_id"] for r in docs.collect()}]
    columns = docs.columns
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        assert docs.columns[: len(columns)] == columns and (len(docs.columns) == len(columns)) == (k < 4)
        seen.append({r["doc_id"] for r in docs.collect()})
    clean = {i for i in range(600) if i % 6}
    assert clean <= seen[1] and len({i for i in range(600) if i % 6 == 0} & seen[1]) <= 5 and {5000, 5001} <= seen[1]
    assert seen[1] - seen[2] == {1001, 1002, 1003, 1004}
    assert seen[2] - seen[3] == {2000}
    assert seen[4] <= seen[3] and seen[5] == seen[4] and not {5000, 5001} & seen[4]
    assert {r["shard"] for r in docs.collect()} <= set(range(24))
    twice = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    assert C.near_duplicates(spark, twice.union(twice), sf).count() == 50
    empty = twice.limit(0)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
    assert C.run(spark, sf).count() == docs.count()


def test_rows_without_or_with_one_id(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(f"v{rng.randrange(500)}" for _ in range(n))
    item, long = text(30), text(20_000)
    clash = ("_document", "_copies", "_copy", "score", "_d", "_h", "hs", "shard", "_key")
    body = [(i, text(50)) for i in range(40)]
    given = [*body, (7, text(50)), (7, body[7][1]), (None, text(40)), (None, f"{item} x"), (None, None), (60, long), (61, None), (62, item)]
    rows = [(i, t, "ab"[(i or 0) % 2], *(f"{c}{k}" for c in clash)) for k, (i, t) in enumerate(given)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in clash)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "source", *clash]
    assert len(seen[1]) == len(given)
    # one row of those with id 7, all without an id
    assert sorted(str(r["doc_id"]) for r in seen[2]) == sorted([*map(str, range(40)), "None", "None", "None", "60", "61", "62"])
    assert {(r["doc_id"], r["text"]) for r in seen[2]} - {(r["doc_id"], r["text"]) for r in seen[3]} == {(None, f"{item} x"), (62, item)}
    assert (60, long) in {(r["doc_id"], r["text"]) for r in seen[4]} and all(r["text"] for r in seen[4])
    assert all(r["_copy"].startswith("_copy") and r["_d"].startswith("_d") for r in seen[5]) and {r["shard"] for r in seen[5]} <= set(range(24))
    again = C.near_duplicates(spark, spark.read.parquet(f"{sf}/out0").repartition(3), sf).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in seen[2]}


def loop_pipeline(rows, labels, items):
    """The five stages in loops, over (doc_id, text, source): how often each (doc_id, shard, grown_shard) comes out."""
    scores = P.loop_toxicity([(i, t) for i, t, _ in rows], labels)
    rows = [r for r in rows if scores[r[0]] < 0.5]
    found = P.loop_similar([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if found[r[0]][1] == r[0]]
    hit = N.loop_decontaminate([t for _, t, _ in rows], items)
    rows = [r for r, h in zip(rows, hit, strict=True) if not h[-1]]
    name = lambda i, t: f"+{i}/{xxhash.xxh64_intdigest((t or '').encode(), 42):X}" + ("/null" if t is None else "")
    size = {name(i, t): len(P.words(t)) for i, t, _ in rows}
    mixed = N.loop_mix([(name(i, t), s, size[name(i, t)]) for i, t, s in rows])
    out = Counter()
    for i, t, s in rows:
        k = name(i, t)
        draw = int(hashlib.md5(f"round-0:{k}".encode()).hexdigest()[:8], 16) / 2**32
        copies = math.floor(sum(mixed[s, k]) / max(size[k], 1) + draw) if size[k] else 0
        cost = []
        for shard in range(25):
            h = int(hashlib.md5(f"{i}/{shard}/0".encode()).hexdigest()[:12], 16)
            cost.append((-math.log((h + 1) / 2**48), shard))
        if copies:
            out[i, min(cost[:24])[1], min(cost)[1]] += copies
    return out


def test_pipeline_against_loops(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join(f"u{rng.randrange(300)}" for _ in range(n))
    item = text(25)
    rows, labels = [(900, None, "b"), (901, "", "c")], {}
    for i in range(300):
        bad = i % 6 == 0
        rows.append((i, text(rng.randrange(20, 60)) + (" grubly" if bad else ""), "abc"[i % 3] if i % 11 else None))
        if i % 2 == 0:
            labels[i] = int(bad)
    rows += [(400 + k, rows[20 + k // 3][1] + (" end" if k % 3 else ""), "a") for k in range(12)]
    rows += [(500, f"{text(9)} {item}", "a"), (501, item[: len(item) // 2], "b"), (502, text(2600), "b")]
    rows = [r for r in rows if r[0] != 20]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in labels.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter((r["doc_id"], r["shard"], r["grown_shard"]) for r in C.run(spark, str(tmp_path)).collect())
    want = loop_pipeline(rows, labels, [(1, item)])
    assert got == want and 150 < len(want) < len(rows) and max(want.values()) > 1
