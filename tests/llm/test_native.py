"""The operators in DataFrame functions, against small loops."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from recallery.llm import decontaminate as D
from recallery.llm import lines as L
from recallery.llm import mixing as M
from recallery.llm import sharding as S

DOCS = "doc_id long, text string, source string, key string"


def frame(spark, texts, **more):
    rows = [(i, t, more.get("sources", {}).get(i, "a"), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# ------------------------------------------------------------------------ lines


def loop_lines(texts):
    """Chunks by the same rule, removed when their bytes stood before."""
    out, seen = [], set()
    for t in texts:
        if t is None:
            out.append((None, 0, 0))
            continue
        ls = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
        kept, gone, begin = [], 0, 0
        for i in range(len(ls)):
            r = h[i] + 131 * (h[i - 1] if i else 0)
            if r % 1_000_003 % 3 == 0 or i == len(ls) - 1:
                body = "\n".join(ls[begin : i + 1])
                n, begin = i + 1 - begin, i + 1
                if n >= 2 and body.strip() and body in seen:
                    gone += n
                else:
                    kept.append(body)
                seen.add(body)
        out.append(("\n".join(kept), len(ls), gone))
    return out


def test_lines(spark):
    block = "\n".join(f"shared line {i}" for i in range(12))
    texts = [f"one\n{block}\nend", None, "", f"two\n\n{block}\nother end", "\n\n\n", "\n\n\n", f"{block}", "x" * 30_000 + "\n" + block, "tie\ns\nc\n\nsc", "tie\ns\nc\n\nsc"]
    got = {r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_removed"]) for r in L.dedup_lines(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == loop_lines(texts)
    assert sum(g[2] for g in got.values()) > 10
    assert L.dedup_lines(frame(spark, texts).limit(0)).count() == 0


def test_lines_repeated_rows(spark):
    df = frame(spark, ["a\nb\nc\nd\ne\nf\ng"])
    got = L.dedup_lines(df.union(df)).collect()
    assert len(got) == 2 and all(r["n_removed"] == 0 and r["key"] == "clash" for r in got)


CLASH = ("_key", "_h", "_lines", "_row", "chunks", "chunk", "n_lines", "_piece", "_start", "shard", "grown_shard", "hash", "body")


def test_lines_clashes_and_ids(spark):
    rows = [(i, t, *(f"{c} {i}" for c in CLASH)) for i, t in [(1, "a\nb\nc\nd\ne\nf"), (1, "z\na\nb\nc\nd\ne\nf"), (None, "a\nb\nc\nd\ne\nf"), (5, None), (None, "5")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH))
    for run in (L.dedup_lines, L.dedup_windows):
        got = run(df).collect()
        assert len(got) == 5 and all(r[c] == f"{c} {r['doc_id']}" for r in got for c in CLASH if c != "n_lines")
        by = {(r["doc_id"], r["text"]): r for r in got}
        assert by[5, None]["kept_text"] is None and by[None, "5"]["kept_text"] == "5"
        # rows without an id come first
        assert by[None, "a\nb\nc\nd\ne\nf"]["n_removed"] == 0 < by[1, "a\nb\nc\nd\ne\nf"]["n_removed"]
        assert run(df.limit(0)).count() == 0


def loop_windows(texts):
    """Every two lines in a row that stood before are removed."""
    out, seen = [], set()
    for t in texts:
        if t is None:
            out.append((None, 0, 0))
            continue
        ls, gone = t.split("\n"), set()
        for i in range(len(ls) - 1):
            body = "\n".join(ls[i : i + 2])
            if body.strip() and body in seen:
                gone |= {i, i + 1}
            seen.add(body)
        out.append(("\n".join(x for i, x in enumerate(ls) if i not in gone), len(ls), len(gone)))
    return out


def test_lines_whole(spark):
    block = "\n".join(f"shared line {i}" for i in range(12))
    texts = [f"one\n{block}\nend", None, "", f"two\n\n{block}\nother end", "\n\n\n", "\n\n\n", f"{block}", "x" * 30_000 + "\n" + block, "tie\ns\nc\n\nsc", "tie\ns\nc\n\nsc", "r\nr\nr\nr", "shared line 3\nshared line 4", "shared line 3\nshared line 5", "alone"]
    df = frame(spark, texts)
    got = {r["doc_id"]: (r["kept_text"], r["n_lines"], r["n_removed"]) for r in L.dedup_windows(df).collect()}
    assert [got[i] for i in range(len(texts))] == loop_windows(texts)
    # a passage between differing lines goes whole; by chunks its ends stay
    assert got[3][2] == got[7][2] == 12 and got[11][2] == 2 and got[12][2] == 0
    assert {r["doc_id"]: r["n_removed"] for r in L.dedup_lines(df).collect()}[3] < 12
    twice = L.dedup_windows(df.union(df)).collect()
    assert len(twice) == 2 * len(texts) and all((r["kept_text"], r["n_lines"], r["n_removed"]) == got[r["doc_id"]] and r["key"] == "clash" for r in twice)
    assert L.dedup_windows(df.limit(0)).count() == 0


# --------------------------------------------------------------------- sharding


def test_sharding(spark):
    df = spark.range(3000).select((F.col("id") % 2900).alias("doc_id"), F.lit("x").alias("shard_name"))
    got = S.assign(df, "doc_id", [1.0] * 24)
    rows = got.collect()
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows)
    moved = sum(r["grown_shard"] == 24 for r in rows) / len(rows)
    assert 0.02 < moved < 0.07
    same = {}
    assert all(same.setdefault(r["doc_id"], r["shard"]) == r["shard"] for r in rows)
    slots = {}
    for r in S.number(got, "shard", ["doc_id"]).collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_against_a_loop(spark):
    """The shard with the smallest -ln(draw) / weight, the draw by the MD5 of key, shard and seed."""
    import math

    weights, keys = [1.0, 2.5, 0.5, 0.0, 1.0], [None, "", "a", "é", "\x00null", *map(str, range(200))]
    frame_ = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: (r["shard"], r["grown_shard"]) for r in S.assign(frame_.withColumn("shard", F.lit("old")), "k", weights, 3).collect()}
    for k in keys:
        draw = lambda s: int(hashlib.md5(f"{chr(0) + 'null' if k is None else k}/{s}/3".encode()).hexdigest()[:12], 16)  # noqa: B023, E731
        cost = [(-math.log((draw(s) + 1) / 2**48) / w, s) for s, w in enumerate([*weights, 1.0]) if w]
        assert got[k] == (min(c for c in cost if c[1] < 5)[1], min(cost)[1])


def test_numbering_clashes_and_nulls(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i // 2 if i % 5 else None, "p", "s", "n") for i in range(300)], "g int, k long, _piece string, _start string, _n string")
    got = S.number(df.withColumn("g", F.coalesce("g", F.lit(-1))), "g", ["k"], pieces=5).collect()
    assert all((r["_piece"], r["_start"], r["_n"]) == ("p", "s", "n") for r in got) and len(got) == 300
    slots = {}
    for r in got:
        slots.setdefault(r["g"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights(spark):
    got = spark.range(8000).select(S.rendezvous(F.col("id"), [1.0, 3.0, 0.0]).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 8000 for r in got}
    assert set(share) == {0, 1} and share[1] == pytest.approx(0.75, abs=0.03)
    with pytest.raises(ValueError):
        S.rendezvous(F.col("id"), [0.0])


def test_sharding_query(spark, tmp_path):
    frame(spark, [None, "", "é" * 5, "x" * 50_000, "x" * 50_000]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in S.op3_sharding(spark, str(tmp_path)).collect()}
    assert [got[i]["size"] for i in range(5)] == [8, 8, 18, 50_008, 50_008]
    assert got[2]["text_crc32"] == zlib.crc32(("é" * 5).encode()) and got[0]["text_crc32"] == 0
    frame(spark, []).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert S.op3_sharding(spark, str(tmp_path)).count() == 0


# ----------------------------------------------------------------------- mixing


def loop_targets(sizes):
    """Water filling by rounds."""
    names = sorted(n for n in sizes if n is not None) + ([None] if None in sizes else [])
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    left, target, full = sum(sizes.values()), {}, set()
    while True:
        open_ = [n for n in names if n not in full]
        rest = left - sum(3 * sizes[n] for n in full)
        target = {n: 3.0 * sizes[n] if n in full else rest * weight[n] / sum(weight[m] for m in open_) for n in names}
        over = {n for n in open_ if target[n] > 3 * sizes[n]}
        if not over:
            return target
        full |= over


def loop_seats(target, seats):
    won = dict.fromkeys(target, 0)
    order = {n: i for i, n in enumerate(target)}
    for _ in range(seats):
        best = max(target, key=lambda n: (target[n] / (2 * won[n] + 1), -order[n]))
        won[best] += 1
    return won


@pytest.mark.parametrize("sizes", [{"a": 500, "b": 400, "c": 30, None: 70}, {"a": 1}, {"a": 1000, "b": 0, "c": 3}, {f"s{i}": 7 * i + 1 for i in range(40)}])
def test_apportionment(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, n long")
    votes = M.targets(df)
    got = {r["source"]: r["target"] for r in votes.collect()}
    want = loop_targets(sizes)
    assert got == pytest.approx(want)
    for block, shards in ((4, 3), (1, 5), (64, 2)):
        quotas = {}
        for r in M.apportion(votes, block, shards).collect():
            assert r["quota"] >= 0
            quotas[r["source"]] = quotas.get(r["source"], 0) + r["quota"]
        names = sorted(n for n in want if n is not None) + ([None] if None in want else [])
        seats = loop_seats({n: want[n] for n in names}, int(sum(want.values()) / block + 0.5))
        assert quotas == seats


def test_mix(spark):
    rows = [(i, "abc"[i % 3] if i % 10 else None, 20 + i % 50) for i in range(2000)] + [(9000, "tiny", 40), (9001, "a", 0), (9002, "tiny", 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = M.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(t) - target) <= 3 * M.BLOCK for (_, target), t in by.items())
    again = {(r["doc_id"], r["taken"]) for r in M.mix(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert M.mix(df.limit(0)).count() == 0
    assert {r["taken"] for r in M.mix(df.withColumn("size", F.lit(0).cast("long"))).collect()} == {0}


def test_mix_of_small_sources(spark):
    rows = [(i, "big", 200) for i in range(1000)] + [(2000 + i, "m1", 9) for i in range(100)] + [(3000 + i, "m2", 10) for i in range(100)] + [(10_000 + i, f"s{i:05d}", 5) for i in range(2000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by, target = {}, {}
    for r in got:
        by[r["source"]] = by.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(by[s] - target[s]) <= (3 * M.BLOCK if s == "big" else 1) for s in by)


def loop_mix(rows, block=M.BLOCK, shards=M.SHARDS, seed=M.SEED):
    """Block by block: the seats of each house, the chosen blocks in order, dealt to the shards by their quotas."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = loop_targets(sizes)
    unit = {s: 1 if n < block * M.FINE else block for s, n in sizes.items()}
    ends = {s: [0] for s in sizes}
    for u in set(unit.values()):
        names = [s for s in target if unit[s] == u]
        total = sum(target[s] for s in names)
        order = sorted(((target[s] / (2 * k + 1), -i, s) for i, s in enumerate(names) if target[s] for k in range(3 * -(-sizes[s] // u))), reverse=True)
        for house in range(1, shards + 1):
            won = [s for _, _, s in order[: int(total / u * house / shards + 0.5)]]
            for s in names:
                ends[s].append(won.count(s))
    taken = {}
    for s in sizes:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2]))
        words = [r[0] for r in mine for _ in range(r[2])]
        u, q = unit[s], ends[s][-1]
        blocks = [words[k : k + u] for k in range(0, len(words), u)] or [[]]
        b, start = len(blocks), int(hashlib.md5(f"{seed}/{s or ''}".encode()).hexdigest()[:8], 16)
        chosen = [k for _ in range(q // b) for k in range(b)] + [k for k in range(b) for _ in range(((k + 1) * (q % b) + start % b) // b - (k * (q % b) + start % b) // b)]
        for t, k in enumerate(chosen):
            shard = next(j for j in range(shards) if t < ends[s][j + 1])
            for doc in blocks[k]:
                taken.setdefault((s, doc), [0] * shards)[shard] += 1
    return {(s, d): taken.get((s, d), [0] * shards) for d, s, _ in rows}


@pytest.mark.parametrize(
    "rows",
    [
        [(i, "abc"[i % 3] if i % 10 else None, 1 + i % 40) for i in range(600)] + [(9000, "tiny", 40), (9001, "a", 0), (9002, "b", 4000)],
        [(i, f"s{i}", 45) for i in range(0, 20, 2)] + [(1, "s1", 0), (99, "s05", 32)],
        [(None, "a", 3), (1, "", 5), (2, None, 7), (3, "a", 5000)],
    ],
)
def test_mix_against_blocks(spark, rows):
    got = {(r["source"], r["doc_id"]): r for r in M.mix(spark.createDataFrame(rows, "doc_id long, source string, size long").withColumns({"_key": F.lit(1), "rank": F.lit(2)})).collect()}
    want = loop_mix(rows)
    assert {k: r["by_shard"] for k, r in got.items()} == want
    assert all(r["taken"] == sum(r["by_shard"]) <= 3 * r["size"] for r in got.values())


def test_seats_stop_at_the_limit(spark):
    rows = [("full", 100, 0, 300.0)] + [(f"s{i}", 1 + i % 2, i + 1, 1.4) for i in range(1000)]
    got = {}
    for r in M.apportion(spark.createDataFrame(rows, "source string, n long, rank int, target double"), 1, 2).collect():
        assert r["quota"] >= 0
        got[r["source"]] = got.get(r["source"], 0) + r["quota"]
    # by the highest quotients alone "full" gets 321 seats, beyond 3 times its words
    assert got == {"full": 300} | {f"s{i}": 2 if i < 400 else 1 for i in range(1000)}


def test_sizes(spark):
    assert [r["size"] for r in M.sizes(frame(spark, [None, "", " a b  c\t\x0bd ", "x"])).orderBy("doc_id").collect()] == [0, 0, 3, 1]


# --------------------------------------------------------------- decontamination


def loop_decontaminate(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        w = words(t)
        hit, found = set(), set()
        for name, item in items:
            v = words(item)
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(name))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark):
    long = " ".join(f"w{i}" for i in range(25))
    items = [(2, long), (10, "Short item here"), (11, "solo"), (12, "two words"), (13, None), (14, "..."), (15, long), (3, "a a a a a a a a a a a"), (4, "the of and the of and the of and the of and unique the of")]
    texts = [
        None, "", "nothing", long.upper() + "!", " ".join(f"w{i}" for i in range(3, 13)), " ".join(f"w{i}" for i in range(3, 12)), "x short ITEM, here y solo", "two  words two words", "a " * 40,
        "w24 " + long + " " + long, "the of and the of and the of and the of and unique the of", "z " * 5000 + long, "café soloé", "the of and " * 30,
    ]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {r["doc_id"]: tuple(r)[1:] for r in D.decontaminate(frame(spark, texts), bench).collect()}
    assert [got[i] for i in range(len(texts))] == loop_decontaminate(texts, items)
    docs = frame(spark, texts)
    twice = D.decontaminate(docs.union(docs), bench.union(bench)).collect()
    assert len(twice) == 2 * len(texts) and all(tuple(r)[1:] == got[r["doc_id"]] for r in twice)
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in D.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_decontamination_repeated_and_null_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    bench = spark.createDataFrame([(1, one, "x"), (1, two, "x"), (None, " ".join(f"c{i}" for i in range(12)), "x"), (2, one, "x")], "item_id long, text string, hits string")
    docs = spark.createDataFrame([(5, None), (None, "5"), (6, "z " + one), (6, two), (7, " ".join(f"c{i}" for i in range(12))), (None, one), (8, one + " z " + two)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"]) for r in D.decontaminate(docs, bench).collect())
    assert got == sorted([("5", 0, 0, 0), ("None", 1, 0, 0), ("6", 13, 12, 2), ("6", 12, 12, 1), ("7", 12, 12, 0), ("None", 12, 12, 2), ("8", 25, 24, 2)])


def test_decontamination_of_many_hits(spark):
    passage = [f"w{i}" for i in range(40)]
    bench = [(1, " ".join(passage)), (2, " ".join(passage[5:30]))]
    text = " ".join(passage * 120 + ["end"])
    got = D.decontaminate(frame(spark, [text, "w1 w2 " * 900]), spark.createDataFrame(bench, "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in got] == [(4801, 4800, 2), (1800, 0, 0)]


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame([(1, " ".join("abcdefghijkl"))], "item_id long, text string")
    got = D.decontaminate(frame(spark, ["x " + " ".join("bcdefghijkl") + " y"]), bench).first()
    assert (got["n_words"], got["n_hit"]) == (13, 11)
