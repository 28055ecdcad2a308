"""Scores behind bounds: BM25 by blocks of postings, and dense scores by groups around pivots."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallery.operators import dense, lexical, nearest
from recallery.operators import graph as G
from recallery.operators import retrieve as R


def corpus(seed=3, n=900):
    """Documents of two samples with frequent and rare words, a few passages that keys repeat, and odd rows."""
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.55)), 6000)}"
    passages = [" ".join(f"r{rng.randrange(4000)}" for _ in range(8)) for _ in range(30)]
    docs = []
    for i in range(n):
        text = " ".join(word() for _ in range(int(rng.paretovariate(0.9) * 8) % 400))
        docs.append(("ab"[i % 3 == 0], str(i), f"{text} {rng.choice(passages)}" if i % 4 == 0 else text, rng.choice(passages) if i % 9 == 0 else ""))
    keys = [f"{p} {word()} {word()} {word()} {word()}" for p in passages] + [" ".join(f"w{rng.randrange(1, 60)}" for _ in range(6)) for _ in range(20)] + ["w1", "nothing here", "the", "w1 w2"]
    return docs, keys


def loop(docs, keys, min_rel, top_k):
    """(sample, key, doc) -> score."""
    out = {}
    for sample in {d[0] for d in docs}:
        mine = [(d, lexical_tokens(text) or ["_empty"], key) for s, d, text, key in docs if s == sample]
        n, average = len(mine), sum(len(t) for _, t, _ in mine) / len(mine)
        df = Counter(w for _, t, _ in mine for w in set(t))
        raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
        mean = sum(raw.values()) / len(raw)
        idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
        for q in keys:
            asked = Counter(w for w in lexical_tokens(q) if w in idf)
            score = {}
            for d, t, _ in mine:
                tf = Counter(t)
                if any(w in tf for w in asked):
                    score[d] = sum(k * idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / average)) for w, k in asked.items() if w in tf)
            best = max(score.values(), default=0)
            rel = {d: round(s / best, 9) for d, s in score.items()} if best > 0 else {}
            for d, _, key in mine:
                if key == q:
                    rel[d] = max(rel.get(d, 0), 1.0)
            rows = sorted(((-r, d) for d, r in rel.items() if r >= min_rel))[:top_k]
            out |= {(sample, q, d): -r for r, d in rows}
    return out


def lexical_tokens(text):
    return [w for w in text.lower().split() if len(w) > 1 and w not in lexical.X.STOPWORDS]


@pytest.mark.parametrize(("min_rel", "top_k", "block", "first"), [(0.5, 20, 16, 2), (0.5, 3, 40, 1), (0.8, None, 16, 2)])
def test_bm25_by_bounds(spark, monkeypatch, min_rel, top_k, block, first):
    docs, keys = corpus()
    for name, value in (("DIRECT", 0), ("BLOCK", block), ("FIRST", first)):
        monkeypatch.setattr(lexical, name, value)
    rows = spark.createDataFrame(docs, "sample_id string, doc string, text string, key string")
    asked = spark.createDataFrame([(k,) for k in keys], "qkey string")
    got = {(r["sample_id"], r["qkey"], r["doc"]): r["score"] for r in lexical.match_keys(lexical.index(rows, asked=asked), asked, min_rel, top_k).collect()}
    want = loop(docs, keys, min_rel, top_k)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-8 for k, v in want.items())
    # keys of one sample each, over all postings
    own = spark.createDataFrame([("ab"[i % 2], k) for i, k in enumerate(keys)], "sample_id string, qkey string")
    got = {(r["sample_id"], r["qkey"], r["doc"]) for r in lexical.match_keys(lexical.index(rows), own, min_rel, top_k).collect()}
    mine = {(r["sample_id"], r["qkey"]) for r in own.collect()}
    assert got == {k for k in want if k[:2] in mine}


def test_bm25_joins_few_rows(spark, monkeypatch):
    docs, keys = corpus(5, 3000)
    monkeypatch.setattr(lexical, "BLOCK", 128)
    rows = spark.createDataFrame(docs, "sample_id string, doc string, text string, key string")
    asked = spark.createDataFrame([(k,) for k in keys], "qkey string").withColumn("kid", F.monotonically_increasing_id())
    found = lexical.index(rows, asked=asked)
    terms = asked.select("kid", F.explode(lexical.tokens(F.col("qkey"))).alias("term")).groupBy("kid", "term").agg(F.count("*").alias("times"))
    weighed = lexical.settle(terms.join(found.terms, "term").select("sample_id", "kid", "term", (F.col("times") * F.col("idf")).alias("w"), "df"))
    hits = weighed.agg(F.sum("df")).first()[0]
    held = lexical.blocked(found)
    pieces = lexical.settle(lexical.bound_pieces(held, weighed.drop("df")))
    start = pieces.where(F.col("place") <= lexical.FIRST)
    first = lexical.settle(lexical.block_scores(held, start, 0.5, 20))
    rest = lexical.settle(lexical.alive(pieces, lexical.needed(first, 0.5, 20)))
    # every posting moves once, and with it the terms of the keys that ask its block, not once for each key
    assert 5 * (start.count() + rest.count()) < hits
    blocks = pieces.select("sample_id", "kid", "block").distinct().count()
    assert rest.select("sample_id", "kid", "block").distinct().count() < 0.6 * blocks
    assert held.groupBy("sample_id", "block").agg(F.countDistinct("doc").alias("n")).agg(F.max("n")).first()[0] < 3 * lexical.BLOCK


def test_bm25_slices(spark, monkeypatch):
    """Many keys ask one block: they meet it in parts."""
    docs, keys = corpus(7, 300)
    rows = spark.createDataFrame(docs, "sample_id string, doc string, text string, key string")
    asked = spark.createDataFrame([(k,) for k in keys], "qkey string")
    plain = sorted(map(tuple, lexical.match_keys(lexical.index(rows, asked=asked), asked).collect()))
    for name, value in (("DIRECT", 0), ("KEYS", 7), ("BLOCK", 64)):
        monkeypatch.setattr(lexical, name, value)
    assert sorted(map(tuple, lexical.match_keys(lexical.index(rows, asked=asked), asked).collect())) == plain


# ------------------------------------------------------------------------ dense


def clustered(n=1500, d=16, clusters=12, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, d))
    x = centre[rng.integers(clusters, size=n)] + 0.15 * rng.normal(size=(n, d))
    x[5] = x[6] = x[7] = x[8]
    x[40:44] = 0
    return x


def best(q, v, ids, k, clip):
    q, v = (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12) for y in (q, v))
    s = np.round(q @ v.T, 9)
    s = np.maximum(s, 0) if clip else s
    return [[(ids[j], round(float(s[i, j]), 6)) for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]] for i in range(len(q))]


@pytest.mark.parametrize(("k", "clip", "part"), [(10, True, 20_000), (5, False, 20_000), (3, True, 200), (1499, True, 20_000)])
def test_nearest(spark, monkeypatch, k, clip, part):
    for name, value in (("LARGE", 300), ("PART", part), ("BOUNDED", 7)):
        monkeypatch.setattr(nearest, name, value)
    x, small = clustered(), clustered(60, seed=4)
    x[9, :] = -x[8]
    samples = {"large": x, "small": small, "short": clustered(400, 5), "random": np.random.default_rng(1).normal(size=(350, 16)), "zero": np.zeros((310, 4))}
    vectors = spark.createDataFrame([(s, f"m{i}", row.tolist()) for s, v in samples.items() for i, row in enumerate(v)], "sample_id string, id string, vec array<double>")
    asked = {s: np.vstack([v[:3], v[40:42], -v[8:9]]) for s, v in samples.items()}
    questions = spark.createDataFrame([(s, i, row.tolist()) for s, q in asked.items() for i, row in enumerate(q)] + [("none", 1, [1.0])], "sample_id string, qa int, qvec array<double>")
    got = {}
    for r in nearest.top_k(questions, vectors, k, clip).orderBy("rank").collect():
        got.setdefault((r["sample_id"], r["qa"]), []).append((r["id"], round(r["s"], 6)))
    for s, q in asked.items():
        for i, want in enumerate(best(q, samples[s], [f"m{j}" for j in range(len(samples[s]))], k, clip)):
            assert got[s, i] == want, (s, i)
    assert len(got) == sum(map(len, asked.values())) and nearest.top_k(questions, vectors, -1).count() == 0


def test_nearest_passes_groups_over(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LARGE", 300)
    x = clustered(4000, clusters=30)
    vectors = spark.createDataFrame([("s", f"m{i}", row.tolist()) for i, row in enumerate(x)], "sample_id string, id string, vec array<double>")
    questions = vectors.where("int(substring(id, 2, 9)) % 100 = 0").select("sample_id", F.expr("int(substring(id, 2, 9))").alias("qa"), F.col("vec").alias("qvec"))
    sizes = vectors.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    groups = nearest.Groups(vectors, sizes)
    near = nearest.settle(nearest.asked_groups(questions, groups, 5, True, True))
    first = nearest.settle(nearest.group_scores(groups, questions, near, 5, True))
    asking = nearest.settle(nearest.needing(questions, first, 5))
    rest = nearest.settle(nearest.behind(asking, groups, near, 5, True))
    seen = near.unionByName(rest).count()
    # of what is looked at, only what reaches the k-th best goes on
    assert nearest.group_scores(groups, asking, rest, 5, True).count() < rest.count()
    n = groups.around.count()
    assert 40 <= n <= 90 and groups.members.count() == 4000
    assert seen < 0.35 * n * questions.count()


def test_nearest_with_odd_vectors(spark, monkeypatch):
    """Nulls, numbers that are not finite and vectors of other lengths go the plain way, with what it gives."""
    monkeypatch.setattr(nearest, "LARGE", 10)
    rows = [("s", f"m{i}", [float(i), 1.0]) for i in range(20)]
    odd = [("m", None), ("n", [float("nan"), 1.0]), ("o", [float("inf"), 0.0]), ("p", [1.0]), ("q", [None, 1.0])]
    questions = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, [0.0, -1.0])], "sample_id string, qa int, qvec array<double>")
    for extra in odd:
        vectors = spark.createDataFrame([*rows, ("s", *extra)], "sample_id string, id string, vec array<double>")
        got = nearest.top_k(questions, vectors, 4).where("qa = 1").orderBy("rank").collect()
        assert [r["id"] for r in got] == ["m19", "m18", "m17", "m16"]
        assert nearest.top_k(questions, vectors, 30).where(F.col("id") == extra[0]).count() == 2
    assert nearest.top_k(questions.limit(0), vectors, 3).count() == 0 and nearest.top_k(questions, vectors.limit(0), 3).count() == 0


def test_bounds_are_for_large_samples_only(spark, monkeypatch):
    """Where all samples together have many postings, those of a small sample are joined as they are; results are the same."""
    docs, keys = corpus(n=300)
    docs += [(f"s{i}", str(k), text, "") for i in range(20) for k, text in enumerate(("w1 w2 small", "one other", "more words"))]
    monkeypatch.setattr(lexical, "DIRECT", 250)
    monkeypatch.setattr(lexical, "DIRECT_SAMPLE", 200)
    seen, plain = [], lexical.bounded_scores

    def watched(found, weighed, *how):
        seen.extend(r["sample_id"] for r in weighed.select("sample_id").distinct().collect())
        return plain(found, weighed, *how)

    monkeypatch.setattr(lexical, "bounded_scores", watched)
    table = spark.createDataFrame(docs, "sample_id string, doc string, text string, key string")
    asked = spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "qkey string")
    rows = lambda: sorted((r["sample_id"], r["qkey"], r["doc"], round(r["score"], 6)) for r in lexical.match_keys(lexical.index(table, asked=asked), asked).collect())
    got = rows()
    assert sorted(seen) == ["a", "b"] and any(r[0] == "s7" for r in got)
    monkeypatch.setattr(lexical, "DIRECT", 10**9)
    assert rows() == got


def test_stemmed_postings_are_kept(spark):
    """Postings of asked stems are made once, and a document with two tokens of a stem counts once."""
    docs = [("s", "0", "jumps jumping tree", ""), ("s", "1", "jumping cats", ""), ("s", "2", "trees", ""), ("s", "3", "", "")]
    table = spark.createDataFrame(docs, "sample_id string, doc string, text string, key string")
    made = lexical.index(table, "porter", spark.createDataFrame([("jump cat",)], "qkey string"))
    assert "Join" not in made.postings._jdf.queryExecution().optimizedPlan().toString()
    assert {r["term"]: r["df"] for r in made.terms.collect()} == {"jump": 2, "tree": 2, "cat": 1, "_empty": 1}
    assert sorted((r["doc"], r["term"], r["tf"]) for r in made.postings.collect()) == [("0", "jump", 2), ("1", "cat", 1), ("1", "jump", 1)]


def conversations(n=150, seed=4):
    """A graph of a long sample and a short one, with their vectors (some missing or null), questions and scores of pairs."""
    rng = np.random.default_rng(seed)
    sizes = {"long": n, "short": 3}
    vec = {(s, f"memory:{i}"): rng.integers(-3, 4, 4).astype(float).tolist() for s, k in sizes.items() for i in range(k)}
    ids = list(vec)
    vec[ids[7]] = None
    asked = {(s, qa): rng.integers(-3, 4, 4).astype(float).tolist() for s in sizes for qa in range(6)}
    asked["long", 4] = None
    seeds = {(*q, f"memory:{i}"): (0.125 * (i % 5) if i % 3 else None, 0.125 * (i % 7)) for q in asked if q[1] % 2 == 0 for i in range(0, sizes[q[0]], 2)}
    return ids, vec, asked, seeds


@pytest.mark.parametrize("gate", [True, False])
def test_fused_by_blocks(spark, monkeypatch, gate):
    """Vectors meet in blocks, each once for a question: no vector goes with a pair of a question and a memory."""
    ids, vec, asked, seeds = conversations()
    memory = spark.createDataFrame([(s, m, f"D{m[7:]}") for s, m in ids], "sample_id string, memory_id string, dia_id string")
    vectors = spark.createDataFrame([(*k, v) for k, v in vec.items() if k != ids[11]], "sample_id string, memory_id string, vec array<double>")
    questions = spark.createDataFrame([(*k, v) for k, v in asked.items()], "sample_id string, qa int, qvec array<double>")
    scores = spark.createDataFrame([(*k, *v) for k, v in seeds.items()], "sample_id string, qa int, memory_id string, seed double, e double")
    g = G.Graph(memory, None, None, None)
    monkeypatch.setattr(R, "BLOCK", 16)
    monkeypatch.setattr(dense, "cosine", None)  # a join for each pair

    def cosine(a, b):
        a, b = (x if x is None else np.array(x) / max(np.linalg.norm(x), 1e-12) for x in (a, b))
        return 0.0 if a is None or b is None else round(max(float(a @ b), 0.0), 9)

    want = {}
    for (s, qa), q in asked.items():
        mine = {k[2]: v for k, v in seeds.items() if k[:2] == (s, qa)}
        for sample, m in ids:
            if sample == s and (m in mine or not mine or not gate):
                seed, e = mine.get(m, (None, 0.0))
                c = cosine(q, None if (s, m) == ids[11] else vec[s, m])
                if e > 0 or c > 0:
                    want[s, qa, m] = (f"D{m[7:]}", seed or 0.0, e, c, gate and bool(mine))
    pool = R.fuse(g, questions, scores, vectors, 0.25, 0.75, gate).collect()
    got = {(r["sample_id"], r["qa"], r["memory_id"]): r for r in pool}
    assert len(pool) == len(got) and got.keys() == want.keys()
    for k, (dia, seed, e, c, gated) in want.items():
        r = got[k]
        assert (r["dia_id"], r["seed"], r["e"], r["gated"]) == (dia, seed, e, gated) and abs(r["s"] - c) < 2e-9 and abs(r["score"] - (0.25 * e + 0.75 * c)) < 3e-9
    blocks = R.fused(g, questions, scores, vectors, 0.25, 0.75, gate)
    assert blocks.count() <= 6 * (math.ceil(150 / 16) + 1) and blocks.groupBy("sample_id", "qa").count().count() == 12
