"""SentencePiece, periodic runs and fill-in-the-middle, against the library, loops and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from recallery.llm import middle as M
from recallery.llm import periods as R
from recallery.llm import pieces as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  two  spaces ", "▁mark▁ ▁", "é漢😀ﷺ́", "<s></s><unk><0x41>", "a" * 5000, "\n\t\0 x", "tokenization isn't 12345 hard", "x y" * 400, "0" * 999, "퟿\U0010ffff", "x y" * 400]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def query(spark, tmp_path, call, rows):
    spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    done = call(spark, str(tmp_path))
    return [r.asDict() for r in done.collect()]


def by_id(row):
    return str(sorted(row.items(), key=str))


# -------------------------------------------------------------------- sentencepiece


@pytest.fixture(scope="module")
def both():
    return P.Vocabulary(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_against_the_library(both, monkeypatch):
    own, library = both
    rng = random.Random(1)
    bits = [" ", "▁", "a", "the", "é", "漢", "😀", "\n", "\0", "<s>", "<unk>", "<0x41>", "  ", "ing", "aaaa", "1", "'s", "Ω", "x" * 70, *"abcdefghst"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(1500)]
    for short in (P.SHORT, 0):  # side by side and heaps
        monkeypatch.setattr(P, "SHORT", short)
        own.known.clear()
        batch = own.encode_all(texts)[0]
        assert [x.tolist() for x in batch] == library.encode(texts)
        for t in texts:
            ids = own.encode(t)
            assert ids.tolist() == library.encode(t) and own.decode(ids) == library.decode(ids.tolist()) == t.replace("▁", " ")
    monkeypatch.setattr(P, "REMEMBERED", 3)
    assert all(own.encode(t).tolist() == library.encode(t) for t in texts[:200])


def test_pieces_decode_any_ids(both):
    own, library = both
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 0, 1, 2]) for _ in range(rng.randrange(9))]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_pieces_of_other_vocabularies():
    data = open(MODEL, "rb").read()
    byte_fallback = data.rindex(b"\x98\x02\x01")
    for wrong in (data[:byte_fallback] + b"\x98\x02\x00" + data[byte_fallback + 3 :], data.replace(b"\x18\x01 \x002\x00", b"\x18\x01 \x012\x00"), b""):
        with pytest.raises(ValueError):
            P.Vocabulary(wrong)


def test_pieces_in_a_table(spark, both):
    _, library = both
    rows = spark.createDataFrame([(k, t, [1], "x") for k, t in enumerate(ODD)], "key int, Text string, ids array<int>, `a b` string").repartition(3)
    got = {r["key"]: r for r in P.encode(rows, MODEL).collect()}
    assert {k: (r["ids"], r["decoded"], r["Text"], r["a b"]) for k, r in got.items()} == {k: (library.encode(t or ""), (t or "").replace("▁", " "), t, "x") for k, t in enumerate(ODD)}
    assert P.encode(rows.limit(0), MODEL).columns == ["key", "Text", "a b", "ids", "decoded"] and P.encode(rows.limit(0), MODEL).count() == 0


def test_pieces_are_checked(monkeypatch):
    class Model:
        value = open(MODEL, "rb").read()

    monkeypatch.setattr(P.Vocabulary, "encode_all", lambda self, texts: ([np.array([5], np.int32) for _ in texts], {}))
    column = pa.array(["a text"])
    assert next(P._encoded(Model, False)(column))[2][0].to_pylist() == [[5]]
    with pytest.raises(ValueError, match="otherwise"):
        next(P._encoded(Model, True)(column))


def test_pieces_query(spark, tmp_path, both):
    rows = [*enumerate(ODD), (3, "again"), (None, "no id")]
    want = []
    for i, t in rows:
        ids = both[1].encode(t or "")
        want.append({"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids))), "decoded_sha256": sha(both[1].decode(ids))})
    assert sorted(query(spark, tmp_path, P.op11_sentencepiece, rows), key=by_id) == sorted(want, key=by_id)


# -------------------------------------------------------------------- periodic runs


def loop_runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if j > i and len(part) >= max(least, times * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    out = []
    for _ in range(rng.randrange(1, 7)):
        if rng.random() < 0.25:
            out += [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(60))]
        else:
            base = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 12))]
            if rng.random() < 0.3:
                base = base * rng.randrange(1, 4) + [rng.randrange(3)]
            out += (base * 90)[: rng.randrange(1, 90)]
    return out


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (1, 2), (24, 2), (24, 5)])
def test_runs(least, times):
    rng = random.Random(least * times)
    for k in range(250):
        w = some_words(rng)
        assert R.runs_of(np.array(w, np.int64), least, times, [None, 2, 7][k % 3]) == loop_runs(w, least, times), w


def test_lag_counts():
    rng = random.Random(4)
    for n in (1, 30, 700):
        w = np.array([min(int(rng.expovariate(0.3)), 40) for _ in range(n)])
        most = n // 2
        want = [0] + [int((w[:-q] == w[q:]).sum()) for q in range(1, most + 1)]
        for heavy in (1, 2, 10, 10**6):
            assert R.lag_counts(w, most, heavy).tolist() == want


def test_runs_of_long_texts():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 3000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    rng = random.Random(9)
    thue_morse = [i.bit_count() % 2 for i in range(3000)]
    for w in (fibonacci[-1], thue_morse, [0] * 2500 + [rng.randrange(3) for _ in range(600)], list(range(900)) * 3, [rng.randrange(2) for _ in range(3000)]):
        assert R.runs_of(np.array(w)) == loop_runs(w)
    # a stretch of one word is one run, however long; its multiples are not followed
    assert R.runs_of(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]


def loop_periods(i, t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    n, h = len(w), zlib.crc32(str("null" if i is None else i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = loop_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return {"doc_id": i, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if runs else None, "runs_sha256": sha(lines), "collapsed_sha256": sha(" ".join(x for k, x in enumerate(w) if k not in gone))}


def test_runs_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, " ".join(f"w{x}" for x in some_words(rng))) for k in range(150)]
    rows += [(1000 + k, " ".join(f"u{rng.randrange(5000)}" for _ in range(rng.randrange(1, 200)))) for k in range(200)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "é " * 23), (2004, "é\t" * 24 + " é"), (None, "na " * 30), (None, None), (3, "a b " * 40), (3, "a b " * 40), (2005, "x " * 20_000), (2006, "one\x0btwo " * 30)]
    got = query(spark, tmp_path, R.op12_periods, rows)
    assert sorted(got, key=by_id) == sorted((loop_periods(i, t) for i, t in rows), key=by_id)
    assert sum(r["n_runs"] > 0 for r in got) > 100


def test_runs_in_a_table(spark):
    rows = spark.createDataFrame([("a b " * 12 + "c", 1, "x"), (None, 2, "y")], "Body string, runs int, `a.b` string")
    got = {r["a.b"]: r for r in R.periodic_runs(rows, "body").collect()}
    assert [tuple(r) for r in got["x"]["runs"]] == [(0, 24, 2)] and got["x"]["collapsed"] == "a b c" and got["x"]["n_words"] == 25
    assert got["y"]["runs"] == [] and got["y"]["collapsed"] == "" and R.periodic_runs(rows.limit(0), "Body").count() == 0
    assert R.periodic_runs(rows, "Body", 50).where("size(runs) > 0").count() == 0
    with pytest.raises(ValueError):
        R.periodic_runs(rows, "Body", times=1)


# --------------------------------------------------------------- fill in the middle


def loop_middle(i, t):
    t = t or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    digest = sha(f"1:{'null' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    chars = (None, None) if form == "plain" else (len(p), len(m))
    return {"doc_id": i, "n": n, "form": form, "prefix_chars": chars[0], "middle_chars": chars[1], "output": out}


def some_texts(rng, k):
    bits = ["word", "a", "Zed ", " ", "é", "漢", "😀", "\n", "<", "<P", "<S>", "P>", "<<M", "M>", ">", "1", "\0", "S", "<M", "x" * 50]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(k)))


def middle_rows():
    rng = random.Random(8)
    rows = [(k, some_texts(rng, 12 if k % 2 else 60)) for k in range(400)]
    rows += [(500 + k, "".join(rng.choice("ab éé漢\n<P") for _ in range(900))) for k in range(20)]
    return rows + [(600, None), (601, ""), (602, "<P>"), (603, "a" * 3000), (604, "é" * 700 + "<S" + "x"), (605, "a" * 130 + "<P>" + "b" * 130), (None, "no id, long " * 40), (None, None), (7, "again, and again. " * 50), (7, "again, and again. " * 50), (7, "other")]


@pytest.mark.parametrize("chunk", [M.CHUNK, 64, 1])
def test_middle(spark, chunk):
    rows = middle_rows() if chunk > 1 else middle_rows()[::9]
    frame = spark.createDataFrame([(i, t, "clash", "d") for i, t in rows], "doc_id long, text string, n string, d1 string").repartition(3)
    done = M.fill_in_middle(frame, chunk=chunk).withColumn("restored", M.restored(M.F.col("output"), M.F.col("form")))
    got = [r.asDict() for r in done.collect()]
    assert {r.pop("d1") for r in got} == {"d"} and all(r.pop("restored") == (r.pop("text") or "") for r in got)
    assert sorted(got, key=by_id) == sorted((loop_middle(i, t) for i, t in rows), key=by_id)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_middle_query(spark, tmp_path):
    rows = middle_rows()
    want = [loop_middle(i, t) for i, t in rows]
    for r, (_, t) in zip(want, rows, strict=True):
        r["output_sha256"], r["restored_sha256"] = sha(r.pop("output")), sha(t or "")
    assert sorted(query(spark, tmp_path, M.op13_middle, rows), key=by_id) == sorted(want, key=by_id)
    assert query(spark, tmp_path, M.op13_middle, []) == []


def test_automaton_composes():
    rng = random.Random(10)
    for _ in range(60):
        data = np.frombuffer(some_texts(rng, 120).encode(), np.uint8)
        for entry in (0, 2, 5, 7):
            state, begins, states = entry, [], []
            for c in M.KIND[data]:
                begins.append(bool(M.BEGINS[state, c]))
                state = int(M.AFTER[state, c])
                states.append(state)
            got = M.scanned(data, entry)
            assert got[0].tolist() == begins and got[1].tolist() == states
    f, counts = np.array([[rng.randrange(8) for _ in range(8)] for _ in range(13)]), np.array([[rng.randrange(5) for _ in range(8)] for _ in range(13)])
    g, c = M.composed(f, counts)
    for s in range(8):
        at, n = s, 0
        for k in range(13):
            at, n = f[k, at], n + counts[k, at]
            assert (g[k, s], c[k, s]) == (at, n)
