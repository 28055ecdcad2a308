import json

import pytest
from pyspark.sql import functions as F

from recallery import schema
from recallery.operators import dense, extract, lexical, units
from recallery.operators import graph as G
from recallery.operators import retrieve as R
from recallery.plans import catalog
from recallery.plans import evaluate as E
from recallery.sources import store


def dialog(spark, rows):
    """rows: (session, pos, dia_id, speaker, text)"""
    return spark.createDataFrame([("s", n, "8 May 2023", p, d, who, t, "", "", "") for n, p, d, who, t in rows], schema.DIALOG)


def fixed(items):
    """An extractor that finds the entities of a table text -> [(value, type)]; None fails."""

    def run(df, text):
        rows = [(t, None if x is None else [{"value": v, "type": k} for v, k in x]) for t, x in items.items()]
        known = df.sparkSession.createDataFrame(rows, f"_t string, items {schema.ITEM}")
        return df.join(known, df[text] == known["_t"], "left").drop("_t")

    return run


def test_clean_items(spark):
    items = [("Pottery", "What"), ("pottery", "Who"), ("Ann", "Who"), ("x", "Thing"), ("", "What")]
    df = spark.createDataFrame([([{"value": v, "type": t} for v, t in items],), (None,)], f"items {schema.ITEM}")
    got = [[tuple(x) for x in r["items"]] for r in extract.cleaned(df).collect()]
    assert sorted(got, key=len) == [[], [("Ann", "Who"), ("Pottery", "What")]]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('```json\n[{"value":"Ann","type":"Who"},]\n```', [("Ann", "Who")]), ('{"entities":[{"value":"Ann","type":"Who"}]}', [("Ann", "Who")]), ('[{"value":"Ann","type":"Foo"}]', [("Ann", "What")]),
        ("[] trailing words", []), ('Sure: [{"value":"Ann","type":"Who"}] ok', [("Ann", "Who")]), ('[{"value":"http://x","type":"What"}]', [("http://x", "What")]),
        ("[1]", None), ('[{"value":"a"}]', None), ("no json", None),
        # what is neither a list nor an object with entities leaves it to the next reading
        ('{"result": [{"value":"Ann","type":"Who"}]}', [("Ann", "Who")]), ('{"value": "Ann", "type": "Who"}', [("Ann", "Who")]), ('{"note": "x"} [{"value":"Ann","type":"Who"}]', [("Ann", "Who")]), ("7", None), ('{"note": "x"}', None),
        # fences go, their content stays
        ('[{"value":"Ann","type":"Who"}]\n```json\n```', [("Ann", "Who")]), ('[]```json\n[{"value":"Ann","type":"Who"}]\n```', []), ('```json\n[{"value":"Ann","type":"Who"}]', [("Ann", "Who")]), ('```\n{"entities": []}\n```', []),
        ('```json\n[{"value":"Ann","type":"Who"}, {"value":"Bo', [("Ann", "Who")]), ('{"entities": {"value": "a"}}', None), ("[" * 100_000, None),
    ],
)
def test_answers(answer, want):
    if want is None:
        with pytest.raises(ValueError):
            extract.parse_answer(answer)
    else:
        assert extract.parse_answer(answer) == want


def test_model_extractor(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "t string")
    run = extract.model_extractor(lambda: lambda prompt: '[{"value":"Ann","type":"Who"}]' if prompt.endswith("a") else "junk")
    got = {r["t"]: r["items"] for r in run(df, "t").collect()}
    assert got["b"] is None and got["a"][0]["value"] == "Ann"


def test_build(spark):
    rows = [
        (1, 0, "D1:2", "Ann", "two"), (1, 1, "D1:10", "Bob", "ten"), (1, 2, " ", "Zed", "no id"), (1, 3, "D1:11", "", "blank speaker"), (1, 4, "D1:12", "Ann", "ANN"), (1, 5, "D1:2", "Eve", "again"),
        (2, 0, "D2:1", "Bob", "you"), (2, 1, "D2:2", "Cid", ""), (2, 2, "D2:3", "Dan", "fails"),
    ]
    g = G.build(dialog(spark, rows), fixed({"two": [("Ann", "What"), ("tea", "What"), ("tea", "Who")], "ANN": [("ANN", "Who")], "fails": None}))
    memory = {r["dia_id"]: r for r in g.memory.collect()}
    assert memory["D1:2"]["text"] == "two" and len(memory) == 7
    assert memory["D2:1"]["text_normalized"] == "you"  # the speaker before is of the same session only
    before = {(r["dia_id"], r["speaker"]): r["previous_speaker"] for r in G.turns(dialog(spark, rows)).collect()}
    assert before["D1:12", "Ann"] == "Bob"
    entity = {r["key"]: r for r in g.entity.collect()}
    assert entity["ann"]["type"] == "What" and entity["ann"]["value"] == "Ann" and entity["ann"]["merged_from"] == ["Ann", "ANN"]
    mention = {(r["entity_id"][7:], r["memory_id"][7:]) for r in g.mention.collect()}
    assert ("dan", "D2:3") in mention and ("eve", "D1:2") in mention and not any(m == "D2:2" for _, m in mention)
    nexts = {(r["src_memory_id"][7:], r["dst_memory_id"][7:]) for r in g.memory_edge.where("edge_type = 'next'").collect()}
    assert ("D1:2", "D1:10") in nexts and ("D1:12", "D2:1") in nexts and g.memory_edge.count() == 12
    assert G.violations(g).count() == 0
    stats = G.stats(g).first()
    assert (stats["memories"], stats["memory_edges"]) == (7, 12)
    assert {r["dia_id"] for r in G.pending(g.memory, g.mention).collect()} == {"D1:11", "D2:2"}
    assert G.build_memories_only(dialog(spark, rows)).memory.where("dia_id = 'D1:2'").first()["text"] == "again"


def worked(spark):
    m = [("s", f"memory:D1:{i}", f"D1:{i}", 1, "", "x", f"t{i}", f"t{i}", "", "", "", {}) for i in (1, 2, 3)]
    memory = spark.createDataFrame(m, schema.MEMORY)
    e = [("s", f"entity:{k}", k, k, t, [k], {}) for k, t in (("caroline", "Who"), ("support group", "What"), ("melanie", "Who"))]
    pairs = [("caroline", 1), ("caroline", 3), ("support group", 1), ("melanie", 2)]
    mention = spark.createDataFrame([("s", f"edge:{a}{b}", f"entity:{a}", f"memory:D1:{b}", "mentions", 0.0, {}) for a, b in pairs], schema.MENTION)
    g = G.Graph(memory, spark.createDataFrame(e, schema.ENTITY), mention, G.sequence_edges(memory))
    vec = spark.createDataFrame([("s", f"memory:D1:{i}", [c, (1 - c * c) ** 0.5]) for i, c in ((1, 0.5), (2, 0.6), (3, 0.9))], "sample_id string, memory_id string, vec array<double>")
    q = spark.createDataFrame([("s", 1, [1.0, 0.0])], "sample_id string, qa int, qvec array<double>")
    k = spark.createDataFrame([("s", 1, "Caroline"), ("s", 1, "support  group")], "sample_id string, qa int, qkey string")
    return g, q, k, vec


def test_worked_example(spark):
    g, q, k, vec = worked(spark)
    got = [(r["dia_id"], round(r["score"], 6)) for r in R.retrieve(g, q, k, vec).orderBy("rank").collect()]
    assert got == [("D1:3", 0.664134), ("D1:1", 0.566404), ("D1:2", 0.528202)]
    audit = R.audit(g, q, k, vec).first()
    assert audit["gated"] and audit["pool"] == 3 and [r["dia_id"] for r in audit["rows"]] == ["D1:3", "D1:1", "D1:2"]
    assert [r["via_sequence_only"] for r in audit["rows"]] == [False, False, True]


def test_ungated(spark):
    g, q, k, vec = worked(spark)
    none = k.limit(0)
    plain = [r["dia_id"] for r in R.retrieve(g, q, none, vec).orderBy("rank").collect()]
    assert plain == ["D1:3", "D1:2", "D1:1"]
    nothing = k.withColumn("qkey", F.lit("zzz"))
    assert [r["dia_id"] for r in R.retrieve(g, q, nothing, vec).orderBy("rank").collect()] == plain
    zero = R.retrieve(g, q, none, vec, variant=R.Variant("x", 1.0, 0.0)).orderBy("rank").collect()
    assert [(r["dia_id"], r["score"]) for r in zero] == [("D1:1", 0.0), ("D1:2", 0.0), ("D1:3", 0.0)]
    assert R.retrieve(g, q, k, vec, k=-1).count() == 0
    dense_only = [r["dia_id"] for r in R.retrieve(g, q, k, vec, variant=R.VARIANTS[3]).orderBy("rank").collect()]
    assert dense_only == plain


def test_bm25_against_loop(spark):
    import math

    docs = ["the cat sat", "cat cat dog", "", "bird dog fish", "cat"]
    df = spark.createDataFrame([("s", str(i), d, "key " + d) for i, d in enumerate(docs)], "sample_id string, doc string, text string, key string")
    asked = spark.createDataFrame([("s", "cat dog dog")], "sample_id string, qkey string")
    got = {r["doc"]: r["score"] for r in lexical.match_keys(lexical.index(df), asked, min_rel=0.0, top_k=None).collect()}
    toks = [[t for t in d.split() if t != "the"] or ["_empty"] for d in docs]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    terms = {t for d in toks for t in d}
    idf = {t: math.log(n - sum(t in d for d in toks) + 0.5) - math.log(sum(t in d for d in toks) + 0.5) for t in terms}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    score = [sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in "cat dog dog".split() if t in d) for d in toks]
    for i, s in enumerate(score):
        if s > 0:
            assert got[str(i)] == pytest.approx(s / max(score), abs=1e-8)
    exact = spark.createDataFrame([("s", "key the cat sat"), ("s", "the")], "sample_id string, qkey string")
    assert {r["doc"] for r in lexical.match_keys(lexical.index(df), exact).collect()} >= {"0"}
    assert lexical.match_keys(lexical.index(df), exact, top_k=-1).count() == 0
    assert lexical.index(df.limit(0)).postings.count() == 0


def test_dense(spark):
    v = spark.createDataFrame([("s", "a", [1.0, 0.0]), ("s", "b", [-1.0, 0.0]), ("s", "c", [0.0, 0.0])], "sample_id string, memory_id string, vec array<double>")
    q = spark.createDataFrame([("s", 1, [2.0, 0.0])], "sample_id string, qa int, qvec array<double>")
    assert {r["memory_id"]: r["s"] for r in dense.cosine(q, v).collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}
    none = spark.createDataFrame([], "sample_id string, qa int, memory_id string")
    assert dense.cosine(q, v, none).count() == 0
    t = spark.createDataFrame([("x y",), ("x y",), (None,)], "t string")
    e = dense.embed(t, "t")
    assert e.count() == 2 and dense.missing(t, "t", e, "hashed").count() == 0 and dense.missing(t, "t", e, "other").count() == 3


def test_units(spark):
    from recallery.plans.catalog import UNITS

    rows = spark.createDataFrame(list(UNITS), "sample_id string, observation string, session_summary string")
    got = {(r["unit_id"], r["text"], tuple(r["dia_ids"])) for r in units.observations(rows).collect()}
    assert ("obs::session_1::Ann::2", "has a cat", ("D1:3",)) in got and ("obs::session_1::Bob::0", "runs", ("D1:4", "D1:5")) in got and len(got) == 5
    assert units.summaries(rows).count() == 2


def test_gates(spark):
    row = spark.createDataFrame([(45.0, 46.0, 78.0, 82.0), (45.0, 45.0, 78.0, 70.0), (45.0, 44.0, 1.0, 2.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert [r[0] for r in row.select(E.publish_gate(*map(F.col, "abcd"))).collect()] == ["publish_ok_method_helps", "publish_ok_f1_non_worse", "method_weaker_on_f1_diagnose", "incomplete"]
    assert [r[0] for r in spark.createDataFrame([(43.0,), (42.0,), (40.0,)], "f double").select(E.write_up_gate(F.col("f"))).collect()] == ["full_writeup", "parity_claim_only", "stop_large_compare"]
    best = E.unit_gate(spark.createDataFrame([("o5", 31.43), ("o25", 32.69)], "variant string, token_f1_pct double")).first()
    assert (best["best"], best["gate"]) == ("o25", "stop_p3_main_spend")


def test_answers_and_frozen(spark):
    q = spark.createDataFrame([("s", 1, "who?", "Ann", ["D1:1"], 1), ("s", 2, "who?", "Bob", [], 2)], schema.QUESTION)
    prompts = E.prompts(q, spark.createDataFrame([("s", 1, "line one\nline two")], "sample_id string, qa int, context string"))
    said = {r["qa"]: r["prediction"] for r in E.answer(prompts).collect()}
    assert said == {1: "line one", 2: "(no retrieved dialogs)"}
    p = spark.createDataFrame([("s", "who?", "Bob", ["D1:1"])], "sample_id string, question string, prediction string, ids array<string>")
    assert E.frozen(p, q).first()["token_f1"] == 1.0  # the last of repeated questions counts
    rolled = E.rollup(E.at_cutoffs(q, spark.createDataFrame([("s", 1, ["D1:1"])], "sample_id string, qa int, ids array<string>")).withColumn("token_f1", F.lit(0.5)))
    overall = rolled.where("k = 25 and category is null").first()
    assert (overall["n"], overall["recall_acc"], overall["token_f1_pct"]) == (2, 100.0, 50.0)
    assert E.at_cutoffs(q, spark.createDataFrame([("s", 1, ["x"])], "sample_id string, qa int, ids array<string>"), empty_gold="skip").count() == 4


def test_sources(spark, tmp_path):
    sample = {
        "sample_id": "c1", "qa": [{"question": "Who?", "answer": 7, "evidence": ["D1:1"], "category": 1}, {"question": " "}],
        "conversation": {"session_1": [{"dia_id": "D1:1", "speaker": "Ann", "text": "hi", "img_url": ["u"], "img_caption": "cat"}, "junk"], "session_1_date_time": "8 May 2023", "session_x": [], "session_2": "no list"},
    }
    path = tmp_path / "data.json"
    path.write_text(json.dumps([sample]))
    df = store.samples(spark, str(path), "c1")
    turn = store.dialogs(df).collect()
    assert len(turn) == 1 and (turn[0]["date_time"], turn[0]["blip_caption"], turn[0]["img_url"]) == ("8 May 2023", "cat", "u")
    asked = store.questions(df).collect()
    assert len(asked) == 1 and asked[0]["answer"] == "7" and asked[0]["qa"] == 1
    with pytest.raises(ValueError):
        store.samples(spark, str(path), "c2")
    (tmp_path / "c1_qkeys_x.json").write_text(json.dumps({"1": ["ann", "tea"], "2": []}))
    assert {(r["sample_id"], r["qa"], r["qkey"]) for r in store.question_keys(spark, str(tmp_path / "c1_qkeys_x.json")).collect()} == {("c1", 1, "ann"), ("c1", 1, "tea")}


def test_lines_and_arrays(spark, tmp_path):
    """A file of samples is an array, a line for each, or one object over several lines."""
    made = [{"sample_id": f"c{i}", "qa": [], "conversation": {"session_1": [{"dia_id": "D1:1", "speaker": "A", "text": "[hi]"}]}} for i in range(3)]
    texts = {"array": json.dumps(made), "pretty": json.dumps(made, indent=1), "lines": "\n".join(map(json.dumps, made)), "gaps": "\n\n".join(map(json.dumps, made)) + "\n\n", "one": json.dumps(made[0], indent=1), "last": json.dumps(made[0]), "none": "", "empty": "[]"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    for name, n in (("array", 3), ("pretty", 3), ("lines", 3), ("gaps", 3), ("one", 1), ("last", 1), ("none", 0), ("empty", 0)):
        df = store.samples(spark, str(tmp_path / f"{name}.json"))
        assert sorted(r["sample_id"] for r in df.collect()) == [f"c{i}" for i in range(n)] and store.dialogs(df).count() == n, name
    both = store.samples(spark, str(tmp_path / "{lines,gaps}.json"))
    assert both.count() == 6 and store.samples(spark, str(tmp_path / "lines.json"), "c2", lines=True).count() == 1
    assert store.samples(spark, str(tmp_path / "lines.json"), lines=False).count() < 3


def test_graph_store_and_cache(spark, tmp_path):
    g = worked(spark)[0]
    store.save_graph(g, str(tmp_path / "g"))
    back = store.load_graph(spark, str(tmp_path / "g"))
    assert back.memory.count() == 3 and {r["weight"] for r in back.mention.collect()} == {1.0}
    assert len(json.loads(store.to_json(g).first()["graph"])["mention"]) == 4
    cache = store.Cache(spark, str(tmp_path / "c"), "k string, v int", ["k"])
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "k string, v int")
    assert (cache.add(rows), cache.add(rows), cache.read().count()) == (2, 0, 2)
    assert "| a |" in store.report_markdown(rows)


def test_pending(spark):
    asked = spark.createDataFrame([("s", i, ["a"]) for i in range(1, 5)], "sample_id string, qa int, context_ids array<string>")
    stored = spark.createDataFrame([("s", 1, ["a"], "x", 1.0), ("s", 2, ["b"], "x", 1.0), ("s", 3, ["a"], " ", 1.0), ("s", 4, ["a"], "x", None)], "sample_id string, qa int, context_ids array<string>, prediction string, token_f1 double")
    assert sorted(r["qa"] for r in E.pending(asked, stored).collect()) == [2, 3, 4]


def test_jobs(spark, tmp_path):
    from recallery.plans import jobs

    turns = [{"dia_id": f"D1:{i}", "speaker": "AB"[i % 2], "text": t} for i, t in enumerate(["the remarkable elephants", "nothing here", "remarkable weather today", "fine"], 1)]
    qa = [{"question": "what is remarkable", "answer": "elephants", "evidence": ["D1:1"], "category": 1}, {"question": "fine", "answer": "fine", "evidence": [], "category": 5}]
    (tmp_path / "d.json").write_text(json.dumps([{"sample_id": "s1", "conversation": {"session_1": turns, "session_1_date_time": "8 May 2023"}, "qa": qa}]))
    g = jobs.build_graphs(spark, str(tmp_path / "d.json"), str(tmp_path / "g"))
    assert store.from_json(store.to_json(g)).mention.count() == g.mention.count()
    q = jobs.embed_questions(store.questions(store.samples(spark, str(tmp_path / "d.json"))))
    keys = spark.createDataFrame([("s1", 1, "remarkable")], "sample_id string, qa int, qkey string")
    v = jobs.embed_memories(g)
    rows = jobs.run_variant(g, q, keys, v, R.VARIANTS[1])
    first = rows.where("qa = 1 and k = 5").first()
    assert first["hit"] and 0 < first["token_f1"] <= 1 and rows.count() == 8
    kept = rows.where("k = 5").select("sample_id", "qa", "context_ids", F.lit("elephants").alias("prediction"), F.lit(1.0).alias("token_f1"))
    again = jobs.run_variant(g, q, keys, v, R.VARIANTS[1], checkpoint=kept)
    assert again.where("qa = 1 and k = 5").first()["token_f1"] == 1.0
    rolled = jobs.ablation(g, q, keys, v, R.VARIANTS[:2])
    assert "gate" in jobs.summarize(rolled)[0] and {r["variant"] for r in rolled.collect()} == {"A", "B"}
    assert jobs.retrieve_all(g, q, keys, v).count() == 2
    p = spark.createDataFrame([("s1", "fine", "fine", ["D1:4"])], "sample_id string, question string, prediction string, ids array<string>")
    f1, cut = jobs.score_frozen(p, q)
    assert f1.where("category is null").first()["token_f1_pct"] == 100.0 and cut.count() == 0  # no gold: left out
    done = jobs.answer_again(q.withColumn("context", F.lit("elephants")), lambda: E.first_line_reader)
    assert done.where("qa = 1").first()["token_f1"] == 1.0 and done.first()["gate"] == "full_writeup"
    unit = spark.createDataFrame([("s1", '{"session_1": {"A": [["remarkable elephants", "D1:1"]]}}', None)], "sample_id string, observation string, session_summary string")
    per, overall = jobs.run_units(q, unit, "observation", 5)
    assert per.where("qa = 1").first()["hit"] and overall.where("category is null").first()["n"] == 2


def test_time_word_detection(spark):
    from recallery.functions.text import time_words

    df = spark.createDataFrame([("Yesterday, LAST WEEKEND and todays",)], "t string")
    assert df.select(time_words("t")).first()[0] == ["yesterday", "last weekend"]


def test_bm25_porter_asks_every_language(spark, tmp_path):
    docs = [(1, "running horses jump fences", "en"), (2, "running horses jump fences", "fr"), (3, "other words stand here", "fr"), (4, "running horses jump fences", None), (5, "other words stand here", "en"), (6, "other words stand here", None), (7, "third of many", "en"), (8, "third of many", "fr"), (9, "third of many", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "horse run")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = catalog.bm25_porter(spark, str(tmp_path)).collect()
    assert {r["doc"]: r["score"] for r in got} == {"1": 1.0, "2": 1.0, "4": 1.0}


def test_clients():
    from recallery.operators import clients as K

    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 4:
            raise OSError("busy")
        return x

    assert K.retrying(flaky, 5, sleep=waits.append)("a") == "a" and waits == [0.75, 1.5, 3.0]
    with pytest.raises(OSError):
        K.retrying(lambda: open("/no/such/file"), 2, sleep=waits.append)()
    assert K.ask(lambda p: p, "x", tokens=5) == "x" and K.ask(lambda p, tokens: (p, tokens), "x", tokens=5, temperature=1) == ("x", 5) and K.ask(lambda p, **s: sorted(s), "x", a=1, b=2) == ["a", "b"]
    assert K.named({"small": lambda: len}, "s", {"s": "small"})("abc") == 3
    with pytest.raises(ValueError):
        K.named({}, "large")
    assert K.with_examples(lambda p: p, [("1+1", "2")])("2+2") == "1+1\n2\n\n2+2"
    said = iter(["no", "{", '{"a": 1}'])
    assert K.json_trials(lambda p: next(said), "x") == {"a": 1}
    with pytest.raises(ValueError):
        K.json_trials(lambda p: "no", "x", 2)


def test_calls_under_way():
    import threading
    import time

    from recallery.operators import clients as K

    busy, most, lock = [0], [0], threading.Lock()

    def call(x):
        with lock:
            busy[0] += 1
            most[0] = max(most[0], busy[0])
        time.sleep(0.05)
        with lock:
            busy[0] -= 1
        if x % 10 == 3:
            raise OSError(x)
        return x * x

    took = {}
    for window in (1, 8):
        began = time.time()
        got = list(K.in_order(call, range(48), window))
        took[window] = time.time() - began
        assert [(r, type(e).__name__) for r, e in got] == [(None, "OSError") if x % 10 == 3 else (x * x, "NoneType") for x in range(48)]
    assert took[1] > 5 * took[8] and most[0] == 8
    # who stops reading stops the calls
    for _ in K.in_order(call, iter(range(10**9)), 4):
        break
    now, waits = [10.0], []
    rate = K.Rate(4, lambda: now[0], waits.append)
    for _ in range(3):
        rate.wait()
    assert waits == [0.0, 0.25, 0.5]


def test_a_failing_text_leaves_its_batch_alone(spark):
    def make():
        def client(prompt):
            if prompt.endswith("bad"):
                raise OSError("down")
            return json.dumps([{"value": prompt[-3:], "type": "What"}])

        return client

    df = spark.createDataFrame([("one",), ("bad",), ("two",)], "t string").coalesce(1)
    got = {r["t"]: r["items"] and r["items"][0]["value"] for r in extract.model_extractor(make, 2)(df, "t").collect()}
    assert got == {"one": "one", "bad": None, "two": "two"}
    with pytest.raises(Exception, match="down"):
        extract.model_extractor(make, 2)(df.where("t = 'bad'"), "t").collect()


def test_encoders(spark, tmp_path):
    import numpy as np

    t = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "t string")
    cache = store.embedding_cache(spark, str(tmp_path / "c"))
    found, n = dense.embed_cached(t, "t", cache)
    assert (found.count(), n) == (3, 3) and dense.embed_cached(t, "t", cache)[1] == 0
    assert dense.embed_cached(t, "t", cache, role="query")[1] == 3 and dense.embed_cached(t, "t", cache, dense.Encoder("other"))[1] == 3
    api = dense.api_encoder("api", lambda texts: np.ones((len(texts), 4)), 4)
    dual = dense.dual_encoder("dual", lambda texts: np.ones((len(texts), 2)), lambda texts: -np.ones((len(texts), 2)), 2)
    assert (api.query_role, dual.query_role) == ("context", "query")
    assert dense.embed_cached(t, "t", cache, api)[0].first()["vec"] == [0.5] * 4
    assert dense.embed_cached(t, "t", cache, dual, "query")[0].first()["vec"][0] > 0 > dense.embed_cached(t, "t", cache, dual)[0].first()["vec"][0]
    for bad in (lambda texts, role: np.ones((len(texts) + 1, 64)), lambda texts, role: np.ones((len(texts), 63))):
        with pytest.raises(Exception, match="vectors"):
            dense.embed_cached(t, "t", cache, dense.Encoder("bad", bad))


def test_stored_index(spark, tmp_path):
    from recallery.plans import jobs

    g, path = worked(spark)[0], str(tmp_path / "i")
    assert store.load_index(spark, path) is None
    cache = store.embedding_cache(spark, str(tmp_path / "c"))
    index, n = jobs.build_index(g.memory, path, cache)
    assert n == 3 and jobs.build_index(g.memory, path, cache)[1] == 0 and dense.index_matches(index, g.memory, "hashed").first()["matches"]
    assert not dense.index_matches(index, g.memory.limit(2), "hashed").first()["matches"] and not dense.index_matches(index, g.memory, "other").first()["matches"]
    # an index gives what it holds to an empty cache
    other = store.embedding_cache(spark, str(tmp_path / "c2"))
    assert jobs.build_index(g.memory, path, other)[1] == 0 and other.read().count() == 3
    index.drop("text_digest").write.parquet(str(tmp_path / "old"))
    index.withColumn("format", F.lit(1)).write.parquet(str(tmp_path / "one"))
    assert store.load_index(spark, str(tmp_path / "old")) is None and store.load_index(spark, str(tmp_path / "one")) is None
    with pytest.raises(ValueError):
        store.save_index(index.withColumn("text_digest", F.lit(None).cast("string")), str(tmp_path / "x"))


def test_keys_and_resume(spark, tmp_path):
    from recallery.plans import jobs

    (tmp_path / "s_qkeys_a.json").write_text('{"1": ["ann"]}')
    a, b = str(tmp_path / "s_qkeys_a.json"), str(tmp_path / "s_qkeys_b.json")
    assert [store.question_keys(spark, *p).count() for p in ((b, a), (a, b), (b,))] == [1, 1, 0]
    q = spark.createDataFrame([("s", 1, "fails"), ("s", 2, "Ann and tea"), ("s", 3, "nothing"), ("s", 4, " ")], "sample_id string, qa int, question string")
    found = {"fails": None, "Ann and tea": [("Ann's", "Who"), ("ANN", "Who"), ("Tea", "What")], "nothing": []}
    keys, n, failed = jobs.question_keys(q, str(tmp_path / "k"), fixed(found))
    assert ({(r["qa"], r["qkey"]) for r in keys.collect()}, n, failed) == ({(2, "ann"), (2, "tea")}, 2, 1)
    keys, n, failed = jobs.question_keys(q, str(tmp_path / "k"), fixed(found | {"fails": [("Bob", "Who")]}))
    assert (keys.count(), n, failed) == (3, 1, 0)


def test_frozen_scores_count_each_prediction_once(spark):
    from recallery.plans import jobs

    q = spark.createDataFrame([("s", 1, "same?", "a", ["D1:1"], 1), ("s", 2, "same?", "b", ["D1:2"], 2), ("s", 3, "other?", "c", ["D1:3"], 5), ("s", 4, "none?", "d", [], 1)], schema.QUESTION)
    p = spark.createDataFrame(
        [("s", "same?", "b", ["D1:2"], 0.75), ("s", "same?", "x", ["D1:9"], None), ("s", "other?", "c", ["D1:1"], None), ("s", "other?", "c", [], None), ("s", "none?", "d", ["D1:1"], None)],
        "sample_id string, question string, prediction string, ids array<string>, token_f1 double",
    )
    f1, cut = jobs.score_frozen(p, q)
    got = {(r["k"], r["category"]): (r["n"], r["recall_acc"], r["token_f1_pct"]) for r in cut.collect()}
    assert got[25, None] == (3, 33.33, 58.33) and got[5, 2] == (2, 50.0, None) and {k for k, _ in got} == {5, 10, 25}
    assert {r["category"]: r["n"] for r in f1.collect()} == {None: 4, 1: 1, 2: 2, 5: 1}


def test_one_sample_is_read_from_its_folder(spark, tmp_path):
    g = worked(spark)[0]
    store.save_graph(g, str(tmp_path / "g"))
    assert store.load_graph(spark, str(tmp_path / "g"), "s").memory.count() == 3 and store.load_graph(spark, str(tmp_path / "g"), "t").memory.count() == 0


def test_scratch_folder_of_a_cluster(spark, monkeypatch):
    from recallery.sources import scratch

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    with pytest.raises(ValueError):
        scratch.root(Session())
    assert str(scratch.folder(spark)).endswith(spark.sparkContext.applicationId)


def test_stop_word_profiles(spark):
    df = spark.createDataFrame([("s", "1", "those running dogs", "x"), ("s", "2", "cats", "x"), ("s", "3", "birds", "x")], "sample_id string, doc string, text string, key string")
    terms = lambda p: {r["term"] for r in lexical.index(df, p).terms.collect()}
    assert "those" in terms("plain") and "those" not in terms("english") and terms("porter_english") == {"run", "dog", "cat", "bird"}
    with pytest.raises(ValueError):
        lexical.tokens(F.col("text"), "other")


def test_items_are_computed_once_for_each_turn(spark):
    """A filter that the optimizer makes of an exploded list must not repeat the extraction."""
    rows = [("s", 1, "8 May 2023", 0, "D1:1", "Ann", "I saw you yesterday", "", "", ""), ("s", 1, "8 May 2023", 1, "D1:2", " ", "fine", "", "", "")]
    found = G.extracted(G.turns(spark.createDataFrame(rows, schema.DIALOG)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert sorted((r["dia_id"], r["key"]) for r in found.collect()) == [("D1:1", "2023"), ("D1:1", "ann")]
