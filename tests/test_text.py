from datetime import date

import pytest
from pyspark.sql import functions as F

from recallery.functions import metrics as M
from recallery.functions import text as X


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'date' if isinstance(v, date) else 'string'}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], kinds)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "key", "value"),
    [("  Caroline's ", "caroline", "Caroline"), ("Mel's.", "mel's.", "Mel's"), ("Support   Group", "support group", "Support Group"), ('"Paris!"', '"paris!"', "Paris"), (None, "", "")],
)
def test_keys_and_values(spark, raw, key, value):
    assert one(spark, X.entity_key("a"), a=raw) == key
    assert one(spark, X.entity_value("a"), a=raw) == value


@pytest.mark.parametrize(
    ("text", "speaker", "previous", "said", "want"),
    [
        ("I went to a LGBTQ support group yesterday", "Caroline", "Melanie", "1:56 pm on 8 May, 2023", "Caroline went to a LGBTQ support group 7 May 2023"),
        ("You gave me your book", "Ann", "Bob", "", "Bob gave Ann Bob's book"),
        ("I'm proud of myself", "Ann", None, "", "Ann'm proud of Ann"),
        ("Is that yours or mine?", "Ann", "Bob", "", "Is that Bob's or Ann's?"),
        ("Is that yours?", "Ann", None, "", "Is that yours?"),
        ("", "Ann", "Bob", "8 May 2023", ""),
        ("I paid", "A$1\\b", None, "", "A$1\\b paid"),
        ("last week and last weekend", "", "", "8 May 2023", "1 May 2023 and 1 May 2023"),
        ("yesterday", "Ann", None, "31 February 2023", "yesterday"),
        ("éI said I", "Bo", None, "", "éI said Bo"),
    ],
)
def test_normalized(spark, text, speaker, previous, said, want):
    assert one(spark, X.normalized("t", F.col("s"), F.col("p"), F.col("d")), t=text, s=speaker, p=previous, d=said) == want


def test_own_time_words(spark):
    assert one(spark, X.normalized("t", F.lit(""), F.lit(""), F.lit("8 May 2023"), ["last monday"]), t="Last   Monday, today") == "1 May 2023, today"


@pytest.mark.parametrize(
    ("word", "anchor", "want"),
    [("yesterday", "8 May 2023", "7 May 2023"), ("last month", "31 March 2023", "1 March 2023"), ("next month", "31 January 2023", "28 February 2023"), ("next month", "31 December 2023", "28 January 2024"), ("a year ago", "29 February 2024", "28 February 2023"), ("last monday", "8 May 2023", "1 May 2023"), ("last sunday", "8 May 2023", "7 May 2023"), ("next week", "8 May 2023", None)],
)
def test_time_words(spark, word, anchor, want):
    assert one(spark, X.shown_date(X.time_word_date("w", X.dialog_date("a"))), w=word, a=anchor) == want


def test_documents_and_lines(spark):
    assert one(spark, X.entity_document("k", "v"), k="ann", v="Ann") == "ann"
    assert one(spark, X.entity_document("k", "v"), k="ann", v="Anna") == "ann Anna"
    assert one(spark, X.entity_document("k", "v"), k=None, v="Anna") == "Anna"
    assert one(spark, X.dialog_line("s", "t", "c"), s="Ann", t="hi", c=" cat ") == 'Ann said, "hi" and shared cat'
    assert one(spark, X.extraction_text("n", "q", "c"), n="hi", q=" ", c="cat") == "hi [Image: cat]"
    assert one(spark, X.search_text("n", "t", "s", "c", "q"), n="a", t="b", s="c", c=None, q="d") == "a b c  d"
    assert "Not mentioned" in one(spark, X.answer_prompt("q", F.lit(5), "c"), q="why", c="")
    assert one(spark, X.answer_prompt("q", F.lit(2), "c"), q="when", c="") .startswith("(no retrieved dialogs)\n\n")


def test_metrics(spark):
    f1 = lambda g, p: one(spark, M.token_f1("g", "p"), g=g, p=p)
    assert f1("7 May 2023", "May 7, 2023") == 1.0
    assert f1("a a b", "a") == pytest.approx(2 / 3)
    assert (f1("", ""), f1("x", ""), f1("x", "y")) == (1.0, 0.0, 0.0)
    assert one(spark, M.recall_at(F.col("g"), F.col("f")), g=["D1:1", "D1:1", "D2:3"], f=["D1:1"]) == pytest.approx(2 / 3)
    assert one(spark, M.recall_at(F.col("g"), F.col("f")), g=[], f=["x"]) == 1.0
    assert one(spark, M.recall_at(F.col("g"), F.col("f"), "skip"), g=[], f=["x"]) is None
    assert one(spark, M.hit_at(F.col("g"), F.col("f")), g=[], f=[]) is True
    assert one(spark, M.degree_weight(F.lit(1)), a="") == pytest.approx(1.442695, abs=1e-6)
    assert one(spark, M.clipped(F.lit(float("nan"))), a="") == 0.0
