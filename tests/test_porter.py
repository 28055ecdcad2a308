"""The stemmer as Columns against a loop over letters."""

import random

import pytest
from pyspark.sql import functions as F

from recallery.functions import porter

KNOWN = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "enjoy": "enjoy", "by": "by",
    "relational": "relat", "generalization": "gener", "oscillators": "oscil", "sky": "sky", "skies": "sky", "controlling": "control", "at": "at", "died": "die", "cried": "cri", "dying": "die", "geology": "geolog", "theology": "theolog",
    "hopefully": "hope", "rationally": "ration", "sensationally": "sensat", "syzygy": "syzygi", "using": "use", "used": "use", "feed": "feed", "proceed": "proceed", "roll": "roll", "probate": "probat", "cease": "ceas", "adoption": "adopt", "vision": "vision", "as": "as", "": "",
}


def consonant(w, i):
    return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not consonant(w, i - 1))


def m(w):
    kinds = "".join("c" if consonant(w, i) else "v" for i in range(len(w)))
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


def cvc(w):
    n = len(w)
    return (n >= 3 and consonant(w, n - 3) and not consonant(w, n - 2) and consonant(w, n - 1) and w[-1] not in "wxy") or (n == 2 and not consonant(w, 0) and consonant(w, 1))


def by_rules(w, rules):
    for s, put, fits in rules:
        if w.endswith(s):
            stem = w[: len(w) - len(s)]
            return stem + put if fits(stem) else w
    return w


def loop(w):
    if w in porter.IRREGULAR:
        return porter.IRREGULAR[w]
    if len(w) <= 2:
        return w
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    else:
        w = by_rules(w, [("sses", "ss", bool), ("ies", "i", lambda s: True), ("ss", "ss", lambda s: True), ("s", "", lambda s: True)])
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        stem = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and any(not consonant(w, i) for i in range(len(w) - len(s)))), None)
        if stem is not None:
            w = stem
            if stem.endswith(("at", "bl", "iz")):
                w = stem + "e"
            elif len(stem) >= 2 and stem[-1] == stem[-2] and consonant(stem, len(stem) - 1):
                w = stem if stem[-1] in "lsz" else stem[:-1]
            elif m(stem) == 1 and cvc(stem):
                w = stem + "e"
    if w.endswith("y") and len(w) > 2 and consonant(w, len(w) - 2):
        w = w[:-1] + "i"
    some, more = lambda s: m(s) > 0, lambda s: m(s) > 1
    while w.endswith("alli") and m(w[:-4]) > 0:
        w = w[:-2]
    w = by_rules(w, [("logi", "log", lambda s: m(s + "l") > 0)] + [(a, b, some) for a, b in sorted(porter.STEP_2, key=lambda r: -len(r[0]))])
    w = by_rules(w, [(a, b, some) for a, b in sorted(porter.STEP_3, key=lambda r: -len(r[0]))])
    w = by_rules(w, [(a, "", (lambda s: m(s) > 1 and s[-1] in "st") if a == "ion" else more) for a in sorted(porter.STEP_4, key=lambda s: -len(s))])
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and m(w[:-1]) > 1 else w


def stems(spark, words):
    row = spark.createDataFrame([(words,)], "t array<string>").select(porter.stemmed(F.col("t")).alias("s")).first()
    return dict(zip(words, row["s"], strict=True))


def test_known_words(spark):
    assert {w: loop(w) for w in KNOWN} == KNOWN
    assert stems(spark, list(KNOWN)) == KNOWN
    assert spark.createDataFrame([(None,), ([],)], "t array<string>").select(porter.stemmed(F.col("t")).alias("s")).collect() == [(None,), ([],)]


@pytest.mark.parametrize("seed", [1, 2])
def test_stems_against_a_loop(spark, seed):
    rng = random.Random(seed)
    ends = ["", "s", "es", "ed", "ing", "y", "ies", "ied", "eed", "e", "ll", "ly", "logy", "alli", "ally", "fully", "yy", *(a for a, _ in porter.STEP_2 + porter.STEP_3), *porter.STEP_4]
    letters = "aeiouybcdfglmnprstvwxz7"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(0, 7))) + "".join(rng.choice(ends) for _ in range(rng.randrange(1, 3))) for _ in range(6000)}
    got = stems(spark, sorted(words))
    assert {w: s for w, s in got.items() if s != loop(w)} == {}
