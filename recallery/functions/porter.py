"""The Porter stemmer (Porter, 1980) as Column expressions over token arrays, so stemming stays in the JVM.

With the extensions of the reimplementation that most Python users have: words of one or two letters stay, some irregular words
have their stem by a list, and short words in -ies, -ied and -y, words in -ally, -fully and -logy are treated with more care.

A y is a vowel after a consonant. Such ones are written Y first, and as rules change only ends that hold none, vowels and
consonants can be told by their letters from then on. The measure of a stem, how often vowels are followed by
consonants, is then a regular expression, alike in Java and in RE2: the same steps can be written in other SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix rules of steps 2, 3 and 4, and irregular words.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
IRREGULAR = {"skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed", "sky": "sky"}

_V, _C = "[aeiouY]", "[^aeiouY]"
#: The vowels written so, a stem of measure 1 or more, one of 2 or more, and a short end: consonant, vowel, consonant but w, x or y.
VOWEL_Y = "([^aeiou])y"
ONE, TWO = f"{_C}*{_V}+{_C}.*", f"{_C}*{_V}+{_C}+{_V}+{_C}.*"
SHORT_END = f"({_C}{_V}[^aeiouYwxy]|^{_V}{_C})$"
#: A stem of measure 1 that ends so.
SHORT_ONE = f"^({_C}+{_V}[^aeiouYwxy]|{_V}{_C})$"
#: What stands for a removed -ed or -ing until the stem is mended.
CUT = "+"


class Dialect:
    """How one SQL writes the few functions that the steps need, over expressions of its own kind."""

    def __init__(self, when: Callable, ends: Callable, replaced: Callable, matches: Callable, without: Callable, last: Callable, joined: Callable):
        self.when, self.ends, self.replaced, self.matches = when, ends, replaced, matches
        self.without, self.last, self.joined = without, last, joined


def _rules(d: Dialect, w, rules, least: str):
    """The longest suffix that a word has decides; it is replaced where the stem's measure is enough."""
    return d.when([(d.ends(w, s), d.replaced(w, f"^({least}){s}$", put)) for s, put in sorted(rules, key=lambda r: -len(r[0]))], w)


def steps(d: Dialect) -> list[Callable]:
    """The steps in order, each from a word to a word."""
    ion = lambda w: (d.ends(w, "sion"), d.ends(w, "tion"))
    mended = lambda w: d.when([(d.ends(w, x + CUT), d.joined(d.without(w, 1), "e")) for x in ("at", "bl", "iz")] + [
        (d.matches(w, f"{_C}{_C}[{CUT}]$", d.last(w, 1), d.last(w, 2)), d.when([(d.matches(w, f"[lsz][{CUT}]$"), d.without(w, 1))], d.without(w, 2))), (d.matches(w, f"Yy[{CUT}]$"), d.without(w, 2)),
        (d.matches(d.without(w, 1), SHORT_ONE), d.joined(d.without(w, 1), "e")),
    ], d.without(w, 1))
    return [
        lambda w: d.replaced(w, VOWEL_Y, "Y"),
        lambda w: d.when([(d.matches(w, "^.ies$"), d.without(w, 1)), (d.ends(w, "sses"), d.without(w, 2)), (d.ends(w, "ies"), d.without(w, 2)), (d.ends(w, "ss"), w), (d.ends(w, "s"), d.without(w, 1))], w),
        lambda w: d.when([(d.matches(w, "^.ied$"), d.without(w, 1)), (d.ends(w, "ied"), d.without(w, 2)), (d.ends(w, "eed"), d.replaced(w, f"^({ONE})eed$", "ee"))] + [(d.ends(w, s), d.replaced(w, f"^(.*{_V}.*){s}$", CUT)) for s in ("ed", "ing")], w),
        lambda w: d.when([(d.ends(w, CUT), mended(w))], w),
        lambda w: d.replaced(w, f"^(.+{_C})Y$", "i"),
        lambda w: d.replaced(w, f"^({ONE})alli$", "al"),
        # of -logi the l counts with the stem
        lambda w: d.when([(d.ends(w, "logi"), d.replaced(w, f"^({ONE})ogi$", "og"))], _rules(d, w, STEP_2, ONE)),
        lambda w: _rules(d, w, STEP_3, ONE),
        lambda w: d.when([(c, d.replaced(w, f"^({TWO})ion$", "")) for c in ion(w)] + [(d.ends(w, "ion"), w)], _rules(d, w, [(s, "") for s in STEP_4 if s != "ion"], TWO)),
        lambda w: d.when([(d.ends(w, "e"), d.when([(d.matches(d.without(w, 1), f"^{TWO}$"), d.without(w, 1)), (d.matches(d.without(w, 1), SHORT_END), w), (d.matches(d.without(w, 1), f"^{ONE}$"), d.without(w, 1))], w))], w),
        lambda w: d.when([(d.ends(w, "ll"), d.replaced(w, f"^({TWO})l$", ""))], w),
    ]


def _case(choices: list, otherwise: Column) -> Column:
    out = F.when(*choices[0])
    for c in choices[1:]:
        out = out.when(*c)
    return out.otherwise(otherwise)


#: The steps as Columns. ``replaced`` keeps the first group and puts something behind it.
SPARK = Dialect(
    when=_case,
    ends=lambda w, s: w.endswith(s),
    replaced=lambda w, pattern, put: F.regexp_replace(w, pattern, f"$1{put}"),
    matches=lambda w, pattern, *equal: w.rlike(pattern) & (equal[0] == equal[1]) if equal else w.rlike(pattern),
    without=lambda w, n: F.substring(w, F.lit(1), F.length(w) - n),
    last=lambda w, back: F.substring(w, F.length(w) - back, F.lit(1)),
    joined=lambda w, tail: F.concat(w, F.lit(tail)),
)


def stemmed(tokens: Column) -> Column:
    """Each token of an array stemmed. Tokens are lower case."""
    out = tokens
    for step in steps(SPARK):
        out = F.transform(out, step)
    listed = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    stem = lambda o, s: F.when(F.length(o) <= 2, o).when(o.isin(*IRREGULAR), F.try_element_at(listed, o)).otherwise(F.replace(s, F.lit("Y"), F.lit("y")))
    return F.zip_with(tokens, out, stem)
