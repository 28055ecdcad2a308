"""Periodic runs of words by heavy/light lag counting.

A run is a maximal stretch of consecutive words with smallest period q (words q apart are
identical) and at least max(LEAST, 3 q) words. For each text:

1. Lag counts: how many words equal the word q places on, for every lag q. Words that occur
   often (heavy) are counted by an exact autocorrelation, the inverse FFT of the summed
   power spectra of where each stands; the others (light) by the differences of their places.
2. A run of period q holds max(LEAST - q, 2 q) consecutive matches at lag q, so lags with fewer
   have none. Lags are taken in order. Every multiple of a run's period matches inside that run,
   and no other run of the multiple can share a match there (two periods that overlap so far
   would make one); those matches are subtracted before a lag is judged.
3. What is left gets an island scan: of any so many consecutive matches one aligned block of half
   as many lies inside, so blocks are probed first, and only islands around a whole block are
   followed to both ends. Islands inside a run of a period that divides the lag are that
   run again and passed over.

The cost is n log n for a text of n words and each heavy word, whose number is bounded by n over
their least count, plus n / q probes for each lag q that is left.

Edge cases: null and empty texts have no words and no runs; texts of fewer than LEAST words have no run;
a very long text is taken whole, in one task; repeated rows get equal results; of runs with equal exponents the one
that starts first is the strongest, then the one with the smaller period; an empty table gives an empty
result; columns beside the text are carried as they are, but n_words, runs and collapsed are those of the result. In the
query a null doc_id counts as the text "null" and is null in the result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.llm import kernels as K
from recallery.llm.common import table, through_arrow, words

#: Words of a run at least, and how many periods.
LEAST, TIMES = 24, 3
#: A word is heavy from this count on, at least; the bound grows with the square root of the text.
HEAVY = 48
#: Bytes of text that go through a task's memory at a time.
PIECE = 1 << 20


def lag_counts(number: np.ndarray, most: int, heavy: int | None = None) -> np.ndarray:
    """For each lag up to ``most`` how many words equal the one so many places on. ``number``: a number for each word."""
    n = len(number)
    heavy = heavy or max(HEAVY, int(np.sqrt(n)) // 2)
    counts = np.zeros(most + 1, np.int64)
    often = np.bincount(number)
    order = np.argsort(number, kind="stable")
    light = order[often[number[order]] < heavy]
    of = number[light]
    for step in range(1, min(heavy, len(light))):
        same = of[step:] == of[:-step]
        if not same.any():
            break
        lag = (light[step:] - light[:-step])[same]
        counts += np.bincount(lag[lag <= most], minlength=most + 1)
    size = 1 << int(n + most).bit_length()
    power = 0.0
    for word in np.flatnonzero(often >= heavy):
        spectrum = np.fft.rfft((number == word).astype(np.float64), size)
        power = power + spectrum.real**2 + spectrum.imag**2
    if not np.isscalar(power):
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    counts[0] = 0
    return counts


def _reach(number: np.ndarray, lag: int, at: int, forward: bool) -> int:
    """How many matches at a lag follow ``at`` (itself first), or come before it, in growing steps."""
    n, done, step = len(number) - lag, 0, 64
    while True:
        a, b = (at + done, min(at + done + step, n)) if forward else (max(at - done - step, 0), at - done)
        if a >= b:
            return done
        other = number[a:b] != number[a + lag : b + lag]
        if other.any():
            return done + int(other.argmax() if forward else other[::-1].argmax())
        done, step = done + b - a, step * 2


def runs_of(number: np.ndarray, least: int = LEAST, times: int = TIMES, heavy: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text, by start and period."""
    n = len(number)
    most = n // times
    if n < least or not most:
        return []
    lags = np.arange(most + 1)
    need = np.maximum(least - lags, (times - 1) * lags)
    left = lag_counts(number, most, heavy)
    # by period: where its runs start and end
    starts: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    out = []
    candidates = np.flatnonzero(left >= need)
    for lag in candidates[candidates > 0].tolist():
        if left[lag] < need[lag]:
            continue  # what matched lies in runs of shorter periods
        asked = int(need[lag])
        block = (asked + 1) // 2
        at = np.arange(0, n - lag - block + 1, block)
        for probe in (0, block // 2, block - 1, block // 4, 3 * block // 4):
            at = at[number[at + probe] == number[at + probe + lag]]
        inner = [p for p in starts if lag % p == 0]
        end = -1
        for j in at.tolist():
            if j < end or any((k := bisect_right(starts[p], j)) and ends[p][k - 1] >= j + block + lag for p in inner):
                continue
            ahead = _reach(number, lag, j, True)
            if ahead < block:
                continue
            begin, end = j - _reach(number, lag, j, False), j + ahead
            if end - begin >= asked:
                length = end - begin + lag
                out.append((begin, length, lag))
                starts.setdefault(lag, []).append(begin)
                ends.setdefault(lag, []).append(begin + length)
                twice = lags[2 * lag :: lag]
                left[twice] -= np.maximum(length - twice, 0)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _searched(least: int, times: int):
    def run(column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        _, at = K.texts(column)
        for i, j in K.pieces(at, PIECE):
            sizes, lists, collapsed = [], [], []
            for text in column.slice(i, j - i):
                # bytes.split() parts at exactly the separators of a plain word
                split = (text.as_py() or "").encode().split()
                known: dict[bytes, int] = {}
                number = np.array([known.setdefault(w, len(known)) for w in split], np.int64)
                # all words different: no run
                found = runs_of(number, least, times) if len(known) < len(split) else []
                sizes.append(len(split))
                lists.append([{"start": a, "length": b, "period": c} for a, b, c in found])
                if found:
                    split = [w for w, k in zip(split, kept(len(split), found).tolist(), strict=True) if k]
                collapsed.append(b" ".join(split).decode())
            yield i, j - i, [pa.array(sizes, pa.int64()), pa.array(lists, _RUNS), pa.array(collapsed, pa.string())]

    return run


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """All columns of ``docs``, with n_words, runs (start, length, period, by start and period) and collapsed, the words
    that no run repeats, joined by one space. ``least``: words of a run; ``times``: how often a period stands in it, both at least."""
    if times < 2 or least < 1:
        raise ValueError("a run needs two periods and a word at least")
    results = [("n_words", "long"), ("runs", "array<struct<start:long,length:long,period:long>>"), ("collapsed", "string")]
    return through_arrow(docs, text, _searched(least, times), results)


def planted(text: Column, doc_id: Column) -> Column:
    """The text as the contract changes it: of a tenth of the documents, chosen by a checksum h of the id, the words from a on
    are those of the p words from a on, over and over."""
    ws = words(text)
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    # the words are bound to a name, so they are split once and not for each word
    return F.when((h % 10 == 0) & (F.size(ws) > 0), F.get(F.transform(F.array(ws), repeated), 0)).otherwise(text)


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    # the one with the most periods, then the first, then the one of the smaller period; exact fractions by cross products
    best = F.aggregate("runs", F.get("runs", 0), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    shown = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * b.length div b.period").alias("exponent_milli")
    return shown.select("doc_id", "n_runs", "b.start", "b.length", "b.period", exponent, "runs_sha256", "collapsed_sha256")
