"""Substring dedup with prefix-partitioned suffix trees.

Words covered by a window of DEPTH consecutive words that also starts earlier (smaller
doc_id, or earlier in the document) are removed. Equal windows are leaves under one
internal node, DEPTH words deep, of the suffix tree over all documents. That tree is never
built whole:

1. Every window owns an anchor: its k-gram of GRAM words with the smallest fingerprint,
   which depends on nothing outside the window. Only windows whose anchor occurs twice
   anywhere can repeat. Fingerprints are compared in packed pieces, a row for each task
   and bucket; a task sends each fingerprint once, however often it holds it.
2. Suffixes go to groups by a prefix of variable length. It is GRAM words long, the
   anchor, in general; neighbouring suffixes have one anchor and travel together, so each
   word is sent about four times and not DEPTH times. A prefix with more than GROUP / 4
   occurrences in all is extended to DEPTH words: each of its suffixes goes by its own
   whole window, so one frequent phrase with many surroundings is spread over the tasks.
   Equal stretches within a task are sent once, the others are repeats.
3. In each group the words are numbered by their bytes and the suffixes sorted with their
   longest common prefixes, which gives the subtree; under each internal node DEPTH words
   deep all leaves but the first mark repeats. Runs of marked words are the maximal
   repeats to remove.

Edge cases: null and empty texts have no words; texts shorter than DEPTH words lose
nothing; very long texts and words are taken whole, a text in one task; rows that share both
doc_id and text are one document; rows that share a doc_id but not the text are documents of
their own, of which the one with the smaller hash of its text is earlier; rows without a doc_id are kept whole and
earlier than nothing; ties don't arise, since the first leaf is the smallest (doc_id, hash,
start); an empty table gives an empty result; other columns, whatever their names, are not
used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.llm import kernels as K
from recallery.llm.common import cut, small_batches, table

#: What tells documents apart: the id, and a hash of the text for texts that share one.
DOC = ["doc_id", "key"]
#: Words of a window and of an anchor.
DEPTH, GRAM = 20, 8
#: Suffixes of one subtree, anchors packed at a time, and bytes of text for each bucket.
GROUP, PACKED, BUCKET_BYTES = 200_000, 1_500_000, 16 << 20
#: Buckets and tasks of a shuffle at most; beyond, a task reads several buckets, one after another.
MOST_BUCKETS, MOST_TASKS = 400_000, 50_000
#: Stretches looked through for repeats before they are sent.
LOCAL = 120_000
#: Runs to remove, and frequent anchors, up to which their table is broadcast.
BROADCAST_RUNS, BROADCAST_ANCHORS = 1_000_000, 1_000_000


def owners(h: np.ndarray, row: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor and its fingerprint, for each stretch of windows with one anchor."""
    n = len(h) - depth + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, K.U),)
    m = len(h) - gram + 1
    total = h[:m] * K._ODD[0]
    for j in range(1, gram):
        total += h[j : m + j] * K._ODD[j]
    prints = K.mix(total)
    start = np.flatnonzero(row[:n] == row[depth - 1 :])
    least = np.lib.stride_tricks.sliding_window_view(prints, depth - gram + 1)
    owner = start + least[start].argmin(1)
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return start[at], np.diff(np.append(at, len(start))), owner[at], prints[owner[at]]


def _within(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Word numbers within their rows."""
    return at - np.searchsorted(row, row[at])


#: Columns of packed fingerprints.
_PACKED = ["bucket", "prints", "times", "docs", "keys", "places"]


def _anchors(depth: int, buckets: int):
    """Packed fingerprints by bucket, and (doc_id, anchor) of those that repeat within a task's piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out():
            prints, docs, keys, places = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(prints, kind="stable")
            prints, docs, keys, places = prints[order], docs[order], keys[order], places[order]
            new = np.ones(len(prints), bool)
            new[1:] = prints[1:] != prints[:-1]
            twice = ~new
            twice[:-1] |= ~new[1:]
            bucket = (prints[new] >> K.U(40)) % K.U(buckets)
            firsts = np.flatnonzero(new)
            times = np.diff(np.append(firsts, len(prints))).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            found, begin = np.unique(bucket[by], return_index=True)
            rows = np.split(by, begin[1:])
            pack = lambda x: pa.array([x[at].tobytes() for at in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pack(prints[firsts]), pack(times), pack(docs[firsts]), pack(keys[firsts]), pack(places[firsts])], names=_PACKED)
            if twice.any():
                # already known to repeat; sent on by document
                one = np.flatnonzero(twice)
                none = pa.array([None], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), none, none, *(pa.array([x[one].tobytes()], pa.binary()) for x in (docs, keys, places))], names=_PACKED)

        for batch in batches:
            ids, named = (batch.column(c).to_numpy() for c in DOC)
            for first, _, row, _, _, h, _ in K.hashed(batch.column("text")):
                _, _, owner, prints = owners(h, row, depth)
                held.append((prints, ids[first + row[owner]], named[first + row[owner]], _within(row, owner).astype(np.int32)))
                size += len(owner)
                if size > PACKED:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    return run


_ANCHOR = "doc_id long, key long, place long, print long"


def _shared(most: int):
    """(doc_id, anchor) of fingerprints that occur twice at least, and the fingerprints that occur more often than ``most`` (without a doc_id)."""
    from recallery.llm.jaccard import runs

    def rows(docs, keys, places):
        for k in range(0, len(docs), 50_000):
            part = docs[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(keys[k : k + 50_000]), pa.array(places[k : k + 50_000].astype(np.int64)), pa.nulls(len(part), pa.int64())], names=["doc_id", "key", "place", "print"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []

        def parts():
            for batch in batches:
                mark = np.array(batch.column("bucket")) < 0
                for i in np.flatnonzero(mark):
                    ready.extend(rows(*(np.frombuffer(batch.column(c)[int(i)].as_py(), kind) for c, kind in (("docs", np.int64), ("keys", np.int64), ("places", np.int32)))))
                yield batch.filter(pa.array(~mark))

        for part in runs(parts(), "bucket"):
            yield from ready
            ready.clear()
            whole = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in part.column(name).to_pylist()])  # noqa: B023, E731
            prints = whole("prints", K.U)
            order = np.argsort(prints, kind="stable")
            prints = prints[order]
            twice = np.zeros(len(prints), bool)
            same = prints[1:] == prints[:-1]
            twice[1:] |= same
            twice[:-1] |= same
            at = order[twice]
            yield from rows(whole("docs", np.int64)[at], whole("keys", np.int64)[at], whole("places", np.int32)[at])
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            often = prints[first[np.add.reduceat(whole("times", np.int32)[order].astype(np.int64), first) > most]]
            if len(often):
                none = pa.nulls(len(often), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(often.view(np.int64))], names=["doc_id", "key", "place", "print"])
        yield from ready

    return run


_STRETCH = "print long, doc_id long, key long, start int, windows int, body binary"
_COLUMNS = ["print", "doc_id", "key", "start", "windows", "body"]


def _stretches(depth: int):
    """Stretches of windows of repeating anchors, with their words; runs of words known to be repeats have no body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out():
            # equal stretches: all but the first are repeats
            first: dict[bytes, int] = {}
            order = sorted(range(len(held)), key=lambda i: held[i][1:4])
            rows = []
            for i in order:
                one = held[i]
                j = first.setdefault(one[5], i)
                if i == j:
                    rows.append(one)
                elif held[j][1:4] != one[1:4]:
                    last = rows[-1] if rows else None
                    if last and last[5] is None and last[1:3] == one[1:3] and one[3] <= last[3] + last[4]:
                        # a run goes on
                        rows[-1] = (*last[:4], max(last[4], one[3] + one[4] - last[3]), None)
                    else:
                        rows.append((*one[:5], None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=_COLUMNS)

        for batch in batches:
            ids, named = (batch.column(c).to_numpy() for c in DOC)
            lists = batch.column("places")
            for first, n, row, begin, end, h, part in K.hashed(batch.column("text")):
                start, count, owner, prints = owners(h, row, depth)
                asked = lists.slice(first, n)
                sizes = np.asarray(asked.value_lengths().fill_null(0))
                wanted = (np.repeat(np.arange(n), sizes) << 32) | np.asarray(asked.flatten(), np.int64)
                mine = (row[owner] << 32) | _within(row, owner)
                keep = np.flatnonzero(np.isin(mine, wanted))
                data = part.tobytes()
                place = _within(row, start[keep]) if len(keep) else []
                for i, p in zip(keep, place, strict=True):
                    a, c = int(start[i]), int(count[i])
                    body = b" ".join(data[begin[a] : end[a + c + depth - 2]].split())
                    held.append((int(prints[i].view(np.int64)), int(ids[first + row[a]]), int(named[first + row[a]]), int(p), c, body))
                if len(held) > LOCAL:
                    yield out()
                    held = []
        if held:
            yield out()

    return run


def _windows(depth: int):
    """Stretches of frequent anchors as windows, each under a print of its own; the others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = batch.column("hot").to_numpy(zero_copy_only=False) & ~batch.column("body").is_null().to_numpy(zero_copy_only=False)
            plain = batch.select(_COLUMNS)
            yield plain.filter(pa.array(~hot))
            out = []
            for i in np.flatnonzero(hot):
                doc, key, start, n, body = (plain.column(c)[int(i)].as_py() for c in _COLUMNS[1:])
                words = body.split(b" ")
                for k in range(n):
                    one = b" ".join(words[k : k + depth])
                    out.append((int.from_bytes(hashlib.blake2b(one, digest_size=8).digest(), "little", signed=True), doc, key, start + k, 1, one))
            for k in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 20_000], strict=True), plain.schema, strict=True)], schema=plain.schema)

    return run


def subtree(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (rows of word numbers, as many columns as the tree is deep) in order, and the
    longest common prefix of each with the one before it."""
    order = np.lexsort(words.T[::-1])
    same = words[order[1:]] == words[order[:-1]]
    common = np.where(same.all(1), words.shape[1], same.argmin(1))
    return order, np.concatenate([[0], common])


def deep_nodes(common: np.ndarray, depth: int) -> np.ndarray:
    """For each leaf in order, the number of the internal node at least so deep above it, or one of its own."""
    return np.cumsum(common < depth)


def _mark(prints: np.ndarray, docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray, bodies: list[bytes], depth: int, group: int = GROUP, bits: int = 0) -> list[tuple[int, int, int, int]]:
    """(doc_id, key, first word, end) of the repeats among stretches of a group."""
    if counts.sum() > group and bits < 40 and (prints != prints[0]).any():
        # a longer prefix of the fingerprint
        side = (prints >> K.U(bits)) & K.U(1)
        out = []
        for k in (0, 1):
            at = np.flatnonzero(side == k)
            if len(at):
                out += _mark(prints[at], docs[at], keys[at], starts[at], counts[at], [bodies[i] for i in at], depth, group, bits + 1)
        return out
    if len(prints) < 2:
        return []
    data = np.frombuffer(b" ".join(bodies), np.uint8)
    edge = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bodies])])
    edge[-1] -= 1
    row, begin, end = K.split(data, edge)
    number = K.numbered(data, begin, end)
    first = np.searchsorted(row, np.arange(len(bodies)))
    at = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    doc, key = np.repeat(docs, counts), np.repeat(keys, counts)
    place = np.repeat(starts, counts) + at - np.repeat(first, counts)
    order, common = subtree(np.lib.stride_tricks.sliding_window_view(number.astype(np.int32), depth)[at])
    node = deep_nodes(common, depth)
    doc, key, place = doc[order], key[order], place[order]
    by = np.lexsort((place, key, doc, node))
    node, doc, key, place = node[by], doc[by], key[by], place[by]
    lead = np.ones(len(node), bool)
    lead[1:] = node[1:] != node[:-1]
    lead = np.maximum.accumulate(np.where(lead, np.arange(len(node)), 0))
    gone = (doc != doc[lead]) | (key != key[lead]) | (place != place[lead])
    doc, key, place = doc[gone], key[gone], place[gone]
    by = np.lexsort((place, key, doc))
    doc, key, place = doc[by], key[by], place[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (place[1:] > place[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return list(zip(doc[at].tolist(), key[at].tolist(), place[at].tolist(), (place[last] + depth).tolist(), strict=True)) if len(at) else []


def _trees(depth: int, group: int):
    from recallery.llm.jaccard import runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "bucket"):
            docs, keys, starts, counts = (part.column(c).to_numpy().astype(np.int64) for c in (*DOC, "start", "windows"))
            known = part.column("body").is_null().to_numpy(zero_copy_only=False)
            found = list(zip(docs[known].tolist(), keys[known].tolist(), starts[known].tolist(), (starts[known] + counts[known] + depth - 1).tolist(), strict=True))
            at = np.flatnonzero(~known)
            if len(at):
                bodies = part.column("body").take(pa.array(at)).to_pylist()
                found += _mark(part.column("print").to_numpy().view(K.U)[at], docs[at], keys[at], starts[at], counts[at], bodies, depth, group)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=[*DOC, "start", "end"])

    return run


def repeats(docs: DataFrame, depth: int = DEPTH, group: int = GROUP) -> DataFrame:
    """(doc_id, key, starts, ends): runs of words to remove, in order, ends exclusive. ``docs``: doc_id, text and key, which tells apart
    the texts that share an id."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(8, -(-size // BUCKET_BYTES)), MOST_BUCKETS)
    docs = docs.where("doc_id is not null")
    packed = docs.mapInArrow(K.tidy(_anchors(depth, buckets)), "bucket int, prints binary, times binary, docs binary, keys binary, places binary")
    # repeats known within a task (bucket -1) are dealt over all tasks
    to = F.when(F.col("bucket") < 0, F.xxhash64("docs", "keys")).otherwise(F.col("bucket").cast("long"))
    dealt = packed.withColumn("to", to).repartition(min(buckets, MOST_TASKS), "to").sortWithinPartitions("bucket").drop("to")
    shared = cut(dealt.mapInArrow(K.tidy(_shared(group // 4)), _ANCHOR))
    wanted = shared.where("doc_id is not null").groupBy(*DOC).agg(F.collect_set("place").alias("places"))
    joined = docs.join(wanted, DOC).select(*DOC, "text", "places")
    sent = joined.mapInArrow(K.tidy(_stretches(depth)), _STRETCH)
    hot = shared.where("print is not null").select("print", F.lit(True).alias("hot"))
    often = hot.limit(BROADCAST_ANCHORS + 1).count()
    if often:
        side = F.broadcast(hot) if often <= BROADCAST_ANCHORS else hot
        marked = sent.join(side, "print", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        sent = marked.select(*_COLUMNS, "hot").mapInArrow(K.tidy(_windows(depth)), _STRETCH)
    key = F.when(F.col("body").isNull(), F.xxhash64(*DOC)).otherwise(F.col("print"))
    groups = 4 * buckets
    grouped = sent.withColumn("bucket", F.pmod(F.shiftrightunsigned(key, 40), F.lit(groups)).cast("int"))
    grouped = grouped.repartition(min(groups, MOST_TASKS), "bucket").sortWithinPartitions("bucket")
    found = grouped.mapInArrow(K.tidy(_trees(depth, group)), "doc_id long, key long, start int, end int")
    return found.groupBy(*DOC).agg(F.collect_list(F.struct("start", "end")).alias("spans")).mapInArrow(K.tidy(_merged), "doc_id long, key long, starts array<int>, ends array<int>")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching spans of each document joined."""
    for batch in batches:
        rows: list[tuple[list[int], list[int]]] = []
        for spans in batch.column("spans"):
            starts: list[int] = []
            ends: list[int] = []
            for a, b in sorted((s["start"], s["end"]) for s in spans.as_py()):
                if ends and a <= ends[-1]:
                    ends[-1] = max(ends[-1], b)
                else:
                    starts.append(a)
                    ends.append(b)
            rows.append((starts, ends))
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in DOC), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], names=[*DOC, "starts", "ends"])


def kept_words(text: str | None, starts: list[int] | None, ends: list[int] | None) -> tuple[int, list[bytes]]:
    """How many words a text has, and the words outside the spans, which are in order and apart."""
    words = (text or "").encode().split()
    out, done = [], 0
    for a, b in zip(starts or (), ends or (), strict=True):
        out += words[done:a]
        done = b
    return len(words), out + words[done:]


def dedup(docs: DataFrame, depth: int = DEPTH, texts: bool = True, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row and, unless turned off, kept_text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    spans = cut(repeats(docs, depth, group))
    fits = (spans.agg(F.sum(F.size("starts") + 1)).first()[0] or 0) <= BROADCAST_RUNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(batch.column("text"), batch.column("starts"), batch.column("ends"), strict=True):
                n, words = kept_words(text.as_py(), starts.as_py(), ends.as_py())
                body = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(body).hexdigest(), body.decode() if texts else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    joined = docs.join(F.broadcast(spans) if fits else spans, DOC, "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(K.tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), texts=False).drop("kept_text")
