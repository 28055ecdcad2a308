"""N-gram Jaccard join over a count-vector R-tree.

A document's set are its distinct shingles of WORDS words. Tokens are hashed into GROUPS
groups; how many of a set fall into each is a point, and the overlap of two sets is at
most the sum over the groups of the smaller count. An R-tree over the points (boxes keep
their upper corner and the range of set sizes) prunes by that bound; survivors are
verified on the sets themselves.

To spread the join, documents first meet in blocks: two sets that are similar enough share
one of the first tokens under any common order (prefix filter). The order puts tokens
known to be frequent last; any order is exact, a better one only makes blocks smaller.
Blocks of the same documents are one. In a block beyond BLOCK documents those that the bound lets be
similar to its pivot are tied to that, by a star; near copies all are, and cost a row for each of their tokens.
The others meet all documents of the block, in parts, or, where they are more than BLOCK, are dealt anew by pairs of
tokens, since two similar sets also share two of their first tokens, one more counted; what
is still as large is tied as a whole. An R-tree
join of each other block's points ties documents that the bound lets be similar into families, by a
spanning forest and not by pairs.

Then each family's sets are joined over an R-tree again and the survivors verified. A family
beyond LIMIT tokens is joined in rounds: its blocks each on their own; one set of each group found
so with those of the other groups; and then the pairs of blocks whose groups are still apart, so that
many near copies are not compared pair by pair. No task holds an unbounded group. Equal sets are
one class with one representative throughout. Pairs that are joined already are not looked at again,
since links only serve to join.

Shingles are compared as 64-bit hashes. A class is told by the size of its set and sums of
two independent hashes; where two classes agree in all first hashes, at least one shingle
differs by the second, so one is not counted.

Edge cases: null and empty texts and texts without words have an empty set, link with
nothing and are their own component; texts of fewer than WORDS words have one shingle;
very long texts are taken whole, the set of one in one task; rows that share a doc_id are one
node: each of their texts links, with its own n_shingles, and all get one component; rows
without a doc_id link with nothing and have a null component; ties don't arise, as a
component is named by its smallest doc_id; extra columns, whatever their names, are not
used; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.llm import kernels as K
from recallery.llm.common import components, cut, drop, release, small_batches, table

#: Shingle length, and the similarity as a fraction.
WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Least and most groups of a count vector; tokens to a group on average.
LEAST_GROUPS, MOST_GROUPS, TO_GROUP = 16, 4096, 4
#: Points of a leaf and children of an inner node; documents of a block at most.
LEAF, FAN, BLOCK = 16, 16, 2048
#: Tokens of a family that one task holds; tokens counted at a time, and the most frequent ones known.
LIMIT, COUNTED, KNOWN = 1 << 20, 1 << 21, 1 << 18
#: A family list of up to so many rows is broadcast, a longer one shuffled.
BROADCAST_ROWS = 400_000
#: Ratio of neighbouring size classes: the similarity itself.
RATIO = np.log(DENOMINATOR / NUMERATOR)


# ---------------------------------------------------------------- token order


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        token, n = np.unique(np.concatenate(held), return_counts=True)
        token, n = token[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    for batch in batches:
        for _, _, _, s in K.shingle_sets(batch.column("text"), WORDS):
            held.append(s)
            size += len(s)
            if size > COUNTED:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that stand in many documents and their counts, sorted by token: the KNOWN most
    frequent ones at most. Every document is counted, and tokens that repeat within a few
    million others come up; which ones do affects only the speed."""
    rows = docs.select("text").mapInArrow(K.tidy(_count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 2")
    top = rows.orderBy(F.desc("n"), "token").limit(KNOWN).toArrow()
    token, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _sums(r: np.ndarray, s: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The size of each row's set, and a sum over its tokens."""
    n = np.bincount(r, minlength=rows)
    ends = np.cumsum(n)
    total = np.concatenate([np.zeros(1, K.U), np.cumsum(K.mix(s + K.U(1)), dtype=K.U)])
    return n, (total[ends] - total[ends - n]).view(np.int64)


def _sets(known: tuple[np.ndarray, np.ndarray]):
    """doc_id, n, sums over two hashes that identify the set, its prefix tokens with one more, and its count vector."""
    tokens, counts = known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, rows, r, s, other in K.shingle_sets(batch.column("text"), WORDS, seeds=2):
                raw, (n, k1), k2 = s, _sums(r, s, rows), _sums(r, other, rows)[1]
                ends = np.cumsum(n)
                weight = np.zeros(len(s), np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    weight = np.where(tokens[at] == s, counts[at], 0)
                if weight.any():
                    order = np.lexsort((s, weight, r))
                    s = s[order]
                keep = np.minimum(prefix_of(n) + 1, n)
                rank = np.arange(len(s)) - np.repeat(ends - n, n)
                prefix = s[rank < np.repeat(keep, n)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(prefix))
                size = groups_of(n)
                base = np.cumsum(size) - size
                place = base[r] + (K.mix(raw).astype(np.int64) & (size[r] - 1))
                # a count of 255 stands for any larger one
                vec = np.minimum(np.bincount(place, minlength=int(size.sum())), 255).astype(np.uint8)
                at = np.append(base, size.sum()).astype(np.int64)
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(vec.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(first, rows), pa.array(n), pa.array(k1), pa.array(k2), lists, blobs], names=["doc_id", "n", "k1", "k2", "prefix", "vec"])

    return run


def prefix_of(n):
    """How many first tokens of a set of n another must share one of to be similar enough."""
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + (n > 0)


def groups_of(n: np.ndarray) -> np.ndarray:
    """Groups of the count vector of a set of n tokens: a power of two."""
    wanted = np.clip(n / TO_GROUP, LEAST_GROUPS, MOST_GROUPS)
    return (1 << np.round(np.log2(wanted)).astype(np.int64)).astype(np.int64)


# ------------------------------------------------------------------- families


def _fits(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table to join with, broadcast while it has few enough rows."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _once(tied: DataFrame) -> DataFrame:
    """(token, cls, df) of the tokens of more than one class, those of the same classes once. ``tied``: distinct (token, cls)."""
    one, two = F.xxhash64("cls"), F.xxhash64("cls", F.lit(7))
    sums = tied.groupBy("token").agg(F.count("*").alias("df"), F.bit_xor(one).alias("x1"), F.bit_xor(two).alias("x2")).where("df > 1")
    kept = sums.groupBy("df", "x1", "x2").agg(F.min("token").alias("token")).select("token", "df")
    return tied.join(kept, "token").select("token", "cls", "df")


def _blocks(reps: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(token, cls): classes that share a prefix token, at most ``most`` to a token, and (a, b): stars of larger groups."""
    n = F.col("n")
    first = (n - F.ceil(n * NUMERATOR / DENOMINATOR) + 1).cast("int")
    rows = reps.select("cls", F.explode(F.slice("prefix", F.lit(1), first)).alias("token"))
    # a token of one class ties nothing
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    tied = cut(rows.join(shared, "token").distinct())
    release(tied)
    single = cut(_once(tied))
    small = single.where(F.col("df") <= most).select("token", "cls")
    large = cut(single.where(F.col("df") > most).select("token", "cls"))
    if large.isEmpty():
        return small, single.limit(0).select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    marked = cut(_marked(large, reps))
    star = marked.where("near and cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
    # what may not be like the pivot meets all others: in parts while it is little, else dealt by pairs of tokens
    counts = marked.groupBy("token").agg(F.count_if("near").alias("near_n"), F.count_if(~F.col("near")).alias("rest_n")).where("rest_n > 0")
    counts = cut(counts.withColumn("parts", F.ceil(F.greatest(F.col("near_n"), F.lit(1)) / most).cast("int")))
    few = marked.join(_fits(counts.where(F.col("rest_n") <= most)), "token")
    part = F.when(F.col("near"), F.array(F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    met = few.select("cls", "token", F.explode(part).alias("part")).select(F.xxhash64("token", "part", F.lit(1)).alias("token"), "cls")
    many = cut(counts.where(F.col("rest_n") > most).select("token"))
    if many.isEmpty():
        return small.unionByName(met), star
    # with each token that comes behind it; a set of one token links with its like only, and those are its class
    at = reps.where("n > 1").select("cls", "prefix", F.posexplode(F.slice("prefix", F.lit(1), first)).alias("i", "token")).join(_fits(many), "token")
    pairs = at.select("cls", "token", F.explode(F.slice("prefix", F.col("i") + 2, F.size("prefix"))).alias("next"))
    pairs = cut(_once(cut(pairs.select("cls", F.xxhash64("token", "next").alias("token")).distinct())))
    over = pairs.where(F.col("df") > most)
    tie = over.join(_fits(cut(over.groupBy("token").agg(F.min("cls").alias("b")))), "token").select(F.col("cls").alias("a"), "b").distinct()
    return small.unionByName(met).unionByName(pairs.where(F.col("df") <= most).select("token", "cls")), star.unionByName(tie)


def _marked(large: DataFrame, reps: DataFrame) -> DataFrame:
    """(token, cls, pivot, near) of the classes of large blocks: the pivot is a block's smallest class, near what the bound lets be similar to it.
    A class has a row for each of its tokens, and each pair of a class and a pivot is looked at once."""
    pivots = large.groupBy("token").agg(F.min("cls").alias("pivot"))
    placed = cut(large.join(_fits(cut(pivots)), "token"))
    pairs = placed.select("cls", "pivot").distinct()
    points = reps.select("cls", "n", "vec")
    other = points.select(F.col("cls").alias("pivot"), F.col("n").alias("pn"), F.col("vec").alias("pvec")).join(_fits(cut(pairs.select("pivot").distinct())), "pivot", "left_semi")
    both = pairs.join(points, "cls").join(other, "pivot").select("cls", "pivot", "n", "vec", "pn", "pvec")
    near = both.mapInArrow(K.tidy(_near_rows), "cls long, pivot long, near boolean")
    return placed.join(near, ["cls", "pivot"]).select("token", "cls", "pivot", "near")


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, pn = batch.column("n").to_numpy(), batch.column("pn").to_numpy()
        groups = np.minimum(groups_of(n), groups_of(pn))
        most = [np.minimum(fold(np.frombuffer(a, np.uint8), g), fold(np.frombuffer(b, np.uint8), g)).sum() for a, b, g in zip(batch.column("vec").to_pylist(), batch.column("pvec").to_pylist(), groups.tolist(), strict=True)]
        near = enough(np.minimum(np.array(most, np.int64), np.minimum(n, pn)), n, pn)
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("pivot"), pa.array(near, pa.bool_())], names=["cls", "pivot", "near"])


def _bound_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of what the count vectors of each block let be similar."""
    for part in runs(batches, "token"):
        ids, once = np.unique(part.column("cls").to_numpy(), return_index=True)
        if len(ids) < 2:
            continue
        part = part.take(once)
        links = bound_forest(part.column("n").to_numpy(), [np.frombuffer(b, np.uint8) for b in part.column("vec").to_pylist()])
        if links:
            a, b = np.array(links).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])


def fold(vec: np.ndarray, groups: int) -> np.ndarray:
    """A count vector over fewer groups; a full count stands for any number."""
    wide = np.where(vec == 255, 1 << 20, vec).astype(np.int32)
    return wide.reshape(-1, groups).sum(0)


def bound_forest(n: np.ndarray, vecs: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose bound on the overlap is high enough. Each size class is joined
    with itself and the next larger one, over as many groups as its smallest sets have."""
    level = np.floor(np.log(n) / RATIO).astype(int)
    label, out = np.arange(len(n)), []
    for c in np.unique(level):
        own, both = np.flatnonzero(level == c), np.flatnonzero((level == c) | (level == c + 1))
        if len(both) < 2:
            continue
        groups = int(groups_of(n[own]).min())
        point = np.stack([fold(vecs[i], groups) for i in both])
        tree = RTree(n[both], point)
        for k in np.flatnonzero(level[both] == c):
            q = both[k]
            found = both[tree.search(int(n[q]), point[k])]
            found = found[found != q]
            for other in np.unique(label[found]):
                if other != label[q]:
                    r = found[label[found] == other]
                    if len(r):
                        out.append((int(q), int(r[0])))
                        label[label == other] = label[q]
    return out


def _families(reps: DataFrame, most: int) -> DataFrame:
    """(cls, family) of the classes that may be similar to another. ``reps``: cls, n, prefix, vec."""
    blocks, stars = _blocks(reps, most)
    joined = blocks.join(reps.select("cls", "n", "vec"), "cls").select("token", "cls", "n", "vec")
    edges = joined.repartition("token").sortWithinPartitions("token").mapInArrow(K.tidy(_bound_rows), "a long, b long")
    return components(edges.unionByName(stars)).select(F.col("node").alias("cls"), F.col("component").alias("family"))


# --------------------------------------------------------------------- rounds


def _links(held: DataFrame, tasks: DataFrame) -> DataFrame:
    """(a, b): what the R-tree joins of each task's sets link. ``held``: cls, tokens; ``tasks``: cls, task, side, group (a
    class's group before; pairs of one group are not looked at, and with sides only pairs across)."""
    sent = held.join(_fits(tasks), "cls").select("cls", "task", "side", "group", "tokens")
    return sent.repartition("task").sortWithinPartitions("task").mapInArrow(K.tidy(_join_rows), "a long, b long")


def _parts(members: DataFrame, limit: int) -> DataFrame:
    """(cls, task, side, group) of families in blocks of half a limit of tokens: each pair of blocks of equal or neighbouring
    size class is a task. ``members``: cls, family, n, group and own, whether its group has blocks of its own, whose pairs
    with each other are left out."""
    sized = members.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / float(RATIO)).cast("int"))
    # which blocks a class may be in: those of its own group, or those of all small groups
    sized = sized.withColumn("kind", F.when(F.col("own"), F.col("group").cast("string")).otherwise(F.lit("")))
    sizes = sized.groupBy("family", "c", "kind").agg(F.ceil(F.sum("n") / (limit // 2)).cast("int").alias("k"))
    by_group = F.pmod(F.when(F.col("own"), F.xxhash64("cls")).otherwise(F.xxhash64("group")), F.col("k"))
    placed = sized.join(_fits(cut(sizes)), ["family", "c", "kind"]).withColumn("block", F.struct("c", "kind", by_group.cast("int").alias("i")))
    placed = cut(placed.select("cls", "family", "group", "c", "kind", "block"))
    # the partners of a block: a table of blocks, not of classes
    blocks = placed.select("family", "c", "kind", "block").distinct()
    other = blocks.select("family", F.col("c").alias("c2"), F.col("kind").alias("kind2"), F.col("block").alias("block2"))
    near = (F.abs(F.col("c") - F.col("c2")) <= 1) & ~((F.col("kind") == F.col("kind2")) & (F.col("kind") != ""))
    pairs = cut(blocks.join(other, "family").where(near).select("family", "block", F.concat_ws("/", "family", F.least("block", "block2").cast("string"), F.greatest("block", "block2").cast("string")).alias("task")))
    sent = placed.join(_fits(pairs), ["family", "block"])
    return sent.select("cls", "task", F.col("block").cast("string").alias("side"), "group")


def _joined(members: DataFrame, held: DataFrame, limit: int) -> DataFrame:
    """(a, b): links that join what the similarity joins. ``members``: cls, family, n; ``held``: cls, tokens."""
    sizes = members.groupBy("family").agg(F.sum("n").alias("tokens"))
    large = cut(sizes.where(F.col("tokens") > limit).select("family"))
    none = F.lit("").alias("side")
    if large.isEmpty():
        return _links(held, members.select("cls", F.col("family").cast("string").alias("task"), none, F.col("cls").alias("group")))
    held = cut(held)  # read in every round
    small = members.join(_fits(large), "family", "left_anti")
    out = _links(held, small.select("cls", F.col("family").cast("string").alias("task"), none, F.col("cls").alias("group")))
    rest = cut(members.join(_fits(large), "family").select("cls", "family", "n"))
    # blocks on their own: classes of a size class, in an order by size, so that like meets like
    c = F.floor(F.log(F.col("n").cast("double")) / float(RATIO)).cast("int")
    sized = rest.withColumn("c", c)
    counts = sized.groupBy("family", "c").agg(F.ceil(F.sum("n") / (limit // 2)).cast("int").alias("k"))
    own = sized.join(_fits(cut(counts)), ["family", "c"]).select("cls", F.concat_ws("/", "family", "c", F.pmod(F.xxhash64("cls"), F.col("k"))).alias("task"), none, F.col("cls").alias("group"))
    links = cut(_links(held, own))

    def grouped(links: DataFrame) -> DataFrame:
        found = components(links).select(F.col("node").alias("cls"), F.col("component").alias("group"))
        return cut(rest.join(found, "cls", "left").withColumn("group", F.coalesce("group", "cls")))

    # a class of each group of some size, as many as tokens / limit times 8 at most
    now = grouped(links)
    many = now.groupBy("family", "group").agg(F.sum("n").alias("tokens"), F.min(F.struct("n", "cls")).alias("one"))
    pivots = cut(many.where(F.col("tokens") >= limit // 8).select(F.col("one.cls").alias("cls"), "family", F.col("one.n").alias("n")))
    links = cut(links.unionByName(_links(held, _parts(pivots.withColumns({"group": F.col("cls"), "own": F.lit(False)}), limit))))
    # what is still apart
    now = grouped(links)
    many = now.groupBy("family", "group").agg(F.sum("n").alias("tokens"))
    apart = many.groupBy("family").agg(F.count("*").alias("groups")).where("groups > 1").select("family")
    many = cut(many.where(F.col("tokens") > limit // 2).select("group", F.lit(True).alias("own")))
    left = now.join(_fits(cut(apart)), "family", "left_semi").join(_fits(many), "group", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    return out.unionByName(links).unionByName(_links(held, _parts(left.select("cls", "family", "n", "group", "own"), limit)))


# --------------------------------------------------------------------- R-tree


class RTree:
    """Points in bulk-loaded leaves: set sizes and count vectors, upper corners of the boxes."""

    def __init__(self, size: np.ndarray, point: np.ndarray):
        self.order = np.lexsort((point.argmax(1), size))
        # slabs by size, tiles by the widest coordinate within each
        slab = LEAF * FAN
        for a in range(0, len(size), slab):
            part = self.order[a : a + slab]
            wide = int(np.argmax(np.ptp(point[part], axis=0)))
            self.order[a : a + slab] = part[np.argsort(point[part, wide], kind="stable")]
        self.size, self.point = size[self.order], point[self.order]
        self.levels = []
        low, high, corner, step = self.size, self.size, self.point, LEAF
        while len(low) > 1 or not self.levels:
            at = np.arange(0, len(low), step)
            low, high, corner = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(corner, at)
            self.levels.append((low, high, corner, step))
            step = FAN

    def search(self, size: int, point: np.ndarray) -> np.ndarray:
        """Points (as first numbered) whose bound on the overlap lets the similarity be reached."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high, corner, step = self.levels[depth]
            fits = (high[nodes] * DENOMINATOR >= size * NUMERATOR) & (low[nodes] * NUMERATOR <= size * DENOMINATOR)
            nodes = nodes[fits]
            most = np.minimum(corner[nodes], point).sum(1)
            nodes = nodes[enough(most, size, np.maximum(low[nodes], -(-size * NUMERATOR // DENOMINATOR)))]
            below = len(self.levels[depth - 1][0]) if depth else len(self.size)
            nodes = (nodes[:, None] * step + np.arange(step)).ravel()
            nodes = nodes[nodes < below]
        nodes = nodes[(self.size[nodes] * DENOMINATOR >= size * NUMERATOR) & (self.size[nodes] * NUMERATOR <= size * DENOMINATOR)]
        most = np.minimum(self.point[nodes], point).sum(1)
        return self.order[nodes[enough(most, size, self.size[nodes])]]


def enough(overlap, a, b):
    """Whether sets of sizes a and b with that overlap are similar enough: o / (a + b - o) >= 4 / 5."""
    return (NUMERATOR + DENOMINATOR) * overlap >= NUMERATOR * (a + b)


def join(sets: list[np.ndarray], side: np.ndarray | None = None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what the similarity joins (a spanning forest), as indexes into ``sets`` (sorted arrays).
    With sides, only pairs across them count; with groups, those count as joined."""
    size = np.array([len(s) for s in sets])
    groups = min(256, int(groups_of(size).min()))
    place = (K.mix(np.concatenate(sets)) & K.U(groups - 1)).astype(np.int64)
    point = np.bincount(np.repeat(np.arange(len(sets)), size) * groups + place, minlength=len(sets) * groups).reshape(-1, groups).astype(np.int32)
    tree, out = RTree(size, point), []
    label = np.arange(len(sets)) if group is None else np.unique(group, return_inverse=True)[1]
    for q in range(len(sets)):
        found = tree.search(int(size[q]), point[q])
        found = found[found < q]
        if side is not None:
            found = found[side[found] != side[q]]
        while len(found := found[label[found] != label[q]]):
            r, found = int(found[0]), found[1:]
            a, b = (sets[q], sets[r]) if size[q] <= size[r] else (sets[r], sets[q])
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            overlap = int((b[at] == a).sum())
            # different classes: where all first hashes agree, a shingle differs by the second
            overlap -= overlap == len(b)
            if enough(overlap, len(a), len(b)):
                label[label == label[q]] = label[r]
                out.append((q, r))
    return out


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the classes, as bytes of sorted 64-bit tokens. A row whose text is not that of its class (other
    texts may share the doc_id), or that repeats a class within the task, gives none."""
    seen: set[int] = set()
    for batch in batches:
        for first, rows, r, s in K.shingle_sets(batch.column("text"), WORDS):
            part = batch.slice(first, rows)
            n, k1 = _sums(r, s, rows)
            cls = part.column("cls").to_numpy()
            own = (n == part.column("n").to_numpy()) & (k1 == part.column("k1").to_numpy())
            own &= np.array([c not in seen for c in cls.tolist()], bool)
            own[np.setdiff1d(np.flatnonzero(own), np.unique(np.where(own, cls, np.iinfo(np.int64).min), return_index=True)[1])] = False
            seen.update(cls[own].tolist())
            ends = np.cumsum(n) * 8
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(s.tobytes())])
            whole = pa.RecordBatch.from_arrays([part.column("cls"), blob.cast(pa.binary())], names=["cls", "tokens"])
            yield whole.filter(pa.array(own))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                last = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield pa.Table.from_batches(held)


def _join_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in runs(batches, "task"):
        ids = part.column("cls").to_numpy()
        _, once = np.unique(ids, return_index=True)
        part, ids = part.take(once), ids[once]
        if len(ids) < 2:
            continue
        sets = [np.frombuffer(b, K.U) for b in part.column("tokens").to_pylist()]
        names = np.array(part.column("side").to_pylist(), dtype=object)
        links = join(sets, None if (names == names[0]).all() else (names == names[0]), part.column("group").to_numpy())
        if links:
            a, b = np.array(links).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])


# ---------------------------------------------------------------------- whole


def similar(docs: DataFrame, block: int = BLOCK, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row (see the module)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = frequent(docs)
    made = docs.mapInArrow(K.tidy(_sets(known)), "doc_id long, n long, k1 long, k2 long, prefix array<bigint>, vec binary")
    whole = cut(made.withColumn("row", F.monotonically_increasing_id()))
    sets = cut(whole.select("doc_id", "row", "n", "k1", "k2"))
    key = ["n", "k1", "k2"]
    # a class goes by the row number of its representative, the row with the smallest doc_id
    classes = sets.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min(F.struct("doc_id", "row")).alias("r"))
    classes = cut(classes.select(*key, F.col("r.doc_id").alias("rep"), F.col("r.row").alias("cls")))
    reps = whole.select(F.col("row").alias("cls"), "n", "prefix", "vec").join(classes.select("cls"), "cls", "left_semi")
    members = cut(_families(reps, block).join(classes.select("cls", "rep", "n", "k1"), "cls"))
    drop(whole)
    release(members)
    texts = docs.join(_fits(members.select(F.col("rep").alias("doc_id"), "cls", "n", "k1")), "doc_id").select("cls", "n", "k1", "text")
    held = texts.mapInArrow(K.tidy(_set_rows), "cls long, tokens binary")
    links = _joined(members.select("cls", "family", "n"), held, limit)
    # the texts of one doc_id are one node
    twice = cut(sets.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1 and doc_id is not null").select("doc_id"))
    if not twice.isEmpty():
        several = sets.join(twice, "doc_id", "left_semi").join(classes, key).select("doc_id", "cls").distinct()
        links = links.unionByName(several.join(several.groupBy("doc_id").agg(F.min("cls").alias("b")), "doc_id").select(F.col("cls").alias("a"), "b"))
    joined = cut(components(links).select(F.col("node").alias("cls"), "component"))
    release(joined)
    named = joined.join(classes.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("least"))
    named = classes.join(joined.join(named, "component").select("cls", "least"), "cls", "left").select(*key, F.coalesce("least", "rep").alias("component_id"))
    out = sets.join(named, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    if not twice.isEmpty():
        # an empty text beside another under one doc_id
        least = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("own"))
        out = out.join(least, "doc_id", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "own", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
