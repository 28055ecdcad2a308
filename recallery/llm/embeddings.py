"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it when their inner product exceeds a threshold.
The directions are all sums of one codeword from each of m random codes over m parts of
the coordinates (a random product code), so the filters that a vector passes are listed by
searching part by part instead of trying every direction. Vectors that share a filter are
compared exactly, in double precision. Codes and threshold follow from the number of
vectors: the number of vectors behind a filter stays level while the table grows, and the
number of directions is raised until simulated pairs at the required cosine are found.

Equal vectors are one class: they are compared once, counted as often as they stand.
Behind a filter a pair counts only if no smaller filter has both, so each vector brings the
smaller filters it passes along. Links are added up and never listed; a spanning star of
each group found goes on to the components. A filter with many vectors is split into
blocks, and each pair of blocks is a group of its own.

Edge cases: null vectors, zero vectors and such with null or non-finite components link
with nothing; vectors of unlike length don't link; an empty table gives an empty result;
rows that repeat a vec_id are one vector if the vectors are equal, and else count as
separate vectors under one id, each row with the links of its own; rows without a vec_id
link with nothing; ties don't arise, as a component is named by its smallest vec_id; other
columns, whatever their names, are not used; vectors may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallery.llm import kernels as K
from recallery.llm.common import components, cut, small_batches, table

COSINE = 0.9
#: Vectors behind a filter at the threshold chosen, on average; vectors of a block of a larger one.
BEHIND, BLOCK = 512, 2048
#: Codewords of a part at most, filters of one code that a vector passes on average, and the
#: share of simulated pairs at exactly the required cosine that must meet.
WIDEST, PASSED, MEET = 192, 2, 0.99


#: Filters with too many vectors up to which their table is broadcast.
BROADCAST_ROWS = 1_000_000


class Filters:
    """Random product codes of a dimension, each behind a rotation of its own: which filters a vector passes."""

    def __init__(self, d: int, parts: int, width: int, alpha: float, tables: int, seed: int = 7):
        rng = np.random.default_rng([seed, d, parts, width])
        self.cuts = np.linspace(0, d, parts + 1).astype(int)
        self.width, self.alpha, self.size, self.tables = width, alpha, width**parts, []
        for _ in range(tables):
            turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
            codes = [rng.standard_normal((width, b - a)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
            self.tables.append((turn, [c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) / np.sqrt(parts) for c in codes]))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that each unit vector passes, in order of rows."""
        found = [self._one(x, *table, k * self.size) for k, table in enumerate(self.tables)]
        row, name = (np.concatenate(z) for z in zip(*found, strict=True))
        order = np.lexsort((name, row))
        return row[order], name[order]

    def _one(self, x: np.ndarray, turn: np.ndarray, codes: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
        turned = x @ turn
        scores = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], codes, strict=False)]
        rest = np.zeros(len(x))
        best = [rest]
        for s in reversed(scores[1:]):
            rest = rest + s.max(1)
            best.insert(0, rest)
        row, total, name = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for s, ahead in zip(scores, best, strict=True):
            # a prefix goes on only where the best of the remaining parts can still lift it over alpha
            grown = total[:, None] + s[row]
            keep, word = np.nonzero(grown >= (self.alpha - ahead[row])[:, None])
            row, total, name = row[keep], grown[keep, word], name[keep] * self.width + word
        return row, name + base


def threshold(share: float, d: int) -> float:
    """The inner product that a random direction has or exceeds with a random unit vector of d components with that probability."""
    t = np.linspace(0, 1, 1_000_001)[:-1]
    # the density is (1 - t^2) ^ ((d - 3) / 2); its logarithm, so that no share is too small
    log = (d - 3) / 2 * np.log1p(-(t**2))
    above = np.cumsum(np.exp(log - log.max())[::-1])[::-1]
    return float(t[np.searchsorted(-above, -2 * share * above[0])])


def choose(n: int, d: int, cosine: float = COSINE) -> tuple[int, int, float, int]:
    """Parts, codewords of a part, threshold and number of codes for n vectors of d components."""
    rng = np.random.default_rng([11, d])
    x = rng.standard_normal((600, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((600, d))
    y -= (y * x).sum(1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    share = min(0.2, BEHIND / max(n, 1))
    # a cap need not be narrower than the link itself, which few components would ask for
    alpha = min(threshold(share, d), cosine) if d > 1 else cosine
    wanted = PASSED / share
    parts = 1 if d < 4 else next(m for m in range(2, d) if wanted ** (1 / m) <= WIDEST or m >= d // 4)
    width = max(2, int(np.ceil(wanted ** (1 / parts))))
    tables, met = 0, np.zeros(len(x), bool)
    while met.mean() < MEET:
        # each further code with a rotation of its own is an independent chance to meet
        tables += 1
        f = Filters(d, parts, width, alpha, 1, seed=1000 + tables)
        for k in range(0, len(x), 50):
            (ra, na), (rb, nb) = (f.decode(z[k : k + 50]) for z in (x, y))
            met[k + ra[np.isin(ra * f.size + na, rb * f.size + nb)]] = True
    return parts, width, alpha, tables


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _listing(plan: dict[int, tuple[int, int, float, int]], kind: str, number: pa.DataType):
    """Vectors as bytes, with the filters they pass in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Filters] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lengths, column = part.column("d").to_numpy(), part.column("vec")
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
                start = np.cumsum(lengths) - lengths
                out: list = [None] * part.num_rows
                for d in set(lengths.tolist()):
                    f = made.setdefault(d, Filters(d, *plan[d]))
                    rows = np.flatnonzero(lengths == d)
                    row, name = f.decode(_unit(flat[start[rows][:, None] + np.arange(d)]))
                    for i, r in enumerate(rows):
                        out[r] = name[np.searchsorted(row, i) : np.searchsorted(row, i, "right")]
                size = np.dtype(kind).itemsize
                ends = np.append(start, lengths.sum()) * size
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("times"), blob.cast(pa.binary()), pa.array(out, pa.list_(number))], names=["id", "times", "vec", "filters"])

    return run


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element of a list column."""
    column = column.combine_chunks()
    return np.repeat(np.arange(len(column)), np.asarray(column.value_lengths())), column.flatten().to_numpy(zero_copy_only=False)


def _known(one: tuple, other: tuple, shape: tuple[int, int]) -> np.ndarray:
    """Which pairs of rows share a smaller filter, from (row, filter) on either side."""
    out = np.zeros(shape, bool)
    (ra, fa), (rb, fb) = one, other
    oa, ob = np.argsort(fa, kind="stable"), np.argsort(fb, kind="stable")
    ra, fa, rb, fb = ra[oa], fa[oa], rb[ob], fb[ob]
    for f in np.intersect1d(fa, fb):
        a, b = (r[np.searchsorted(x, f) : np.searchsorted(x, f, "right")] for r, x in ((ra, fa), (rb, fb)))
        out[np.ix_(a, b)] = True
    return out


def _group(part: pa.Table, kind: str, links: dict, edges: list, cosine: float) -> None:
    """Adds the links of one filter's group to ``links`` and a spanning star of each linked set to ``edges``.
    Of a pair of blocks only the pairs across count."""
    chunk, i, j = (part.column(c).to_numpy() for c in ("chunk", "i", "j"))
    ids, times = part.column("id").to_numpy(), part.column("times").to_numpy().astype(float)
    x = _unit(np.frombuffer(b"".join(part.column("vec").to_pylist()), kind).reshape(len(ids), -1))
    row, smaller = _lists(part.column("smaller"))
    pick = lambda at: (np.searchsorted(at, row[m := np.isin(row, at)]), smaller[m])
    if i[0] == j[0]:
        a = b = np.arange(len(ids))
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
    else:
        a, b = np.flatnonzero(chunk == i), np.flatnonzero(chunk != i)
        near = x[a] @ x[b].T >= cosine
    if not near.any():
        return
    near &= ~_known(pick(a), pick(b), near.shape)
    sums = [(a, near @ times[b])] + ([] if a is b else [(b, near.T @ times[a])])
    for at, added in sums:
        for k in np.flatnonzero(added):
            links[ids[at[k]]] = links.get(ids[at[k]], 0) + int(added[k])
    # a spanning star of each linked set
    left = near.any(1)
    while left.any():
        root = int(np.argmax(left))
        seen, across = np.zeros(len(a), bool), np.zeros(len(b), bool)
        front = seen.copy()
        front[root] = True
        while front.any():
            seen |= front
            met = near[front].any(0) & ~across
            across |= met
            front = near[:, met].any(1) & ~seen
        edges += [(int(ids[a[root]]), int(k)) for k in np.union1d(ids[a[seen]], ids[b[across]]) if k != ids[a[root]]]
        left &= ~seen


def _verify(cosine: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        held: list[pa.RecordBatch] = []

        def out(final: bool):
            if final or len(links) + len(edges) > 50_000:
                rows = [(k, None, v) for k, v in links.items()] + [(a, b, 0) for a, b in edges]
                links.clear()
                edges.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "n"])

        def done():
            part = pa.Table.from_batches(held)
            held.clear()
            d = np.asarray(pc.binary_length(part.column("vec").combine_chunks()))
            for one in np.unique(d):
                some = part.filter(pa.array(d == one))
                if some.num_rows > 1:
                    _group(some, kind, links, edges, cosine)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.array(batch.column(c)) for c in ("filter", "i", "j")], 1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), batch.num_rows]
            for s, e in zip(starts, starts[1:], strict=False):
                key = tuple(keys[s].tolist())
                if held and key != last:
                    done()
                    yield from out(False)
                last = key
                held.append(batch.slice(s, e - s))
        if held:
            done()
        yield from out(True)

    return run


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row (see the module)."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"), F.monotonically_increasing_id().alias("row"))
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda c: c != 0), F.lit(False))
    kind = "f4" if rows.schema["vec"].dataType.elementType.typeName() == "float" else "f8"
    # 96 bits of two hashes tell vectors apart; a negative zero is made a zero
    vec = F.transform("vec", lambda c: c.cast("float" if kind == "f4" else "double") + F.lit(0.0).cast("float" if kind == "f4" else "double"))
    marked = cut(rows.select("id", "row", F.when(good, vec).alias("vec")).withColumns({"h1": F.when(F.col("vec").isNotNull(), F.xxhash64("vec")), "h2": F.when(F.col("vec").isNotNull(), F.hash("vec"))}))
    distinct = marked.where("vec is not null").groupBy("id", "h1", "h2").agg(F.min("row").alias("row"), F.first("vec").alias("vec"))
    classes = distinct.groupBy("h1", "h2").agg(F.min(F.struct("id", "row")).alias("r"), F.count("*").alias("times"), F.first("vec").alias("vec"))
    # a class goes by the row number of its representative
    classes = cut(classes.select("h1", "h2", F.col("r.row").alias("id"), F.col("r.id").alias("rep"), "times", F.size("vec").alias("d"), "vec"))
    sizes = {r["d"]: r["n"] for r in classes.groupBy("d").agg(F.count("*").alias("n")).collect()}
    plan = {d: choose(n, d, cosine) for d, n in sizes.items()}
    few = all(width**parts * tables < 2**31 for parts, width, _, tables in plan.values())
    made = K.tidy(_listing(plan, kind, pa.int32() if few else pa.int64()))
    listed = cut(classes.select("id", "times", "d", "vec").mapInArrow(made, f"id long, times long, vec binary, filters array<{'int' if few else 'bigint'}>"))
    # of the filters only those before the one at hand go along
    dealt = listed.select("id", "times", "vec", "filters", F.posexplode("filters").alias("p", "filter")).select("id", "times", "vec", F.slice("filters", F.lit(1), F.col("p")).alias("smaller"), "filter")
    large = listed.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = cut(large.select("filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")))
    # known to be small before the vectors move, they move once
    side = F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large
    split = dealt.join(side, "filter", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    split = split.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(o, F.col("chunk")).alias("i"), F.greatest(o, F.col("chunk")).alias("j")))
    sent = ["id", "times", "vec", "smaller", "filter", "chunk"]
    split = split.select(*sent, F.explode(pairs).alias("p")).select(*sent, "p.i", "p.j")
    groups = split.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j")
    found = cut(groups.mapInArrow(K.tidy(_verify(cosine, kind)), "a long, b long, n long"))
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "id")
    # back from classes to ids: the smallest id of each linked set
    joined = cut(components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id"))
    low = joined.join(classes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    info = classes.select("h1", "h2", "id", "rep", "times").join(joined.join(low, "component").select("id", "least"), "id", "left").join(links, "id", "left")
    info = info.select("h1", "h2", F.coalesce("least", "rep").alias("component_id"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = marked.select(F.col("id").alias(key), "h1", "h2").join(info, ["h1", "h2"], "left")
    whole = F.coalesce(F.col("component_id"), F.col(key))
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"), F.coalesce(F.col(key) == whole, F.lit(True)).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
