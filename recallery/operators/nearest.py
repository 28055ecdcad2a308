"""Exact dense top-k within a sample, behind bounds.

A large sample's vectors are grouped around pivots, about the square root of their number of them, chosen by a hash; a group has a
radius, the greatest angle to its pivot. By the triangle inequality on the sphere no member is nearer to a question than
the pivot's angle less the radius. The nearest groups of a question are scored first; the k-th best score so far is what
other groups must be able to reach, and those that can't are never joined with the question. Groups are scored by products of
matrices, each question's k best of a group go on, and what is left is merged.

Small samples, and those that hold vectors of several lengths, nulls or numbers that are not finite, are joined as they are, in
parts. Results are the same either way.

Edge cases: a vector of length 0 scores 0; ties go by id as text; with ``clip`` a score is at least 0, so that where fewer than k are
positive the others follow by id; a negative k gives no rows; a question of a sample without vectors gives none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recallery.functions import metrics as M
from recallery.sources.scratch import settle
from recallery.sources.ship import ship

#: Vectors from which a sample is grouped; pivots of a sample at most; vectors or questions that one task takes on a side.
LARGE, MOST_PIVOTS, PART = 10_000, 4096, 20_000
#: Questions that one product of matrices scores, and whose bounds one task takes; what rounding may do to a bound.
KERNEL, BOUNDED, SLACK = 512, 2000, 1e-7
#: The group of vectors of length 0.
ZERO = ""

_PLACED = "sample_id string, pivot string, id string, vec array<double>, angle double"
_ASKED = "sample_id string, pivot string, qa int"
_SCORED = "sample_id string, qa int, id string, s double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1, or 0."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.zeros((0, 0))
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _placed(key: tuple, rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Each vector with its nearest pivot."""
    x, p = _matrix(rows.column("vec")), _matrix(pivots.column("vec"))
    near, angle = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), KERNEL):
        to = _angles(x[a : a + KERNEL], p)
        near[a : a + KERNEL], angle[a : a + KERNEL] = to.argmin(1), to.min(1)
    zero = ~x.any(1)
    names = pc.if_else(pa.array(zero), ZERO, pivots.column("pivot").combine_chunks().take(pa.array(near)))
    return pa.Table.from_arrays([rows.column("sample_id"), names, rows.column("id"), _lists(x), pa.array(np.where(zero, 0.0, angle))], names=["sample_id", "pivot", "id", "vec", "angle"])


def bounds(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of questions to pivots, and the most that a member of each group can score."""
    angle = _angles(q, pivots)
    return angle, np.where(zero[None, :], 0.0, np.cos(np.maximum(angle - radius[None, :], 0.0)))


def _asking(k: int, first: bool, clip: bool) -> Callable:
    """The groups that questions ask: those nearest that hold k vectors, or those that may reach ``need``."""

    def run(key: tuple, questions: pa.Table, groups: pa.Table) -> pa.Table:
        q, p = _matrix(questions.column("qvec")), groups.column("vec").combine_chunks()
        zero = pc.equal(groups.column("pivot"), ZERO).to_numpy()
        radius, n = groups.column("radius").to_numpy(), groups.column("n").to_numpy()
        pivots = np.zeros((len(zero), q.shape[1]))
        if (~zero).any():
            pivots[~zero] = _matrix(p.filter(pa.array(~zero)))
        rows, columns = [], []
        for a in range(0, len(q), KERNEL):
            angle, bound = bounds(q[a : a + KERNEL], pivots, radius, zero)
            bound = np.maximum(bound, 0.0) if clip else bound
            order = np.argsort(angle, axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            near = np.zeros(angle.shape, bool)
            np.put_along_axis(near, order, before < k, axis=1)
            if not first:
                need = questions.column("need").to_numpy(zero_copy_only=False)[a : a + KERNEL].astype(np.float64)
                near = (bound >= np.nan_to_num(need, nan=-np.inf)[:, None] - SLACK)
            i, j = np.nonzero(near)
            rows.append(a + i)
            columns.append(j)
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, columns))
        return pa.Table.from_arrays([questions.column("sample_id").take(pa.array(i)), groups.column("pivot").take(pa.array(j)), questions.column("qa").take(pa.array(i))], names=["sample_id", "pivot", "qa"])

    return run


def _scoring(k: int, clip: bool) -> Callable:
    """The k best of a group for each question that asks it, as far as they reach ``need``."""

    def run(key: tuple, members: pa.Table, asked: pa.Table) -> pa.Table:
        q, v = _matrix(asked.column("qvec")), _matrix(members.column("vec"))
        ids = np.array(members.column("id").to_pylist(), dtype=object)
        by_id = np.argsort(ids, kind="stable")  # as text: Python compares code points
        ids, v, out = ids[by_id], v[by_id], []
        need = np.nan_to_num(asked.column("need").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
        for a in range(0, len(q) if len(v) else 0, KERNEL):
            s = np.round(q[a : a + KERNEL] @ v.T, 9)
            s = np.maximum(s, 0.0) + 0.0 if clip else s + 0.0
            # a stable order keeps equal scores in the order of their ids
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(s, best, 1)
            i, j = np.nonzero(found >= need[a : a + KERNEL, None])
            out.append((a + i, best[i, j], found[i, j]))
        row, at, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.Table.from_arrays([asked.column("sample_id").take(pa.array(row)), asked.column("qa").take(pa.array(row)), pa.array(ids[at].tolist(), pa.string()), pa.array(s)], names=["sample_id", "qa", "id", "s"])

    return run


def _dealt(df: DataFrame, key: str, parts: str, name: str) -> DataFrame:
    """A row's part of a number of parts, by a hash of its key."""
    return df.withColumn(name, F.pmod(F.xxhash64(key), F.col(parts)).cast("int"))


def _every(df: DataFrame, parts: str, name: str) -> DataFrame:
    """A row for each of a number of parts."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))


def _cogrouped(left: DataFrame, right: DataFrame, by: list[str], run: Callable, schema: str) -> DataFrame:
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def _parts(n: Column, size: int = 0) -> Column:
    return F.ceil(n / (size or PART)).cast("int")


class Groups:
    """The vectors of large samples around pivots. ``members``: sample_id, pivot, id, vec, angle; ``around``: sample_id, pivot, n, radius, vec (of the pivot)."""

    def __init__(self, vectors: DataFrame, sizes: DataFrame):
        ship(vectors.sparkSession)
        rows = vectors.join(sizes.select("sample_id", F.col("n"), "least"), "sample_id")
        wanted = F.least(F.ceil(F.sqrt(F.col("n").cast("double"))), F.lit(MOST_PIVOTS))
        chosen = (F.pmod(F.xxhash64("id"), F.col("n")) < wanted) | (F.col("id") == F.col("least"))
        # about the square root of the sample's vectors, MOST_PIVOTS at most; where ids repeat, of each any one
        pivots = settle(rows.where(chosen).where(F.exists("vec", lambda x: x != 0)).groupBy("sample_id", F.col("id").alias("pivot")).agg(F.max(F.col("vec")).alias("vec"), _parts(F.max("n")).alias("np")))
        sent = _dealt(rows.withColumn("np", _parts(F.col("n"))), "id", "np", "part").select("sample_id", "part", "id", "vec")
        has = sent.join(pivots.select("sample_id").distinct(), "sample_id", "left_semi")
        placed = _cogrouped(has, _every(pivots, "np", "part").select("sample_id", "part", "pivot", "vec"), ["sample_id", "part"], _placed_rows, _PLACED)
        none = sent.join(pivots.select("sample_id").distinct(), "sample_id", "left_anti").select("sample_id", F.lit(ZERO).alias("pivot"), "id", F.col("vec").cast("array<double>").alias("vec"), F.lit(0.0).alias("angle"))
        self.members = settle(placed.unionByName(none))
        groups = self.members.groupBy("sample_id", "pivot").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        self.around = settle(groups.join(pivots.select("sample_id", "pivot", F.col("vec").cast("array<double>").alias("vec")), ["sample_id", "pivot"], "left"))


def _placed_rows(key: tuple, rows: pa.Table, pivots: pa.Table) -> pa.Table:
    if rows.num_rows:
        return _placed(key, rows, pivots)
    empty = pa.array([], pa.string())
    return pa.Table.from_arrays([empty, empty, empty, pa.array([], pa.list_(pa.float64())), pa.array([], pa.float64())], names=["sample_id", "pivot", "id", "vec", "angle"])


def asked_groups(questions: DataFrame, groups: Groups, k: int, clip: bool, first: bool) -> DataFrame:
    """(sample_id, pivot, qa): the groups that each question must see: at first the nearest that hold k vectors, then
    those that may reach ``need``. ``questions``: sample_id, qa, qvec and maybe need."""
    counted = questions.groupBy("sample_id").agg(_parts(F.count("*"), BOUNDED).alias("np"))
    sent = _dealt(questions.join(counted, "sample_id"), "qa", "np", "part").drop("np")
    around = _every(groups.around.join(counted, "sample_id"), "np", "part").select("sample_id", "part", "pivot", "n", "radius", "vec")
    return _cogrouped(sent, around, ["sample_id", "part"], _guarded(_asking(k, first, clip), _ASKED), _ASKED)


def _guarded(run: Callable, schema: str) -> Callable:
    """A function over two tables that gives nothing where one is empty."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    empty = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in schema.split(", ")]).empty_table()
    return lambda key, a, b: run(key, a, b) if a.num_rows and b.num_rows else empty


def group_scores(groups: Groups, questions: DataFrame, asked: DataFrame, k: int, clip: bool) -> DataFrame:
    """(sample_id, qa, id, s): the k best members of each asked group, for each question (sample_id, qa, qvec and maybe need, the score from
    which they count); large groups, and groups that many questions ask, in parts."""
    need = F.col("need") if "need" in questions.columns else F.lit(None).cast("double")
    counted = asked.groupBy("sample_id", "pivot").agg(_parts(F.count("*")).alias("nq"))
    both = settle(counted.join(groups.around.select("sample_id", "pivot", _parts(F.col("n")).alias("nv")), ["sample_id", "pivot"]))
    by = ["sample_id", "pivot", "i", "j"]
    members = _every(_dealt(groups.members.join(both, ["sample_id", "pivot"]), "id", "nv", "i"), "nq", "j").select(*by, "id", "vec")
    sent = _every(_dealt(asked.join(both, ["sample_id", "pivot"]), "qa", "nq", "j"), "nv", "i").join(questions.select("sample_id", "qa", "qvec", need.alias("need")), ["sample_id", "qa"]).select(*by, "qa", "qvec", "need")
    return _cogrouped(members, sent, by, _guarded(_scoring(k, clip), _SCORED), _SCORED)


def needing(questions: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Questions with ``need``, the k-th best score of ``first``; null where there are fewer."""
    need = _ranked(first, k).groupBy("sample_id", "qa").agg(F.max(F.when(F.col("rank") == k, F.col("s"))).alias("need"))
    return questions.join(need, ["sample_id", "qa"], "left")


def behind(questions: DataFrame, groups: Groups, nearest: DataFrame, k: int, clip: bool) -> DataFrame:
    """(sample_id, pivot, qa): the groups beside the ``nearest`` that may hold better vectors than questions ``need``."""
    return asked_groups(questions, groups, k, clip, False).join(nearest, ["sample_id", "pivot", "qa"], "left_anti")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("sample_id", "qa").orderBy(F.desc("s"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("sample_id", "qa", "id", "s", "rank")


def joined(questions: DataFrame, vectors: DataFrame, clip: bool) -> DataFrame:
    """(sample_id, qa, id, s) of every question and every vector of its sample. A sample with many
    questions or vectors is dealt to parts, each pair of parts a join of its own."""
    q = questions.select("sample_id", "qa", M.unit(F.col("qvec")).alias("_q"))
    v = vectors.select("sample_id", "id", M.unit(F.col("vec")).alias("_v"))
    size = v.groupBy("sample_id").agg(_parts(F.count("*")).alias("_nv")).join(q.groupBy("sample_id").agg(_parts(F.count("*")).alias("_nq")), "sample_id")
    q = _every(_dealt(q.join(size, "sample_id"), "qa", "_nq", "_i"), "_nv", "_j").select("sample_id", "qa", "_q", "_i", "_j")
    v = _every(_dealt(v.join(size, "sample_id"), "id", "_nv", "_j"), "_nq", "_i").select("sample_id", "id", "_v", "_i", "_j")
    dot = M.dot(F.col("_q"), F.col("_v"))
    return q.join(v, ["sample_id", "_i", "_j"]).select("sample_id", "qa", "id", F.round(M.clipped(dot) if clip else dot, 9).alias("s"))


def top_k(questions: DataFrame, vectors: DataFrame, k: int, clip: bool = True) -> DataFrame:
    """(sample_id, qa, id, s, rank): the k best vectors of its sample for each question by cosine. ``questions``: sample_id, qa, qvec;
    ``vectors``: sample_id, id, vec."""
    k = max(k, 0)
    plain = lambda c: F.coalesce(~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    shape = lambda c: [F.min(F.size(c)).alias("low"), F.max(F.size(c)).alias("high"), F.bool_and(plain(c)).alias("plain")]
    sizes = vectors.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("id").alias("least"), *shape("vec")).where((F.col("n") >= LARGE) & F.col("plain") & (F.col("low") == F.col("high")))
    told = questions.groupBy("sample_id").agg(*(c.alias(f"q{i}") for i, c in enumerate(shape("qvec"))))
    large = settle(sizes.join(told, "sample_id").where((F.col("q0") == F.col("low")) & (F.col("q1") == F.col("low")) & F.col("q2")).select("sample_id", "n", "least"))
    if not k or large.isEmpty():
        return _ranked(joined(questions, vectors, clip), k)
    names = large.select("sample_id")
    small = joined(questions.join(names, "sample_id", "left_anti"), vectors.join(names, "sample_id", "left_anti"), clip)
    asking = settle(questions.join(names, "sample_id", "left_semi").select("sample_id", F.col("qa").cast("int").alias("qa"), F.col("qvec").cast("array<double>").alias("qvec")))
    groups = Groups(vectors.join(names, "sample_id", "left_semi").select("sample_id", "id", F.col("vec").cast("array<double>").alias("vec")), large)
    nearest = settle(asked_groups(asking, groups, k, clip, True))
    first = settle(group_scores(groups, asking, nearest, k, clip))
    asking = settle(needing(asking, first, k))
    rest = group_scores(groups, asking, settle(behind(asking, groups, nearest, k, clip)), k, clip)
    return _ranked(small.unionByName(first).unionByName(rest), k)
