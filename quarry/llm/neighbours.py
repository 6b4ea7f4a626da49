"""Approximate nearest neighbours by inner product: low-dimensional stable projections in
kd-trees, searched incrementally until a chi-square stopping test holds.

Vectors get one more coordinate that brings all to the largest norm M, and queries are scaled to
norm M, so the largest inner product is the smallest Euclidean distance. A Gaussian (2-stable)
projection to ``dims`` numbers is indexed: for a pair at distance d, the squared projected
distance is d^2 times a chi-square variable with ``dims`` degrees of freedom. A query takes
projected neighbours in ascending projected distance, verifies them with their whole vectors, and
stops as soon as the projected distance reached exceeds the ``confidence`` quantile of that
variable times its k-th best distance: a nearer vector would have shown up before with at least
that probability.

Equal vectors are one point (with its k + 1 smallest ids, all that one result can name), so a
vector that a third of the rows hold is searched and verified once. Points are dealt to cells by
the upper levels of a kd-tree whose splits are fitted on at most ``SAMPLE`` points; every point is
indexed. A task holds one cell of bounded size as a kd-tree and streams queries through it. Queries
visit their own cell first; its k-th distance then bounds which other cells the stopping test lets
them visit. A cell that outgrows ``CELL`` (more points than the sample can split) is dealt to
several parts by a hash.

Defined results: vectors that are null, hold null or non-finite components, have not the commonest
length (of equally common ones the longest), or whose norm is zero or too large for a double, and
rows with a null id take no part; repeated rows are rows of their own, each a neighbour of the
others; ties go to the smaller id; an empty table gives an empty result; queries without another
row give no row. Scores are sums of products from the first component to the last, in double
precision. Only the id and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ready

K, DIMS, CONFIDENCE, SEED = 20, 12, 0.95, 42
#: Points a cell aims at; points that its splits are fitted on; points of a kd-tree leaf.
CELL, SAMPLE, LEAF = 8192, 16384, 64
#: Leaves that a query looks at first; every further look takes twice as many.
FIRST_LEAVES = 8
#: Squared distances, in units of the squared norm, that single precision may be off.
MARGIN = 1e-5
_ASK = "cell int, part int, kind int, key bigint, v array<double>, ids array<bigint>, bound double"
_FOUND = "key bigint, cell int, part int, found array<struct<id:bigint,score:double>>"
_FOUND_TYPE = pa.list_(pa.struct([("id", pa.int64()), ("score", pa.float64())]))


def chi_square_quantile(p: float, dims: int) -> float:
    """The p quantile of the chi-square distribution with an even number of degrees of freedom."""
    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def ordered_sum(a: np.ndarray) -> np.ndarray:
    """Row sums from the first column to the last, as a loop over a row would add them."""
    return np.add.accumulate(a, axis=1)[:, -1]


@dataclass(frozen=True)
class Space:
    """The projection and the cells; a few arrays of at most SAMPLE numbers."""
    norm: float
    directions: np.ndarray  # (length + 1) x dims
    split_dim: np.ndarray   # per inner node of a complete binary tree, the root first
    split_at: np.ndarray
    parts: int

    def project(self, v: np.ndarray) -> np.ndarray:
        """Projections of points (rows), brought to the norm."""
        rest = np.sqrt(np.maximum(self.norm ** 2 - (v * v).sum(1), 0))
        return v @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def project_queries(self, v: np.ndarray) -> np.ndarray:
        return (v * (self.norm / np.sqrt((v * v).sum(1)))[:, None]) @ self.directions[:-1]

    def cells(self, p: np.ndarray) -> np.ndarray:
        node, inner = np.zeros(len(p), np.int64), len(self.split_dim)
        for _ in range((inner + 1).bit_length() - 1):
            right = p[np.arange(len(p)), self.split_dim[node]] > self.split_at[node]
            node = 2 * node + 1 + right
        return node - inner

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of the cells."""
        inner, dims = len(self.split_dim), self.directions.shape[1]
        lo, hi = np.full((2 * inner + 1, dims), -np.inf), np.full((2 * inner + 1, dims), np.inf)
        for i in range(inner):
            for child in (2 * i + 1, 2 * i + 2):
                lo[child], hi[child] = lo[i], hi[i]
            hi[2 * i + 1, self.split_dim[i]] = self.split_at[i]
            lo[2 * i + 2, self.split_dim[i]] = self.split_at[i]
        return lo[inner:], hi[inner:]


def box_distance(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    gap = np.maximum(np.maximum(lo - q, q - hi), 0)
    return (gap * gap).sum(1)


class Tree:
    """A cell's points in kd-tree leaves: projections, vectors, and ids."""

    def __init__(self, space: Space, v: np.ndarray, ids: list[list[int]], confidence: float):
        p = space.project(v)
        order, ends = self._leaves(p)
        self.space, self.p, self.v, self.ids = space, p[order], v[order], [ids[i] for i in order.tolist()]
        self.start = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.end = ends
        self.lo = np.minimum.reduceat(self.p, self.start)
        self.hi = np.maximum.reduceat(self.p, self.start)
        # the test in units of the norm, as are the distances below
        self.stop = chi_square_quantile(confidence, p.shape[1]) * space.norm ** 2
        self.square = (self.p * self.p).sum(1)
        self.places = [np.arange(a, b) for a, b in zip(self.start.tolist(), self.end.tolist())]
        self.unit = (self.v / space.norm).astype(np.float32)
        self.single = all(len(i) == 1 for i in ids)

    @staticmethod
    def _leaves(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Point order and leaf ends, halving the widest dimension at its median."""
        out, todo = [], [np.arange(len(p))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                out.append(own)
                continue
            x = p[own]
            x = x[:, np.argmax(x.max(0) - x.min(0))]
            half = len(own) // 2
            by = np.argpartition(x, half)
            todo += [own[by[half:]], own[by[:half]]]
        return np.concatenate(out), np.cumsum([len(o) for o in out])

    def search(self, q: np.ndarray, bound: float, k: int) -> tuple[list[int], list[float]]:
        """The ids and scores of the k nearest found, nearest first, ties to smaller ids. ``bound``:
        squared distance of the k-th neighbour the query has already."""
        unit = (q / math.sqrt(float((q * q).sum()))).astype(np.float32)
        pq = self.space.project_queries(q[None, :])[0]
        far = box_distance(pq, self.lo, self.hi)
        order = np.argsort(far, kind="stable")
        far = far[order]
        rows, near = np.empty(0, np.int64), np.empty(0)  # verified: places and squared distances
        wait, wait_at = np.empty(0, np.int64), np.empty(0)  # seen, but not next yet
        own = float(pq @ pq)
        i, step, kth = 0, FIRST_LEAVES, bound / self.space.norm ** 2
        while True:
            if i < len(order):
                j = min(len(order), i + step)
                more = np.concatenate([self.places[x] for x in order[i:j].tolist()])
                at = np.maximum(self.square[more] + own - 2 * (self.p[more] @ pq), 0)
                wait, wait_at = np.concatenate([wait, more]), np.concatenate([wait_at, at])
                i, step = j, 2 * step
            reached = far[i] if i < len(order) else np.inf  # all points nearer than this have been seen
            inside = wait_at <= min(reached, self.stop * kth)
            now = wait[inside]
            wait, wait_at = wait[~inside], wait_at[~inside]
            if len(now):
                d = 2 - 2 * (self.unit[now] @ unit)  # single precision, so a margin is kept
                close = d <= kth + MARGIN
                rows, near = np.concatenate([rows, now[close]]), np.concatenate([near, d[close]])
                kth = min(kth, self._kth(rows, near, k))
                keep = near <= kth + MARGIN
                rows, near = rows[keep], near[keep]
            if reached > self.stop * kth or i >= len(order):
                # what waits is farther than the test allows, or than ``reached``
                break
        score = ordered_sum(self.v[rows] * q)
        found = sorted((-s, x) for s, r in zip(score.tolist(), rows.tolist()) for x in self.ids[r])[:k]
        return [x for _, x in found], [-s for s, _ in found]

    def _kth(self, rows: np.ndarray, near: np.ndarray, k: int) -> float:
        """The squared distance of the k-th id among the verified points, in units of the norm."""
        if self.single:
            return float(np.partition(near, k - 1)[k - 1]) if len(near) >= k else math.inf
        if len(near) > k:  # a point has an id at least
            near_k = np.argpartition(near, k - 1)[:k]
            rows, near = rows[near_k], near[near_k]
        left = k
        for r, d in sorted(zip(rows.tolist(), near.tolist()), key=lambda x: x[1]):
            left -= len(self.ids[r])
            if left <= 0:
                return d
        return math.inf


def _square(v: Column) -> Column:
    """Inner product of a vector with itself, added from the first component on."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def _valid(v: Column) -> Column:
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return v.isNotNull() & whole & _square(v).between(F.lit(5e-324), F.lit(1.7e308))


def matrix(col: pa.Array) -> np.ndarray:
    """A column of equally long vectors as rows."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _project(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                v = matrix(b.column("v"))
                yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(space.project(v).tolist(), pa.list_(pa.float64()))], ["h", "p"])
    return run


def _deal(space: Space):
    """Points to the cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                v = matrix(b.column("v"))
                n = len(v)
                part = pa.array(np.array(b.column("h").to_pylist(), np.int64) % space.parts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(space.cells(space.project(v)), pa.int32()), part, pa.array(np.zeros(n, np.int32)),
                     pa.nulls(n, pa.int64()), b.column("v"), b.column("ids"), pa.nulls(n, pa.float64())],
                    ["cell", "part", "kind", "key", "v", "ids", "bound"])
    return run


def _send(space: Space, confidence: float, home: bool):
    """Queries to their own cell, or to the other cells that the stopping test lets them visit."""
    lo, hi = space.boxes()
    stop = chi_square_quantile(confidence, space.directions.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            v = matrix(b.column("v"))
            p = space.project_queries(v)
            own, keys, bounds = space.cells(p), b.column("key").to_pylist(), b.column("bound").to_pylist()
            for r in range(len(v)):
                if home:
                    to = [(int(own[r]), keys[r] % space.parts)]
                else:
                    near = np.flatnonzero(box_distance(p[r], lo, hi) <= stop * bounds[r]).tolist()
                    to = [(c, part) for c in near for part in range(space.parts) if (c, part) != (own[r], keys[r] % space.parts)]
                for i in range(0, len(to), 4096):
                    n = len(part_of := to[i: i + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c for c, _ in part_of], pa.int32()), pa.array([x for _, x in part_of], pa.int32()),
                         pa.array([1] * n, pa.int32()), pa.array([keys[r]] * n, pa.int64()),
                         b.column("v").take(pa.array([r] * n)), pa.nulls(n, pa.list_(pa.int64())),
                         pa.array([bounds[r]] * n, pa.float64())], ["cell", "part", "kind", "key", "v", "ids", "bound"])
    return run


def _visit(space: Space, confidence: float, k: int):
    """Rows sorted by cell, part and kind (points, then queries): a tree per cell part, and an
    answer per query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, v, ids = None, None, [], []
        for b in batches:
            where = list(zip(b.column("cell").to_pylist(), b.column("part").to_pylist()))
            kinds, keys, bounds = (b.column(c).to_pylist() for c in ("kind", "key", "bound"))
            if not len(b):
                continue
            vectors, own = matrix(b.column("v")), b.column("ids").to_pylist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for r in range(len(b)):
                if where[r] != at:
                    at, tree, v, ids = where[r], None, [], []
                if kinds[r] == 0:
                    v.append(vectors[r])
                    ids.append(own[r])
                    continue
                if tree is None and v:
                    tree, v = Tree(space, np.stack(v), ids, confidence), []
                if tree is not None:
                    found = tree.search(vectors[r], bounds[r], k)
                else:  # a cell part without points
                    found = ([], [])
                for o, x in zip(out, (keys[r], *at, [{"id": i, "score": s} for i, s in zip(*found)])):
                    o.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], _FOUND_TYPE)], ["key", "cell", "part", "found"])
    return run


def points_of(rows: DataFrame, keep: int) -> DataFrame:
    """v, ids, h: every distinct vector with its ``keep`` smallest ids (a limit per vector before
    the shuffle) and a hash."""
    by = Window.partitionBy("v").orderBy("id")
    return rows.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= keep) \
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", "ids", F.xxhash64("v").alias("h"))


def fit(points: DataFrame, dims: int, cell: int, seed: int) -> Space | None:
    """The space of the points (v, ids, h): the norm and the number of points from all of them,
    splits from the SAMPLE points with the smallest hashes. None if there are no points."""
    n, most, length = points.agg(F.count("*"), F.max(_square(F.col("v"))), F.max(F.size("v"))).first()
    if not n:
        return None
    directions = np.random.default_rng(seed).standard_normal((length + 1, dims))
    flat = Space(math.sqrt(most), directions, np.empty(0, np.int64), np.empty(0), 1)
    some = points.select("h", "v").orderBy("h").limit(SAMPLE).mapInArrow(_project(flat), "h bigint, p array<double>")
    levels = max(0, min(math.ceil(math.log2(n / cell)), int(math.log2(SAMPLE / LEAF))))
    groups, split_dim, split_at = [np.array([r["p"] for r in some.collect()], float)], [], []
    for _ in range(levels):
        halves = []
        for g in groups:
            d = int(np.argmax(g.max(0) - g.min(0))) if len(g) else 0
            c = float(np.median(g[:, d])) if len(g) else 0.0
            split_dim.append(d)
            split_at.append(c)
            halves += [g[g[:, d] <= c], g[g[:, d] > c]]
        groups = halves
    parts = max(1, math.ceil(n / (cell << levels)))
    return Space(flat.norm, directions, np.array(split_dim, np.int64), np.array(split_at), parts)


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE,
            cell: int = CELL, seed: int = SEED) -> DataFrame:
    """query_id, rank, id, score: for every row of ``queries`` (id, v) the k nearest found among
    ``rows`` (id, v), its own row left out. Vectors are arrays of doubles."""
    spark = ready(rows.sparkSession)
    spec = "query_id bigint, rank int, id bigint, score double"
    rows, queries = (x.filter(F.col("id").isNotNull() & _valid(F.col("v"))).select(F.col("id").cast("long").alias("id"), "v")
                     for x in (rows, queries))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], spec)
    rows, queries = (x.filter(F.size("v") == common["n"]) for x in (rows, queries))
    points = points_of(rows, k + 1).checkpoint()
    space = fit(points, dims, cell, seed)
    asked = queries.groupBy("v").agg(F.min("id").alias("key")).withColumn("bound", F.lit(math.inf)).checkpoint()
    dealt = points.mapInArrow(_deal(space), _ASK)

    def visit(asks: DataFrame) -> DataFrame:
        both = dealt.unionByName(asks).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
        return both.mapInArrow(_visit(space, confidence, k + 1), _FOUND)

    first = visit(asked.mapInArrow(_send(space, confidence, True), _ASK)).checkpoint()
    norm = F.lit(space.norm)
    length = F.sqrt(_square(F.col("v")))
    kth = F.get("found", F.lit(k))["score"]
    bounded = asked.drop("bound").join(first, "key").select("key", "v", F.coalesce(
        F.greatest(2 * norm * norm - 2 * norm / length * kth, F.lit(0.0)), F.lit(math.inf)).alias("bound"))
    second = visit(bounded.mapInArrow(_send(space, confidence, False), _ASK))
    every = first.unionByName(second).select("key", F.explode("found").alias("x")).select("key", "x.id", "x.score")
    by = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    best = every.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1) \
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("l"))
    # a query's own row: the first of its id with its own score
    own = _square(F.col("v"))
    by_query = queries.join(asked.select("v", "key"), "v").select("id", "key", own.alias("own")).join(best, "key")
    other = F.filter("l", lambda x: ~((x["id"] == F.col("id")) & (x["score"] == F.col("own")) & (x["r"] == F.col("at"))))
    mine = F.array_min(F.transform(F.filter("l", lambda x: (x["id"] == F.col("id")) & (x["score"] == F.col("own"))), lambda x: x["r"]))
    return by_query.withColumn("at", F.coalesce(mine, F.lit(0))).select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(other, 1, k)).alias("p", "x")) \
        .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


def op11(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    found = nearest(rows, rows.filter(F.col("id") % 20 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
