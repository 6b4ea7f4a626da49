"""Consensus fits, own aggregates, table functions and scorers against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.aggregates import Aggregate, Histogram, Moments, aggregate
from quarry.functions.tables import rising_runs
from quarry.functions.udfs import tolerant_udf
from quarry.operators import motion as MO
from quarry.operators.scoring import centroids, nearest_centroid


# -- consensus -----------------------------------------------------------------------

MATCHES = "vec_id long, m array<struct<pt:long,x0:double,y0:double,x1:double,y1:double>>"


def _moved(rnd, angle, dx, dy, n, outliers):
    rows = []
    for i in range(n):
        x, y = rnd.uniform(-1, 1), rnd.uniform(-1, 1)
        u, v = math.cos(angle) * x - math.sin(angle) * y + dx, math.sin(angle) * x + math.cos(angle) * y + dy
        rows.append((i, x, y, *((rnd.uniform(-3, 3), rnd.uniform(-3, 3)) if i < outliers else (u, v))))
    return rows


def test_outliers_do_not_move_the_fit(spark):
    rnd = random.Random(7)
    want = {k: (rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for k in range(60)}
    df = spark.createDataFrame([(k, _moved(rnd, *want[k], 40, 18)) for k in want], MATCHES)
    got = {r.vec_id: r for r in MO.consensus_fit(df).collect()}
    for k, (angle, dx, dy) in want.items():
        assert got[k].n_inliers >= 22 and (got[k].da, got[k].dx, got[k].dy) == pytest.approx((angle, dx, dy), abs=1e-3)
    again = {r.vec_id: r for r in MO.consensus_fit(df.repartition(3)).collect()}
    assert got == again
    plain = MO.least_squares(F.col("m"))
    off = [abs(r.f.dx - want[r.vec_id][1]) for r in df.select("vec_id", plain.alias("f")).collect()]
    assert sum(x > 0.01 for x in off) > 50  # the plain fit is moved


def test_degenerate_matches_give_no_motion(spark):
    same = [(i, 1.0, 1.0, 2.0, 2.0) for i in range(5)]
    df = spark.createDataFrame([(1, []), (2, same[:1]), (3, same)], MATCHES)
    assert all((r.n_inliers, r.dx, r.dy, r.da) == (0, None, None, None) for r in MO.consensus_fit(df).collect())


def test_vectors_are_paired_whole(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0, 7.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: [tuple(p) for p in r.m] for r in MO.matches(MO.vector_pairs(v)).collect()}
    assert got == {1: [(0, 1.0, 2.0, 4.0, 5.0)], 4: [], 5: []}
    plan = MO.consensus_fit(MO.matches(MO.vector_pairs(v)))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


# -- aggregates ------------------------------------------------------------------------

def _extremes():
    """An aggregate of the tests' own (defined here, so tasks get it by value)."""
    class Extremes(Aggregate):
        size, result = 2, "low double, high double"

        def partial(self, values):
            return np.array([values.min(), values.max()])

        def merge(self, states):
            return np.array([states[:, 0].min(), states[:, 1].max()])

        def finish(self, state):
            return tuple(state.tolist())

    return Extremes()


def test_merging_in_any_grouping_is_the_whole():
    rnd = np.random.default_rng(5)
    values = rnd.gamma(2, 3, 1000)
    for agg in (Moments(), Histogram(0, 20, 7), _extremes()):
        whole = agg.partial(values)
        for _ in range(20):
            parts = np.split(values, np.sort(rnd.integers(1, 999, 6)))
            states = [agg.partial(p) for p in parts if len(p)]
            left = agg.merge(np.stack([agg.merge(np.stack(states[:2])), *states[2:]]))
            assert np.allclose(left, whole) and np.allclose(agg.merge(np.stack(states[::-1])), whole)


def test_own_aggregates_by_key(spark):
    rnd = random.Random(4)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 40}", i % 2, None if i % 13 == 0 else rnd.gauss(5, 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, odd int, v double").repartition(7)
    want = {}
    for k, odd, v in rows:
        if v is not None:
            want.setdefault((k, odd), []).append(v)
    got = {(r.k, r.odd): (r.low, r.high) for r in aggregate(df, ["k", "odd"], "v", _extremes()).collect()}
    assert got == {k: (min(v), max(v)) for k, v in want.items()}
    moments = {(r.k, r.odd): r for r in aggregate(df, ["k", "odd"], "v", Moments()).collect()}
    assert set(moments) == set(want)
    for k, v in want.items():
        assert (moments[k].n, moments[k].mean, moments[k].variance) == pytest.approx((len(v), np.mean(v), np.var(v)))
    assert aggregate(df.limit(0), ["k"], "v", Moments()).count() == 0


def test_own_aggregates_over_tasks_without_a_row(spark):
    """Tasks that no row of the input, or no key, is dealt to."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        df = spark.range(0, 2, 1, 8).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
        assert sorted(tuple(r) for r in aggregate(df, ["k"], "v", Moments()).collect()) == [(0, 1, 0.0, 0.0, None), (1, 1, 1.0, 0.0, None)]
        assert sorted(tuple(r) for r in aggregate(df, ["k"], "v", Histogram(0, 2, 2)).collect()) == [(0, 1, [1, 0], 0), (1, 1, [0, 1], 1)]
    finally:
        spark.conf.set(name, old)


# -- table function ----------------------------------------------------------------------

def test_rising_runs(spark):
    values = [1.0, 2.0, 3.0, 3.0, 1.0, None, 5.0, 6.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)] + [(2, 0, None)] + [(3, i, float(i)) for i in range(500)],
                               "video long, frame long, dx double").repartition(5)
    got = sorted(map(tuple, rising_runs(df).collect()))
    assert got[:4] == [(1, 0, 0, 3, 1.0, 3.0), (1, 0, 3, 1, 3.0, 3.0), (1, 0, 4, 1, 1.0, 1.0), (1, 0, 6, 2, 5.0, 6.0)]
    assert [r[:4] for r in got[4:]] == [(3, 0, 0, 201), (3, 1, 201, 200), (3, 2, 401, 99)]
    assert rising_runs(df.limit(0)).count() == 0


# -- scorers -----------------------------------------------------------------------------

def test_a_scorer_is_made_once_a_task(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, int(i % 4) if i % 9 else None, (rnd.standard_normal(6) + i % 4).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    made = spark.sparkContext.accumulator(0)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # many batches a task
    try:
        got = {r.vec_id: (r.label, r.nearest) for r in nearest_centroid(df, centroids(df), made).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert made.value == 5
    c = {x: np.mean([v for _, y, v in rows if y == x], axis=0) for x in range(4)}
    assert got == {i: (x, min(c, key=lambda y: (((np.array(v) - c[y]) ** 2).sum(), y))) for i, x, v in rows}
    assert [r.nearest for r in nearest_centroid(df.limit(3), centroids(df.limit(0))).collect()] == [None] * 3


def test_failing_rows_are_null_wherever_they_stand(spark):
    calls = spark.sparkContext.accumulator(0)

    def inverse(s):
        calls.add(1)
        return s.map(lambda x: 12 // x)

    f = tolerant_udf(inverse, "long")
    df = spark.range(0, 400, 1, 1).select("id", F.when(F.col("id").isin(7, 8, 399), 0).otherwise(F.col("id") % 5 + 1).alias("x"))
    got = {r.id: r.y for r in df.select("id", f("x").alias("y")).collect()}
    assert got == {i: None if i in (7, 8, 399) else 12 // (i % 5 + 1) for i in range(400)}
    assert calls.value < 60  # halves, not row by row
