"""Hand-written edge fixtures, each checked against a plain Python statement of the rule."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import exchange as X
from quarry.operators import logs as LG
from quarry.operators import trajectory as TR
from quarry.operators import trips as T
from quarry.operators import voting as V
from quarry.functions.scalars import trip_duration


def test_duration_seconds_component(spark):
    base = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [(base, base + dt.timedelta(minutes=10)), (base, base + dt.timedelta(hours=24, minutes=10)),
            (base, base - dt.timedelta(seconds=1)), (base, None)]
    df = spark.createDataFrame(rows, "p timestamp_ntz, d timestamp_ntz")
    got = [r.s for r in df.select(trip_duration("p", "d").alias("s")).collect()]
    assert got == [600, 600, 86399, None]


def test_group_gate(spark):
    rows = [("f", 1, 1)] + [("f", 2, i) for i in range(3)] + [("f", 3, i) for i in range(4)] + \
           [("f", None, i) for i in range(4)]
    df = spark.createDataFrame(rows, "file string, pickup_location_id long, trip_id long")
    got = {(r.pickup_location_id, r.n_rows) for r in T.gated_groups(df).collect()}
    assert got == {(3, 4), (None, 4)}


def _smooth_py(v, r):
    n = len(v)
    tr, s = [], 0.0
    for x in v:
        s += x
        tr.append(s)
    out = []
    for f in range(n):
        win = [tr[min(max(j, 0), n - 1)] for j in range(f - r, f + r + 1)]
        out.append(sum(win) / (2 * r + 1) - tr[f] + v[f])
    return out


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 11, 20])
def test_smooth_clamp_and_replicate(spark, n):
    r = 5
    v = [((i * 7919) % 13) / 3.0 for i in range(n)]
    tf = spark.createDataFrame([(1, i, i, x, 2 * x, x / 10) for i, x in enumerate(v)],
                               "video long, frame long, event_id long, dx double, dy double, da double")
    got = {x.frame: x.smooth_dx for x in TR.smooth(tf, r, chunk_rows=6).collect()}
    exp = _smooth_py(v, r)
    assert all(abs(got[f] - exp[f]) < 1e-6 for f in range(n))


def _vote_py(labels):
    counts, first3 = {}, labels[:3]
    for lab in first3:
        counts[lab] = counts.get(lab, 0) + 1
        if counts[lab] >= 2:
            return min(3, len(labels)), lab
    k = len(first3)
    for lab in labels[3:11]:
        k += 1
        counts[lab] = counts.get(lab, 0) + 1
        if counts[lab] >= k // 2 + 1:
            return k, lab
    return min(len(labels), 11), None


@pytest.mark.parametrize("labels", [
    list("aab"), list("abcaa") + list("zzzz"), list("abcdefghijklmn"), list("ab"), list("abcabcbbbb")])
def test_vote(spark, labels):
    votes = spark.createDataFrame([(1, k + 1, lab) for k, lab in enumerate(labels)], "item long, k long, label string")
    r = V.majority_vote(votes).collect()[0]
    assert (r.models_run, r.winner) == _vote_py(labels)


@pytest.mark.parametrize("r,m", [(5, 3), (6, 4), (7, 3), (2, 3)])
def test_balanced_buckets_match_ntile(spark, r, m):
    items = spark.createDataFrame([(i,) for i in range(r)], "key long")
    got = {(x.key, x.bucket, x.pos_in_bucket) for x in X.balanced_buckets(items, "key", m).collect()}
    q, rem = divmod(r, m)
    exp, i = set(), 0
    for b in range(m):
        for p in range(q + (1 if b < rem else 0)):
            exp.add((i, b + 1, p + 1))
            i += 1
    assert got == exp
    rr = [x.key for x in X.interleave(X.balanced_buckets(items, "key", m), "key", m).orderBy("rr_order").collect()]
    assert rr == [k for _, _, k in sorted((p, b, k) for k, b, p in exp)]


def _split(spark, rows):
    return spark.createDataFrame(
        rows, "file string, pickup_location_id long, is_test boolean, dropoff_location_id long, trip_duration long")


def test_regression_edges(spark):
    # one distinct x: slope 0, intercept = mean; x midway between trained 10 and 20 goes to the lower.
    rows = [("f", 1, False, 5, 10), ("f", 1, False, 5, 20), ("f", 1, True, 7, 40),
            ("f", 2, False, 10, 100), ("f", 2, False, 20, 200), ("f", 2, True, 15, 100)]
    s = _split(spark, rows)
    ols = {r.pickup_location_id: r.mae for r in T.ols_group_mae(s).collect()}
    assert ols[1] == 25.0
    tree = {r.pickup_location_id: r.mae for r in T.tree_group_mae(s).collect()}
    assert tree[2] == 0.0 and tree[1] == 25.0


@pytest.mark.parametrize("seq,exp", [
    (["a"], [("a", 1, 1)]), (["a", "a", "a"], [("a", 1, 3)]),
    (["a", "b", "a", "b"], [("a", 1, 1), ("b", 2, 1), ("a", 3, 1), ("b", 4, 1)])])
def test_run_lengths(spark, seq, exp):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(seq)], "u long, t long, name string")
    got = sorted((r.name, r.run_start, r.run_length) for r in LG.run_lengths(df, ["u"], ["t"], "name").collect())
    assert got == sorted(exp)


def _pairs(spark, pts):
    return spark.createDataFrame([(1, i, x0, y0, x1, y1, 1) for i, (x0, y0, x1, y1) in enumerate(pts)],
                                 "vec_id long, pt long, x0 double, y0 double, x1 double, y1 double, status int")


def test_similarity_shift_rotation_single_point(spark):
    base = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)]
    shift = _pairs(spark, [(x, y, x + 0.5, y - 0.25) for x, y in base])
    r = TR.similarity_fit(shift).collect()[0]
    assert (r.dx, r.dy, r.da) == (0.5, -0.25, 0.0)
    a = 0.3
    rot = _pairs(spark, [(x, y, math.cos(a) * x - math.sin(a) * y, math.sin(a) * x + math.cos(a) * y) for x, y in base])
    r = TR.similarity_fit(rot).collect()[0]
    assert abs(r.da - a) < 1e-6 and abs(r.dx) < 1e-6 and abs(r.dy) < 1e-6
    one = _pairs(spark, [(0.1, 0.2, 0.3, 0.4)])
    r = TR.similarity_fit(one).collect()[0]
    assert r.da is None and r.n_points == 1


def test_stat_text(spark):
    docs = spark.createDataFrame([
        (1, "nothing to see here"),
        (2, "Spilled 12.5 MiB 7 objects write throughput 3 4 5 MiB/s executed x executed in 3.5s"),
        (3, "a\nSpilled 1 b\nc Spilled 2\nSpilled"),
    ], "doc_id long, text string")
    p = {r.doc_id: r for r in LG.parse_stats(docs, "Spilled", duration_marker="executed").collect()}
    assert (p[1].amount, p[1].amount_num, p[1].duration) == ("", 0.0, None)
    assert (p[2].amount, p[2].objects, p[2].throughput, p[2].amount_num) == ("12.5", "7", "4", 12.5)
    assert p[2].duration == "3.5"
    s = {r.doc_id: (r.n_lines, r.amount, r.objects) for r in LG.sum_stats(docs, "Spilled").collect()}
    assert s == {2: (1, 12.5, 7.0), 3: (3, 3.0, 0.0)}


def test_duration_ignores_session_time_zone(spark):
    rows = [(dt.datetime(2024, 3, 10, 1, 30), dt.datetime(2024, 3, 10, 3, 30))]   # US DST starts in between
    df = spark.createDataFrame(rows, "p timestamp_ntz, d timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert df.select(trip_duration("p", "d").alias("s")).collect()[0].s == 7200
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_null_keys_are_groups_of_their_own(spark):
    from quarry.operators import results as RS
    from quarry.operators import trajectory as TR
    from quarry.plans.quantiles import exact_quantiles
    vals = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), ("a", 5.0, 3)], "k string, v double, i long")
    assert sorted((r.k or "", r.v, r.ecdf) for r in RS.ecdf(vals, ["k"], "v", "i").collect()) == [
        ("", 1.0, 0.5), ("", 3.0, 1.0), ("a", 5.0, 1.0)]
    assert {r.k: r.p50 for r in exact_quantiles(vals, ["k"], "v", [0.5]).collect()} == {None: 2.0, "a": 5.0}
    got = spark.createDataFrame([(None, 0), (None, 0), (None, 1), ("a", 0)], "video string, frame long")
    assert {r.video: (r.n_received, r.n_delivered) for r in TR.idempotent_sink(got).collect()} == {None: (3, 2), "a": (1, 1)}
    done = TR.completeness(got.dropDuplicates(), got.dropDuplicates()).collect()
    assert {r.video: r.complete for r in done} == {None: True, "a": True}
    short = TR.completeness(got.dropDuplicates(), got.dropDuplicates().filter("frame = 0")).collect()
    assert {r.video: r.complete for r in short} == {None: False, "a": True}


def test_first_match_by_item_and_token(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "xtwoy zz"), (3, "ab cd"), (4, None), (5, ""), (6, "é1é")],
                                 "doc_id long, text string")
    tokens = spark.createDataFrame(
        [(1, "ne two th"), (1, "two"), (1, "b c"), (2, "zz"), (2, "z"), (3, "1é"), (3, "absent"), (3, " "), (3, None), (1, "two")],
        "item_id long, token string")
    got = {(r.item_id, r.token): r.doc_id for r in LG.first_match(tokens, docs).collect()}
    assert got == {(1, "ne two th"): 1, (1, "two"): 1, (1, "b c"): 3, (2, "zz"): 2, (2, "z"): 2, (3, "1é"): 6}


def test_run_lengths_across_chunks_and_null_values(spark):
    seq = ["a", "a", None, None, "a", "b", "b", "b", "a"]
    df = spark.createDataFrame([(None, i, x) for i, x in enumerate(seq)], "u long, t long, name string")
    got = sorted((r.run_start, r.name, r.run_length) for r in LG.run_lengths(df, ["u"], ["t"], "name", chunk_rows=2).collect())
    assert got == [(1, "a", 2), (3, None, 2), (5, "a", 1), (6, "b", 3), (9, "a", 1)]


def test_slices_lose_no_element(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, 0, [7.0])], "vec_id long, label long, embedding array<double>")
    got = {(r.vec_id, r.slice_idx): r["values"] for r in X.split_slices(v, 2).collect()}
    assert got == {(1, 0): [1.0, 2.0], (1, 1): [3.0, 4.0, 5.0], (2, 0): [], (2, 1): [7.0]}


def test_pivot_keeps_unlisted_schemes(spark):
    from quarry.operators import results as RS
    t = spark.createDataFrame([("s", "F", 1, 2.0), ("s", "X", 1, 4.0), ("s", None, 1, 6.0)],
                              "series string, scheme string, working_set long, runtime double")
    r = RS.result_pivot(t, "s", ["F", "O"]).collect()[0]
    assert (r.F, r.O, r.other) == (2.0, 0.0, 5.0)


def test_vote_summary_sums_the_service_times_of_the_models_that_ran(spark):
    votes = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, "a"), (2, 2, "b"), (2, 3, "c"), (2, 4, "a"), (2, 5, "a"), (3, 1, "x")]
    df = spark.createDataFrame(votes, "item long, k long, label string")
    lcg = lambda x: (x * 1103515245 + 12345) % 2 ** 31
    picked = {(r.item, r.k): (r.model, r.service_s) for r in V.model_pick(df).collect()}
    assert picked == {(i, k): V.MODEL_POOL[lcg(i * 1000 + k) % 7] for i, k, _ in votes}
    times = [sum(picked[i, k][1] for k in range(1, n + 1)) for i, n in ((1, 3), (2, 5), (3, 1))]
    got = V.vote_summary(df, V.majority_vote(df)).first()
    assert tuple(got)[:3] == (3, 9, 1) and got.n_decided == 2
    assert (got.total_latency_s, got.mean_latency_s, got.max_latency_s) == pytest.approx((sum(times), sum(times) / 3, max(times)), abs=2e-6)
