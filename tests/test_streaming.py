"""Streaming equals batch, also across a restart from the checkpoint, out of order and on replays."""

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import trajectory as TR
from quarry.operators import voting as V
from quarry.plans import inputs as I
from quarry.session import scratch_path
from quarry.streaming import completeness as SC
from quarry.streaming import files as SF_
from quarry.streaming import latency as SL
from quarry.streaming import trajectory as ST
from quarry.streaming import votes as SV

SF = "/root/testdata/sf0.001"
DAY = 86_400_000


@pytest.fixture(autouse=True)
def few_partitions(spark, monkeypatch):
    """Two state stores and two triggers a run: what is tested does not depend on their number."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    monkeypatch.setattr(SF_, "TRIGGERS", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def _paths(spark):
    return [scratch_path(spark, n) for n in ("t-src", "t-out", "t-ckpt")]


def _same(a, b):
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_restart_resumes_from_checkpoint(spark):
    tf = I.transforms(spark, SF)
    inp = ST.stream_input(tf)
    src, out, ck = _paths(spark)
    SF_.stage(inp.filter("frame < 20"), ["frame"], src)
    ST.process(spark, src, out, ck, radius=5)
    first = spark.read.schema(ST.SMOOTH_OUT).parquet(out).count()
    SF_.stage(inp.filter("frame >= 20"), ["frame"], src)
    ST.process(spark, src, out, ck, radius=5)
    exp = TR.smooth(tf, 5)
    assert 0 < first < exp.count()
    _same(spark.read.schema(ST.SMOOTH_OUT).parquet(out), exp)


def test_replayed_and_early_rows(spark):
    """Later frames arrive before earlier ones, and a part is delivered twice."""
    tf = I.transforms(spark, SF)
    inp = ST.stream_input(tf)
    src, out, ck = _paths(spark)
    for part in ("frame >= 20", "frame >= 5 and frame < 10", "frame < 10", "frame >= 10 and frame < 20"):
        SF_.stage(inp.filter(part), ["frame"], src)
    ST.process(spark, src, out, ck, radius=5, mode="running")
    _same(spark.read.schema(ST.RUNNING_OUT).parquet(out), TR.running_sum(tf))


def test_replay_after_the_end_and_frames_beyond_it_are_ignored(spark):
    rows = lambda v: spark.createDataFrame([(7, f, float(x), float(x), float(x), end) for f, x, end in v], ST.IN_SCHEMA)
    src, out, ck = _paths(spark)
    video = [(f, f + 1, False) for f in range(6)] + [(6, 0, True)]
    for part in (video, video, [(9, 1, False)]):
        SF_.stage(rows(part), ["frame"], src)
        ST.process(spark, src, out, ck, radius=2, mode="running")
    got = spark.read.schema(ST.RUNNING_OUT).parquet(out).orderBy("frame").collect()
    assert [(r.frame, r.cum_dx) for r in got] == [(f, (f + 1) * (f + 2) / 2) for f in range(6)]


def test_smoothing_in_pieces_is_the_whole_formula():
    rnd = random.Random(4)
    for _ in range(200):
        n, r = rnd.randint(1, 40), rnd.randint(0, 6)
        v = np.array([[rnd.randint(-50, 50) / 4 for _ in range(3)] for _ in range(n)])
        t = v.cumsum(0)
        want = [ST.rounded(np.mean([t[min(max(j, 0), n - 1)] for j in range(f - r, f + r + 1)], axis=0) - t[f] + v[f]) for f in range(n)]
        got, state, hist, i = [], None, [], 0
        while i < n:
            m = rnd.randint(1, 9)
            tr = ST.Trajectory(r, True, state, hist)
            for frames, values in tr.take(v[i: i + m]):
                got += list(zip(frames.tolist(), values.tolist()))
            i = tr.next
            hist = list(zip(tr.t.tolist(), tr.v.tolist()))
            assert len(hist) <= 2 * r + 1
            state = (tr.next, tr.emitted, n, 0, tr.cum.tolist(), tr.first.tolist())
        tr = ST.Trajectory(r, True, state, hist)
        for frames, values in tr.finish():
            got += list(zip(frames.tolist(), values.tolist()))
        assert [f for f, _ in got] == list(range(n)) and np.allclose([x for _, x in got], want, atol=1.1e-6)


class _State:
    """Counts what a processor writes to a state variable."""

    def __init__(self):
        self.value, self.written = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if self.value is not None else iter(())

    def update(self, value):
        self.value, self.written = value, self.written + 1

    def put(self, values):
        self.value, self.written = values, self.written + len(values)

    def clear(self):
        self.value = None


def _long_video(n, radius, calls):
    p = ST.Smoother(radius, "smooth")
    p.at, p.hist, p.early = _State(), _State(), _State()
    out, t = 0, time.process_time()
    for part in np.array_split(np.arange(n), calls):
        pdf = pd.DataFrame({"frame": part, "dx": 1.0, "dy": 2.0, "da": 0.5, "is_end": False})
        out += sum(map(len, p.handleInputRows((1,), iter([pdf]), None)))
    end = pd.DataFrame({"frame": [n], "dx": 0.0, "dy": 0.0, "da": 0.0, "is_end": True})
    out += sum(map(len, p.handleInputRows((1,), iter([end]), None)))
    assert out == n
    return time.process_time() - t, p.hist.written


def test_one_video_of_100_000_frames_takes_linear_time_and_writes_a_window_per_call():
    _long_video(10_000, 30, 5)
    small, large = min(_long_video(25_000, 30, 10)[0] for _ in range(3)), min(_long_video(100_000, 30, 40)[0] for _ in range(3))
    assert large < 10 * max(small, 0.02)
    assert _long_video(100_000, 30, 40)[1] <= 40 * 61


def test_long_video_through_spark(spark):
    n = 100_000
    tf = spark.range(n).select(F.lit(1).cast("long").alias("video"), F.col("id").alias("frame"),
                               *[((F.col("id") * k % 7) / 4).alias(c) for k, c in ((1, "dx"), (2, "dy"), (3, "da"))])
    got = ST.run_stream(tf, 30).agg(F.count("*"), F.countDistinct("frame"), F.max("frame")).first()
    assert tuple(got) == (n, n, n - 1)


class _Map:
    """Counts the calls of a map state."""

    def __init__(self):
        self.d, self.calls = {}, 0

    def containsKey(self, k):
        self.calls += 1
        return k in self.d

    def updateValue(self, k, v):
        self.calls += 1
        self.d[k] = v


def test_many_videos_of_a_bucket_take_one_call_and_few_state_calls():
    """A call for all videos; per video the state is asked once, and written once when it has ended."""
    n, p = 300, ST.Smoothers(3, "smooth")
    p.held, p.waiting, p.ended = _State(), _Map(), _Map()
    videos, parts = np.arange(n), (range(0, 7), range(7, 20))
    got = []
    for k, frames in enumerate(parts):
        f = np.random.default_rng(k).permutation(np.repeat(list(frames) + [20] * k, n))
        pdf = pd.DataFrame({"video": np.tile(videos, len(f) // n), "frame": np.sort(f), "dx": 1.0, "dy": 2.0, "da": 0.5})
        pdf["is_end"] = pdf["frame"] == 20
        pdf = pdf.sample(frac=1, random_state=k)
        got += list(p.handleInputRows((5,), iter(np.array_split(pdf, 3)), None))
    assert len(got) == 2 and p.held.value is None and p.waiting.calls == 0 and p.ended.calls <= 3 * n
    all_ = pd.concat(got)
    assert sorted(zip(all_.video, all_.frame)) == [(v, f) for v in range(n) for f in range(20)]


def test_early_frames_as_ranges():
    rnd = random.Random(9)
    for _ in range(300):
        n, x, seen = rnd.randint(1, 40), SC.Video(), set()
        for _ in range(rnd.randint(1, 6)):
            f = np.sort([rnd.randrange(n) for _ in range(rnd.randint(1, 15))])
            x = SC.Video(*x.state())
            x.take(f, np.zeros(len(f), bool))
            seen |= set(f.tolist())
            gap = next(i for i in range(n + 1) if i not in seen)
            held = [i for a, b in zip(x.starts, x.stops) for i in range(a, b)]
            assert x.next == gap and held == sorted(i for i in seen if i > gap) and x.last == max(seen)
        assert x.row() == (None, len(seen), max(seen) + 1 - len(seen), False, "timer")
        x.take(np.array([n]), np.array([True]))
        assert x.row() == ((n, n, 0, True, "marker") if len(seen) == n else (n, len(seen), n - len(seen), False, "timer"))


# -- votes ---------------------------------------------------------------------------

def _at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def _votes(spark, rows):
    return spark.createDataFrame([(i, k, x, _at(d)) for i, k, x, d in rows], SV.IN_SCHEMA)


def test_vote_rule_against_the_batch_operator(spark):
    rnd = random.Random(8)
    rows = [(i, k, rnd.choice("aabc") if rnd.random() < 0.95 else None) for i in range(300) for k in range(1, rnd.randint(1, 14) + 1)]
    want = {r[0]: tuple(r)[1:] for r in V.majority_vote(spark.createDataFrame([r for r in rows if r[2]], "item long, k long, label string")).collect()}
    for i in want:
        votes = {k: x for j, k, x in rows if j == i and x and k <= V.MAX_RUN}
        assert SV.judge(votes, True) == want[i]
        now = SV.judge(votes, False)
        assert now is None or now == want[i]


def test_vote_across_a_restart_out_of_order_and_after_the_decision(spark):
    src, out, ck = _paths(spark)
    first = [(1, 2, "a", 0), (2, 1, "a", 0), (3, 1, "x", 0), (3, 2, "y", 0), (3, 3, "z", 0), (None, 1, "n", 0)]
    second = [(1, 1, "b", 1), (1, 3, "a", 1), (3, 5, "x", 1), (3, 4, "x", 2), (2, 1, "a", 2)]
    third = [(1, 4, "b", 3), (1, 5, "b", 3), (1, 6, "b", 3), (1, 7, "b", 3)]  # after item 1 was decided
    emitted = []
    for part in (first, second, third):
        SF_.stage(_votes(spark, part), ["ts"], src)
        SV.process(spark, src, out, ck, 30 * DAY)
        emitted.append({r["item"]: tuple(r)[1:] for r in spark.read.schema(SV.OUT).parquet(out).collect()})
    assert emitted[0] == {} and emitted[1] == emitted[2] == {1: (3, "a", True), 3: (5, "x", False)}
    SV.close(spark, src, _votes(spark, first), 30 * DAY)
    SV.process(spark, src, out, ck, 30 * DAY)
    last = {r["item"]: tuple(r)[1:] for r in spark.read.schema(SV.OUT).parquet(out).collect()}
    assert last == emitted[1] | {2: (1, None, False), None: (1, None, False)}


def test_vote_state_is_bounded(spark):
    """Votes beyond the 11th are not kept, whatever their number."""
    src, out, ck = _paths(spark)
    rows = [(1, k, f"l{k}", 0) for k in range(2, 500)]  # the first vote is missing
    SF_.stage(_votes(spark, rows), ["ts"], src)
    SV.process(spark, src, out, ck, DAY)
    held = spark.read.format("statestore").option("stateVarName", "votes").load(ck)
    assert held.count() == V.MAX_RUN - 1
    SF_.stage(_votes(spark, [(1, 1, "l2", 0)]), ["ts"], src)
    SV.process(spark, src, out, ck, DAY)
    assert spark.read.schema(SV.OUT).parquet(out).collect()[0].asDict() == {"item": 1, "models_run": 3, "winner": "l2", "stopped_early": True}
    assert spark.read.format("statestore").option("stateVarName", "votes").load(ck).count() == 0


# -- end of stream ---------------------------------------------------------------------

def _deliveries(spark, rows):
    return spark.createDataFrame([(v, f, e, _at(d)) for v, f, e, d in rows], SC.IN_SCHEMA)


def test_videos_end_by_marker_or_timer_across_restarts(spark):
    src, out, ck = _paths(spark)
    seen = []
    for part in ([(1, f, False, 0) for f in (0, 2, 1, 1)] + [(2, 0, False, 0), (2, 2, False, 0), (2, 3, True, 0), (3, 0, False, 0)],
                 [(1, 3, True, 1), (3, 1, False, 3)],
                 [(1, 0, False, 9), (3, 2, False, 9), (4, 0, False, 9), (4, 1, True, 9)]):
        SF_.stage(_deliveries(spark, part), ["ts"], src)
        SC.process(spark, src, out, ck, 5 * DAY)
        seen.append({r.video: tuple(r)[1:] for r in spark.read.schema(SC.OUT).parquet(out).collect()})
    one, two = (3, 3, 0, True, "marker"), (3, 2, 1, False, "timer")
    assert seen[0] == {} and seen[1] == {1: one}
    # the third part's time passes the patience of videos 2 and 3 (silent since day 3); 4 is whole
    assert seen[2] == {1: one, 2: two, 3: (None, 3, 0, False, "timer"), 4: (1, 1, 0, True, "marker")} or \
        seen[2] == {1: one, 2: two, 4: (1, 1, 0, True, "marker")}
    SC.close(spark, src, _deliveries(spark, []), 5 * DAY)
    SC.process(spark, src, out, ck, 5 * DAY)
    ended = spark.read.schema(SC.OUT).parquet(out)
    assert sorted(r.video for r in ended.collect()) == [1, 2, 3, 4]
    videos = lambda ids: spark.createDataFrame([(i,) for i in ids], "video long")
    assert tuple(SC.job_done(videos([1, 2, 3, 4]), ended).first()) == (4, 4, 2, True)
    assert tuple(SC.job_done(videos([1, 5]), ended).first()) == (2, 1, 1, False)


def test_rows_behind_the_watermark_are_not_dropped_unnoticed(spark):
    src, out, ck = _paths(spark)
    SF_.stage(_deliveries(spark, [(1, 0, False, 9)]), ["ts"], src)
    SC.process(spark, src, out, ck, DAY)
    SF_.stage(_deliveries(spark, [(2, 0, False, 1)]), ["ts"], src)
    with pytest.raises(RuntimeError, match="1 rows"):
        SC.process(spark, src, out, ck, DAY)


# -- latency -------------------------------------------------------------------------------

def test_latency_counts_rows_behind_the_watermark(spark):
    src, out, ck = _paths(spark)
    rows = lambda v: spark.createDataFrame([(i, f, _at(d)) for i, f, d in v], SL.IN_SCHEMA)
    due = SL.starts(rows([(1, 0, 0), (2, 0, 0)]))
    for part in ([(1, 0, 0), (1, 30, 2)], [(2, 0, 1), (2, 60, 4), (9, 0, 5)], [(1, 60, 5)]):
        SF_.stage(rows(part), ["ts"], src)
        SL.process(spark, src, due, out, ck, fps=30)
    got = {(r.video, r.frame): (r.lateness_s, r.behind) for r in spark.read.parquet(f"{out}/rows").collect()}
    day = 86_400.0
    assert got == {(1, 0): (0.0, False), (1, 30): (2 * day - 1, False), (2, 0): (day, True), (2, 60): (4 * day - 2, False),
                   (9, 0): (None, False), (1, 60): (5 * day - 2, False)}
    ledger = spark.read.schema(SL.LEDGER).parquet(f"{out}/ledger").agg(F.sum("n_rows"), F.sum("n_behind"), F.sum("n_unmatched")).first()
    assert tuple(ledger) == (6, 1, 1)
