"""The exactly-once sink, the source over table files, ordered outputs and selection quantiles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import ordered as O
from quarry.plans.quantiles import exact_quantiles
from quarry.session import scratch_path
from quarry.sources import delivery_log as DL
from quarry.sources import table_files as TF
from quarry.streaming import files as SFS

SF = "/root/testdata/sf0.001"
ROWS = "video long, frame long, x double"


# -- sink ----------------------------------------------------------------------------

def _frames(spark, rows):
    return spark.createDataFrame([(v, f, f / 2) for v, f in rows], ROWS).repartition(2)


def test_a_replayed_epoch_writes_nothing(spark):
    path = scratch_path(spark, "log")
    for epoch, rows in ((0, [(1, 0), (1, 1), (2, 0)]), (1, [(1, 2), (2, 1)]), (1, [(1, 2), (2, 1)]), (0, [(9, 9)])):
        DL.append(_frames(spark, rows), path, epoch)
    got = DL.read_log(spark, path, ROWS)
    assert sorted((r.video, r.frame, r.epoch) for r in got.collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (2, 0, 0), (2, 1, 1)]
    assert sorted(r.epoch for r in DL.ledger(spark, path).select("epoch").distinct().collect()) == [0, 1]


def test_a_killed_attempt_leaves_nothing(spark):
    path = scratch_path(spark, "log")
    DL.append(_frames(spark, [(1, 0)]), path, 0)
    fails = spark.range(0, 4, 1, 4).select(F.col("id").alias("video"), F.when(F.col("id") < 3, F.col("id")).otherwise(
        F.raise_error(F.lit("killed")).cast("long")).alias("frame"), F.lit(0.0).alias("x"))
    with pytest.raises(Exception, match="killed"):
        DL.append(fails, path, 1)
    assert DL.read_log(spark, path, ROWS).count() == 1
    DL.append(_frames(spark, [(1, 1)]), path, 1)  # the epoch can still be delivered
    assert DL.read_log(spark, path, ROWS).count() == 2


def test_a_stream_delivers_each_frame_once_and_gaps_are_reported(spark):
    from quarry.operators.trajectory import idempotent_sink
    path, ck, src = (scratch_path(spark, n) for n in ("log", "log-ck", "log-src"))
    DL.register(spark)

    def run(part):
        SFS.stage(_frames(spark, part), ["frame"], src)
        q = spark.readStream.schema(ROWS).parquet(src).writeStream.format("delivery_log").option("path", path) \
            .option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()

    run([(1, 0), (1, 1), (1, 1), (2, 0)])
    run([(1, 1), (1, 3), (2, 1)])  # frame 1 again, frame 2 of video 1 lost
    log = DL.read_log(spark, path, ROWS)
    once = DL.first_deliveries(log, ["video", "frame"])
    assert sorted((r.video, r.frame) for r in once.collect()) == [(1, 0), (1, 1), (1, 3), (2, 0), (2, 1)]
    report = {r.video: (r.n_received, r.n_delivered, r.n_missing) for r in idempotent_sink(log).collect()}
    assert report == {1: (5, 3, 1), 2: (2, 2, 0)}
    # the last micro-batch is delivered again, as after a crash between sink and checkpoint
    last = DL.ledger(spark, path).agg(F.max("epoch")).first()[0]
    DL.append(_frames(spark, [(1, 3)]), path, last)
    assert DL.read_log(spark, path, ROWS).count() == log.count()


def test_lines(spark):
    path = scratch_path(spark, "log")
    DL.append(spark.createDataFrame([(1, 0.5), (2, 0.25)], "frame long, latency_s double"), path, 0, lines=True)
    assert sorted(r.value for r in spark.read.text(f"{path}/data").collect()) == ["1 0.5", "2 0.25"]
    assert sorted((r.frame, r.latency_s) for r in DL.read_log(spark, path, "frame long, latency_s double").collect()) == [(1, 0.5), (2, 0.25)]


def test_an_empty_epoch(spark):
    path = scratch_path(spark, "log")
    DL.append(_frames(spark, []), path, 0)
    assert DL.read_log(spark, path, ROWS).count() == 0


# -- source --------------------------------------------------------------------------

CASES = ["l_orderkey >= 1000", "l_orderkey = 7", "l_orderkey < 50 and l_returnflag in ('A', 'N')", "l_quantity < 3", "l_quantity > 48",
         "l_shipdate is not null and l_linenumber <= 2", "l_returnflag = 'nothing'", "l_orderkey + 1 > 1200", "true"]


@pytest.mark.parametrize("where", CASES)
def test_source_rows_are_those_of_the_parquet_scan(spark, where):
    path, columns = f"{SF}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]
    got, want = TF.scan(spark, path, columns).filter(where), spark.read.parquet(path).select(*columns).filter(where)
    assert got.schema == want.schema
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_source_pushes_filters_and_prunes_row_groups(spark):
    path = scratch_path(spark, "groups")
    spark.range(0, 40_000, 1, 4).select("id", (F.col("id") % 7).alias("m"), F.when(F.col("id") % 5 > 0, F.col("id") / 2).alias("x")).write \
        .option("parquet.block.size", 16_384).option("parquet.block.size.row.check.max", 1000).parquet(path)
    df = TF.scan(spark, path, ["id", "m"]).filter("id >= 39000 and m = 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan), plan  # both were taken by the source
    assert df.count() == spark.read.parquet(path).filter("id >= 39000 and m = 3").count()
    reader = TF.TableReader(path, ["id"], 1000)
    whole = sum(len(p.groups) for p in reader.partitions())
    left = list(reader.pushFilters([TF.GreaterThanOrEqual(("id",), 39_000), TF.EqualTo(("x",), float("nan")), TF.GreaterThan(("x",), 1.0)]))
    assert [type(f) for f in left] == [TF.EqualTo, TF.GreaterThan]  # floats: Spark decides about NaN
    assert 0 < sum(len(p.groups) for p in reader.partitions()) < whole


# -- ordered outputs -----------------------------------------------------------------

def test_outputs_are_in_order(spark):
    rnd = random.Random(3)
    rows = [(None if i % 50 == 0 else rnd.randint(0, 90), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, i long")
    path = O.write_ordered(df, ["k", "i"], 6)
    got = [(r.k, r.i) for r in O.read_ordered(spark, path, df.schema).orderBy("pos").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    m = O.manifest(spark, path).orderBy("output").collect()
    assert len(m) == 6 and sum(r.n_rows for r in m) == 2000 and [r.rows_before for r in m] == [sum(x.n_rows for x in m[:i]) for i in range(6)]
    assert tuple(O.order_report(spark, path, ["k", "i"], df.schema).first()) == (6, 2000, 0, 0)
    one = [(r.k, r.i) for r in O.one_output(spark, path, 2, df.schema).collect()]
    assert one == got[m[2].rows_before: m[3].rows_before]


def test_broken_order_is_reported(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k")).coalesce(1)
    path = O.write_ordered(df, ["k"], 4)
    spark.read.parquet(f"{path}/data").coalesce(1).sortWithinPartitions(F.desc("k")).write.mode("append").parquet(f"{path}/data")
    assert O.order_report(spark, path, ["k"], df.schema).first()["broken_inside"] == 99


def test_large_outputs_are_several_files_in_order(spark, monkeypatch):
    """What a task sorts is bounded by rows, not by the number of outputs."""
    monkeypatch.setattr(O, "PART_ROWS", 100)
    rnd = random.Random(5)
    rows = [(None if i % 70 == 0 else rnd.randint(0, 40), i) for i in range(1900)]
    df = spark.createDataFrame(rows, "k long, i long")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    path = O.write_ordered(df, ["k", "i"], 3)
    files = O.parts(spark, path).orderBy("part").collect()
    assert len(files) == 21 and max(f.n_rows for f in files) <= 250
    assert [(tuple(f.lo), tuple(f.hi)) for f in files] == [(want[f.rows_before], want[f.rows_before + f.n_rows - 1]) for f in files]
    m = O.manifest(spark, path).orderBy("output").collect()
    assert [len(r.files) for r in m] == [7, 7, 7] and [r.rows_before for r in m] == [sum(x.n_rows for x in m[:i]) for i in range(3)]
    assert [(r.k, r.i) for r in O.read_ordered(spark, path, df.schema).orderBy("pos").collect()] == want
    assert [(r.k, r.i) for r in O.one_output(spark, path, 1, df.schema).collect()] == want[m[1].rows_before: m[2].rows_before]
    assert [(r.k, r.i) for r in O.numbered(df, ["k", "i"], 3).orderBy("pos").collect()] == want
    assert tuple(O.order_report(spark, path, ["k", "i"], df.schema).first()) == (3, 1900, 0, 0)
    # files of one output, and of two, that overlap
    wrong = scratch_path(spark, "wrong")
    O._write(df, ["k", "i"], 3, wrong)
    O.parts(spark, path).withColumn("lo", F.when(F.col("part").isin(2, 5, 7), F.struct(F.lit(None).cast("long").alias("k"), F.lit(-1).cast("long").alias("i")))
                                    .otherwise(F.col("lo"))).coalesce(1).write.parquet(f"{wrong}/manifest")
    assert tuple(O.order_report(spark, wrong, ["k", "i"], df.schema).first())[2:] == (2, 1)


def test_ordered_outputs_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k long")
    path = O.write_ordered(df, ["k"], 3)
    assert O.read_ordered(spark, path, df.schema).count() == 0


# -- quantiles -----------------------------------------------------------------------

def _quantile(v, p):
    h = (len(v) - 1) * p
    lo, hi = v[int(h)], v[min(int(h) + 1, len(v) - 1)]
    return lo + (h - int(h)) * (hi - lo)


def test_quantiles_are_exact(spark):
    rnd = random.Random(6)
    data = {"hot": [rnd.gauss(0, 1) for _ in range(60_000)], "ties": [float(rnd.randint(0, 3)) for _ in range(25_000)],
            "edge": [float(i) for i in range(10_001)], "few": [3.0, 1.0], "one": [5.0], None: [2.0, 4.0, 8.0]}
    rows = [(k, x) for k, v in data.items() for x in v] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    probs = [0.0, 0.001, 0.5, 0.9, 0.99, 1.0]
    names = {p: f"q{i}" for i, p in enumerate(probs)}
    got = {r.k: [r[f"q{i}"] for i in range(len(probs))] for r in exact_quantiles(df, ["k"], "v", probs, names=names).collect()}
    assert got.pop("none") == [None] * len(probs)
    for k, v in data.items():
        assert got[k] == pytest.approx([_quantile(sorted(v), p) for p in probs], abs=1e-12), k


def test_quantiles_neither_sort_nor_checkpoint(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    plan = exact_quantiles(df, ["k"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan and "ObjectHashAggregate" in plan
