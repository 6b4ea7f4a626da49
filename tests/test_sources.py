"""Sources, sinks and scalar functions."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.functions.scalars import LCG_INCREMENT, LCG_MODULUS, LCG_MULTIPLIER, strict_bool
from quarry.sources import generator, partitioned, results_csv, sinks


def test_random_rows_source(spark):
    generator.register(spark)
    df = spark.read.format("random_rows").option("n", 103).option("parallelism", 4).option("num_columns", 2).load()
    rows = sorted(df.collect())
    assert len(rows) == 103 and df.rdd.getNumPartitions() == 5
    r = rows[7]
    c0 = (7 * LCG_MULTIPLIER + LCG_INCREMENT) % LCG_MODULUS
    assert (r.row_id, r.c_0, r.c_1) == (7, c0, (c0 * LCG_MULTIPLIER + LCG_INCREMENT) % LCG_MODULUS)


def test_result_csv_explicit_schema(spark):
    d = tempfile.mkdtemp(prefix="quarry-csv-")
    with open(os.path.join(d, "r.csv"), "w") as f:
        f.write("runtime,spilled,migration,objs,wt,ra,ro\n")
        f.write("12.5,1GB,3,10,5MB/s,,,,512,100000000\n")
    df = results_csv.read_results(spark, d, "sort")
    r = df.collect()[0]
    assert df.columns[-1] == "partition_size" and r.runtime == 12.5 and r.num_partitions == 512


def test_year_month_paths_and_trailing(spark):
    d = tempfile.mkdtemp(prefix="quarry-ym-")
    for y, m in [(2019, 11), (2019, 12), (2020, 1)]:
        spark.createDataFrame([(y * 100 + m,)], "v long").write.parquet(f"{d}/{y}/{m:02d}")
    df = partitioned.read_year_month(spark, d)
    assert sorted((r.year, r.month, r.v) for r in df.collect()) == [(2019, 11, 201911), (2019, 12, 201912), (2020, 1, 202001)]
    df = df.withColumn("period", F.col("year") * 100 + F.col("month"))
    assert sorted(r.v for r in partitioned.last_n_periods(df, "period", 2).collect()) == [201912, 202001]


def test_sinks(spark):
    d = tempfile.mkdtemp(prefix="quarry-sink-")
    df = spark.createDataFrame([(1, 1.25), (2, 1.5)], "frame long, latency_s double")
    assert not sinks.append_csv(df, f"{d}/dummy")
    assert sinks.append_csv(df, f"{d}/out") and sinks.append_csv(df, f"{d}/out")
    assert spark.read.csv(f"{d}/out").count() == 4
    sinks.write_latency_text(df, f"{d}/lat")
    assert sorted(r.value for r in spark.read.text(f"{d}/lat").collect()) == ["1 1.25", "2 1.5"]
    runs = spark.createDataFrame([(3.0, True, 8, 100, 5.0)], "time double, success boolean, num_partitions long, partition_size long, spilled double")
    sinks.write_metrics_json(sinks.metrics_records(runs, ["spilled"]), f"{d}/m")
    m = spark.read.json(f"{d}/m").collect()[0]
    assert m.perf_metrics[0].name == "spilled" and m.perf_metrics[0].value == 5.0


def test_strict_bool(spark):
    ok = spark.createDataFrame([("True",), ("false",)], "s string").select(strict_bool("s").alias("b"))
    assert [r.b for r in ok.collect()] == [True, False]
    bad = spark.createDataFrame([("yes",)], "s string").select(strict_bool("s").alias("b"))
    with pytest.raises(Exception):
        bad.collect()
