"""Result sinks: appended CSV rows, latency text, metrics JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_csv(df: DataFrame, path: str) -> bool:
    """Append rows as header-less CSV; paths containing 'dummy' are a dry run."""
    if "dummy" in path:
        return False
    df.write.mode("append").option("header", False).csv(path)
    return True


def latency_lines(df: DataFrame, frame: str = "frame", latency: str = "latency_s") -> DataFrame:
    """One '<frame> <latency>' line per row."""
    return df.select(F.concat_ws(" ", F.col(frame).cast("string"), F.col(latency).cast("string")).alias("value"))


def write_latency_text(df: DataFrame, path: str, **kw) -> None:
    latency_lines(df, **kw).write.mode("overwrite").text(path)


def metrics_records(runs: DataFrame, metric_cols: list[str], time_col: str = "time") -> DataFrame:
    """Shape run rows as metrics documents:
    {time, success, num_partitions, partition_size, perf_metrics: [{name, value, type}]}."""
    items = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"),
                      F.lit("gauge").alias("type")) for c in metric_cols]
    return runs.select(F.col(time_col).cast("double").alias("time"), F.col("success").cast("boolean").alias("success"),
                       F.col("num_partitions").cast("long").alias("num_partitions"),
                       F.col("partition_size").cast("long").alias("partition_size"),
                       F.array(*items).alias("perf_metrics"))


def write_metrics_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_latency_text(spark: SparkSession, path: str) -> DataFrame:
    """The rows of latency lines: frame and latency_s (null where a line holds no number)."""
    part = F.split("value", " ")
    return spark.read.text(path).select(F.get(part, F.lit(0)).try_cast("long").alias("frame"),
                                        F.get(part, F.lit(1)).try_cast("double").alias("latency_s"))


METRICS_SCHEMA = ("time double, success boolean, num_partitions long, partition_size long, "
                  "perf_metrics array<struct<name: string, value: double, type: string>>")


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per run and metric of metrics documents."""
    runs = spark.read.schema(METRICS_SCHEMA).json(path)
    return runs.select("time", "success", "num_partitions", "partition_size", F.inline("perf_metrics"))
