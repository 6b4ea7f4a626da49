"""Datasets laid out as ``root/<year>/<month>/file``: plain values, which Spark's partition
discovery does not see, or ``name=value`` folders, read by their path all the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR_MONTH = r"/(?:[^/=]+=)?(\d{4})/(?:[^/=]+=)?(\d{1,2})/[^/]+$"


def write_year_month(df: DataFrame, root: str, date_col: str, fmt: str = "parquet") -> None:
    """Write ``df`` in folders by year and month of a date column. The rows are rebalanced by
    period first, so a period has few files, and a large one is split over several tasks."""
    year, month = F.year(date_col).alias("period_year"), F.month(date_col).alias("period_month")
    (df.select("*", year, month).hint("rebalance", "period_year", "period_month")
       .write.partitionBy("period_year", "period_month").format(fmt).save(root))


def read_year_month(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """All files under root/*/*/ with ``year``/``month`` taken from the path."""
    df = spark.read.format(fmt).load(f"{root.rstrip('/')}/*/*/")
    path = F.col("_metadata.file_path")
    return (df.withColumn("year", F.regexp_extract(path, YEAR_MONTH, 1).cast("int"))
              .withColumn("month", F.regexp_extract(path, YEAR_MONTH, 2).cast("int")))


def last_n_periods(df: DataFrame, period_col: str, n: int) -> DataFrame:
    """Rows of the trailing ``n`` periods. The period list is reduced to n rows before it is
    broadcast, so the broadcast side is bounded by n."""
    last = df.select(period_col).distinct().orderBy(F.col(period_col).desc()).limit(n)
    return df.join(F.broadcast(last), period_col, "left_semi")
