"""Configuration sweeps: every series crossed with the swept parameter lists, built with
``explode`` over literal lists (a generator per row, no join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The swept worker counts, partition counts and partition sizes (bytes),
# and the number of repeated trials.
WORKERS = (8, 16)
PARTITIONS = (320, 512)
PARTITION_SIZES = (10_000_000, 50_000_000, 100_000_000)
TRIALS = 3


def param_grid(series: DataFrame) -> DataFrame:
    def ex(df, name, vals):
        return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in vals])))
    g = ex(series, "workers", WORKERS)
    g = ex(g, "partitions", PARTITIONS)
    g = ex(g, "partition_size", PARTITION_SIZES)
    g = g.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(TRIALS))))
    return g.withColumn("trial", F.col("trial").cast("long"))
