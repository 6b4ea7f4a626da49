"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of (u, v), u > v.

    large: every node links its larger neighbours to the smallest of itself and its
    neighbours. small: every node links its smaller neighbours and itself to the smallest.
    The minimum is a partial aggregate and the join back is one that Spark can split, so a
    node with very many neighbours does not have to fit one task."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.withColumnRenamed("m", "v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (u, v; any order, nulls not allowed) with the
    smallest node of its component; an empty edge table gives an empty result. Every round
    is cut off with checkpoint(), so lost executors do not replay earlier rounds."""
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) \
        .distinct().checkpoint()
    seen = None
    while True:
        now = _stars(_stars(now, True), False).checkpoint()
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
