"""Analysis of run results: trial statistics, pivots, error bars, latency percentiles,
empirical CDF, last-value counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import stable_round
from quarry.plans.nullsafe import join_keys
from quarry.plans.quantiles import exact_quantiles
from quarry.plans.sequence import number_rows

WARMUP_SECONDS = 3
NUM_WORKERS = 7


def trial_stats(trials: DataFrame, keys=("series", "scheme"), workers: int = NUM_WORKERS) -> DataFrame:
    """Mean, population std and variance of runtime; floor-mean of counters; mean over the
    trials of the migrations per node, (local + remote) / (workers + 1): the head's own count and
    the workers' total over all nodes."""
    return trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"),
        stable_round(F.avg("runtime"), 6).alias("mean_runtime"),
        stable_round(F.stddev_pop("runtime"), 6).alias("std_runtime"),
        stable_round(F.var_pop("runtime"), 3).alias("var_runtime"),
        F.floor(F.sum("spilled") / F.count(F.lit(1))).cast("long").alias("spilled_floor_mean"),
        stable_round(F.avg((F.col("migrations") + F.col("remote_migrations")) / F.lit(workers + 1)), 6).alias("per_node_mean"))


def result_pivot(trials: DataFrame, series: str, schemes: list[str]) -> DataFrame:
    """Filter one series, group by working set, one column per scheme (mean runtime) and
    ``other`` for trials of any scheme not listed; missing combinations report 0."""
    named = F.when(F.col("scheme").isin(schemes), F.col("scheme")).otherwise("other")
    t = trials.filter(F.col("series") == series).withColumn("scheme", named)
    p = t.groupBy("working_set").pivot("scheme", [*schemes, "other"]).agg(stable_round(F.avg("runtime"), 6))
    return p.na.fill(0.0, subset=[*schemes, "other"])


def result_table(trials: DataFrame, keys=("series", "scheme", "working_set")) -> DataFrame:
    """Smallest, largest and mean runtime and the mean counters of every combination."""
    return trials.groupBy(*keys).agg(
        F.min("runtime").alias("min_runtime"), F.max("runtime").alias("max_runtime"),
        stable_round(F.avg("runtime"), 6).alias("mean_runtime"), stable_round(F.avg("spilled"), 6).alias("mean_spilled"),
        stable_round(F.avg("migrations"), 6).alias("mean_migrations"))


def error_bars(trials: DataFrame, keys=("series", "scheme")) -> DataFrame:
    g = trials.groupBy(*keys).agg(F.avg("runtime").alias("_m"), F.stddev_pop("runtime").alias("_s"))
    return g.select(*keys, stable_round("_m", 6).alias("mean_runtime"),
                    stable_round(F.col("_m") - F.col("_s") / 2, 6).alias("bar_lo"),
                    stable_round(F.col("_m") + F.col("_s") / 2, 6).alias("bar_hi"))


def frame_latencies(tf: DataFrame) -> DataFrame:
    """Per-frame delivery latency in seconds: the 1 s smoothing floor plus dx milliseconds;
    the "file" a frame belongs to is its event type."""
    return tf.select(F.col("event_type").alias("file"), "video", "frame", "event_id",
                     (F.lit(1.0) + F.col("dx") / F.lit(1000.0)).alias("latency_s"))


def latency_stats(lat: DataFrame, fps: int) -> DataFrame:
    """Drop the warm-up (frame <= 3 s * fps) and the last frame of each file, convert to ms
    above the 1 s floor, and report mean, p50, p90, p99, max (linear interpolation)."""
    maxf = lat.groupBy("file").agg(F.max("frame").alias("_maxf"))
    kept = join_keys(lat, maxf, ["file"]).filter((F.col("frame") > WARMUP_SECONDS * fps) & (F.col("frame") < F.col("_maxf")))
    kept = kept.withColumn("ms", (F.col("latency_s") - 1) * 1000)
    basic = [F.count(F.lit(1)).alias("n"), F.avg("ms").alias("_mean"), F.max("ms").alias("_max")]
    j = exact_quantiles(kept, ["file"], "ms", [0.5, 0.9, 0.99], extra=basic)
    return j.select("file", "n", stable_round("_mean", 6).alias("mean_ms"),
                    stable_round("p50", 6).alias("p50_ms"), stable_round("p90", 6).alias("p90_ms"),
                    stable_round("p99", 6).alias("p99_ms"), stable_round("_max", 6).alias("max_ms"))


def ecdf(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Sorted values with (1..n)/n (every row its own step, unlike ``cume_dist`` on ties)."""
    r = number_rows(df.select(*keys, value, tie), keys, [value, tie], rn="_rn")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return join_keys(r, n, keys).select(*keys, value, (F.col("_rn") / F.col("_n")).alias("ecdf"))


def last_value(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The value on the last line of each key (later lines overwrite earlier ones)."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(f"last_{value}"),
                                 F.count(F.lit(1)).alias("n_lines"))
