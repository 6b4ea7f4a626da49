"""Exact linear-interpolation quantiles by distributed selection, without sorting a group or
gathering it into one task.

A mergeable sketch (one aggregate) brackets each wanted rank between two values. A second pass
counts rows: one count per distinct value inside a bracket, one per gap between brackets, all
partial aggregates, so a group that holds a third of the rows stays spread and sends few counts
per task. Running totals over those counts (a few values in ten thousand of a group) find the
exact values at the ranks: q(p) = v[lo] + (h - lo) * (v[hi] - v[lo]) with h = (n - 1) p.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.nullsafe import join_keys

#: The sketch's rank error is 1 / ACCURACY of a group; a bracket reaches SLACK of them to each side,
#: which also covers the two ranks between p * n and p * (n - 1). Groups of at most ACCURACY rows
#: are one bracket.
ACCURACY, SLACK = 10_000, 4


def _tag(p: float) -> str:
    return f"p{round(p * 100):02d}" if p < 1 else "p100"


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], names: dict | None = None,
                    extra: list[Column] | None = None) -> DataFrame:
    """keys, the quantiles of the non-null values (null if a group has none), and the ``extra``
    aggregates, which are computed in the first pass."""
    d = SLACK / ACCURACY
    marks = sorted({x for p in probs for x in (max(0.0, p - d), min(1.0, p + d))})
    sketch = df.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.percentile_approx(value, marks, ACCURACY).alias("_m"), F.min(value).alias("_lo"),
        F.max(value).alias("_hi"), *(extra or []))
    small = F.col("_n") <= ACCURACY
    at = {x: F.col("_m")[i] for i, x in enumerate(marks)}
    ends = [F.struct(F.when(small, F.col("_lo")).otherwise(at[max(0.0, p - d)]).alias("lo"),
                     F.when(small, F.col("_hi")).otherwise(at[min(1.0, p + d)]).alias("hi")) for p in sorted(probs)]
    brackets = sketch.select(*keys, F.array(*ends).alias("_b"))
    rows = join_keys(df.filter(F.col(value).isNotNull()).select(*keys, value), brackets, keys)
    x = F.col(value)
    inside = F.exists("_b", lambda b: (x >= b["lo"]) & (x <= b["hi"]))
    gap = F.size(F.filter("_b", lambda b: b["hi"] < x))
    counts = rows.select(*keys, x.alias("_x"), F.when(inside, x).alias("_v"), F.when(~inside, gap).alias("_gap")) \
        .groupBy(*keys, "_v", "_gap").agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_at"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    ranked = join_keys(counts.withColumn("_upto", upto).filter(F.col("_v").isNotNull()), sketch.select(*keys, "_n"), keys)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_c")), F.col("_v")))

    aggs, outs = [], []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        aggs += [value_at(F.floor(h) + 1).alias(f"_l{i}"), value_at(F.ceil(h) + 1).alias(f"_u{i}"), F.max(h - F.floor(h)).alias(f"_f{i}")]
        q = F.col(f"_l{i}") + F.col(f"_f{i}") * (F.col(f"_u{i}") - F.col(f"_l{i}"))
        outs.append(q.alias((names or {}).get(p, _tag(p))))
    found = ranked.groupBy(*keys).agg(*aggs).select(*keys, *outs)
    return join_keys(sketch.drop("_n", "_m", "_lo", "_hi"), found, keys, "left")
