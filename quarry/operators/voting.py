"""Ensemble majority vote with sequential escalation.

Votes of an item arrive in order k = 1, 2, ...; c_k is how often label_k occurs among the
first k votes. Three models always run; if one of their labels reaches 2 the item stops
at 3. Otherwise one more model runs at a time and the item stops at the first k >= 4
with c_k >= floor(k/2) + 1, or once 11 have run (the loop admits one past a cap of 10).

Only the first ``MAX_RUN`` votes of an item can matter, so after numbering the votes
(skew-safe) everything works on at most 11 rows per item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.nullsafe import join_keys
from quarry.functions.scalars import lcg, stable_round

INITIAL = 3
MAX_RUN = 11

# The model pool and the seconds one inference takes on each.
MODEL_POOL = (
    ("Resnet18", 0.007),
    ("Resnet50", 0.007),
    ("Resnet101", 0.011),
    ("BEiT", 0.018),
    ("ConvNeXT", 0.006),
    ("ViT384", 0.059),
    ("MIT_B0", 0.016),
)


def counted(votes: DataFrame) -> DataFrame:
    """The first MAX_RUN votes of each item with c_k."""
    v = votes.filter(F.col("k") <= MAX_RUN)
    w = Window.partitionBy("item", "label").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return v.withColumn("c", F.count(F.lit(1)).over(w))


def majority_vote(votes: DataFrame) -> DataFrame:
    """Per item: models_run, the winning label (null when none reached a majority) and
    whether it stopped after the initial batch."""
    c = counted(votes)
    early = "k <= 3 AND c >= 2"
    late = "k >= 4 AND c >= floor(k / 2) + 1"
    g = c.groupBy("item").agg(
        F.count(F.lit(1)).alias("_n"),
        F.expr(f"min_by(label, k) FILTER (WHERE {early})").alias("_early_label"),
        F.expr(f"min(k) FILTER (WHERE {early})").alias("_early_k"),
        F.expr(f"min_by(label, k) FILTER (WHERE {late})").alias("_late_label"),
        F.expr(f"min(k) FILTER (WHERE {late})").alias("_late_k"))
    models_run = (F.when(F.col("_early_k").isNotNull(), F.least(F.lit(INITIAL), F.col("_n")))
                   .when(F.col("_late_k").isNotNull(), F.col("_late_k"))
                   .otherwise(F.col("_n")))
    return g.select("item", models_run.cast("long").alias("models_run"),
                    F.coalesce("_early_label", "_late_label").alias("winner"),
                    F.col("_early_k").isNotNull().alias("stopped_early"))


def votes_run(votes: DataFrame, result: DataFrame) -> DataFrame:
    """The votes actually cast: k <= models_run of the item."""
    return votes.filter(F.col("k") <= MAX_RUN).transform(lambda v: join_keys(v, result.select("item", "models_run"), ["item"])) \
                .filter(F.col("k") <= F.col("models_run"))


def vote_tally(votes: DataFrame, result: DataFrame) -> DataFrame:
    return votes_run(votes, result).groupBy("item", "label").agg(F.count(F.lit(1)).alias("n_votes"))


def model_pick(votes: DataFrame) -> DataFrame:
    """Reproducible pseudo-random model for step k of item: LCG(item * 1000 + k) mod 7."""
    idx = F.pmod(lcg(F.col("item") * 1000 + F.col("k")), F.lit(len(MODEL_POOL))) + 1
    names = F.array(*[F.lit(n) for n, _ in MODEL_POOL])
    secs = F.array(*[F.lit(s) for _, s in MODEL_POOL])
    return votes.select("item", "k", "label", F.element_at(names, idx.cast("int")).alias("model"),
                        F.element_at(secs, idx.cast("int")).alias("service_s"))


def vote_summary(votes: DataFrame, result: DataFrame) -> DataFrame:
    """Serving totals: items, models run, items stopped at 3, the per-item latency (sum of
    service times of the votes run; only positive latencies count), and items with a winner."""
    per = (model_pick(votes_run(votes, result).select("item", "k", "label"))
           .groupBy("item").agg(F.sum("service_s").alias("latency_s")))
    j = join_keys(result, per, ["item"], "left")
    pos = F.when(F.col("latency_s") > 0, F.col("latency_s"))
    return j.agg(F.count(F.lit(1)).alias("n_items"),
                 F.sum("models_run").alias("total_models_run"),
                 F.count_if("stopped_early").alias("n_stopped_at_3"),
                 stable_round(F.sum(pos), 6).alias("total_latency_s"),
                 stable_round(F.avg(pos), 6).alias("mean_latency_s"),
                 stable_round(F.max(pos), 6).alias("max_latency_s"), F.count("winner").alias("n_decided"))
