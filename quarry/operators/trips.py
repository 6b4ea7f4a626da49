"""Many-model training: per (file, pickup location) prepare trips, split 75/25, fit one-feature
regressors, score by MAE, rank.

Nothing runs per group on the driver or in one task per group: the OLS fit is one aggregate
pass (``regr_slope``/``regr_intercept`` merge partial sums), the tree is a group-by on
(group, x) plus an as-of lookup over distinct x values only, and scoring joins test rows to
predictions on (group, x).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import LCG_MODULUS, lcg, stable_round, trip_duration
from quarry.plans.sequence import number_rows

GROUP = ["file", "pickup_location_id"]
MIN_GROUP_ROWS = 4
TEST_FRACTION_DENOM = 4

# The regressors fitted for every group, in the order they are listed.
MODELS = ("linear_regression", "decision_tree", "decision_tree_random")


def prepare_trips(raw: DataFrame) -> DataFrame:
    """Parse 'yyyy-MM-dd HH:mm:ss' times, add trip_duration (seconds component of the
    difference), replace null location ids by -1."""
    fmt = "yyyy-MM-dd HH:mm:ss"
    t = (raw.withColumn("pickup_at", F.to_timestamp_ntz("pickup_at", F.lit(fmt)))
            .withColumn("dropoff_at", F.to_timestamp_ntz("dropoff_at", F.lit(fmt))))
    return (t.withColumn("trip_duration", trip_duration("pickup_at", "dropoff_at"))
             .withColumn("pickup_location_id", F.coalesce("pickup_location_id", F.lit(-1)).cast("long"))
             .withColumn("dropoff_location_id", F.coalesce("dropoff_location_id", F.lit(-1)).cast("long")))


def group_sizes(trips: DataFrame) -> DataFrame:
    return trips.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_rows"))


def gated_groups(trips: DataFrame) -> DataFrame:
    """Groups with at least MIN_GROUP_ROWS trips (fewer cannot be split)."""
    return group_sizes(trips).filter(F.col("n_rows") >= MIN_GROUP_ROWS)


def split_train_test(trips: DataFrame) -> DataFrame:
    """Add ``is_test``: per gated group, the first ceil(n/4) trips in a reproducible shuffled
    order (LCG of trip_id, then trip_id) are the test set, the rest train."""
    t = number_rows(trips.withColumn("_h", lcg("trip_id")), GROUP, ["_h", "trip_id"], rn="_pos", total="n_rows")
    return (t.filter(F.col("n_rows") >= MIN_GROUP_ROWS)
             .withColumn("is_test", F.col("_pos") <= F.ceil(F.col("n_rows") / F.lit(TEST_FRACTION_DENOM))).drop("_h", "_pos"))


def _xy(split: DataFrame) -> DataFrame:
    return split.select(*GROUP, "is_test", F.col("dropoff_location_id").alias("x"),
                        F.col("trip_duration").cast("double").alias("y"))


def _mae(test: DataFrame, pred_col: str, model: str) -> DataFrame:
    return (test.groupBy(*GROUP)
                .agg(stable_round(F.avg(F.abs(F.col("y") - F.col(pred_col))), 3).alias("mae"))
                .withColumn("model", F.lit(model)))


def ols_fit(split: DataFrame) -> DataFrame:
    """Least squares y = a + b x on the train rows; constant x gives b = 0, a = mean(y)."""
    tr = _xy(split).filter(~F.col("is_test"))
    varies = F.var_pop("x") > 0
    return tr.groupBy(*GROUP).agg(
        F.when(varies, F.regr_slope("y", "x")).otherwise(F.lit(0.0)).alias("slope"),
        F.when(varies, F.regr_intercept("y", "x")).otherwise(F.avg("y")).alias("intercept"))


def ols_group_mae(split: DataFrame) -> DataFrame:
    te = _xy(split).filter(F.col("is_test"))
    fit = ols_fit(split)
    scored = te.join(fit, GROUP, "inner").withColumn(
        "pred", F.col("intercept") + F.col("slope") * F.col("x"))
    return _mae(scored, "pred", MODELS[0]).select(*GROUP, "model", "mae")


def tree_neighbours(xy: DataFrame) -> DataFrame:
    """For every distinct test x its nearest trained x below and above (itself included) and
    their mean y: GROUP, x, lo_x, lo_y, hi_x, hi_y. One aggregate to distinct x values comes
    first, so the window per group is bounded by the feature's domain, not by trips; both
    windows only look back, in ascending and in descending order."""
    train = ~F.col("is_test")
    cells = xy.groupBy(*GROUP, "x").agg(F.avg(F.when(train, F.col("y"))).alias("mean_y"),
                                        F.max(train).alias("_t"), F.max("is_test").alias("_asked"))
    back = lambda o: Window.partitionBy(*GROUP).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_t"), F.struct("x", "mean_y")), ignorenulls=True)
    return (cells.withColumn("_lo", seen.over(back(F.col("x").asc()))).withColumn("_hi", seen.over(back(F.col("x").desc())))
            .filter("_asked")
            .select(*GROUP, "x", F.col("_lo.x").alias("lo_x"), F.col("_lo.mean_y").alias("lo_y"),
                    F.col("_hi.x").alias("hi_x"), F.col("_hi.mean_y").alias("hi_y")))


def tree_value(random_split: bool = False) -> Column:
    """Prediction of a fully grown one-feature regression tree from ``tree_neighbours``.

    Grown until pure, such a tree predicts the mean y of the trained x a query falls to:
    the nearest trained x, the lower one on a tie (the midpoint goes left). The random
    splitter instead cuts each gap at a reproducible point a + u (b - a), u from an LCG.
    """
    gap = F.col("hi_x") - F.col("lo_x")
    if random_split:
        u = lcg(lcg("lo_x") + F.col("hi_x")) / F.lit(float(LCG_MODULUS))
        go_low = F.col("x") <= F.col("lo_x") + u * gap
    else:
        go_low = (F.col("x") - F.col("lo_x")) <= (F.col("hi_x") - F.col("x"))
    return (F.when(F.col("lo_x").isNull(), F.col("hi_y")).when(F.col("hi_x").isNull(), F.col("lo_y"))
             .when(gap == 0, F.col("lo_y")).when(go_low, F.col("lo_y")).otherwise(F.col("hi_y")))


def tree_group_mae(split: DataFrame, random_split: bool = False) -> DataFrame:
    xy = _xy(split)
    scored = xy.filter("is_test").join(tree_neighbours(xy), [*GROUP, "x"]).withColumn("pred", tree_value(random_split))
    return _mae(scored, "pred", MODELS[2] if random_split else MODELS[1]).select(*GROUP, "model", "mae")


def all_model_scores(split: DataFrame) -> DataFrame:
    """GROUP, model, mae of every model: one fit, one neighbour search and one scoring pass
    over the test rows, then a row per model."""
    xy = _xy(split)
    scored = xy.filter("is_test").join(tree_neighbours(xy), [*GROUP, "x"]).join(ols_fit(split), GROUP)
    preds = (F.col("intercept") + F.col("slope") * F.col("x"), tree_value(False), tree_value(True))
    maes = scored.groupBy(*GROUP).agg(*[
        stable_round(F.avg(F.abs(F.col("y") - p)), 3).alias(m) for m, p in zip(MODELS, preds)])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("mae")) for m in MODELS]))
    return maes.select(*GROUP, each.alias("_m")).select(*GROUP, "_m.model", "_m.mae")


def rank_models(scores: DataFrame) -> DataFrame:
    """Rank 1 = lowest MAE in the group; ties by model name."""
    w = Window.partitionBy(*GROUP).orderBy("mae", "model")
    return scores.withColumn("model_rank", F.row_number().over(w).cast("long"))


def group_x_model(trips: DataFrame) -> DataFrame:
    """Every trainable group paired with every model (a generator, not a join)."""
    g = gated_groups(trips)
    n_test = F.ceil(F.col("n_rows") / F.lit(TEST_FRACTION_DENOM))
    return g.select(*GROUP, F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"),
                    (F.col("n_rows") - n_test).cast("long").alias("n_train"),
                    n_test.cast("long").alias("n_test"))


def train_counters(trips: DataFrame) -> DataFrame:
    """Per file: locations seen, groups trained, and models fitted."""
    g = group_sizes(trips)
    trained = F.count_if(F.col("n_rows") >= MIN_GROUP_ROWS)
    return g.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_locations"), trained.alias("n_trained"),
        (trained * F.lit(len(MODELS))).alias("n_model_fits"))
