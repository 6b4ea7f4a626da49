"""Sort, random shuffle and the dataflow shapes of the task-graph benchmarks, expressed as
DataFrame plans: Spark's exchange does the map -> merge -> reduce work.

Array "objects" are the 64-float ``embeddings`` vectors; a mapper is a vector and slice j
of every mapper goes to reducer j.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import lcg, stable_round
from quarry.operators.ordered import numbered
from quarry.plans.scalars import attach_scalar
from quarry.plans.sequence import number_rows


# ---- generated rows, sort, shuffle ------------------------------------------------------

def row_ids(lineitem: DataFrame) -> DataFrame:
    """A unique id per line item (line numbers are below 8)."""
    return lineitem.withColumn("row_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


def gen_rows(lineitem: DataFrame, num_columns: int = 2, parallelism: int = 8) -> DataFrame:
    """One generated row per line item: c_j = LCG applied j+1 times to the row id, uniform in
    [0, 2^31); ``block`` = row_id mod parallelism is the read task the row belongs to."""
    r = row_ids(lineitem).select("row_id")
    return r.select("row_id", F.pmod("row_id", F.lit(parallelism)).alias("block"),
                    *[lcg("row_id", j + 1).alias(f"c_{j}") for j in range(num_columns)])


def global_sort(lineitem: DataFrame) -> DataFrame:
    """Ascending sort on (price, order, line), delivered as ordered outputs and read back with the
    1-based global position."""
    li = lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return _delivered(li, ["l_extendedprice", "l_orderkey", "l_linenumber"])


def _delivered(df: DataFrame, keys: list[str]) -> DataFrame:
    return numbered(df, keys, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def random_shuffle(lineitem: DataFrame) -> DataFrame:
    """A reproducible uniform permutation: sort by LCG(row_id), tie-broken by row_id."""
    r = row_ids(lineitem).select("l_orderkey", "l_linenumber", "row_id").withColumn("_k", lcg("row_id"))
    return _delivered(r, ["_k", "row_id"]).drop("_k", "row_id")


def range_partition(lineitem: DataFrame, n: int) -> DataFrame:
    """Repartition to exactly n range partitions on price: per output its rows, lo and hi."""
    p = lineitem.select("l_extendedprice").repartitionByRange(n, "l_extendedprice").withColumn("part", F.spark_partition_id())
    return p.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


def range_invariants(parts: DataFrame) -> DataFrame:
    """What holds of ``range_partition`` however its bounds fall: outputs, rows, smallest and
    largest value, and how many outputs begin before the one in front of them has ended. The
    window sees one row per output."""
    before = F.lag("hi").over(Window.orderBy("part"))
    return parts.withColumn("_before", before).agg(
        F.count(F.lit(1)).alias("n_outputs"), F.sum("n_rows").alias("n_rows"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"), F.count_if(F.col("lo") <= F.col("_before")).alias("n_overlaps"))


#: Order keys of a block.
BLOCK_KEYS = 4096


def partition_stats(df: DataFrame) -> DataFrame:
    """Statistics of blocks of consecutive order keys: per block its line items, orders, first and last
    key and total price."""
    block = F.floor(F.col("l_orderkey") / F.lit(BLOCK_KEYS)).cast("long")
    return df.groupBy(block.alias("block")).agg(
        F.count(F.lit(1)).alias("num_rows"), F.countDistinct("l_orderkey").alias("num_orders"),
        F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"),
        stable_round(F.sum("l_extendedprice"), 2).alias("total_price"))


# ---- slices and all-to-all --------------------------------------------------------------

def split_slices(vectors: DataFrame, n: int, array_col: str = "embedding") -> DataFrame:
    """Cut each array into n contiguous slices of len // n elements; the last also takes the
    remainder. The slices are cut before they become rows, so no whole array is repeated."""
    arr = F.col(array_col)
    size = F.floor(F.size(arr) / F.lit(n)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(
        arr, i * size + 1, F.when(i == n - 1, F.size(arr) - i * size).otherwise(size)))
    return (vectors.select("vec_id", "label", F.posexplode(cut).alias("slice_idx", "values"))
            .withColumn("slice_idx", F.col("slice_idx").cast("long")))


def _slice_sum(c: str = "values"):
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def slice_summary(slices: DataFrame) -> DataFrame:
    return slices.select("vec_id", "slice_idx", F.size("values").alias("n_values"),
                         stable_round(_slice_sum(), 6).alias("slice_sum"))


def all_to_all(slices: DataFrame) -> DataFrame:
    """Reducer j receives slice j of every mapper."""
    return (slices.withColumn("_s", _slice_sum())
                  .groupBy("slice_idx").agg(F.count(F.lit(1)).alias("n_mappers"),
                                            F.sum(F.size("values")).alias("n_values"),
                                            stable_round(F.sum("_s"), 6).alias("total")))


def parallel_shuffle(slices: DataFrame, width: int) -> DataFrame:
    """``width`` independent all-to-all shuffles; mapper v belongs to shuffle v mod width."""
    return (slices.withColumn("shuffle_id", F.pmod("vec_id", F.lit(width))).withColumn("_s", _slice_sum())
                  .groupBy("shuffle_id", "slice_idx").agg(F.count(F.lit(1)).alias("n_mappers"),
                                                          stable_round(F.sum("_s"), 6).alias("total")))


def two_stage_shuffle(slices: DataFrame) -> DataFrame:
    """Two chained exchanges: by (label, slice) then by slice."""
    first = (slices.withColumn("_s", _slice_sum()).groupBy("label", "slice_idx")
                   .agg(F.sum("_s").alias("stage1_sum"), F.count(F.lit(1)).alias("stage1_n")))
    return first.groupBy("slice_idx").agg(F.count(F.lit(1)).alias("n_groups"),
                                          F.sum("stage1_n").alias("n_mappers"),
                                          stable_round(F.sum("stage1_sum"), 6).alias("total"))


def one_slice(vectors: DataFrame, n: int, array_col: str = "embedding") -> DataFrame:
    """Only slice 0 of n is consumed, so only that one is cut."""
    size = F.floor(F.size(array_col) / F.lit(n)).cast("int")
    return vectors.select("vec_id", F.slice(F.col(array_col), F.lit(1), size).alias("values")).select(
        "vec_id", stable_round(_slice_sum(), 6).alias("slice_sum"))


def skewed_group(lineitem: DataFrame) -> DataFrame:
    """Aggregate on a key where one value holds a third of the rows: partial aggregation
    before the exchange means the hot key ships one row per map task."""
    key = F.when(F.col("l_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_orderkey"))
    return (lineitem.withColumn("skew_key", key).groupBy("skew_key")
                    .agg(F.count(F.lit(1)).alias("n_rows"), stable_round(F.sum("l_quantity"), 6).alias("sum_qty")))


# ---- buckets and interleave ----------------------------------------------------------

def balanced_buckets(items: DataFrame, key: str, m: int) -> DataFrame:
    """R items in key order into m contiguous buckets; the first R mod m get one extra
    (the ``ntile`` rule), computed from a global row number and R, without a global window."""
    n = number_rows(items.select(key), [], [key], rn="_rn")
    n = attach_scalar(n, items.agg(F.count(F.lit(1)).alias("_r")))
    q = F.floor(F.col("_r") / F.lit(m))
    rem = F.col("_r") - q * F.lit(m)
    big = rem * (q + 1)
    bucket = F.when(F.col("_rn") <= big, F.floor((F.col("_rn") - 1) / (q + 1)) + 1) \
              .otherwise(rem + F.floor((F.col("_rn") - 1 - big) / F.nullif(q, F.lit(0))) + 1)
    start = F.when(bucket <= rem, (bucket - 1) * (q + 1)).otherwise(big + (bucket - 1 - rem) * q)
    out = n.withColumn("bucket", bucket.cast("long"))
    out = out.withColumn("pos_in_bucket", (F.col("_rn") - start).cast("long"))
    return out.withColumn("_q", q.cast("long")).withColumn("_rem", rem.cast("long"))


def interleave(buckets: DataFrame, key: str, m: int) -> DataFrame:
    """Round-robin order across buckets: position 1 of every bucket, then position 2, ...
    (order by (pos_in_bucket, bucket)), as arithmetic on the bucket sizes."""
    pos, b = F.col("pos_in_bucket"), F.col("bucket")
    rr = F.when(pos <= F.col("_q"), (pos - 1) * F.lit(m) + b).otherwise(F.col("_q") * F.lit(m) + b)
    return buckets.select(key, "bucket", "pos_in_bucket", rr.cast("long").alias("rr_order"))


# ---- dataflow shapes -----------------------------------------------------------------

def stage_chain(lineitem: DataFrame) -> DataFrame:
    """Four 1:1 stages fused into one codegen stage."""
    s1 = lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax",
                         (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s1"))
    s2 = s1.withColumn("s2", F.col("s1") * (1 + F.col("l_tax")))
    s3 = s2.withColumn("s3", F.col("s2") - F.col("l_quantity"))
    s4 = s3.withColumn("s4", F.col("s3") / 2)
    return s4.select("l_orderkey", "l_linenumber", stable_round("s4", 6).alias("stage_out"))


def diamond(lineitem: DataFrame) -> DataFrame:
    """One input consumed by two aggregations whose results meet again: both are taken in one pass
    over the shared input, so it is scanned and exchanged once, and a null flag meets itself."""
    return lineitem.groupBy("l_returnflag").agg(stable_round(F.sum("l_quantity"), 6).alias("sum_qty"),
                                               stable_round(F.avg("l_extendedprice"), 6).alias("avg_price"))


def three_way(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """consumer(a, b, c): per order its lines, its header and its customer."""
    lines = lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("_rev"))
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    c = customer.select("c_custkey", "c_mktsegment")
    j = lines.join(o, lines.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.select("o_orderkey", "o_orderstatus", "c_mktsegment", "n_lines",
                    stable_round("_rev", 6).alias("revenue"))


def gather_all(lineitem: DataFrame) -> DataFrame:
    return lineitem.agg(F.count(F.lit(1)).alias("n_rows"),
                        stable_round(F.sum("l_quantity"), 6).alias("sum_qty"),
                        stable_round(F.sum("l_extendedprice"), 6).alias("sum_price"),
                        stable_round(F.avg("l_discount"), 6).alias("avg_disc"))


def partial_final(lineitem: DataFrame) -> DataFrame:
    """Partial aggregation per map task, final per key after the exchange."""
    price = F.col("l_extendedprice")
    disc = price * (1 - F.col("l_discount"))
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        stable_round(F.sum("l_quantity"), 6).alias("sum_qty"),
        stable_round(F.sum(price), 6).alias("sum_base_price"),
        stable_round(F.sum(disc), 6).alias("sum_disc_price"),
        stable_round(F.sum(disc * (1 + F.col("l_tax"))), 6).alias("sum_charge"),
        stable_round(F.avg("l_quantity"), 6).alias("avg_qty"),
        stable_round(F.avg(price), 6).alias("avg_price"),
        stable_round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("count_order"))


def scatter_gather(lineitem: DataFrame) -> DataFrame:
    """Average per partition (supplier), then the unweighted average of those averages."""
    per = lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_extendedprice").alias("_a"))
    return per.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_parts"),
                                           stable_round(F.avg("_a"), 6).alias("avg_of_avgs"))


def running_backlog(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Line items ordered but not yet shipped, per day. Rows are first reduced to one per
    calendar day (+ordered, -shipped), so the running window runs over days, a domain that
    does not grow with the data."""
    li = lineitem.select("l_orderkey", "l_shipdate")
    o = orders.select("o_orderkey", "o_orderdate")
    made = li.join(o, li.l_orderkey == o.o_orderkey) \
             .groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("delta"))
    gone = li.groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg((-F.count(F.lit(1))).alias("delta"))
    per_day = made.unionByName(gone).groupBy("day").agg(F.sum("delta").alias("delta"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.withColumn("backlog", F.sum("delta").over(w))
