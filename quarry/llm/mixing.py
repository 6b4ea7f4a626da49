"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a fixed shuffled order (an MD5 of the id), twice over, since
a source may be used up to two times. An instance's virtual finish time is its source's
cumulative tokens divided by the source's target; the instances of all sources are sorted by
finish time and taken until the budget is spent, the last one in part.

Running sums never put a source, or the table, into one task: rows fall into buckets of the
order (hash or finish-time ranges), bucket totals give each bucket its offset, and only rows
of one bucket are summed in order.

Defined results: a null text has size 0 and takes nothing; null is a source like any other,
ordered last; if all sizes are 0, targets and takes are 0; repeated rows are separate
documents; an empty table gives an empty result. Only ``doc_id``, ``text`` and ``source`` are
read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, numbered, partitions, ready, written

WEIGHTS = (5, 2, 1)
BUDGET_PCT = 150
MAX_USES = 2
#: Rows a bucket of the order aims at (the buckets' totals are summed in one task), and the least
#: number of finish-time buckets.
BUCKET_ROWS, TIME_BUCKETS = 16384, 4096
_HASH_BITS = 56


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``out``: inclusive running sum of ``value`` in (bucket, order) within ``keys``."""
    total = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    at = total.select(*[F.col(k).alias(f"_{k}") for k in [*keys, bucket]],
                      F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, bucket]]
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_in", F.sum(value).over(inside)).join(at, on) \
        .withColumn(out, F.col("_off") + F.col("_in")).drop("_in", "_off", *[f"_{k}" for k in [*keys, bucket]])


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from one row per source. Water filling: sources in the
    order of (their limit / weight); the first k are full, the others share the rest by
    weight, with the smallest k for which none of those is above its limit."""
    w = F.element_at(F.lit(list(WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    # encode() would order alike: Spark compares strings by their UTF-8 bytes, so by code point
    s = sizes.withColumn("rank", F.row_number().over(by_code_point)).withColumn("w", w) \
        .withColumn("limit", F.col("source_size") * MAX_USES)
    fill = Window.orderBy(F.col("limit") / F.col("w"), "rank")
    before, here = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(BUDGET_PCT) / F.lit(100.0)
                               - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("w").over(here))
    share = F.min(F.when(F.col("level") <= F.col("limit") / F.col("w"), F.struct(F.col("limit") / F.col("w"), "rank", "level"))) \
        .over(Window.partitionBy())["level"]
    return s.withColumn("share", share).select(
        "source", "source_size", F.when(F.col("share").isNull(), F.col("limit").cast("double")).otherwise(
            F.least(F.col("limit").cast("double"), F.col("share") * F.col("w"))).alias("target"))


def schedule(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken (words, repeats
    counted) and copies (instances of it that the mix takes, at least in part)."""
    return _uses(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")).drop("row")


def _uses(rows: DataFrame) -> DataFrame:
    """The schedule of (row, doc_id, source, text), with the row's number."""
    spark = ready(rows.sparkSession)
    # the text is read once: what is written is (row, doc_id, source, size, hash)
    d = rows.select("row", "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                    F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, _HASH_BITS // 4), 16, 10)
                    .cast("long").alias("h")).checkpoint()
    goal = targets(d.groupBy("source").agg(F.sum("size").alias("source_size"))) \
        .withColumnRenamed("source", "_source").checkpoint()
    total, count = d.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()  # two numbers
    budget = total * BUDGET_PCT // 100
    # buckets grow with the rows, so what one task sorts does not; sums are exact, so no row changes
    many = max(4 * partitions(spark), count // BUCKET_ROWS)
    times = max(TIME_BUCKETS, 1 << (MAX_USES * count // BUCKET_ROWS).bit_length())
    d = d.join(goal, d["source"].eqNullSafe(goal["_source"])).drop("_source") \
        .withColumn("hb", F.shiftright(F.col("h"), _HASH_BITS - max(4, many.bit_length())))
    d = _running(d, ["source"], "hb", [F.col("h"), F.col("doc_id"), F.col("size"), F.col("row")], "size", "cum")
    # documents without a word take nothing and have no place in the queue (a source's target is 0
    # only if all its documents are such)
    runs = d.filter("size > 0").withColumn("use", F.explode(F.lit(list(range(MAX_USES))))).withColumn(
        "finish", (F.col("use") * F.col("source_size") + F.col("cum")) / F.col("target"))
    # evenly spaced up to 1.5 times the time at which targets are met, then by logarithm
    runs = runs.withColumn("fb", F.when(F.col("finish") < 1.5, F.floor(F.col("finish") * times)).otherwise(
        int(1.5 * times) + F.floor(F.log2(F.col("finish") / 1.5) * (times // 8))).cast("int"))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("h"), F.col("doc_id"), F.col("use"), F.col("size"), F.col("row")]
    took = _running(runs, [], "fb", order, "size", "spent").withColumn(
        "take", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("size") - F.col("spent") + F.lit(budget))))
    names = ["doc_id", "size", "source", "source_size", "target"]
    return took.groupBy("row").agg(
        *[F.first(c).alias(c) for c in names],
        F.sum("take").alias("taken"), F.count_if(F.col("take") > 0).cast("int").alias("copies")).unionByName(
        d.filter("size = 0").select("row", *names, F.lit(0).cast("long").alias("taken"), F.lit(0).alias("copies")))


def mix(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: every row as often as the mix takes it, at least in part (the
    last document of the budget is not cut). Rows are told apart by numbers that are written with
    them, so rows that share a doc_id, or have none, are used each by their own schedule; columns
    may have any name."""
    ready(docs.sparkSession)
    rows = written(numbered(docs), "mixing")
    took = _uses(rows.select("row", "doc.doc_id", "doc.source", "doc.text")).filter("copies > 0").select("row", "copies")
    return rows.join(took, "row").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op4(docs: DataFrame) -> DataFrame:
    return schedule(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = f"""
WITH d AS (SELECT doc_id, source,
      coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {_HASH_BITS // 4}))::BIGINT AS h,
      row_number() OVER () AS rid FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
      [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS w
      FROM d GROUP BY source),
r AS (SELECT *, source_size * {MAX_USES} AS lim, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
f AS (SELECT *, ((sum(source_size) OVER ())::BIGINT * {BUDGET_PCT} / 100::DOUBLE
        - coalesce(sum(lim) OVER (ORDER BY lim / w::DOUBLE, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
        / (sum(w) OVER (ORDER BY lim / w::DOUBLE, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
p AS (SELECT arg_min(level, (lim / w::DOUBLE, rk)) AS share FROM f WHERE level <= lim / w::DOUBLE),
t AS (SELECT source, source_size, CASE WHEN share IS NULL THEN lim::DOUBLE ELSE least(lim::DOUBLE, share * w) END AS target
      FROM f, p),
c AS (SELECT d.*, source_size, target, (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size, rid
        ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, CASE WHEN target > 0 THEN (u.use * source_size + cum) / target ELSE 0 END AS finish
      FROM c, (SELECT unnest(range({MAX_USES})) AS use) u),
g AS (SELECT *, (sum(size) OVER (ORDER BY finish, source NULLS LAST, h, doc_id, use, size, rid ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM u),
k AS (SELECT *, greatest(0, least(size, size - spent + (SELECT (sum(size) * {BUDGET_PCT} // 100)::BIGINT FROM d))) AS take FROM g)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size,
       any_value(target) AS target, sum(take)::BIGINT AS taken, (count(*) FILTER (take > 0))::INTEGER AS copies
FROM k GROUP BY rid
"""
