"""Ordered work per key without putting a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task; when
one key holds a third of the rows that task is the whole job. These helpers keep each
task bounded:

* ``number_rows`` range-partitions on (key, order), so a hot key spans many tasks, and
  adds each task's offset, computed from per-(task, key) counts. This is the
  count-then-offset scheme of ``zipWithIndex``, written with DataFrame operators. The
  range-partitioned rows are written once with ``checkpoint()`` (to the shared folder in
  ``spark.checkpoint.dir``): range bounds come from a sample whose seed differs between
  two evaluations, so the counts and the rows must come from one materialisation. The
  checkpoint also cuts the lineage, so a lost executor does not recompute the sort.
* ``with_halo`` cuts each key's sequence into chunks of ``chunk_rows`` consecutive rows
  and copies the few rows a window frame needs from the neighbouring chunk into it, so
  ``lag``/``lead``/``rowsBetween(-r, r)`` run per (key, chunk) with identical results.
* ``running_totals`` sums inside each chunk and adds the total of all earlier chunks.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

DEFAULT_CHUNK_ROWS = 1 << 16


def _cols(xs: Iterable) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _null_safe_on(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def number_rows(df: DataFrame, keys: list[str], order: list, rn: str = "rn",
                partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Add ``rn`` = 1-based row number inside ``keys`` ordered by ``order``, and ``total``, if named:
    the rows of the key, from the same counts.

    ``order`` must be a total order inside a key (end it with a unique column); with
    ``keys=[]`` the number is global. Plan: one range exchange on (keys, order), a sort
    inside each task, then a join with a table of one row per (task, key). That table has
    at most (#keys + #tasks) rows; AQE broadcasts it when it measures small.
    """
    spark = df.sparkSession
    sort_cols = _cols(keys) + _cols(order)
    ensure_checkpoint_dir(spark)
    # Without an explicit count the range exchange follows spark.sql.shuffle.partitions and
    # AQE may merge small neighbouring ranges; merged ranges stay contiguous and are sorted
    # again below, so the numbering is unaffected.
    ranged = df.repartitionByRange(partitions, *sort_cols) if partitions else df.repartitionByRange(*sort_cols)
    ranged = (ranged.sortWithinPartitions(*sort_cols)
                .withColumn("_q_pid", F.spark_partition_id())
                .withColumn("_q_mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    stats = ranged.groupBy("_q_pid", *keys).agg(
        F.min("_q_mid").alias("_q_first"), F.count(F.lit(1)).alias("_q_cnt"))
    before = Window.partitionBy(*keys).orderBy("_q_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    stats = stats.withColumn("_q_off", F.coalesce(F.sum("_q_cnt").over(before), F.lit(0)))
    stats = stats.withColumn("_q_all", F.sum("_q_cnt").over(Window.partitionBy(*keys)) if total else F.lit(0))
    stats = stats.select("_q_pid", *keys, "_q_first", "_q_off", "_q_all")
    r, s = ranged.alias("_q_r"), stats.alias("_q_s")
    joined = r.join(s, (r["_q_pid"] == s["_q_pid"]) & _null_safe_on(r, s, keys), "inner")
    out_cols = [r[c] for c in df.columns]
    return joined.select(
        *out_cols,
        (r["_q_mid"] - s["_q_first"] + s["_q_off"] + 1).alias(rn), *([s["_q_all"].alias(total)] if total else []))


def with_chunk(df: DataFrame, rn: str = "rn", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    return df.withColumn("_q_chunk", F.floor((F.col(rn) - 1) / F.lit(chunk_rows)).cast("long"))


def with_halo(df: DataFrame, rn: str = "rn", before: int = 0, after: int = 0,
              chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add ``_q_chunk`` and ``_q_home``; rows near a chunk edge appear a second time
    (``_q_home`` false) in the neighbouring chunk. Window over
    ``partitionBy(*keys, "_q_chunk").orderBy(rn)``, then keep ``_q_home``."""
    if before > chunk_rows or after > chunk_rows:
        raise ValueError("window reach must not exceed chunk_rows")
    pos = (F.col(rn) - 1) % F.lit(chunk_rows)
    chunk = F.floor((F.col(rn) - 1) / F.lit(chunk_rows)).cast("long")
    entry = lambda c, home: F.struct(c.alias("c"), F.lit(home).alias("h"))
    copies = F.array(entry(chunk, True))
    if after > 0:
        copies = F.when((pos < after) & (chunk > 0),
                        F.array_union(copies, F.array(entry(chunk - 1, False)))).otherwise(copies)
    if before > 0:
        copies = F.when(pos >= chunk_rows - before,
                        F.array_union(copies, F.array(entry(chunk + 1, False)))).otherwise(copies)
    return (df.withColumn("_q_e", F.explode(copies))
              .withColumn("_q_chunk", F.col("_q_e.c"))
              .withColumn("_q_home", F.col("_q_e.h"))
              .drop("_q_e"))


def chunk_window(keys: list[str], rn: str = "rn"):
    return Window.partitionBy(*keys, "_q_chunk").orderBy(rn)


def neighbours(df: DataFrame, keys: list[str], rn: str, cols: Mapping[str, tuple[str, int]],
               chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add columns from the row ``offset`` places away in the same key
    (``cols = {new_name: (source_col, offset)}``; negative = earlier, like ``lag``)."""
    before = max([-o for _, o in cols.values()] + [0])
    after = max([o for _, o in cols.values()] + [0])
    h = with_halo(df, rn, before, after, chunk_rows)
    w = chunk_window(keys, rn)
    for name, (src, off) in cols.items():
        h = h.withColumn(name, F.lag(src, -off).over(w) if off < 0 else F.lead(src, off).over(w))
    return h.filter("_q_home").drop("_q_chunk", "_q_home")


def running_totals(df: DataFrame, keys: list[str], rn: str, sums: Mapping[str, Column],
                   chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add ``name = sum(expr)`` over rows 1..rn of the key, for each entry of ``sums``."""
    c = with_chunk(df, rn, chunk_rows)
    w = Window.partitionBy(*keys, "_q_chunk").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    local = c.select("*", *[F.sum(e).over(w).alias(f"_q_loc_{n}") for n, e in sums.items()])
    totals = c.groupBy(*keys, "_q_chunk").agg(*[F.sum(e).alias(f"_q_tot_{n}") for n, e in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_q_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_q_chunk", *[
        F.coalesce(F.sum(f"_q_tot_{n}").over(earlier), F.lit(0)).alias(f"_q_car_{n}") for n in sums])
    a, b = local.alias("_q_a"), carry.alias("_q_b")
    j = a.join(b, (a["_q_chunk"] == b["_q_chunk"]) & _null_safe_on(a, b, keys), "inner")
    return j.select(*[a[x] for x in df.columns],
                    *[(a[f"_q_loc_{n}"] + b[f"_q_car_{n}"]).alias(n) for n in sums])


def window_sums(df: DataFrame, keys: list[str], rn: str, exprs: Mapping[str, Column],
                before: int, after: int, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add ``name = sum(expr)`` over rows rn-before .. rn+after of the same key, and
    ``_q_cnt`` = number of rows in that frame."""
    h = with_halo(df, rn, before, after, chunk_rows)
    w = chunk_window(keys, rn).rowsBetween(-before, after)
    h = h.select("*", *[F.sum(e).over(w).alias(n) for n, e in exprs.items()])
    return h.filter("_q_home").drop("_q_chunk", "_q_home")
