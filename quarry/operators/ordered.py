"""Ordered delivery: a sorted or shuffled dataset written as N outputs in order, and read back so.

Every output is one range of the sort keys, sorted inside: one file, or several files one behind the
other where it has more than ``PART_ROWS`` rows, so what a task sorts does not grow with the table. A
manifest holds, per file, its place, its output, its rows, the rows before it and its smallest and
largest key. A row's global position is the rows before its file plus its place in it, so no window,
no second sort and no checkpoint are needed to number the rows: the written outputs are the only
materialisation.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.sequence import chunk_window, with_halo
from quarry.session import scratch_path

#: Rows of a file, about: ranges are cut by a sample.
PART_ROWS = 1_000_000


def _write(df: DataFrame, keys: list[str], n: int, path: str) -> None:
    files = n * max(1, math.ceil(df.count() / (n * PART_ROWS)))
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.parquet(f"{path}/data")


def _places(per: DataFrame, n: int) -> DataFrame:
    """``part`` (a file's place), ``output`` and ``rows_before`` for rows (file, n_rows, ...), one per
    file. The files are shared out evenly over ``n`` outputs. Their numbers are in their names; the
    windows see one row per file."""
    number = F.struct(*[F.regexp_extract("file", p, 1).try_cast("long") for p in (r"^part-(\d+)", r"-c(\d+)")])
    place = Window.orderBy("_number")
    files = F.count(F.lit(1)).over(Window.partitionBy())
    return per.withColumn("_number", number).withColumn("part", (F.row_number().over(place) - 1).cast("long")).withColumn(
        "output", F.floor(F.col("part") * F.least(F.lit(n), files) / files).cast("long")).withColumn(
        "rows_before", F.sum("n_rows").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_rows")).drop("_number")


def write_ordered(df: DataFrame, keys: list[str], n: int, path: str | None = None) -> str:
    """Write ``df`` as at most ``n`` outputs, ascending by ``keys`` (which should be unique) inside
    and between them, with a manifest; returns the folder. Ranges that get no row give no file."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "ordered")
    _write(df, keys, n, path)
    per = _lowest_and_highest(spark.read.schema(df.schema).parquet(f"{path}/data"), keys)
    _places(per, n).select("output", "part", "file", "n_rows", "rows_before", "lo", "hi").write.parquet(f"{path}/manifest")
    return path


def _lowest_and_highest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """file, n_rows, lo and hi of read rows. Spark sorts for an aggregate of structs, so the first key,
    aggregated without a sort, first leaves few rows that may be lowest or highest (nulls are lowest)."""
    rows = rows.select(F.col("_metadata.file_name").alias("file"), *keys)
    first = F.col(keys[0])
    ends = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.max(first).alias("_high"),
                                    F.when(F.count(first) == F.count(F.lit(1)), F.min(first)).alias("_low"))
    found = rows.join(F.broadcast(ends), "file").filter(first.eqNullSafe(F.col("_low")) | first.eqNullSafe(F.col("_high")))
    return found.groupBy("file", "n_rows").agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi"))


def numbered(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The rows with their global position ``pos``, from 1, in the order of ``keys`` (unique): written
    as ordered outputs and read back, without a manifest; the counts per file read no column."""
    path = scratch_path(df.sparkSession, "ordered")
    _write(df, keys, n, path)
    whole = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")
    per = whole.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    return _positions(whole, _places(per, n)).drop("output")


def _positions(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``output`` and ``pos`` of read rows. There is one row per file, so the files are broadcast."""
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    m = files.select(F.col("file").alias("_of"), "output", "rows_before")
    return rows.join(F.broadcast(m), rows["_file"] == m["_of"]).withColumn("pos", F.col("rows_before") + F.col("_at") + 1) \
        .drop("_file", "_at", "_of", "rows_before")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """output, part, file, n_rows, rows_before, lo, hi: one row per file."""
    return spark.read.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """output, files (in order), n_rows, rows_before, lo, hi: one row per output."""
    return parts(spark, path).groupBy("output").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("part", "file"))), lambda p: p["file"]).alias("files"),
        F.sum("n_rows").alias("n_rows"), F.min("rows_before").alias("rows_before"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def read_ordered(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows with their ``output`` and global position ``pos``, from 1."""
    return _positions(spark.read.schema(schema).parquet(f"{path}/data"), parts(spark, path))


def one_output(spark: SparkSession, path: str, output: int, schema) -> DataFrame:
    """The rows of one output as they are delivered: in order, from its files only."""
    found = [r["files"] for r in manifest(spark, path).filter(F.col("output") == output).select("files").collect()]  # one row
    files = [spark.read.schema(schema).parquet(f"{path}/data/{n}") for names in found for n in names]
    return reduce(DataFrame.union, files).coalesce(1) if files else spark.createDataFrame([], schema)


def order_report(spark: SparkSession, path: str, keys: list[str], schema) -> DataFrame:
    """One row: outputs, rows, and how often order is broken inside an output (a row below the one in
    front of it in the file, a file that begins before the one in front has ended) and between outputs
    (likewise). A window sees a chunk of a file, or the manifest; a task gets about a file's rows."""
    rows = spark.read.schema(schema).parquet(f"{path}/data").select(
        F.struct(*keys).alias("k"), F.col("_metadata.file_name").alias("f"), (F.col("_metadata.row_index") + 1).alias("i"))
    chunks = with_halo(rows, "i", before=1).repartition(max(1, parts(spark, path).count()), "f", "_q_chunk")
    inside = chunks.withColumn("b", F.lag("k").over(chunk_window(["f"], "i"))).filter("_q_home").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("k") < F.col("b")).alias("_inside"))
    place = Window.orderBy("part")
    m = parts(spark, path).withColumn("_broken", F.col("lo") < F.lag("hi").over(place)).withColumn("_same", F.col("output") == F.lag("output").over(place))
    between = m.agg(F.count_distinct("output").alias("n_outputs"), F.count_if(F.col("_broken") & F.col("_same")).alias("_files"),
                    F.count_if(F.col("_broken") & ~F.col("_same")).alias("broken_between"))
    return between.join(inside).select("n_outputs", "n_rows", (F.col("_inside") + F.col("_files")).alias("broken_inside"), "broken_between")
