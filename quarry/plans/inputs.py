"""How the reference's inputs are derived from the shared tables.

Each function reads a shared table and returns the shape an operator expects, so every
registered query's work grows with the tables:

* trips: ``events`` per user in (ts, event_id) order; a trip starts at one event and ends
  at the user's next event; the pickup location is the user, the dropoff location
  ``floor(value)``, and the "file" is the month (the reference keeps one file per month).
* transforms (one video per user): frame = position in (ts, event_id) order,
  dx = value, dy = props.k, da = (props.k - 50) / 1000.
* votes (one item per user): k = position in (ts, event_id) order, label = event_type.
* vectors and points: ``embeddings``; point i of a vector is (e[2i], e[2i+1]).
* trial results: ``orders``; one trial per order, runtime = o_totalprice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.sequence import DEFAULT_CHUNK_ROWS, neighbours, number_rows
from quarry.sources.tables import table

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
EVENT_ORDER = ["ts", "event_id"]


def numbered_events(spark: SparkSession, sf_dir: str, cols: list[str] | None = None) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    if cols:
        ev = ev.select(*sorted(set(cols) | {"user_id", "ts", "event_id"}))
    return number_rows(ev, ["user_id"], EVENT_ORDER, rn="rn")


def first_events(spark: SparkSession, sf_dir: str, n: int, cols: list[str]) -> DataFrame:
    """The first ``n`` events of every user with their number ``rn``. Spark turns the bound on
    row_number into a limit per group before the shuffle, so each task sends at most n rows
    of a user, however many that user has."""
    ev = table(spark, sf_dir, "events").select(*sorted(set(cols) | {"user_id", "ts", "event_id"}))
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(*EVENT_ORDER)).cast("long")
    return ev.withColumn("rn", rn).filter(F.col("rn") <= n)


def raw_trips(spark: SparkSession, sf_dir: str, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Trip rows as a trip file carries them: times as text, ids possibly null."""
    ev = numbered_events(spark, sf_dir, ["value"])
    ev = neighbours(ev, ["user_id"], "rn", {"next_ts": ("ts", 1)}, chunk_rows)
    return (ev.filter(F.col("next_ts").isNotNull())
              .select(F.col("event_id").alias("trip_id"),
                      F.date_format("ts", "yyyy-MM").alias("file"),
                      F.date_format("ts", TIME_FORMAT).alias("pickup_at"),
                      F.date_format("next_ts", TIME_FORMAT).alias("dropoff_at"),
                      F.col("user_id").alias("pickup_location_id"),
                      F.floor("value").cast("long").alias("dropoff_location_id")))


def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = numbered_events(spark, sf_dir, ["value", "props"])
    k = F.regexp_extract("props", r'"k":\s*(-?\d+)', 1).try_cast("double")
    return ev.select(F.col("user_id").alias("video"), (F.col("rn") - 1).alias("frame"),
                     F.col("event_id"), F.col("ts"),
                     F.col("value").alias("dx"), k.alias("dy"),
                     ((k - F.lit(50.0)) / F.lit(1000.0)).alias("da"))


def votes(spark: SparkSession, sf_dir: str, first: int) -> DataFrame:
    """The first ``first`` votes of every item: later ones are never asked for."""
    ev = first_events(spark, sf_dir, first, ["event_type"])
    return ev.select(F.col("user_id").alias("item"), F.col("rn").alias("k"),
                     F.col("event_type").alias("label"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (vector, point): (vec_id, pt, x, y)."""
    em = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = em.select("vec_id", "embedding",
                  F.explode(F.sequence(F.lit(0), (F.size("embedding") / 2 - 1).cast("int"))).alias("pt"))
    return p.select("vec_id", F.col("pt").cast("long").alias("pt"),
                    F.element_at("embedding", 2 * F.col("pt") + 1).cast("double").alias("x"),
                    F.element_at("embedding", 2 * F.col("pt") + 2).cast("double").alias("y"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial per order: series = priority, scheme = status, working set = month % 4 + 1."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("trial_id"),
                    F.col("o_orderpriority").alias("series"),
                    F.col("o_orderstatus").alias("scheme"),
                    (F.month("o_orderdate") % 4 + 1).cast("long").alias("working_set"),
                    F.col("o_totalprice").alias("runtime"),
                    (F.col("o_custkey") % 97).alias("spilled"),
                    (F.col("o_custkey") % 13).alias("migrations"),
                    (F.col("o_orderkey") % 29).alias("remote_migrations"))
