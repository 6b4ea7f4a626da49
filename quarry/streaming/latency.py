"""Delivery latency on a stream: arrivals joined with the static times at which their videos start.

Frame i of a video is due at its start plus i / fps. Every arrival is written with its lateness and
with ``behind``: it came after the watermark (the latest time of earlier batches less a delay) had
passed it. Such rows are marked and counted, not dropped. A batch is written to a folder of its own
number, its latest time and counts to a ledger beside it, so a batch that runs again replaces what
it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import epoch_micros, stable_round
from quarry.session import scratch_path
from quarry.streaming.files import drain, read_staged, stage

IN_SCHEMA = "video long, frame long, ts timestamp_ntz"
LEDGER = "batch long, latest_us long, n_rows long, n_behind long, n_unmatched long"


def starts(tf: DataFrame) -> DataFrame:
    """video and start_us, the time of its first frame."""
    return tf.groupBy("video").agg(F.min("ts").alias("ts")).select("video", epoch_micros("ts").alias("start_us"))


def process(spark, src: str, starts: DataFrame, out: str, ck: str, fps: int, delay_ms: int = 0) -> None:
    """Join the arrivals that ``ck`` has not seen; rows go to ``out``/rows, counts to ``out``/ledger."""

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        path = own._jvm.org.apache.hadoop.fs.Path(f"{out}/ledger")
        known = path.getFileSystem(own._jsc.hadoopConfiguration()).exists(path)
        mark = own.read.schema(LEDGER).parquet(f"{out}/ledger").filter(F.col("batch") < number).agg(F.max("latest_us")).first()[0] \
            if known else None  # one number: the latest time of the batches before this one
        at = epoch_micros("ts")
        s = starts.select(F.col("video").alias("_video"), "start_us")
        due = F.col("start_us") + F.floor(F.col("frame") * F.lit(1_000_000) / F.lit(fps)).cast("long")
        behind = F.lit(False) if mark is None else at < F.lit(mark - 1000 * delay_ms)
        batch.join(s, batch["video"].eqNullSafe(s["_video"]), "left").select(
            "video", "frame", at.alias("at_us"), due.alias("due_us"), stable_round((at - due) / F.lit(1e6), 6).alias("lateness_s"),
            F.coalesce(behind, F.lit(False)).alias("behind")).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        own.read.parquet(f"{out}/rows/batch={number}").agg(
            F.lit(number).cast("long").alias("batch"), F.max("at_us").alias("latest_us"), F.count(F.lit(1)).alias("n_rows"),
            F.count_if("behind").alias("n_behind"), F.count_if(F.col("due_us").isNull()).alias("n_unmatched")) \
            .write.mode("overwrite").parquet(f"{out}/ledger/number={number}")

    drain(read_staged(spark, src, IN_SCHEMA), ck, each_batch=write)


def run_stream(tf: DataFrame, fps: int) -> tuple[DataFrame, DataFrame]:
    """(arrivals with their lateness, the ledger) of transforms (video, frame, ts) staged by time."""
    spark = tf.sparkSession
    out, ck = (scratch_path(spark, n) for n in ("latency-out", "latency-ckpt"))
    due = starts(tf).checkpoint()
    process(spark, stage(tf.select("video", "frame", "ts"), ["ts", "video", "frame"]), due, out, ck, fps)
    return spark.read.parquet(f"{out}/rows").drop("batch"), spark.read.schema(LEDGER).parquet(f"{out}/ledger").drop("number")
