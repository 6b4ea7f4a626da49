"""The same aggregation done batch by batch on a file stream (``availableNow`` trigger), with
``foreachBatch`` writing per-batch partials; summing the partials gives the one-shot batch
result. Files hold a bounded number of rows and a trigger a bounded number of files, so batches
are of one size whatever the table's. A batch that runs again replaces its own partials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import stable_round
from quarry.session import scratch_path
from quarry.streaming.files import drain, read_staged, stage


def batched_totals(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    part, ck = (scratch_path(spark, n) for n in ("batches-part", "batches-ckpt"))
    ev = events.select("event_id", "event_type", "value")

    def per_batch(df: DataFrame, epoch: int) -> None:
        (df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
           .write.mode("overwrite").parquet(f"{part}/epoch={epoch}"))

    drain(read_staged(spark, stage(ev, ["event_id"]), ev.schema), ck, each_batch=per_batch)
    p = spark.read.schema("event_type string, n long, total double, epoch long").parquet(part)
    return p.groupBy("event_type").agg(F.sum("n").alias("n_events"), stable_round(F.sum("total"), 6).alias("total"))
