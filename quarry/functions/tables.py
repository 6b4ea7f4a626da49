"""Table functions: any number of output rows for the rows of a partition."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RisingRuns:
    """Runs of rising values in the order of a partition's rows: one row per run, as soon as the next
    one begins. The state is one run, whatever the partition's size. A null value ends a run and is in
    none."""

    def __init__(self):
        self.run: list | None = None

    def eval(self, row) -> Iterator[tuple]:
        video, segment, frame, value = row["video"], row["segment"], row["frame"], row["value"]
        if self.run and value is not None and value > self.run[5]:
            self.run[3] += 1
            self.run[5] = value
            return
        yield from self.terminate()
        if value is not None:
            self.run = [video, segment, frame, 1, value, value]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            video, segment, first, n, low, high = self.run
            yield video, segment, first, n, low, high
        self.run = None


def rising_runs(tf: DataFrame, value: str = "dx", period: int = 200) -> DataFrame:
    """video, segment, first_frame, n_frames, low, high of the rising runs in segments of ``period``
    frames: a table function called once per (video, segment), so a long video spreads over tasks."""
    segment = F.floor(F.greatest(F.col("frame") - 1, F.lit(0)) / F.lit(period)).cast("long")
    rows = tf.select("video", segment.alias("segment"), "frame", F.col(value).cast("double").alias("value"))
    call = F.udtf(RisingRuns, returnType="video bigint, segment bigint, first_frame bigint, n_frames bigint, low double, high double")
    return call(rows.asTable().partitionBy("video", "segment").orderBy("frame"))
