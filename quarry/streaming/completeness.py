"""End of a video's stream, and of the job.

A video ends when its end marker has come and no frame below it is missing. One that falls silent
before (a frame lost, or no marker at all) is closed as incomplete once the watermark passes its
latest delivery by ``patience``, instead of waiting for ever. Repeated deliveries count once, and
what comes after the end is ignored. The job is done when every expected video has ended.

Per video the state holds counters, and the frames that arrived early as ranges, until the gap before
them closes. A stream deals its videos into buckets, and a call takes a bucket's new rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from quarry.session import scratch_path
from quarry.streaming.files import bucketed, by_key, drain, lots, read_staged, sized_stores, stage
from quarry.streaming.timers import DELAY, PatientProcessor, latest_ms
from quarry.streaming.votes import close

IN_SCHEMA = "video long, frame long, is_end boolean, ts timestamp"
OUT = "video long, expected long, delivered long, n_missing long, complete boolean, ended_by string"


class Video:
    """One video's deliveries while a call runs: next frame, latest frame, frame count once known (else
    -1), when it is closed, and the early frames as disjoint ranges [start, stop) in order."""

    def __init__(self, next_: int = 0, last: int = -1, end: int = -1, due: int | None = None, starts=(), stops=()):
        self.next, self.last, self.end, self.due = next_, last, end, due
        self.starts, self.stops = np.array(starts, np.int64), np.array(stops, np.int64)

    def take(self, frames: np.ndarray, is_end: np.ndarray) -> None:
        """Frames in order, with end markers among them."""
        if is_end.any() and self.end < 0:
            self.end = int(frames[is_end][0])
        f = frames[~is_end]
        f = f[(f >= self.next) & ((f < self.end) if self.end >= 0 else True)]
        if not len(f):
            return
        self.last = max(self.last, int(f[-1]))
        cut = np.flatnonzero(np.diff(f) > 1) + 1
        starts, stops = np.concatenate([self.starts, f[np.r_[0, cut]]]), np.concatenate([self.stops, f[np.r_[cut - 1, len(f) - 1]] + 1])
        at = np.argsort(starts, kind="stable")
        starts, reach = starts[at], np.maximum.accumulate(stops[at])
        first = np.r_[True, starts[1:] > reach[:-1]]
        self.starts, self.stops = starts[first], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(reach) - 1]]
        if self.starts[0] <= self.next:
            self.next, self.starts, self.stops = int(self.stops[0]), self.starts[1:], self.stops[1:]

    @property
    def whole(self) -> bool:
        return 0 <= self.end <= self.next

    def row(self) -> tuple:
        """The result, whole or as it is when the patience is over."""
        if self.whole:
            return self.end, self.next, 0, True, "marker"
        starts, stops = self.starts, self.stops
        if self.end >= 0:  # early frames beyond the marker are none of the video's
            starts, stops = np.minimum(starts, self.end), np.minimum(stops, self.end)
        delivered = self.next + int((stops - starts).sum())
        expected = self.end if self.end >= 0 else None
        return expected, delivered, (self.end if self.end >= 0 else self.last + 1) - delivered, False, "timer"

    def state(self) -> tuple:
        return self.next, self.last, self.end, self.due, self.starts.tolist(), self.stops.tolist()


class Ending(PatientProcessor):
    """All videos of a bucket in one call. What its open videos hold is one list, read and written once
    a call; one timer stands at the earliest time that one of them is closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "video long, next long, last long, end_n long, due long, starts array<long>, stops array<long>")
        self.ended = handle.getMapState("ended", "video long", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        videos = {r[0]: Video(*r[1:]) for r in self.open.get()}
        over, changed = set(), False
        for pdf in lots(rows):
            pdf = pdf[pdf["frame"].notna()].reset_index(drop=True)  # a heartbeat has no frame
            frames, is_end, ts, out = pdf["frame"].to_numpy(np.int64), pdf["is_end"].to_numpy(bool), pdf["ts"], []
            for video, at in by_key(pdf, "video", "frame"):
                if video in over:
                    continue
                if video not in videos:
                    if self.ended.containsKey((video,)):
                        over.add(video)
                        continue
                    videos[video] = Video()
                x, changed = videos[video], True
                x.take(frames[at], is_end[at])
                x.due = max(x.due or 0, latest_ms(ts.iloc[at]) + self.patience_ms)
                if x.whole:
                    out.append((video, *x.row()))
                    self._close(videos, video)
                    over.add(video)
            if out:
                yield self._rows(out)
        if changed:
            self._save(videos)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        videos = {r[0]: Video(*r[1:]) for r in self.open.get()}
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        out = [(video, *x.row()) for video, x in videos.items() if x.due <= now]
        for video, *_ in out:
            self._close(videos, video)
        self._save(videos)
        if out:
            yield self._rows(out)

    def _close(self, videos: dict, video) -> None:
        del videos[video]
        self.ended.updateValue((video,), (True,))

    def _save(self, videos: dict) -> None:
        if videos:
            self.open.put([(video, *x.state()) for video, x in videos.items()])
            self.wait_until(min(x.due for x in videos.values()))
        else:
            self.open.clear()
            self.stop_waiting()

    @staticmethod
    def _rows(out: list) -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["video", "expected", "delivered", "n_missing", "complete", "ended_by"], dtype=object)
        return rows.astype({"video": "Int64", "expected": "Int64", "delivered": "int64", "n_missing": "int64", "complete": bool})


def process(spark, src: str, out: str, ck: str, patience_ms: int) -> None:
    res = bucketed(read_staged(spark, src, IN_SCHEMA).withWatermark("ts", DELAY), "video", Ending(patience_ms), OUT, "eventTime")
    drain(res, ck, out)


def run_stream(deliveries: DataFrame, patience_ms: int = 30 * 86_400_000) -> DataFrame:
    """Stage the deliveries (video, frame, is_end, ts) by time, stream them, let the source close,
    and return one row per video."""
    spark = deliveries.sparkSession
    out, ck = (scratch_path(spark, n) for n in ("ending-out", "ending-ckpt"))
    deliveries = deliveries.select("video", "frame", "is_end", F.col("ts").cast("timestamp").alias("ts"))
    src = stage(deliveries, ["ts", "video", "frame"])
    with sized_stores(spark, src):
        process(spark, src, out, ck, patience_ms)
        close(spark, src, deliveries, patience_ms)
        process(spark, src, out, ck, patience_ms)
    return spark.read.schema(OUT).parquet(out)


def job_done(expected: DataFrame, ended: DataFrame) -> DataFrame:
    """One row over the expected videos (video): n_videos, n_ended, n_complete, and ``done``: all have
    ended. Videos of which nothing ever arrived have not."""
    videos = expected.select("video").distinct()
    e = ended.select(F.col("video").alias("_v"), "complete")
    return videos.join(e, videos["video"].eqNullSafe(e["_v"]), "left").agg(
        F.count(F.lit(1)).alias("n_videos"), F.count("complete").alias("n_ended"), F.count_if("complete").alias("n_complete"),
        F.coalesce(F.every(F.col("complete").isNotNull()), F.lit(True)).alias("done"))


def lossy_deliveries(tf: DataFrame) -> DataFrame:
    """Deliveries of transforms (video, frame, ts): frames with frame % 41 = 7 of videos with
    video % 4 = 1 are lost, those with frame % 7 = 3 come twice, and only videos with video % 3 <> 0
    send an end marker."""
    copies = F.when((F.col("video") % 4 == 1) & (F.col("frame") % 41 == 7), F.array().cast("array<int>")) \
        .when(F.col("frame") % 7 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = tf.withColumn("copy", F.explode(copies)).select("video", "frame", F.lit(False).alias("is_end"), "ts")
    ends = tf.groupBy("video").agg(F.count(F.lit(1)).alias("frame"), F.max("ts").alias("ts")).filter(F.col("video") % 3 != 0)
    return rows.unionByName(ends.select("video", "frame", F.lit(True).alias("is_end"), "ts"))
