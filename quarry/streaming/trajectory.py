"""Keyed, stateful trajectory smoothing on a stream.

Per video a value (next expected frame, emitted frames, frame count once known, running sums, first
trajectory value), a list (trajectory and transform of the last frames that later windows need, at
most 2r + 1) and a map (frames that arrived early). A stream deals its videos into buckets, and a call
takes a bucket's new rows (``Smoothers``): what its running videos hold is one list, read and written
once a call, and what grows (early frames, ended videos) is in maps, of which a call touches
what it needs. Repeated frames (replays after a restart) are ignored;
early frames wait until the gap closes. Frame f is emitted once frame f + r has arrived, or when
the video's end marker says no more frames follow (then the last value is replicated). Afterwards
only the value stays, so replays after the end are ignored too, as are frames beyond the end.
Rows that wait for a missing frame are never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.session import scratch_path
from quarry.streaming.files import bucketed, by_key, drain, lots, read_staged, sized_stores, stage

IN_SCHEMA = "video long, frame long, dx double, dy double, da double, is_end boolean"
SMOOTH_OUT = "video long, frame long, smooth_dx double, smooth_dy double, smooth_da double"
RUNNING_OUT = "video long, frame long, cum_dx double, cum_dy double, cum_da double"


def rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals, nudged and half away from zero like the batch operators."""
    y = (x + 1e-9) * 1e6
    return np.sign(y) * np.floor(np.abs(y) + 0.5) / 1e6


class Trajectory:
    """One video's frames while a call runs."""

    def __init__(self, radius: int, smooth: bool, at: tuple | None, hist: list):
        self.radius, self.smooth = radius, smooth
        self.next, self.emitted, self.end, self.early, cum, first = at or (0, 0, -1, 0, [0.0] * 3, None)
        self.cum, self.first = np.array(cum, float), None if first is None else np.array(first, float)
        self.t = np.array([t for t, _ in hist], float).reshape(-1, 3)
        self.v = np.array([v for _, v in hist], float).reshape(-1, 3)

    def take(self, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Consume the transforms of the next frames; yields (frames, values) that can be emitted."""
        t = np.cumsum(np.concatenate([self.cum[None], v]), axis=0)[1:]
        self.cum = t[-1]
        self.first = t[0] if self.first is None else self.first
        self.next += len(v)
        if not self.smooth:
            self.emitted = self.next
            yield np.arange(self.next - len(v), self.next), rounded(t)
            return
        self.t, self.v = np.concatenate([self.t, t]), np.concatenate([self.v, v])
        if self.emitted + self.radius < self.next:
            yield self._smoothed(self.next - self.radius, 0)
        keep = max(self.emitted - self.radius, 0) - (self.next - len(self.t))
        self.t, self.v = self.t[keep:], self.v[keep:]

    def finish(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The frames still held back, with the last value replicated."""
        if self.smooth and self.emitted < self.next:
            yield self._smoothed(self.next, self.radius)
        self.t = self.v = np.empty((0, 3))
        self.first = None

    def _smoothed(self, until: int, tail: int) -> tuple[np.ndarray, np.ndarray]:
        """Frames emitted..until - 1; ``tail`` copies of the last value follow the held frames."""
        r, base = self.radius, self.next - len(self.t)
        frames = np.arange(self.emitted, until)
        lead = max(r - self.emitted, 0)  # copies of the first value before frame 0
        wide = np.concatenate([np.repeat(self.first[None], lead, 0), self.t, np.repeat(self.t[-1:], tail, 0)])
        start = self.emitted - r + lead - base
        mean = np.lib.stride_tricks.sliding_window_view(wide[start: start + len(frames) + 2 * r], 2 * r + 1, axis=0).sum(-1) / (2 * r + 1)
        at = frames - base
        self.emitted = until
        return frames, rounded(mean - self.t[at] + self.v[at])


class Smoother(StatefulProcessor):
    def __init__(self, radius: int, mode: str):
        self.radius, self.smooth = radius, mode == "smooth"
        self.names = [c.split()[0] for c in (SMOOTH_OUT if self.smooth else RUNNING_OUT).split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, emitted long, end_n long, early long, cum array<double>, first array<double>")
        self.hist = handle.getListState("hist", "t array<double>, v array<double>")
        self.early = handle.getMapState("early", "frame long", "v array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.at.exists()
        tr = Trajectory(self.radius, self.smooth, self.at.get() if known else None, list(self.hist.get()) if known else [])
        finished = 0 <= tr.end <= tr.next
        for pdf in rows:
            if finished:
                continue
            for frames, values in self._arrived(tr, *_arrays(pdf)):
                yield self._rows(key, frames, values)
        if not finished:
            if 0 <= tr.end <= tr.next:
                for frames, values in tr.finish():
                    yield self._rows(key, frames, values)
                self.early.clear()
                tr.early = 0
            if len(tr.t):
                self.hist.put(list(zip(tr.t.tolist(), tr.v.tolist())))
            else:
                self.hist.clear()
            self.at.update((tr.next, tr.emitted, tr.end, tr.early, tr.cum.tolist(), None if tr.first is None else tr.first.tolist()))

    def _arrived(self, tr: Trajectory, frames: np.ndarray, v: np.ndarray, is_end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if is_end.any() and tr.end < 0:
            tr.end = int(frames[is_end][0])
        frames, first = np.unique(frames[~is_end], return_index=True)
        v = v[~is_end][first]
        ok = (frames >= tr.next) & ((frames < tr.end) if tr.end >= 0 else True)
        frames, v = frames[ok], v[ok]
        while True:
            n = int(np.argmin(np.append(frames == tr.next + np.arange(len(frames)), False)))
            if n:
                yield from tr.take(v[:n])
                frames, v = frames[n:], v[n:]
            if not tr.early or not self.early.containsKey((tr.next,)) or 0 <= tr.end <= tr.next:
                break
            waited = np.array([self.early.getValue((tr.next,))[0]], float)
            self.early.removeKey((tr.next,))
            tr.early -= 1
            yield from tr.take(waited)
            past = int(np.searchsorted(frames, tr.next))
            frames, v = frames[past:], v[past:]
        for f, x in zip(frames.tolist(), v.tolist()):
            if not tr.early or not self.early.containsKey((f,)):
                self.early.updateValue((f,), (x,))
                tr.early += 1

    def _rows(self, key, frames: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(self.names, (np.full(len(frames), key[0]), frames, *values.T))))

    def close(self) -> None:
        pass


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pdf["frame"].to_numpy(np.int64), pdf[["dx", "dy", "da"]].to_numpy(float), pdf["is_end"].to_numpy(bool)


class Early:
    """A video's early frames while a call runs: those of the state, and those of the call."""

    def __init__(self, state, video, stored: int):
        self.state, self.video, self.stored, self.new = state, video, stored, {}

    def containsKey(self, key: tuple) -> bool:
        return key[0] in self.new or (self.stored > 0 and self.state.containsKey((self.video, *key)))

    def getValue(self, key: tuple) -> tuple:
        return self.new[key[0]] if key[0] in self.new else self.state.getValue((self.video, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.new[key[0]] = value

    def removeKey(self, key: tuple) -> None:
        if self.new.pop(key[0], None) is None:
            self.state.removeKey((self.video, *key))
            self.stored -= 1

    def save(self, ended: bool) -> int:
        """Write what waits, or clear all; the number of frames in the state."""
        if ended:
            for k in [k for k in self.state.keys() if k[0] == self.video] if self.stored else ():
                self.state.removeKey(k)
            return 0
        for f, x in self.new.items():
            self.state.updateValue((self.video, f), x)
        return self.stored + len(self.new)


class Smoothers(Smoother):
    """All videos of a bucket in one call."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "video long, next long, emitted long, end_n long, early long, cum array<double>, "
                                                "first array<double>, hist binary")  # hist: trajectories, then transforms
        self.waiting = handle.getMapState("early", "video long, frame long", "v array<double>")
        self.ended = handle.getMapState("ended", "video long", "end_n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {r[0]: r[1:] for r in self.held.get()}
        running: dict = {}  # what the call has opened; None: ended before
        for pdf in lots(rows):
            frames, v, is_end = _arrays(pdf)
            out = []
            for video, at in by_key(pdf, "video", "frame"):
                if video not in running:
                    running[video] = None if video not in held and self.ended.containsKey((video,)) else self._open(video, held.get(video))
                if running[video] is None:
                    continue
                tr, self.early = running[video]
                out += [(video, *x) for x in self._arrived(tr, frames[at], v[at], is_end[at])]
                if 0 <= tr.end <= tr.next:
                    out += [(video, *x) for x in tr.finish()]
                    self.early.save(True)
                    self.ended.updateValue((video,), (tr.end,))
                    running[video] = None
                    held.pop(video, None)
            if out:
                yield self._all_rows(out)
        for video, x in running.items():
            if x is not None:
                tr, early = x
                tr.early = early.save(False)
                held[video] = (tr.next, tr.emitted, tr.end, tr.early, tr.cum.tolist(), None if tr.first is None else tr.first.tolist(),
                               np.concatenate([tr.t, tr.v]).tobytes())
        if held:
            self.held.put([(video, *x) for video, x in held.items()])
        else:
            self.held.clear()

    def _open(self, video, row: tuple | None) -> tuple[Trajectory, Early]:
        if row is None:
            return Trajectory(self.radius, self.smooth, None, []), Early(self.waiting, video, 0)
        tr = Trajectory(self.radius, self.smooth, row[:6], [])
        tr.t, tr.v = np.frombuffer(bytes(row[6])).reshape(2, -1, 3)
        return tr, Early(self.waiting, video, tr.early)

    def _all_rows(self, out: list) -> pd.DataFrame:
        sizes = [len(f) for _, f, _ in out]
        videos = pd.array([x[0] for x in out], dtype="Int64").repeat(sizes)
        return pd.DataFrame(dict(zip(self.names, (videos, np.concatenate([x[1] for x in out]), *np.concatenate([x[2] for x in out]).T))))


def stream_input(tf: DataFrame) -> DataFrame:
    """Transforms plus one end marker per video (frame = frame count)."""
    rows = tf.select("video", "frame", "dx", "dy", "da", F.lit(False).alias("is_end"))
    nothing = [F.lit(0.0).alias(c) for c in ("dx", "dy", "da")]
    ends = tf.groupBy("video").agg(F.count(F.lit(1)).alias("frame")).select("video", "frame", *nothing, F.lit(True).alias("is_end"))
    return rows.unionByName(ends)


def process(spark, src: str, out: str, ck: str, radius: int, mode: str = "smooth") -> None:
    """Process everything in ``src`` not yet seen by checkpoint ``ck`` and stop; state and
    progress live in ``ck``, so a later call resumes where this one ended."""
    res = bucketed(read_staged(spark, src, IN_SCHEMA), "video", Smoothers(radius, mode),
                   SMOOTH_OUT if mode == "smooth" else RUNNING_OUT, "none")
    drain(res, ck, out)


def run_stream(tf: DataFrame, radius: int, mode: str = "smooth") -> DataFrame:
    """Stage the transforms in frame order, stream them through the keyed state, and return what
    the sink received."""
    spark = tf.sparkSession
    out, ck = (scratch_path(spark, n) for n in ("stream-out", "stream-ckpt"))
    src = stage(stream_input(tf), ["frame", "video"])
    with sized_stores(spark, src):
        process(spark, src, out, ck, radius, mode)
    return spark.read.schema(SMOOTH_OUT if mode == "smooth" else RUNNING_OUT).parquet(out)
