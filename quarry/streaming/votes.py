"""Sequential majority vote on a stream, with early stopping.

Per item the state holds its votes so far, at most 11 (position -> label), until they decide: the
winner is emitted on that vote, the votes are cleared and one flag stays, which drops later votes.
Votes may arrive in any order; only an unbroken run from the first is judged while more can come.
An item that falls silent undecided is judged with the votes it has once the watermark passes its
latest vote by ``patience``. The rule is that of :mod:`quarry.operators.voting`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from quarry.operators.voting import INITIAL, MAX_RUN
from quarry.session import scratch_path
from quarry.streaming.files import drain, heartbeat, keyed, read_staged, sized_stores, stage
from quarry.streaming.timers import DELAY, PatientProcessor, latest_ms

IN_SCHEMA = "item long, k long, label string, ts timestamp"
OUT = "item long, models_run long, winner string, stopped_early boolean"


def judge(votes: dict[int, str], final: bool) -> tuple[int, str | None, bool] | None:
    """(models run, winner, stopped early) once the votes (position -> label) decide or are all there
    are; None while more are needed."""
    tally: dict = {}
    late = None
    for n, k in enumerate(sorted(votes), 1):
        if k != n and not final:
            return None
        label = votes[k]
        tally[label] = tally.get(label, 0) + 1
        if k <= INITIAL and tally[label] >= 2 and (final or len(votes) >= INITIAL and INITIAL in votes and 1 in votes and 2 in votes):
            return min(INITIAL, len(votes)), label, True
        if k > INITIAL and tally[label] >= k // 2 + 1:
            late = (k, label, False)
            break
    if late or final or len(votes) == MAX_RUN:
        return late or (len(votes), None, False)
    return None


class Voting(PatientProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.decided = handle.getValueState("decided", "yes boolean")
        self.votes = handle.getMapState("votes", "k long", "label string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        decided, votes, new, latest = self.decided.exists(), None, {}, None
        for pdf in rows:
            pdf = pdf[pdf["k"].notna()]  # a heartbeat has no position
            if decided or not len(pdf):
                continue
            if votes is None:
                votes = {k[0]: v[0] for k, v in self.votes.iterator()}
            latest = max(latest or 0, latest_ms(pdf["ts"]))
            for k, label in zip(pdf["k"].astype("int64"), pdf["label"]):
                if k <= MAX_RUN and k not in votes:
                    votes[k] = new[k] = None if pd.isna(label) else label
        if not votes:
            return
        found = judge(votes, False)
        if found:
            yield self._close(key, found)
            return
        for k, label in new.items():
            self.votes.updateValue((k,), (label,))
        self.wait_from(latest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        yield self._close(key, judge({k[0]: v[0] for k, v in self.votes.iterator()}, True))

    def _close(self, key, found: tuple[int, str | None, bool]) -> pd.DataFrame:
        self.stop_waiting()
        self.votes.clear()
        self.decided.update((True,))
        run, winner, early = found
        return pd.DataFrame({"item": [key[0]], "models_run": [run], "winner": pd.Series([winner], dtype=object), "stopped_early": [early]})


def process(spark, src: str, out: str, ck: str, patience_ms: int) -> None:
    """Judge the votes in ``src`` that checkpoint ``ck`` has not seen; results go to ``out``."""
    res = keyed(read_staged(spark, src, IN_SCHEMA).withWatermark("ts", DELAY), "item", Voting(patience_ms), OUT, "eventTime")
    drain(res, ck, out)


def run_stream(votes: DataFrame, patience_ms: int = 30 * 86_400_000) -> DataFrame:
    """Stage the votes (item, k, label, ts) by time, stream them, then move the watermark past the
    last patience, as a source that closes does, and return the results."""
    spark = votes.sparkSession
    out, ck = (scratch_path(spark, n) for n in ("vote-out", "vote-ckpt"))
    votes = votes.select("item", "k", "label", F.col("ts").cast("timestamp").alias("ts"))
    src = stage(votes, ["ts", "item"])
    with sized_stores(spark, src):
        process(spark, src, out, ck, patience_ms)
        close(spark, src, votes, patience_ms)
        process(spark, src, out, ck, patience_ms)
    return spark.read.schema(OUT).parquet(out)


def close(spark, src: str, rows: DataFrame, patience_ms: int, ts: str = "ts") -> None:
    """Append a heartbeat behind the latest time in ``src`` plus the patience and the delay."""
    last = spark.read.schema(rows.schema).parquet(src).agg(
        (F.max(ts) + F.expr(f"make_dt_interval(0, 0, 0, {patience_ms // 1000 + 2})")).alias("at")).first()["at"]
    if last is not None:
        stage(heartbeat(spark, rows.schema, ts, last), [ts], src)
