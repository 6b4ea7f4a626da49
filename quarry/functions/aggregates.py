"""Aggregates of one's own: a state of fixed size with partial, merge and finish steps.

Every task turns its rows into one state per key it meets, batch by batch; states are merged in a
tree (per key and salt, then per key), so a key that holds a third of the rows is merged from a
bounded number of states. Only keys and states are shuffled. The steps run on Arrow batches as
pandas frames; a state is an array of doubles, so merging is one vectorised call per key.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Keys a task holds before it sends their states on; states of a key that meet in a first merge.
HELD_KEYS, SALTS = 50_000, 32


class Aggregate(ABC):
    """``size`` numbers of state and the SQL schema of the result columns."""

    size: int
    result: str

    @abstractmethod
    def partial(self, values: np.ndarray) -> np.ndarray:
        """The state of some non-null values (at least one)."""

    @abstractmethod
    def merge(self, states: np.ndarray) -> np.ndarray:
        """One state from several (rows); any order and grouping gives the same."""

    @abstractmethod
    def finish(self, state: np.ndarray) -> tuple:
        """The result columns."""


class Moments(Aggregate):
    """Count, mean, population variance and skewness by merging central moments."""

    size, result = 4, "n long, mean double, variance double, skewness double"

    def partial(self, values: np.ndarray) -> np.ndarray:
        d = values - values.mean()
        return np.array([len(values), values.mean(), (d ** 2).sum(), (d ** 3).sum()])

    def merge(self, states: np.ndarray) -> np.ndarray:
        n, mean, m2, m3 = states.T
        whole = (n * mean).sum() / n.sum()
        d = mean - whole
        return np.array([n.sum(), whole, (m2 + n * d ** 2).sum(), (m3 + 3 * d * m2 + n * d ** 3).sum()])

    def finish(self, state: np.ndarray) -> tuple:
        n, mean, m2, m3 = state.tolist()
        return int(n), mean, m2 / n, (m3 / n) / (m2 / n) ** 1.5 if m2 > 0 else None


class Histogram(Aggregate):
    """Counts in equal bins of [low, high) (values outside go to the end bins), and the fullest bin."""

    result = "n long, bins array<long>, fullest long"

    def __init__(self, low: float, high: float, bins: int):
        self.low, self.high, self.size = low, high, bins

    def partial(self, values: np.ndarray) -> np.ndarray:
        at = np.floor((values - self.low) * (self.size / (self.high - self.low)))
        return np.bincount(np.clip(at, 0, self.size - 1).astype(int), minlength=self.size).astype(float)

    def merge(self, states: np.ndarray) -> np.ndarray:
        return states.sum(0)

    def finish(self, state: np.ndarray) -> tuple:
        return int(state.sum()), state.astype(int).tolist(), int(state.argmax())


def aggregate(df: DataFrame, keys: list[str], value: str, agg: Aggregate) -> DataFrame:
    """``agg`` of the non-null values per key (null keys are a key)."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    key_fields = [StructField(f"_k{i}", rows.schema[k].dataType) for i, k in enumerate(keys)]
    state = StructType([*key_fields, StructField("_state", ArrayType(DoubleType()))])
    names = [f.name for f in key_fields]
    rows = rows.toDF(*names, "_value")

    def frames(states: dict) -> Iterator[pd.DataFrame]:
        """Nothing for no states: an empty column of lists has no type that Arrow could take."""
        if states:
            out = pd.DataFrame(list(states), columns=names, dtype=object)
            out["_state"] = [s.tolist() for s in states.values()]
            yield out

    def put(states: dict, key, new: np.ndarray) -> None:
        key = tuple(None if pd.isna(x) else x for x in (key if isinstance(key, tuple) else (key,)))
        old = states.get(key)
        states[key] = new if old is None else agg.merge(np.stack([old, new]))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for b in batches:
            for key, x in b.groupby(names, dropna=False, sort=False)["_value"]:
                put(states, key, agg.partial(x.to_numpy()))
            if len(states) >= HELD_KEYS:
                yield from frames(states)
                states = {}
        yield from frames(states)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by key: a key is complete when the next one begins."""
        states: dict = {}
        for b in batches:
            for key, x in b.groupby(names, dropna=False, sort=False)["_state"]:
                put(states, key, agg.merge(np.stack(x.to_numpy())))
            if len(states) > 1:
                last = list(states)[-1]
                held = {last: states.pop(last)}
                yield from frames(states)
                states = held
        yield from frames(states)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split(" ", 1)[0] for c in agg.result.split(", ")]
        for b in merge(batches):
            done = pd.DataFrame([agg.finish(np.array(s)) for s in b["_state"]], columns=columns)
            yield pd.concat([b[names].reset_index(drop=True), done], axis=1)

    part = rows.mapInPandas(partial, state).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    some = part.repartition(*names, "_salt").sortWithinPartitions(*names).drop("_salt").mapInPandas(merge, state)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields)
    out = some.repartition(*names).sortWithinPartitions(*names).mapInPandas(finish, f"{kinds}, {agg.result}")
    return out.withColumnsRenamed(dict(zip(names, keys)))
