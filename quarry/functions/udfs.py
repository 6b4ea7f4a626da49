"""The Python seams, for models that no built-in expression can express.

* ``map_with_init``: a one-off initialisation per task (load a model, open a decoder),
  then Arrow-batched scoring of every batch of that task (``mapInPandas``).
* ``tolerant_udf``: a vectorised UDF whose failures become nulls instead of failing the
  job; a failing batch is halved until the bad rows stand alone, and only they are null.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_with_init(df: DataFrame, init: Callable[[], object],
                  score: Callable[[object, pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    def run(batches):
        state = init()
        for pdf in batches:
            yield score(state, pdf)
    return df.mapInPandas(run, schema)


def tolerant_udf(fn: Callable[[pd.Series], pd.Series], return_type):
    def attempt(s: pd.Series) -> list:
        try:
            return list(fn(s))
        except Exception:  # noqa: BLE001 - a failing row must not fail the batch
            if len(s) == 1:
                return [None]
            half = len(s) // 2
            return attempt(s.iloc[:half]) + attempt(s.iloc[half:])

    @F.pandas_udf(return_type)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(attempt(s) if len(s) else [], dtype=object)
    return run
