"""Scoring with a model that is made once a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.udfs import map_with_init

MAX_CENTROIDS = 10_000


def centroids(vectors: DataFrame) -> DataFrame:
    """label, i, x: the mean vector of every label (null is none), one partial aggregate."""
    e = vectors.filter(F.col("label").isNotNull()).select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return e.groupBy("label", "i").agg(F.avg("x").alias("x"))


def nearest_centroid(vectors: DataFrame, model: DataFrame, made=None) -> DataFrame:
    """vec_id, label and the label of the nearest centroid (ties to the smaller label) with its squared
    distance. The model, at most ``MAX_CENTROIDS`` labels (checked), goes to the tasks; each makes its
    matrix once and scores batches of vectors with it. ``made`` (an accumulator) counts the makings."""
    per = model.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    rows = per.orderBy("label").limit(MAX_CENTROIDS + 1).collect()  # bounded
    if len(rows) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} labels")
    labels, points = [r["label"] for r in rows], [r["c"] for r in rows]

    def init() -> tuple[np.ndarray, np.ndarray]:
        if made is not None:
            made.add(1)
        return np.array(labels), np.array(points)

    def score(state: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, c = state
        if not len(pdf):
            return pd.DataFrame(columns=["vec_id", "label", "nearest", "distance"])
        x = np.stack(pdf["embedding"].to_numpy()).astype(float)
        d = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]) if len(c) else np.empty((len(x), 0))
        best = d.argmin(1)
        exact = ((x - c[best]) ** 2).sum(1)
        return pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "nearest": names[best], "distance": exact})

    whole = vectors.filter(F.col("embedding").isNotNull()).select("vec_id", "label", "embedding")
    if not rows:
        return whole.select("vec_id", "label", F.lit(None).cast("int").alias("nearest"), F.lit(None).cast("double").alias("distance"))
    kind = vectors.schema["label"].dataType.simpleString()
    return map_with_init(whole, init, score, f"vec_id long, label {kind}, nearest {kind}, distance double")
