"""Plug-in seam for a user's batch scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def apply_scorer(
    df: DataFrame,
    load: Callable[[], Callable[[np.ndarray], np.ndarray]],
    labels: Sequence[str],
    *,
    vector: str = "embedding",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Score batches of vectors with a user model: ``load()`` runs once per task and returns a
    function from (rows, width) to (rows, len(labels)). Another shape is an error."""
    width = len(labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            scores = np.asarray(model(np.stack(batch[vector].to_numpy()).astype(np.float64)), dtype=np.float64)
            if scores.shape != (len(batch), width):
                raise ValueError(f"scorer returned shape {scores.shape}, expected ({len(batch)}, {width})")
            out = batch[list(keep)].copy()
            out["scores"] = list(scores)
            yield out

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "scores array<double>"])
    return df.select(*keep, vector).mapInPandas(run, schema)


def linear_head(vector: Column, weights: Sequence[float], bias: float) -> Column:
    """Sigmoid of a dot product as a built-in expression, for heads small enough to inline."""
    products = F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.exp(-(total + F.lit(float(bias)))))
