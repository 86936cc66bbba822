"""Predictions on a stream: a fitted model applied to rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame


def predict_stream(model, stream: DataFrame, n_sim: int = 0, name: str = "prediction") -> DataFrame:
    """The streaming DataFrame with the model's prediction; no state, so any output mode and restart will do."""
    return model.predict(stream, n_sim, name)
