"""Prediction tables written by the prompt scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opinarium.operators.classification_metrics import prediction_counts
from opinarium.operators.scoring import latest, succeeded


def load_predictions(spark: SparkSession, path: str, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """``(successful predictions, counts per split)``."""
    rows = spark.read.parquet(path)
    if "run_id" in rows.columns:
        rows = latest(rows, key)
    return succeeded(rows), prediction_counts(rows)
