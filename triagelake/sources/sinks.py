"""Manifest of an embedding dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def manifest(df: DataFrame, vec_col: str = "embedding", model_name: str = "") -> DataFrame:
    """One row: model name, embedding dimension, record count, creation time.
    A single global aggregation (partial counts per task, one tiny merge)."""
    return df.agg(F.lit(model_name).alias("model_name"),
                  F.max(F.size(vec_col)).cast("int").alias("embedding_dim"),
                  F.count(F.lit(1)).alias("num_records"),
                  F.current_timestamp().alias("date_created"))


def write_with_manifest(df: DataFrame, path: str, vec_col: str = "embedding", model_name: str = "") -> dict:
    """S6 + S7: write an embedding dataset; its manifest comes from the metrics
    of that same write."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("num_records"), F.max(F.size(vec_col)).alias("embedding_dim")).write.mode("overwrite").parquet(path)
    return {"model_name": model_name, **seen.get}
