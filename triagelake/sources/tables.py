"""Reading the input tables of a data directory (one Parquet dataset per table)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Partitioned Parquet scan; projections and filters applied later are
    pushed into the scan by Catalyst (ReadSchema / PushedFilters). The split
    size is the reader's (spark.sql.files.maxPartitionBytes)."""
    return spark.read.parquet(table_path(sf_dir, name))

def keep_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the session's shared checkpoint folder and read
    back: cuts the lineage, survives lost executors, and has a known size."""
    path = os.path.join(checkpoint_dir(df.sparkSession), "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
