"""File sources and sinks (S1-S6, S8). Paths may be any Hadoop URI
(``s3a://``, ``abfss://``, ``hdfs://``) -- the object-store client is Spark's."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import schemas
from ..operators.corpus import kb_rows
from . import csv_ranges, json_ranges


def read_incidents(spark: SparkSession, path: str, fmt: str = "parquet",
                   schema: T.StructType = schemas.INCIDENT) -> DataFrame:
    """Incident table with a declared schema (parquet, csv or json)."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return r.format(fmt).load(path)


def read_kb_export(spark: SparkSession, path: str) -> DataFrame:
    """KB export pages ``{"result": [...]}`` -> one row per article, in as
    many tasks as the files have byte ranges (``sources.json_ranges``)."""
    return kb_rows(json_ranges.array_objects(spark, path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             header: bool = True) -> DataFrame:
    """CSV with quoted newlines and doubled quotes, in as many tasks as the
    files have byte ranges (``sources.csv_ranges``)."""
    return csv_ranges.parse(csv_ranges.csv_records(spark, path), schema, header)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header; quotes doubled and white space kept like
    pandas writes them."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Parquet sink (embedding dataset, corpus, any stage output)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The vector index for serving -- read once, kept in executor
    memory (spilling to disk), so repeated searches do not rescan."""
    return spark.read.parquet(path).persist(StorageLevel.MEMORY_AND_DISK)


