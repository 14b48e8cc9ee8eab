"""Helpers shared by the operators: intermediate tables, batches, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

#: Rows of an Arrow batch sent to Python; texts make rows large.
BATCH_ROWS = 1000
#: Python works on slices of a batch of about this many bytes of text.
SLICE_BYTES = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet")).select(*cols)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: later steps survive lost executors without running the
    earlier ones again, and joins see the table's real size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch sent to Python, however long its texts are.
BATCH_BYTES = 16_000_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to BATCH_ROWS rows and BATCH_BYTES
    bytes, if it is larger."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def training_rows(id_col: str | Column) -> Column:
    """True for rows that models may learn from: crc32(id as text) mod 3 is
    not 1. Rows without an id are never learnt from."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % 3 != 1, F.lit(False))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def text_slices(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with their texts as UTF-8 bytes, cut so that a
    slice holds about SLICE_BYTES (one longer text is a slice of its own)."""
    for batch in batches:
        texts = batch.column(text_col).cast(pa.binary()).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            n = len(t) if t is not None else 0
            if i > start and size + n > SLICE_BYTES:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += n
        if start < len(texts):
            yield batch.slice(start), texts[start:]


#: Result rows of by_group's batches.
GROUP_OUT_ROWS = 4096


def by_group(rows: DataFrame, keys: list[str], order: list[str], cols: list[str], fn, schema: str) -> DataFrame:
    """``fn(key, rows)`` for every group, rows as tuples of ``cols`` in
    ``order``; it returns result rows as tuples of ``schema``. Groups are read
    from sorted batches, so thousands of small ones cost no frame each; a group
    must be bounded. ``rows`` must be partitioned by the keys."""
    from pyspark.sql.pandas.types import to_arrow_schema
    shape = to_arrow_schema(T._parse_datatype_string(schema))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, held = None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(shape)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and row[:n] != key:
                    out.extend(fn(key, held))
                    held = []
                    if len(out) >= GROUP_OUT_ROWS:
                        yield flush()
                key = row[:n]
                held.append(row[n:])
        if held:
            out.extend(fn(key, held))
        yield flush()
    return rows.sortWithinPartitions(*keys, *order).select(*keys, *cols).mapInArrow(run, schema)


#: Slots of the bitmap that maybe_in() builds: 8 MB, whatever the input.
BITMAP_SLOTS = 1 << 26


def maybe_in(rows: DataFrame, hash_col: str, wanted: DataFrame, wanted_col: str) -> DataFrame:
    """Rows of ``rows`` whose hash may be among ``wanted``'s: those of wanted
    rows, and others whose hash falls on a taken slot. A semi-join reduction
    that spares a join the shuffle of rows without a match; the broadcast
    bitmap has a fixed number of slots, so it only filters less, never wrongly,
    when there are more wanted rows than slots."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_SLOTS)) + 1
    bits = (wanted.select(slot(F.col(wanted_col)).alias("_s"))
            .groupBy(F.bitmap_bucket_number("_s").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits")))
    bits = keep(bits, "bitmap")  # at most 2,048 rows of 4 KB
    at = rows.withColumn("_s", slot(F.col(hash_col)))
    at = at.withColumn("_b", F.bitmap_bucket_number("_s")).withColumn("_p", F.bitmap_bit_position("_s"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (at.join(F.broadcast(bits), F.col("_b") == F.col("_bucket"))
            .where(F.getbit(byte, (F.col("_p") % 8).cast("int")) == 1).drop("_s", "_b", "_p", "_bucket", "_bits"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list of longs: ``node``, ``component``
    (the smallest node reachable), one row per node that has an edge.

    Alternates large-star and small-star rounds, which end in stars around
    each smallest node after about log(n) rounds. Each round is a written
    table; the minima per node are aggregates, combined before the shuffle,
    and no group is ever collected.
    """
    e = keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        # large star: every larger neighbour of u to the smallest of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = keep(e.join(low.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).distinct(), "large-star")
        # small star: u's smaller neighbours, and u, to the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        low = keep(low, "small-star")
        if low.where("m < most").isEmpty() and big.join(low.select(F.col("u").alias("_u")), F.col("v") == F.col("_u"), "left_semi").isEmpty():
            e = low.select("u", F.col("m").alias("v"))  # stars: one centre each, and no centre is a leaf
            break
        e = keep(big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` of what ``comp`` joins and of more edges (a, b): only the
    edges between different components are worked on."""
    of = comp.select("node", "component")
    e = edges.join(of.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left").join(
        of.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left")
    e = e.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    top = components(e).select(F.col("node").alias("component"), F.col("component").alias("top"))
    both = comp.join(top, "component", "full").select(
        F.coalesce("node", "component").alias("node"), F.coalesce("top", "component").alias("component"))
    return keep(both, "components")
