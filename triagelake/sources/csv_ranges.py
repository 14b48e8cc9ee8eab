"""CSV with quoted newlines, read in byte ranges.

Spark's text reader gives the lines of every byte range of a file. Whether a
line begins inside a quoted value is not known inside one range, so a first
pass runs each range's lines from both states, outside and inside, and keeps
what each becomes: both the same, unchanged, or swapped. Along a file these
maps give every range its true first state. The second pass joins lines to
records where they really end; a record that crosses ranges is put together
from its pieces. Records are then parsed by Spark's own CSV parser.

Both passes are narrow. Shuffled are one row per range, and the pieces of
records that cross ranges (a group is one record).
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of the second pass' output batches.
OUT_ROWS = 4096


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted value, given how it begins. A quote
    opens a value only as its first character; two inside one are a quote."""
    i, n = 0, len(line)
    while True:
        if not inside:
            # i is where a field begins
            if i < n and line[i] == '"':
                inside, i = True, i + 1
            else:
                i = line.find(",", i) + 1
                if not i:
                    return False
                continue
        i = line.find('"', i)
        if i < 0:
            return True
        if line.startswith('"', i + 1):
            i += 2
            continue
        inside, i = False, line.find(",", i + 1) + 1  # what follows up to the comma is left to the parser
        if not i:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """Runs of lines of one range, in order; a range may come in several."""
    for b in batches:
        cols = [c.to_pylist() for c in b.columns[:-1]]
        values = b.column(len(b.columns) - 1).to_pylist()
        keys, at = list(zip(*cols)), 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                yield keys[at], values[at:i]
                at = i


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, ended, out = None, [False, True], [False, False], []

    def done():
        if key is not None:
            out.append((*key, *state, *ended))
    for k, lines in _ranges(batches):
        if k != key:
            done()
            key, state, ended = k, [False, True], [False, False]
        for line in lines:
            if '"' not in line:  # unchanged
                ended = [e or not s for e, s in zip(ended, state)]
                continue
            state = [ends_inside(line, s) for s in state]
            ended = [e or not s for e, s in zip(ended, state)]
    done()
    cols = list(zip(*out)) if out else [()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.bool_()) for c in cols[2:]]],
                                     ["file", "start", "from_out", "from_in", "ends_out", "ends_in"])


def range_states(lines: DataFrame) -> DataFrame:
    """file, start, inside (how the range begins) and owner (if it begins
    inside: the range where that record began)."""
    m = lines.mapInArrow(_maps, "file string, start long, from_out boolean, from_in boolean, ends_out boolean, ends_in boolean")
    along = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0)).over(along), F.lit(0))
    m = m.withColumn("swaps", swaps)
    # the last range before this one that ends the same from both states
    same = F.last(F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "swaps")), ignorenulls=True).over(along)
    m = m.withColumn("same", same)
    since = F.col("swaps") - F.coalesce("same.swaps", F.lit(0))
    m = m.withColumn("inside", F.coalesce("same.from_out", F.lit(False)) != (since % 2 == 1))
    begins = ~F.col("inside") | F.when(F.col("inside"), F.col("ends_in")).otherwise(F.col("ends_out"))
    owner = F.last(F.when(begins, F.col("start")), ignorenulls=True).over(along)
    return m.withColumn("owner", owner).select("file", "start", "inside", "owner")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """record, and for pieces of a record that crosses ranges its file and
    owner. Columns of the input: file, start, inside, owner, line."""
    out: list[tuple] = []
    key, inside, owner, held, at_top = None, False, None, [], False

    def flush():
        cols = list(zip(*out)) if out else [()] * 5
        batch = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                            pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.string())], ["file", "owner", "start", "first", "record"])
        out.clear()
        return batch

    def close():
        """The range is over: what is held goes on in the next one."""
        if held:
            out.append((key[0], owner if owner is not None else key[1], key[1], at_top, "\n".join(held)))
    for k, lines in _ranges(batches):
        if k != key:
            close()
            key, inside, owner, held = k, k[2], k[3] if k[2] else None, []
            at_top = k[1] == 0
        for line in lines:
            inside = ends_inside(line, inside)
            held.append(line)
            if not inside:
                text = "\n".join(held)
                if owner is not None:  # the end of a record that began in an earlier range
                    out.append((key[0], owner, key[1], False, text))
                    owner = None
                else:
                    out.append((None, None, None, at_top, text))
                    at_top = False
                held = []
                if len(out) >= OUT_ROWS:
                    yield flush()
    close()
    yield flush()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """record (its text) and first (it is the first of its file), one row per
    CSV record of the files at ``path``."""
    lines = _lines(spark, path)
    states = range_states(lines)
    # one row per byte range (128 MB of input by default); a join that moved lines would lose their order
    marked = lines.join(F.broadcast(states), ["file", "start"]).select("file", "start", "inside", "owner", "value")
    found = marked.mapInArrow(_records, "file string, owner long, start long, first boolean, record string")
    whole = found.where("file IS NULL").select("record", "first")
    crossing = found.where("file IS NOT NULL").groupBy("file", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda x: x["record"]), "\n").alias("record"),
        F.max("first").alias("first"))
    return whole.unionByName(crossing.select("record", "first"))


def parse(records: DataFrame, schema: T.StructType | None, header: bool) -> DataFrame:
    """Columns of CSV records, by Spark's parser. Without a schema the columns
    are strings, named by the header or ``_c0``, ``_c1``, ... Empty records are
    skipped, like a CSV reader skips empty lines."""
    text = F.regexp_replace("record", "\r\\z", "")
    records = records.select("first", F.when(F.col("first"), F.ltrim(text, F.lit("\ufeff"))).otherwise(text).alias("record")).where("record <> ''")
    if schema is None:
        top = records.where("first").limit(1).collect()  # one record
        names = next(csv.reader([top[0]["record"]])) if top else []
        schema = T.StructType([T.StructField(n if header else f"_c{i}", T.StringType()) for i, n in enumerate(names)])
    if not schema.fields:
        return records.sparkSession.createDataFrame([], schema)
    if header:
        records = records.where(~F.col("first"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    fields = F.from_csv("record", ddl, {"quote": '"', "escape": '"', "multiLine": "true"})
    return records.select(F.inline(F.array(fields)))
