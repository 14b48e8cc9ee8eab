"""Objects of a top-level JSON array, read in byte ranges.

An export is one JSON document, ``{"result": [{...}, ...]}``, on one line or
many. Spark's text reader cuts its files at every ``}`` in byte ranges. A first
pass runs each range from both states, outside and inside a string, and keeps
what each becomes and by how much the depth changes; along a file these give
every range its true first state and depth. The second pass cuts the array's
objects where they really end; an object that crosses ranges is put together
from its parts.

Both passes are narrow; shuffled are one row per range and the parts of
objects that cross ranges (a group is one object).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .csv_ranges import _ranges
from .tables import keep_table

_OUTSIDE = re.compile(r'["{\[\]]')
_INSIDE = re.compile(r'["\\]')
#: Rows of the second pass: a whole object, a part that goes on from the range
#: before, a part that goes on in the next one, what a range says of its array.
WHOLE, GOES_ON, OPEN, SAYS = 0, 1, 2, 9
OUT_ROWS = 4096


def after(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether what follows a piece and its ``}`` is inside a string, and by how
    much the depth has changed."""
    i, depth = 0, 0
    while True:
        m = (_INSIDE if inside else _OUTSIDE).search(piece, i)
        if m is None:
            return inside, depth if inside else depth - 1
        c, i = m[0], m.end()
        if c == '"':
            inside = not inside
        elif c == "\\":
            i += 1
        else:
            depth += -1 if c == "]" else 1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), "value")


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[tuple, list] = {}
    for key, pieces in _ranges(batches):
        now = out.setdefault(key, [False, 0, True, 0])
        for p in pieces:
            for s in (0, 2):
                now[s], d = after(p, now[s])
                now[s + 1] += d
    cols = list(zip(*((*k, *v) for k, v in out.items()))) if out else [()] * 6
    types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file", "start", "from_out", "deep_out", "from_in", "deep_in"])


def range_states(pieces: DataFrame) -> DataFrame:
    """file, start, inside and depth at the beginning of every range."""
    m = pieces.mapInArrow(_maps, "file string, start long, from_out boolean, deep_out long, from_in boolean, deep_in long")
    along = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("swaps", F.coalesce(F.sum(F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0)).over(along), F.lit(0)))
    m = m.withColumn("same", F.last(F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "swaps")), ignorenulls=True).over(along))
    since = F.col("swaps") - F.coalesce("same.swaps", F.lit(0))
    m = m.withColumn("inside", F.coalesce("same.from_out", F.lit(False)) != (since % 2 == 1))
    m = m.withColumn("deep", F.when(F.col("inside"), F.col("deep_in")).otherwise(F.col("deep_out")))
    return m.withColumn("depth", F.coalesce(F.sum("deep").over(along), F.lit(0))).select("file", "start", "inside", "depth")


def _cut(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, inside, depth = None, False, 0
        held: list[str] = []   # parts of the container that is open at depth 3
        is_open, is_object, goes_on = False, False, False  # goes_on: it was opened in an earlier range
        mine, says = None, None  # mine: whether the open array is the named one, None: an earlier range knows
        word, text = 0, None   # start and content of the last string at depth 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 5
            types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file", "start", "kind", "mine", "part"])

        def close() -> None:
            if key is not None:
                if held:  # what is no object belongs to no one
                    out.append((key[0], key[1], GOES_ON if goes_on else OPEN, mine if goes_on or is_object else False, "".join(held)))
                out.append((key[0], key[1], SAYS, says, None))
        for k, pieces in _ranges(batches):
            if k != key:
                close()
                key, inside, depth, held, mine, says, text = k, k[2], k[3], [], None, None, None
                is_open = goes_on = depth >= 3
            for piece in pieces:
                i, begin = 0, 0 if is_open else None  # begin: where the open container's text starts in this piece
                while (m := (_INSIDE if inside else _OUTSIDE).search(piece, i)) is not None:
                    c, i = m[0], m.end()
                    if c == "\\":
                        i += 1
                    elif c == '"':
                        if depth == 1:
                            word, text = (i, text) if not inside else (word, piece[word:i - 1])
                        inside = not inside
                    elif c == "]":
                        depth -= 1
                        if depth == 2 and is_open:
                            is_open, goes_on, begin, held = False, False, None, []
                    else:
                        if depth == 1:
                            mine = says = c == "[" and text == name
                        if depth == 2:
                            begin, is_open, is_object, goes_on = i - 1, True, c == "{", False
                        depth += 1
                if inside:
                    if begin is not None:
                        held.append(piece[begin:] + "}")
                    continue
                depth -= 1
                if begin is not None:
                    held.append(piece[begin:] + "}")
                    if depth == 2:
                        out.append((key[0], key[1], GOES_ON if goes_on else WHOLE, mine, "".join(held)))
                        held, is_open, goes_on = [], False, False
                        if len(out) >= OUT_ROWS:
                            yield flush()
        close()
        yield flush()
    return run


def array_objects(spark: SparkSession, path: str, name: str = "result") -> DataFrame:
    """``r``, the JSON text of every object of the array ``name`` of the root
    object of each file at ``path``. Elements that are no objects are left out."""
    pieces = _pieces(spark, path)
    states = range_states(pieces)
    # one row per byte range (128 MB of input by default); a join that moved pieces would lose their order
    marked = pieces.join(F.broadcast(states), ["file", "start"]).select("file", "start", "inside", "depth", "value")
    escaped = json.dumps(name)[1:-1]
    found = keep_table(marked.mapInArrow(_cut(escaped), "file string, start long, kind int, mine boolean, part string"), "json-objects")
    along = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    says = found.where(F.col("kind") == SAYS).select("file", "start", F.coalesce(F.last("mine", ignorenulls=True).over(along), F.lit(False)).alias("before"))
    rows = found.where(F.col("kind") != SAYS).join(F.broadcast(says), ["file", "start"])  # one row per byte range
    rows = rows.withColumn("mine", F.coalesce("mine", "before"))
    whole = rows.where((F.col("kind") == WHOLE) & F.col("mine")).select(F.col("part").alias("r"))
    parts = rows.where(F.col("kind").isin(GOES_ON, OPEN))
    order = Window.partitionBy("file").orderBy("start", "kind")
    parts = parts.withColumn("owner", F.last(F.when(F.col("kind") == OPEN, F.col("start")), ignorenulls=True).over(order))
    crossing = parts.groupBy("file", "owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "part"))), lambda x: x["part"]), "").alias("r"),
        F.max_by("mine", F.col("kind")).alias("mine"))
    return whole.unionByName(crossing.where("mine").select("r"))
