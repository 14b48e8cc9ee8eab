"""Exact top-k search that reads only cells which can still matter.

The corpus is dealt to cells around pivots, once. Of every cell the driver
holds its centre, its widest angle and the largest and smallest weight of each
dimension -- the heads of its posting lists. No unit vector of a cell can score
more with a query than

* the cosine of the query's angle to the centre less the cell's widest angle,
* the sum over dimensions of the query's weight times the list's head,

so a query reads cells in falling order of the smaller of the two, in waves of
1, 16, 256, ... blocks of ``block_rows`` rows, and stops as soon as no other cell
can reach its k-th best score; a wave reads all that can as soon as that is
at most PAIRS_AT_ONCE pairs of a query and a row. What a wave reads is worked
out once, by as many tasks as its bounds need, and written. What one co-grouped
task takes is a lot: as many cells as LOT_ROWS rows allow, and of the queries that
read them a part of LOT_ROWS at most; a query goes to a lot once, with the cells
it reads there. Larger cells are dealt to several lots by rows, so no task holds
more than a lot, whatever a cell's share of the rows. What is sent to tasks (the
cells' heads) is bounded by CELL_NUMBERS numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import keep_table

#: Most cells, and most numbers that their heads may have together.
MAX_CELLS = 2048
CELL_NUMBERS = 1 << 22
#: Rows that pivots are chosen from, and rounds of that choice.
SAMPLE_ROWS = 16384
PIVOT_ROUNDS = 5
#: Slack of angles and bounds against rounding.
SLACK = 1e-6
#: First wave's blocks, and how many times more each next wave reads.
FIRST_BLOCKS, WAVE_FACTOR = 1, 16
#: Pairs of a query and a row that are read as the last wave.
PAIRS_AT_ONCE = 1 << 36
#: Rows of the queries and of the corpus that a lot holds at most.
LOT_ROWS = 1 << 15
#: Numbers of a table of bounds, and rows of a batch of queries on their way.
BOUND_NUMBERS, SENT_ROWS = 1 << 19, 4096

Rows = tuple[str, ...]  # the columns that hold a vector: ("vec",) or ("bs", "vs")


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay, rows of length one stay as stored."""
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    n[(n == 0) | (np.abs(n - 1.0) < 1e-12)] = 1.0
    return m / n[:, None]


def batch_matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Unit rows of a batch with dense ``vec``, or packed ``bs`` and ``vs``."""
    m = np.zeros((batch.num_rows, dim))
    if "vec" in batch.schema.names:
        v = batch.column("vec")
        if batch.num_rows and set(pa.compute.list_value_length(v).unique().to_pylist()) != {dim}:
            raise ValueError(f"vectors must have {dim} components")
        m[:] = v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
    else:
        lens = pa.compute.list_value_length(batch.column("bs")).to_numpy(zero_copy_only=False).astype(np.int64)
        at = batch.column("bs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        m[np.repeat(np.arange(len(lens)), lens), at] = batch.column("vs").flatten().to_numpy(zero_copy_only=False)
    return unit_rows(m)


def choose_pivots(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres for at most ``cells`` cells, by a few rounds of spherical
    k-means over the distinct rows of a bounded sample."""
    sample = np.unique(sample[np.any(sample != 0, axis=1)], axis=0)
    if not len(sample):
        return np.eye(1, sample.shape[1])
    if len(sample) <= cells:
        return sample
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(np.int64)]
    for _ in range(PIVOT_ROUNDS):
        of = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        filled = np.bincount(of, minlength=len(centres)) > 0
        centres = unit_rows(np.where(filled[:, None], sums, centres))
    return centres


@dataclass
class Cells:
    """A corpus dealt to cells. ``rows``: id, the vector's columns, cell; per
    cell number the centre, widest angle, heads and row count."""

    rows: DataFrame
    payload: Rows
    dim: int
    numbers: np.ndarray
    centres: np.ndarray
    widest: np.ndarray
    largest: np.ndarray
    smallest: np.ndarray
    counts: np.ndarray
    block_rows: int

    @property
    def blocks(self) -> np.ndarray:
        return -(-self.counts // self.block_rows)

    def bounds(self, q: np.ndarray, positive: bool = False) -> np.ndarray:
        """Per query and cell, a score that none of the cell's rows exceeds.
        ``positive``: only scores above 0 count; a cell without a dimension in
        common has none (-inf)."""
        x = np.clip(q @ self.centres.T, -1.0, 1.0)
        near = np.cos(self.widest)[None, :]
        # cos(angle - widest), 1 within the widest angle
        by_angle = np.where(x >= near, 1.0, x * near + np.sqrt(1.0 - x * x) * np.sin(self.widest)[None, :])
        by_heads = np.maximum(q, 0) @ self.largest.T + np.minimum(q, 0) @ self.smallest.T
        # a zero query has a score of 0 with everything
        out = np.where(np.any(q != 0, axis=1)[:, None], np.minimum(by_angle, by_heads), 0.0) + SLACK
        if positive:
            signless = np.all(q >= 0, axis=1)[:, None] & np.all(self.smallest >= 0, axis=1)[None, :]
            out[signless & (by_heads == 0)] = -np.inf
        return out


#: The cell of zero vectors; its centre is the last one, of zeros.
ZERO_CELL = -1


def cell_of(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell of each unit or zero row: that of the nearest centre."""
    of = np.argmax(m @ centres.T, axis=1)
    of[~np.any(m != 0, axis=1)] = ZERO_CELL
    return of


def _assign(payload: Rows, dim: int, centres, schema: T.StructType):
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            m = batch_matrix(batch, dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell_of(m, c), pa.int32())], names)
    return run


def _heads(dim: int, centres):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.vstack([centres.value, np.zeros((1, dim))])
        count: dict[int, int] = {}
        widest: dict[int, float] = {}
        hi: dict[int, np.ndarray] = {}
        lo: dict[int, np.ndarray] = {}
        for batch in batches:
            m = batch_matrix(batch, dim)
            of = batch.column("cell").to_numpy(zero_copy_only=False)
            for n in np.unique(of).tolist():
                x = m[of == n]
                least = float(np.clip((x @ c[n]).min(), -1.0, 1.0)) if n != ZERO_CELL else 1.0
                count[n] = count.get(n, 0) + len(x)
                widest[n] = max(widest.get(n, 0.0), math.acos(least))
                hi[n] = np.maximum(hi.get(n, -np.inf), x.max(axis=0))
                lo[n] = np.minimum(lo.get(n, np.inf), x.min(axis=0))
        keys = list(count)
        yield pa.RecordBatch.from_pydict({
            "cell": pa.array(keys, pa.int32()), "n": pa.array([count[k] for k in keys], pa.int64()),
            "widest": pa.array([widest[k] for k in keys], pa.float64()),
            "hi": pa.array([hi[k].tolist() for k in keys], pa.list_(pa.float64())),
            "lo": pa.array([lo[k].tolist() for k in keys], pa.list_(pa.float64()))})
    return run


def head_rows(rows: DataFrame, dim: int, centres) -> dict[int, tuple]:
    """Per cell: rows, widest angle, largest and smallest weights. One row per
    cell and dimension reaches the driver (bounded by CELL_NUMBERS)."""
    part = rows.mapInArrow(_heads(dim, centres), "cell int, n long, widest double, hi array<double>, lo array<double>")
    flat = part.select("cell", "n", "widest", F.posexplode(F.arrays_zip("hi", "lo")).alias("at", "x"))
    got = flat.groupBy("cell", "at").agg(F.sum("n").alias("n"), F.max("widest").alias("w"), F.max("x.hi").alias("hi"), F.min("x.lo").alias("lo")).toPandas()
    out = {}
    for cell, g in got.groupby("cell"):
        g = g.sort_values("at")
        out[int(cell)] = (int(g["n"].iloc[0]), float(g["w"].iloc[0]), g["hi"].to_numpy(), g["lo"].to_numpy())
    return out


def deal(corpus: DataFrame, payload: Rows, dim: int | None = None, block_rows: int = 4096, cells: int | None = None,
         more: tuple[str, ...] = ()) -> Cells | None:
    """Deal a corpus (id, the vector's columns and those named in ``more``) to
    cells and write it once. None for an empty corpus. Rows without a vector
    (NULL) are left out; ``cells`` sets the number of cells (else one per
    ``block_rows`` rows)."""
    spark = corpus.sparkSession
    corpus = corpus.select("id", *more, *payload).where(F.col(payload[0]).isNotNull())
    n = corpus.count()
    if n == 0:
        return None
    if dim is None:
        dim = corpus.select(F.max(F.size(payload[0]))).first()[0]
    sample = corpus.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select(*payload).toArrow()
    sample = np.vstack([batch_matrix(b, dim) for b in sample.to_batches()])
    most = max(1, min(MAX_CELLS, CELL_NUMBERS // (3 * dim)))
    pivots = choose_pivots(sample, min(most, cells or -(-n // block_rows)))
    sent = spark.sparkContext.broadcast(pivots)
    schema = T.StructType([*corpus.schema.fields, T.StructField("cell", T.IntegerType())])
    rows = keep_table(corpus.mapInArrow(_assign(payload, dim, sent, schema), schema), "cells")
    heads = head_rows(rows, dim, sent)
    numbers = np.array(sorted(heads))
    centres = np.vstack([pivots, np.zeros((1, dim))])[numbers]
    col = lambda i: np.array([heads[c][i] for c in numbers.tolist()])
    return Cells(rows, payload, dim, numbers, centres, col(1) + SLACK, col(2), col(3), col(0), block_rows)


def narrowed(dealt: Cells, rows: DataFrame) -> Cells:
    """The cells with some of their rows; the heads bound these all the more.
    Cells that are left with much less than a block are merged."""
    n = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # one row per cell
    at = np.array([i for i, c in enumerate(dealt.numbers.tolist()) if c in n], dtype=np.int64)
    counts = np.array([n[c] for c in dealt.numbers[at].tolist()], dtype=np.int64)
    return merged(Cells(rows, dealt.payload, dealt.dim, dealt.numbers[at], dealt.centres[at], dealt.widest[at], dealt.largest[at], dealt.smallest[at],
                        counts, dealt.block_rows))


def merged(dealt: Cells) -> Cells:
    """Neighbouring cells as one, about as many as there are blocks of rows; as
    they are if they are not many more. To bound a cell costs a query as much as
    to score dozens of rows, so cells of few rows cost more than they spare."""
    some = np.flatnonzero(dealt.numbers != ZERO_CELL)
    most = max(1, -(-int(dealt.counts.sum()) // dealt.block_rows))
    if len(some) <= 2 * most:
        return dealt
    pivots = choose_pivots(dealt.centres[some], most)
    of = np.argmax(dealt.centres[some] @ pivots.T, axis=1)
    parts = [some[of == n] for n in np.unique(of)]
    centres = pivots[np.unique(of)]
    # a row is no farther from the new centre than the old centre is and it from that
    widest = np.array([(np.arccos(np.clip(dealt.centres[p] @ c, -1.0, 1.0)) + dealt.widest[p]).max() for p, c in zip(parts, centres)])
    zero = np.flatnonzero(dealt.numbers == ZERO_CELL)
    # of Arrow: a table of rows would be made by Python workers in a job's tasks
    table = dealt.rows.sparkSession.createDataFrame(pa.table({
        "cell": pa.array(np.r_[np.concatenate([dealt.numbers[p] for p in parts]), ZERO_CELL], pa.int32()),
        "_merged": pa.array(np.r_[np.repeat(np.arange(len(parts)), [len(p) for p in parts]), ZERO_CELL], pa.int32())}))
    rows = dealt.rows.join(F.broadcast(table), "cell")  # at most MAX_CELLS + 1 rows
    rows = rows.select(*[F.col("_merged").alias("cell") if c == "cell" else F.col(c) for c in dealt.rows.columns])

    def each(fold, x: np.ndarray) -> np.ndarray:
        return np.array([*[fold(x[p], axis=0) for p in parts], *x[zero]])
    return Cells(rows, dealt.payload, dealt.dim, np.r_[np.arange(len(parts)), dealt.numbers[zero]], np.vstack([centres, dealt.centres[zero]]),
                 np.r_[np.minimum(widest + SLACK, np.pi), dealt.widest[zero]], each(np.max, dealt.largest), each(np.min, dealt.smallest),
                 each(np.sum, dealt.counts), dealt.block_rows)


@dataclass
class Work:
    """What a search did: pairs of a query and a block that were scored, and
    the pairs there are; waves."""

    scored: int = 0
    pairs: int = 0
    waves: list[int] = field(default_factory=list)


#: Stand for the rows of later waves, and for the queries, in a count of what a wave reads.
LATER, QUERIES = -2, -3


def _bits(flags: np.ndarray) -> pa.Array:
    """Rows of flags as binary values."""
    packed = np.packbits(flags, axis=1)
    offsets = np.arange(len(packed) + 1, dtype=np.int32) * packed.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])


def _flags(bits: pa.Array, n: int) -> np.ndarray:
    """What ``_bits`` was made of, ``n`` flags a row."""
    return np.unpackbits(np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), -1), axis=1, count=n).astype(bool)


def _wanted(sent, most: int | None, margin: float, positive: bool, names: list[str]):
    """The queries of a wave with the cells they read in it (``read``) and so
    far (``done``), as flags by place, and how many rows are left for later
    waves: the best cells that matter and hold ``most`` rows (None: all)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Cells = sent.value
        step = max(1, BOUND_NUMBERS // len(c.numbers))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                m = batch_matrix(part, c.dim)
                ub = c.bounds(m, positive)
                done = _flags(part.column("done"), len(c.numbers))
                bound = part.column("bound").to_numpy(zero_copy_only=False)
                read = matters = (ub >= (bound - margin)[:, None]) & (ub > -np.inf) & ~done
                if most is not None:
                    # of cells that may all hold the best, the one with the nearest centre
                    order = np.lexsort((-(m @ c.centres.T), np.where(matters, -ub, np.inf)), axis=1)
                    rows = np.where(np.take_along_axis(matters, order, axis=1), c.counts[order], 0)
                    read = np.zeros_like(matters)
                    np.put_along_axis(read, order, (rows > 0) & (np.cumsum(rows, axis=1) - rows < most), axis=1)
                later = (matters & ~read) @ c.counts
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["done"]).columns, _bits(done | read), _bits(read), pa.array(later, pa.int64())], names)
    return run


def _loads(sent):
    """How many queries read each cell in a wave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Cells = sent.value
        n, later, queries = np.zeros(len(c.numbers), np.int64), 0, 0
        step = max(1, BOUND_NUMBERS // len(c.numbers))
        for batch in batches:
            later += int(batch.column("later").to_numpy().sum())
            queries += batch.num_rows
            for start in range(0, batch.num_rows, step):
                n += np.count_nonzero(_flags(batch.column("read").slice(start, step), len(n)), axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([*c.numbers[some].tolist(), LATER, QUERIES], pa.int32()),
                                          pa.array([*n[some].tolist(), later, queries], pa.int64())], ["cell", "n"])
    return run


def lots_of(loads: dict[int, int], counts: dict[int, int], q_room: int, c_room: int, q_parts: int | None = None,
            queries: int | None = None) -> tuple[dict[int, tuple[int, int, int]], int]:
    """Per cell its first lot and the blocks of rows and parts of queries it is
    dealt to (a lot each), and the number of lots. Cells of one block share
    lots as long as there is room for their rows and, as long as it is not
    known how many ``queries`` read them together, for all who read each."""
    out, lots = {}, 0
    group: list[int] = []

    def parts(n: int) -> int:
        return q_parts or max(1, -(-(n if queries is None else min(n, queries)) // q_room))

    def close() -> None:
        nonlocal lots
        if group:
            p = parts(sum(loads[c] for c in group))
            out.update((c, (lots, 1, p)) for c in group)
            lots += p
            group.clear()
    q = c = 0
    for cell, n in sorted(loads.items()):
        blocks = -(-counts[cell] // c_room)
        if blocks > 1 or queries is None and parts(n) > 1:
            out[cell] = (lots, blocks, parts(n))
            lots += blocks * parts(n)
            continue
        if group and (queries is None and q + n > q_room or c + counts[cell] > c_room):
            close()
        if not group:
            q = c = 0
        group.append(cell)
        q, c = q + n, c + counts[cell]
    close()
    return out, lots


def _sent(sent, lots: dict[int, tuple[int, int, int]], names: list[str]):
    """The queries of a wave, once per lot, with the cells they read there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Cells = sent.value
        lot0, blocks, parts = np.array([lots.get(n, (0, 1, 1)) for n in c.numbers.tolist()], dtype=np.int64).T
        step = max(1, BOUND_NUMBERS // len(c.numbers))
        for part in (b.slice(start, step) for b in batches for start in range(0, b.num_rows, step)):
            at, cell = np.nonzero(_flags(part.column("read"), len(c.numbers)))
            part = part.drop_columns(["read"])
            times = blocks[cell]
            block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, cell = np.repeat(at, times), np.repeat(cell, times)
            spread = part.column("spread").to_numpy(zero_copy_only=False)
            lot = lot0[cell] + block * parts[cell] + spread[at] % parts[cell]
            order = np.lexsort((cell, lot, at))
            at, cell, lot = at[order], c.numbers[cell[order]], lot[order]
            start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (lot[1:] != lot[:-1])][:len(at)])
            end = np.r_[start[1:], len(at)][:len(start)]
            for s in range(0, len(start), SENT_ROWS):
                a, b = start[s:s + SENT_ROWS], end[s:s + SENT_ROWS]
                rows = part.take(pa.array(at[a]))
                cells = pa.ListArray.from_arrays(pa.array(np.r_[a, b[-1]] - a[0], pa.int32()), pa.array(cell[a[0]:b[-1]], pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, cells, pa.array(lot[a], pa.int32())], names)
    return run


def search(queries: DataFrame, corpus: Cells, score_lot, rank, *, margin: float, q_rows: int = 8192, q_parts: int | None = None,
           found_fields: list[T.StructField], min_score: float | None = None, work: Work | None = None) -> DataFrame:
    """The ranked best rows of every query: qid, k, ``found_fields`` (of the
    corpus' rows), score, rank.

    ``queries`` has qid, k (at least 1) and the vector's columns; it is written
    once. ``score_lot(q, c)`` scores a lot's queries (with ``bound`` and the
    ``cells`` they read) against its rows (with ``cell``) and returns
    candidates (qid, k, ``found_fields``, score); ``rank`` keeps each query's
    first k of them. A cell that cannot come within ``margin`` of a query's
    k-th best score, or of ``min_score``, is not read for it.
    """
    spark = queries.sparkSession
    work = work if work is not None else Work()
    queries = keep_table(queries.select("qid", "k", *corpus.payload), "queries")
    blocks = {int(c): int(b) for c, b in zip(corpus.numbers, corpus.blocks)}
    counts = {int(c): int(n) for c, n in zip(corpus.numbers, corpus.counts)}
    n_queries = queries.count()
    work.pairs += n_queries * sum(blocks.values())
    bare = Cells(None, corpus.payload, corpus.dim, corpus.numbers, corpus.centres, corpus.widest, corpus.largest, corpus.smallest,
                 corpus.counts, corpus.block_rows)
    sent = spark.sparkContext.broadcast(bare)  # at most CELL_NUMBERS numbers
    schema = T.StructType([queries.schema["qid"], T.StructField("k", T.LongType()), *found_fields, T.StructField("score", T.DoubleType())])
    best = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    par = spark.sparkContext.defaultParallelism
    positive = min_score is not None and min_score >= 0
    width, later, wanted = FIRST_BLOCKS * corpus.block_rows, None, None
    # as many tasks as there are tables of bounds, or batches of queries; one file of queries would be one
    tasks = max(1, min(4 * par, max(-(-n_queries * len(blocks) // BOUND_NUMBERS), n_queries // (2 * SENT_ROWS))))
    while later is None or later > 0:
        if wanted is None:
            state = queries.withColumn("bound", F.lit(None).cast("double")).withColumn("done", F.lit(bytearray(-(-len(blocks) // 8))))
        else:  # a bound once k rows are known: their smallest score
            known = best.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= F.max("k"), F.min("score")).alias("bound"))
            state = wanted.where("later > 0").select("qid", "k", *corpus.payload, "done").join(known, "qid", "left")
        state = state.select("qid", "k", F.greatest("bound", F.lit(float("-inf") if min_score is None else float(min_score))).alias("bound"),
                             F.pmod(F.xxhash64("qid"), F.lit(1 << 30)).alias("spread"), *corpus.payload, "done")
        most = None if later is not None and later <= PAIRS_AT_ONCE else width
        wanted_schema = T.StructType([*state.schema.fields, T.StructField("read", T.BinaryType()), T.StructField("later", T.LongType())])
        wanted = keep_table((state.repartition(tasks, "qid") if tasks > 1 else state).mapInArrow(
            _wanted(sent, most, margin, positive, wanted_schema.names), wanted_schema), "wanted")
        loads = {r["cell"]: r["n"] for r in wanted.select("read", "later").mapInArrow(_loads(sent), "cell int, n long")
                 .groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # one row per cell
        later, asked = loads.pop(LATER, 0), loads.pop(QUERIES, 0)
        width *= WAVE_FACTOR
        if not loads:
            break  # no query's next cell can matter
        work.scored += sum(n * blocks[c] for c, n in loads.items())
        work.waves.append(sum(loads.values()))
        # lots for all cores, but not smaller than a part of the queries
        rows = sum(counts[c] for c in loads)
        q_room = max(1, min(LOT_ROWS, max(q_rows, -(-asked * -(-rows // LOT_ROWS) // (4 * par)))))
        lots, groups = lots_of(loads, counts, q_room, LOT_ROWS, q_parts, asked)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * groups, 4 * par))
        asking = wanted.select("qid", "k", "bound", "spread", *corpus.payload, "read")
        pair_schema = T.StructType([*asking.drop("read").schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("lot", T.IntegerType())])
        q = (asking.repartition(tasks, "qid") if tasks > 1 else asking).mapInArrow(_sent(sent, lots, pair_schema.names), pair_schema).drop("spread").repartition(parts, "lot")
        table = spark.createDataFrame(pa.table(dict(zip(
            ("cell", "_lot", "_blocks", "_parts"), (pa.array(x, pa.int32()) for x in zip(*[(c, *lots[c]) for c in loads]))))))
        block = F.pmod(F.xxhash64("vk" if "vk" in corpus.rows.columns else "id"), F.col("_blocks")).cast("int")
        lot = F.explode(F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda p: F.col("_lot") + F.col("_block") * F.col("_parts") + p))
        c = (corpus.rows.join(F.broadcast(table), "cell").withColumn("_block", block).withColumn("lot", lot)  # at most MAX_CELLS + 1 rows
             .drop("_lot", "_blocks", "_parts", "_block").repartition(parts, "lot"))
        found = q.groupBy("lot").cogroup(c.groupBy("lot")).applyInPandas(score_lot, schema)
        best = keep_table(rank(best.drop("rank").unionByName(found)), "best")
    return best
