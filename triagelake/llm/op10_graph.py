"""Embedding near-dedup on a robust-pruned flat graph.

Vectors of one label are dealt into overlapping cluster shards. Each shard
builds a neighbour graph by robust pruning (a neighbour is dropped if one
already taken is nearer to it by a factor); a vector's lists from all its
shards are united. Every vector then searches its shards: a greedy beam search
from itself and the medoid, which goes on through all vectors found in range. Pairs in
range are verified by their cosine in double precision. Cells that centroids
cannot split are compared whole instead, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, keep, read, small_batches

THRESHOLD = 0.98
#: Cells with more vectors are split again, by at most SPLIT sampled centroids.
SHARD = 2400
SPLIT = 48
DEPTH = 6
#: A vector joins every cell whose centroid is not much farther than the nearest
#: one. Two vectors at the threshold differ by a chord that is spread over all
#: dimensions; the margin is this many times its usual share along one direction.
SPREAD = 1.5
#: Centroids are at least this many chords at the threshold apart, so that a
#: group of vectors all in range of each other has one centroid at most.
APART = 2
#: A cell is compared whole if, on SAMPLE of its vectors, splitting it would keep
#: more than half of its pairs to compare, or store its vectors more often than
#: OVERLAP times and than whole comparison does (once for each block of WHOLE).
SAMPLE, OVERLAP, WHOLE = 256, 2, 4096
#: Robust pruning: candidates, neighbours kept, factor.
CANDIDATES, DEGREE, ALPHA = 48, 16, 1.2
#: Beam of the greedy search; queries searched together.
BEAM = 24
BLOCK = 256
#: Neighbours (with repetitions) looked at together, in groups of many in range.
EXPAND = 1 << 17


# ---- inside a shard ----------------------------------------------------------

def robust_prune(sim: np.ndarray) -> list[np.ndarray]:
    """Neighbour lists of all vectors from their similarities: nearest first,
    dropping candidates that a taken neighbour is nearer to by ALPHA; edges
    both ways. Parts of the graph without an edge between them are joined, each
    by the shortest edge out of it, until all is connected."""
    n = len(sim)
    dist = np.sqrt(np.maximum(0.0, 2 - 2 * sim))
    c = min(CANDIDATES, n - 1)
    if c < 1:
        return [np.empty(0, np.int64) for _ in range(n)]
    own = dist.copy()
    np.fill_diagonal(own, np.inf)
    cand = np.argpartition(own, c - 1, axis=1)[:, :c]
    cand = np.take_along_axis(cand, np.argsort(np.take_along_axis(own, cand, 1), axis=1, kind="stable"), 1)
    far = np.take_along_axis(own, cand, 1)
    alive = np.ones_like(cand, bool)
    rows = np.arange(n)
    edges = np.zeros((n, n), bool)
    for _ in range(min(DEGREE, c)):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        star = cand[rows, pick]
        edges[rows[some], star[some]] = True
        alive &= ALPHA * dist[star[:, None], cand] > far
        alive[rows, pick] = False
    edges |= edges.T
    while True:
        part = _parts(edges)
        if not part.any():
            break
        out = np.where(part[:, None] == part[None, :], np.inf, dist)
        to = out.argmin(1)
        length = out[rows, to]
        first = np.lexsort((length, part))
        first = first[np.r_[True, np.diff(part[first]) > 0]]
        edges[first, to[first]] = edges[to[first], first] = True
    return [np.flatnonzero(e) for e in edges]


def _parts(linked: np.ndarray) -> np.ndarray:
    """Smallest vector connected with each, from a symmetric boolean matrix."""
    root = np.arange(len(linked))
    i, j = np.nonzero(linked)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def range_search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, least: float) -> np.ndarray:
    """For queries (indices into x, unit rows): True where a vector was found
    with similarity >= least. Greedy beam search from the query's own vector
    and the medoid; vectors in range are expanded until no new one is found."""
    n, q = len(x), len(queries)
    width = max(1, max(len(e) for e in lists))
    table = np.full((n, width), -1, np.int64)
    for i, e in enumerate(lists):
        table[i, :len(e)] = e
    medoid = int((x @ x.mean(0)).argmax())
    rows = np.arange(q)
    sim = np.full((q, n), -np.inf)
    sim[:, medoid] = x[queries] @ x[medoid]
    sim[rows, queries] = 1.0
    done = np.zeros((q, n), bool)
    beam = np.full((q, BEAM), -1, np.int64)
    beam[:, 0] = queries
    beam[:, 1] = np.where(queries == medoid, -1, medoid)

    def expand(who: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Newly seen neighbours (query, node) of the nodes."""
        done[who, node] = True
        r, c = np.repeat(who, width), table[node].ravel()
        new = c >= 0
        r, c = r[new], c[new]
        new = sim[r, c] == -np.inf
        r, c = r[new], c[new]
        for s in range(0, len(r), EXPAND):
            some = r[s:s + EXPAND], c[s:s + EXPAND]
            sim[some] = np.einsum("ij,ij->i", x[queries[some[0]]], x[some[1]])
        return r, c

    while True:
        score = np.where(beam >= 0, sim[rows[:, None], beam], -np.inf)
        todo = (beam >= 0) & ~done[rows[:, None], beam]
        who = np.flatnonzero(todo.any(1))
        if not len(who):
            break
        best = np.where(todo, score, -np.inf)[who].argmax(1)
        r, c = expand(who, beam[who, best])
        if not len(r):
            continue
        r, c = np.divmod(np.unique(r * n + c), n)
        place = np.arange(len(r)) - np.searchsorted(r, r)
        fresh = np.full((q, int(place.max()) + 1), -1, np.int64)
        fresh[r, place] = c
        both = np.concatenate((beam, fresh), 1)
        value = np.where(both >= 0, sim[rows[:, None], both], -np.inf)
        beam = np.take_along_axis(both, np.argsort(-value, axis=1, kind="stable")[:, :BEAM], 1)
    while True:
        who, node = np.nonzero((sim >= least) & ~done)
        if not len(who):
            break
        piece = max(1, EXPAND // width)
        for s in range(0, len(who), piece):
            expand(who[s:s + piece], node[s:s + piece])
    found = sim >= least
    found[rows, queries] = False
    return found


def _unit(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(np.float64)


def _graph(pdf: pd.DataFrame) -> pd.DataFrame:
    """Neighbour lists of one shard."""
    x = _unit(pdf)
    nodes = pdf["node"].to_numpy()
    return pd.DataFrame({"node": nodes, "near": [nodes[e] for e in robust_prune(x @ x.T)]})


def _members(cells: pd.Series, which) -> np.ndarray:
    """One row per vector, one column per cell that ``which`` takes: 1 if the
    vector is in it."""
    place = {c: k for k, c in enumerate(sorted({c for cs in cells for c in cs if which(c)}))}
    out = np.zeros((len(cells), len(place)), np.float32)
    for i, cs in enumerate(cells):
        for c in cs:
            if c in place:
                out[i, place[c]] = 1
    return out


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per vector of one shard: ``links`` (vectors in range, copies counted,
    of pairs that no earlier shard shares) and ``root`` (a vector it is
    connected with by pairs in range)."""
    pdf = pdf.sort_values("node").reset_index(drop=True)
    x, nodes, cell = _unit(pdf), pdf["node"].to_numpy(), pdf["cell"].iloc[0]
    at = {v: i for i, v in enumerate(nodes.tolist())}
    lists = [np.array([at[v] for v in e if v in at], np.int64) for e in pdf["near"]]
    n = len(x)
    found = np.zeros((n, n), bool)
    for s in range(0, n, BLOCK):
        queries = np.arange(s, min(n, s + BLOCK))
        found[queries] = range_search(x, lists, queries, THRESHOLD - 1e-9)
    # pairs that share another cell are compared all, so that each of these
    # cells has the same ones and the first can count them
    others = _members(pdf["cells"], lambda c: c != cell)
    for s in range(0, n if others.any() else 0, BLOCK):
        found[s:s + BLOCK] |= (x[s:s + BLOCK] @ x.T >= THRESHOLD - 1e-9) & (others[s:s + BLOCK] @ others.T > 0)
    np.fill_diagonal(found, False)
    found |= found.T
    # verify: cosine in double precision of the vectors as given
    a, b = np.nonzero(found)
    raw = np.stack(pdf["raw"].to_numpy()).astype(np.float64)
    norm = np.sqrt((raw * raw).sum(1))
    for s in range(0, len(a), 1 << 16):
        i, j = a[s:s + (1 << 16)], b[s:s + (1 << 16)]
        found[i, j] = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= THRESHOLD
    root = _parts(found)
    # a pair counts in the first of the shards it shares
    earlier = _members(pdf["cells"], lambda c: c < cell)
    count = pdf["times"].to_numpy()
    links = np.array([(found[s:s + BLOCK] & (earlier[s:s + BLOCK] @ earlier.T == 0)) @ count for s in range(0, n, BLOCK)], object)
    return pd.DataFrame({"node": nodes, "links": np.concatenate(list(links)).astype(np.int64), "root": nodes[root]})


# ---- cells compared whole ------------------------------------------------------

def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """As _search, exactly, for the pairs of two blocks (or in one block) of a
    cell: ``links`` and ``root`` of the vectors that have a pair in range."""
    pdf = pdf.sort_values("node").reset_index(drop=True)
    nodes, cell, one, two = pdf["node"].to_numpy(), pdf["cell"].iloc[0], pdf["one"].iloc[0], pdf["two"].iloc[0]
    left, right = (np.flatnonzero(pdf["block"] == b) for b in (one, two))
    raw = np.stack(pdf["raw"].to_numpy()).astype(np.float64)
    norm = np.sqrt((raw * raw).sum(1))
    earlier = _members(pdf["cells"], lambda c: c < cell)
    count = pdf["times"].to_numpy().astype(np.float64)
    hit = np.zeros((len(left), len(right)), bool)
    links = np.zeros(len(pdf))
    for s in range(0, len(left), BLOCK):
        rows = left[s:s + BLOCK]
        cos = raw[rows] @ raw[right].T / (norm[rows][:, None] * norm[right][None, :])
        a, b = np.nonzero(np.abs(cos - THRESHOLD) < 1e-9)  # as _search rounds it
        i, j = rows[a], right[b]
        cos[a, b] = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j])
        h = (cos >= THRESHOLD) & (rows[:, None] != right[None, :])
        hit[s:s + BLOCK] = h
        h = h & (earlier[rows] @ earlier[right].T == 0)
        links[rows] += h @ count[right]
        if one != two:
            links[right] += count[rows] @ h
    root = np.arange(len(pdf))
    while True:
        low = root.copy()
        for s in range(0, len(left), BLOCK):
            rows, h = left[s:s + BLOCK], hit[s:s + BLOCK]
            low[rows] = np.minimum(low[rows], np.where(h, root[right][None, :], len(pdf)).min(1, initial=len(pdf)))
            low[right] = np.minimum(low[right], np.where(h, root[rows][:, None], len(pdf)).min(0, initial=len(pdf)))
        low = np.minimum(low, low[low])
        if (low == root).all():
            break
        root = low
    some = np.zeros(len(pdf), bool)
    some[left], some[right] = some[left] | hit.any(1), some[right] | hit.any(0)
    return pd.DataFrame({"node": nodes[some], "links": links[some].astype(np.int64), "root": nodes[root][some]})


def compare_whole(cells: DataFrame) -> DataFrame:
    """``node``, ``links``, ``root`` from all pairs of each cell: its vectors
    are dealt into blocks, and every two blocks are a group of their own."""
    sizes = cells.groupBy(F.col("cell").alias("_cell")).agg(F.ceil(F.count(F.lit(1)) / WHOLE).alias("blocks"))
    dealt = (cells.join(sizes, F.col("cell") == F.col("_cell")).withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), "blocks"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("_cell", "blocks", "other"))
    return dealt.groupBy("cell", "one", "two").applyInPandas(_compare, "node long, links long, root long")


# ---- shards ------------------------------------------------------------------

def _margin(dims: int) -> float:
    return SPREAD * np.sqrt((2 - 2 * THRESHOLD) / dims) + 1e-12


def _marks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Centroids of one large cell from a sample of its vectors, and whether the
    cell is to be compared ``whole``, as they do not split it."""
    pdf = pdf.sort_values("k")
    x, size, parts = _unit(pdf), int(pdf["size"].iloc[0]), int(pdf["parts"].iloc[0])
    dist = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x.T)))
    taken: list[int] = []
    for i in range(len(x)):
        if len(taken) < parts and (dist[i, taken] >= APART * np.sqrt(2 - 2 * THRESHOLD)).all():
            taken.append(i)
    rest = np.setdiff1d(np.arange(len(x)), taken)
    d = dist[rest][:, taken]
    joins = d <= d.min(1, keepdims=True) + _margin(x.shape[1])
    whole = len(taken) < 2 or not len(rest) or bool((joins.mean(0) ** 2).sum() > 0.5) or joins.sum(1).mean() > max(OVERLAP, size / WHOLE)
    return pd.DataFrame({"_c": [pdf["cell"].iloc[0]], "marks": [[v.tolist() for v in x[taken]]], "whole": [bool(whole)]})


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of cells that are split, with their cell's centroids -> child cells."""
    for batch in batches:
        out = []
        for cell, node, v, marks in zip(*[batch.column(c).to_pylist() for c in ("cell", "node", "v", "marks")]):
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (np.asarray(marks) @ np.asarray(v))))
            least = d.min()
            out += [(f"{cell}.{k:02d}", node, v) for k in np.flatnonzero(d <= least + _margin(len(v)))]
        yield pa.record_batch([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()),
                               pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["cell", "node", "v"])


def shards(vectors: DataFrame) -> DataFrame:
    """``cell``, ``node``, ``whole``: overlapping cells of about SHARD vectors,
    and larger ones to be compared whole.

    Cells start as labels. A cell that is too large is split by centroids,
    which are at most SPLIT of its vectors (a bounded sample, lowest hashes),
    level by level; every vector stays in at least one cell. Cells that do not
    split (_marks), or are too large after DEPTH levels, are left whole."""
    cells = vectors.select(F.col("label").cast("string").alias("cell"), "node", "v")
    done = None
    for level in range(DEPTH + 1):
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
        large = keep(sizes.where(F.col("size") > SHARD).select(
            F.col("cell").alias("_cell"), "size", F.least(F.lit(SPLIT), F.ceil(2.5 * F.col("size") / SHARD)).alias("parts")), "graph-large")
        if large.isEmpty():
            break
        big = cells.join(large, F.col("cell") == F.col("_cell")).drop("_cell")
        small = cells.join(large, F.col("cell") == F.col("_cell"), "left_anti")
        order = Window.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(level)), "node")
        sample = big.withColumn("k", F.row_number().over(order)).where(f"k <= {SAMPLE}")
        marks = keep(sample.groupBy("cell").applyInPandas(_marks, "_c string, marks array<array<double>>, whole boolean")
                     .withColumn("whole", F.col("whole") | F.lit(level == DEPTH)), "graph-marks")
        big = big.drop("size", "parts").join(marks, F.col("cell") == F.col("_c")).drop("_c")
        split = big.where("NOT whole").drop("whole").mapInArrow(_assign, "cell string, node long, v array<double>")
        out = small.select("cell", "node", F.lit(False).alias("whole")).unionByName(big.where("whole").select("cell", "node", "whole"))
        out = keep(out, "graph-done")
        done = out if done is None else done.unionByName(out)
        cells = keep(split, "graph-cells")
    last = cells.select("cell", "node", F.lit(False).alias("whole"))
    return last if done is None else done.unionByName(last)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, ``n_links`` (other vectors of its label with
    cosine >= THRESHOLD that were found), ``component_id`` (smallest id
    reachable by links, itself included) and ``kept`` (id = component_id).

    Vectors that are NULL, empty, zero, or hold NULL or non-finite numbers,
    and rows without label or id, link with nothing; vectors of other lengths
    than their label's usual one are compared with their own length only.
    Equal vectors of a label are one class with a count. Repeated rows link
    each other. Every link is verified; some may not be found (``audit``),
    none of a cell that is compared whole.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) > 0)
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), v.alias("raw"),
                          F.coalesce(fine & F.col(label_col).isNotNull() & F.col(id_col).isNotNull(), F.lit(False)).alias("fine"))
    rows = rows.withColumn("node", F.when(F.col("fine"), F.xxhash64("_label", "raw")))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    classes = keep(rows.where("fine").groupBy("node", "_label", "raw").agg(F.count(F.lit(1)).alias("times"), F.min("_id").alias("head"))
                   .withColumn("norm", norm).select("node", F.concat_ws("x", F.col("_label").cast("string"), F.size("raw")).alias("label"), "raw",
                           F.expr("transform(raw, x -> x / norm)").alias("v"), "times", "head"), "graph-classes")
    cells = shards(classes)
    split = cells.where("NOT whole").drop("whole").join(classes.select("node", "v"), "node")
    graph = split.groupBy("cell").applyInPandas(_graph, "node long, near array<long>")
    graph = keep(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph-lists")
    where = cells.groupBy("node").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    given = where.join(classes.select("node", "raw", "times"), "node")
    found = (split.join(graph, "node").join(given, "node").groupBy("cell").applyInPandas(_search, "node long, links long, root long")
             .unionByName(compare_whole(cells.where("whole").select("cell", "node").join(given, "node"))))
    found = keep(found, "graph-found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    label = keep(classes.select("node", "head", "times").join(comp, "node", "left").join(links, "node", "left")
                 .select("node", "head", F.coalesce("component", "node").alias("comp"),
                         (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")), "graph-labels")
    low = keep(label.groupBy("comp").agg(F.min("head").alias("component_id")), "graph-low")
    named = keep(label.join(low, "comp").select(F.col("node").alias("_node"), "n_links", "component_id"), "graph-named")
    some = (rows.where("fine").select("_id", "node").join(named, F.col("node") == F.col("_node"))
            .select(F.col("_id").alias(id_col), "n_links", "component_id"))
    none = rows.where("NOT fine").select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _brute(sent, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {k: (np.array([i for i, _ in r]), np.array([v for _, v in r], np.float64)) for k, r in sent.value.items()}
        for batch in batches:
            got: dict[int, int] = {}
            by: dict[object, list] = {}
            for label, v in zip(batch.column("_label").to_pylist(), batch.column("raw").to_pylist()):
                by.setdefault((label, len(v)), []).append(v)
            for k, rows in by.items():
                if k in queries:
                    ids, q = queries[k]
                    x = np.array(rows, np.float64)
                    cos = (q @ x.T) / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :]
                    for i, c in zip(ids.tolist(), (cos >= threshold).sum(1).tolist()):
                        got[i] = got.get(i, 0) + c
            yield pa.record_batch([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], ["id", "n"])

    return run


def audit(vectors: DataFrame, result: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
          every: int = 20, block: int = 2000) -> float:
    """Recall of the links: vectors whose id is divisible by ``every`` against
    all rows by brute force, in blocks of at most ``block`` queries."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), v.alias("raw")).where(
        F.col("_label").isNotNull() & ~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & (F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x) > 0))
    queries = rows.where(F.col("_id") % every == 0)
    blocks = max(1, -(-queries.count() // block))
    there = seen = 0
    for b in range(blocks):
        part = queries.where(F.expr(f"pmod(xxhash64(_id), {blocks}) = {b}")).collect()
        by: dict[object, list] = {}
        for r in part:
            by.setdefault((r["_label"], len(r["raw"])), []).append((r["_id"], r["raw"]))
        sent = vectors.sparkSession.sparkContext.broadcast(by)
        true = rows.mapInArrow(_brute(sent, THRESHOLD), "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("n"))
        got = true.join(result.select(F.col(id_col).alias("id"), "n_links"), "id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
        there, seen = there + (got[0] or 0), seen + (got[1] or 0)
    return seen / there if there else 1.0


def op10_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
