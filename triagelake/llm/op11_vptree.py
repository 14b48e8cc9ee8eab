"""Operator 11: centroid clustering with a vantage-point tree over centroids.

Lloyd rounds on integer vectors. Every round builds a vantage-point tree over
the k centroids on the driver and sends it with the tasks (k centroids, a
parameter). A task searches its vectors best first, branch and bound: all
vectors of a slice step together, each expanding its own most promising node
until no open node's bound can reach its best distance. Distances at nodes and
leaves are exact integers; bounds are floats that are widened before they
prune, and prune only what is strictly farther, so that of equally near
centroids the smallest number wins.

Tasks return one row of exact sums per cluster they met; these are added up in
groups of ADD_ROWS rows, so no group grows with the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, read

DIM = 64
K = 16
ROUNDS = 3
#: Components are floor(SCALE * x).
SCALE = 64
#: Centroids of a leaf.
LEAF = 3
#: Vectors that step together; times the tree's nodes, the size of the bounds.
LANES = 2048
#: Rows of sums that one group adds up.
ADD_ROWS = 256
#: Components below this size keep squared distances of 64 components in a long.
SMALL = 1 << 27

SUMS = "part long, cluster int, n long, sums array<string>"


# -- the tree ------------------------------------------------------------------------


@dataclass
class Tree:
    """Node i: its centroids (padded with -1), and per child its number and the
    range of distances of the child's centroids to the node's first one."""

    members: np.ndarray  # nodes x LEAF; inner nodes have one, the vantage point
    child: np.ndarray    # nodes x 2, -1: none
    near: np.ndarray     # nodes x 2, smallest distance to the vantage point
    far: np.ndarray      # nodes x 2, largest distance


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def _root(squared: np.ndarray) -> np.ndarray:
    """Square roots as floats; of integers beyond the floats, the largest float."""
    if squared.dtype != object:
        return np.sqrt(squared.astype(np.float64))
    one = lambda v: math.sqrt(v) if v < 1 << 1000 else float(min(math.isqrt(v), 10 ** 308))
    return np.array([one(int(v)) for v in squared], np.float64)


def plant(centroids: np.ndarray) -> Tree:
    """The tree over the rows of an integer matrix (int64, or Python integers)."""
    members, child, near, far = [], [], [], []

    def node(ids: np.ndarray) -> int:
        at = len(members)
        members.append(np.full(LEAF, -1, np.int64))
        for table, fill in ((child, -1), (near, 0.0), (far, 0.0)):
            table.append([fill, fill])
        if len(ids) <= LEAF:
            members[at][:len(ids)] = ids
            return at
        # the centroid farthest from the first one sees the others most unequally
        vantage = ids[int(np.argmax(_root(_squared(centroids[ids], centroids[ids[0]]))))]
        rest = ids[ids != vantage]
        d = _root(_squared(centroids[rest], centroids[vantage]))
        order = np.argsort(d, kind="stable")
        members[at][0] = vantage
        for side, part in enumerate(np.array_split(order, 2)):
            near[at][side], far[at][side] = d[part].min(), d[part].max()
            child[at][side] = node(rest[part])
        return at

    node(np.arange(len(centroids)))
    return Tree(np.array(members), np.array(child), np.array(near), np.array(far))


def nearest(tree: Tree, centroids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Per row of ``x`` the nearest centroid (ties: the smaller number), its
    exact squared distance, and the number of distances that were computed."""
    n, work = len(x), 0
    best = np.full(n, len(centroids), np.int64)
    dist = np.zeros(n, x.dtype)
    reach = np.full(n, np.inf)  # best distance so far, as a float
    bound = np.full((n, len(tree.members)), np.inf)
    bound[:, 0] = 0.0
    lanes = np.arange(n)
    while len(lanes):
        at = np.argmin(bound[lanes], axis=1)
        least = bound[lanes, at]
        # inclusive: a bound equal to the best distance may hide a tie
        go = np.isfinite(least) & (least <= reach[lanes])
        lanes, at = lanes[go], at[go]
        if not len(lanes):
            break
        bound[lanes, at] = np.inf
        to_vantage = None
        for slot in range(LEAF):
            c = tree.members[at, slot]
            has = c >= 0
            if not has.any():
                continue
            rows, c = lanes[has], c[has]
            d = _squared(x[rows], centroids[c])
            work += len(rows)
            fresh = best[rows] == len(centroids)
            better = fresh | (d < dist[rows]) | ((d == dist[rows]) & (c < best[rows]))
            won = rows[better]
            best[won], dist[won] = c[better], d[better]
            reach[won] = _root(d[better]) * (1 + 1e-9) + 1e-9
            if slot == 0:
                to_vantage = _root(d)  # every node has a first member
        for side in (0, 1):
            c = tree.child[at, side]
            has = c >= 0
            if has.any():
                v = to_vantage[has]
                low = np.maximum(v - tree.far[at[has], side], tree.near[at[has], side] - v)
                bound[lanes[has], c[has]] = np.maximum(low * (1 - 1e-9) - 1e-9, 0.0)
    return best, dist, work


# -- tasks --------------------------------------------------------------------------


def _integers(x: np.ndarray) -> np.ndarray:
    """floor(64 x) of doubles: int64, or Python integers if one is large."""
    if x.size == 0 or np.abs(x).max() < SMALL / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    whole = lambda v: int(v) * SCALE if abs(v) >= 1 << 53 else math.floor(v * SCALE)
    return np.array([[whole(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _as_matrix(centroids: list[list[int]], like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    small = like.dtype != object and all(abs(v) < SMALL for c in centroids for v in c)
    kind = np.int64 if small else object
    return np.array(centroids, kind), like.astype(kind)


def _assign(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], dim: int):
    trees: dict[np.dtype, tuple[np.ndarray, Tree]] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, LANES):
            part = batch.slice(start, LANES)
            raw = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            c, x = _as_matrix(centroids, _integers(raw))
            if c.dtype not in trees:
                trees[c.dtype] = (c, plant(c))
            yield part, x, *nearest(trees[c.dtype][1], c, x)[:2]


def _sums(centroids: list[list[int]], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for _, x, cluster, _ in _assign(batches, centroids, dim):
            for c in np.unique(cluster).tolist():
                of = x[cluster == c]
                n[c] = n.get(c, 0) + len(of)
                total[c] = total.get(c, 0) + of.sum(axis=0).astype(object)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part] * len(n), pa.int64()), "cluster": pa.array(list(n), pa.int32()), "n": pa.array(list(n.values()), pa.int64()),
            "sums": pa.array([[str(v) for v in total[c]] for c in n], pa.list_(pa.string()))})
    return run


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.array([[int(v) for v in s] for s in rows["sums"]], object).sum(axis=0)
    return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // ADD_ROWS], "cluster": [rows["cluster"].iloc[0]], "n": [rows["n"].sum()],
                         "sums": [[str(v) for v in total]]})


def _next(x: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """The centroids after one round: exact floors of the means."""
    sums = x.mapInArrow(_sums(centroids, dim), SUMS)
    parts = x.rdd.getNumPartitions()
    while True:  # ADD_ROWS rows to one, until a cluster has one row
        sums = sums.groupBy("cluster", F.floor(F.col("part") / ADD_ROWS).alias("_g")).applyInPandas(_add, SUMS)
        parts = -(-parts // ADD_ROWS)
        if parts <= 1:
            break
    out = [list(c) for c in centroids]
    for r in sums.collect():  # k rows
        out[r["cluster"]] = [int(v) // r["n"] for v in r["sums"]]
    return out


def _labels(centroids: list[list[int]], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, dist in _assign(batches, centroids, dim):
            far = [None if int(d) >= 1 << 63 else int(d) for d in dist] if dist.dtype == object else dist
            yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(far, pa.int64())})
    return run


# -- the operator ----------------------------------------------------------------------


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """vec_id and x (components as doubles) of the vectors with ``dim``
    components, none NULL or not finite."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(e))
    kept = vectors.where((F.size(vec_col) == dim) & finite)
    return kept.select(F.col(id_col).alias("vec_id"), v.alias("x"))


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, *, id_col: str = "vec_id", vec_col: str = "embedding",
            dim: int = DIM) -> tuple[DataFrame, list[list[int]]]:
    """Assignment of every kept vector after ``rounds`` rounds (vec_id, cluster,
    distance), as a written table, and the final centroids.

    The first centroids are the ``k`` kept vectors with the smallest SHA-256 of
    ``1:<id>``, ascending. Defined results: NULL vectors, those of another
    length and those with NULL, NaN or infinite components are not kept; rows
    of one id each take part (as first centroids ordered by their components);
    a NULL id counts as an empty text; fewer vectors than ``k`` give as many
    clusters as there are; an empty cluster keeps its centroid; an empty table
    gives no rows; other columns are not read. Sums and distances are exact for
    components of any size; a squared distance beyond a long is NULL.
    """
    spark = vectors.sparkSession
    x = keep(kept_vectors(vectors, id_col, vec_col, dim), "vp-vectors")
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = x.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centroids = [_integers(np.array(r["x"])).tolist() for r in first]
    schema = f"vec_id {x.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    if not centroids:
        return spark.createDataFrame([], schema), []
    for _ in range(rounds):
        centroids = _next(x, centroids, dim)
    return keep(x.mapInArrow(_labels(centroids, dim), schema), "vp-labels"), centroids


def op11_vp_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector with its cluster's and the whole inertia (NULL if a
    distance is NULL or the sum is beyond a long)."""
    rows, centroids = cluster(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(whole.alias("s")).collect()}  # at most k rows
    as_long = lambda v: int(v) if v is not None and v < 1 << 63 else None
    total = None if None in per.values() else as_long(sum(per.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    table = [(c, as_long(s), total, digest(c)) for c, s in per.items()]
    table = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql_rounds() -> str:
    """Twin: every distance to every centroid, round by round."""
    squared = "list_sum(list_transform(generate_series(1, len(v)), lambda i: (v[i] - x[i]) * (v[i] - x[i])))"
    ctes = [f"vec as materialized (select vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::double)::bigint) as v from embeddings "
            f"where len(embedding) = {DIM} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {DIM})",
            "c0 as materialized (select row_number() over (order by h, v) - 1 as c, v as x from "
            f"(select sha256('1:' || coalesce(vec_id::varchar, '')) as h, v from vec order by h, v limit {K}))"]
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} as materialized (select vec_id, v, min(struct_pack(d := {squared}::bigint, c := c)) as b from (select row_number() over () as n, * from vec), c{r} group by n, vec_id, v)")
        if r < ROUNDS:
            ctes.append(f"s{r} as (select c, list(f order by i) as x from (select c, i, ((s - ((s % n) + n) % n) // n)::bigint as f from "
                        f"(select b.c as c, i, sum(v[i]) as s, count(*) as n from a{r}, generate_series(1, {DIM}) g(i) group by b.c, i)) group by c)")
            ctes.append(f"c{r + 1} as materialized (select c{r}.c, coalesce(s{r}.x, c{r}.x) as x from c{r} left join s{r} on s{r}.c = c{r}.c)")
    return "with " + ",\n".join(ctes) + f"""
select vec_id, a.b.c::integer as cluster, a.b.d as distance, (sum(a.b.d) over (partition by a.b.c))::bigint as cluster_inertia, (sum(a.b.d) over ())::bigint as inertia,
       sha256(array_to_string(f.x, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} f on f.c = a.b.c"""


OP11_SQL = _sql_rounds()
