"""Operator 11 against plain distances, on whole numbers of any size."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.llm import op11_vptree as V

SCHEMA = "vec_id long, embedding array<double>, cluster int, x string, distance string, n int"


def brute(rows, k, rounds, dim):
    """[(vec_id, cluster, distance)] and centroids, in Python integers."""
    fine = [(i, [math.floor(64 * c) if abs(c) < 1e15 else int(c) * 64 for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    seed = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in fine)
    cent = [v for _, v in seed[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        at = [place(v)[1] for _, v in fine]
        for n in range(len(cent)):
            mine = [v for (_, v), a in zip(fine, at) if a == n]
            if mine:
                cent[n] = [sum(col) // len(mine) for col in zip(*mine)]
    out = []
    for i, v in fine:
        d, n = place(v)
        out.append((i, n, d if d < 1 << 63 else None))
    return sorted(out, key=str), cent


def run(spark, rows, k, rounds, dim):
    df = spark.createDataFrame([(i, v, 7, "clash", "clash", 7) for i, v in rows], SCHEMA).repartition(5)
    got, cent = V.cluster(df, k, rounds, dim=dim)
    return sorted([tuple(r) for r in got.select("vec_id", "cluster", "distance").collect()], key=str), cent


@pytest.mark.parametrize("k", [1, 2, 3, 4, 7, 16, 64])
def test_tree_finds_the_nearest_and_the_smaller_number(k):
    rng = np.random.default_rng(k)
    cent = rng.integers(-3, 4, (k, 3))  # many ties and repeated centroids
    x = rng.integers(-4, 5, (800, 3))
    at, dist, _ = V.nearest(V.plant(cent), cent, x)
    every = ((x[:, None] - cent[None]) ** 2).sum(-1)
    assert (at == every.argmin(1)).all() and (dist == every.min(1)).all()


def test_search_prunes():
    rng = np.random.default_rng(0)
    cent = rng.integers(-1000, 1000, (256, 2))
    x = rng.integers(-1000, 1000, (2000, 2))
    at, _, work = V.nearest(V.plant(cent), cent, x)
    assert (at == ((x[:, None] - cent[None]) ** 2).sum(-1).argmin(1)).all()
    assert work < 0.2 * len(x) * len(cent)


def test_rounds_nulls_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "ADD_ROWS", 2)  # several rounds of sums
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-40, 40, 4) / 64 + (0.001 if i % 2 else 0)).tolist()) for i in range(300)]
    rows += [(5, [0.5] * 4), (5, [0.5] * 4), (5, [-0.25] * 4), (None, [0.1] * 4), (900, None), (901, [0.1] * 3), (902, [0.1, None, 0.2, 0.3]),
             (903, [0.1, float("nan"), 0.2, 0.3]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    rows += [(1000 + i, [0.75, 0.75, 0.75, 0.75]) for i in range(200)]  # one vector in many rows
    want, cent = brute(rows, 6, 3, 4)
    got, got_cent = run(spark, rows, 6, 3, 4)
    assert got == want and got_cent == cent


def test_components_of_any_size(spark):
    rows = [(i, [float(i % 5), float(i % 3) * (1e6 if i % 4 else 1e18), -1e300 if i == 7 else 2.5]) for i in range(40)]
    want, cent = brute(rows, 4, 2, 3)
    got, got_cent = run(spark, rows, 4, 2, 3)
    assert got == want and got_cent == cent and any(d is None for _, _, d in got)


def test_few_and_no_vectors(spark):
    two = [(1, [0.1, 0.2]), (2, [0.3, -0.4])]
    assert run(spark, two, 16, 3, 2) == brute(two, 16, 3, 2)
    assert run(spark, [(1, None)], 16, 3, 2) == ([], [])
    same = [(i, [0.5, 0.5]) for i in range(20)]  # all first centroids are one: the smallest number takes all
    assert run(spark, same, 16, 3, 2) == brute(same, 16, 3, 2)


def test_query_equals_its_twin(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf_small}/embeddings.parquet')")
    twin = con.execute(V.OP11_SQL)
    names = [c[0] for c in twin.description]
    got = V.op11_vp_clusters(spark, sf_small).select(*names)
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(twin.fetchall(), key=str)
    assert got.where(F.col("cluster_inertia") > F.col("inertia")).isEmpty()
