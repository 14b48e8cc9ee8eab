"""Waves, lots and products of the search where bounds hardly prune."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from triagelake.operators import cells as C
from triagelake.operators import vectors as V


def test_small_cells_that_all_queries_read_share_lots():
    """Queries of a part go to a lot of many cells once, not to each cell."""
    loads, counts = {c: 100_000 for c in range(800)}, {c: 128 for c in range(800)}
    lots, n = C.lots_of(loads, counts, 32768, 32768, None, 100_000)
    assert n == 4 * 4 and {x[1:] for x in lots.values()} == {(1, 4)}           # 4 of rows by 4 of queries, not 3,200
    loads, counts = {0: 5, 1: 70_000, 2: 5}, {0: 10, 1: 100_000, 2: 10}
    lots, n = C.lots_of(loads, counts, 32768, 32768, None, 70_000)
    assert lots[1][1:] == (4, 3) and lots[0] == lots[2] and n == 13


def test_products_hold_the_wanted_pairs_once():
    rng = np.random.default_rng(3)
    cell = rng.integers(0, 60, 2000)
    reads = rng.random((300, 60)) < 0.95
    reads[:, 40:] = rng.random((300, 20)) < 0.05
    reads[7] = False
    q = pd.DataFrame({"cells": [np.r_[np.flatnonzero(r), 99] for r in reads]})  # 99: a cell without rows here
    seen, products = np.zeros((300, 2000), np.int64), 0
    for qi, ci, wants in V._reads(q, pd.DataFrame({"cell": cell}), 16):
        here = np.ones((len(qi), len(ci)), bool) if wants is None else np.repeat(wants[0], wants[1], axis=1)
        seen[np.ix_(qi, ci)] += here
        products += 1
    assert (seen == reads[:, cell]).all()
    assert products < 40                                                      # not one per block of 16 rows


def test_bounds_are_worked_out_by_many_tasks(spark, monkeypatch):
    """One file of queries is not one task."""
    parts = []
    kept = C.keep_table

    def keep(df, name):
        out = kept(df, name)
        if name == "wanted":
            parts.append(df.rdd.getNumPartitions())
        return out
    monkeypatch.setattr(C, "keep_table", keep)
    monkeypatch.setattr(C, "BOUND_NUMBERS", 500)
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, embedding array<double>").coalesce(1)
    work = C.Work()
    got = V.topk_search(df.withColumnRenamed("id", "qid"), df, 3, c_block_rows=40, q_block_rows=32, work=work).collect()
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    order = np.lexsort((np.broadcast_to(np.arange(400), (400, 400)), -np.round(unit @ unit.T, 4)), axis=1)
    assert {(r["qid"], r["rank"]): r["id"] for r in got} == {(i, r + 1): int(order[i, r]) for i in range(400) for r in range(3)}
    assert len(parts) == len(work.waves) == 2 and min(parts) > 1


def test_pairs_left_for_more_waves_are_found(spark, monkeypatch):
    """Waves without a last one that reads everything: no cell twice, none missed."""
    monkeypatch.setattr(C, "PAIRS_AT_ONCE", 0)
    monkeypatch.setattr(C, "WAVE_FACTOR", 2)
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, embedding array<double>")
    work = C.Work()
    got = V.topk_search(df.withColumnRenamed("id", "qid"), df, 290, c_block_rows=20, work=work).collect()
    assert len(got) == 300 * 290 == len({(r["qid"], r["id"]) for r in got}) and len(work.waves) >= 4
    assert work.scored == work.pairs


def _few_of_many(spark, rng):
    """A corpus of 60 cells of 20 rows, and of each cell two rows (some of zeros)."""
    centres = rng.normal(size=(60, 8))
    vecs = np.repeat(centres, 20, axis=0) + 0.2 * rng.normal(size=(1200, 8))
    vecs[::97] = 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    return vecs, C.deal(df, ("vec",), None, 20)


def test_cells_left_with_few_rows_are_merged(spark):
    """To bound a cell costs more than to score the few rows it has left."""
    vecs, dealt = _few_of_many(spark, np.random.default_rng(8))
    some = C.narrowed(dealt, dealt.rows.where("id % 10 = 0 OR id % 97 = 0"))
    assert len(dealt.numbers) > 40 and len(some.numbers) <= -(-some.counts.sum() // 20) + 1
    got = {r["id"]: r["cell"] for r in some.rows.collect()}
    assert sorted(got) == [i for i in range(1200) if i % 10 == 0 or i % 97 == 0]
    assert {int(n): int(c) for n, c in zip(some.numbers, some.counts)} == pd.Series(got).value_counts().to_dict()
    unit = C.unit_rows(vecs)
    q = C.unit_rows(np.vstack([np.random.default_rng(9).normal(size=(50, 8)), np.zeros((1, 8)), vecs[:50]]))
    upper = pd.DataFrame(some.bounds(q), columns=some.numbers)
    for i, cell in got.items():
        assert (q @ unit[i] <= upper[cell]).all()


def test_merged_cells_hold_the_best_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "PAIRS_AT_ONCE", 0)
    vecs, dealt = _few_of_many(spark, np.random.default_rng(10))
    rows = dealt.rows.where("id % 10 = 0 OR id % 97 = 0").union(dealt.rows.where("id % 20 = 0").withColumn("id", F.col("id") + 5000))
    q = dealt.rows.where("id % 7 = 0").select(F.col("id").alias("qid"), F.lit(9).alias("k"), "vec")
    got = V.search_dealt(q, replace(dealt, rows=rows)).collect()
    ids = np.array(sorted(r["id"] for r in rows.collect()))
    unit = C.unit_rows(vecs)
    for i in range(0, 1200, 7):
        s = np.round(unit[ids % 5000] @ unit[i], 4)
        order = np.lexsort((ids, -s))[:9]
        assert [r["id"] for r in sorted((r for r in got if r["qid"] == i), key=lambda r: r["rank"])] == ids[order].tolist()


def test_pairs_of_a_product_hold_each_rows_best():
    rng = np.random.default_rng(12)
    s = np.where(rng.random((70, 900)) < 0.2, -np.inf, rng.random((70, 900)) - 0.3).astype(np.float32)
    s[3] = -np.inf
    k = rng.integers(1, 9, 70)
    for least in (np.full(70, -np.inf), np.full(70, 0.0), np.where(np.arange(70) % 2, 0.65, -np.inf)):
        for positive in (False, True):
            r, at = V._block_pairs(s, k, least, positive)
            got = set(zip(r.tolist(), at.tolist()))
            assert len(got) == len(r) < 70 * 100 and np.isfinite(s[r, at]).all() and (not positive or (s[r, at] > 0).all())
            for i in range(70):
                best = [j for j in np.argsort(-s[i])[:k[i]] if s[i, j] > -np.inf and s[i, j] >= least[i] and (not positive or s[i, j] > 0)]
                assert {(i, j) for j in best} <= got
