"""Parity-sketch join, suffix-array dedup, flat graph and the pipeline."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import brute_components, brute_repeats, closure, shingles
from test_text_ops import DOCS, EDGE, clashing
from triagelake.llm import op4_parity as o4
from triagelake.llm import op6_suffix as o6
from triagelake.llm import op10_graph as o10
from triagelake.llm.common import components
from triagelake.llm.shingles import WordHasher, shingle_sets


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    para = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [para(rng.choice([3, 5, 9, 20, 60, 200, 400])) for _ in range(50)]
    texts = list(base)
    for b in base:
        for _ in range(rng.choice([0, 1, 3])):
            w = b.split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    passage = para(60)
    texts += [para(30) + " " + passage + " " + para(rng.randint(1, 50)) for _ in range(20)]
    texts += [None, "", "  \n", base[0], base[0].upper(), "a", "a", "a b c", "a b c"]
    texts += ["ab" * 300, "x" * 230, "x" * 199, "é" * 150 + para(10), "é" * 150 + para(12), para(5000)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)


# ---- components ------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 220)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = closure(range(300), links)
    assert got == {i: low[i] for e in links if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- parity-sketch join ------------------------------------------------------------

def test_word_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    from triagelake.llm import shingles as sh

    text = ("alpha  beta\tgamma \x0b" * 40 + "delta" * 50 + " end").encode()
    whole = WordHasher().words(text)
    monkeypatch.setattr(sh, "PIECE", 37)
    cut = WordHasher().words(text)
    assert (whole[0] == cut[0]).all()
    by = {}
    for s, h in zip(*map(list, cut)):
        by.setdefault(text[s:].split()[0], set()).add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_shingle_sets_are_the_sets():
    texts = [(t or "").encode() if t is not None else None for _, t in corpus()]
    for n in (4, 5):
        for t, s in zip(texts, shingle_sets(WordHasher(), texts, n)):
            assert len(s) == len(shingles(t.decode() if t else t, n))


@pytest.mark.parametrize("num, den", [(85, 100), (80, 100)])
def test_pigeonhole_and_sketches_lose_no_link(num, den):
    rng = np.random.default_rng(1)
    bands = o4.Bands(num, den)
    for size in [5, 8, 12, 13, 30, 99, 400, 1500]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            drop = rng.integers(0, size // 5 + 1)
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, rng.integers(0, size // 5 + 1), np.uint64))))
            common = len(np.intersect1d(a, b))
            if den * common < num * (len(a) + len(b) - common) or common == len(a) == len(b):
                continue
            assert len(np.intersect1d(o4.join_keys(a, bands), o4.join_keys(b, bands)))
            sa, sb = (np.frombuffer(o4.bit_sketch(x), np.uint8) for x in (a, b))
            assert o4.may_link(bands, len(a), sa, len(b), sb)


@pytest.mark.parametrize("block", [2048, 3])
def test_links_match_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(o4, "GROUP_BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in o4.link_components(clashing(docs), 4, 85, 100).collect()}
    assert got == brute_components(corpus(), 4, 85, 100)


def test_one_per_group(spark, docs):
    want = brute_components(corpus(), 5, 80, 100)
    twice = docs.union(docs.where("doc_id IN (0, 1, 2)"))
    got = sorted(r.doc_id for r in o4.one_per_group(twice).collect())
    assert got == sorted(i for i, (_, c) in want.items() if i == c)


def test_one_id_with_two_unlinked_texts(spark):
    a, b = (" ".join(f"{w}{k}" for k in range(40)) for w in "ab")
    rows = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in o4.one_per_group(rows).collect()) == [(1, a), (1, b)]


def test_links_edges(spark):
    edge = clashing(spark.createDataFrame(EDGE, DOCS))
    got = o4.link_components(edge).collect()
    assert len(got) == len(EDGE)
    assert all(r.component_id == r.doc_id for r in got if r.doc_id is not None)
    assert {r.n_shingles for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert o4.link_components(edge.limit(0)).count() == 0


# ---- suffix array ------------------------------------------------------------------

def test_suffix_ranks_sort_all_suffixes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 5, 50, 300):
        for top in (1, 2, 4):
            s = rng.integers(1, top + 1, n)
            rank = o6.suffix_ranks(s.astype(np.int64), top, 10 ** 9)
            want = sorted(range(n), key=lambda i: s[i:].tolist())
            assert np.argsort(rank).tolist() == want


def suffix_query(spark, monkeypatch, df):
    monkeypatch.setattr(o6, "read", lambda *a: df.select("doc_id", "text"))
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in o6.op6_suffix_dedup(spark, "").collect()}


@pytest.mark.parametrize("hot, held", [(1024, 1 << 20), (3, 1000)])
def test_repeats_match_brute_force(spark, docs, monkeypatch, hot, held):
    monkeypatch.setattr(o6, "HOT_RUNS", hot)
    monkeypatch.setattr(o6, "SORT_BYTES", held)
    assert suffix_query(spark, monkeypatch, clashing(docs)) == brute_repeats(corpus())


def test_repeats_edges(spark, monkeypatch):
    edge = spark.createDataFrame([r for r in EDGE if r[0] is not None], DOCS)
    got = suffix_query(spark, monkeypatch, edge)
    assert got[5][:3] == (150_000, 150_000, 1) and got[1][:3] == (0, 0, 0) and got[4][1] == 0
    long = spark.createDataFrame([(1, "q" * 10 + "z" * 0 + "abc" * 80), (1, "q" * 10 + "abc" * 80), (None, "t" * 5 + "abc" * 80)], "doc_id long, text string")
    assert len(o6.repeated_spans(long).collect()) == 3
    assert o6.without_repeats(clashing(edge)).count() == edge.count()
    assert o6.without_repeats(edge.limit(0)).count() == 0


# ---- flat graph --------------------------------------------------------------------

def test_graph_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(o10, "SHARD", 300)
    rng = np.random.default_rng(0)
    v = []
    for label in range(3):
        c = rng.normal(size=(1200 if label == 0 else 150, 16))
        for k in range(60):
            c[-k - 1] = c[k] + rng.normal(size=16) * rng.choice([0, 0.02, 0.05, 0.3])
        v += [(x.astype(np.float32).tolist(), label) for x in c]
    v += [(None, 0), ([0.0] * 16, 0), ([float("nan")] * 16, 1), ([float("inf")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1), ([], 1),
          (v[0][0], None), ([1.0, 2.0], 1), ([1.0, 2.0], 1)]
    table = clashing(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(v)], "vec_id long, embedding array<float>, label int"))
    result = o10.near_duplicates(table)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in result.collect()}
    n, good = len(v), len(v) - 9
    x, label = np.array([a for a, _ in v[:good]]), np.array([b for _, b in v[:good]])
    x = x / np.sqrt((x * x).sum(1))[:, None]
    near = (x @ x.T >= o10.THRESHOLD) & (label[:, None] == label[None])
    links = [(a, b) for a, b in zip(*map(list, np.nonzero(near))) if a < b] + [(n - 2, n - 1)]
    low = closure(range(n), links)
    degree = dict.fromkeys(range(n), 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    found = sum(min(got[i][0], degree[i]) for i in got) / sum(degree.values())
    assert found >= 0.97 and len(got) == n
    assert all(got[i][0] <= degree[i] and low[got[i][1]] == low[i] and got[i][2] == (got[i][1] == i) for i in got)
    assert o10.audit(table, result, every=1) >= 0.97
    assert o10.near_duplicates(table.limit(0)).count() == 0


def test_pruned_graph_is_searchable():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    lists = o10.robust_prune(x @ x.T)
    found = o10.range_search(x, lists, np.arange(300), 0.9)
    want = (x @ x.T >= 0.9) & ~np.eye(300, dtype=bool)
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()


def test_pair_missed_in_its_first_shard_is_counted(monkeypatch):
    real = o10.range_search
    monkeypatch.setattr(o10, "range_search", lambda x, lists, queries, least: (
        real(x, lists, queries, least) if len(x) == 3 else np.zeros((len(queries), len(x)), bool)))
    x = [np.array(v) / np.linalg.norm(v) for v in ([1, 0, 0], [1, 0.1, 0], [0, 1, 0], [0, 0, 1.0])]

    def shard(cell, nodes):
        return pd.DataFrame({"cell": cell, "node": nodes, "v": [x[i] for i in nodes], "raw": [x[i] for i in nodes], "times": 1,
                             "near": [[j for j in nodes if j != i] for i in nodes],
                             "cells": [["a", "b"] if i < 2 else ["a"] if i == 2 or cell == "a" else ["b"] for i in nodes]})

    both = pd.concat([o10._search(shard("a", [0, 1, 2, 3])), o10._search(shard("b", [0, 1, 3]))])
    assert both.groupby("node")["links"].sum().to_dict() == {0: 1, 1: 1, 2: 0, 3: 0}


@pytest.mark.parametrize("background", [0, 200])
def test_groups_larger_than_the_candidate_lists_are_reached(background):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=64) + 0.03 * rng.normal(size=(100, 64)) for _ in range(10)] + [rng.normal(size=(background, 64))])
    x /= np.sqrt((x * x).sum(1))[:, None]
    found = o10.range_search(x, o10.robust_prune(x @ x.T), np.arange(len(x)), o10.THRESHOLD)
    want = (x @ x.T >= o10.THRESHOLD) & ~np.eye(len(x), dtype=bool)
    assert want[:1000].sum() == 10 * 100 * 99 and (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_dense_group_larger_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(o10, "SHARD", 100)
    monkeypatch.setattr(o10, "WHOLE", 200)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=16) + 0.025 * rng.normal(size=(700, 16)), rng.normal(size=(300, 16))])
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    result = o10.near_duplicates(table).collect()
    x = x / np.sqrt((x * x).sum(1))[:, None]
    near = x @ x.T >= o10.THRESHOLD
    assert near[:700, :700].all()
    degree = near.sum(1) - 1
    assert all(r.n_links <= degree[r.vec_id] for r in result)
    assert all(r.n_links == degree[r.vec_id] and r.component_id == 0 for r in result if r.vec_id < 700)


# ---- pipeline ----------------------------------------------------------------------

def test_pipeline_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_small)
        if name == "source_mixing":
            assert {"doc_id", "text", "source", "copies", "copy", "target"} <= set(after.columns)
            break
        assert after.columns == corpus_pipeline.COLUMNS
        before, rows = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(rows) <= set(before)
        if name == "ngram_jaccard_join":
            want = brute_components([(i, r.text) for i, r in before.items()], 5, 80, 100)
            assert set(rows) == {i for i, (_, c) in want.items() if i == c}
        if name == "suffix_array_dedup":
            cut = brute_repeats([(i, r.text) for i, r in before.items()])
            assert set(rows) == set(before)
            assert all((rows[i].text == before[i].text) == (cut[i][1] == 0) for i in rows)
        docs = after
    assert sum(1 for _ in after.toLocalIterator()) > 100
