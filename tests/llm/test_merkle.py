"""Operator 13 against trees built level by level, and its log against a plain postorder walk."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.llm import op13_merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx string, tree int, root string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(lv, j):
    for x in lv[:-1]:
        run = x[j - j % 3:j - j % 3 + 3]
        yield "".join(run[:j % 3]), "".join(run[j % 3 + 1:])
        j //= 3


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[k] = levels([leaf_of(r, r[1]) for r in groups[k]])
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for t, k in enumerate(keys):
        for j, r in enumerate(groups[k]):
            p = [*path(trees[k], j), *path(top, t)]
            fold = leaf_of(r, r[1])
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                fold = leaf_of(r, r[1].replace("\n", ""))
            for b, a in p:
                fold = digest(b + fold + a)
            out.append((r[0], trees[k][0][j], trees[k][-1][0], top[-1][0], digest("".join(b + a for b, a in p)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    proof = F.sha2(F.array_join(F.zip_with("before", "after", lambda b, a: F.concat(b, a)), ""), 256)
    return sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified").collect()], key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 82])
def test_positions_are_those_of_a_postorder_walk(n):
    walk = []

    def visit(level, j):
        if level:
            for c in range(3 * j, min(3 * j + 3, -(-n // 3 ** (level - 1)))):
                visit(level - 1, c)
        walk.append((level, j))
    visit(M.height(n), 0)
    assert [int(M.positions(l, np.array([j]), n)[0]) for l, j in walk] == list(range(len(walk)))
    logged = M._append(0, [digest(str(i)) for i in range(n)], 0, n, M.height(n))
    assert [x[:2] for x in logged] == walk


def test_nulls_empty_texts_ties_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_LEVELS", 2)  # several rounds on few rows
    rows = [(i, f"line {i}\nmore" if i % 2 else "no feed", "en", "hot" if i % 3 else f"s{i % 7}", i) for i in range(150)]
    rows += [(None, "a\nb", None, None, None), (None, "a\nb", None, None, None), (None, None, "de", "hot", 3), (5, "x\n" * 5000, "en", "hot", 1),
             (5, "", "en", "hot", 1), (6, None, None, "é", None), (7, "ü\n", "fr", "Z", 2), (8, "\n", "fr", "only", 2), (8, "\n", "fr", "only", 2)]
    df = spark.createDataFrame([(*r, "clash", "clash", 9, "clash") for r in rows], SCHEMA).repartition(5)
    assert rows_of(M.manifest_proofs(df)) == brute(rows)


def test_one_row_and_no_row(spark):
    one = [(3, "t\n", "en", None, 1)]
    df = spark.createDataFrame([(*r, "a", "b", 1, "c") for r in one], SCHEMA)
    assert rows_of(M.manifest_proofs(df)) == brute(one)
    empty = M.manifest_proofs(df.where("false"))
    assert empty.count() == 0 and rows_of(empty) == []


def test_log_is_whole_and_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_LEVELS", 1)
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 60, "a").otherwise("b").alias("source"),
                                 F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    m = M.build(df)
    for tree, n in ((0, 60), (1, 40), (-1, 2)):
        got = [r[0] for r in m.log.where(F.col("tree") == tree).orderBy("position").select("position").collect()]
        nodes, w = n, n
        while w > 1:
            w = -(-w // 3)
            nodes += w
        assert got == list(range(nodes))
    proofs = M.prove(m)
    bad = proofs.where(M.folded(F.col("c_2"), F.col("before"), F.col("after")) != F.col("root"))
    assert proofs.count() == 100 and bad.isEmpty()


def test_query_equals_its_twin(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_small}/documents.parquet')")
    twin = con.execute(M.OP13_SQL)
    names = [c[0] for c in twin.description]
    got = M.op13_merkle_manifest(spark, sf_small).select(*names)
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(twin.fetchall(), key=str)
