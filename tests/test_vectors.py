"""Top-k search and the hashing encoder against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import vectors as V
from triagelake.sources.tables import read_table


def brute_topk(qs, cs, k, exclude_self=False, min_score=None):
    out = {}
    for qid, qv in qs.items():
        qv = np.asarray(qv, float)
        qn = np.linalg.norm(qv) or 1.0
        cand = []
        for cid, cv in cs.items():
            if exclude_self and cid == qid:
                continue
            cv = np.asarray(cv, float)
            cn = np.linalg.norm(cv) or 1.0
            s = float(qv @ cv) / (qn * cn)
            if min_score is not None and not s > min_score:
                continue
            cand.append((-round(s, 4), cid, s))
        cand.sort()
        out[qid] = [(c[1], c[2]) for c in cand[:k]]
    return out


def run_topk(spark, q, c, k, **kw):
    qdf = spark.createDataFrame([(i, list(map(float, v))) for i, v in q.items()], "qid long, embedding array<double>")
    cdf = spark.createDataFrame([(i, list(map(float, v))) for i, v in c.items()], "id long, embedding array<double>")
    rows = V.topk_search(qdf, cdf, k, **kw).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))
    return got


@pytest.mark.parametrize("blocks", [(1, 1), (3, 2), (5, 7)])
def test_topk_matches_brute_force(spark, sf_small, blocks):
    e = read_table(spark, sf_small, "embeddings").select("vec_id", "embedding").collect()
    vecs = {r[0]: r[1] for r in e}
    q = {i: vecs[i] for i in list(vecs)[:60]}
    got = run_topk(spark, q, vecs, 5, q_blocks=blocks[0], c_blocks=blocks[1])
    exp = brute_topk(q, vecs, 5)
    assert set(got) == set(exp)
    for qid in exp:
        assert [g[0] for g in got[qid]] == [x[0] for x in exp[qid]]
        assert np.allclose([g[1] for g in got[qid]], [x[1] for x in exp[qid]])


def test_k_larger_than_corpus_and_zero_vector(spark):
    c = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.0, 0.0]}
    q = {10: [1.0, 1.0], 11: [0.0, 0.0]}
    got = run_topk(spark, q, c, 10)
    assert [x[0] for x in got[10]] == [1, 2, 3]          # fewer rows, never padded
    assert got[10][2][1] == 0.0                          # zero vector scores 0
    assert all(s == 0.0 for _, s in got[11])


def test_self_exclusion_by_identity_with_duplicates(spark):
    c = {1: [1.0, 0.0], 2: [1.0, 0.0], 3: [0.6, 0.8]}
    got = run_topk(spark, {1: c[1], 2: c[2]}, c, 1, exclude_self=True)
    assert got[1][0][0] == 2 and got[2][0][0] == 1       # the duplicate stays, only self goes


def test_ties_broken_by_id(spark):
    c = {5: [1.0, 0.0], 3: [1.0, 0.0], 4: [1.0, 0.00001]}
    got = run_topk(spark, {1: [1.0, 0.0]}, c, 3)
    assert [x[0] for x in got[1]] == [3, 4, 5]           # equal at 4 places -> by id


def test_per_query_k(spark):
    c = {i: [float(i), 1.0] for i in range(1, 8)}
    qdf = spark.createDataFrame([(1, [1.0, 0.0], 2), (2, [0.0, 1.0], None), (3, [1.0, 1.0], 0)],
                                "qid long, embedding array<double>, k int")
    cdf = spark.createDataFrame([(i, v) for i, v in c.items()], "id long, embedding array<double>")
    rows = V.topk_search(qdf, cdf, 5, k_col="k").collect()
    n = {}
    for r in rows:
        n[r["qid"]] = n.get(r["qid"], 0) + 1
    assert n == {1: 2, 2: 5}


def test_invariants_on_table(spark, sf_small):
    e = read_table(spark, sf_small, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    c = read_table(spark, sf_small, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = V.topk_search(e, c, 4, c_blocks=3).collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r["qid"], []).append(r)
    for rs in by_q.values():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1)) and len(rs) <= 4
        sc = [round(r["score"], 4) for r in rs]
        assert sc == sorted(sc, reverse=True)


def _py_hash_vector(text, dim=64):
    toks = re.findall(r"[^\W_]+", (text or "").lower())
    counts = np.zeros(dim)
    for t in toks:
        counts[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] += 1
    n = np.linalg.norm(counts)
    return counts / n if n else None


def test_hash_embed_matches_python(spark):
    texts = {1: "VPN login fails for Customer#000000012", 2: "Écran noir, ÉTÉ été 42!", 3: "   ", 4: None,
             5: "order order ORDER fallout"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in V.hash_embed(df, "id", "text").collect()}
    assert set(got) == {1, 2, 5}                         # no tokens -> no vector
    for i, v in got.items():
        assert np.allclose(v, _py_hash_vector(texts[i]))
        assert abs(np.linalg.norm(v) - 1) < 1e-12


def test_l2_normalize_keeps_zero(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, embedding array<double>")
    got = {r["id"]: r["embedding"] for r in V.l2_normalize(V.with_norm(df)).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0]


def test_attach_metadata_defaults(spark):
    top = spark.createDataFrame([(1, 1, 7, 0.123456), (1, 2, 8, 0.1)], "qid long, rank int, id long, score double")
    meta = spark.createDataFrame([(7, "src1", "x" * 900)], "id long, source string, training_text string")
    rows = {r["rank"]: r for r in V.attach_metadata(top, meta, text_chars=500).collect()}
    assert rows[1]["similarity_score"] == 0.1235 and len(rows[1]["training_text"]) == 500
    assert rows[1]["assignment_group"] == "Not Provided"
    assert rows[2]["id"] == "record_8" and rows[2]["source"] == "unknown"
    snip = {r["rank"]: r for r in V.attach_metadata(top, meta, mode="snippet", text_chars=200).collect()}
    assert max(len(r["training_text"]) for r in V.attach_metadata(top, meta).collect()) == 900
    assert len(snip[1]["snippet"]) == 200 and snip[2]["id"] == "" and snip[1]["score"] == 0.123456


def test_tie_flood_keeps_smallest_ids(spark):
    # 3,000 identical corpus vectors: every one ties; the k smallest ids win
    c = {i: [1.0, 0.0, 0.0] for i in range(3000, 0, -1)}
    c[5000] = [0.0, 1.0, 0.0]
    got = run_topk(spark, {1: [1.0, 0.0, 0.0], 2: [0.0, 1.0, 0.0]}, c, 3, c_blocks=4)
    assert [x[0] for x in got[1]] == [1, 2, 3]
    assert got[2][0][0] == 5000 and [x[0] for x in got[2][1:]] == [1, 2]


def test_local_cut_is_bounded_and_exact():
    import numpy as np
    r = np.zeros(1000, dtype=np.int64)
    cidx = np.arange(1000)
    exact = np.full(1000, 0.7)
    exact[500] = 0.71
    crank = np.arange(1000)[::-1].copy()          # id order reversed against position
    rr, cc, ee = V._first_k_per_row(r, cidx, exact, crank, 3)
    assert len(rr) == 3
    assert cc[np.argmax(ee)] == 500               # the better score is kept
    assert set(cc) - {500} == {999, 998}          # then the smallest ids among the ties


def test_embed_with_user_encoder(spark):
    def make_predict_fn():
        import numpy as np

        def predict(texts):
            lens = np.array([len(t) for t in texts], dtype=np.float32)
            return np.stack([lens, np.ones_like(lens), np.zeros_like(lens)], axis=1)
        return predict
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "hello")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in V.embed_with(df, "text", make_predict_fn, dim=3).collect()}
    assert got == {1: [3.0, 1.0, 0.0], 2: [0.0, 1.0, 0.0], 3: [5.0, 1.0, 0.0]}


def _clustered(n, groups, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return centres[np.arange(n) % groups] + 0.1 * rng.normal(size=(n, dim))


def test_cells_that_cannot_matter_are_not_read(spark):
    from triagelake.operators.cells import Work
    vecs = {i: v for i, v in enumerate(_clustered(1500, 30))}
    q = {i: vecs[i] for i in range(0, 1500, 5)}
    work = Work()
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in q.items()], "qid long, embedding array<double>")
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in vecs.items()], "id long, embedding array<double>")
    rows = V.topk_search(qdf, cdf, 5, c_block_rows=50, q_block_rows=16, work=work).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {i: [c for c, _ in x] for i, x in brute_topk(q, vecs, 5).items()}
    print("scored", work.scored, "of", work.pairs, "pairs of a query and a block, by waves", work.waves)
    assert work.pairs >= 300 * 30 and work.scored < work.pairs / 6


@pytest.mark.parametrize("kw", [{"c_blocks": 40}, {"c_block_rows": 20, "q_blocks": 3}])
def test_cells_with_signs_zeros_ties_and_hot_vectors(spark, kw):
    rng = np.random.default_rng(4)
    vecs = {i: rng.integers(-2, 3, 6).astype(float) for i in range(240)}      # many equal scores
    vecs |= {i: np.array([1.0, 0, 0, 0, 0, 0]) for i in range(240, 360)}      # one vector in a third of all rows
    vecs |= {i: np.zeros(6) for i in range(360, 380)}
    q = {i: vecs[i] for i in range(0, 380, 9)}
    for extra in ({}, {"exclude_self": True}, {"min_score": 0.25}, {"min_score": 0.0}):
        got = run_topk(spark, q, vecs, 4, **kw, **extra)
        want = brute_topk(q, vecs, 4, **extra)
        assert {i: [c for c, _ in x] for i, x in got.items()} == {i: [c for c, _ in x] for i, x in want.items() if x}


def test_heads_bound_packed_vectors(spark):
    from triagelake.operators.cells import Work
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(words[(i % 20) * 20 + j] for j in rng.integers(0, 20, 3))) for i in range(800)]
    df = spark.createDataFrame(docs, "id long, text string")
    dim = 1024
    c = V.pack(V.hash_counts(df, "id", "text", dim), "id")
    work = Work()
    got = V.topk_search_long(c.withColumnRenamed("id", "qid"), c, 3, dim=dim, min_score=0.0, c_block_rows=40, work=work).collect()
    dense = {i: _py_hash_vector(t, dim) for i, t in docs}
    want = brute_topk(dense, dense, 3, min_score=0.0)
    by = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        by.setdefault(r["qid"], []).append(r["id"])
    assert by == {i: [x for x, _ in w] for i, w in want.items()}
    assert work.scored < work.pairs / 4


def test_null_vectors_and_no_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<double>")
    q = v.withColumnRenamed("id", "qid")
    assert sorted((r["qid"], r["rank"], r["id"]) for r in V.topk_search(q, v, 1).collect()) == [(1, 1, 1), (3, 1, 3)]
    assert V.topk_search(q, v.where("false"), 1).collect() == [] and V.topk_search(q.where("false"), v, 1).collect() == []


def test_one_huge_k_and_zero_scores_stay_bounded():
    import resource

    import numpy as np
    import pandas as pd

    # no shared bucket: every score is 0, nothing passes and nothing is gathered
    q = pd.DataFrame({"qid": range(512), "k": 5, "vec": [np.eye(64)[i % 8] for i in range(512)]})
    c = pd.DataFrame({"id": range(16384), "vec": [np.eye(64)[32 + i % 8] for i in range(16384)]})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(V._local_topk_fn(False, 0.0)(q, c)) == 0
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # KB
    # one query asks for everything, the others for 2
    q["k"] = [10 ** 9] + [2] * 511
    c["vec"] = [np.eye(64)[i % 8] for i in range(16384)]
    got = V._local_topk_fn(False, None)(q, c).groupby("qid").size()
    assert got[0] == 16384 and (got.drop(0) == 2).all()


def test_token_beyond_the_old_cut_is_found(spark):
    corpus = spark.createDataFrame([("a", "filler " * 400 + "needle"), ("b", "other words")], "id string, training_text string")
    req = spark.createDataFrame([(1, "needle", 3)], "request_id long, query string, top_k int")
    hits = V.search_texts(req, V.build_index(corpus)).collect()
    assert "a" in {r["id"] for r in hits}
    assert all(r["training_text"].endswith("needle") for r in hits if r["id"] == "a")


def test_index_with_a_user_encoder(spark):
    def make_predict_fn():
        import numpy as np

        def predict(texts):
            return np.stack([np.array([float(t.count(x)) for t in texts], np.float32) for x in "abc"], axis=1)
        return predict
    corpus = spark.createDataFrame([("x", "aaa"), ("y", "bbb"), ("z", "abc")], "id string, training_text string")
    index = V.build_index(corpus, encoder=make_predict_fn, dim=3)
    req = spark.createDataFrame([(1, "aa", 1), (2, "bb", 2), (2, "bb", 2)], "request_id long, query string, top_k int")
    got = sorted((r["request_id"], r["rank"], r["id"]) for r in V.search_texts(req, index, encoder=make_predict_fn, dim=3).collect())
    assert got == [(1, 1, "x"), (2, 1, "y"), (2, 1, "y"), (2, 2, "z"), (2, 2, "z")]


def test_search_texts_hot_text(spark, sf_small):
    from triagelake.plans import catalog as CAT
    corpus = CAT.search_index(spark, sf_small)
    hot = "crm profile out of sync"
    rows = [(i, hot if i % 3 == 0 else f"retry order {i}", 2 if i % 2 else None) for i in range(600)]
    req = spark.createDataFrame(rows, "request_id long, query string, top_k int")
    hits = V.search_texts(req, corpus).collect()
    single = V.search_texts(spark.createDataFrame([(0, hot, 5)], "request_id long, query string, top_k int"),
                            corpus).collect()
    ranked = [(r["rank"], r["id"], r["similarity_score"]) for r in sorted(single, key=lambda r: r["rank"])]
    by_req = {}
    for r in hits:
        by_req.setdefault(r["request_id"], []).append((r["rank"], r["id"], r["similarity_score"]))
    for i in range(0, 600, 3):   # every hot request: its own k of the same ranking
        k = 2 if i % 2 else 5
        assert sorted(by_req[i]) == ranked[:k]


def test_equal_vectors_are_searched_once(spark):
    from triagelake.operators.cells import Work
    rng = np.random.default_rng(6)
    kinds = rng.normal(size=(30, 8))
    vecs = {i: kinds[i % 30] for i in range(1200)}
    q = {i: kinds[i % 30] for i in range(600)}
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in vecs.items()], "id long, embedding array<double>")
    qdf = spark.createDataFrame([(i, v.tolist(), 1 + i % 7) for i, v in q.items()], "qid long, embedding array<double>, k int")
    work, got = Work(), {}
    for r in sorted(V.topk_search(qdf, cdf, k_col="k", c_block_rows=10, work=work).collect(), key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["id"])
    want = brute_topk(q, vecs, 7)
    assert got == {i: [c for c, _ in x][:1 + i % 7] for i, x in want.items()}
    assert work.pairs <= 30 * 12                                              # 30 vectors, not 600 queries against 120 blocks


def test_small_blocks_share_tasks():
    from triagelake.operators.cells import lots_of
    loads, counts = {c: 700 for c in range(500)}, {c: 128 for c in range(500)}
    lots, n = lots_of(loads, counts, 32768, 32768)
    assert n == -(-500 // (32768 // 700)) and {x[1:] for x in lots.values()} == {(1, 1)}   # not 500 cells * 11 parts of 64
    loads, counts = {0: 5, 1: 70_000, 2: 5}, {0: 10, 1: 100_000, 2: 10}
    lots, n = lots_of(loads, counts, 32768, 32768)
    assert lots[1][1:] == (4, 3) and n == 13 and lots[0] == lots[2]            # a large cell has lots of its own


def test_a_large_cell_does_not_hide_the_cells_after_it(spark):
    """A wave in which no query has a cell is not the last one."""
    rng = np.random.default_rng(8)
    vecs = {i: np.r_[1.0, 0.001 * rng.normal(size=5)] for i in range(900)}
    vecs |= {i: np.r_[0.8, 0.6, 0.001 * rng.normal(size=4)] for i in range(900, 940)}
    q = {i: np.r_[1.0, 0.02 * rng.normal(size=5)] for i in range(20)}
    got = run_topk(spark, q, vecs, 920, c_block_rows=4, c_blocks=2)
    want = brute_topk(q, vecs, 920)
    assert {i: [c for c, _ in x] for i, x in got.items()} == {i: [c for c, _ in x] for i, x in want.items()}


def test_texts_are_packed_row_by_row(spark):
    rows = [(1, "a b a"), (1, "a"), (2, " ., "), (3, None), (None, "Ünï 12 b")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = [(r["id"], dict(zip(r["bs"], r["vs"])), list(r["bs"])) for r in V.pack_texts(df, "text").collect()]
    for i, (key, text) in enumerate(rows):
        one = V.pack(V.hash_counts(spark.createDataFrame([(key, text)], "id long, text string"), "id", "text"), "id").collect()
        assert [(r["id"], dict(zip(r["bs"], r["vs"])), list(r["bs"])) for r in one] == ([x for x in got if x[0] == key and sum(x[1].values()) == len((text or "").split())] if one else [])
    assert len(got) == 3
    assert "Exchange" not in V.pack_texts(df, "text")._jdf.queryExecution().executedPlan().toString()
