"""Rows that share an id, columns whose names clash, and the pipeline's stages
on input of any kind, against brute force."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from brute import brute_components, brute_repeats
from triagelake.llm import op1_mixing as o1
from triagelake.llm import op4_parity as o4
from triagelake.llm import op6_suffix as o6
from triagelake.llm import pipeline, queries

P = "a passage that repeats, " * 10


def test_rows_of_one_id_whose_texts_share_a_32_bit_hash(spark, monkeypatch):
    # two texts of one 32-bit hash, one with the passage that a third row repeats
    some = spark.range(300_000).select("id", F.concat(F.when(F.col("id") % 2 == 0, F.lit(P)).otherwise(F.lit("")), F.lit("unique text no. "), "id").alias("t"))
    pair = some.groupBy(F.hash("t").alias("h")).agg(F.min(F.when(F.col("id") % 2 == 0, F.col("t"))).alias("a"), F.min(F.when(F.col("id") % 2 == 1, F.col("t"))).alias("b"))
    a, b = pair.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").first()
    rows = [(None, a), (None, b), (7, "other start " + P)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(o6, "read", lambda *x: df)
    got = sorted(r.kept_sha256 for r in o6.op6_suffix_dedup(spark, "").collect())
    want = brute_repeats(list(enumerate(t for _, t in rows)))
    assert got == sorted(w[3] for w in want.values())
    assert b in {r.text for r in o6.without_repeats(df).collect()}


CLASH = ["rows", "head", "kept_text", "size", "target", "copies", "copy", "label", "node", "n", "key", "spans", "_kept_text"]


def test_columns_of_any_name(spark):
    docs = [(i, f"{P if i % 3 == 0 else ''}words of number {i} and {i * i} and more {i % 4}", "en", f"s{i % 2}", 1) for i in range(30)] + [(30, "words of number 2 and 4 and more 2", "en", "s0", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    wide = df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH)])
    for op in (o4.one_per_group, o6.without_repeats):
        got, plain = op(wide), op(df)
        assert got.columns == wide.columns
        assert sorted(map(tuple, got.select(df.columns).collect())) == sorted(map(tuple, plain.collect()))
        assert {r["rows"] for r in got.collect()} == {"x0"}
    mixed = o1.mixed(wide)
    assert sorted(mixed.columns) == sorted({*wide.columns, "size", "target", "copies", "copy"}) and mixed.where("copy > copies").isEmpty()


def windows(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return w, [tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12))] if w else []


def contaminated(text, items):
    words, _ = windows(text)
    hit = set()
    for item in items:
        for win in windows(item)[1]:
            for s in range(len(words) - len(win) + 1):
                if tuple(words[s:s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_stages_against_brute_force(spark, tmp_path):
    item = " ".join(f"bench{i}" for i in range(20))
    rows = [(i, f"clean words number {i} " + " ".join(f"v{i}x{j}" for j in range(30)), "en", "ab"[i % 2], 1) for i in range(40)]
    rows += [(100 + i, rows[i][1] + (" tail" if i % 2 else ""), "en", "a", 1) for i in range(6)]                       # near and exact copies
    rows += [(200 + i, f"start {i} " + P + " ".join(f"z{i}y{j}" for j in range(40)), "en", None, 1) for i in range(5)]   # a repeated passage
    rows += [(300 + i, f"intro {i} {item} outro", "de", "b", 1) for i in range(3)]                                     # the benchmark
    rows += [(400 + i, " ".join(f"awful{j % 7} slur{j % 5}" for j in range(20 + i)), "en", "a", 1) for i in range(30)]   # toxic
    rows += [(None, "no id " + P, "en", "a", None), (None, None, None, None, None), (500, None, "en", "a", 0), (501, "", "en", "a", 0), (501, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1)).withColumn("rows", F.lit("x"))
    d = str(tmp_path)
    spark.createDataFrame([(i, int(400 <= (i or 0) < 500)) for i, *_ in rows if i is not None], "doc_id long, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame([("q", item), ("n", None), ("e", "")], "item_id string, text string").write.parquet(d + "/benchmark.parquet")
    stages = dict(pipeline.STAGES)
    key = lambda r: (str(r["doc_id"]), str(r["text"]))

    after = stages["toxicity"](spark, docs, d)
    assert after.columns == pipeline.COLUMNS
    left = sorted(map(key, after.collect()))
    assert left == sorted((str(r[0]), str(r[1])) for r in rows if not 400 <= (r[0] or 0) < 500)

    got = stages["ngram_jaccard_join"](spark, after, d)
    assert got.columns == pipeline.COLUMNS
    texts = {i: r["text"] for i, r in enumerate(sorted(after.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))}
    ids = {i: r["doc_id"] for i, r in enumerate(sorted(after.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)))}
    want = brute_components([(i, texts[i]) for i in texts], 5, 80, 100)
    stay = sorted((str(ids[i]), str(texts[i])) for i, (n, c) in want.items() if i == c or n == 0 or ids[i] is None)
    assert sorted(map(key, got.collect())) == stay

    cut = stages["suffix_array_dedup"](spark, got, d)
    assert cut.columns == pipeline.COLUMNS
    before = list(enumerate(r["text"] for r in got.collect()))
    rest = sorted(w[3] for w in brute_repeats(before).values())
    assert sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in cut.collect()) == rest

    kept = stages["benchmark_decontamination"](spark, cut, d)
    assert kept.columns == pipeline.COLUMNS
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in cut.collect() if not contaminated(r["text"], [item]))

    mixed = stages["source_mixing"](spark, kept, d)
    plan = {key(r): r["copies"] for r in o1.mix(kept.withColumn("k", F.struct("doc_id", F.xxhash64("text"))), id_col="k").select(
        F.col("k.doc_id").alias("doc_id"), F.lit("").alias("text"), "copies").collect()}
    assert plan and mixed.where("copy < 1 OR copy > copies").isEmpty()
    words = {r["source"]: (r["got"], r["target"]) for r in mixed.where("size > 0").groupBy("source").agg(F.sum("size").alias("got"), F.max("target").alias("target")).collect()}
    longest = max(len((r["text"] or "").split()) for r in kept.collect())
    assert all(abs(got - target) <= longest for got, target in words.values())


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "one text", "en", "a", 8)] * 3])
def test_stages_on_few_rows(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(d + "/benchmark.parquet")
    docs.write.parquet(d + "/documents.parquet")
    out = pipeline.run(spark, d)
    assert (out.count() > 0) == bool(rows)


@pytest.mark.parametrize("name", ["op4_parity_join", "op10_flat_graph", "mix_targets", "url_rules"])
def test_twins_on_the_smallest_tables(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_small}/{t}.parquet')")
    twin = con.execute(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, sf_small).select(*[c[0] for c in twin.description])
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(twin.fetchall(), key=str)
