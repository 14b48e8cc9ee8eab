"""Scalar helpers and declared output schemas."""

from triagelake import schemas
from triagelake.functions.text import empty_to_null, fmt_fixed, nonblank, pystrip, render
from triagelake.operators import triage as TR
from triagelake.operators import vectors as V
from triagelake.plans import catalog as CAT


def test_pystrip_nonblank_empty(spark):
    df = spark.createDataFrame([(" \t a b \n",), ("   ",), ("",), (None,)], "s string")
    rows = df.select(pystrip("s").alias("p"), nonblank("s").alias("n"), empty_to_null("s").alias("e")).collect()
    assert [r["p"] for r in rows] == ["a b", "", "", None]
    assert [r["n"] for r in rows] == [True, False, False, False]
    assert rows[2]["e"] is None and rows[0]["e"] == " \t a b \n"


def test_render_and_fixed_point(spark):
    df = spark.createDataFrame([("x", None, 0.125), ("y", 3, 1234.5)], "a string, b int, c double")
    rows = df.select(render("{a}:{b}:{{lit}}").alias("r"), fmt_fixed("c").alias("f")).collect()
    assert [r["r"] for r in rows] == ["x::{lit}", "y:3:{lit}"]
    # Python's f"{x:.2f}": exact binary value, ties to even, no separators
    assert [r["f"] for r in rows] == [f"{0.125:.2f}", f"{1234.5:.2f}"]


def test_sparse_weights_from_dense(spark):
    df = spark.createDataFrame([(1, [0.0, 0.6, 0.0, 0.8])], "id long, embedding array<double>")
    got = sorted((r["bucket"], r["weight"]) for r in V.sparse_weights(df, "id").collect())
    assert got == [(1, 0.6), (3, 0.8)]


def test_outputs_follow_declared_schemas(spark, sf_small):
    hits = CAT.request_hits(spark, sf_small)
    assert hits.columns == ["request_id"] + [f.name for f in schemas.HIT.fields if f.name != "qid"]
    dec = TR.decide(CAT.request_clean(spark, sf_small), CAT.FX.response(spark, sf_small),
                    CAT.FX.payload(spark, sf_small))
    assert dec.columns == [f.name for f in schemas.DECISION.fields]
    assert CAT.request_clean(spark, sf_small).schema["top_k"].dataType == schemas.REQUEST["top_k"].dataType
    m = CAT.manifest(spark, sf_small)
    assert m.columns == [f.name for f in schemas.MANIFEST.fields if f.name != "date_created"]
    corpus = CAT.corpus_union(spark, sf_small)
    assert corpus.columns == [f.name for f in schemas.CORPUS.fields]
    assert [corpus.schema[c].dataType for c in corpus.columns] == [f.dataType for f in schemas.CORPUS.fields]
