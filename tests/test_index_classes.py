"""A stored index keeps the class of equal vectors of every row."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from triagelake.operators import vectors as V
from triagelake.operators.index import IndexStore


def test_texts_are_cut_like_tokens(spark):
    rng = random.Random(1)
    alphabet = "aZ09 _-.\t\n\x00\x7féİΣ²Ⅳ一́"
    texts = ["".join(rng.choice(alphabet[:12] if i % 2 else alphabet) for _ in range(rng.randrange(30))) for i in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "x " * 50_000])], "id long, text string")
    for dim in (64, 100):
        got = {r["id"]: (list(r["bs"]), list(r["vs"])) for r in V.pack_texts(df, "text", dim, ["id"]).collect()}
        want = {r["id"]: (list(r["bs"]), list(r["vs"])) for r in V.pack(V.hash_counts(df, "id", "text", dim), "id").collect()}
        assert got == want


def test_rows_are_stored_with_their_class(spark, tmp_path):
    rows = [("a", "one two"), ("b", "two one"), ("c", "two  ONE"), ("d", "three"), ("e", " . "), ("f", None), ("a", "one two")]
    store = IndexStore(spark, str(tmp_path / "i"))
    snap = store.update(spark.createDataFrame(rows, "id string, training_text string"))
    for _ in range(2):
        stored = snap.stored()
        vk = {}
        for r in stored.collect():
            vk.setdefault(r["training_text"], set()).add(r["vk"])
        assert vk["one two"] == vk["two one"] == vk["two  ONE"] != vk["three"]
        assert vk[" . "] == vk[None] == {None} and vk["three"] != {None}
        assert "vk" not in snap.rows().columns
        cells = snap.cells()
        assert sum(cells.counts) == stored.where(F.col("cell").isNotNull()).count() == 5
        # the search takes the stored classes
        members = {r["vk"] for r in V._members(cells.rows, cells.payload, 9).collect()}
        assert members == {x for v in vk.values() for x in v if x}
        q = V.pack_texts(spark.createDataFrame([("q", "one two")], "qid string, text string"), "text", keep=["qid"]).withColumn("k", F.lit(9))
        assert [r["id"] for r in V.search_dealt(q, cells, min_score=0.0).orderBy("rank").collect()] == ["a", "a", "b", "c"]
        self_hits = V.search_dealt(q, cells, exclude_self=True, min_score=0.0)
        assert sorted(r["id"] for r in self_hits.collect()) == ["a", "a", "b", "c"]
        store.update(spark.createDataFrame([*rows, ("g", "four")], "id string, training_text string"))
        snap = store.update(spark.createDataFrame(rows, "id string, training_text string"))
        snap = store.compact()
