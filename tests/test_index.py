"""Versions of a stored index: what an update writes, and who sees what."""

import os

import pytest
from pyspark.sql import functions as F

from triagelake.operators import vectors as V
from triagelake.operators.index import IndexStore
from triagelake.sources import fs

SCHEMA = "id string, source string, training_text string"
FIRST = [("a", "s", "vpn login fails"), ("b", "s", "order fallout on order"), ("c", "s", "vpn login fails"), ("d", "s", None), ("e", "s", "printer jam"),
         ("f", "s", "printer jam"), ("f", "s", "printer jam"), (None, "s", "no id here"), ("g", "s", "to be removed")]
SECOND = [("a", "s", "vpn login fails"), ("b", "s", "order fallout on order 7"), ("c", "moved", "vpn login fails"), ("d", "s", None), ("e", "s", "printer jam"),
          ("f", "s", "printer jam"), (None, "s", "no id here"), ("h", "s", "vpn login fails"), ("i", "s", "brand new text"), ("j", "s", "brand new text")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(rows):
    return sorted(((r["id"], r["source"], r["training_text"], tuple(r["bs"] or ()), tuple(r["vs"] or ())) for r in rows.collect()), key=str)


def test_update_equals_a_full_build(spark, tmp_path):
    store, whole = IndexStore(spark, str(tmp_path / "i")), IndexStore(spark, str(tmp_path / "w"))
    one = store.update(frame(spark, FIRST)).manifest
    assert (one["version"], one["num_records"], one["rows_added"], one["rows_removed"], one["texts_encoded"]) == (1, 9, 9, 0, 6)
    earlier = store.open()
    two = store.update(frame(spark, SECOND)).manifest
    # b's text and c's source changed, h, i, j are new, one f is left; of their texts two are new to the index
    assert (two["version"], two["num_records"], two["rows_added"], two["rows_removed"], two["texts_encoded"]) == (2, 10, 6, 5, 2)
    assert content(store.open().rows()) == content(whole.update(frame(spark, SECOND)).rows())
    assert sorted((r[:3] for r in content(earlier.rows())), key=str) == sorted(FIRST, key=str)  # who opened version 1 goes on reading it
    assert store.update(frame(spark, SECOND)).manifest["version"] == 2  # nothing differs: no version
    three = store.compact()
    assert three.manifest["version"] == 3 and len(three.manifest["parts"]) == 1 and not three.manifest["tombstones"]
    assert content(three.rows()) == content(whole.open().rows())
    back = store.update(frame(spark, FIRST))
    assert content(back.rows()) == content(earlier.rows())
    assert [r["version"] for r in store.manifests().orderBy("version").collect()] == [1, 2, 3, 4]


def test_search_in_an_updated_index(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"))
    store.update(frame(spark, [(str(i), "s", f"filler number {i} word{i % 7}") for i in range(300)]))
    rows = [(str(i), "s", f"filler number {i} word{i % 7}") for i in range(100, 300)] + [(f"n{i}", "s", f"router model x{i} rebooted") for i in range(60)]
    rows.append(("z", "s", ""))  # no token: in the index, found by nothing
    snap = store.update(frame(spark, rows))
    req = spark.createDataFrame([(1, "router rebooted", 4), (2, "filler number 150", 3), (3, "filler number 50", 3), (4, "", 2)],
                                "request_id long, query string, top_k int")
    got = sorted(tuple(r) for r in V.search_texts(req, snap).collect())
    want = sorted(tuple(r) for r in V.search_texts(req, V.build_index(frame(spark, rows))).collect())
    assert got == want and {r[0] for r in got} == {1, 2, 3} and not any(r[2] == "50" for r in got)


def test_unchanged_tables_are_not_read(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"))
    store.update(frame(spark, FIRST), source_state="x")
    broken = frame(spark, FIRST).withColumn("training_text", F.raise_error(F.lit("read")).cast("string"))
    assert store.update(broken, source_state="x").manifest["version"] == 1
    with pytest.raises(Exception, match="read"):
        store.update(broken, source_state="y")
    assert store.versions() == [1]  # the update that died left no version
    assert content(store.open().rows())


def test_of_two_updates_one_commits(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path / "i"))
    store.update(frame(spark, FIRST))
    monkeypatch.setattr(IndexStore, "versions", lambda self: [1])  # both saw version 1 as the latest
    store.update(frame(spark, SECOND))
    with pytest.raises(RuntimeError, match="another update"):
        store.update(frame(spark, SECOND[:3]))
    monkeypatch.undo()
    assert store.versions() == [1, 2] and store.open().manifest["num_records"] == len(SECOND)


def test_another_model_encodes_anew(spark, tmp_path):
    path = str(tmp_path / "i")
    IndexStore(spark, path).update(frame(spark, FIRST))
    two = IndexStore(spark, path, model_name="other").update(frame(spark, FIRST)).manifest
    assert (two["version"], two["rows_added"], two["texts_encoded"], two["num_records"], len(two["parts"])) == (2, 9, 6, 9, 1)


def test_index_of_a_user_encoder(spark, tmp_path):
    def make_predict_fn():
        import numpy as np

        def predict(texts):
            return np.stack([np.array([float(t.count(x)) for t in texts], np.float32) for x in "abc"], axis=1)
        return predict
    store = IndexStore(spark, str(tmp_path / "i"), encoder=make_predict_fn, dim=3, model_name="letters")
    store.update(frame(spark, [("x", "s", "aaa"), ("y", "s", "bbb"), ("z", "s", "abc"), ("n", "s", "")]))
    snap = store.update(frame(spark, [("x", "s", "aaa"), ("y", "s", "bbc"), ("z", "s", "abc")]))
    assert snap.manifest["texts_encoded"] == 1
    req = spark.createDataFrame([(1, "aa", 1), (2, "bb", 2)], "request_id long, query string, top_k int")
    got = sorted((r["request_id"], r["rank"], r["id"]) for r in V.search_texts(req, snap, encoder=make_predict_fn, dim=3).collect())
    assert got == [(1, 1, "x"), (2, 1, "y"), (2, 2, "z")]


def test_empty_corpus(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"))
    snap = store.update(frame(spark, FIRST).where("false"))
    req = spark.createDataFrame([(1, "vpn", 2)], "request_id long, query string, top_k int")
    assert snap.rows().count() == 0 and V.search_texts(req, snap).collect() == []
    assert [r["id"] for r in V.search_texts(req, store.update(frame(spark, FIRST))).orderBy("rank").collect()] == ["a", "c"]


def test_state_of_files(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    frame(spark, FIRST).coalesce(1).write.parquet(p)
    before = fs.state(spark, [p])
    assert before == fs.state(spark, [p])
    frame(spark, SECOND).coalesce(1).write.mode("append").parquet(p)
    assert fs.state(spark, [p]) != before
    assert fs.names(spark, os.path.join(str(tmp_path), "nowhere")) == []
