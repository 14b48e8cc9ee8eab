"""Hits and their folds are made once per group of requests that have the same."""

from collections import Counter

from triagelake.operators import context as C
from triagelake.operators import vectors as V

ASKED = "request_id long, _vk string, _k int"
HITS = "_vk string, rank int, id string, source string, training_text string"


def _tables(spark):
    asked = [(i, "a", 2) for i in range(40)] + [(100, "a", 1), (101, "b", 5), (102, "none", 3), (103, "b", 0)]
    asked += [(7, "b", 1), (7, "a", 2), (None, "a", 1), (None, "b", 2)]  # ids that repeat or are missing
    hits = [(v, r, f"{v}{r}", "kb_article", f"text {v}{r} " * 50) for v in "ab" for r in (1, 2, 3)]
    return spark.createDataFrame(asked, ASKED), spark.createDataFrame(hits, HITS)


def test_groups_have_the_hits_of_their_requests(spark, monkeypatch):
    monkeypatch.setattr(V, "GROUP_REQUESTS", 8)
    asked, hits = _tables(spark)
    groups, found = V.group_requests(asked, hits, "request_id")
    each = C.each_of_group(groups, found)
    plain = asked.join(hits, "_vk").where("rank <= _k").select(each.columns)
    assert Counter(each.collect()) == Counter(plain.collect())
    # one row per key; a text that many send is several groups, each folded once
    sizes = {r["group_id"]: r["count"] for r in groups.groupBy("group_id").count().collect()}
    assert sum(sizes.values()) == 45 and max(sizes.values()) < 20
    assert found.count() < 30 < plain.count()


def test_folds_by_group_are_folds_by_request(spark):
    asked, hits = _tables(spark)
    groups, found = V.group_requests(asked, hits, "request_id")
    plain = asked.join(hits, "_vk").where("rank <= _k").drop("_vk", "_k")
    assert (Counter(C.each_of_group(groups, C.fold_context(found, "group_id")).collect())
            == Counter(C.fold_context(plain, "request_id").collect()))
    requests = spark.createDataFrame([(7, "q7", "ci"), (7, "q7 again", ""), (100, "q100", ""), (102, "q102", ""), (None, "q", "")],
                                     "request_id long, query string, configuration_item string")
    grouped = requests.join(groups, "request_id", "left")
    assert (Counter(C.answer_prompts(grouped, C.fold_context(found, "group_id"), qid="group_id", by="group_id").collect())
            == Counter(C.answer_prompts(requests, C.fold_context(plain, "request_id"), qid="request_id").collect()))
    assert (Counter(C.group_prompts(grouped, found, qid="group_id", by="group_id").collect())
            == Counter(C.group_prompts(requests, plain, qid="request_id").collect()))


def test_shared_texts_are_written_once_a_file(spark, tmp_path):
    import random

    from triagelake.streaming.stream import _write
    texts = [random.Random(i).randbytes(8000).hex() for i in range(150)]  # 2.4 MB that do not compress much
    table = spark.createDataFrame(list(enumerate(texts)), "n long, training_text string")
    rows = spark.range(4000).selectExpr("id AS request_id", "id * 7 % 150 AS n").join(table, "n").drop("n").coalesce(1)
    _write(rows, str(tmp_path), 0)
    assert spark.read.parquet(str(tmp_path)).count() == 4000
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 6e6  # 64 MB of texts
