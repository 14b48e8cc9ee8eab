"""Context, outcome, ticket updates, streaming (stream = batch, replay-safe)."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from triagelake import rules
from triagelake.operators import context as C
from triagelake.operators import outcome as O
from triagelake.operators import triage as TR
from triagelake.operators.requests import clean_requests
from triagelake.plans import fixtures as FX
from triagelake.streaming import stream as S


def test_fold_context_order_and_top3(spark):
    hits = spark.createDataFrame([(1, r, "incident", f"t{r}") for r in (4, 2, 1, 3)],
                                 "qid long, rank int, source string, training_text string")
    got = C.fold_context(hits).first()["context"]
    assert got == "Similar incident 1: t1\nSimilar incident 2: t2\nSimilar incident 3: t3"


def test_complete_with_batch_boundaries(spark):
    prompts = spark.range(0, 500).select(F.col("id").alias("request_id"), F.lit("answer").alias("kind"),
                                         F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = C.complete_with(prompts.repartition(7), lambda ps: [p.upper() for p in ps]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["request_id"], r["llm_output"]) for r in out) == [(i, f"P{i}") for i in range(500)]


def test_complete_with_fails_prompt_by_prompt(spark):
    def shout(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    rows = [(i, "answer", "bad" if i == 3 else f"p{i}") for i in range(6)]
    out = {r["request_id"]: r["llm_output"] for r in C.complete_with(
        spark.createDataFrame(rows, "request_id long, kind string, prompt string").coalesce(1), shout).collect()}
    assert out == {i: f"P{i}" if i != 3 else "LLaMA Error: no" for i in range(6)}


def test_action_result_by_handler(spark):
    rows = [(1, "create_invoice", 200, '{"id":"7"}'), (2, "create_invoice", 500, "boom"), (3, "retry_order", 200, '{"status":"failure","message":"order not found"}'),
            (4, "retry_order", 500, '{"status":"success","message":"done"}'), (5, "sync_customer_data", 200, "oops"),
            (6, "fix_asset_mismatch", 200, "{}"), (7, "create_invoice", 200, "not json"), (8, "create_invoice", None, None)]
    got = {r["request_id"]: tuple(r)[1:] for r in O.interpret_action_result(
        spark.createDataFrame(rows, "request_id long, handler string, http_code int, body string")).collect()}
    assert got[1] == ("success", rules.MSG_INVOICE_CREATED, "7") and got[2] == ("failure", "boom", None)
    assert got[3] == ("failure", "order not found", None) and got[4] == ("success", "done", None)
    assert got[5] == got[7] == ("error", rules.ERROR_BODY_NOT_JSON, None)
    assert got[6] == (None, None, None) and got[8] == ("failure", None, None)


def test_ticket_notes_and_text_keys(spark):
    ups = spark.createDataFrame([("T", "b", 1, None, None, "3", {}), ("T", "a", 2, 2, None, "2", {}), ("T", "a", 1, None, None, "1", {}),
                                 ("T", "c", 1, 6, None, None, {})],
                                "ticket_key string, request_id string, seq int, state int, close_notes string, work_notes string, fields map<string,string>")
    assert [(r["note_no"], r["work_notes"]) for r in O.ticket_notes(ups).orderBy("note_no").collect()] == [(1, "1"), (2, "2"), (3, "3")]
    r = O.apply_updates(spark.createDataFrame([("T",)], "number string"), ups).first()
    assert (r["state"], r["last_work_note"], r["n_work_notes"]) == (6, "3", 3)


def test_attach_responses_flags_errors(spark):
    prompts = spark.createDataFrame([(1, "answer", "p"), (2, "answer", "p"), (3, "answer", "p")],
                                    "request_id long, kind string, prompt string")
    resp = spark.createDataFrame([(1, "answer", "  ok \n"), (2, "answer", "LLaMA Error: boom")],
                                 "request_id long, kind string, llm_output string")
    got = {r["request_id"]: r for r in C.attach_responses(prompts, resp).collect()}
    assert got[1]["answer"] == "ok" and not got[1]["is_error"]
    assert got[2]["is_error"] and got[3]["missing"]


def test_assignment_group_rule(spark):
    hits = spark.createDataFrame([(1, 1, "incident", "Database Team"), (2, 1, "incident", "Not Provided"),
                                  (3, 1, "kb_article", "Not Applicable"), (3, 2, "incident", "X")],
                                 "qid long, rank int, source string, assignment_group string")
    got = {r["qid"]: r["assignment_group"] for r in TR.assignment_group(hits).collect()}
    assert got == {1: "Database Team", 2: rules.DEFAULT_GROUP, 3: rules.DEFAULT_GROUP}


def test_update_payload_and_status_code(spark):
    df = spark.createDataFrame([(" Resolve ", "m"), ("escalate", "m"), ("worknote", "m"), ("close", "m")],
                               "t string, m string")
    rows = [r[0] for r in df.select(O.update_payload("t", "m").alias("u")).collect()]
    assert (rows[0]["state"], rows[0]["close_notes"], rows[0]["work_notes"]) == (6, "m", "Resolution details:\nm")
    assert (rows[1]["state"], rows[1]["work_notes"]) == (2, "Escalated to human: m")
    assert rows[2]["state"] is None and rows[2]["work_notes"] == "m"
    assert not rows[3]["ok"] and "close" in rows[3]["error"]
    res = spark.createDataFrame([(1, 404, '{"error":"x"}'), (2, 500, "{}"), (3, 502, '{"http_status":1}'),
                                 (4, 500, "oops"), (5, 204, "{}")], "request_id long, http_code int, body string")
    got = {r["request_id"]: r for r in O.interpret_update_response(res).collect()}
    assert got[1]["update_response"] == '{"error":"x","http_status":404}'
    assert got[2]["update_response"] == '{"http_status":500}'
    assert got[3]["update_response"] == '{"http_status":1}' and got[4]["update_response"] == "oops"
    assert got[5]["update_ok"] and not got[1]["update_ok"]


def test_apply_updates_latest_state(spark):
    tickets = spark.createDataFrame([("INC1",), ("INC2",)], "number string")
    ups = spark.createDataFrame([
        ("INC1", 1, 1, None, None, "n1", {rules.AI_SUGGESTION_FIELD: "s1"}),
        ("INC1", 1, 2, 2, None, "n2", {}),
        ("INC1", 5, 1, None, None, "n3", {rules.AI_SUGGESTION_FIELD: "s5"}),
        ("INC1", 5, 2, 6, "closed", "n4", {}),
    ], "ticket_key string, request_id long, seq int, state int, close_notes string, work_notes string, "
       "fields map<string,string>")
    got = {r["number"]: r for r in O.apply_updates(tickets, ups).collect()}
    r = got["INC1"]
    assert (r["state"], r["close_notes"], r["last_work_note"], r["n_work_notes"]) == (6, "closed", "n4", 4)
    assert r[rules.AI_SUGGESTION_FIELD] == "s5"
    assert got["INC2"]["state"] is None and got["INC2"]["n_work_notes"] == 0


def test_outcome_invariants(spark, sf_small):
    req = FX.request(spark, sf_small)
    t = S.triage_batch(req, FX.response(spark, sf_small), FX.payload(spark, sf_small),
                       FX.action_result(spark, sf_small), TR.rule_tables(spark)["action_registry"])
    for r in t["decisions"].collect():
        if r["automation_allowed"]:
            assert r["approved_action"] in rules.AUTO_APPROVED_ACTIONS and r["confidence"] >= 0.9
        else:
            assert r["approved_action"] is None
    outs = t["outcomes"].collect()
    assert all(o["ticket_key"] for o in outs)
    for o in outs:
        assert o["success"] == (o["automation_allowed"] and o["mcp_status"] == "success"
                                and o["confidence"] >= 0.9)
        assert (o["fail_reason"] is None) == o["success"]


def test_stream_equals_batch_and_replay_is_idempotent(spark, sf_small):
    req = FX.request(spark, sf_small)
    resp, pay, res = FX.response(spark, sf_small), FX.payload(spark, sf_small), FX.action_result(spark, sf_small)
    base = tempfile.mkdtemp(prefix="tl-stream-")
    out = S.run_stream_once(spark, req, resp, pay, res, files=3, work_dir=base)
    streamed = spark.read.parquet(os.path.join(out, "decisions"))
    assert streamed.select("batch_id").distinct().count() == 3
    batch = TR.decide(clean_requests(req), resp, pay)
    cols = batch.columns
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.collect()))
    before = sorted(map(tuple, spark.read.parquet(os.path.join(out, "ticket_updates")).collect()))
    # replay batch 1 by hand: the same rows overwrite only that partition
    b1 = spark.read.parquet(os.path.join(base, "requests")).where(
        F.col("request_id").isin([r[0] for r in spark.read.parquet(os.path.join(out, "decisions"))
                                  .where("batch_id = 1").select("request_id").collect()]))
    tables = S.triage_batch(b1, resp, pay, res, TR.rule_tables(spark)["action_registry"])
    S._write(tables["ticket_updates"], os.path.join(out, "ticket_updates"), 1)
    after = sorted(map(tuple, spark.read.parquet(os.path.join(out, "ticket_updates")).collect()))
    assert before == after
    # a replay without rows leaves none of the batch's rows behind
    S._write(tables["ticket_updates"].where("false"), os.path.join(out, "ticket_updates"), 1)
    assert spark.read.parquet(os.path.join(out, "ticket_updates")).where("batch_id = 1").count() == 0


def test_latest_per_ticket_hot_ticket(spark):
    rows = [(i, "INC_HOT" if i % 3 else None) for i in range(1, 3001)] + [(5000, "INC_OTHER")]
    df = spark.createDataFrame(rows, "request_id long, ticket_key string")
    got = S.latest_per_ticket(df)
    keyed = {r["ticket_key"]: r["request_id"] for r in got.where("ticket_key is not null").collect()}
    assert keyed == {"INC_HOT": 2999, "INC_OTHER": 5000}
    assert got.where("ticket_key is null").count() == 1000


def test_assignment_group_for_requests_without_hits(spark):
    hits = spark.createDataFrame([(1, 1, "incident", "Database Team")],
                                 "qid long, rank int, source string, assignment_group string")
    req = spark.createDataFrame([(1,), (2,)], "qid long")
    got = {r["qid"]: r["assignment_group"] for r in TR.assignment_group(hits, requests=req).collect()}
    assert got == {1: "Database Team", 2: rules.DEFAULT_GROUP}


def test_stream_search_equals_batch_search(spark, sf_small):
    from triagelake.plans import catalog as CAT
    index = CAT.search_index(spark, sf_small)
    req = FX.request(spark, sf_small)
    base = tempfile.mkdtemp(prefix="tl-stream-search-")
    out = S.run_stream_once(spark, req, FX.response(spark, sf_small), FX.payload(spark, sf_small),
                            FX.action_result(spark, sf_small), files=2, work_dir=base, index=index)
    streamed = spark.read.parquet(os.path.join(out, "hits")).drop("batch_id")
    batch = CAT.request_hits(spark, sf_small)
    assert sorted(map(tuple, streamed.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert spark.read.parquet(os.path.join(out, "context")).count() == batch.select("request_id").distinct().count()


def _requests(spark, rows):
    return spark.createDataFrame([(i, "retry order", "OSM", t, None, None) for i, t in rows],
                                 "request_id long, query string, configuration_item string, ticket_id string, sys_id string, top_k int")


def _drain(spark, base, rows_by_batch, **kw):
    """Run batches one after the other; returns the updates' (batch, ticket, request)."""
    resp = spark.createDataFrame([(i, '{"action":"update_order","confidence":0.95}') for i in range(100)], "request_id long, llm_output string")
    for rows in rows_by_batch:
        _requests(spark, rows).coalesce(1).write.mode("append").parquet(os.path.join(base, "in"))
        S.start_triage_stream(spark, os.path.join(base, "in"), os.path.join(base, "out"), resp, checkpoint=os.path.join(base, "cp"), **kw).awaitTermination()
    u = S.read_committed(spark, os.path.join(base, "out"), "ticket_updates")
    return sorted({(r["batch_id"], r["ticket_key"], r["request_id"]) for r in u.collect()})


def test_a_ticket_is_updated_by_later_requests_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "STATE_PARTS", 2)  # the state is merged on the way
    batches = [[(5, "A"), (3, "A"), (4, "B")], [(4, "A"), (9, "B"), (1, None)], [(6, "A"), (8, "B"), (2, "C")], [(5, "A")], [(7, "A"), (7, "B"), (3, "C")]]
    got = _drain(spark, str(tmp_path), batches)
    assert got == [(0, "A", 5), (0, "B", 4), (1, "B", 9), (2, "A", 6), (2, "C", 2), (4, "A", 7), (4, "C", 3)]
    assert all(len(c["state"]) <= 3 for c in S.commits(spark, os.path.join(str(tmp_path), "out")).values())


def test_state_expires(spark, tmp_path):
    got = _drain(spark, str(tmp_path), [[(5, "A")], [(50, "B")], [(51, "B")], [(4, "A")]], expire_batches=2)
    assert got == [(0, "A", 5), (1, "B", 50), (2, "B", 51), (3, "A", 4)]


def test_a_batch_counts_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    base, write = str(tmp_path), S._write
    first = _drain(spark, base, [[(5, "A"), (6, "B")]])

    def dies(df, path, batch_id):
        if path.endswith("ticket_updates"):
            raise RuntimeError("lost")
        write(df, path, batch_id)
    monkeypatch.setattr(S, "_write", dies)
    with pytest.raises(Exception, match="lost"):
        _drain(spark, base, [[(7, "A")]])
    out = os.path.join(base, "out")
    # the batch wrote outcomes and other tables, but no reader sees any of them
    assert os.path.exists(os.path.join(out, "outcomes", "batch_id=1"))
    assert sorted(S.commits(spark, out)) == [0]
    for table in ("outcomes", "decisions", "ticket_updates"):
        assert [r[0] for r in S.read_committed(spark, out, table).select("batch_id").distinct().collect()] == [0]
    monkeypatch.undo()
    assert _drain(spark, base, [[(3, "A")]]) == [*first, (1, "A", 7)]  # replayed whole; 3 is older than 7
    assert sorted(S.commits(spark, out)) == [0, 1, 2]


def test_only_the_tables_asked_for(spark, tmp_path):
    _drain(spark, str(tmp_path), [[(5, "A")]], tables=("ticket_updates",))
    assert not os.path.exists(os.path.join(str(tmp_path), "out", "decisions"))
    with pytest.raises(ValueError, match="decisions"):
        S.read_committed(spark, os.path.join(str(tmp_path), "out"), "decisions")


def test_equal_prompts_are_asked_once(spark, tmp_path):
    calls, store = spark.sparkContext.accumulator(0), str(tmp_path / "answers")
    broken = spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(len(prompts))
        if "bad" in prompts:
            broken.add(1)
            raise ValueError("down")
        return [p.upper() for p in prompts]
    df = spark.createDataFrame([(i, "decision", f"prompt {i % 5}") for i in range(50)] + [(50, "x", None), (51, "x", "")], "request_id long, kind string, prompt string")
    got = {r["request_id"]: r["llm_output"] for r in C.complete_once(df, model, store).collect()}
    assert got == {**{i: f"PROMPT {i % 5}" for i in range(50)}, 50: None, 51: ""}
    assert calls.value == 6
    again = C.complete_once(df, model, store).collect()
    assert calls.value == 6 and len(again) == 52  # a rerun calls the function zero times
    more = df.unionByName(spark.createDataFrame([(60, "decision", "prompt 9"), (61, "decision", "bad")], df.schema))
    got = {r["request_id"]: r["llm_output"] for r in C.complete_once(more, model, store).collect()}
    assert got[60] == "PROMPT 9" and got[61].startswith(rules.MODEL_ERROR_PREFIX) and got[3] == "PROMPT 3"
    before = broken.value
    C.complete_once(more, model, store)
    assert broken.value > before  # an error is not kept
    os.makedirs(os.path.join(store, "run-died"))  # a run that died: no part of it is read
    assert len(C.complete_once(df, model, store).collect()) == 52


def test_notes_of_a_hot_ticket_are_numbered_in_many_tasks(spark):
    from triagelake.operators.corpus import number_within
    rows = [("HOT" if i % 3 == 0 else f"T{i % 50}", i, s, f"note {i}.{s}") for i in range(900) for s in (1, 2)] + [(None, 1, 1, "a"), (None, 2, 1, "b")]
    u = spark.createDataFrame(rows, "ticket_key string, request_id long, seq int, work_notes string").repartition(7)
    got = sorted((r["ticket_key"] or "", r["note_no"], r["work_notes"]) for r in O.ticket_notes(u).collect())
    by = {}
    for t, i, s, n in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        by.setdefault(t or "", []).append(n)
    assert got == sorted((t, n + 1, x) for t, xs in by.items() for n, x in enumerate(xs))
    same = spark.range(600).select(F.lit("one").alias("k"), F.lit(1).alias("o"))  # equal rows are spread too
    numbered = number_within(same, "k", ["o"], "no", num_partitions=6)
    assert sorted(r["no"] for r in numbered.collect()) == list(range(1, 601))


def test_counts_of_a_write(spark, tmp_path):
    from triagelake.operators import corpus as P
    from triagelake.sources.sinks import write_with_manifest
    df = spark.createDataFrame([(1, "a" * 11), (2, "short"), (3, None)], "id long, training_text string")
    assert P.write_prepared(df, str(tmp_path / "p")) == {"n_before": 3, "n_after": 1, "n_dropped": 2}
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    e = spark.createDataFrame([(1, [0.5, 1.0])], "id long, embedding array<float>")
    assert write_with_manifest(e, str(tmp_path / "e"), model_name="m") == {"model_name": "m", "num_records": 1, "embedding_dim": 2}


def test_an_arrival_lands_in_files_of_its_own_and_is_one_batch(spark, sf_small, tmp_path):
    from triagelake.sources import fs
    req = FX.request(spark, sf_small).where("request_id < 60").repartition(3)
    base = str(tmp_path / "run")
    out = S.run_stream_once(spark, req, FX.response(spark, sf_small), None, None, work_dir=base, tables=("decisions",),
                            arrival=F.pmod(F.col("request_id"), F.lit(2)), arrivals=2)
    files = [n for n in fs.names(spark, f"{base}/requests") if n.startswith("part-")]
    assert len(files) == 6                                                    # three tasks wrote each arrival, not one
    got = {b: {r["request_id"] % 2 for r in rows} for b, rows in
           ((b, S.read_committed(spark, out, "decisions").where(F.col("batch_id") == b).collect()) for b in S.committed(spark, out))}
    assert got == {0: {0}, 1: {1}}
