"""Strict parsing and the gate on literal answers (FIXTURES.md §4, §5)."""

import pytest
from pyspark.sql import functions as F

from triagelake import rules
from triagelake.operators import triage as TR


def parse(spark, outputs):
    df = spark.createDataFrame([(i, o) for i, o in enumerate(outputs)], "request_id long, llm_output string")
    return {r["request_id"]: r for r in TR.parse_decision(df).collect()}


CASES = [
    # text, json_ok, action, confidence, confidence_ok
    ('{"action":"update_order","confidence":0.95}', True, "update_order", 0.95, True),
    ('```json\n{"action":"sync_customer_data","confidence":0.9}\n```', True, "sync_customer_data", 0.9, True),
    ('```\n{"action":"restart_server","confidence":0.89}\n```', True, "restart_server", 0.89, True),
    ('Sure: {"action":"create_invoice","confidence":0.97} hope it helps', True, "create_invoice", 0.97, True),
    ("I cannot help with that.", False, None, None, None),
    ('{"action":"update_order","confidence":"0.93"}', True, "update_order", 0.93, True),
    ('{"action":"update_order"}', True, "update_order", 0.0, True),
    ('{"confidence":0.99}', True, "none", 0.99, True),
    ('{"action":"update_order","confidence":0.99} and {"x":1}', False, None, None, None),
    ('{"a":1}, {"b":2}', False, None, None, None),
    ("LLaMA Error: 429 {'error': 'rate'}", False, None, None, None),
    ('{"action":"update_order","confidence":"high"}', True, "update_order", None, False),
    ('{"action":"update_order","confidence":NaN}', False, None, None, None),
    ('{"action":"update_order","confidence":Infinity}', False, None, None, None),
    ('{"action":"update_order","confidence":0.95,}', False, None, None, None),
    ('{"action":"update_order","confidence":null}', True, "update_order", None, False),
    ('{"action":"update_order","confidence":true}', True, "update_order", None, False),
    ('{"action":"x","action":"update_order","confidence":0.95}', True, "update_order", 0.95, True),
    ("", False, None, None, None),
    ("{}", True, "none", 0.0, True),
]


def test_parse_cases(spark):
    got = parse(spark, [c[0] for c in CASES])
    for i, (text, ok, action, conf, conf_ok) in enumerate(CASES):
        r = got[i]
        assert r["json_ok"] == ok, text
        if ok:
            assert r["action"] == action, text
            assert r["confidence"] == (pytest.approx(conf) if conf is not None else None), text
            assert r["confidence_ok"] == conf_ok, text


def test_gate_threshold_inclusive(spark):
    df = spark.createDataFrame([("update_order", 0.9), ("update_order", 0.8999), ("retry_order", 0.99),
                                ("create_order", 5.0), (None, 0.95)], "a string, c double")
    got = [r[0] for r in df.select(TR.gate("a", "c")).collect()]
    assert got == [True, False, False, True, False]


def test_payload_check(spark):
    rows = [
        (0, '{"client_id":"5","line_items":[{"product_key":"p"}]}', True),
        (1, '{"error":"insufficient_data"}', False),
        (2, '{"client_id":"7"}', False),
        (3, '{"client_id":null,"line_items":[]}', True),
        (4, "no payload found", False),
        (5, '```json\n{"client_id":"9","line_items":[]}\n```', True),
        (6, '{"client_id":"9","line_items":[],"error":null}', False),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "request_id long, llm_output string")
    got = {r["request_id"]: r["payload_ok"] for r in TR.check_payload(df).collect()}
    assert got == {i: ok for i, _, ok in rows}


def test_decide_record(spark):
    req = spark.createDataFrame([
        (1, "vpn down", "ROD-OSM"),          # denied before the model
        (2, "retry order 2", "x"),           # approved
        (3, "create invoice", "x"),          # invoice without payload -> revoked
        (4, "screen", "x"),                  # invalid JSON
        (5, "screen", "x"),                  # invalid confidence
        (6, "screen", "x"),                  # no answer
    ], "request_id long, query string, configuration_item string")
    resp = spark.createDataFrame([
        (1, '{"action":"update_order","confidence":0.99}'),
        (2, '{"action":"update_order","confidence":0.95}'),
        (3, '{"action":"create_invoice","confidence":0.95}'),
        (4, "nope"),
        (5, '{"action":"update_order","confidence":"high"}'),
    ], "request_id long, llm_output string")
    d = {r["request_id"]: r for r in TR.decide(req, resp, None).collect()}
    assert d[1]["reason"] == rules.NETWORK_DENY_REASON and d[1]["automation_allowed"] is False
    assert d[1]["llm_raw_output"] is None
    assert d[2]["automation_allowed"] and d[2]["approved_action"] == "update_order"
    assert d[2]["reason"] == rules.REASON_APPROVED
    assert d[3]["automation_allowed"] is False and d[3]["approved_action"] is None
    assert d[3]["reason"] == rules.REASON_NOT_APPROVED and d[3]["confidence"] == pytest.approx(0.95)
    assert d[4]["reason"] == "Invalid JSON returned by LLM. Error: No JSON found in output: nope. Output was: nope" and d[4]["confidence"] == 0.0
    assert d[5]["reason"] == rules.REASON_INVALID_CONFIDENCE
    assert d[6]["reason"].startswith("LLM call failed")


def test_classifier_order_and_substring(spark):
    df = spark.createDataFrame([("Author page border wrong",), ("ORDER invoice",), ("billing crm",),
                                (None,), ("screen",)], "t string")
    got = [r[0] for r in df.select(TR.classify_issue("t")).collect()]
    # 'auth' hits "Author" first; rules are tried in list order, not text order
    assert got == ["network", "order_mgmt", "crm", "unknown", "unknown"]


def test_classifier_join_matches_when_chain(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["Author page", "vpn and invoice", "billing", "", None, "profile order"])], "k long, t string")
    a = {r["k"]: r["issue_type"] for r in df.select("k", TR.classify_issue("t").alias("issue_type")).collect()}
    b = {r["k"]: r["issue_type"] for r in
         TR.classify_issue_join(df, "t", TR.rule_tables(spark)["rules"]).collect()}
    assert a == b
    twice = spark.createDataFrame([(None, "vpn"), (None, "order"), (1, "crm"), (1, "crm")], "k long, t string")
    got = TR.classify_issue_join(twice, "t", TR.rule_tables(spark)["rules"])
    assert got.columns == ["k", "t", "issue_type"] and got.count() == 4


@pytest.mark.parametrize("chars", [1 << 30, 30])
def test_many_rules_against_brute_force(spark, chars):
    import random
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    kws = [(rng.randint(0, 9) if i % 7 else None, word(rng.randint(1, 4)) if i % 11 else None, f"c{i % 5}" if i % 13 else None) for i in range(60)]
    kws += [(5, "", "all")] if chars > 100 else []
    texts = [(i, word(rng.randint(0, 30)).upper() if i % 9 else None, "clash", "x") for i in range(300)]
    df = spark.createDataFrame(texts, "c_0 long, t string, _text string, _found string").repartition(3)
    rule_df = spark.createDataFrame(kws, "priority int, keyword string, category string")
    got = {r["c_0"]: r["issue_type"] for r in TR.classify_issue_join(df, "t", rule_df, rule_chars=chars).collect()}
    order = sorted((k for k in kws if k[1] is not None), key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2] is not None, k[2] or ""))
    for i, t, *_ in texts:
        first = next((c for _, k, c in order if k in (t or "").lower()), None)
        assert got[i] == (first or "unknown"), (t, first)


def test_a_hundred_thousand_rules(spark):
    import time
    rule_df = spark.range(100_000).select(F.col("id").cast("int").alias("priority"), F.concat(F.lit("key"), F.col("id").cast("string"), F.lit("!")).alias("keyword"),
                                          F.concat(F.lit("c"), (F.col("id") % 100).cast("string")).alias("category"))
    df = spark.range(2000).select("id", F.concat(F.lit("some text key"), F.col("id") * 50, F.lit("! and KEY"), F.col("id") * 51 + 7, F.lit("! end")).alias("t"))
    start = time.time()
    got = {r["id"]: r["issue_type"] for r in TR.classify_issue_join(df, "t", rule_df).collect()}
    known = lambda n: n < 100_000
    assert got == {i: f"c{min(x for x in (i * 50, i * 51 + 7) if known(x)) % 100}" if known(i * 50) or known(i * 51 + 7) else "unknown" for i in range(2000)}
    assert time.time() - start < 60


def test_confidence_must_be_a_decimal_number(spark):
    good = {"0.95": 0.95, " 0.95 ": 0.95, "1": 1.0, "9e-1": 0.9, ".5": 0.5, "5.": 5.0, "-0.1": -0.1}
    rows = [(v, '{"action":"update_order","confidence":"%s"}' % v) for v in [*good, "0.95d", "0.95f", "0x1p0", "1_0", "NaN", "Infinity", "high", ""]]
    got = {r["v"]: (r["confidence_ok"], r["confidence"]) for r in TR.parse_decision(
        spark.createDataFrame(rows, "v string, llm_output string")).collect()}
    assert got == {v: (v in good, good.get(v)) for v, _ in rows}


def test_extract_object_is_linear(spark):
    import time

    from triagelake.functions import jsonx
    rows = [("{" * 1_000_000,), ("}" * 1_000_000,), ("} {",), ('a {"b": {"c": 1}} d',), (None,), ("{\n}",)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    start = time.time()
    got = [r[0] for r in df.select(jsonx.extract_object("t")).collect()]
    assert got == ["", "", "", '{"b": {"c": 1}}', None, "{\n}"] and time.time() - start < 20


def test_unicode_whitespace(spark):
    from triagelake.functions.text import nonblank, pystrip
    texts = ["\u00a0", "\u2003 x\u3000", "\x1f\t", "a\u00a0b", "\u200b", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["s"], r["b"]) for r in df.select("i", pystrip("t").alias("s"), nonblank("t").alias("b")).collect()}
    assert got == {i: (t.strip() if t is not None else None, bool(t and t.strip())) for i, t in enumerate(texts)}


def test_ci_route(spark):
    df = spark.createDataFrame([("rod-osm",), ("OurTelco",), (" BRM",), (None,), ("brm",)], "ci string")
    got = [r["route"] for r in TR.ci_route(df, "ci", TR.rule_tables(spark)["ci_alias"]).orderBy(
        F.monotonically_increasing_id()).collect()]
    assert sorted(got) == sorted(["retry_order", "sync_customer_data", rules.NO_CI_ROUTE,
                                  rules.NO_CI_ROUTE, "fix_asset_mismatch"])


def test_answers_are_parsed_once(spark, sf_small):
    from triagelake.plans.catalog import QUERIES
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    for name in ("prompt_payload", "decision_gate", "action_plan"):
        plan = QUERIES[name](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and plan.count("regexp_extract") <= 4, name


def test_reason_tells_what_the_parser_found(spark):
    import json
    bad = ['{"a":1,}', "{'a': 1}", '{"a" 1}', '{"a":1} {"b":2}', '{"a":tru}', '{"a":"x}', "{\n\n]}", "{" * 5 + "}"]
    rows = [(i, t) for i, t in enumerate([*bad, '{"a": NaN}', "no object", '{"action":"update_order","confidence":0.95}'])]
    req = spark.createDataFrame([(i, "order", "x") for i, _ in rows], "request_id long, query string, configuration_item string")
    got = {r["request_id"]: r["reason"] for r in TR.decide(req, spark.createDataFrame(rows, "request_id long, llm_output string")).collect()}
    for i, t in enumerate(bad):
        with pytest.raises(ValueError) as e:
            json.loads(t)
        assert got[i] == rules.REASON_INVALID_JSON.format(error=str(e.value), output=t), t
    assert rules.ERROR_NOT_STRICT in got[len(bad)] and "No JSON found" in got[len(bad) + 1] and got[len(bad) + 2] == rules.REASON_APPROVED
