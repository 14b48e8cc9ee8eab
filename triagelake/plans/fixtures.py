"""Derived input views (FIXTURES.md §2) built with the DataFrame API from the
driver's tables. The same definitions exist as SQL in ``plans/oracle.py``.

Every view is a projection of one base table (plus the orders-customer
equi-join for ``incident``), so it scales with its input and needs no
shuffle except that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..sources.tables import read_table


def _case(key: Column, mapping: list[tuple[int, Column | str | None]], default=None) -> Column:
    expr = None
    for k, v in mapping:
        val = F.lit(v) if not isinstance(v, Column) else v
        expr = F.when(key == F.lit(k), val) if expr is None else expr.when(key == F.lit(k), val)
    dv = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(dv)


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _inc_key(c: str) -> Column:
    return F.concat(F.lit("INC"), F.lpad(_s(c), 7, "0"))


def incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    k = F.col("o_orderkey")
    return j.select(
        _inc_key("o_orderkey").alias("number"),
        _case(k % 8, [
            (0, F.concat(F.lit("VPN login fails for "), F.col("c_name"))),
            (1, F.concat(F.lit("Order fallout on order "), _s("o_orderkey"))),
            (2, F.concat(F.lit("CRM profile mismatch for "), F.col("c_name"))),
            (3, F.concat(F.lit("Billing invoice missing for "), F.col("c_name"))),
            (4, "Author page border wrong"),
            (5, F.concat(F.lit("Printer jam in "), F.col("c_mktsegment"))),
            (6, ""),
        ]).alias("short_description"),
        _case(F.col("o_custkey") % 5, [
            (0, None), (1, "Network Support"), (2, "Application Support"), (3, "Database Team"),
        ], "Service Desk").alias("assignment_group"),
        _case(k % 6, [
            (0, "ROD-OSM"), (1, "Sie-CRM"), (2, "ROD-BRM"), (3, "OurTelco"), (4, "VPN-GW"),
        ]).alias("configuration_item"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Closed as "), F.col("o_orderpriority"))).alias("resolution_notes"),
    )


def request(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    k = F.col("event_id")
    return e.select(
        k.alias("request_id"),
        _case(k % 8, [
            (0, F.concat(F.lit("vpn down for user "), _s("user_id"))),
            (1, F.concat(F.lit("retry order "), _s("event_id"))),
            (2, "customer cannot login to order portal"),
            (3, F.concat(F.lit("create invoice for client "), _s("user_id"))),
            (4, "crm profile out of sync"),
            (5, "screen flickers"),
            (6, F.when(k % 16 == 6, "   ").otherwise("\u00a0\u2003")),
        ]).alias("query"),
        _case(k % 7, [
            (0, "rod-osm"), (1, "SIE-CRM"), (2, "BRM"), (3, "OurTelco"), (4, "OSM"), (5, "printer"),
        ]).alias("configuration_item"),
        _case(k % 5, [(0, ""), (1, None)], _inc_key("event_id")).alias("ticket_id"),
        _case(k % 5, [(0, _inc_key("event_id"))]).alias("sys_id"),
        F.when(k % 4 == 0, F.lit(None).cast("int")).otherwise((k % 4).cast("int")).alias("top_k"),
    )


def request_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests with one ticket per user, so that a ticket has many."""
    ids = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("_e"), "user_id")
    r = request(spark, sf_dir).join(ids, F.col("request_id") == F.col("_e"))
    return r.withColumn("ticket_id", _inc_key("user_id")).withColumn("sys_id", F.lit(None).cast("string")).drop("_e", "user_id")


_NL = "\n"


def response(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id")
    shapes = [
        (0, '{"action":"update_order","confidence":0.95,"reasoning":"ok"}'),
        (1, "```json" + _NL + '{"action":"sync_customer_data","confidence":0.9,"reasoning":"ok"}' + _NL + "```"),
        (2, "```" + _NL + '{"action":"restart_server","confidence":0.89,"reasoning":"ok"}' + _NL + "```"),
        (3, 'Sure: {"action":"create_invoice","confidence":0.97,"reasoning":"ok"} hope it helps'),
        (4, "I cannot help with that."),
        (5, '{"action":"none","confidence":0.0,"reasoning":"vague"}'),
        (6, '{"action":"update_order","confidence":"0.93","reasoning":"string number"}'),
        (7, '{"action":"update_order"}'),
        (8, '{"action":"retry_order","confidence":0.99,"reasoning":"not on list"}'),
        (9, '{"action":"update_order","confidence":0.99} and {"x":1}'),
        (10, "LLaMA Error: 429 {'error': 'rate'}"),
        (11, '{"action":"update_order","confidence":"0.95d"}'),
        (12, '{"action":"update_order","confidence":"0x1p0"}'),
        (13, '{"action":"update_order","confidence":"0.95f"}'),
    ]
    return e.select(k.alias("request_id"),
                    _case(k % 15, shapes, '{"action":"update_order","confidence":"high"}').alias("llm_output"))


def response_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure answers that name every approved action in turn."""
    e = read_table(spark, sf_dir, "events").select("event_id")
    n = len(rules.AUTO_APPROVED_ACTIONS)
    action = _case(F.floor(F.col("event_id") / 8) % n, list(enumerate(rules.AUTO_APPROVED_ACTIONS)))
    return e.select(F.col("event_id").alias("request_id"),
                    F.concat(F.lit('{"action":"'), action, F.lit('","confidence":0.95,"reasoning":"ok"}')).alias("llm_output"))


def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    good = F.concat(
        F.lit('{"client_id":"'), _s("o_custkey"),
        F.lit('","line_items":[{"product_key":"p","notes":"n","cost":'),
        F.floor(F.col("o_totalprice")).cast("long").cast("string"),
        F.lit(',"quantity":2}]}'))
    return o.select(k.alias("request_id"), _case(k % 6, [
        (0, good),
        (1, '{"error":"insufficient_data"}'),
        (2, '{"client_id":"7"}'),
        (3, '{"client_id":null,"line_items":[]}'),
        (4, "no payload found"),
    ], "```json" + _NL + '{"client_id":"9","line_items":[]}' + _NL + "```").alias("llm_output"))


def action_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id")
    return e.select(
        k.alias("request_id"),
        _case(k % 4, [(0, "retry_order"), (1, "sync_customer_data"), (2, "fix_asset_mismatch")], "create_invoice").alias("handler"),
        _case(k % 7, [(0, 200), (1, 201), (2, 404), (3, 500), (4, 200), (5, 200)]).cast("int").alias("http_code"),
        _case(k % 7, [
            (0, F.concat(F.lit('{"id":"'), _s("event_id"), F.lit('"}'))),
            (1, "{}"), (2, "not found"), (3, '{"http_status":502}'),
            (4, '{"status":"failure","message":"order not found"}'),
            (5, F.concat(F.lit('{"id":"'), _s("event_id"), F.lit('","status":"success","message":"Order '), _s("event_id"), F.lit(' retried"}'))),
        ]).alias("body"),
    )


def update_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of the two ticket updates (seq 1: fields, 2: resolve or escalate)."""
    e = read_table(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    k = F.col("event_id") + F.col("seq")
    return e.select(
        F.col("event_id").alias("request_id"), "seq",
        _case(k % 5, [(0, 200), (1, 204), (2, 404), (3, 500)]).cast("int").alias("http_code"),
        _case(k % 5, [(0, '{"result":"ok"}'), (1, "{}"), (2, "not found"), (3, '{"http_status":502}')]).alias("body"))


def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id")
    return e.where(k % 4 != 0).select(
        k.alias("request_id"),
        _case(k % 4, [(1, F.concat(F.lit("  1. Restart the client of user "), _s("event_id"))), (2, "Ask the Service Desk.\n")],
              "LLaMA Error: 500").alias("llm_output"))


def group_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id")
    return e.where(k % 3 != 0).select(k.alias("request_id"), _case(k % 3, [(1, " Database Team\n")], "   ").alias("llm_output"))
