"""Classification, response parsing and the automation gate.

Every step is a column expression or a join with a small rule table, so a batch of requests is gated in one narrow pass plus the joins
that bring responses and payloads to their requests.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions import jsonx
from ..functions.text import ColumnOrName, _col, empty_to_null, let, pystrip, render, with_once
from ..session import ensure_conf

# A decimal number as text: what a confidence may look like.
DECIMAL_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table built on the JVM (``inline`` of literal structs):
    unlike ``createDataFrame`` on a Python list it needs no Python workers."""
    fields = [f.strip().split() for f in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def rule_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The fixed rule lists as small DataFrames (FIXTURES.md §3)."""
    return {
        "rules": literal_table(
            spark, [(i + 1, kw, cat) for i, (kw, cat) in enumerate(rules.ISSUE_KEYWORDS)],
            "priority int, keyword string, category string"),
        "allowed_action": literal_table(
            spark, [(a,) for a in rules.AUTO_APPROVED_ACTIONS], "action string"),
        "action_registry": literal_table(
            spark, rules.ACTION_REGISTRY, "action string, handler string, body_key string"),
        "ci_alias": literal_table(spark, rules.CI_ALIASES, "alias string, handler string"),
    }


# -- T1 / J5: ordered keyword classifier -------------------------------------

def classify_issue(text: ColumnOrName, keyword_rules=None) -> Column:
    """First rule (in rule order) whose keyword is a substring of the
    lower-cased text; else 'unknown'. NULL text counts as ''."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    expr = None
    for kw, cat in (keyword_rules or rules.ISSUE_KEYWORDS):
        cond = t.contains(F.lit(kw))
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return expr.otherwise(F.lit(rules.UNKNOWN_ISSUE))


#: Characters of keywords in one automaton, and bytes that it may have as sent.
RULE_CHARS = 16_000_000
AUTOMATON_BYTES = 1 << 30


def _automata(rule_df: DataFrame, chars: int) -> Iterator[tuple[bytes, list[str | None], int | None]]:
    """Pickled Aho-Corasick automata of the rules in order, each of at most
    about ``chars`` characters of keywords, with their rules' categories and
    the place of an empty keyword. A keyword's value is that of its first rule."""
    import ahocorasick
    rules_in_order = rule_df.where("keyword IS NOT NULL").select("priority", "keyword", "category").orderBy("priority", "keyword", "category")
    machine, categories, empty, size = ahocorasick.Automaton(), [], None, 0

    def sealed():
        if len(machine):
            machine.make_automaton()
        blob = pickle.dumps(machine if len(machine) else None)
        if len(blob) > AUTOMATON_BYTES:
            raise ValueError(f"an automaton of {len(blob)} bytes; lower RULE_CHARS")
        return blob, categories, empty
    for r in rules_in_order.toLocalIterator():
        if not r["keyword"]:
            empty = len(categories) if empty is None else empty
        elif r["keyword"] not in machine:
            machine.add_word(r["keyword"], len(categories))
        categories.append(r["category"])
        size += len(r["keyword"])
        if size >= chars:
            yield sealed()
            machine, categories, empty, size = ahocorasick.Automaton(), [], None, 0
    if categories:
        yield sealed()


def _first_rules(blob, names: list[str]):
    """Arrow function: the category of the first rule whose keyword is in the
    lower-cased text (last column but one), for rows without one so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, categories, empty = blob.value
        machine = pickle.loads(packed)
        for batch in batches:
            out = []
            for text, found in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if found is None:
                    first = min((place for _, place in machine.iter(text)), default=None) if machine is not None else None
                    if empty is not None and (first is None or empty < first):
                        first = empty
                    found = None if first is None else {"category": categories[first]}
                out.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.struct([("category", pa.string())]))], names)
    return run


def classify_issue_join(df: DataFrame, text_col: str, rule_df: DataFrame,
                        out_col: str = "issue_type", rule_chars: int = RULE_CHARS) -> DataFrame:
    """J5 for rules given as a table (priority, keyword, category): every row
    of ``df`` with its category added; no row is merged or shuffled.

    A row takes the category of the matching rule of the lowest priority,
    'unknown' without one. The rules become an Aho-Corasick automaton, so a
    text is read once however many rules there are; more than ``rule_chars``
    characters of keywords become several automata that the rows pass in rule
    order. Rules without a keyword are left out, an empty keyword is in every
    text; an automaton's size is checked before it is sent."""
    spark = df.sparkSession
    names = df.columns
    # inner names by place, so that no column of the caller can clash
    inner = df.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)],
                      F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("_text"),
                      F.lit(None).cast("struct<category:string>").alias("_found"))
    for machine in _automata(rule_df, rule_chars):
        inner = inner.mapInArrow(_first_rules(spark.sparkContext.broadcast(machine), inner.columns), inner.schema)
    given = [F.col(f"c_{i}").alias(c) for i, c in enumerate(names) if c != out_col]
    return inner.select(*given, F.coalesce("_found.category", F.lit(rules.UNKNOWN_ISSUE)).alias(out_col))


# -- T2: network deny rule -----------------------------------------------------

def network_denied(issue_type: ColumnOrName, ci: ColumnOrName) -> Column:
    """Category 'network' and the lower-cased CI in the deny list."""
    return ((_col(issue_type) == F.lit(rules.NETWORK_CATEGORY))
            & F.lower(F.coalesce(_col(ci), F.lit(""))).isin(*rules.NETWORK_DENY_CIS))


# -- T11 / J4: route by configuration item -----------------------------------

def ci_route(df: DataFrame, ci_col: str, ci_alias: DataFrame, out_col: str = "route") -> DataFrame:
    """Upper-cased (untrimmed) CI looked up in the alias table; no match
    gives the fixed 'no automation' message. An equi-join, whose strategy
    Spark chooses by size."""
    a = ci_alias.select(F.col("alias").alias("_alias"), F.col("handler").alias("_h"))
    j = df.join(a, F.upper(F.coalesce(F.col(ci_col), F.lit(""))) == F.col("_alias"), "left")
    return j.withColumn(out_col, F.coalesce(F.col("_h"), F.lit(rules.NO_CI_ROUTE))).drop("_alias", "_h")


# -- T3-T6: strict parse of a model answer -------------------------------------

_DECISION_SCHEMA = T.StructType([T.StructField("action", T.StringType()),
                                 T.StructField("confidence", T.StringType())])
_JSON_OPTS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
              "allowUnquotedFieldNames": "false"}


def parse_decision(df: DataFrame, output_col: str = "llm_output") -> DataFrame:
    """Adds json_ok, action, has_confidence, confidence, confidence_ok.

    json_ok: the fence-stripped text has a first-{ to last-} span that is one
    strict JSON object. action defaults to 'none' only when the key is
    missing; confidence defaults to 0.0 when the key is missing, and is
    NULL with confidence_ok = false when present but not a finite decimal
    number (a cast alone would also take suffixes and hexadecimal floats).
    """
    ensure_conf(df.sparkSession)
    p = with_once(df, let(jsonx.extract_object(jsonx.strip_code_fence(output_col)), lambda j: F.struct(
        j.alias("json_text"), F.coalesce(jsonx.is_strict_object(j), F.lit(False)).alias("json_ok"),
        F.from_json(j, _DECISION_SCHEMA, _JSON_OPTS).alias("_fields"), jsonx.object_keys(j).alias("_keys"))))
    has = lambda key: F.coalesce(F.array_contains("_keys", F.lit(key)), F.lit(False))
    number = lambda text: F.when(text.rlike(DECIMAL_NUMBER), text.try_cast("double"))
    finite = lambda x: F.when((x == x) & (F.abs(x) != F.lit(float("inf"))) & ~F.isnan(x), x)
    value = F.when(~has("confidence"), F.lit(0.0)).otherwise(let(pystrip(F.col("_fields.confidence")), lambda t: let(number(t), finite)))
    p = with_once(p, F.struct(
        F.when(F.col("json_ok"), F.when(has("action"), F.col("_fields.action")).otherwise(F.lit("none"))).alias("action"),
        F.when(F.col("json_ok"), has("confidence")).alias("has_confidence"),
        F.when(F.col("json_ok"), value).alias("confidence")))
    return p.withColumn("confidence_ok", F.when(F.col("json_ok"), F.col("confidence").isNotNull())).drop("_fields", "_keys")


# -- T7: approval gate -----------------------------------------------------------

def gate(action: ColumnOrName, confidence: ColumnOrName,
         threshold: float = rules.CONFIDENCE_THRESHOLD) -> Column:
    """Action in the allow-list and confidence >= threshold (inclusive)."""
    return F.coalesce(_col(action).isin(*rules.AUTO_APPROVED_ACTIONS)
                      & (_col(confidence) >= F.lit(threshold)), F.lit(False))


# -- T8: invoice payload check ----------------------------------------------------

def check_payload(df: DataFrame, output_col: str = "llm_output") -> DataFrame:
    """Adds payload_json (the extracted object) and payload_ok: a strict JSON
    object with no 'error' key and with 'client_id' and 'line_items' keys
    (NULL values pass, as only key presence is checked)."""
    ensure_conf(df.sparkSession)
    has = lambda keys, key: F.coalesce(F.array_contains(keys, F.lit(key)), F.lit(False))
    right = lambda keys: ~has(keys, "error") & has(keys, "client_id") & has(keys, "line_items")
    return with_once(df, let(jsonx.extract_object(jsonx.strip_code_fence(output_col)), lambda j: F.struct(
        j.alias("payload_json"),
        (F.coalesce(jsonx.is_strict_object(j), F.lit(False)) & let(jsonx.object_keys(j), right)).alias("payload_ok"))))


# -- T2 + T5-T9: decision record ---------------------------------------------------

def decide(requests: DataFrame, responses: DataFrame | None = None,
           payloads: DataFrame | None = None, *, key: str = "request_id",
           threshold: float = rules.CONFIDENCE_THRESHOLD, carry: Sequence[str] = ()) -> DataFrame:
    """Decision record per request.

    ``requests``: key, query, configuration_item. ``responses``: key,
    llm_output (decision answers). ``payloads``: key, llm_output (invoice
    answers). Requests are joined to their answers with left equi-joins;
    the deny rule is evaluated first, so denied rows never need an answer.

    Output: key, automation_allowed, approved_action, confidence, reason,
    payload (JSON text), llm_raw_output (first 500 characters), llm_output
    (the whole answer), and the request's columns named in ``carry``.
    """
    r = requests.select(key, "query", "configuration_item", *[c for c in carry if c not in ("query", "configuration_item")])
    r = r.withColumn("_issue", classify_issue("query"))
    if responses is not None:
        r = r.join(responses.select(key, F.col("llm_output").alias("_out")), key, "left")
    else:
        r = r.withColumn("_out", F.lit(None).cast("string"))
    p = parse_decision(r, "_out")
    allowed0 = p["json_ok"] & p["confidence_ok"] & gate("action", "confidence", threshold)
    p = p.withColumn("_allowed0", F.coalesce(allowed0, F.lit(False)))
    is_invoice = F.col("action").isin(*rules.INVOICE_ACTIONS)
    if payloads is not None:
        pl = check_payload(payloads.select(key, "llm_output"), "llm_output").select(
            key, F.col("payload_json").alias("_pj"), F.col("payload_ok").alias("_pok"))
        p = p.join(pl, key, "left")
    else:
        p = p.withColumn("_pj", F.lit(None).cast("string")).withColumn("_pok", F.lit(None).cast("boolean"))
    needs_payload = F.col("_allowed0") & is_invoice
    allowed = F.col("_allowed0") & (~needs_payload | F.coalesce(F.col("_pok"), F.lit(False)))
    p = p.withColumn("_allowed", allowed)
    denied = network_denied("_issue", "configuration_item")
    no_answer = F.col("_out").isNull()
    bad_json = ~F.col("json_ok")
    bad_conf = ~F.coalesce(F.col("confidence_ok"), F.lit(False))
    shown = F.left(F.col("_out"), F.lit(rules.ERROR_OUTPUT_CHARS))
    detail = jsonx.parse_error("json_text", bad_json & (F.col("json_text") != ""))
    error = F.when(F.col("json_text") == "", render(rules.ERROR_NO_JSON, output=shown)).otherwise(F.coalesce(detail, F.lit(rules.ERROR_NOT_STRICT)))
    reason = (F.when(denied, F.lit(rules.NETWORK_DENY_REASON))
              .when(no_answer, F.lit(rules.REASON_NO_ANSWER))
              .when(bad_json, render(rules.REASON_INVALID_JSON, error=error, output=shown))
              .when(bad_conf, F.lit(rules.REASON_INVALID_CONFIDENCE))
              .when(F.col("_allowed"), F.lit(rules.REASON_APPROVED))
              .otherwise(F.lit(rules.REASON_NOT_APPROVED)))
    early = denied | no_answer | bad_json | bad_conf
    return p.select(
        key,
        F.when(early, F.lit(False)).otherwise(F.col("_allowed")).alias("automation_allowed"),
        F.when(~early & F.col("_allowed"), F.col("action")).alias("approved_action"),
        F.when(early, F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence"),
        reason.alias("reason"),
        F.when(~early & F.col("_allowed") & is_invoice, F.col("_pj")).alias("payload"),
        F.when(~early, F.left(F.col("_out"), F.lit(rules.RAW_OUTPUT_CHARS))).alias("llm_raw_output"),
        F.when(~early, F.col("_out")).alias("llm_output"), *carry)


# -- T10: assignment group ------------------------------------------------------

def assignment_group(hits: DataFrame, group_answers: DataFrame | None = None,
                     qid: str = "qid", requests: DataFrame | None = None) -> DataFrame:
    """Per query: the rank-1 hit's group when that hit is an incident with a
    real group; else the trimmed model answer when there is one; else
    'Service Desk'. Reads rank-1 rows only (a filter, no aggregation). With
    ``requests`` (having the ``qid`` column) every request gets a row, also
    one whose search found nothing."""
    top = hits.where(F.col("rank") == 1).select(
        qid,
        F.when((F.col("source") == F.lit(rules.SOURCE_INCIDENT))
               & ~F.coalesce(F.col("assignment_group"), F.lit(rules.NOT_PROVIDED))
                   .isin(rules.NOT_PROVIDED, rules.NOT_APPLICABLE),
               F.col("assignment_group")).alias("_g"))
    if requests is not None:
        top = requests.select(qid).join(top, qid, "left")
    if group_answers is not None:
        ga = group_answers.select(F.col(qid), empty_to_null(pystrip("llm_output")).alias("_a"))
        top = top.join(ga, qid, "left")
    else:
        top = top.withColumn("_a", F.lit(None).cast("string"))
    return top.select(qid, F.coalesce("_g", "_a", F.lit(rules.DEFAULT_GROUP)).alias("assignment_group"))


__all__ = ["rule_tables", "classify_issue", "classify_issue_join", "network_denied", "ci_route",
           "parse_decision", "gate", "check_payload", "decide", "assignment_group", "render"]
