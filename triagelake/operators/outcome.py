"""Action plans, action results, outcomes and ticket updates.

Calls to outside services are table boundaries: ``action_plan`` writes what
would be called, ``interpret_action_result`` / ``interpret_update_response``
read what came back, and ``ticket_updates`` is the table of PATCH bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import jsonx
from ..functions.text import ColumnOrName, _col, empty_to_null, fmt_fixed, pystrip, render
from ..sources.tables import keep_table
from .corpus import number_within

# -- J3 / T12 / O1 / O2 ---------------------------------------------------------


def with_plan(decisions: DataFrame, registry: DataFrame) -> DataFrame:
    """Decisions (which carry their query) with the plan of their action:
    ``handler`` and ``plan_body`` to call with, ``plan_status`` ('planned',
    'error', NULL if not approved) and ``plan_message``. An error: no handler
    is mapped, or an invoice has no payload.

    Body: ``{"<body_key>": strip(query)}`` for order/customer/asset handlers,
    the validated payload JSON for invoice handlers.
    """
    reg = registry.select(F.col("action").alias("_ra"), "handler", "body_key")
    j = decisions.join(reg, F.col("approved_action") == F.col("_ra"), "left")
    is_invoice = F.col("approved_action").isin(*rules.INVOICE_ACTIONS)
    no_handler = F.col("handler").isNull()
    no_payload = is_invoice & F.col("payload").isNull()
    body = F.when(is_invoice, F.col("payload")).otherwise(
        F.to_json(F.create_map(F.col("body_key"), pystrip(F.coalesce(F.col("query"), F.lit(""))))))
    allowed = F.coalesce(F.col("automation_allowed"), F.lit(False))
    message = (F.when(no_handler, F.concat(F.lit(rules.MSG_NO_HANDLER), F.col("approved_action")))
               .when(no_payload, F.lit(rules.MSG_NEEDS_PAYLOAD)))
    return j.withColumns({
        "plan_status": F.when(allowed, F.when(no_handler | no_payload, F.lit("error")).otherwise(F.lit("planned"))),
        "plan_body": F.when(allowed & ~no_handler & ~no_payload, body),
        "plan_message": F.when(allowed, message)}).drop("_ra", "body_key")


def action_plan(planned: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per approved decision (see ``with_plan``)."""
    return planned.where(F.col("plan_status").isNotNull()).select(
        key, F.col("approved_action").alias("action"), "handler", F.col("plan_status").alias("status"),
        F.col("plan_body").alias("body"), F.col("plan_message").alias("message"))


# -- O3 / O4 ------------------------------------------------------------------------


def result_columns(handler: Column, code: Column, body: Column) -> dict[str, Column]:
    """O3: status, message and invoice id of a call's response, by handler.

    The invoice handler: 200 -> success with the invoice id from the body;
    anything else (including a missing code) -> failure with the body text as
    message. Every other handler answers with its own status and message,
    whatever the code. A body that should be a JSON object and is none gives
    the status 'error'. ``mcp_body`` is the whole answer of a handler other than
    the invoice one, with whatever keys it has.
    """
    ok = F.coalesce(code == F.lit(200), F.lit(False))
    invoice = F.coalesce(handler == F.lit(rules.INVOICE_HANDLER), F.lit(False))
    readable = F.coalesce(jsonx.is_strict_object(body) & pystrip(body).startswith("{"), F.lit(False))
    refused = invoice & ~ok
    return {
        "mcp_status": F.when(refused, F.lit(rules.STATUS_FAILURE)).when(~readable, F.lit(rules.STATUS_ERROR))
                       .when(invoice, F.lit(rules.STATUS_SUCCESS)).otherwise(jsonx.get_text(body, "status")),
        "mcp_message": F.when(refused, body).when(~readable, F.lit(rules.ERROR_BODY_NOT_JSON))
                        .when(invoice, F.lit(rules.MSG_INVOICE_CREATED)).otherwise(jsonx.get_text(body, "message")),
        "invoice_id": F.when(invoice & ok & readable, jsonx.get_text(body, "id")),
        "mcp_body": F.when(~invoice & readable, body),
    }


def interpret_action_result(results: DataFrame, key: str = "request_id", whole: bool = False) -> DataFrame:
    """O3 for a table of responses (key, handler, http_code, body); with
    ``whole`` also ``mcp_body``."""
    read = result_columns(F.col("handler"), F.col("http_code"), F.col("body"))
    return results.select(key, *[c.alias(n) for n, c in read.items() if whole or n != "mcp_body"])


def _with_status_code(body: Column, code: Column) -> Column:
    """Append ``"http_status": code`` to a JSON object text that lacks it."""
    is_obj = F.coalesce(jsonx.is_strict_object(body) & pystrip(body).startswith("{"), F.lit(False))
    lacks = ~jsonx.has_key(body, "http_status")
    empty = pystrip(body).rlike(r"^\{\s*\}$")
    code_txt = code.cast("string")
    added = F.when(empty, F.concat(F.lit('{"http_status":'), code_txt, F.lit("}"))).otherwise(
        F.regexp_replace(body, r"\}\s*$", F.concat(F.lit(',"http_status":'), code_txt, F.lit("}"))))
    return F.when(is_obj & lacks & code.isNotNull(), added).otherwise(body)


def interpret_update_response(results: DataFrame, key: str = "request_id") -> DataFrame:
    """Ok when 200 <= code < 300; a failed JSON-object response gets the
    status code attached unless it already has one."""
    code = F.col("http_code")
    ok = F.coalesce(code.between(200, 299), F.lit(False))
    return results.select(key, ok.alias("update_ok"),
                          F.when(ok, F.col("body")).otherwise(_with_status_code(F.col("body"), code))
                          .alias("update_response"))


def both_updates(results: DataFrame, key: str = "request_id") -> DataFrame:
    """O4 for both calls of a request (``seq`` 1: the field update, 2: the
    resolve or escalate update), one row per request. At most one row per
    call; of repeated ones the largest struct counts."""
    r = results.withColumn("_k", F.struct(key, "seq"))
    read = interpret_update_response(r, "_k").select(F.col(f"_k.{key}").alias(key), F.col("_k.seq").alias("seq"), "update_ok", "update_response")
    pick = lambda n: F.max(F.when(F.col("seq") == n, F.struct("update_ok", "update_response")))
    g = read.groupBy(key).agg(pick(1).alias("_f"), pick(2).alias("_u"))
    return g.select(key, "_u.update_ok", "_u.update_response", F.col("_f.update_ok").alias("field_update_ok"),
                    F.col("_f.update_response").alias("field_update_response"))


# -- O5-O8, O11 ---------------------------------------------------------------------


def _none(c: ColumnOrName) -> Column:
    """Python's rendering of a missing value inside an f-string."""
    return F.coalesce(_col(c).cast("string"), F.lit("None"))


def action_answer() -> Column:
    """The action's result as JSON: the handler's whole answer, or status,
    message and invoice id where the engine says what came of the call."""
    own = F.to_json(F.struct(F.col("mcp_status").alias("status"), F.col("mcp_message").alias("message"), F.col("invoice_id")), {"ignoreNullFields": "false"})
    return F.coalesce("mcp_body", own)


def outcome(planned: DataFrame, action_results: DataFrame | None = None, answers: DataFrame | None = None,
            update_results: DataFrame | None = None, key: str = "request_id",
            threshold: float = rules.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Outcome per planned decision (``with_plan``; it carries ``ticket_key``)
    that has a ticket key (O12).

    Joins (left, on the request key): action result (O3), optional answer
    text and optional ticket-update responses (O4; key, seq, http_code,
    body). Requests and decisions are not read again.
    Produces the success rule (O5), failure reasons (O6), the three notes
    (O7) with their defaults (O8) and the status label (O11).
    """
    d = (planned.where(F.col("ticket_key").isNotNull())
         .withColumnsRenamed({"plan_status": "_plan_status", "plan_message": "_plan_msg", "handler": "_handler"}))
    if action_results is not None:
        d = d.join(action_results.select(key, F.col("http_code").alias("_code"), F.col("body").alias("_body"),
                                         F.lit(True).alias("_called")), key, "left")
        read = result_columns(F.col("_handler"), F.col("_code"), F.col("_body"))
        d = d.withColumns({n: F.when(F.col("_called"), c) for n, c in read.items()})
    else:
        d = (d.withColumn("mcp_status", F.lit(None).cast("string"))
              .withColumn("mcp_message", F.lit(None).cast("string"))
              .withColumn("invoice_id", F.lit(None).cast("string")).withColumn("mcp_body", F.lit(None).cast("string")))
    if answers is not None:
        d = d.join(answers.select(key, F.col("answer").alias("_ans")), key, "left")
    else:
        d = d.withColumn("_ans", F.lit(None).cast("string"))
    names = ["update_ok", "update_response", "field_update_ok", "field_update_response"]
    if update_results is not None:
        d = d.join(both_updates(update_results, key), key, "left")
    else:
        d = d.withColumns({n: F.lit(None).cast("boolean" if n.endswith("ok") else "string") for n in names})

    allowed = F.coalesce(F.col("automation_allowed"), F.lit(False))
    ran = allowed & (F.col("_plan_status") == F.lit("planned"))
    # the action's result exists only when the action was allowed and called
    status = (F.when(allowed & (F.col("_plan_status") == F.lit("error")), F.lit("error"))
               .when(ran, F.col("mcp_status")))
    message = (F.when(allowed & (F.col("_plan_status") == F.lit("error")), F.col("_plan_msg"))
                .when(ran, F.coalesce(F.col("mcp_message"), F.lit(rules.NO_MCP_MESSAGE)))
                .otherwise(F.lit(rules.NO_MCP_MESSAGE)))
    conf = F.coalesce(F.col("confidence"), F.lit(0.0))
    d = d.select(
        key, "ticket_key", allowed.alias("automation_allowed"), conf.alias("confidence"),
        F.coalesce(empty_to_null("reason"), F.lit(rules.NO_DECISION_REASON)).alias("decision_reason"),
        F.coalesce(F.col("llm_raw_output"), F.lit("")).alias("llm_raw"),
        status.alias("mcp_status"), message.alias("mcp_message"),
        F.when(ran, F.col("invoice_id")).alias("invoice_id"), F.when(ran, F.col("mcp_body")).alias("mcp_body"),
        (allowed & F.col("_plan_status").isNotNull()).alias("has_result"),
        F.coalesce(empty_to_null("approved_action"), F.lit(rules.NO_ACTION)).alias("approved_action"),
        F.col("payload"), F.coalesce(F.col("_ans"), F.lit("")).alias("ai_suggestion"),
        *names)
    success = (F.col("automation_allowed") & F.coalesce(F.col("mcp_status") == F.lit("success"), F.lit(False))
               & (F.col("confidence") >= F.lit(threshold)))
    bits = F.array(
        F.when(~F.col("automation_allowed"), F.lit(rules.FAIL_NOT_ALLOWED)),
        F.when(~F.coalesce(F.col("mcp_status") == F.lit("success"), F.lit(False)),
               render(rules.FAIL_MCP_STATUS, mcp_status=_none("mcp_status"))),
        F.when(F.col("confidence") < F.lit(threshold),
               render(rules.FAIL_LOW_CONFIDENCE, confidence=fmt_fixed("confidence"),
                      threshold=F.lit(repr(float(threshold))))))
    fail_reason = F.array_join(F.filter(bits, lambda x: x.isNotNull()), ", ")
    mcp_result = F.when(F.col("has_result"), action_answer()).otherwise(F.lit("{}"))
    d = d.withColumn("success", success).withColumn(
        "fail_reason", F.when(~F.col("success"), F.coalesce(empty_to_null(fail_reason), F.lit(rules.UNSPECIFIED))))
    base = render(rules.BASE_NOTE, field=F.lit(rules.AI_SUGGESTION_FIELD), mcp_status=_none("mcp_status"))
    resolution = render(rules.RESOLUTION_NOTE, confidence=fmt_fixed("confidence"),
                        payload=_none("payload"), mcp_result=mcp_result)
    failure = render(rules.FAILURE_NOTE, llm_raw="llm_raw", payload=_none("payload"), mcp_result=mcp_result)
    kind = F.when(F.col("success"), F.lit("resolve")).otherwise(F.lit("escalate"))
    label = F.lit(None).cast("string")
    for update, (done, failed) in rules.UPDATE_STATUS.items():
        label = F.when(kind == update, F.when(F.coalesce(F.col("update_ok"), F.lit(True)), F.lit(done)).otherwise(F.lit(failed))).otherwise(label)
    return d.select(
        "*", base.alias("base_note"), kind.alias("update_type"),
        F.when(F.col("success"), resolution).otherwise(failure).alias("update_message"),
        label.alias("ticket_update_status"))


# -- O9, O10, O12 ---------------------------------------------------------------------


def update_payload(update_type: ColumnOrName, message: ColumnOrName) -> Column:
    """struct(ok, state, close_notes, work_notes, error) for one update
    call; the type is stripped and lower-cased, unknown types give an error."""
    t = F.lower(pystrip(F.coalesce(_col(update_type), F.lit(""))))
    m = F.coalesce(_col(message), F.lit(""))
    known = t.isin("worknote", "resolve", "escalate")
    return F.struct(
        known.alias("ok"),
        F.when(t == "resolve", F.lit(rules.STATE_RESOLVED))
         .when(t == "escalate", F.lit(rules.STATE_IN_PROGRESS)).cast("int").alias("state"),
        F.when(t == "resolve", m).alias("close_notes"),
        F.when(t == "worknote", m)
         .when(t == "resolve", F.concat(F.lit(rules.RESOLVE_WORK_NOTE_PREFIX), m))
         .when(t == "escalate", F.concat(F.lit(rules.ESCALATE_WORK_NOTE_PREFIX), m)).alias("work_notes"),
        F.when(~known, render(rules.UNKNOWN_UPDATE, update_type=t)).alias("error"))


def ticket_updates(outcomes: DataFrame, key: str = "request_id") -> DataFrame:
    """Two PATCH rows per outcome: (seq 1) field update merged with the base
    work note -- the note wins over a ``work_notes`` field (O10) -- and
    (seq 2) the resolve/escalate update (O9). Both rows come from one pass
    over the outcomes (an explode of a two-element array)."""
    fields = F.create_map(F.lit(rules.AI_SUGGESTION_FIELD), F.col("ai_suggestion"))
    up = update_payload("update_type", "update_message")
    first = F.struct(
        F.lit(1).alias("seq"), F.lit("fields").alias("update_type"),
        F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("close_notes"),
        F.col("base_note").alias("work_notes"),
        F.map_filter(fields, lambda k, v: k != F.lit("work_notes")).alias("fields"))
    second = F.struct(
        F.lit(2).alias("seq"), F.col("update_type").alias("update_type"),
        up["state"].alias("state"), up["close_notes"].alias("close_notes"),
        up["work_notes"].alias("work_notes"),
        F.create_map().cast("map<string,string>").alias("fields"))
    return (outcomes.select("ticket_key", key, F.explode(F.array(first, second)).alias("_u"))
                    .select("ticket_key", key, "_u.seq", "_u.update_type", "_u.state",
                            "_u.close_notes", "_u.work_notes", "_u.fields"))


# -- O13 ------------------------------------------------------------------------------


def apply_updates(tickets: DataFrame, updates: DataFrame, ticket_col: str = "number",
                  key: str = "request_id") -> DataFrame:
    """Effect of the PATCH calls on the ticket table: latest non-NULL state,
    close notes and suggestion per ticket (ordered by request key, then
    sequence), the latest work note and the number of notes. Bounded
    aggregates only (max_by / count), so a ticket with very many updates is
    combined map-side and never collected into one task."""
    order = F.struct(F.col(key), F.col("seq"))
    u = updates.select("ticket_key", order.alias("_o"), "state", "close_notes", "work_notes",
                       F.col("fields")[rules.AI_SUGGESTION_FIELD].alias("_sugg"))

    def latest(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_o")))
    agg = u.groupBy("ticket_key").agg(
        latest("state").alias("state"), latest("close_notes").alias("close_notes"),
        latest("work_notes").alias("last_work_note"),
        F.count("work_notes").alias("n_work_notes"), latest("_sugg").alias(rules.AI_SUGGESTION_FIELD))
    t = tickets.join(agg, tickets[ticket_col] == agg["ticket_key"], "left").drop("ticket_key")
    return t.withColumn("n_work_notes", F.coalesce(F.col("n_work_notes"), F.lit(0)))


def ticket_notes(updates: DataFrame, key: str = "request_id") -> DataFrame:
    """O13, the notes of every ticket in the order of the calls: ticket_key,
    note_no (from 1), work_notes. Rows, not one folded value per ticket, and
    numbered across range partitions, so a ticket with a third of all notes is
    the work of many tasks."""
    notes = updates.where(F.col("work_notes").isNotNull()).select("ticket_key", F.col(key).alias("_at"), "seq", "work_notes")
    return number_within(notes, "ticket_key", ["_at", "seq"], "note_no").select(
        "ticket_key", F.col("note_no").cast("int").alias("note_no"), "work_notes")


# -- J6 / A4 ------------------------------------------------------------------------------


DECISION_FIELDS = ["automation_allowed", "approved_action", "confidence", "reason", "payload", "llm_raw_output"]


def final_record(decisions: DataFrame, folded_hits: DataFrame, outcomes: DataFrame,
                 answers: DataFrame | None = None, key: str = "request_id", by: str | None = None) -> DataFrame:
    """The response record per request, assembled with left joins on the
    request key. ``decisions`` carries query and configuration_item, hits
    arrive folded (A4) with all their fields, ``outcomes`` (requests with a
    ticket) holds the action's result and both update responses. Nested parts
    are JSON text. With ``by``, a column of the decisions, hits are folded by
    it (the group of a request). Hits are joined last, as they are long."""
    js = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    by = by or key
    r = decisions.select(*dict.fromkeys([key, by]), "query", "configuration_item", js(DECISION_FIELDS).alias("decision_engine"),
                         F.coalesce("automation_allowed", F.lit(False)).alias("automation_triggered"))
    if answers is not None:
        r = r.join(answers.select(key, F.col("answer").alias("_a")), key, "left")
        r = r.withColumn("ai_suggestion", F.coalesce("_a", F.lit(""))).drop("_a")
    else:
        r = r.withColumn("ai_suggestion", F.lit(""))
    out = outcomes.select(
        key, F.when(F.col("has_result"), action_answer()).alias("mcp_action_result"),
        F.col("field_update_ok").alias("ticket_ai_field_update_ok"), F.col("field_update_response").alias("ticket_ai_field_update_resp"),
        "ticket_update_status", F.col("update_response").alias("ticket_update_response"))
    r = r.join(out, key, "left")
    similar = folded_hits.select(by, F.to_json("similar_items", {"ignoreNullFields": "false"}).alias("similar_items"))
    if by != key:
        similar = keep_table(similar, "similar-items")  # once per group, and of a known size
    r = r.join(similar, by, "left").withColumn("similar_items", F.coalesce("similar_items", F.lit("[]")))
    return r.select(key, "query", "configuration_item", "decision_engine", "automation_triggered", "similar_items", *[c for c in ("ai_suggestion", *out.columns) if c != key])
