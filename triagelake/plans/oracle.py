"""DuckDB SQL twins of the named queries (the correctness oracle).

All statements share one WITH chain of derived views; DuckDB evaluates
only the views a statement references. Templates and rule lists come from
``rules`` so both engines render the same text.
"""

from __future__ import annotations

import string

from .. import rules

NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def render(template: str, **exprs: str) -> str:
    parts = []
    for literal, field, _s, _c in string.Formatter().parse(template):
        if literal:
            parts.append(lit(literal))
        if field is not None:
            parts.append(f"coalesce(cast(({exprs.get(field, field)}) as varchar), '')")
    return "(" + " || ".join(parts) + ")"


WHITESPACE = " || ".join(f"chr({ord(c)})" for c in rules.WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WHITESPACE})"


def decode(x: str) -> str:
    for ent, ch in rules.HTML_ENTITIES:
        x = f"replace({x}, {lit(ent)}, {lit(ch)})"
    return x


def html_to_text(x: str) -> str:
    s = (f"regexp_replace({x}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', "
         f"'<x>', 'g')")
    s = f"regexp_replace({s}, '(?:<[^>]*>)+', {NL}, 'g')"
    return strip(decode(s))


def html_title(x: str) -> str:
    return strip(decode(f"regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)"))


def classify(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    whens = " ".join(f"when contains({t}, {lit(kw)}) then {lit(cat)}" for kw, cat in rules.ISSUE_KEYWORDS)
    return f"(case {whens} else {lit(rules.UNKNOWN_ISSUE)} end)"


def denied(issue: str, ci: str) -> str:
    lst = ", ".join(lit(c) for c in rules.NETWORK_DENY_CIS)
    return f"({issue} = {lit(rules.NETWORK_CATEGORY)} and lower(coalesce({ci}, '')) in ({lst}))"


def fence_strip(x: str) -> str:
    s = strip(x)
    fj, f, e = lit("```json"), lit("```"), lit("")
    no_json_fence = strip(f"replace(replace({s}, {fj}, {e}), {f}, {e})")
    no_fence = strip(f"replace({s}, {f}, {e})")
    return (f"(case when starts_with({s}, {fj}) then {no_json_fence} "
            f"when starts_with({s}, {f}) then {no_fence} else {s} end)")


def extract_obj(x: str) -> str:
    return f"regexp_extract({x}, '(?s)\\{{.*\\}}', 0)"


def allow_list() -> str:
    return ", ".join(lit(a) for a in rules.AUTO_APPROVED_ACTIONS)


def invoice_list() -> str:
    return ", ".join(lit(a) for a in rules.INVOICE_ACTIONS)


def fmt2(x: str) -> str:
    return f"printf('%.2f', {x})"


def hash_vectors(name: str, src: str, id_expr: str, text_expr: str) -> str:
    """Sparse (id, b, w) unit vectors of hashed tokens."""
    return f"""
{name}_tok as (select {id_expr} as id, unnest(regexp_extract_all(lower(coalesce({text_expr}, '')), '[\\p{{L}}\\p{{N}}]+')) as tok from {src}),
{name}_cnt as (select id, cast((('0x' || substr(md5(tok), 1, 8))::BIGINT) % 64 as integer) as b, count(*) as c from {name}_tok group by 1, 2),
{name}_vec as (select id, b, c / sqrt(sum(c * c) over (partition by id)) as w from {name}_cnt)"""


V_INCIDENT = """
incident as (
select 'INC' || lpad(cast(o_orderkey as varchar(20)), 7, '0') as number,
       case o_orderkey % 8
         when 0 then 'VPN login fails for ' || c_name
         when 1 then 'Order fallout on order ' || cast(o_orderkey as varchar(20))
         when 2 then 'CRM profile mismatch for ' || c_name
         when 3 then 'Billing invoice missing for ' || c_name
         when 4 then 'Author page border wrong'
         when 5 then 'Printer jam in ' || c_mktsegment
         when 6 then '' else null end as short_description,
       case o_custkey % 5
         when 0 then null when 1 then 'Network Support' when 2 then 'Application Support'
         when 3 then 'Database Team' else 'Service Desk' end as assignment_group,
       case o_orderkey % 6
         when 0 then 'ROD-OSM' when 1 then 'Sie-CRM' when 2 then 'ROD-BRM'
         when 3 then 'OurTelco' when 4 then 'VPN-GW' else null end as configuration_item,
       case o_orderkey % 4 when 0 then null else 'Closed as ' || o_orderpriority end as resolution_notes
from orders join customer on o_custkey = c_custkey)"""

_TICKET = """case event_id % 5 when 0 then '' when 1 then null
         else 'INC' || lpad(cast(event_id as varchar(20)), 7, '0') end"""
_SYS_ID = """case event_id % 5 when 0 then 'INC' || lpad(cast(event_id as varchar(20)), 7, '0')
         else null end"""


def v_request(ticket: str = _TICKET, sys_id: str = _SYS_ID) -> str:
    return f"""
request as (
select event_id as request_id,
       case event_id % 8
         when 0 then 'vpn down for user ' || cast(user_id as varchar(20))
         when 1 then 'retry order ' || cast(event_id as varchar(20))
         when 2 then 'customer cannot login to order portal'
         when 3 then 'create invoice for client ' || cast(user_id as varchar(20))
         when 4 then 'crm profile out of sync'
         when 5 then 'screen flickers'
         when 6 then (case when event_id % 16 = 6 then '   ' else chr(160) || chr(8195) end) else null end as query,
       case event_id % 7
         when 0 then 'rod-osm' when 1 then 'SIE-CRM' when 2 then 'BRM' when 3 then 'OurTelco'
         when 4 then 'OSM' when 5 then 'printer' else null end as configuration_item,
       {ticket} as ticket_id,
       {sys_id} as sys_id,
       case when event_id % 4 = 0 then null else cast(event_id % 4 as int) end as top_k
from events)"""

V_RESPONSE = """
response as (
select event_id as request_id,
       case event_id % 15
         when 0 then '{"action":"update_order","confidence":0.95,"reasoning":"ok"}'
         when 1 then '```json' || chr(10) || '{"action":"sync_customer_data","confidence":0.9,"reasoning":"ok"}' || chr(10) || '```'
         when 2 then '```' || chr(10) || '{"action":"restart_server","confidence":0.89,"reasoning":"ok"}' || chr(10) || '```'
         when 3 then 'Sure: {"action":"create_invoice","confidence":0.97,"reasoning":"ok"} hope it helps'
         when 4 then 'I cannot help with that.'
         when 5 then '{"action":"none","confidence":0.0,"reasoning":"vague"}'
         when 6 then '{"action":"update_order","confidence":"0.93","reasoning":"string number"}'
         when 7 then '{"action":"update_order"}'
         when 8 then '{"action":"retry_order","confidence":0.99,"reasoning":"not on list"}'
         when 9 then '{"action":"update_order","confidence":0.99} and {"x":1}'
         when 10 then 'LLaMA Error: 429 {''error'': ''rate''}'
         when 11 then '{"action":"update_order","confidence":"0.95d"}'
         when 12 then '{"action":"update_order","confidence":"0x1p0"}'
         when 13 then '{"action":"update_order","confidence":"0.95f"}'
         else '{"action":"update_order","confidence":"high"}' end as llm_output
from events)"""

V_PAYLOAD = """
payload as (
select o_orderkey as request_id,
       case o_orderkey % 6
         when 0 then '{"client_id":"' || cast(o_custkey as varchar(20)) || '","line_items":[{"product_key":"p","notes":"n","cost":' || cast(cast(floor(o_totalprice) as bigint) as varchar(20)) || ',"quantity":2}]}'
         when 1 then '{"error":"insufficient_data"}'
         when 2 then '{"client_id":"7"}'
         when 3 then '{"client_id":null,"line_items":[]}'
         when 4 then 'no payload found'
         else '```json' || chr(10) || '{"client_id":"9","line_items":[]}' || chr(10) || '```' end as llm_output
from orders)"""

V_ACTION_RESULT = """
action_result as (
select event_id as request_id,
       case event_id % 4 when 0 then 'retry_order' when 1 then 'sync_customer_data' when 2 then 'fix_asset_mismatch' else 'create_invoice' end as handler,
       case event_id % 7 when 0 then 200 when 1 then 201 when 2 then 404 when 3 then 500 when 4 then 200 when 5 then 200 else null end as http_code,
       case event_id % 7 when 0 then '{"id":"' || cast(event_id as varchar(20)) || '"}'
         when 1 then '{}' when 2 then 'not found' when 3 then '{"http_status":502}'
         when 4 then '{"status":"failure","message":"order not found"}'
         when 5 then '{"id":"' || cast(event_id as varchar(20)) || '","status":"success","message":"Order ' || cast(event_id as varchar(20)) || ' retried"}'
         else null end as body
from events),
update_result as (
select event_id as request_id, seq,
       case (event_id + seq) % 5 when 0 then 200 when 1 then 204 when 2 then 404 when 3 then 500 else null end as http_code,
       case (event_id + seq) % 5 when 0 then '{"result":"ok"}' when 1 then '{}' when 2 then 'not found'
         when 3 then '{"http_status":502}' else null end as body
from events, (values (1), (2)) s(seq)),
answer as (
select event_id as request_id,
       case event_id % 4 when 1 then '  1. Restart the client of user ' || cast(event_id as varchar(20))
         when 2 then 'Ask the Service Desk.' || chr(10) else 'LLaMA Error: 500' end as llm_output
from events where event_id % 4 <> 0),
group_answer as (
select event_id as request_id, case event_id % 3 when 1 then ' Database Team' || chr(10) else '   ' end as llm_output
from events where event_id % 3 <> 0)"""


def _topk_sql(name: str, exclude_self: bool = False, per_query_k: bool = False) -> str:
    cond = "where q.vec_id <> c.vec_id" if exclude_self else ""
    kexpr = "coalesce(case when q.label = 0 then null else q.label end, 5)" if per_query_k else "5"
    return f"""
{name}_s as (select q.vec_id as qid, c.vec_id as id, {kexpr} as k,
                    list_inner_product(q.e, c.e) / (q.n * c.n) as score
             from emb_v q, emb_v c {cond}),
{name} as (select qid, id, score, cast(row_number() over (partition by qid order by round(score, 4) desc, id) as integer) as rank, k
           from {name}_s)"""


# request_clean, shared by the triage statements
REQ_CLEAN = f"""
request_clean as (
select request_id, coalesce(query, '') as query, coalesce(configuration_item, '') as configuration_item,
       coalesce(nullif(ticket_id, ''), nullif(sys_id, '')) as ticket_key,
       cast(coalesce(top_k, {rules.DEFAULT_TOP_K}) as integer) as top_k
from request where length({strip("coalesce(query, '')")}) > 0)"""

INC_CLEAN = f"""
incident_clean as (
select number, short_description,
       coalesce(assignment_group, {lit(rules.NOT_PROVIDED)}) as assignment_group,
       coalesce(configuration_item, {lit(rules.NOT_PROVIDED)}) as configuration_item,
       coalesce(resolution_notes, {lit(rules.NO_RESOLUTION)}) as resolution_notes
from incident where short_description is not null),
incident_text as (
select *, {render(rules.INCIDENT_TEXT_TEMPLATE)} as training_text from incident_clean)"""

KB = f"""
kb_pages as (select page_id, {html_title('html')} as title, {html_to_text('html')} as body from pages),
kb_text as (
select page_id, {lit(rules.KB_ID_PREFIX)} || cast(row_number() over (order by page_id) as varchar) as id,
       title, body, {render(rules.KB_TEXT_TEMPLATE)} as training_text
from kb_pages)"""

CORPUS = f"""
corpus_union as (
select cast(number as varchar) as id, {lit(rules.SOURCE_INCIDENT)} as source, training_text,
       assignment_group, configuration_item, {lit(rules.NOT_APPLICABLE)} as category from incident_text
union all
select id, {lit(rules.SOURCE_KB)} as source, training_text, {lit(rules.NOT_APPLICABLE)} as assignment_group,
       {lit(rules.NOT_APPLICABLE)} as configuration_item, '' as category from kb_text),
search_corpus as (
select id, source, coalesce(training_text, '') as training_text,
       assignment_group, configuration_item, category from corpus_union
where length(coalesce(training_text, '')) > {rules.MIN_TEXT_CHARS_EXCLUSIVE})"""

SEARCH = f"""
req_text as (select distinct query from request_clean),
{hash_vectors('rq', 'req_text', 'query', 'query')},
{hash_vectors('sc', 'search_corpus', 'id', 'training_text')},
rq_scores as (select rq_vec.id as query, sc_vec.id as id, sum(rq_vec.w * sc_vec.w) as score
              from rq_vec join sc_vec using (b) group by 1, 2),
rq_ranked as (select query, id, score,
                     cast(row_number() over (partition by query order by round(score, 4) desc, id) as integer) as rank
              from rq_scores where score > 0),
request_hits as (
select r.request_id, h.rank, h.id, round(h.score, 4) as similarity_score, c.source,
       c.training_text, c.assignment_group, c.configuration_item, c.category
from request_clean r join rq_ranked h on h.query = r.query and h.rank <= r.top_k
join search_corpus c on c.id = h.id)"""

_SHOWN = f"left(out, {rules.ERROR_OUTPUT_CHARS})"

# what a JSON parser says of the fixture's two bad shapes: single quotes, and text after an object and a space
_DETAIL = ("case when starts_with(j, " + lit("{'") + ") then 'Expecting property name enclosed in double quotes: line 1 column 2 (char 1)' "
           "else 'Extra data: line 1 column ' || (instr(j, '}') + 2) || ' (char ' || (instr(j, '}') + 1) || ')' end")

PARSE = f"""
resp_j as (select request_id, llm_output, {extract_obj(fence_strip('llm_output'))} as j from response),
resp_ok as (select request_id, llm_output, j, coalesce(j <> '' and json_valid(j), false) as json_ok from resp_j),
resp_parsed as (
select request_id, llm_output, j, json_ok,
       case when json_ok then list_contains(json_keys(j), 'action') end as has_action,
       case when json_ok then list_contains(json_keys(j), 'confidence') end as has_conf
from resp_ok),
resp_dec as (
select request_id, llm_output, j, json_ok,
       case when json_ok then (case when has_action then j->>'action' else 'none' end) end as action,
       case when json_ok then (case when not has_conf then 0.0 else try_cast(j->>'confidence' as double) end) end as conf0
from resp_parsed),
decision_parse as (
select request_id, json_ok, action,
       case when json_ok and conf0 is not null and isfinite(conf0) then conf0 end as confidence,
       coalesce(json_ok and conf0 is not null and isfinite(conf0), false) as confidence_ok,
       llm_output, j
from resp_dec),
pay_j as (select request_id, {extract_obj(fence_strip('llm_output'))} as pj from payload),
payload_check as (
select request_id, pj,
       case when coalesce(pj <> '' and json_valid(pj), false)
            then not list_contains(json_keys(pj), 'error') and list_contains(json_keys(pj), 'client_id')
                 and list_contains(json_keys(pj), 'line_items')
            else false end as payload_ok
from pay_j),
dec_in as (
select r.request_id, r.query, r.configuration_item, {classify('r.query')} as issue,
       p.llm_output as out, p.j, coalesce(p.json_ok, false) as json_ok, p.action, p.confidence,
       coalesce(p.confidence_ok, false) as confidence_ok, pc.pj, pc.payload_ok
from request_clean r left join decision_parse p using (request_id) left join payload_check pc using (request_id)),
dec_flags as (
select *, {denied('issue', 'configuration_item')} as denied, out is null as no_answer,
       coalesce(json_ok and confidence_ok and action in ({allow_list()}) and confidence >= {rules.CONFIDENCE_THRESHOLD}, false) as allowed0,
       coalesce(action in ({invoice_list()}), false) as is_invoice
from dec_in),
dec_flags2 as (
select *, allowed0 and (not is_invoice or coalesce(payload_ok, false)) as allowed,
       denied or no_answer or not json_ok or not confidence_ok as early
from dec_flags),
decisions as (
select request_id,
       case when early then false else allowed end as automation_allowed,
       case when not early and allowed then action end as approved_action,
       case when early then 0.0 else confidence end as confidence,
       case when denied then {lit(rules.NETWORK_DENY_REASON)}
            when no_answer then {lit(rules.REASON_NO_ANSWER)}
            when not json_ok then {render(rules.REASON_INVALID_JSON, output=_SHOWN, error="case when j = '' then " + render(rules.ERROR_NO_JSON, output=_SHOWN) + " else " + _DETAIL + " end")}
            when not confidence_ok then {lit(rules.REASON_INVALID_CONFIDENCE)}
            when allowed then {lit(rules.REASON_APPROVED)}
            else {lit(rules.REASON_NOT_APPROVED)} end as reason,
       case when not early and allowed and is_invoice then pj end as payload,
       case when not early then left(out, {rules.RAW_OUTPUT_CHARS}) end as llm_raw_output,
       case when not early then out end as llm_output
from dec_flags2)"""


def _result_status(handler: str) -> str:
    return (f"(case when {handler} = {lit(rules.INVOICE_HANDLER)} and not ok then {lit(rules.STATUS_FAILURE)} when not readable then {lit(rules.STATUS_ERROR)} "
            f"when {handler} = {lit(rules.INVOICE_HANDLER)} then {lit(rules.STATUS_SUCCESS)} else json_extract_string(body_json, '$.status') end)").replace("body_json", _SAFE_BODY)


def _result_message(handler: str) -> str:
    return (f"(case when {handler} = {lit(rules.INVOICE_HANDLER)} and not ok then a_body when not readable then {lit(rules.ERROR_BODY_NOT_JSON)} "
            f"when {handler} = {lit(rules.INVOICE_HANDLER)} then {lit(rules.MSG_INVOICE_CREATED)} else json_extract_string(body_json, '$.message') end)").replace("body_json", _SAFE_BODY).replace("a_body", "res_body")


def _result_invoice(handler: str) -> str:
    return f"(case when {handler} = {lit(rules.INVOICE_HANDLER)} and ok and readable then json_extract_string(body_json, '$.id') end)".replace("body_json", _SAFE_BODY)


_SAFE_BODY = "(case when readable then res_body end)"
_REG_VALUES = ", ".join(f"({lit(a)}, {lit(h)}, {lit(k) if k else 'NULL'})" for a, h, k in rules.ACTION_REGISTRY)

OUTCOME = f"""
registry as (select * from (values {_REG_VALUES}) t(action, handler, body_key)),
action_plan as (
select d.request_id, d.approved_action as action, g.handler,
       case when g.handler is null or (d.approved_action in ({invoice_list()}) and d.payload is null) then 'error' else 'planned' end as status,
       case when g.handler is null or (d.approved_action in ({invoice_list()}) and d.payload is null) then null
            when d.approved_action in ({invoice_list()}) then d.payload
            else json_object(g.body_key, {strip("coalesce(r.query, '')")}) end as body,
       case when g.handler is null then {lit(rules.MSG_NO_HANDLER)} || d.approved_action
            when d.approved_action in ({invoice_list()}) and d.payload is null then {lit(rules.MSG_NEEDS_PAYLOAD)} end as message
from decisions d left join request_clean r using (request_id) left join registry g on d.approved_action = g.action
where d.automation_allowed),
ar_read as (
select request_id, handler, http_code, body as res_body, coalesce(http_code = 200, false) as ok,
       coalesce(json_valid(body), false) and starts_with({strip("coalesce(body, '')")}, '{{') as readable
from action_result),
ar_interp as (
select request_id,
       {_result_status('handler')} as mcp_status, {_result_message('handler')} as mcp_message,
       {_result_invoice('handler')} as invoice_id,
       case when handler is distinct from {lit(rules.INVOICE_HANDLER)} and readable then res_body end as mcp_body
from ar_read),
up_read as (
select request_id, seq, coalesce(http_code between 200 and 299, false) as update_ok,
       case when coalesce(http_code between 200 and 299, false) then body
            when http_code is not null and coalesce(json_valid(body), false) and starts_with({strip('body')}, '{{')
                 and not (case when coalesce(json_valid(body), false) then list_contains(json_keys(body), 'http_status') else false end)
            then (case when regexp_matches({strip('body')}, '^\\{{\\s*\\}}$') then '{{"http_status":' || cast(http_code as varchar) || '}}'
                       else regexp_replace(body, '\\}}\\s*$', ',"http_status":' || cast(http_code as varchar) || '}}') end)
            else body end as update_response
from update_result),
updates as (
select request_id, any_value(update_ok) filter (where seq = 2) as update_ok, any_value(update_response) filter (where seq = 2) as update_response,
       any_value(update_ok) filter (where seq = 1) as field_update_ok, any_value(update_response) filter (where seq = 1) as field_update_response
from up_read group by request_id),
oc_in as (
select r.request_id, r.ticket_key, coalesce(d.automation_allowed, false) as allowed, d.confidence, d.reason,
       d.llm_raw_output, d.approved_action, d.payload, p.status as plan_status, p.message as plan_msg,
       case when a.request_id is not null then {_result_status('p.handler')} end as res_status,
       case when a.request_id is not null then {_result_message('p.handler')} end as res_msg,
       case when a.request_id is not null then {_result_invoice('p.handler')} end as res_invoice,
       case when a.request_id is not null and p.handler is distinct from {lit(rules.INVOICE_HANDLER)} and readable then res_body end as res_whole,
       u.update_ok, u.update_response, u.field_update_ok, u.field_update_response,
       coalesce({strip('s.llm_output')}, '') as suggestion
from request_clean r left join decisions d using (request_id) left join action_plan p using (request_id)
left join ar_read a using (request_id) left join updates u using (request_id) left join answer s using (request_id)
where r.ticket_key is not null),
oc1 as (
select request_id, ticket_key, allowed as automation_allowed, coalesce(confidence, 0.0) as confidence,
       coalesce(nullif(reason, ''), {lit(rules.NO_DECISION_REASON)}) as decision_reason,
       coalesce(llm_raw_output, '') as llm_raw,
       case when allowed and plan_status = 'error' then 'error' when allowed and plan_status = 'planned' then res_status end as mcp_status,
       case when allowed and plan_status = 'error' then plan_msg
            when allowed and plan_status = 'planned' then coalesce(res_msg, {lit(rules.NO_MCP_MESSAGE)})
            else {lit(rules.NO_MCP_MESSAGE)} end as mcp_message,
       case when allowed and plan_status = 'planned' then res_invoice end as invoice_id,
       case when allowed and plan_status = 'planned' then res_whole end as mcp_body,
       allowed and plan_status is not null as has_result,
       coalesce(nullif(approved_action, ''), {lit(rules.NO_ACTION)}) as approved_action, payload, suggestion as ai_suggestion,
       update_ok, update_response, field_update_ok, field_update_response
from oc_in),
oc2 as (
select *, automation_allowed and coalesce(mcp_status = 'success', false) and confidence >= {rules.CONFIDENCE_THRESHOLD} as success,
       case when has_result then coalesce(mcp_body, json_object('status', mcp_status, 'message', mcp_message, 'invoice_id', invoice_id)) else '{{}}' end as mcp_result
from oc1),
outcomes as (
select *,
       case when not success then coalesce(nullif(concat_ws(', ',
            case when not automation_allowed then {lit(rules.FAIL_NOT_ALLOWED)} end,
            case when not coalesce(mcp_status = 'success', false) then {render(rules.FAIL_MCP_STATUS, mcp_status="coalesce(mcp_status, 'None')")} end,
            case when confidence < {rules.CONFIDENCE_THRESHOLD} then {render(rules.FAIL_LOW_CONFIDENCE, confidence=fmt2('confidence'), threshold=lit(repr(float(rules.CONFIDENCE_THRESHOLD))))} end), ''),
            {lit(rules.UNSPECIFIED)}) end as fail_reason,
       case when success then 'resolve' else 'escalate' end as update_type,
       case when success then (case when coalesce(update_ok, true) then 'resolved' else 'resolve_failed' end)
            else (case when coalesce(update_ok, true) then 'escalated' else 'escalate_failed' end) end as ticket_update_status,
       {render(rules.BASE_NOTE, field=lit(rules.AI_SUGGESTION_FIELD), mcp_status="coalesce(mcp_status, 'None')")} as base_note
from oc2),
outcome_msgs as (
select *, case when success then {render(rules.RESOLUTION_NOTE, confidence=fmt2('confidence'), payload="coalesce(payload, 'None')")}
               else {render(rules.FAILURE_NOTE, payload="coalesce(payload, 'None')")} end as update_message
from outcomes),
ticket_update as (
select ticket_key, request_id, 1 as seq, 'fields' as update_type, cast(null as integer) as state,
       cast(null as varchar) as close_notes, base_note as work_notes, ai_suggestion
from outcome_msgs
union all
select ticket_key, request_id, 2 as seq, update_type,
       cast(case update_type when 'resolve' then {rules.STATE_RESOLVED} when 'escalate' then {rules.STATE_IN_PROGRESS} end as integer) as state,
       case when update_type = 'resolve' then update_message end as close_notes,
       case update_type when 'resolve' then {lit(rules.RESOLVE_WORK_NOTE_PREFIX)} || update_message
                        when 'escalate' then {lit(rules.ESCALATE_WORK_NOTE_PREFIX)} || update_message end as work_notes,
       cast(null as varchar) as ai_suggestion
from outcome_msgs)"""


def _with(*blocks: str) -> str:
    return "with " + ",".join(b.strip().rstrip(",") + "\n" for b in blocks if b.strip())


STREAM = """
ticket_update_stream as (select * from ticket_update)"""

EMB = """
emb_v as (select vec_id, label, embedding::DOUBLE[] as e,
                 sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) as n from embeddings)"""

PREFIX = _with(V_INCIDENT, v_request(), V_RESPONSE, V_PAYLOAD, V_ACTION_RESULT, REQ_CLEAN, INC_CLEAN, KB,
               CORPUS, SEARCH, PARSE, OUTCOME, STREAM, EMB,
               _topk_sql("tk_batch"), _topk_sql("tk_self", exclude_self=True),
               _topk_sql("tk_perk", per_query_k=True),
               hash_vectors("ut", "(select conv_id || ':' || turn as qid, text from conversations where role = 'user')",
                            "qid", "text"),
               hash_vectors("dc", "documents", "doc_id", "text"))


def _q(body: str) -> str:
    return PREFIX + body


#: The triage views over requests with one ticket per user.
BY_USER = _with(v_request("'INC' || lpad(cast(user_id as varchar(20)), 7, '0')", "cast(null as varchar)"), V_RESPONSE, V_PAYLOAD, V_ACTION_RESULT,
                REQ_CLEAN, PARSE, OUTCOME)


#: The triage views over sure answers that name every approved action; half the payloads are lost before planning.
_ACTIONS = rules.AUTO_APPROVED_ACTIONS
APPROVED = _with(v_request(), f"""
response as (
select event_id as request_id, '{{"action":"' || (case (event_id // 8) % {len(_ACTIONS)} {' '.join(f'when {i} then {lit(a)}' for i, a in enumerate(_ACTIONS))} end)
       || '","confidence":0.95,"reasoning":"ok"}}' as llm_output from events)""", V_PAYLOAD, V_ACTION_RESULT, REQ_CLEAN, PARSE,
                 OUTCOME.replace("d.payload", "(case when d.request_id % 2 = 0 then d.payload end)"))

_HIT_META = f"""
select t.qid, t.rank, case when d.doc_id is not null then cast(t.id as varchar) else {lit(rules.RECORD_ID_PREFIX)} || cast(t.id as varchar) end as id,
       round(t.score, 4) as similarity_score,
       case when d.doc_id is not null then d.source else {lit(rules.UNKNOWN_SOURCE)} end as source,
       left(case when d.doc_id is not null then d.text else '' end, {rules.HIT_TEXT_CHARS}) as training_text,
       {lit(rules.NOT_PROVIDED)} as assignment_group, {lit(rules.NOT_PROVIDED)} as configuration_item,
       {lit(rules.NOT_PROVIDED)} as category
from tk_batch t left join documents d on d.doc_id = t.id where t.rank <= 5"""

_SNIPPET = f"""
select t.qid, t.rank, case when d.doc_id is not null then cast(t.id as varchar) else '' end as id,
       case when d.doc_id is not null then d.source else '' end as source,
       round(t.score, 6) as score,
       left(case when d.doc_id is not null then d.text else '' end, {rules.SNIPPET_CHARS}) as snippet
from tk_batch t left join documents d on d.doc_id = t.id where t.rank <= 5"""

_ANSWER_LINE = render(rules.ANSWER_CONTEXT_LINE)
_GROUP_LINE = render(rules.GROUP_CONTEXT_LINE)

ORACLE: dict[str, str] = {
    "incident_scan": _q("select * from incident"),
    "incident_clean": _q("select * from incident_text"),
    "embed_user": _q("""
, letters as (select doc_id, i as dim, len(coalesce(text, '')) - len(replace(coalesce(text, ''), substr('aeiou', i + 1, 1), '')) as c
              from documents, range(5) r(i)),
norms as (select doc_id, sqrt(sum(c * c)) as n from letters group by doc_id)
select doc_id, dim::integer as dim, round(case when n > 0 then c / n else 0.0 end, 6) as weight from letters join norms using (doc_id)"""),
    "kb_text": _q("select * from kb_text"),
    "corpus_union": _q("select * from corpus_union"),
    "corpus_filter": _q(f"""
select doc_id, left(coalesce(text, ''), {rules.MAX_TEXT_CHARS}) as training_text,
       cast(length(left(coalesce(text, ''), {rules.MAX_TEXT_CHARS})) as integer) as n_chars
from documents where length(left(coalesce(text, ''), {rules.MAX_TEXT_CHARS})) > {rules.MIN_TEXT_CHARS_EXCLUSIVE}"""),
    "corpus_drop_stats": _q(f"""
select count(*) as n_before,
       cast(sum(case when length(left(coalesce(text, ''), {rules.MAX_TEXT_CHARS})) > {rules.MIN_TEXT_CHARS_EXCLUSIVE} then 1 else 0 end) as bigint) as n_after,
       cast(sum(case when length(left(coalesce(text, ''), {rules.MAX_TEXT_CHARS})) > {rules.MIN_TEXT_CHARS_EXCLUSIVE} then 0 else 1 end) as bigint) as n_dropped
from documents"""),
    # CSV has no empty values besides NULL, and ends lines in one way
    "csv_scan": _q("select doc_id, nullif(source, '') as source, nullif(replace(text, chr(13) || chr(10), chr(10)), '') as text from documents"),
    "kb_export_scan": _q("""
select 'Page ' || page_id || ' } of {' as title, body, case when page_id % 2 = 0 then 'page' end as category from kb_pages"""),
    "embed_hash": _q("select id as doc_id, b as bucket, round(w, 6) as weight from dc_vec"),
    "manifest": _q("""
select 'embeddings-table' as model_name, cast(max(len(embedding)) as integer) as embedding_dim,
       count(*) as num_records from embeddings"""),
    "topk_batch": _q("select qid, rank, id, round(score, 4) as score from tk_batch where rank <= 5"),
    "topk_self": _q("select qid, rank, id, round(score, 4) as score from tk_self where rank <= 5"),
    "topk_per_query_k": _q("select qid, rank, id, round(score, 4) as score from tk_perk where rank <= k"),
    "topk_blocked": _q("select qid, rank, id, round(score, 4) as score from tk_batch where rank <= 5"),
    "hits": _q(_HIT_META),
    "hits_snippet": _q(_SNIPPET),
    "text_search": _q("""
, ts_s as (select ut_vec.id as qid, dc_vec.id as id, sum(ut_vec.w * dc_vec.w) as score
           from ut_vec join dc_vec using (b) group by 1, 2),
ts_r as (select qid, id, score, cast(row_number() over (partition by qid order by round(score, 4) desc, id) as integer) as rank
         from ts_s where score > 0)
select qid, rank, id, round(score, 4) as score from ts_r where rank <= 5"""),
    "request_clean": _q("select * from request_clean"),
    "request_rejects": _q(f"""
select request_id, 'error' as status, {lit(rules.QUERY_REQUIRED)} as message from request
where length({strip("coalesce(query, '')")}) = 0"""),
    "request_hits": _q("select * from request_hits"),
    "context_fold": _q(f"""
select request_id, string_agg({_ANSWER_LINE}, chr(10) order by rank) as context
from request_hits where rank <= {rules.CONTEXT_HITS} group by request_id"""),
    "prompt_answer": _q(f"""
, ctx as (select request_id, string_agg({_ANSWER_LINE}, chr(10) order by rank) as context
          from request_hits where rank <= {rules.CONTEXT_HITS} group by request_id)
select r.request_id, 'answer' as kind, {render(rules.ANSWER_PROMPT)} as prompt
from request_clean r left join ctx using (request_id)"""),
    "prompt_group": _q(f"""
, ctx as (select request_id, string_agg({_GROUP_LINE}, chr(10) order by rank) as context
          from request_hits where rank <= {rules.CONTEXT_HITS} group by request_id)
select r.request_id, 'group' as kind, {render(rules.GROUP_PROMPT)} as prompt
from request_clean r left join ctx using (request_id)"""),
    "prompt_decision": _q(f"""
select request_id, 'decision' as kind, {render(rules.DECISION_PROMPT, actions=lit(', '.join(rules.AUTO_APPROVED_ACTIONS)))} as prompt
from request_clean where not {denied(classify('query'), 'configuration_item')}"""),
    "prompt_payload": _q(f"""
select r.request_id, 'payload' as kind, {render(rules.PAYLOAD_PROMPT)} as prompt
from request_clean r join decision_parse p using (request_id)
where not {denied(classify('r.query'), 'r.configuration_item')}
  and p.json_ok and p.confidence_ok and p.action in ({allow_list()}) and p.confidence >= {rules.CONFIDENCE_THRESHOLD}
  and p.action in ({invoice_list()})"""),
    "assign_group": _q(f"""
select r.request_id, coalesce(case when h.source = {lit(rules.SOURCE_INCIDENT)}
                                  and coalesce(h.assignment_group, {lit(rules.NOT_PROVIDED)}) not in ({lit(rules.NOT_PROVIDED)}, {lit(rules.NOT_APPLICABLE)})
                                 then h.assignment_group end, nullif({strip('g.llm_output')}, ''), {lit(rules.DEFAULT_GROUP)}) as assignment_group
from request_clean r left join (select * from request_hits where rank = 1) h using (request_id)
left join group_answer g using (request_id)"""),
    "response_clean": _q(f"""
select r.request_id, 'decision' as kind, {strip('s.llm_output')} as answer,
       coalesce(starts_with(s.llm_output, {lit(rules.MODEL_ERROR_PREFIX)}), false) as is_error,
       s.llm_output is null as missing
from request_clean r left join response s using (request_id)
where not {denied(classify('r.query'), 'r.configuration_item')}"""),
    "completion_once": _q(f"""
select request_id, 'decision' as kind, 'answer ' || md5({render(rules.DECISION_PROMPT, actions=lit(', '.join(rules.AUTO_APPROVED_ACTIONS)))}) as answer,
       false as is_error, false as missing
from request_clean where not {denied(classify('query'), 'configuration_item')}"""),
    "issue_class": _q(f"select number, {classify('short_description')} as issue_type from incident"),
    "issue_class_rules": _q(f"""
select case when number like '%0' then null else left(number, 9) end as number, {classify('short_description')} as issue_type from incident"""),
    "network_deny": _q(f"""
select number, {classify('short_description')} as issue_type,
       {denied(classify('short_description'), 'configuration_item')} as denied,
       case when {denied(classify('short_description'), 'configuration_item')} then {lit(rules.NETWORK_DENY_REASON)} end as reason
from incident"""),
    "ci_route": _q(f"""
, ci_alias as (select * from (values {", ".join(f"({lit(a)}, {lit(h)})" for a, h in rules.CI_ALIASES)}) t(alias, handler))
select i.number, i.configuration_item, coalesce(a.handler, {lit(rules.NO_CI_ROUTE)}) as route
from incident i left join ci_alias a on upper(coalesce(i.configuration_item, '')) = a.alias"""),
    "decision_parse": _q("select request_id, json_ok, action, confidence, confidence_ok from decision_parse"),
    "decision_gate": _q("select * from decisions"),
    "stream_triage": _q("select * from decisions"),
    "stream_updates": _q("select * from ticket_update_stream"),
    "stream_hits": _q("select * from request_hits"),
    "stream_ticket_state": BY_USER + """
, latest as (select ticket_key, (request_id * 7 + 2) % 4 as batch_id, max(request_id) as request_id from request_clean where ticket_key is not null group by 1, 2),
before as (select *, max(request_id) over (partition by ticket_key order by batch_id rows between unbounded preceding and 1 preceding) as earlier from latest)
select u.*, cast(b.batch_id as integer) as batch_id from ticket_update u join before b using (ticket_key, request_id) where earlier is null or b.request_id > earlier""",
    "index_build": _q("select id, b as bucket, round(w, 6) as weight from sc_vec"),
    "index_update": _q("select id, b as bucket, round(w, 6) as weight from sc_vec"),
    "index_versions": _q(f"""
, early as (
select number, short_description, coalesce(case when assignment_group <> 'Database Team' then assignment_group end, {lit(rules.NOT_PROVIDED)}) as assignment_group,
       coalesce(configuration_item, {lit(rules.NOT_PROVIDED)}) as configuration_item, {lit(rules.NO_RESOLUTION)} as resolution_notes
from incident where short_description is not null),
old_corpus as (
select number as id, {lit(rules.SOURCE_INCIDENT)} as source, {render(rules.INCIDENT_TEXT_TEMPLATE)} as training_text, assignment_group, configuration_item,
       {lit(rules.NOT_APPLICABLE)} as category from early
union all
select 'customer_' || c_custkey, 'customer', c_name || ' in ' || c_mktsegment, {lit(rules.NOT_PROVIDED)}, {lit(rules.NOT_PROVIDED)}, {lit(rules.NOT_APPLICABLE)} from customer),
old_c as (select * from old_corpus where length(coalesce(training_text, '')) > {rules.MIN_TEXT_CHARS_EXCLUSIVE}),
new_c as (select id, source, training_text, assignment_group, configuration_item, category from search_corpus),
added as (select * from new_c except all select * from old_c),
removed as (select * from old_c except all select * from new_c),
m(model_name, embedding_dim) as (values ('hash-md5-64', 64))
select 1 as version, model_name, embedding_dim, (select count(*) from old_c) as num_records, (select count(*) from old_c) as rows_added,
       0 as rows_removed, (select count(distinct training_text) from old_c) as texts_encoded from m
union all
select 2, model_name, embedding_dim, (select count(*) from new_c), (select count(*) from added), (select count(*) from removed),
       (select count(distinct training_text) from added where training_text not in (select training_text from old_c)) from m"""),
    "index_search": _q("""
, is_s as (select ut_vec.id as qid, sc_vec.id as id, sum(ut_vec.w * sc_vec.w) as score
           from ut_vec join sc_vec using (b) group by 1, 2),
is_r as (select qid, id, score, cast(row_number() over (partition by qid order by round(score, 4) desc, id) as integer) as rank
         from is_s where score > 0)
select qid, rank, id, round(score, 4) as similarity_score from is_r where rank <= 5"""),
    "update_response": _q("select * from updates"),
    "ticket_notes": _q("""
select ticket_key, cast(row_number() over (partition by ticket_key order by request_id, seq) as integer) as note_no, work_notes
from ticket_update where work_notes is not null"""),
    "final_record": _q("""
, items as (select request_id, '[' || string_agg(json_object('rank', rank, 'id', id, 'similarity_score', similarity_score, 'source', source,
                   'training_text', training_text, 'assignment_group', assignment_group, 'configuration_item', configuration_item, 'category', category), ',' order by rank) || ']' as similar_items
            from request_hits group by request_id)
select r.request_id, r.query, r.configuration_item,
       json_object('automation_allowed', d.automation_allowed, 'approved_action', d.approved_action, 'confidence', d.confidence,
                   'reason', d.reason, 'payload', d.payload, 'llm_raw_output', d.llm_raw_output) as decision_engine,
       coalesce(d.automation_allowed, false) as automation_triggered, coalesce(items.similar_items, '[]') as similar_items,
       coalesce(ANSWER, '') as ai_suggestion,
       case when o.has_result then o.mcp_result end as mcp_action_result,
       o.field_update_ok as ticket_ai_field_update_ok, o.field_update_response as ticket_ai_field_update_resp,
       o.ticket_update_status, o.update_response as ticket_update_response
from request_clean r left join decisions d using (request_id) left join items using (request_id)
left join answer s using (request_id) left join outcomes o using (request_id)""".replace("ANSWER", strip("s.llm_output"))),
    "payload_check": _q("""
select request_id, payload_ok, case when payload_ok then json_extract_string(pj, '$.client_id') end as client_id
from payload_check"""),
    "action_plan": _q("select * from action_plan"),
    "action_plan_branches": APPROVED + "select * from action_plan",
    "action_result": _q("select * from ar_interp"),
    "outcome": _q("""
select request_id, ticket_key, automation_allowed, confidence, mcp_status, success, fail_reason,
       update_type, ticket_update_status from outcomes"""),
    "outcome_notes": _q("select request_id, base_note, update_message from outcome_msgs"),
    "ticket_update": _q("select * from ticket_update"),
    "ticket_apply": _q("""
, tu as (select *, request_id * 10 + seq as o from ticket_update),
agg as (select ticket_key,
               arg_max(state, o) filter (where state is not null) as state,
               arg_max(close_notes, o) filter (where close_notes is not null) as close_notes,
               arg_max(work_notes, o) filter (where work_notes is not null) as last_work_note,
               count(work_notes) as n_work_notes,
               arg_max(ai_suggestion, o) filter (where ai_suggestion is not null) as u_ai_suggestion
        from tu group by ticket_key)
select i.number, a.state, a.close_notes, a.last_work_note, coalesce(a.n_work_notes, 0) as n_work_notes, a.u_ai_suggestion
from incident i left join agg a on a.ticket_key = i.number"""),
}

