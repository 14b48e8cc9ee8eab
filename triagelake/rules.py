"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is data, stated plainly and in its natural order.
Operators read these lists either as literal Spark expressions (when the list
is tiny and fixed) or as small broadcast tables built by ``rule_tables``.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES -- keyword -> issue category, checked in this order (first hit
# in list order wins, not first hit in the text).
# ---------------------------------------------------------------------------
ISSUE_KEYWORDS: list[tuple[str, str]] = [
    ("vpn", "network"),
    ("connectivity", "network"),
    ("sso", "network"),
    ("login", "network"),
    ("auth", "network"),
    ("crm", "crm"),
    ("profile", "crm"),
    ("order", "order_mgmt"),
    ("fallout", "order_mgmt"),
    ("billing", "billing"),
    ("invoice", "billing"),
]
UNKNOWN_ISSUE = "unknown"

# FIXED VALUES -- actions the decision gate may approve, in this order.
AUTO_APPROVED_ACTIONS: list[str] = [
    "create_order",
    "update_order",
    "create_invoice",
    "update_invoice",
    "restart_server",
    "sync_customer_data",
]
INVOICE_ACTIONS: list[str] = ["create_invoice", "update_invoice"]
CONFIDENCE_THRESHOLD = 0.90

# FIXED VALUES -- network deny rule: category and configuration items
# (compared lower-cased).
NETWORK_CATEGORY = "network"
NETWORK_DENY_CIS: list[str] = ["sie-crm", "rod-brm", "rod-osm"]
NETWORK_DENY_REASON = "Network issues cannot trigger CRM/BRM/OSM automation."

# FIXED VALUES -- action -> (handler, request-body key). A body key of None
# means the body is the validated invoice payload.
ACTION_REGISTRY: list[tuple[str, str, str | None]] = [
    ("retry_order", "retry_order", "order_id"),
    ("update_order", "retry_order", "order_id"),
    ("sync_customer_data", "sync_customer_data", "customer_id"),
    ("fix_asset_mismatch", "fix_asset_mismatch", "asset_id"),
    ("create_invoice", "create_invoice", None),
    ("update_invoice", "create_invoice", None),
]

# FIXED VALUES -- configuration item (upper-cased, untrimmed) -> routed handler.
CI_ALIASES: list[tuple[str, str]] = [
    ("ROD-OSM", "retry_order"),
    ("OSM", "retry_order"),
    ("OURTELCO", "sync_customer_data"),
    ("CRM", "sync_customer_data"),
    ("SIE-CRM", "sync_customer_data"),
    ("ROD-BRM", "fix_asset_mismatch"),
    ("BRM", "fix_asset_mismatch"),
]
NO_CI_ROUTE = "No automation available for this CI"

# FIXED VALUES -- column fills and provenance constants.
NO_RESOLUTION = "No resolution provided."
NOT_PROVIDED = "Not Provided"
NOT_APPLICABLE = "Not Applicable"
DEFAULT_GROUP = "Service Desk"
SOURCE_INCIDENT = "incident"
SOURCE_KB = "kb_article"
UNKNOWN_SOURCE = "unknown"
KB_ID_PREFIX = "KB_"
RECORD_ID_PREFIX = "record_"

# FIXED VALUES -- sizes.
MAX_TEXT_CHARS = 2000
MIN_TEXT_CHARS_EXCLUSIVE = 10
HIT_TEXT_CHARS = 500
SNIPPET_CHARS = 200
RAW_OUTPUT_CHARS = 500
ERROR_OUTPUT_CHARS = 200
DEFAULT_TOP_K = 5
CONTEXT_HITS = 3
EMBED_BATCH = 16

# FIXED VALUES -- decision reasons and messages.
REASON_APPROVED = "Action auto-approved and payload validated."
REASON_NOT_APPROVED = "Action not auto-approved or confidence too low."
REASON_INVALID_JSON = "Invalid JSON returned by LLM. Error: {error}. Output was: {output}"
ERROR_NO_JSON = "No JSON found in output: {output}"
ERROR_NOT_STRICT = "not one strict JSON object"
REASON_NO_ANSWER = "LLM call failed: no response"
REASON_INVALID_CONFIDENCE = "invalid_confidence"
MODEL_ERROR_PREFIX = "LLaMA Error:"
QUERY_REQUIRED = "Query required"
MSG_NO_HANDLER = "No MCP function mapped for action: "
MSG_NEEDS_PAYLOAD = "Invoice action requires payload"
MSG_INVOICE_CREATED = "Invoice created successfully"
INVOICE_HANDLER = "create_invoice"
STATUS_SUCCESS = "success"
STATUS_FAILURE = "failure"
STATUS_ERROR = "error"
ERROR_BODY_NOT_JSON = "response body is not a JSON object"
UPDATE_STATUS = {"resolve": ("resolved", "resolve_failed"), "escalate": ("escalated", "escalate_failed")}
NO_ACTION = "N/A"
UNKNOWN_UPDATE = "Unknown update_type '{update_type}'"
NO_DECISION_REASON = "No decision reason provided."
NO_MCP_MESSAGE = "No MCP message"
UNSPECIFIED = "Unspecified"
AI_SUGGESTION_FIELD = "u_ai_suggestion"

# FIXED VALUES -- ticket states.
STATE_IN_PROGRESS = 2
STATE_RESOLVED = 6

# FIXED VALUES -- what is stripped at both ends of a text: the characters that
# count as white space in Unicode, and the four separators before the space.
WHITESPACE = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

# FIXED VALUES -- HTML entities that the SQL twins decode; "&amp;" is applied
# last so that an escaped entity is decoded exactly once. The engine decodes
# every named and numeric entity.
HTML_ENTITIES: list[tuple[str, str]] = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&middot;", "·"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&hellip;", "…"),
    ("&amp;", "&"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES -- text templates. ``{name}`` is a column placeholder, ``{{``
# and ``}}`` are literal braces (Python format-string syntax, parsed at plan
# time into a Spark ``concat``).
# ---------------------------------------------------------------------------
INCIDENT_TEXT_TEMPLATE = (
    "Issue: {short_description}\n"
    "Resolution: {resolution_notes}\n"
    "Assignment Group: {assignment_group}\n"
    "Configuration Item: {configuration_item}"
)
KB_TEXT_TEMPLATE = "Title: {title}\nContent: {body}"
ANSWER_CONTEXT_LINE = "Similar {source} {rank}: {training_text}"
GROUP_CONTEXT_LINE = "{source} {rank}: {training_text}"

ANSWER_PROMPT = """
You are an IT support assistant for ServiceNow.

USER ISSUE:
{query}

CONFIGURATION ITEM:
{configuration_item}

SIMILAR CONTEXT (Incidents and KB Articles):
{context}

Your task:
1. Analyze the user's issue and the provided context.
2. Use relevant KB articles and past incident resolutions to propose a solution.
3. Provide a clear, step-by-step resolution (3-6 steps).
4. If escalation is needed, mention the appropriate assignment group.

Return only the solution steps in a concise format.
"""

GROUP_PROMPT = """
        You are an IT support assistant.
        USER ISSUE: {query}
        SIMILAR CONTEXT:
        {context}

        Predict the most appropriate assignment group for handling this issue.
        Examples: Application Support, Network Support, Database Team, Service Desk.
        Return ONLY the group name.
        """

DECISION_PROMPT = """
You MUST reply in EXACT JSON only. No extra text before or after.

Extract:
- action: intended operation (one of: {actions}, or "none")
- confidence: number between 0.0 and 1.0
- reasoning: short explanation

If unclear or query is too vague → action = "none", confidence = 0.0

QUERY: "{query}"
CI: "{configuration_item}"

Output ONLY valid JSON:
"""

PAYLOAD_PROMPT = """
You MUST return ONLY valid JSON payload for the invoice. No extra text.

Extract from this query:
QUERY: "{query}"
CI: "{configuration_item}"

Required format:
{{
  "client_id": "extracted_client_id",
  "line_items": [
    {{
      "product_key": "item_name",
      "notes": "description",
      "cost": 100.0,
      "quantity": 1
    }}
  ]
}}

If you cannot extract client_id or line_items, return: {{"error": "insufficient_data"}}
"""

BASE_NOTE = (
    "AI suggestion saved to '{field}'.\n"
    "Decision reason: {decision_reason}\n"
    "MCP status: {mcp_status}\n"
    "MCP message: {mcp_message}"
)
RESOLUTION_NOTE = (
    "Resolved by AI automation.\n"
    "Approved action: {approved_action}\n"
    "Confidence: {confidence}\n"
    "Payload: {payload}\n"
    "MCP Result: {mcp_result}\n"
)
FAILURE_NOTE = (
    "AI could not auto-resolve.\n"
    "Failure reason: {fail_reason}\n"
    "\n"
    "AI Failure Message (from suggestion):\n"
    "{ai_suggestion}\n"
    "\n"
    "Decision reason: {decision_reason}\n"
    "LLM raw output: {llm_raw}\n"
    "Payload: {payload}\n"
    "MCP Result: {mcp_result}\n"
)
RESOLVE_WORK_NOTE_PREFIX = "Resolution details:\n"
ESCALATE_WORK_NOTE_PREFIX = "Escalated to human: "
FAIL_NOT_ALLOWED = "automation not allowed"
FAIL_MCP_STATUS = "MCP status: {mcp_status}"
FAIL_LOW_CONFIDENCE = "low confidence ({confidence} < {threshold})"
