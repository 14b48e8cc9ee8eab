"""Request intake (P15-P17): defaults, ticket key and blank-query rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import empty_to_null, nonblank


def clean_requests(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Valid requests with defaults: query '' , CI '', top_k 5, and
    ``ticket_key = ticket_id or sys_id`` where '' counts as missing."""
    return requests.where(nonblank("query")).select(
        key, F.coalesce("query", F.lit("")).alias("query"),
        F.coalesce("configuration_item", F.lit("")).alias("configuration_item"),
        F.coalesce(empty_to_null("ticket_id"), empty_to_null("sys_id")).alias("ticket_key"),
        F.coalesce("top_k", F.lit(rules.DEFAULT_TOP_K)).cast("int").alias("top_k"))


def reject_requests(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests without a non-blank query, as error rows (never dropped)."""
    return requests.where(~nonblank("query")).select(
        key, F.lit("error").alias("status"), F.lit(rules.QUERY_REQUIRED).alias("message"))
