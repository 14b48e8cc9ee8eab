"""Strict extraction and parsing of JSON objects embedded in model output.

The accepted language is the one of Python's ``json.loads`` applied to the
greedy first-``{``-to-last-``}`` span of the fence-stripped text: trailing
text, single quotes, trailing commas and ``NaN``/``Infinity`` are rejected.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ColumnOrName, _col, let, pystrip

_FENCE_JSON = "```json"
_FENCE = "```"


def strip_code_fence(c: ColumnOrName) -> Column:
    """Strip the text; if it then starts with a code fence, remove every
    fence marker and strip again."""
    bare = lambda s: F.replace(s, F.lit(_FENCE), F.lit(""))
    return let(pystrip(_col(c)), lambda s: (
        F.when(s.startswith(_FENCE_JSON), pystrip(bare(F.replace(s, F.lit(_FENCE_JSON), F.lit("")))))
         .when(s.startswith(_FENCE), pystrip(bare(s)))
         .otherwise(s)))


def extract_object(c: ColumnOrName) -> Column:
    """Greedy first-``{`` to last-``}`` span across lines; '' when none.
    Two patterns that each match once from a fixed place, so the time is
    linear in the text whatever it holds."""
    from_first = F.regexp_extract(_col(c), r"(?s)\{.*", 0)
    return F.regexp_extract(from_first, r"(?s)^.*\}", 0)


def is_strict_object(j: ColumnOrName) -> Column:
    """True when ``j`` is exactly one valid JSON value and nothing else.

    ``try_parse_json`` stops at the end of the first value, so ``{..} x``
    would pass on its own; wrapping the text in ``[...]`` makes trailing
    text a syntax error and a second value a second array element.
    """
    j = _col(j)
    return F.coalesce(j != F.lit(""), F.lit(False)) & let(F.concat(F.lit("["), j, F.lit("]")), lambda wrapped: (
        F.try_parse_json(wrapped).isNotNull()
        & (F.coalesce(F.json_array_length(wrapped), F.lit(0)) == F.lit(1))))


def object_keys(j: ColumnOrName) -> Column:
    """Top-level keys of a JSON object text (NULL for non-objects)."""
    return F.json_object_keys(_col(j))


def has_key(j: ColumnOrName, key: str) -> Column:
    return F.coalesce(F.array_contains(object_keys(j), F.lit(key)), F.lit(False))


def get_text(j: ColumnOrName, key: str) -> Column:
    """Field as text: strings unquoted, other values as JSON text, NULL when
    missing or JSON null."""
    return F.get_json_object(_col(j), f"$.{key}")


@F.pandas_udf(T.StringType())
def _why_invalid(texts: pd.Series) -> pd.Series:
    def why(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            json.loads(text)
        except (ValueError, RecursionError) as e:
            return str(e)
        return None
    return texts.map(why)


def parse_error(j: ColumnOrName, invalid: Column) -> Column:
    """The JSON parser's message for texts that are ``invalid``, as a strict
    parser words it (NULL if this one takes the text). Only invalid texts
    travel to Python."""
    return _why_invalid(F.when(invalid, _col(j)))
