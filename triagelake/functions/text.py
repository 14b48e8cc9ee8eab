"""Scalar text helpers, all built from JVM-side Spark functions."""

from __future__ import annotations

import html
import re
import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` names
    it: a lambda variable, which the optimiser does not replace by its source."""
    return F.transform(F.array(value), fn).getItem(0)


def with_once(df: DataFrame, fields: Column) -> DataFrame:
    """``df`` with the fields of a struct as columns, evaluated once per row: a
    generator's output, which later projections and filters refer to instead
    of evaluating its source again."""
    return df.select("*", F.inline(F.array(fields)))


def pystrip(c: ColumnOrName) -> Column:
    """Strip leading/trailing Unicode whitespace, like ``str.strip``.

    Spark's ``trim`` removes spaces only; ``btrim`` with the whitespace set
    is linear in the text (an end-anchored whitespace regex backtracks over
    every interior whitespace run).
    """
    return F.btrim(_col(c), F.lit(rules.WHITESPACE))


def as_text(c: ColumnOrName, null_text: str = "") -> Column:
    """Null -> ``null_text``, anything else cast to string (never NULL)."""
    return F.coalesce(_col(c).cast("string"), F.lit(null_text))


def nonblank(c: ColumnOrName) -> Column:
    """True when the value has a non-whitespace character (NULL -> False)."""
    return F.coalesce(F.length(pystrip(c)) > 0, F.lit(False))


def empty_to_null(c: ColumnOrName) -> Column:
    """Python truthiness for strings: '' behaves like a missing value."""
    return F.nullif(_col(c), F.lit(""))


def render(template: str, null_text: str = "", **cols: ColumnOrName) -> Column:
    """Render a ``str.format``-style template as one ``concat`` expression.

    Placeholders name keyword arguments (Columns or column names); when a
    placeholder has no keyword argument the column of that name is used.
    NULL values render as ``null_text`` so a missing field never nulls the
    whole text (Spark's ``concat`` is NULL-propagating).
    """
    parts: list[Column] = []
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            src = cols.get(field, field)
            parts.append(as_text(src, null_text))
    if not parts:
        return F.lit("")
    return F.concat(*parts)


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def decode_entities(c: ColumnOrName) -> Column:
    """Decode every named and numeric HTML entity. Only texts with an
    ampersand travel to Python (Arrow batches)."""
    c = _col(c)
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


# The states of a page: text, a tag (with its quoted values), a raw element, a
# comment, a declaration. Each pattern runs once from where its state begins;
# possessive repeats never go back, so a page is read in linear time.
_TAG = re.compile(r"""</?[a-zA-Z](?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+(>?)""")
_NAME = re.compile(r"<([a-zA-Z][^\s/>]*)")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style")}
_COMMENT_END = re.compile(r"--!?>")


def page_text(page: str) -> str:
    """Text nodes of an HTML page, joined by a newline (see ``html_to_text``)."""
    nodes, node, i = [], [], 0  # node: pieces of the text node that i is in
    while True:
        lt = page.find("<", i)
        if lt < 0:
            node.append(page[i:])
            break
        node.append(page[i:lt])
        kind = page[lt + 1:lt + 2]
        if kind == "!" and page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):  # an empty comment
                i = page.index(">", lt + 4) + 1
            else:
                end = _COMMENT_END.search(page, lt + 4)
                i = end.end() if end else len(page)
        elif kind in ("!", "?"):
            end = page.find(">", lt + 2)
            i = end + 1 if end >= 0 else len(page)
        elif kind == "/" or kind.isascii() and kind.isalpha():
            tag = _TAG.match(page, lt)
            if tag is None:  # "</" before no letter: a bogus comment
                end = page.find(">", lt + 2)
                i = end + 1 if end >= 0 else len(page)
            else:
                if not tag[1]:  # never closed: no tag
                    node.append(page[lt:])
                    break
                i = tag.end()
                name = _NAME.match(page, lt)
                raw = _RAW_END.get(name[1].lower()) if name else None
                if raw is not None:
                    end = raw.search(page, i)
                    i = end.start() if end else len(page)
        else:  # a lone "<" is text
            node.append("<")
            i = lt + 1
            continue
        if any(node):
            nodes.append("".join(node))
        node = []
    if any(node):
        nodes.append("".join(node))
    text = "\n".join(nodes)
    return html.unescape(text) if "&" in text else text


@F.pandas_udf(T.StringType())
def _page_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: None if p is None else page_text(p))


def html_to_text(c: ColumnOrName) -> Column:
    """Readable text of an HTML page.

    Text nodes are joined by a newline (one newline per run of adjacent
    tags), script/style/comment/doctype content is dropped, entities are
    decoded and the result is stripped. One Arrow pass over the pages.
    """
    return pystrip(_page_text(_col(c)))


def html_title(c: ColumnOrName) -> Column:
    """Text of the page's ``<title>`` element ('' when absent)."""
    t = F.regexp_extract(_col(c), r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return pystrip(decode_entities(t))


def fmt_fixed(c: ColumnOrName, digits: int = 2) -> Column:
    """Fixed-point text like Python's ``f'{x:.2f}'`` (exact binary value,
    ties to even); no grouping separators. NULL stays NULL."""
    return F.regexp_replace(F.format_number(_col(c).cast("double"), digits), ",", "")

