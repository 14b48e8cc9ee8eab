"""Corpus build: incident cleaning, article text, unified corpus, length
filter and row counts (S2, P1-P17, U1, A1-A2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import rules
from ..session import checkpoint_dir
from ..sources.tables import keep_table
from ..functions.text import as_text, html_title, html_to_text, render

INCIDENT_COLUMNS = ["number", "short_description", "assignment_group",
                    "configuration_item", "resolution_notes"]
CORPUS_COLUMNS = ["id", "source", "training_text", "assignment_group",
                  "configuration_item", "category"]


# -- P14 --------------------------------------------------------------------

def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail at plan time when a required column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    return df


# -- P1-P3, P7: incidents ---------------------------------------------------

def clean_incidents(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL short description ('' is kept), fill the three
    optional columns and keep the five incident columns."""
    require_columns(df, INCIDENT_COLUMNS)
    return (df.dropna(subset=["short_description"])
              .fillna({"resolution_notes": rules.NO_RESOLUTION,
                       "assignment_group": rules.NOT_PROVIDED,
                       "configuration_item": rules.NOT_PROVIDED})
              .select(*INCIDENT_COLUMNS))


def incident_training_text(df: DataFrame) -> DataFrame:
    return df.withColumn("training_text", render(rules.INCIDENT_TEXT_TEMPLATE))


# -- S2: KB export (JSON page with a ``result`` array) -------------------------

def kb_export_rows(export: DataFrame, text_col: str = "value") -> DataFrame:
    """``kb_rows`` of whole export documents, one per row."""
    return kb_rows(export.select(F.explode(F.from_json(F.col(text_col), "result array<string>")["result"]).alias("r")))


def kb_rows(items: DataFrame) -> DataFrame:
    """One row per element of an export's ``result`` array (``r``: its JSON
    text, so that key presence is visible). A *missing* key becomes '' while a
    key present with JSON null stays NULL (dict.get with a default)."""

    def get(name: str) -> Column:
        present = F.coalesce(F.array_contains(F.json_object_keys("r"), F.lit(name)), F.lit(False))
        return F.when(present, F.get_json_object("r", f"$.{name}")).otherwise(F.lit(""))
    return items.select(get("short_description").alias("title"),
                        html_to_text(F.coalesce(get("article_body"), F.lit(""))).alias("body"),
                        get("category").alias("category"))


# -- P10, P8: articles from HTML pages ---------------------------------------

def kb_from_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Title (the page's <title>) and readable body text of every page."""
    return pages.withColumns({"title": html_title(html_col), "body": html_to_text(html_col)})


def kb_training_text(df: DataFrame, null_text: str = "") -> DataFrame:
    """``Title: ...\\nContent: ...``; a NULL field renders as ``null_text``
    (pass 'nan' to reproduce the pandas rendering of missing bodies)."""
    return df.withColumn("training_text", render(rules.KB_TEXT_TEMPLATE, null_text=null_text))


# -- P9 / W2: dense ordinal without a single task ------------------------------

def dense_ordinal(df: DataFrame, order_cols: Sequence[str], out_col: str = "ordinal",
                  start: int = 1, num_partitions: int | None = None) -> DataFrame:
    """Number rows 1..n in ``order_cols`` order (must be a unique key).

    Range-partition on the key and sort inside each partition; count rows
    per partition (one small row per partition goes to the driver, as
    ``zipWithIndex`` does); each row's ordinal is its partition's offset plus
    its position inside the partition. No step puts all rows in one task.
    The numbered rows are checkpointed once (one write of the table). Range
    sampling and shuffle each evaluate the input, so number narrow rows and
    join wide columns afterwards.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    # Range bounds come from sampling the input; if the input order is not
    # reproducible (e.g. it comes from a shuffle) a recomputation could cut
    # the partitions differently. A reliable checkpoint in the shared folder
    # fixes one numbering that the count and the result both read.
    checkpoint_dir(spark)
    r = r.checkpoint(eager=True)
    counts = sorted((row[0], row[1]) for row in r.groupBy("_pid").count().collect())
    offsets, acc = {}, 0
    for pid, cnt in counts:
        offsets[pid] = acc
        acc += cnt
    if not offsets:
        return r.drop("_pid", "_mid").withColumn(out_col, F.lit(None).cast("long"))
    # offsets by partition number, read by position
    off_array = F.array(*[F.lit(offsets.get(p, 0)) for p in range(max(offsets) + 1)])
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (r.withColumn(out_col, F.element_at(off_array, F.col("_pid") + 1) + local + F.lit(start))
             .drop("_pid", "_mid"))


def number_within(df: DataFrame, key: str, order_cols: Sequence[str], out_col: str, start: int = 1,
                  num_partitions: int | None = None) -> DataFrame:
    """Number the rows of each ``key`` from ``start`` in ``order_cols`` order.

    A segmented prefix sum: rows are range-partitioned by (key, order), so a
    key with a third of all rows lies in many partitions; every partition
    counts its rows per key, the counts of earlier partitions are added up,
    and a row's number is that sum plus its place among its partition's rows.
    The sorted rows are written once. Rows that are equal in key and order
    are numbered in any order, but spread by a number of their own, so that
    repeated rows do not share one partition either.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [key, *order_cols, "_tie"]
    # the tie number is fixed by a write, as sampling and shuffle both read it
    rows = keep_table(df.withColumn("_tie", F.monotonically_increasing_id()), "unnumbered")
    rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    rows = keep_table(rows.drop("_tie").withColumns({"_pid": F.spark_partition_id(), "_place": place}), "numbered")
    cells = rows.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("_pid").alias("_p"), F.col(key).alias("_key"),
                         (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"))
    return (rows.join(cells, (F.col("_pid") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")))
            .withColumn(out_col, F.col("_place") + F.col("_base") + F.lit(start)).drop("_pid", "_place", "_p", "_key", "_base"))


# -- P4-P6, U1: unified corpus -------------------------------------------------

def _col_or(df: DataFrame, name: str, default: str) -> Column:
    """P5: a missing *column* takes the default; NULL values stay NULL."""
    return F.col(name) if name in df.columns else F.lit(default)


def incidents_to_corpus(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("number").cast("string").alias("id"),
        F.lit(rules.SOURCE_INCIDENT).alias("source"),
        F.col("training_text"),
        _col_or(df, "assignment_group", rules.NOT_PROVIDED).alias("assignment_group"),
        _col_or(df, "configuration_item", rules.NOT_PROVIDED).alias("configuration_item"),
        F.lit(rules.NOT_APPLICABLE).alias("category"),
    )


def kb_to_corpus(df: DataFrame, ordinal_col: str = "ordinal") -> DataFrame:
    return df.select(
        F.concat(F.lit(rules.KB_ID_PREFIX), F.col(ordinal_col).cast("string")).alias("id"),
        F.lit(rules.SOURCE_KB).alias("source"),
        F.col("training_text"),
        F.lit(rules.NOT_APPLICABLE).alias("assignment_group"),
        F.lit(rules.NOT_APPLICABLE).alias("configuration_item"),
        _col_or(df, "category", "").cast("string").alias("category"),
    )


def union_corpus(*parts: DataFrame) -> DataFrame:
    """Concatenate corpus parts by column name; duplicates are kept."""
    out = parts[0].select(*CORPUS_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*CORPUS_COLUMNS))
    return out


# -- P11-P13, A1-A2 ----------------------------------------------------------

def prepare_text(df: DataFrame, text_col: str = "training_text",
                 max_chars: int | None = None,
                 min_chars_exclusive: int = rules.MIN_TEXT_CHARS_EXCLUSIVE) -> DataFrame:
    """NULL -> '', cut to ``max_chars`` code points (None: whole texts), keep
    rows strictly longer than ``min_chars_exclusive`` after the cut."""
    require_columns(df, [text_col])
    t = as_text(text_col) if max_chars is None else F.left(as_text(text_col), F.lit(max_chars))
    return df.withColumn(text_col, t).where(F.length(text_col) > F.lit(min_chars_exclusive))


def write_prepared(df: DataFrame, path: str, text_col: str = "training_text", max_chars: int | None = rules.MAX_TEXT_CHARS) -> dict[str, int]:
    """Write ``prepare_text``'s rows and return the counts of that same pass
    (A1, A2): n_before, n_after, n_dropped."""
    before, after = Observation(), Observation()
    count = F.count(F.lit(1)).alias("n")
    kept = prepare_text(df.observe(before, count), text_col, max_chars).observe(after, count)
    kept.write.mode("overwrite").parquet(path)
    n, m = before.get["n"], after.get["n"]
    return {"n_before": n, "n_after": m, "n_dropped": n - m}


def drop_stats(df: DataFrame, text_col: str = "training_text",
               max_chars: int = rules.MAX_TEXT_CHARS,
               min_chars_exclusive: int = rules.MIN_TEXT_CHARS_EXCLUSIVE) -> DataFrame:
    """Rows before, kept and dropped by ``prepare_text`` -- one pass."""
    kept = F.length(F.left(as_text(text_col), F.lit(max_chars))) > F.lit(min_chars_exclusive)
    return df.agg(F.count(F.lit(1)).alias("n_before"),
                  F.count_if(kept).alias("n_after"),
                  F.count_if(~kept).alias("n_dropped"))

