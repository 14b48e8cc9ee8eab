"""Context folds and prompt tables.

Model calls are table boundaries: operators here *write* prompts as rows
(request_id, kind, prompt) and *read* answers as rows (request_id, kind,
llm_output). ``complete_with`` runs a user completion function over a
prompts table with ``mapInPandas`` when answers are produced in-job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import pystrip, render
from ..sources import fs
from ..sources.tables import keep_table
from . import triage


def fold_context(hits: DataFrame, qid: str = "qid", line_template: str = rules.ANSWER_CONTEXT_LINE,
                 top: int = rules.CONTEXT_HITS, sep: str = "\n", out_col: str = "context") -> DataFrame:
    """The first ``top`` hits of each query rendered with
    ``line_template`` and joined by ``sep`` in rank order. Each group holds
    at most ``top`` rows, and the rank filter runs before the shuffle."""
    lines = hits.where(F.col("rank") <= F.lit(top)).select(
        qid, F.struct(F.col("rank").cast("int").alias("r"),
                      render(line_template).alias("line")).alias("_x"))
    return lines.groupBy(qid).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["line"]),
                     sep).alias(out_col))


def fold_hits(hits: DataFrame, qid: str = "qid", out_col: str = "similar_items",
              max_rank: int | None = None) -> DataFrame:
    """A4: hits of each query as an array of records in rank order. Bounded
    by k per query (hits come from a top-k)."""
    h = hits if max_rank is None else hits.where(F.col("rank") <= F.lit(max_rank))
    fields = [c for c in h.columns if c != qid]
    return h.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out_col))


def each_of_group(groups: DataFrame, folded: DataFrame, group: str = "group_id") -> DataFrame:
    """Rows folded by group (``vectors.group_requests``), for each request of
    the group that has one."""
    return groups.join(folded, group).drop(group)


def answer_prompts(requests: DataFrame, context: DataFrame, key: str = "request_id",
                   qid: str = "qid", by: str | None = None) -> DataFrame:
    """One answer prompt per request (the CI is passed, a fix). ``by``
    names the column of the requests that contexts are joined on (``key``),
    such as their group."""
    j = requests.join(context.withColumnRenamed(qid, by or key), by or key, "left")
    return j.select(key, F.lit("answer").alias("kind"), render(rules.ANSWER_PROMPT).alias("prompt"))


def group_prompts(requests: DataFrame, hits: DataFrame, key: str = "request_id",
                  qid: str = "qid", by: str | None = None) -> DataFrame:
    """Assignment-group prompt with the ``{source} {i}: ...`` context.
    ``by`` as in ``answer_prompts``; contexts by group are written once, so
    that their size is known to the join."""
    ctx = fold_context(hits, qid, rules.GROUP_CONTEXT_LINE).withColumnRenamed(qid, by or key)
    j = requests.join(ctx if by is None else keep_table(ctx, "contexts"), by or key, "left")
    return j.select(key, F.lit("group").alias("kind"), render(rules.GROUP_PROMPT).alias("prompt"))


def decision_prompts(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Decision prompt for every request the deny rule lets through."""
    actions = ", ".join(rules.AUTO_APPROVED_ACTIONS)
    issue = triage.classify_issue("query")
    r = requests.where(~triage.network_denied(issue, "configuration_item"))
    return r.select(key, F.lit("decision").alias("kind"),
                    render(rules.DECISION_PROMPT, actions=F.lit(actions)).alias("prompt"))


def payload_prompts(requests: DataFrame, responses: DataFrame, key: str = "request_id",
                    threshold: float = rules.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Invoice payload prompt, only where the decision answer passes the
    gate with an invoice action (a second call only when needed)."""
    issue = triage.classify_issue("query")
    r = requests.where(~triage.network_denied(issue, "configuration_item"))
    r = r.join(responses.select(key, "llm_output"), key)
    p = triage.parse_decision(r, "llm_output")
    ok = (p["json_ok"] & F.coalesce(p["confidence_ok"], F.lit(False))
          & triage.gate("action", "confidence", threshold)
          & F.col("action").isin(*rules.INVOICE_ACTIONS))
    return p.where(ok).select(key, F.lit("payload").alias("kind"),
                              render(rules.PAYLOAD_PROMPT).alias("prompt"))


def attach_responses(prompts: DataFrame, responses: DataFrame,
                     key: str = "request_id") -> DataFrame:
    """R7 (join form) + R8: left join answers to prompts on (key, kind);
    answers are stripped and error texts flagged instead of passed on."""
    r = responses.select(key, "kind", "llm_output")
    j = prompts.join(r, [key, "kind"], "left")
    return j.select(key, "kind", "prompt",
                    pystrip("llm_output").alias("answer"),
                    F.coalesce(F.col("llm_output").startswith(rules.MODEL_ERROR_PREFIX),
                               F.lit(False)).alias("is_error"),
                    F.col("llm_output").isNull().alias("missing"))


def complete_with(prompts: DataFrame, fn: Callable[[list[str]], list[str]],
                  key: str = "request_id") -> DataFrame:
    """R7 / F3 callable form: ``fn`` maps a list of prompts to a list of as
    many answers; it runs per Arrow batch on the executors. If it raises, the
    batch's prompts are tried one by one, and only those that fail get an
    error text."""
    def one(prompt: str) -> str:
        try:
            return list(fn([prompt]))[0]
        except Exception as e:  # noqa: BLE001 - the error is data
            return f"{rules.MODEL_ERROR_PREFIX} {e}"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            prompts = pdf["prompt"].tolist()
            try:
                out = list(fn(prompts))
                if len(out) != len(prompts):
                    raise ValueError(f"{len(out)} answers to {len(prompts)} prompts")
            except Exception:  # noqa: BLE001
                out = [one(p) for p in prompts]
            yield pd.DataFrame({key: pdf[key], "kind": pdf["kind"], "llm_output": out})
    schema = f"{key} {prompts.schema[key].dataType.simpleString()}, kind string, llm_output string"
    return prompts.select(key, "kind", "prompt").mapInPandas(run, schema)


def complete_once(prompts: DataFrame, fn: Callable[[list[str]], list[str]], store: str, key: str = "request_id") -> DataFrame:
    """R7 / F3 with a memory: answers are kept at ``store`` by the SHA-256 of
    their prompt, and only prompts without an answer there are asked, equal
    ones once. Each run appends what it asked, as one job, so a run that dies
    keeps nothing and a lost executor repeats its own prompts only. Error
    texts are returned but not kept: the next run asks again. Returns what
    ``complete_with`` returns."""
    spark = prompts.sparkSession
    schema = "digest string, llm_output string"
    p = prompts.select(key, "kind", "prompt", F.sha2("prompt", 256).alias("digest"))
    wanted = p.where("digest IS NOT NULL").groupBy("digest").agg(F.max("prompt").alias("prompt"))
    is_error = F.col("llm_output").startswith(rules.MODEL_ERROR_PREFIX)
    parts = [f"{store}/{n}" for n in fs.names(spark, store) if fs.names(spark, f"{store}/{n}") and "_SUCCESS" in fs.names(spark, f"{store}/{n}")]
    known = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    open_ = wanted.join(known.where(~is_error), "digest", "left_anti")
    asked = complete_with(open_.withColumn("kind", F.lit("")), fn, key="digest").select("digest", "llm_output")
    part = f"{store}/run-{uuid.uuid4().hex}"
    asked.write.parquet(part)
    answers = known.where(~is_error).unionByName(spark.read.schema(schema).parquet(part)).groupBy("digest").agg(F.any_value("llm_output").alias("llm_output"))
    return p.join(answers, "digest", "left").select(key, "kind", "llm_output")
