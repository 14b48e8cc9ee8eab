"""The triage flow over a stream of requests.

``readStream`` of request files -> ``foreachBatch``: every micro-batch is
triaged with the same batch operators against static tables (answers,
payloads, action results) and written to Parquet folders of its ``batch_id``.
A small file, committed after all of a batch's tables, makes the batch count:
readers (``read_committed``) see all tables of a batch or none, and a batch
that is replayed after a failure (same id, same input files -- the file source
and the checkpoint guarantee that) is skipped if it was committed and else
written anew.

A ticket gets at most one update per batch, for its latest request, and only
if that is later than the last request applied to the ticket in any earlier
batch (X2). This keyed state is a table of its own: a batch adds the tickets
it updated, combined to one row each before anything is shuffled, and its
commit names the parts that make up the state, so state and results are
committed together. State that no batch touched for ``expire_batches`` batches
expires.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import outcome as O
from ..operators.context import each_of_group, fold_context
from ..operators.vectors import search_texts
from ..operators import triage as TR
from ..operators.requests import clean_requests, reject_requests
from ..session import checkpoint_dir
from ..sources import fs
from ..sources.tables import keep_table


#: Room for the distinct texts of a column of one file: requests share the texts of their hits, which are then written once a file.
DICTIONARY_BYTES = 16 << 20


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    """Replace exactly this batch's folder, also if it has no row now."""
    df.write.mode("overwrite").option("parquet.dictionary.page.size", DICTIONARY_BYTES).parquet(os.path.join(path, f"batch_id={batch_id}"))


def latest_per_ticket(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """The newest request (largest key) of each ticket; requests without
    a ticket key pass through (they produce no update anyway).

    A max per ticket (combined map-side, so a ticket with a huge share of
    the requests is one partial row per task) and a join on the unique
    (ticket, request) pair, which spreads a hot ticket's rows by request key.
    """
    latest = (requests.where(F.col("ticket_key").isNotNull())
              .groupBy("ticket_key").agg(F.max(key).alias(key)))
    with_ticket = requests.join(latest, ["ticket_key", key], "left_semi")
    return with_ticket.unionByName(requests.where(F.col("ticket_key").isNull()))


def newer_than_applied(requests: DataFrame, applied: DataFrame, key: str = "request_id") -> DataFrame:
    """X2 across batches: drop requests that are not later than the last one
    applied to their ticket (``applied``: ticket_key, last)."""
    j = requests.join(applied.select(F.col("ticket_key").alias("_t"), F.col("last").alias("_last")), F.col("ticket_key") == F.col("_t"), "left")
    return j.where(F.col("_last").isNull() | (F.col(key) > F.col("_last"))).drop("_t", "_last")


def triage_batch(requests: DataFrame, responses: DataFrame, payloads: DataFrame | None,
                 action_results: DataFrame | None, registry: DataFrame,
                 key: str = "request_id", persist: bool = False,
                 index=None, answers: DataFrame | None = None, applied: DataFrame | None = None) -> dict[str, DataFrame]:
    """Batch triage of a request table: rejects, decisions, action plans,
    outcomes and ticket updates (one update set per ticket, none for requests
    that ``applied`` outdates). With ``index`` (a version of a stored one)
    also hits and contexts, both made from the hits of groups of requests, which
    are kept. With ``persist`` the planned decisions, which later tables read,
    are kept in executor storage (recomputable from lineage if an executor is
    lost); the caller unpersists them."""
    req = clean_requests(requests, key)
    dec = TR.decide(req, responses, payloads, key=key, carry=["query", "configuration_item", "ticket_key"])
    planned = O.with_plan(dec, registry)
    if persist:
        planned = planned.persist(StorageLevel.MEMORY_AND_DISK)
    latest = latest_per_ticket(planned, key)
    if applied is not None:
        latest = newer_than_applied(latest, applied, key)
    outs = O.outcome(latest, action_results, answers, key=key)
    tables = {"planned": planned, "rejects": reject_requests(requests, key), "decisions": planned.select(*dec.columns),
              "action_plan": O.action_plan(planned, key), "outcomes": outs, "ticket_updates": O.ticket_updates(outs, key)}
    if index is not None:
        groups, hits = search_texts(req, index, key=key, grouped=True)
        hits = keep_table(hits, "group-hits")
        tables["hits"] = each_of_group(groups, hits)
        tables["context"] = each_of_group(groups, fold_context(hits, "group_id"))
    return tables


# -- commits and the tickets' state -------------------------------------------------

#: Parts of the state before they are merged into one.
STATE_PARTS = 16
_COMMITS = "_commits"


def committed(spark: SparkSession, out_dir: str) -> list[int]:
    """Committed batches of an output folder, in order."""
    return sorted(int(n[:-5]) for n in fs.names(spark, f"{out_dir}/{_COMMITS}") if n.endswith(".json") and not n.startswith("."))


def commit_of(spark: SparkSession, out_dir: str, batch_id: int) -> dict:
    return json.loads(fs.read_text(spark, f"{out_dir}/{_COMMITS}/{batch_id:010d}.json"))


def commits(spark: SparkSession, out_dir: str) -> dict[int, dict]:
    """Committed batches of an output folder: batch_id -> what it recorded."""
    return {b: commit_of(spark, out_dir, b) for b in committed(spark, out_dir)}


def read_committed(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """A table of the stream: the rows of committed batches, with batch_id."""
    paths = [os.path.join(out_dir, table, f"batch_id={b}") for b, c in sorted(commits(spark, out_dir).items()) if table in c["tables"]]
    if not paths:
        raise ValueError(f"no committed batch in {out_dir} has a table {table}")
    return spark.read.option("basePath", os.path.join(out_dir, table)).parquet(*paths)


def _applied(spark: SparkSession, out_dir: str, parts: list[str], oldest: int) -> DataFrame | None:
    """ticket_key, last (request applied), seen (batch that applied it)."""
    if not parts:
        return None
    rows = spark.read.schema("ticket_key string, last long, seen long").parquet(*[os.path.join(out_dir, "_state", p) for p in parts])
    return rows.where(F.col("seen") >= oldest).groupBy("ticket_key").agg(F.max("last").alias("last"), F.max("seen").alias("seen"))


def start_triage_stream(spark: SparkSession, request_dir: str, out_dir: str,
                        responses: DataFrame, payloads: DataFrame | None = None,
                        action_results: DataFrame | None = None, *,
                        checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                        available_now: bool = True, index=None, answers: DataFrame | None = None,
                        tables: tuple[str, ...] | None = None, expire_batches: int = 10_000):
    """Start the stream; returns the StreamingQuery. Outputs go to
    ``out_dir/<table>/batch_id=<n>`` and are read with ``read_committed``;
    progress to ``checkpoint`` (default: a fresh folder under the session's
    shared checkpoint folder). ``tables`` names those to write (all). With
    ``index`` (a version of a stored search index) each batch is also searched
    and ``hits`` / ``context`` are written. The static tables must not change
    while the stream runs: a replayed batch reads them again."""
    registry = TR.rule_tables(spark)["action_registry"]
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), f"triage-stream-{uuid.uuid4().hex}")
    reader = spark.readStream.schema(schemas.REQUEST)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(request_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        done = committed(spark, out_dir)
        if batch_id in done:
            return  # committed before the failure that made this a replay
        earlier = [b for b in done if b < batch_id]
        parts = commit_of(spark, out_dir, earlier[-1])["state"] if earlier else []
        applied = _applied(spark, out_dir, parts, batch_id - expire_batches)
        made = triage_batch(batch, responses, payloads, action_results, registry, persist=True,
                            index=index, answers=answers, applied=applied)
        kept = made.pop("planned")
        wanted = [t for t in made if tables is None or t in tables]
        stateful = "outcomes" in wanted or "ticket_updates" in wanted
        try:
            if stateful:  # written first and read back: its joins run once
                path = os.path.join(out_dir, "outcomes", f"batch_id={batch_id}")
                _write(made["outcomes"], os.path.join(out_dir, "outcomes"), batch_id)
                outs = spark.read.schema(made["outcomes"].schema).parquet(path)
                made["ticket_updates"] = O.ticket_updates(outs)
                touched = outs.select("ticket_key", F.col("request_id").alias("last"), F.lit(batch_id).cast("long").alias("seen"))
                if len(parts) >= STATE_PARTS:
                    touched, parts = touched.unionByName(applied) if applied is not None else touched, []
                name = f"part-{batch_id}-{uuid.uuid4().hex}"
                touched.write.parquet(os.path.join(out_dir, "_state", name))
                parts = [*parts, name]
            for name in wanted:
                if name != "outcomes":
                    _write(made[name], os.path.join(out_dir, name), batch_id)
        finally:
            kept.unpersist()
        fs.commit_text(spark, f"{out_dir}/{_COMMITS}", f"{batch_id:010d}.json",
                       json.dumps({"batch_id": batch_id, "tables": wanted, "state": parts}))

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_stream_once(spark: SparkSession, requests: DataFrame, responses: DataFrame,
                    payloads: DataFrame | None, action_results: DataFrame | None,
                    files: int | None = None, work_dir: str | None = None,
                    index=None, answers: DataFrame | None = None, tables: tuple[str, ...] | None = None,
                    arrival: Column | None = None, arrivals: int = 4) -> str:
    """Land ``requests`` as Parquet files (``files``: that many; else as many
    as the session's shuffle partitions), drain them through the stream in
    four micro-batches or so and return the output folder. With ``arrival``,
    a number from 0 to ``arrivals`` - 1, the rows of each number land together,
    in as many files as they are partitions, and are drained as a micro-batch
    of their own before the next land."""
    base = work_dir or os.path.join(checkpoint_dir(spark), f"triage-run-{uuid.uuid4().hex}")
    src, out = os.path.join(base, "requests"), os.path.join(base, "out")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [f.name for f in schemas.REQUEST.fields]

    def drain(per_trigger: int | None) -> None:
        start_triage_stream(spark, src, out, responses, payloads, action_results,
                            checkpoint=os.path.join(base, "checkpoint"), max_files_per_trigger=per_trigger,
                            index=index, answers=answers, tables=tables).awaitTermination()
    if arrival is None:
        requests.select(cols).repartitionByRange(files, "request_id").write.mode("overwrite").parquet(src)
        drain(max(1, files // 4))
    else:
        for n in range(arrivals):
            requests.where(arrival == n).select(cols).write.mode("append").parquet(src)
            drain(None)
    return out
