"""A stored search index with versions.

A version is a manifest, a small file that is committed last; it names the
version's parts, so readers see a version whole or not at all and go on
reading the one they opened. An update compares the corpus with the version
before by content digests of its rows and writes what differs:

* rows that are new or changed, as one part -- a text whose digest the index
  knows takes its vector over, each other distinct text is encoded once;
* rows that are gone, as tombstones;
* the cells of the search (``operators.cells``): rows are dealt around the
  pivots of the first version, and the heads of their cells are widened.

A lost executor repeats its own tasks; an update that dies leaves parts that
no manifest names. Two updates at a time: one commits, the other raises.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import fs
from ..sources.tables import keep_table
from . import cells as C
from . import vectors as V


#: Classes of vectors whose cell a task remembers.
KNOWN_CELLS = 1 << 17


def content_digest(cols: list[str]) -> Column:
    """SHA-256 of columns as text, each with its length, NULL apart from ''."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(F.col(f"`{c}`").cast("string")) for c in cols]), 256)


@dataclass
class Snapshot:
    """One version of an index, as it was committed."""

    spark: SparkSession
    path: str
    manifest: dict

    @property
    def payload(self) -> list[str]:
        return self.manifest["payload"]

    def stored(self) -> DataFrame:
        """Live rows with their digests (row_key, text_key), vector, class of
        equal vectors (vk) and cell."""
        schema = T.StructType.fromJson(self.manifest["schema"])
        out = None
        for p in self.manifest["parts"]:
            part = self.spark.read.schema(schema).parquet(os.path.join(self.path, p["name"])).withColumn("_version", F.lit(p["version"]))
            out = part if out is None else out.unionByName(part)
        dead = None
        for t in self.manifest["tombstones"]:
            gone = self.spark.read.schema("row_key string").parquet(os.path.join(self.path, t["name"])).select(
                F.col("row_key").alias("_dead"), F.lit(t["version"]).alias("_since"))
            dead = gone if dead is None else dead.unionByName(gone)
        if dead is not None:  # a tombstone takes the rows of earlier versions
            out = out.join(dead, (F.col("row_key") == F.col("_dead")) & (F.col("_since") > F.col("_version")), "left_anti")
        return out.drop("_version")

    def rows(self) -> DataFrame:
        """Live rows: the corpus columns and the vector (NULL without a token)."""
        return self.stored().drop("row_key", "text_key", "cell", "vk")

    def cells(self, block_rows: int = 4096) -> C.Cells | None:
        """The live rows as dealt; heads may be wider than needed after
        deletions, never narrower. None if no row has a vector."""
        heads = self.spark.read.parquet(os.path.join(self.path, self.manifest["heads"])).toPandas().sort_values("cell")
        if not len(heads):
            return None
        pivots = _pivots(self.spark, os.path.join(self.path, self.manifest["pivots"]), self.manifest["embedding_dim"])
        centres = np.vstack([pivots, np.zeros((1, self.manifest["embedding_dim"]))])
        numbers = heads["cell"].to_numpy()
        rows = self.stored().where("cell IS NOT NULL")
        rows = rows.select(F.col(self.manifest["id"]).alias("id"), *self._vector(), "cell", *[c for c in ("vk",) if c in rows.columns])
        return C.Cells(rows, tuple("vec" if c == "embedding" else c for c in self.payload), self.manifest["embedding_dim"], numbers, centres[numbers],
                       heads["widest"].to_numpy() + C.SLACK, np.stack(heads["hi"].to_list()), np.stack(heads["lo"].to_list()),
                       heads["n"].to_numpy(), block_rows)

    def _vector(self) -> list[Column]:
        return [F.col("embedding").cast("array<double>").alias("vec")] if self.payload == ["embedding"] else [F.col(c) for c in self.payload]


def _pivots(spark: SparkSession, path: str, dim: int) -> np.ndarray:
    rows = spark.read.parquet(path).orderBy("n").collect()  # at most cells.MAX_CELLS
    return np.array([r["vec"] for r in rows]).reshape(len(rows), dim)


class IndexStore:
    """The versions of an index below one path.

    The encoder is the hashing one, or a user's ``encoder`` (F2) of ``dim``
    components. ``model_name`` stands for it in the manifest: an update with
    another name encodes every text anew.
    """

    def __init__(self, spark: SparkSession, path: str, *, id_col: str = "id", text_col: str = "training_text", dim: int = V.HASH_DIM,
                 encoder: Callable | None = None, model_name: str = V.HASH_MODEL_NAME):
        self.spark, self.path, self.id, self.text = spark, path.rstrip("/"), id_col, text_col
        self.dim, self.encoder, self.model_name = dim, encoder, model_name
        self.payload = ["bs", "vs"] if encoder is None else ["embedding"]

    # -- reading ----------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in fs.names(self.spark, f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]

    def open(self, version: int | None = None) -> Snapshot | None:
        """A version (the latest one), or None if there is none."""
        known = self.versions()
        if not known:
            return None
        text = fs.read_text(self.spark, f"{self.path}/manifests/{version if version is not None else max(known):08d}.json")
        return Snapshot(self.spark, self.path, json.loads(text))

    def manifests(self) -> DataFrame:
        """One row per version."""
        rows = [self.open(v).manifest for v in self.versions()]
        cols = ["version", "model_name", "embedding_dim", "num_records", "rows_added", "rows_removed", "texts_encoded", "date_created"]
        return self.spark.createDataFrame([tuple(m[c] for c in cols) for m in rows], "version int, model_name string, embedding_dim int, "
                                          "num_records long, rows_added long, rows_removed long, texts_encoded long, date_created string")

    # -- writing ----------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str, **metrics: Column) -> tuple[str, dict]:
        """Write a part; its metrics come from the same pass."""
        name = f"{kind}-{uuid.uuid4().hex}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]).write.parquet(f"{self.path}/{name}")
        return name, seen.get

    def _encoded(self, texts: DataFrame) -> DataFrame:
        """text_key and vector of distinct texts (text_key, _text)."""
        if self.encoder is not None:
            return V.embed_with(texts, "_text", self.encoder, self.dim).select("text_key", "embedding")
        return V.pack_texts(texts, "_text", self.dim, ["text_key"])

    def update(self, corpus: DataFrame, source_state: str | None = None) -> Snapshot:
        """Make the index hold exactly the rows of ``corpus`` and return the
        version that does. With the ``source_state`` of the latest version
        nothing is read. Repeated rows and repeated ids stay as often as the
        corpus has them; a NULL text is encoded like an empty one, and rows
        without a vector are in the index and match nothing."""
        old = self.open()
        if old is not None and (old.manifest["model_name"] != self.model_name or "vk" not in {f["name"] for f in old.manifest["schema"]["fields"]}):
            old = None  # of another model, or stored before rows had classes
        if old is not None and source_state is not None and old.manifest["source_state"] == source_state:
            return old
        columns = corpus.columns
        snap = corpus.withColumn("text_key", content_digest([self.text])).withColumn("row_key", content_digest(columns))
        if old is None:  # every row is new
            added = keep_table(snap, "index-added")
            sums = {"was": 0, "now": added.count()}
        else:
            live = old.stored()
            now = snap.groupBy("row_key").agg(F.count(F.lit(1)).alias("now"))
            was = live.groupBy("row_key").agg(F.count(F.lit(1)).alias("was"))
            diff = keep_table(now.join(was, "row_key", "full").na.fill(0, ["now", "was"]).where("now <> was"), "index-diff")
            sums = diff.agg(F.coalesce(F.sum("was"), F.lit(0)).alias("was"), F.coalesce(F.sum("now"), F.lit(0)).alias("now")).first()
            if sums["was"] == 0 and sums["now"] == 0 and old.manifest["columns"] == columns:
                return old
            added = keep_table(snap.join(diff.where("now > 0").select("row_key"), "row_key"), "index-added")
        text = F.coalesce(F.col(f"`{self.text}`"), F.lit(""))
        wanted = added.select("text_key", text.alias("_text")).distinct()
        if old is None:
            known, fresh = None, wanted
        else:
            known = live.join(added.select("text_key").distinct(), "text_key", "left_semi").groupBy("text_key").agg(
                *[F.any_value(c).alias(c) for c in self.payload])
            known = keep_table(known, "index-known")
            fresh = wanted.join(known.select("text_key"), "text_key", "left_anti")
        seen = Observation()
        new = keep_table(self._encoded(fresh.observe(seen, F.count(F.lit(1)).alias("texts"))), "index-encoded")
        vectors = new if known is None else known.unionByName(new)
        if old is not None and old.manifest["num_records"]:
            name = old.manifest["pivots"]
            pivots = _pivots(self.spark, f"{self.path}/{name}", self.dim)
        else:
            pivots, name = self._choose_pivots(vectors, sums["now"])
        sent = self.spark.sparkContext.broadcast(pivots)
        # the vectors of distinct texts are dealt, and no text goes through Python for that
        vectors = keep_table(self._dealt(vectors, sent), "index-dealt")
        rows = added.join(vectors, "text_key", "left")
        part, told = self._write(rows, "rows")
        heads = self._heads(vectors, part, rows.schema, sent)
        if old is not None and old.manifest["num_records"]:
            heads = _widened(heads, self.spark.read.parquet(f"{self.path}/{old.manifest['heads']}").collect())
        table = [(c, n, w, [float(x) for x in hi], [float(x) for x in lo]) for c, (n, w, hi, lo) in heads.items()]
        heads_name, _ = self._write(self.spark.createDataFrame(table, "cell int, n long, widest double, hi array<double>, lo array<double>").coalesce(1), "heads")
        version = (max(self.versions()) + 1) if self.versions() else 1
        tombstones = list(old.manifest["tombstones"]) if old is not None else []
        if sums["was"]:
            gone, _ = self._write(diff.where("was > 0").select("row_key"), "gone")
            tombstones.append({"name": gone, "version": version})
        manifest = {
            "version": version, "model_name": self.model_name, "embedding_dim": self.dim, "id": self.id, "columns": columns, "payload": self.payload,
            "schema": rows.schema.jsonValue(), "source_state": source_state, "pivots": name, "heads": heads_name, "tombstones": tombstones,
            "parts": [*(old.manifest["parts"] if old is not None else []), {"name": part, "version": version}],
            "num_records": (old.manifest["num_records"] if old is not None else 0) + told["rows"] - sums["was"],
            "rows_added": told["rows"], "rows_removed": sums["was"], "texts_encoded": seen.get["texts"],
            "date_created": datetime.now(timezone.utc).isoformat(),
        }
        return self._commit(manifest)

    def compact(self) -> Snapshot:
        """A version with the same rows in one part, without tombstones, and
        with pivots and heads of its own."""
        old = self.open()
        rows = old.stored().drop("cell", "vk")
        pivots, name = self._choose_pivots(rows, old.manifest["num_records"])
        sent = self.spark.sparkContext.broadcast(pivots)
        rows = self._dealt(rows, sent)
        part, told = self._write(rows, "rows")
        heads = self._heads(self.spark.read.schema(rows.schema).parquet(f"{self.path}/{part}"), part, rows.schema, sent)
        table = [(c, n, w, [float(x) for x in hi], [float(x) for x in lo]) for c, (n, w, hi, lo) in heads.items()]
        heads_name, _ = self._write(self.spark.createDataFrame(table, "cell int, n long, widest double, hi array<double>, lo array<double>").coalesce(1), "heads")
        version = max(self.versions()) + 1
        return self._commit({**old.manifest, "version": version, "pivots": name, "heads": heads_name, "tombstones": [], "schema": rows.schema.jsonValue(),
                             "parts": [{"name": part, "version": version}], "num_records": told["rows"], "rows_added": 0, "rows_removed": 0,
                             "texts_encoded": 0, "date_created": datetime.now(timezone.utc).isoformat()})

    def _commit(self, manifest: dict) -> Snapshot:
        if not fs.commit_text(self.spark, f"{self.path}/manifests", f"{manifest['version']:08d}.json", json.dumps(manifest)):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was committed by another update")
        return Snapshot(self.spark, self.path, manifest)

    def _heads(self, vectors: DataFrame, part: str, schema: T.StructType, sent) -> dict[int, tuple]:
        """The heads of the cells of a written part, whose vectors are
        ``vectors``, with its rows per cell."""
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{part}").where("cell IS NOT NULL")
        n = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # one row per cell
        return {c: (n[c], *h[1:]) for c, h in C.head_rows(self._searched(vectors), self.dim, sent).items() if c in n}

    def _searched(self, rows: DataFrame) -> DataFrame:
        """cell and vector of the rows that have one."""
        vec = [F.col("embedding").cast("array<double>").alias("vec")] if self.payload == ["embedding"] else self.payload
        return rows.where("cell IS NOT NULL").select("cell", *vec)

    def _choose_pivots(self, vectors: DataFrame, rows: int, block_rows: int = 4096) -> tuple[np.ndarray, str]:
        some = vectors.where(F.col(self.payload[0]).isNotNull()).select("text_key", *self.payload).orderBy("text_key").limit(C.SAMPLE_ROWS)
        some = some.withColumn("cell", F.lit(0)).transform(self._searched).drop("cell").toArrow()
        sample = np.vstack([np.zeros((0, self.dim)), *[C.batch_matrix(b, self.dim) for b in some.to_batches()]])
        most = max(1, min(C.MAX_CELLS, C.CELL_NUMBERS // (3 * self.dim)))
        pivots = C.choose_pivots(sample, min(most, max(1, -(-rows // block_rows))))
        table = self.spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "n int, vec array<double>")
        return pivots, self._write(table.coalesce(1), "pivots")[0]

    def _dealt(self, rows: DataFrame, sent) -> DataFrame:
        """``rows`` with the cell of their vector and its class ``vk``, the
        same for equal vectors (NULL without one)."""
        names, most = rows.columns, KNOWN_CELLS
        schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("vk", T.StringType())])
        dim, payload = self.dim, self.payload

        def run(batches):
            import hashlib

            import pyarrow as pa
            from pyarrow import compute
            known: dict[str, int] = {}  # the nearest centre is looked for once per class, not per row
            for batch in batches:
                has = compute.is_valid(batch.column(payload[0])).to_numpy(zero_copy_only=False)
                some = batch.filter(pa.array(has)).select(payload)
                ends = np.cumsum(compute.list_value_length(some.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
                flat = [c.flatten().to_numpy(zero_copy_only=False) for c in some.columns]
                vk = np.full(batch.num_rows, None, dtype=object)
                vk[has] = [hashlib.md5(b"".join(x[a:b].tobytes() for x in flat)).hexdigest() for a, b in zip([0, *ends], ends)]
                if payload == ["embedding"]:
                    some = some.rename_columns(["vec"])
                keys = vk[has].tolist()
                fresh = {k: i for i, k in enumerate(keys) if k not in known}
                if fresh:
                    known.update(zip(fresh, C.cell_of(C.batch_matrix(some.take(pa.array(list(fresh.values()))), dim), sent.value).tolist()))
                cell = np.zeros(batch.num_rows, np.int64)
                cell[has] = [known[k] for k in keys]
                if len(known) > most:
                    known.clear()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32(), mask=~has), pa.array(vk, pa.string())], [*names, "cell", "vk"])
        return rows.mapInArrow(run, schema)


def _widened(heads: dict[int, tuple], earlier: list) -> dict[int, tuple]:
    """Heads of cells that cover both (one row per cell on either side)."""
    out = dict(heads)
    for r in earlier:
        n, w, hi, lo = out.get(r["cell"], (0, 0.0, np.full(len(r["hi"]), -np.inf), np.full(len(r["lo"]), np.inf)))
        out[r["cell"]] = (n + r["n"], max(w, r["widest"]), np.maximum(hi, r["hi"]), np.minimum(lo, r["lo"]))
    return out
