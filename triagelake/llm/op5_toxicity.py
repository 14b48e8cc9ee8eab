"""Toxicity: linear classifier over character n-grams whose features are
scaled by naive Bayes log-count ratios, trained on labelled text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, keep, read, small_batches, text_slices, training_rows
from .ngrams import code_points, hashed

ORDERS = (4, 6, 8)
BITS = 20
#: Bound of the labelled rows learnt from, per label.
SAMPLE_ROWS = 2000
#: Pseudo-documents per n-gram, shared between the classes by their size.
PRIOR = 30.0
#: N-grams whose log-count ratio is nearer to 0 than this are left out.
LEAST_RATIO = 0.7
L2 = 3e-4
STEPS = 300
FIT_PART = 1 << 20
THRESHOLD = 0.7


class NBLinear:
    """sigmoid(sum of the weights of the n-grams present + bias); ``weights``
    already hold the log-count ratios, 0 for n-grams left out."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, text: bytes | None) -> float:
        z = float(self.weights[hashed(code_points(text), ORDERS, BITS)].sum()) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (n-gram, documents with label 0, with label 1)."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch, texts in text_slices(batches, "_text"):
        for t, y in zip(texts, batch.column("_y").to_pylist()):
            counts[y, hashed(code_points(t), ORDERS, BITS)] += 1
    some = np.flatnonzero(counts.any(0))
    yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(counts[0, some]), pa.array(counts[1, some])],
                          ["gram", "clean", "toxic"])


def _active(ratios):
    """(label, n-grams that are not left out) of labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = ratios.value
        for batch, texts in text_slices(batches, "_text"):
            grams = [g[used[g]] for g in (hashed(code_points(t), ORDERS, BITS) for t in texts)]
            yield pa.record_batch([batch.column("_y"), pa.array([g.astype(np.int32).tobytes() for g in grams], pa.binary())],
                                  ["y", "grams"])

    return run


def log_count_ratios(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """log of the n-gram's rate in toxic documents over that in clean ones;
    PRIOR pseudo-documents pull n-grams of few documents to 0."""
    share = n_toxic / (n_toxic + n_clean)
    p = (toxic + PRIOR * share) / (n_toxic + PRIOR * share)
    q = (clean + PRIOR * (1 - share)) / (n_clean + PRIOR * (1 - share))
    return np.log(p) - np.log(q)


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on sparse rows (row, column, value)
    by Adam steps over all rows; both classes weigh the same."""
    n = len(y)
    weigh = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    parts = [slice(s, s + FIT_PART) for s in range(0, len(rows), FIT_PART)]  # bounds the memory of a step
    for t in range(1, STEPS + 1):
        z = sum((np.bincount(rows[p], values[p] * w[cols[p]], n) for p in parts), np.zeros(n)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weigh
        g, gb = sum((np.bincount(cols[p], values[p] * err[rows[p]], width) for p in parts), L2 * w), err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.02 / (1 - 0.9 ** t)
        w -= rate * m / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        b -= rate * mb / (np.sqrt(vb / (1 - 0.999 ** t)) + 1e-8)
    return w, b


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> NBLinear:
    """Model from at most SAMPLE_ROWS labelled rows per label, in the order of
    a hash of the id, of ids that are not held out. Of an id with several
    texts, the one with the smallest hash is learnt from. An id with contradicting
    labels counts as toxic; NULL labels and texts are not learnt from.
    Without rows of both labels every score is the share of toxic rows."""
    spark = docs.sparkSession
    small_batches(spark)
    known = (labels.where(training_rows(id_col)).where(F.col(label_col).isin(0, 1))
             .groupBy(F.col(id_col).alias("_lid")).agg(F.max(label_col).cast("int").alias("_y")))
    order = [F.xxhash64("_lid", F.lit(3)), "_lid"]
    chosen = known.where("_y = 1").orderBy(*order).limit(SAMPLE_ROWS).unionAll(
        known.where("_y = 0").orderBy(*order).limit(SAMPLE_ROWS))
    # the chosen ids are at most 2 * SAMPLE_ROWS, and of each one row is learnt
    # from, however often the id is there: few texts are shuffled
    one = F.min(F.struct(F.xxhash64("_text").alias("h"), "_text"))
    sample = keep(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
                  .join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).groupBy("_lid", "_y").agg(one.alias("one"))
                  .select("_y", F.col("one._text").alias("_text")), "toxicity-sample")
    count = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    n_clean, n_toxic = count.get(0, 0), count.get(1, 0)
    none = np.zeros(1 << BITS, np.float32)
    if not n_clean or not n_toxic:
        return NBLinear(none, 60.0 if n_toxic else -60.0)
    # a ratio is far from 0 only if one of the counts is that large: the others stay on the executors
    part = n_toxic / (n_toxic + n_clean)
    least = PRIOR * (np.exp(LEAST_RATIO) - 1)
    found = (sample.mapInArrow(_counts, "gram int, clean int, toxic int").groupBy("gram")
             .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
             .where((F.col("toxic") >= float(0.999 * least * part)) | (F.col("clean") >= float(0.999 * least * (1 - part)))).toPandas())
    clean, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    clean[found["gram"]], toxic[found["gram"]] = found["clean"], found["toxic"]
    ratios = log_count_ratios(clean, toxic, n_clean, n_toxic)
    used = np.abs(ratios) >= LEAST_RATIO
    used &= (clean + toxic) > 0
    rows = sample.mapInArrow(_active(spark.sparkContext.broadcast(used)), "y int, grams binary").collect()
    y = np.array([r["y"] for r in rows], float)
    grams = [np.frombuffer(r["grams"], np.int32) for r in rows]
    cols, at = np.concatenate(grams), np.repeat(np.arange(len(rows), dtype=np.int32), [len(g) for g in grams])
    del rows, grams
    place = np.zeros(1 << BITS, np.int32)
    names = np.flatnonzero(used)
    place[names] = np.arange(len(names))
    values = ratios.astype(np.float32)[cols]
    cols = place[cols]
    w, b = fit_logistic(at, cols, values, y, len(names))
    weights = none
    weights[names] = (w * ratios[names]).astype(np.float32)
    return NBLinear(weights, b)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, texts in text_slices(batches, "_text"):
            scores = [m.score(t) for t in texts]
            yield pa.record_batch([batch.column("_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                                   pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                                  ["_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: NBLinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (0 to 1) and
    ``predicted`` (1 if score >= THRESHOLD). NULL and empty texts have no
    n-gram: their score is the model's bias alone. Whole texts are scored;
    repeated rows give repeated results."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return (rows.mapInArrow(_score(sent), f"_id {kind}, held_out boolean, score double, predicted int")
            .withColumnRenamed("_id", id_col))


def _clean(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, texts in text_slices(batches, text_col):
            yield batch.filter(pa.array([m.score(t) < THRESHOLD for t in texts], pa.bool_()))

    return run


def without_toxic(docs: DataFrame, model: NBLinear, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below THRESHOLD, all columns."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_clean(sent, text_col), docs.schema)


def op5_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = learn(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(read(spark, sf_dir, "documents", "doc_id", "text"), model)
