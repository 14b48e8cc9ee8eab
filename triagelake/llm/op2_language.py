"""Language ID: presence kernels over blended n-grams, Nystrom landmarks,
one-versus-rest kernel ridge regression.

The kernel of two texts is the share of character n-grams (orders 1 to 3)
they have in common: |A and B| / sqrt(|A| |B|) over their sets. Landmarks
are some of the learnt rows; a text's kernel values with them, times one
matrix, give its score per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read, small_batches, text_slices, training_rows
from .ngrams import code_points, hashed

ORDERS = (1, 2, 3)
BITS = 13
#: Bound of the learnt rows (all languages together), and of the landmarks.
SAMPLE_ROWS = 2400
LANDMARKS = 160
RIDGE = 0.3
UNKNOWN = "und"
#: Documents of one matrix product.
BLOCK = 256


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bit set of the n-grams) of learnt rows."""
    for batch, texts in text_slices(batches, "_text"):
        rows = []
        for t in texts:
            flags = np.zeros(1 << BITS, np.uint8)
            flags[hashed(code_points(t), ORDERS, BITS)] = 1
            rows.append(np.packbits(flags).tobytes())
        yield pa.record_batch([batch.column("_lang"), pa.array(rows, pa.binary())], ["_lang", "bits"])


def _has_letter(text: bytes | None) -> bool:
    return text is not None and any(c.isalpha() for c in text.decode("utf-8", "replace"))


class KernelModel:
    """Scores texts: kernel values with the landmarks times ``weights``."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray) -> None:
        self.langs, self.landmarks, self.weights = langs, landmarks, weights

    def scores(self, sets: np.ndarray) -> np.ndarray:
        return presence_kernel(sets, self.landmarks) @ self.weights


def presence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None, :]
    return (a @ b.T) / size


def fit(langs: list[str], sets: np.ndarray) -> KernelModel:
    """Nystrom ridge regression on one-versus-rest targets. Landmarks take
    the languages in turn, so that rare ones are there."""
    names = sorted(set(langs))
    y = np.array([[1.0 if x == n else 0.0 for n in names] for x in langs])
    turn: dict[str, int] = {}
    rank = []
    for x in langs:
        turn[x] = turn.get(x, 0) + 1
        rank.append(turn[x])
    chosen = np.argsort(rank, kind="stable")[:LANDMARKS]
    marks = sets[chosen]
    inner = presence_kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh(inner)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # features = K(x, landmarks) root
    z = presence_kernel(sets, marks).astype(np.float64) @ root
    balance = np.array([1.0 / langs.count(x) for x in langs])
    balance *= len(langs) / balance.sum()
    gram = (z * balance[:, None]).T @ z + RIDGE * np.eye(z.shape[1])
    coef = np.linalg.solve(gram, (z * balance[:, None]).T @ y)
    return KernelModel(names, marks, (root @ coef).astype(np.float32))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelModel | None:
    """Model from at most about SAMPLE_ROWS learnable rows (training id, text
    and lang not NULL, text not empty), an equal share per language, chosen
    by a hash of the id. Only their n-gram bit sets (1 KB each) come to the
    driver. None if there is no such row."""
    rows = docs.where(training_rows(id_col)).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()
                                                   & (F.length(text_col) > 0))
    counts = [(r[0], r[1]) for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(SAMPLE_ROWS).collect()]
    if not counts:
        return None
    share = max(1, SAMPLE_ROWS // len(counts))
    chance = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, share / n))])
    draw = (F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 30)) / float(1 << 30))
    sample = (rows.where(draw < F.element_at(chance, F.col(lang_col)))
              .select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
              .mapInArrow(_sets, "_lang string, bits binary").collect())
    sample.sort(key=lambda r: (r["_lang"], bytes(r["bits"])))
    if not sample:
        return None
    sets = np.unpackbits(np.stack([np.frombuffer(r["bits"], np.uint8) for r in sample]), axis=1).astype(np.float32)
    order = np.random.default_rng(0).permutation(len(sample))
    return fit([sample[i]["_lang"] for i in order], sets[order])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, texts in text_slices(batches, "_text"):
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if m is not None:
                known = [i for i, t in enumerate(texts) if _has_letter(t)]
                for s in range(0, len(known), BLOCK):
                    part = known[s:s + BLOCK]
                    sets = np.zeros((len(part), 1 << BITS), np.float32)
                    for row, i in enumerate(part):
                        sets[row, hashed(code_points(texts[i]), ORDERS, BITS)] = 1
                    out = m.scores(sets)
                    best = out.argmax(1)
                    for row, i in enumerate(part):
                        names[i] = m.langs[best[row]]
                        scores[i] = float(min(1.0, max(0.0, out[row, best[row]])))
            yield pa.record_batch([batch.column("_id"), batch.column("held_out"), pa.array(names, pa.string()),
                                   pa.array(scores, pa.float64())], ["_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: KernelModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score`` (the
    best language's regression value, cut to 0..1).

    ``und`` with score 0 if the text is NULL or has no letter, or no model
    could be learnt. Whole texts are scored; equal scores go to the first
    language by name. Repeated rows give repeated results. A row without an
    id is not held out and never learnt from.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return (rows.mapInArrow(_predict(sent), f"_id {kind}, held_out boolean, lang_pred string, score double")
            .withColumnRenamed("_id", id_col))


def op2_lang_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = learn(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return identify(read(spark, sf_dir, "documents", "doc_id", "text"), model)
