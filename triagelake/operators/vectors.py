"""Vector operators: embed (V1/V2), L2 normalise (V3), exact top-k (V4/V5/V8),
ranked hits (V6/V7) and the hit -> metadata lookup (J1).

Scoring query x corpus (J2) is exact, like a flat inner-product index, but
reads only the cells of the corpus that can hold one of a query's best rows
(``operators.cells``); equal vectors, of the queries and of the corpus, are one.
Queries and the cells they read meet in a co-grouped task, which screens blocks
of both with a float32 matrix product, re-scores what passes in float64 and
keeps each query's local top-k candidates (its own k).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions.text import ColumnOrName, _col
from . import cells as cells_

# ---------------------------------------------------------------------------
# V1 / V2 -- native hashing encoder
# ---------------------------------------------------------------------------

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
HASH_DIM = 64
HASH_MODEL_NAME = "hash-md5-64"


def tokens(text: ColumnOrName) -> Column:
    """Lower-cased runs of letters and digits of the whole text."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))),
                                F.lit(TOKEN_PATTERN), F.lit(0))


_HEX = "0123456789abcdef"


def token_bucket(tok: ColumnOrName, dim: int = HASH_DIM) -> Column:
    """First 32 bits of md5(token) (big-endian) modulo ``dim``.

    When ``dim`` divides 256 only the lowest byte of that 32-bit value
    matters, i.e. hex digits 7 and 8, which are read with two ``instr``
    lookups instead of a base conversion of all eight digits.
    """
    m = F.md5(_col(tok))
    if 256 % dim == 0:
        hi = F.instr(F.lit(_HEX), F.substring(m, 7, 1)) - 1
        lo = F.instr(F.lit(_HEX), F.substring(m, 8, 1)) - 1
        return F.pmod(hi * 16 + lo, F.lit(dim)).cast("int")
    h = F.conv(F.substring(m, 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(dim)).cast("int")


def hash_counts(df: DataFrame, id_col: str, text_col: str, dim: int = HASH_DIM) -> DataFrame:
    """(id, bucket, cnt): token counts per hash bucket. The explode is a
    narrow Generate; the aggregation combines map-side, so at most ``dim``
    rows per input row are shuffled."""
    tok = df.select(F.col(id_col).alias("_id"), F.explode(tokens(text_col)).alias("_tok"))
    return (tok.select("_id", token_bucket("_tok", dim).alias("bucket"))
               .groupBy("_id", "bucket").agg(F.count(F.lit(1)).alias("cnt"))
               .withColumnRenamed("_id", id_col))


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = HASH_DIM,
               out_col: str = "embedding") -> DataFrame:
    """Dense unit-length bag-of-hashed-tokens vectors, one row per input row
    that has at least one token (``id_col`` must be unique).

    Counts per (id, bucket) are folded per id into a bucket -> count map and
    the norm in the same aggregation (at most ``dim`` entries per id); the
    dense vector reads both as stored values.
    """
    c = hash_counts(df, id_col, text_col, dim)
    per_id = c.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "cnt"))).alias("_m"),
        F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).cast("double")).alias("_norm"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(0)).cast("double")
                      / F.col("_norm"))
    return per_id.select(id_col, vec.alias(out_col))


def hash_weights(df: DataFrame, id_col: str, text_col: str, dim: int = HASH_DIM) -> DataFrame:
    """(id, bucket, weight): the non-zero entries of ``hash_embed``'s unit
    vectors, computed without assembling vectors (count / per-id norm)."""
    c = hash_counts(df, id_col, text_col, dim)
    norm = F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).over(Window.partitionBy(id_col)).cast("double"))
    return c.select(id_col, "bucket", (F.col("cnt").cast("double") / norm).alias("weight"))


def sparse_weights(dense: DataFrame, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """(id, bucket, weight) rows for the non-zero entries of dense vectors."""
    return (dense.select(id_col, F.posexplode(vec_col).alias("bucket", "weight"))
            .where(F.col("weight") != 0))


def embed_with(df: DataFrame, text_col: str, encoder: Callable, dim: int,
               batch_size: int = rules.EMBED_BATCH, out_col: str = "embedding") -> DataFrame:
    """V1 with a user-supplied model (F2).

    ``encoder`` is a ``make_predict_fn`` for ``pyspark.ml.functions.predict_batch_udf``:
    it is called once per Python worker and returns a function from a numpy
    array of strings to an (n, dim) float array. Batches are Arrow batches.
    """
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out_col, udf(F.coalesce(F.col(text_col), F.lit(""))))


# ---------------------------------------------------------------------------
# V3 -- L2 normalisation with the norm stored as a column
# ---------------------------------------------------------------------------


def with_norm(df: DataFrame, vec_col: str = "embedding", norm_col: str = "norm") -> DataFrame:
    """Add the L2 norm of ``vec_col`` as a column (computed once per row)."""
    sq = F.aggregate(F.col(vec_col), F.lit(0.0).cast("double"),
                     lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return df.withColumn(norm_col, F.sqrt(sq))


def l2_normalize(df: DataFrame, vec_col: str = "embedding", norm_col: str = "norm",
                 out_col: str | None = None) -> DataFrame:
    """Unit vectors; zero vectors stay unchanged. Reads a *stored* norm column
    (call ``with_norm`` and persist/write first) so that the division does not
    recompute the norm for every element."""
    out_col = out_col or vec_col
    n = F.col(norm_col)
    return df.withColumn(out_col, F.when(n > 0, F.transform(F.col(vec_col), lambda x: x.cast("double") / n))
                         .otherwise(F.transform(F.col(vec_col), lambda x: x.cast("double"))))


# ---------------------------------------------------------------------------
# V4 / V5 / V8 -- exact top-k by inner product of unit vectors
# ---------------------------------------------------------------------------

# Rounded scores decide ranks (ties by id). An item can reach the top k under
# the rounded order only if its exact score is within 1e-4 of the k-th best
# exact score. Pairs are screened with a float32 product (error below 1e-5 for
# unit vectors of this size) against the k-th best float32 score minus a
# margin that covers both, and the survivors are re-scored in float64. Exact,
# no cap on candidates.
SCORE_DIGITS = 4
_MARGIN = 1.5e-4


def _normalize(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    # rows that are already unit length are left bit-for-bit as stored
    n[(n == 0) | (np.abs(n - 1.0) < 1e-12)] = 1.0
    return m / n[:, None]


def _unit_rows(vals: pd.Series, dim: int | None = None) -> np.ndarray:
    if len(vals) == 0:
        return np.zeros((0, dim or 0), dtype=np.float64)
    return _normalize(np.stack([np.asarray(v, dtype=np.float64) for v in vals.values]))


def _matrix(df: pd.DataFrame, id_name: str, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit-row matrix) from a dense ``vec`` column, or -- when the
    frame has ``b``/``v`` columns -- from long (id, index, value) rows."""
    if "vec" in df.columns:
        return df[id_name].to_numpy(), _unit_rows(df["vec"], dim)
    if "bs" in df.columns:  # one row per id with aligned index / value arrays
        ids = df[id_name].to_numpy()
        lens = df["bs"].map(len).to_numpy()
        m = np.zeros((len(ids), dim), dtype=np.float64)
        if lens.sum():
            m[np.repeat(np.arange(len(ids)), lens), np.concatenate(df["bs"].to_numpy()).astype(np.int64)] = \
                np.concatenate(df["vs"].to_numpy()).astype(np.float64)
        return ids, _normalize(m)
    inv, ids = pd.factorize(df[id_name], sort=False)
    ids = np.asarray(ids)
    m = np.zeros((len(ids), dim), dtype=np.float64)
    m[inv, df["b"].to_numpy(dtype=np.int64)] = df["v"].to_numpy(dtype=np.float64)
    return ids, _normalize(m)


def _first_k_per_row(r: np.ndarray, cidx: np.ndarray, exact: np.ndarray, crank: np.ndarray,
                     k: int | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keep, per query row, the first ``k`` (one, or one per row) candidates in the final order
    (score rounded to 4 places desc, id asc) plus every candidate whose
    score lies within 1e-6 of a rounding boundary, where this rounding and
    Spark's could differ. Whatever the true top k is, it is inside the kept
    set, and a row never keeps many more than k even when thousands tie."""
    if len(r) == 0:
        return r, cidx, exact
    scaled = exact * 10.0 ** SCORE_DIGITS
    frac = scaled - np.floor(scaled)
    ambiguous = np.abs(frac - 0.5) < 1e-6
    rounded = np.floor(scaled + 0.5)
    order = np.lexsort((crank[cidx], -rounded, r))
    rs = r[order]
    first = np.r_[True, rs[1:] != rs[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(rs)), 0))
    pos = np.arange(len(rs)) - start
    keep = np.zeros(len(r), dtype=bool)
    keep[order[pos < (k if np.isscalar(k) else k[rs])]] = True
    keep |= ambiguous
    return r[keep], cidx[keep], exact[keep]


#: Cells of one float32 product, rows of one that holds several blocks, candidate pairs re-scored at a time, and
#: candidates that a lot holds before they are cut to each query's own k.
_PRODUCT_CELLS = 1 << 22
_PRODUCT_ROWS = 1 << 12
_RESCORE_PAIRS = 1 << 17
_HELD_CANDIDATES = 1 << 20


def _exact_scores(qm: np.ndarray, cm: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Float64 scores of pairs, in slices of bounded memory."""
    out = np.empty(len(r))
    for s in range(0, len(r), _RESCORE_PAIRS):
        e = s + _RESCORE_PAIRS
        out[s:e] = np.einsum("ij,ij->i", qm[r[s:e]], cm[c[s:e]])
    return out


def _kth_best(s: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Per row its own k-th largest value (the smallest if it has fewer)."""
    out = s.min(axis=1)
    for kk in np.unique(k):
        if kk < s.shape[1]:
            rows = np.flatnonzero(k == kk)
            out[rows] = np.partition(s[rows], s.shape[1] - kk, axis=1)[:, s.shape[1] - kk]
    return out


def _block_pairs(s: np.ndarray, k: np.ndarray, least: np.ndarray, positive: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a product that may be among a row's best k: those of at least
    ``least`` and, where these are many, within the margin of the k-th best.
    One compare per cell; -inf entries never pass."""
    lowest = np.float32(-2)  # below any score of unit vectors
    # just below in float32: a compare with float64 numbers would widen every cell
    least = np.nextafter(np.maximum(least, lowest).astype(np.float32), np.float32(-np.inf))
    if positive:
        least = np.maximum(least, np.nextafter(np.float32(0), np.float32(1)))
    passed = s >= least[:, None]
    if np.count_nonzero(passed) > 8 * int(k.sum()):  # else no more is kept than a few per row
        many = np.flatnonzero(np.count_nonzero(passed, axis=1) > 8 * k)
        some = s[many]
        groups = max(64, 4 * int(k[many].max(initial=1)))
        if s.shape[1] >= 4 * groups:  # the k-th best of the groups' best is not above the k-th best of all
            some = some[:, :s.shape[1] // groups * groups].reshape(len(many), groups, -1).max(axis=2)
        kth = _kth_best(some, k[many]) - _MARGIN
        passed[many] &= s[many] >= np.where(np.isfinite(kth), kth, lowest)[:, None]
    return np.divmod(np.flatnonzero(passed), s.shape[1])  # several times as fast as nonzero of rows and columns


def _reads(q: pd.DataFrame, c: pd.DataFrame, c_rows: int | None):
    """(rows of q, rows of c, wants) for one product after the other: the rows
    of a cell, ``c_rows`` at a time, with the queries that read it; all with all
    without cells. Blocks of neighbouring cells that mostly have the same
    readers go into one product; ``wants`` is None or which row of q wants
    which block, and the blocks' numbers of rows."""
    if "cells" not in q.columns:
        for start in range(0, len(c), c_rows or max(1, len(c))):
            yield np.arange(len(q)), np.arange(len(c))[start:start + (c_rows or len(c))], None
        return
    cell = c["cell"].to_numpy()
    rows = np.argsort(cell, kind="stable")
    cells, first = np.unique(cell[rows], return_index=True)
    blocks = []  # place of the cell, rows
    for n, ci in enumerate(np.split(rows, first[1:])):
        blocks += [(n, ci[start:start + (c_rows or len(ci))]) for start in range(0, len(ci), c_rows or max(1, len(ci)))]
    lens = q["cells"].map(len).to_numpy()
    reader, read = np.repeat(np.arange(len(q)), lens), np.concatenate(q["cells"].to_numpy())
    place = np.minimum(np.searchsorted(cells, read), len(cells) - 1)
    there = cells[place] == read
    reads = np.zeros((len(cells), len(q)), dtype=bool)
    reads[place[there], reader[there]] = True

    def product(some):
        who = np.flatnonzero(np.logical_or.reduce([reads[n] for n, _ in some]))
        wants = np.stack([reads[n, who] for n, _ in some], axis=1)
        ci = np.concatenate([x for _, x in some])
        return who, ci, None if wants.all() else (wants, [len(x) for _, x in some])
    some, union, size, wanted = [], None, 0, 0
    for n, ci in blocks:
        pairs = np.count_nonzero(reads[n]) * len(ci)
        if not pairs:
            continue
        if some:
            both = union | reads[n]
            # one product if it is not too large and mostly what is wanted
            if size + len(ci) <= _PRODUCT_ROWS and 4 * (wanted + pairs) >= 3 * np.count_nonzero(both) * (size + len(ci)):
                some, union, size, wanted = [*some, (n, ci)], both, size + len(ci), wanted + pairs
                continue
            yield product(some)
        some, union, size, wanted = [(n, ci)], reads[n], len(ci), pairs
    if some:
        yield product(some)


def _local_topk_fn(exclude_self: bool, min_score: float | None, dim: int | None = None, q_rows: int | None = None, c_rows: int | None = None):
    """Cogroup function: every query's candidates of one lot of the corpus.
    Rows of ``q`` carry their own ``k`` (at least 1) and, if they have them,
    the ``bound`` that their k-th best row so far sets and the ``cells`` they
    read; rows of ``c`` their ``cell`` and the class ``vk`` they stand for."""

    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [x for x in ("id", "vk") if x in c.columns]
        if len(q) == 0 or len(c) == 0:
            return pd.DataFrame({"qid": q["qid"].iloc[:0], "k": q["k"].iloc[:0], **{x: c[x].iloc[:0] for x in found},
                                 "score": np.zeros(0)})
        q = q.reset_index(drop=True)
        ks = q["k"].to_numpy(dtype=np.int64)
        floor = -np.inf if min_score is None else min_score - 1e-5
        bound = q["bound"].to_numpy(dtype=np.float64).copy() if "bound" in q.columns else np.full(len(q), -np.inf)
        cids, cm = _matrix(c, "id", dim)
        qids, qm = _matrix(q, "qid", cm.shape[1])
        cm32, qm32 = cm.astype(np.float32), qm.astype(np.float32)
        own = None  # rows of q and c with the same id
        if exclude_self:
            own = pd.merge(pd.DataFrame({"x": qids, "q": np.arange(len(qids))}), pd.DataFrame({"x": cids, "c": np.arange(len(cids))}), on="x")
            own_q, own_c = own["q"].to_numpy(), own["c"].to_numpy()
        # rank of each corpus id in id order (Spark orders strings by code point)
        none = pd.isna(cids)
        crank = np.zeros(len(cids), dtype=np.int64)  # NULL ids come first
        crank[np.flatnonzero(~none)[np.argsort(cids[~none], kind="stable")]] = np.arange(1, (~none).sum() + 1)
        # vectors without negative entries: a product of 0 is exactly 0
        positive = min_score is not None and min_score >= 0 and qm.min() >= 0 and cm.min() >= 0
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        n_held = room = 0
        product = np.empty(0, np.float32)  # memory of every product

        def learn(r, exact):
            """The k-th best of a query's candidates sets its bound."""
            order = np.lexsort((-exact, r))
            rs = r[order]
            place = np.arange(len(rs)) - np.searchsorted(rs, rs)
            kth = order[place == ks[rs] - 1]
            bound[r[kth]] = np.maximum(bound[r[kth]], exact[kth])

        def cut():
            """What is held, cut to each query's first k; they set its bound."""
            r, at, exact = _first_k_per_row(*[np.concatenate(x) for x in zip(*held)], crank, ks)
            learn(r, exact)
            held[:] = [(r, at, exact)]
            return len(r)
        for qi, ci, wants in _reads(q, c, c_rows):
            block, block32 = cm[ci], cm32[ci]
            step = max(1, min(q_rows or len(qi), _PRODUCT_CELLS // max(1, len(ci))))
            for start in range(0, len(qi), step):
                some = qi[start:start + step]
                if len(product) < len(some) * len(ci):
                    product = np.empty(len(some) * len(ci), np.float32)
                s = np.matmul(qm32[some], block32.T, out=product[:len(some) * len(ci)].reshape(len(some), len(ci)))
                if wants is not None:
                    ends = np.cumsum(wants[1]).tolist()
                    for n, (a, b) in enumerate(zip([0, *ends], ends)):
                        s[~wants[0][start:start + step, n], a:b] = -np.inf
                if own is not None:
                    q_at, c_at = np.full(len(qids), -1), np.full(len(cids), -1)
                    q_at[some], c_at[ci] = np.arange(len(some)), np.arange(len(ci))
                    here = (q_at[own_q] >= 0) & (c_at[own_c] >= 0)
                    s[q_at[own_q[here]], c_at[own_c[here]]] = -np.inf
                r, at = _block_pairs(s, ks[some], np.maximum(bound[some] - _MARGIN, floor), positive)
                exact = _exact_scores(qm[some], block, r, at)
                if min_score is not None:
                    ok = exact > min_score
                    r, at, exact = r[ok], at[ok], exact[ok]
                r, at, exact = _first_k_per_row(r, ci[at], exact, crank, ks[some])
                held.append((some[r], at, exact))
                learn(some[r], exact)
                n_held += len(r)
                if n_held > max(_HELD_CANDIDATES, 2 * room):
                    n_held = room = cut()
        cut()
        r, at, exact = held[0]
        return pd.DataFrame({"qid": qids[r], "k": ks[r], **{x: c[x].to_numpy()[at] for x in found}, "score": exact})
    return fn


# -- classes of equal vectors --------------------------------------------------

def class_key(*vec: str) -> Column:
    """The same for equal vectors: a digest of the vector's columns."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in vec]))


def _members(c: DataFrame, payload: tuple[str, ...], most: int) -> DataFrame:
    """Rows with the class ``vk`` of their vector and their place ``nth`` in it
    by id, written once. No query takes more than ``most`` rows of a class. A
    stored index has the classes of its rows."""
    c = c if "vk" in c.columns else c.withColumn("vk", class_key(*payload))
    nth = F.row_number().over(Window.partitionBy("vk").orderBy(F.col("id").asc()))
    return cells_.keep_table(c.withColumn("nth", nth).where(F.col("nth") <= F.lit(most)), "members")


def _no_hits(qid: T.StructField, id_type: T.DataType, q: DataFrame) -> DataFrame:
    return q.sparkSession.createDataFrame([], T.StructType([T.StructField("qid", qid.dataType), T.StructField("rank", T.IntegerType()),
                                                            T.StructField("id", id_type), T.StructField("score", T.DoubleType())]))


def _search_cells(q: DataFrame, c: DataFrame, payload: tuple[str, ...], *, exclude_self: bool, min_score: float | None, dim: int | None,
                  block_rows: int, q_rows: int, cells: int | None, q_parts: int | None, work: cells_.Work | None) -> DataFrame:
    """Deal the corpus to cells and search them (see ``operators.cells``)."""
    c = c.where(F.col(payload[0]).isNotNull())

    def deal(rows: DataFrame, more: tuple[str, ...]) -> cells_.Cells | None:
        return cells_.deal(rows, payload, dim, block_rows, cells, more)
    return _search_classes(q, c, payload, deal, exclude_self=exclude_self, min_score=min_score, q_rows=q_rows, q_parts=q_parts, work=work)


def search_dealt(q: DataFrame, dealt: cells_.Cells, *, exclude_self: bool = False, min_score: float | None = None, q_rows: int = 8192,
                 q_parts: int | None = None, work: cells_.Work | None = None) -> DataFrame:
    """Top rows of a dealt corpus (``cells.deal``, or a stored index' ``cells``)
    for queries with qid, k and the vector's columns: qid, rank, id, score."""
    def deal(rows: DataFrame, more: tuple[str, ...]) -> cells_.Cells:
        return cells_.narrowed(dealt, rows) if more else replace(dealt, rows=rows.drop("vk"))
    return _search_classes(q, dealt.rows, dealt.payload, deal,
                           exclude_self=exclude_self, min_score=min_score, q_rows=q_rows, q_parts=q_parts, work=work)


def _search_classes(q: DataFrame, c: DataFrame, payload: tuple[str, ...], deal: Callable, *, exclude_self: bool, min_score: float | None,
                    q_rows: int, q_parts: int | None, work: cells_.Work | None) -> DataFrame:
    """Search each distinct vector of the queries once, among the distinct
    vectors of the corpus. A class of equal vectors stands at its first id: the
    k best rows lie in the k best classes, with at most k rows of each, so
    these are ranked as rows for each class of queries and then handed to its
    queries. Queries whose k is below 1 or whose vector is NULL have no result.

    With ``exclude_self`` every query has rows of its own, so rows are searched
    and not classes."""
    id_field, qid_field = c.schema["id"], q.schema["qid"]
    q = q.where((F.col("k") > 0) & F.col(payload[0]).isNotNull()).select("qid", F.col("k").cast("long").alias("k"), *payload)

    def best(queries: DataFrame, dealt: cells_.Cells, fields: list[T.StructField]) -> DataFrame:
        score = _local_topk_fn(exclude_self, min_score, dealt.dim, q_rows, dealt.block_rows)
        return cells_.search(queries, dealt, lambda a, b: score(a, b), rank_all, margin=_MARGIN, q_rows=q_rows, q_parts=q_parts,
                             found_fields=fields, min_score=min_score, work=work)
    if exclude_self:
        dealt = deal(c, ())
        return _no_hits(qid_field, id_field.dataType, q) if dealt is None else best(q, dealt, [id_field]).select("qid", "rank", "id", "score")
    q = cells_.keep_table(q.withColumn("qvk", class_key(*payload)), "query-classes")
    most = q.agg(F.max("k")).first()[0]
    rows = None if most is None else _members(c, payload, most)
    dealt = None if rows is None else deal(rows.where("nth = 1").drop("nth"), ("vk",))
    if dealt is None or not len(dealt.numbers):
        return _no_hits(qid_field, id_field.dataType, q)
    asked = q.groupBy("qvk", *payload).agg(F.max("k").alias("k")).withColumnRenamed("qvk", "qid")
    classes = best(asked, dealt, [id_field, T.StructField("vk", T.StringType())]).select(F.col("qid").alias("qvk"), "k", "vk", "score")
    found = rank_all(classes.join(rows.select("vk", "id"), "vk").select(F.col("qvk").alias("qid"), "k", "id", "score"))
    found = cells_.keep_table(found.select(F.col("qid").alias("qvk"), "id", "score"), "found")
    return rank_all(q.select("qid", "k", "qvk").join(found, "qvk").drop("qvk")).select("qid", "rank", "id", "score")


def topk_search(queries: DataFrame, corpus: DataFrame, k: int | None = rules.DEFAULT_TOP_K, *,
                q_id: str = "qid", q_vec: str = "embedding", k_col: str | None = None,
                c_id: str = "id", c_vec: str = "embedding",
                exclude_self: bool = False, min_score: float | None = None,
                q_block_rows: int = 8192, c_block_rows: int = 4096,
                q_blocks: int | None = None, c_blocks: int | None = None,
                work: cells_.Work | None = None) -> DataFrame:
    """Exact top-k corpus rows per query by cosine similarity.

    Returns (qid, rank, id, score) with ``score`` the raw float64 inner
    product of the L2-normalised vectors and ``rank`` 1..k ordered by score
    rounded to 4 places (descending), then id (ascending).

    ``k`` is a constant; with ``k_col`` each query carries its own k (NULL ->
    ``k``), and rows beyond it are dropped. ``exclude_self`` removes the
    corpus row whose id equals the query id (V4). ``min_score`` keeps only
    strictly larger scores. Corpus ids must be unique.

    The corpus is dealt to cells of about ``c_block_rows`` rows (``c_blocks``
    sets their number); at most ``c_block_rows`` rows of a cell are scored with
    at most ``q_block_rows`` queries at a time (``q_blocks`` sets the number of
    parts that the queries of a cell are dealt to). Cells that
    cannot reach a query's k-th best score are not read for it; ``work`` is
    filled with what was scored. Rows and queries without a vector are left
    out; all vectors have the same number of components.
    """
    default_k = int(k if k is not None else rules.DEFAULT_TOP_K)
    kexpr = F.coalesce(F.col(k_col).cast("int"), F.lit(default_k)) if k_col else F.lit(default_k)
    q = queries.select(F.col(q_id).alias("qid"), F.col(q_vec).cast("array<double>").alias("vec"), kexpr.alias("k"))
    c = corpus.select(F.col(c_id).alias("id"), F.col(c_vec).cast("array<double>").alias("vec"))
    return _search_cells(q, c, ("vec",), exclude_self=exclude_self, min_score=min_score, dim=None, block_rows=c_block_rows,
                         q_rows=q_block_rows, cells=c_blocks, q_parts=q_blocks, work=work)


def pack(df: DataFrame, id_col: str, index_col: str = "bucket", value_col: str = "cnt") -> DataFrame:
    """One row per vector from long (id, index, value) rows: ``bs`` (indices)
    and ``vs`` (values), aligned arrays in index order."""
    g = df.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(
        F.col(index_col).cast("int").alias("b"), F.col(value_col).cast("double").alias("v")))).alias("_l"))
    return g.select(id_col, F.transform("_l", lambda x: x["b"]).alias("bs"), F.transform("_l", lambda x: x["v"]).alias("vs"))


#: Texts whose tokens are held at a time, and the byte that each byte of an ASCII text is for its tokens.
_TOKEN_ROWS = 1024
_TOKEN_BYTES = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def _bucket_counts(dim: int, names: list[str]):
    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import compute

        def spaced(texts):
            """ASCII texts in lower case, with a space for all but letters and digits."""
            valid, offsets, data = texts.cast(pa.string()).buffers()
            if data is None:
                return texts.cast(pa.string())
            return pa.Array.from_buffers(pa.string(), len(texts), [valid, offsets, pa.py_buffer(_TOKEN_BYTES[np.frombuffer(data, np.uint8)])], offset=texts.offset)

        def counts(part):
            rows, buckets = [], []
            words = compute.ascii_split_whitespace(part.column("_plain"))
            lens = compute.fill_null(compute.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = words.flatten().dictionary_encode()
            # each distinct token of the slice is hashed once; '' beside a separator is none
            of = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % dim if w else -1 for w in flat.dictionary.to_pylist()], np.int64)
            if len(flat):
                bucket = of[flat.indices.to_numpy(zero_copy_only=False)]
                rows.append(np.repeat(np.arange(part.num_rows), lens)[bucket >= 0])
                buckets.append(bucket[bucket >= 0])
            at = part.column("_at")
            lens = compute.fill_null(compute.list_value_length(at), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows.append(np.repeat(np.arange(part.num_rows), lens))
            buckets.append(at.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            return np.unique(np.concatenate(rows) * dim + np.concatenate(buckets), return_counts=True)
        for batch in batches:
            batch = batch.set_column(batch.num_columns - 2, "_plain", spaced(batch.column("_plain")))
            for start in range(0, batch.num_rows, _TOKEN_ROWS):
                part = batch.slice(start, _TOKEN_ROWS)
                cell, n = counts(part)
                some = np.unique(cell // dim)  # rows with a token
                offsets = pa.array(np.r_[np.searchsorted(cell, some * dim), len(cell)], pa.int32())
                kept = part.select(names[:-2]).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(offsets, pa.array(cell % dim, pa.int32())),
                                                  pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.float64)))], names)
    return run


def pack_texts(df: DataFrame, text_col: str, dim: int = HASH_DIM, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` (its columns, or those in ``keep``) whose text has a
    token, with the packed counts of that text: what ``pack`` makes of
    ``hash_counts``, row by row, so nothing is shuffled and rows of one id stay
    apart. ASCII texts are cut into tokens batch by batch, where an Arrow
    expression says the same as ``tokens``; all others by ``tokens`` itself."""
    text = F.coalesce(_col(text_col), F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    keep = df.columns if keep is None else keep
    rows = df.select(*keep, F.when(plain, text).alias("_plain"),
                     F.when(~plain, F.transform(tokens(text_col), lambda t: token_bucket(t, dim))).alias("_at"))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("bs", T.ArrayType(T.IntegerType())), T.StructField("vs", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(_bucket_counts(dim, schema.names), schema)


def topk_search_long(queries: DataFrame, corpus: DataFrame, k: int | None = rules.DEFAULT_TOP_K, *,
                     q_id: str = "qid", c_id: str = "id", dim: int = HASH_DIM, k_col: str | None = None,
                     exclude_self: bool = False, min_score: float | None = None,
                     q_block_rows: int = 8192, c_block_rows: int = 4096,
                     q_blocks: int | None = None, c_blocks: int | None = None,
                     work: cells_.Work | None = None) -> DataFrame:
    """``topk_search`` for packed vectors (see ``pack``): ids with columns
    ``bs`` and ``vs``. Each task builds and normalises its block's matrix
    (value / sqrt(sum of squares), the arithmetic of ``hash_embed``); the heads
    of a cell's posting lists bound what its rows can score. ``k_col`` of the
    queries gives each its own k.
    """
    default_k = int(k if k is not None else rules.DEFAULT_TOP_K)
    kexpr = F.coalesce(F.col(k_col).cast("int"), F.lit(default_k)) if k_col else F.lit(default_k)
    q = queries.select(F.col(q_id).alias("qid"), kexpr.alias("k"), "bs", "vs")
    c = corpus.select(F.col(c_id).alias("id"), "bs", "vs")
    return _search_cells(q, c, ("bs", "vs"), exclude_self=exclude_self, min_score=min_score, dim=dim, block_rows=c_block_rows,
                         q_rows=q_block_rows, cells=c_blocks, q_parts=q_blocks, work=work)


def rank_all(cand: DataFrame) -> DataFrame:
    """Each query's first k candidates (qid, k, id, score) with their rank:
    row_number per query by rounded score desc, id asc."""
    w = Window.partitionBy("qid").orderBy(F.round("score", SCORE_DIGITS).desc(), F.col("id").asc())
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("k"))


# ---------------------------------------------------------------------------
# V6 / V7 / J1 -- ranked hits with metadata
# ---------------------------------------------------------------------------


def _meta_or(meta_cols: list[str], name: str, default: str) -> Column:
    """P5: a missing *column* takes the default; a present NULL stays NULL."""
    return F.col(f"_m_{name}") if name in meta_cols else F.lit(default)


def attach_metadata(top: DataFrame, metadata: DataFrame, *, meta_id: str = "id",
                    mode: str = "hit", text_chars: int | None = None) -> DataFrame:
    """Join top-k rows to corpus metadata by id (left join, so hits whose
    metadata is missing keep default fields) and project a hit record.

    mode='hit' (V6): rank, id, similarity_score (4 dp), source, training_text,
    assignment_group, configuration_item, category.
    mode='snippet' (V7): id, source, score (raw), snippet, '' defaults.
    ``text_chars`` cuts the shown text (a display feature: 500 for hits, 200
    for snippets); None keeps whole texts, as prompts need them.
    The join is an equi-join on id; AQE chooses broadcast or sort-merge.
    """
    mcols = [c for c in metadata.columns if c != meta_id]
    # A display cut is made *before* the join, so that the shuffle carries
    # what is shown only.
    def proj(c: str) -> Column:
        col = F.left(F.col(c), F.lit(text_chars)) if c == "training_text" and text_chars is not None else F.col(c)
        return col.alias(f"_m_{c}")
    meta = metadata.select(F.col(meta_id).alias("_mid"), *[proj(c) for c in mcols])
    j = top.join(meta, top["id"] == meta["_mid"], "left")
    found = F.col("_mid").isNotNull()
    text = _meta_or(mcols, "training_text", "")
    if mode == "snippet":
        return j.select(
            "qid", "rank",
            F.when(found, F.col("id").cast("string")).otherwise(F.lit("")).alias("id"),
            F.when(found, _meta_or(mcols, "source", "")).otherwise(F.lit("")).alias("source"),
            F.col("score").alias("score"),
            F.when(found, text).otherwise(F.lit("")).alias("snippet"),
        )
    return j.select(
        "qid", F.col("rank").cast("int").alias("rank"),
        F.when(found, F.col("id").cast("string"))
         .otherwise(F.concat(F.lit(rules.RECORD_ID_PREFIX), F.col("id").cast("string"))).alias("id"),
        F.round("score", SCORE_DIGITS).alias("similarity_score"),
        F.when(found, _meta_or(mcols, "source", rules.UNKNOWN_SOURCE))
         .otherwise(F.lit(rules.UNKNOWN_SOURCE)).alias("source"),
        F.when(found, text).otherwise(F.lit("")).alias("training_text"),
        F.when(found, _meta_or(mcols, "assignment_group", rules.NOT_PROVIDED))
         .otherwise(F.lit(rules.NOT_PROVIDED)).alias("assignment_group"),
        F.when(found, _meta_or(mcols, "configuration_item", rules.NOT_PROVIDED))
         .otherwise(F.lit(rules.NOT_PROVIDED)).alias("configuration_item"),
        F.when(found, _meta_or(mcols, "category", rules.NOT_PROVIDED))
         .otherwise(F.lit(rules.NOT_PROVIDED)).alias("category"),
    )


def search(queries: DataFrame, corpus: DataFrame, metadata: DataFrame, k: int = rules.DEFAULT_TOP_K,
           mode: str = "hit", **kw) -> DataFrame:
    """V2+V5+V6: search a batch of query vectors and return ranked hits."""
    top = topk_search(queries, corpus, k, **kw)
    return attach_metadata(top, metadata, mode=mode)


def build_index(corpus: DataFrame, id_col: str = "id", text_col: str = "training_text", dim: int = HASH_DIM,
                encoder: Callable | None = None) -> DataFrame:
    """The search index of a text corpus: its columns plus every text's vector
    -- packed token counts (``bs``, ``vs``), or with a user ``encoder`` (F2,
    see ``embed_with``) a dense ``embedding``. Texts are encoded whole. Write
    the result once (``write_parquet``) and search it many times; texts
    without a token are in the index and match nothing.
    """
    if encoder is not None:
        return embed_with(corpus, text_col, encoder, dim)
    packed = pack(hash_counts(corpus, id_col, text_col, dim), id_col)
    return corpus.join(packed, id_col, "left")


def search_texts(requests: DataFrame, index, *, key: str = "request_id", text_col: str = "query",
                 k_col: str | None = "top_k", default_k: int = rules.DEFAULT_TOP_K, index_id: str = "id",
                 dim: int = HASH_DIM, encoder: Callable | None = None, min_score: float | None = 0.0,
                 text_chars: int | None = None, grouped: bool = False, **kw) -> DataFrame | tuple[DataFrame, DataFrame]:
    """V2 + V5 + V8 + V6 for a table of text requests against an index -- a
    version of a stored one (``operators.index``), whose cells are searched as
    they are, or a table of ``build_index``; with the same ``encoder`` --
    searching each distinct text once. Of the index only ids and vectors are
    searched; no text of the corpus is encoded.

    Requests are grouped by the md5 of their text (combined map-side, so a
    text asked by a large share of requests becomes one row before the
    shuffle), and the texts by their vectors; each vector is searched with the
    largest k any of its requests asks for; hits get their metadata from the
    index, once per vector; each request then takes its own first k hits. Returns the V6
    hit columns with ``key`` in place of ``qid``; ``grouped``, what ``group_requests`` makes
    of them, so that folds of hits are made once per group and not per request.
    """
    kexpr = F.coalesce(F.col(k_col).cast("int"), F.lit(default_k)) if k_col else F.lit(default_k)
    text = F.coalesce(F.col(text_col), F.lit(""))
    req = requests.select(key, F.md5(text).alias("_sid"), text.alias("_text"), kexpr.alias("_k"))
    texts = req.groupBy("_sid", "_text").agg(F.max("_k").alias("k"))  # no text is an aggregate, which would be sorted for
    vec = ("bs", "vs") if encoder is None else ("embedding",)
    if encoder is not None:
        q = embed_with(texts, "_text", encoder, dim).select("_sid", "k", "embedding")
    else:
        q = pack_texts(texts, "_text", dim, ["_sid", "k"])
    q = cells_.keep_table(q.withColumn("_vk", class_key(*vec)), "texts")
    asked = q.groupBy("_vk", *vec).agg(F.max("k").alias("k"))
    if not isinstance(index, DataFrame):
        given = [F.col("embedding").cast("array<double>").alias("vec")] if encoder is not None else ["bs", "vs"]
        dealt, index = index.cells(), index.rows()
        if dealt is None:
            top = _no_hits(T.StructField("qid", T.StringType()), index.schema[index_id].dataType, requests)
        else:
            top = search_dealt(asked.select(F.col("_vk").alias("qid"), "k", *given), dealt, min_score=min_score, **kw)
    elif encoder is not None:
        top = topk_search(asked, index, default_k, q_id="_vk", c_id=index_id, k_col="k", min_score=min_score, **kw)
    else:
        top = topk_search_long(asked, index, default_k, q_id="_vk", c_id=index_id, dim=dim, k_col="k", min_score=min_score, **kw)
    top = cells_.keep_table(top, "top")
    meta = index.drop("bs", "vs", "embedding").join(top.select(F.col("id").alias(index_id)).distinct(), index_id, "left_semi")
    hits = attach_metadata(top, meta, meta_id=index_id, mode="hit", text_chars=text_chars).withColumnRenamed("qid", "_vk")
    hits = cells_.keep_table(hits, "hits")
    asked = req.drop("_text").join(q.select("_sid", "_vk"), "_sid")
    if grouped:
        return group_requests(asked.select(key, "_vk", "_k"), hits, key)
    joined = asked.join(hits, "_vk").where(F.col("rank") <= F.col("_k"))
    cols = [c for c in hits.columns if c != "_vk"]
    return joined.select(key, *cols)


#: Requests of one group at most.
GROUP_REQUESTS = 1 << 16


def group_requests(asked: DataFrame, hits: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests that have the same hits as groups: (``key``, group_id), one row
    per key, and (group_id, the columns of ``hits``).

    ``asked`` has a row (``key``, _vk, _k) per request, ``hits`` those of each
    class ``_vk``; a request has its class' first ``_k``. A key that comes
    several times has the hits of all its rows. Texts of hits are joined to
    groups and never shuffled by request; a text that very many send is several
    groups of about ``GROUP_REQUESTS`` requests, so no later join by group has
    a hot key.
    """
    lists = asked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_vk", "_k"))).alias("_asked"))
    name = F.md5(F.array_join(F.transform("_asked", lambda a: F.concat_ws(":", a["_vk"], a["_k"].cast("string"))), ","))
    lists = cells_.keep_table(lists.withColumn("_name", name), "asked")
    parts = F.ceil(F.count(F.lit(1)) / F.lit(GROUP_REQUESTS)).cast("int").alias("_parts")
    kinds = cells_.keep_table(lists.groupBy("_name", "_asked").agg(parts), "asked-kinds")

    def group_id(part: Column) -> Column:
        return F.concat_ws("-", "_name", part.cast("string")).alias("group_id")
    groups = lists.select(key, "_name").join(kinds.select("_name", "_parts"), "_name").select(
        key, group_id(F.pmod(F.xxhash64(key), F.col("_parts"))))
    each = kinds.select(F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_name", "_asked").select(group_id(F.col("_part")), F.inline("_asked"))
    found = each.join(hits, "_vk").where(F.col("rank") <= F.col("_k"))
    return groups, found.select("group_id", *[c for c in hits.columns if c != "_vk"])
