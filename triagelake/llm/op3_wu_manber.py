"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the 13-word windows of the benchmark items (a shorter item
is one string). Words become the numbers of a vocabulary of the benchmark's
words, 0 for any other word. Per string length, a shift table over blocks of
two words tells how far a search position can jump; where it cannot jump, the
bucket of strings with the same last block is compared word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, read, small_batches, text_slices

WINDOW = 13
#: Contaminated: hit words * SHARE >= words.
SHARE = 20
#: A search pass holds test strings of at most about this many bytes of item text.
PASS_BYTES = 32_000_000
#: Words of a text that one lane of the search scans.
LANE = 256
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: runs of digits, letters a-z and
    characters beyond ASCII (whose UTF-8 bytes are all above 0x7F)."""
    return WORDS.findall(text.lower()) if text else []


class WuManber:
    """Shift and bucket tables for strings of one length (in words): string i
    is ``words[at[i]:at[i] + length]``."""

    def __init__(self, words: np.ndarray, at: np.ndarray, length: int) -> None:
        self.words, self.at, self.length = words, at, length
        count = len(at)
        self.block = min(2, length)
        starts = length - self.block + 1
        # slots enough for all blocks, or for four a string: a fuller table only jumps less
        bits = max(10, min(int(4 * count * starts).bit_length(), max(20, int(4 * count).bit_length())))
        self.mask = np.int64((1 << bits) - 1)
        self.shift = np.full(1 << bits, starts, np.uint8)
        for j in range(starts):  # an earlier block allows the longer jump, so the smallest stays
            self.shift[self._hash(words[at + j + self.block - 1], words[at + j])] = starts - 1 - j
        last = self._hash(words[at + length - 1], words[at + length - self.block])
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(last, minlength=1 << bits), out=self.first[1:])

    def _hash(self, end: np.ndarray, begin: np.ndarray) -> np.ndarray:
        h = end.astype(np.int64) * 0x9E3779B1 + begin.astype(np.int64) * 0x85EBCA6B
        return (h ^ (h >> 15)) & self.mask

    @property
    def nbytes(self) -> int:
        return self.shift.nbytes + self.order.nbytes + self.first.nbytes + self.at.nbytes

    def search(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, string) of every occurrence whose last word lies in one of
        the lanes [begin, end) of ``ids``. All lanes step together, each by
        its own shift."""
        at, found = [], []
        pos, stop = begin.copy(), end
        while True:
            live = pos < stop
            if not live.any():
                break
            pos, stop = pos[live], stop[live]
            h = self._hash(ids[pos], ids[pos - self.block + 1])
            jump = self.shift[h]
            cand, ch = pos[jump == 0], h[jump == 0]
            if len(cand):
                n = self.first[ch + 1] - self.first[ch]
                who = np.repeat(np.arange(len(cand)), n)
                nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                string = self.order[self.first[ch][who] + nth]
                start = cand[who] - self.length + 1
                for j in range(self.length):  # direct comparison, first words first
                    same = ids[start + j] == self.words[self.at[string] + j]
                    start, string = start[same], string[same]
                at.append(start)
                found.append(string)
            pos = pos + np.maximum(jump, 1)
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(at), np.concatenate(found)


def distinct_windows(words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows at ``at``, the distinct ones' starts, and the number of
    each window's. Windows are brought together by a 64-bit hash and compared
    with the first of their hash; one that differs there stays a string of its
    own, which costs a comparison and loses nothing."""
    h = np.zeros(len(at), np.uint64)
    for j in range(length):
        h = (h ^ words[at + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    lead = at[order][np.flatnonzero(new)][np.cumsum(new) - 1]  # the first window of each one's hash
    mine = at[order]
    for j in range(length):
        new |= words[mine + j] != words[lead + j]
    # a differing window begins a string; those after it that equal the first are found again below it
    number = np.cumsum(new) - 1
    of = np.empty(len(at), np.int64)
    of[order] = number
    return mine[new], of


class Matcher:
    """All test strings of some benchmark items, as arrays: the items' words
    by number, the strings' starts, and each string's items by offsets."""

    def __init__(self, items: Iterable[tuple[str | None, bytes | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        vocabulary, parts, sizes = self.vocabulary, [], []
        for item, text in items:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                parts.append(ids)
                sizes.append(len(ids))
                self.names.append(item)
        sizes = np.array(sizes, np.int64)
        words = np.concatenate(parts) if parts else np.empty(0, np.int32)
        first = np.cumsum(sizes) - sizes
        count = np.maximum(1, sizes - window + 1)  # strings of each item
        self.tables: list[tuple[WuManber, np.ndarray, np.ndarray]] = []
        for length in np.unique(np.minimum(sizes, window)).tolist():
            some = np.flatnonzero(np.minimum(sizes, window) == length)
            n = count[some]
            owner = np.repeat(some, n)
            at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            at, of = distinct_windows(words, at.astype(np.int32), length)
            order = np.argsort(of, kind="stable")
            begins = np.searchsorted(of[order], np.arange(len(at) + 1))
            self.tables.append((WuManber(words, at, length), owner[order].astype(np.int32), begins.astype(np.int32)))
        self.words = words

    @property
    def nbytes(self) -> int:
        """Bytes of the arrays."""
        return self.words.nbytes + sum(t.nbytes + o.nbytes + b.nbytes for t, o, b in self.tables)

    def scan(self, texts: list[bytes | None]) -> Iterator[tuple[int, list[int], list[str]]]:
        """Per text: number of words, hit spans (start, end, start, end, ...;
        merged, in order) and the items found."""
        get = self.vocabulary.get
        docs = [[get(w, 0) for w in words_of(t)] for t in texts]
        sizes = np.array([len(d) for d in docs], np.int64)
        ids = np.fromiter((w for d in docs for w in d), np.int64, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        doc_at = np.repeat(np.arange(len(docs)), sizes)
        spans, items = [[] for _ in docs], [set() for _ in docs]
        for table, owners, begins in self.tables:
            n = np.maximum(0, sizes - table.length + 1)  # last words of strings in a document
            lanes = -(-n // LANE)
            doc = np.repeat(np.arange(len(docs)), lanes)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            begin = first[doc] + table.length - 1 + nth * LANE
            start, string = table.search(ids, begin, np.minimum(begin + LANE, (first + sizes)[doc]))
            for s, k in zip(start.tolist(), string.tolist()):
                d = int(doc_at[s])
                spans[d].append((s - int(first[d]), s - int(first[d]) + table.length))
                items[d].update(owners[begins[k]:begins[k + 1]].tolist())
        for d in range(len(docs)):
            found = {self.names[i] for i in items[d]} - {None}
            yield int(sizes[d]), merged(spans[d]), sorted(found)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scan_with(items, id_col: str, text_col: str):
    """mapInArrow function: scans with the strings of the broadcast ``items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch, texts in text_slices(batches, text_col):
            matcher = matcher or Matcher(items.value)
            got = list(matcher.scan(texts))
            yield pa.record_batch([
                batch.column(id_col), batch.column("_th"),
                pa.array([x[0] for x in got], pa.int64()),
                pa.array([x[1] for x in got], pa.list_(pa.int64())),
                pa.array([x[2] for x in got], pa.list_(pa.string()))], ["_id", "_th", "n_words", "spans", "items"])

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merged(list(zip(x[::2], x[1::2]))) for x in batch.column("spans").to_pylist()]
        items = [sorted(set(x)) for x in batch.column("items").to_pylist()]
        words = batch.column("n_words").to_pylist()
        hits = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        yield pa.record_batch([
            batch.column("_id"), batch.column("_th"), pa.array(words, pa.int64()), pa.array(hits, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
            pa.array([h > 0 and SHARE * h >= n for h, n in zip(hits, words)], pa.bool_()),
            pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))],
            ["_id", "text_hash", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "hit_spans"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit`` (words inside an
    occurrence of a test string), ``n_items``, ``items_sha256``,
    ``contaminated``, ``item_ids`` (sorted as strings), ``hit_spans`` (word
    offsets start, end, ...) and ``text_hash`` (xxhash64 of the text).

    NULL and empty texts have no words; NULL or wordless items have no
    strings; the strings of an item without an id are searched and hit words,
    but it is not counted as an item. Items with equal ids are one item.
    Repeated rows give repeated results; an empty benchmark hits nothing.

    The benchmark is sent to every executor in passes of at most PASS_BYTES
    of item text (measured first; its tables in a worker have about twelve
    times as many bytes); a pass' result is written and what was sent is
    released before the next one. With more than one pass, results are merged
    by the row's id and text hash, repeated rows counted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-held // PASS_BYTES))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    shape = f"_id {id_type}, _th long, n_words long, spans array<long>, items array<string>"
    found = None
    for p in range(passes):
        part = items.where(F.expr(f"pmod(xxhash64(text), {passes}) = {p}")).collect() if passes > 1 else items.collect()
        sent = spark.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in part])
        scan = rows.mapInArrow(_scan_with(sent, "_id", "_text"), shape)
        if passes == 1:
            found = scan
            break
        scan = keep(scan.withColumn("pass", F.lit(p)), "windows-pass")
        sent.unpersist()
        found = scan if found is None else found.unionByName(scan)
    if passes > 1:
        # equal rows have equal results of a pass: one of them stays, and their number
        each = found.groupBy("_id", "_th", "pass").agg(F.max("n_words").alias("n_words"), F.max("spans").alias("spans"),
                                                      F.max("items").alias("items"), F.count(F.lit(1)).alias("copies"))
        found = each.groupBy("_id", "_th").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                               F.flatten(F.collect_list("items")).alias("items"), F.max("copies").cast("int").alias("copies"))
        found = found.select("*", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "col")
    out = found.mapInArrow(_judge, f"_id {id_type}, text_hash long, n_words long, n_hit long, n_items long, items_sha256 string, "
                                   "contaminated boolean, item_ids array<string>, hit_spans array<long>")
    return out.withColumnRenamed("_id", id_col)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns."""
    bad = keep(decontaminate(docs, benchmark, id_col, text_col).where("contaminated")
               .select(F.col(id_col).alias("_bid"), F.col("text_hash").alias("_bth")).distinct(), "contaminated")
    rows = docs.withColumn("_th", F.xxhash64(text_col))
    return rows.join(bad, rows[id_col].eqNullSafe(bad["_bid"]) & (rows["_th"] == bad["_bth"]), "left_anti").drop("_th")


def op3_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: DuckDB: every window of every document joined with the benchmark's windows.
OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
p AS (SELECT DISTINCT item, list_slice(w, s, s + least(13, len(w)) - 1) AS v
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(v) AS n FROM p),
k AS (SELECT r, n, s, list_slice(w, s, s + n - 1) AS v
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
h AS (SELECT k.r, k.s, k.n, p.item FROM k JOIN p ON k.v = p.v),
hw AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS i FROM (SELECT DISTINCT r, s, n FROM h)) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
