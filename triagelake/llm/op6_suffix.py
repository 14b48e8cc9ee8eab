"""Suffix-array dedup: bytes covered by a 200-byte string that starts twice.

1. Anchors. A window (200-byte string) is named by the smallest hash among
   the short grams inside it, so equal windows have equal names. Consecutive
   windows of one name are a run; a name that only one run has can't repeat.
2. Blocks. A repeated run's bytes (its window starts and 199 bytes more) are
   a block. Blocks go to tasks by name; equal blocks are sorted once.
3. Difference cover. A task sorts the suffixes of its blocks: triples at
   positions not divisible by 3 are sorted and named, the names are sorted
   recursively (until names cover a window), the other suffixes are sorted by
   (byte, rank of the next) and merged in.
4. Adjacent prefixes. Two neighbours of the order that agree in 200 bytes are
   repeated windows, and so are the windows of a block that occurs twice (if
   it is its name's only one, nothing is left to sort).

No window's decision needs more than the blocks of its own name, so steps 2
to 4 run in independent tasks. A name with very many runs (a passage that a
third of all documents hold) is no bucket of its own: its blocks are cut into
parts of a few windows, equal parts are counted once, and the windows of the
distinct parts are compared as keys of an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, read, small_batches, text_slices
from .shingles import BASE, mix

MATCH = 200
GRAM = 96
#: Window starts of one run at most.
RUN = 128
#: Names with more runs than this are hot: parts of STRIDE starts (at most 8).
HOT_RUNS = 1024
STRIDE = 8
#: Bytes sorted together; a name's blocks are never cut apart.
SORT_BYTES = 1 << 20
#: Distinct blocks a task collects before it passes them on.
BLOCKS_HELD = 20_000


# ---- step 1: anchors ---------------------------------------------------------

LETTERS = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


def gram_hashes(a: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes: a polynomial modulo 2**64, by doubling."""
    power = lambda n: np.uint64(pow(BASE, n, 1 << 64))
    h, n, have = LETTERS[a], 1, {}
    while n <= size:
        if size & n:
            have[n] = h
        if 2 * n <= size:
            h = h[:-n] * power(n) + h[n:]
        n *= 2
    count = len(a) - size + 1
    out, at = np.zeros(count, np.uint64), 0
    for n in sorted(have):
        out = out * power(n) + have[n][at:at + count]
        at += n
    return mix(out)


def window_min(v: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every ``size`` consecutive values."""
    n = 1
    while 2 * n <= size:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    rest = size - n
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def runs_of(text: bytes, match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first start, length, weight) of the runs of a text. Weight 2: the
    name's gram is twice in the run, so it may repeat within itself."""
    if len(text) < match:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    a = np.frombuffer(text, np.uint8)
    g = gram_hashes(a, gram)
    width = match - gram + 1
    name = window_min(g, width)
    first = np.concatenate(([0], np.flatnonzero(name[1:] != name[:-1]) + 1))
    length = np.diff(np.append(first, len(name)))
    if length.max() > RUN:
        pieces = -(-length // RUN)
        base = np.repeat(first, pieces)
        nth = np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        stop = np.repeat(first + length, pieces)
        first = base + nth * RUN
        length = np.minimum(stop - first, RUN)
    h = name[first]
    # positions of grams that name some run, by a small table first
    flag = np.zeros(1 << 16, bool)
    flag[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(flag[(g & np.uint64(0xFFFF)).astype(np.int64)])
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, first + length + width - 1)
    who = np.repeat(np.arange(len(first)), hi - lo)
    pos = at[np.arange(len(who)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    times = np.bincount(who[g[pos] == h[who]], minlength=len(first))
    return h, first, length, np.minimum(times, 2)


def _anchors(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "_text"):
            names, place, weight, rows = [], [], [], []
            for i, t in enumerate(texts):
                h, first, length, w = runs_of(t or b"", match)
                names.append(h.view(np.int64))
                place.append(first * 256 + length)
                weight.append(w)
                rows.append(len(h))
            row = pa.array(np.repeat(np.arange(len(texts)), rows))
            yield pa.record_batch([pa.array(np.concatenate(names)), batch.column("_id").take(row), batch.column("_th").take(row),
                                   pa.array(np.concatenate(place)), pa.array(np.concatenate(weight).astype(np.int32))],
                                  ["name", "_id", "_th", "place", "weight"])

    return run


# ---- step 2: blocks ----------------------------------------------------------

def split_hot(block: bytes, length: int, name: int, match: int, gram: int) -> list[tuple[int, int]]:
    """(first start, starts) of the parts of a hot name's block: starts at the
    same distance (in STRIDEs) before the first gram of that name in their
    window. The distance is part of the window, so equal windows agree in it."""
    g = gram_hashes(np.frombuffer(block, np.uint8), gram)
    at = np.flatnonzero(g == np.uint64(name & 0xFFFFFFFFFFFFFFFF))
    starts = np.arange(length)
    where = at[np.searchsorted(at, starts)]
    group = where * (match // STRIDE + 1) + (where - starts) // STRIDE
    cut = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [length]))
    return [(int(x), int(y - x)) for x, y in zip(cut[:-1], cut[1:])]


def blocks_of(text: bytes, runs: list[dict], match: int, gram: int = GRAM) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, first start, starts, block) of the repeated runs (place, name, hot)."""
    for r in runs:
        lo, length, name = r["place"] >> 8, r["place"] & 255, r["name"]
        block = text[lo:lo + length + match - 1]
        parts = split_hot(block, length, name, match, gram) if r["hot"] else [(0, length)]
        for x, n in parts:
            yield name, lo + x, n, block[x:x + n + match - 1]


def digest(block: bytes) -> int:
    return xxhash.xxh3_64_intdigest(block) - (1 << 63)


def _occurrences(match: int):
    """Where every block is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "_text"):
            out, rows = [], []
            for i, (t, runs) in enumerate(zip(texts, batch.column("runs").to_pylist())):
                for bucket, lo, n, block in blocks_of(t, runs, match):
                    out.append((bucket, digest(block), lo * 256 + n))
                    rows.append(i)
            row = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column("_id").take(row), batch.column("_th").take(row),
                                   *[pa.array([x[k] for x in out], pa.int64()) for k in range(3)]],
                                  ["_id", "_th", "bucket", "digest", "place"])

    return run


def _blocks(match: int):
    """Distinct blocks of a task with their number of occurrences there."""

    def flush(held: dict) -> pa.RecordBatch:
        keys = list(held)
        return pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                                pa.array([held[k][0] for k in keys], pa.int32()), pa.array([held[k][1] for k in keys], pa.binary()),
                                pa.array([held[k][2] for k in keys], pa.int64())], ["bucket", "digest", "starts", "block", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch, texts in text_slices(batches, "_text"):
            for t, runs in zip(texts, batch.column("runs").to_pylist()):
                for bucket, _, n, block in blocks_of(t, runs, match):
                    held.setdefault((bucket, digest(block)), [n, block, 0])[2] += 1
            if len(held) > BLOCKS_HELD:
                yield flush(held)
                held = {}
        yield flush(held)

    return run


# ---- step 3: difference cover ------------------------------------------------

def suffix_ranks(s: np.ndarray, top: int, depth: int, covered: int = 1) -> np.ndarray:
    """Dense ranks of all suffixes of ``s`` (numbers from 1 to ``top``; at most
    2**21 of them), compared in at least ``depth`` characters of the text: a
    number of ``s`` stands for ``covered`` of them. Suffixes that agree so far
    may share a rank."""
    n = len(s)
    t = np.concatenate((s, np.zeros(4, np.int64)))
    one, two, zero = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3), np.arange(0, n, 3)
    sample = np.concatenate((one, two))
    base = np.int64(top + 1)
    pair = t[sample] * base + t[sample + 1]
    if top >= 1 << 21:  # three numbers don't fit in 63 bits
        pair = named(pair)
    names = named(pair * base + t[sample + 2])
    most = int(names.max())
    if most < len(sample) and 3 * covered < depth:
        names = suffix_ranks(names, most, depth, 3 * covered)
        most = int(names.max())
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    # the other suffixes by (number, rank of the next), (two numbers, rank of the one after)
    far = np.int64(most + 1)
    both = t[zero] * base + t[zero + 1], t[two] * base + t[two + 1]
    if max(top, most) >= 1 << 21:
        joint = named(np.concatenate(both))
        both = joint[:len(zero)], joint[len(zero):]
    zero1, one0 = merged_places(t[zero] * far + rank[zero + 1], t[one] * far + rank[one + 1])
    zero2, two0 = merged_places(both[0] * far + rank[zero + 2], both[1] * far + rank[two + 2])
    ordered = np.cumsum(np.bincount(names, minlength=most + 1))  # samples up to each name
    place = np.zeros(n + 2, np.int64)  # number of smaller suffixes
    place[zero] = zero1[0] + zero1[1] + zero2[1]
    place[sample] = ordered[names - 1] + np.concatenate((one0[1], two0[1]))
    place = place[:n]
    taken = np.zeros(n + 1, np.int64)
    taken[place] = 1
    return np.cumsum(taken)[place]


def merged_places(a: np.ndarray, b: np.ndarray) -> tuple[tuple, tuple]:
    """For every key of a and of b: (smaller keys on its own side, on the other)."""
    keys = np.concatenate((a, b))
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(keys) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    of_a = np.concatenate(([0], np.cumsum(order < len(a))))[start]
    less_a, less = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    less_a[order], less[order] = of_a, start
    less_b = less - less_a
    m = len(a)
    return (less_a[:m], less_b[:m]), (less_b[m:], less_a[m:])


def named(keys: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of numbers."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate(([1], (ordered[1:] != ordered[:-1]).astype(np.int64))))
    return out


def repeated_starts(blocks: list[bytes], starts: list[int], match: int) -> list[np.ndarray]:
    """Per block a flag for each of its window starts: another start of these
    blocks has the same window. Steps 3 and 4."""
    size = np.array([len(b) + 1 for b in blocks])
    first = np.cumsum(size) - size
    data = np.frombuffer(b"\0".join(blocks) + b"\0", np.uint8)
    s = data.astype(np.int64) + 2
    s[first + size - 1] = 1  # block ends
    rank = suffix_ranks(s, 257, match)
    own = np.repeat(first, starts) + np.arange(sum(starts)) - np.repeat(np.cumsum(starts) - starts, starts)
    order = own[np.argsort(rank[own])]
    # words of 8 bytes from every position: adjacent prefixes, compared directly
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(len(data), np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j:j + len(data)]
    left, right = order[:-1], order[1:]
    alive = np.arange(len(left))
    for off in [*range(0, match - 7, 8), match - 8]:
        alive = alive[word[left[alive] + off] == word[right[alive] + off]]
    flag = np.zeros(len(data), bool)
    flag[left[alive]] = True
    flag[right[alive]] = True
    return [flag[f:f + n] for f, n in zip(first, starts)]


def _sort_blocks(match: int):
    """Blocks in the order of (bucket, digest) -> (bucket, digest, flags) of
    those with repeated windows; flags are bits, one per start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # of whole buckets: digest, starts, block, times, bucket
        now: list[list] = []  # of the current bucket
        size = 0

        def close() -> int:
            """A bucket is complete. One block that occurs twice needs no sorting."""
            if len(now) == 1 and now[0][3] > 1:
                settled.append((now[0][4], now[0][0], np.ones(now[0][1], bool)))
                return 0
            held.extend(now)
            return sum(len(x[2]) + 1 for x in now)

        def decide() -> pa.RecordBatch:
            flags = repeated_starts([x[2] for x in held], [x[1] for x in held], match) if held else []
            out = [(x[4], x[0], np.ones(x[1], bool) if x[3] > 1 else f) for x, f in zip(held, flags)] + settled
            out = [(a, b, np.packbits(f).tobytes()) for a, b, f in out if f.any()]
            return pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                                    pa.array([x[2] for x in out], pa.binary())], ["bucket", "digest", "flags"])

        settled: list[tuple] = []
        for batch in batches:
            for bucket, *row in zip(*[batch.column(c).to_pylist() for c in ("bucket", "digest", "starts", "block", "times")]):
                if now and now[0][4] != bucket:
                    size += close()
                    now = []
                    if size > SORT_BYTES or len(settled) > BLOCKS_HELD:
                        yield decide()
                        held, settled, size = [], [], 0
                if now and now[-1][0] == row[0]:
                    now[-1][3] += row[3]
                else:
                    now.append([*row, bucket])
        if now:
            close()
        yield decide()

    return run


def _hot_flags(parts: DataFrame, match: int) -> DataFrame:
    """``_sort_blocks`` for the parts of hot names: a bucket of its own for
    every window. Aggregates only, so no name gathers in a task."""
    parts = keep(parts.groupBy("bucket", "digest").agg(
        F.max("starts").alias("starts"), F.max("block").alias("block"), F.sum("times").alias("times")), "suffix-parts")
    window = F.expr(f"substring(block, i + 1, {match})")
    windows = (parts.withColumn("i", F.explode(F.expr("sequence(0, starts - 1)")))
               .select("bucket", "digest", "i", "times", F.xxhash64("bucket", window).alias("w1"), F.xxhash64(window, F.lit(1)).alias("w2")))
    twice = windows.groupBy("w1", "w2").agg(F.sum("times").alias("n")).where("n > 1").select("w1", "w2")
    found = windows.join(keep(twice, "suffix-windows"), ["w1", "w2"]).groupBy("bucket", "digest").agg(
        F.sum(F.expr("shiftleft(1, 7 - i)")).alias("bits"))
    return found.select("bucket", "digest", F.unhex(F.lpad(F.hex("bits"), 2, "0")).alias("flags"))


# ---- result ------------------------------------------------------------------

def spans_of(pieces: list[tuple[int, bytes]], match: int) -> list[int]:
    """Merged byte spans (start, end, ...) covered by the flagged windows."""
    hits = [(p >> 8) + np.flatnonzero(np.unpackbits(np.frombuffer(f, np.uint8))[:p & 255]) for p, f in pieces]
    if not hits:
        return []
    s = np.unique(np.concatenate(hits))
    if not len(s):
        return []
    gap = np.flatnonzero(s[1:] > s[:-1] + match)
    first, last = np.concatenate(([s[0]], s[gap + 1])), np.concatenate((s[gap], [s[-1]])) + match
    return [int(x) for pair in zip(first, last) for x in pair]


def _cut(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "_text"):
            spans, kept = [], []
            for t, pieces in zip(texts, batch.column("pieces").to_pylist()):
                cut = spans_of([(p["place"], p["flags"]) for p in pieces], match)
                spans.append(cut)
                edges = [0, *cut, len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.record_batch([batch.column("_id"), batch.column("_th"), pa.array(spans, pa.list_(pa.int64())),
                                   pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())],
                                  ["_id", "_th", "spans", "kept", "kept_text"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_th`` (a 64-bit hash that tells rows with one id apart), ``_text``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))


def repeated_spans(docs: DataFrame, match: int = MATCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold a repeated string of ``match`` bytes: ``_id``,
    ``_th`` (see ``keyed``), ``spans`` (byte offsets start, end, ... of
    maximal covered runs), ``kept`` (the other bytes) and ``kept_text`` (the
    whole characters among them). Repeated rows give repeated results.
    Documents not listed have no repeated string.

    NULL texts are empty. Rows are documents of their own, so repeated rows
    repeat each other's strings. NULL ids are ids like any other.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    anchors = keep(rows.mapInArrow(_anchors(match), f"name long, _id {kind}, _th long, place long, weight int"), "suffix-anchors")
    often = (anchors.groupBy("name").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("c")).where("w > 1")
             .select(F.col("name").alias("_name"), (F.col("c") > HOT_RUNS).alias("hot")))
    often = keep(often, "suffix-names")
    runs = (anchors.join(often, F.col("name") == F.col("_name")).groupBy("_id", "_th")
            .agg(F.collect_set(F.struct("place", "name", "hot")).alias("runs")))
    runs = runs.select(F.col("_id").alias("_rid"), F.col("_th").alias("_rth"), "runs")
    texts = keep(rows.join(runs, rows["_id"].eqNullSafe(runs["_rid"]) & (rows["_th"] == runs["_rth"])).drop("_rid", "_rth"), "suffix-texts")

    shape = "bucket long, digest long, starts int, block binary, times long"
    cold = texts.select("_text", F.filter("runs", lambda r: ~r["hot"]).alias("runs")).where("size(runs) > 0")
    flags = (cold.mapInArrow(_blocks(match), shape).repartition("bucket").sortWithinPartitions("bucket", "digest")
             .mapInArrow(_sort_blocks(match), "bucket long, digest long, flags binary"))
    hot = texts.select("_text", F.filter("runs", lambda r: r["hot"]).alias("runs")).where("size(runs) > 0")
    flags = keep(flags.unionByName(_hot_flags(hot.mapInArrow(_blocks(match), shape), match)), "suffix-flags")
    places = texts.mapInArrow(_occurrences(match), f"_id {kind}, _th long, bucket long, digest long, place long")
    pieces = (places.join(flags, ["bucket", "digest"]).groupBy("_id", "_th")
              .agg(F.collect_set(F.struct("place", "flags")).alias("pieces")))
    pieces = pieces.select(F.col("_id").alias("_pid"), F.col("_th").alias("_pth"), "pieces")
    hit = texts.drop("runs").join(pieces, texts["_id"].eqNullSafe(pieces["_pid"]) & (texts["_th"] == pieces["_pth"])).drop("_pid", "_pth")
    return hit.mapInArrow(_cut(match), f"_id {kind}, _th long, spans array<long>, kept binary, kept_text string")


def without_repeats(docs: DataFrame, match: int = MATCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut from their texts, all columns;
    no row is dropped. A column ``n_chars`` is the new text's length."""
    found = keep(repeated_spans(docs, match, id_col, text_col).dropDuplicates(["_id", "_th"])
                 .select(F.col("_id").alias("_fid"), F.col("_th").alias("_fth"), F.col("kept_text").alias("_kept_text")), "suffix-kept")
    rows = docs.withColumn("_th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = rows.join(found, rows[id_col].eqNullSafe(found["_fid"]) & (rows["_th"] == found["_fth"]), "left")
    new = found["_kept_text"]  # by reference: docs may have a column of any name
    cols = {text_col: F.coalesce(new, rows[text_col])}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(new.isNull(), rows["n_chars"]).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[cols.get(c, rows[c]).alias(c) for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    cut = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2 - 1).cast("int")),
                      lambda i: F.element_at("spans", 2 * i + 2) - F.element_at("spans", 2 * i + 1))
    found = repeated_spans(docs).select(
        F.col("_id").alias("_fid"), F.col("_th").alias("_fth"), F.aggregate(cut, F.lit(0).cast("long"), lambda a, x: a + x).alias("removed"),
        (F.size("spans") / 2).cast("long").alias("spans"), F.sha2("kept", 256).alias("sha"))
    found = keep(found.dropDuplicates(["_fid", "_fth"]), "suffix-found")
    rows = keyed(docs, "doc_id", "text").select("_id", "_th", F.octet_length("_text").cast("long").alias("n_bytes"),
                                                F.sha2(F.col("_text").cast("binary"), 256).alias("whole"))
    return (rows.join(found, rows["_id"].eqNullSafe(found["_fid"]) & (rows["_th"] == found["_fth"]), "left")
            .select(F.col("_id").alias("doc_id"), "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256")))
