"""Operator 12: byte-level BPE encoding and decoding with a pair index.

Texts are cut into pre-tokens; what the merges make of a pre-token depends on
nothing else, so each distinct one of about INDEX_BYTES of texts is merged once. All of them lie
in one array of symbols, and an index lists for every pair that has a rank the
positions where it stands. Active ranks are taken in ascending order: the
listed positions of a rank's pair are merged from left to right, and the pairs
that a merge makes with its neighbours enter the lists of their own ranks.
Positions whose pair has gone meanwhile are passed over when their list comes.

The vocabulary file is read once on the driver and its bytes travel with the
tasks (a file's size, whatever the input). The work is one pass over the
rows; nothing is shuffled, so neither hot sources nor repeated texts matter.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, small_batches, text_slices

#: Pre-tokens kept with their ids between slices of a task; a memo only.
MEMO_WORDS = 200_000
#: Bytes of texts whose new pre-tokens are merged together.
INDEX_BYTES = 8_000_000
#: Tokens that are turned into bytes at a time.
DECODE_TOKENS = 250_000
#: Positions of a pair from which they are merged by array operations.
MANY = 48
#: Characters of a long text that are cut into pre-tokens at a time.
PIECE_CHARS = 2_000_000

#: The byte-level pattern of pre-tokens. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers of Unicode versions after 16.0, first and last code
#: point. The tokenizers library knows Unicode 16.0. Fixed values.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]

#: First byte of the first of them in UTF-8; texts of smaller bytes hold none.
NEWER_BYTE = chr(NEWER[0][0]).encode()[0]

_newer = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]"
_words = regex.compile(PATTERN)
_words_newer = regex.compile("(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{_newer})")
                             .replace(r"\p{L}+", rf"[\p{{L}}--{_newer}]+").replace(r"\p{N}+", rf"[\p{{N}}--{_newer}]+"))
_has_newer = regex.compile(_newer)
#: Between a letter and a space with a letter, no pre-token goes on.
_cut = regex.compile(r"(?<=[a-z])(?= [a-z])")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable ones for themselves, the others in turn from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if (model["type"] != "BPE" or any(model.get(k) for k in plain) or spec.get("normalizer") or spec.get("post_processor")
                or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)
                or (spec.get("decoder") or {}).get("type") != "ByteLevel"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        ids, symbols = model["vocab"], byte_symbols()
        of = {c: b for b, c in enumerate(symbols)}
        self.bytes_to_ids = np.array([ids[c] for c in symbols], np.int64)
        raw = {i: bytes(of[c] for c in token) for token, i in ids.items()}
        self.special: dict[str, int] = {}
        for t in spec.get("added_tokens", []):
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that take in their surroundings are not known")
            self.special[t["content"]] = t["id"]
            raw[t["id"]] = t["content"].encode()
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        n = max(raw) + 1
        self.token_bytes = np.frombuffer(b"".join(raw.get(i, b"") for i in range(n)), np.uint8)
        self.token_size = np.array([len(raw.get(i, b"")) for i in range(n)], np.int64)
        # pairs by number left * n + right, in rank order
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.n = n
        self.left = [ids[a] for a, _ in pairs]
        self.right = [ids[b] for _, b in pairs]
        self.made = [ids[a + b] for a, b in pairs]
        self.rank = {a * n + b: r for r, (a, b) in reversed(list(enumerate(zip(self.left, self.right))))}
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array(list(self.rank.values()), np.int64)[order]


@lru_cache(maxsize=2)
def vocabulary(blob: bytes) -> Vocabulary:
    return Vocabulary(blob)


class PairIndex:
    """Symbols of many words one after the other, and for every pair with a
    rank the positions of its left symbols."""

    def __init__(self, v: Vocabulary, flat: np.ndarray, follows: np.ndarray):
        """``follows``: the next symbol is of the same word."""
        self.v, self.symbol = v, flat
        at = np.arange(len(flat), dtype=np.int64)
        self.after = np.where(follows, at + 1, -1)
        self.before = np.where(np.r_[False, follows[:-1]], at - 1, -1)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.singles: dict[int, list[int]] = {}
        self.active: list[int] = []  # heap of the ranks that have positions
        left = np.flatnonzero(follows)
        self._list(flat[left] * v.n + flat[left + 1], left)

    def _list(self, pairs: np.ndarray, at: np.ndarray) -> None:
        """Enter the positions of the pairs that have a rank."""
        v = self.v
        if not len(pairs) or not len(v.keys):
            return
        spot = np.minimum(np.searchsorted(v.keys, pairs), len(v.keys) - 1)
        known = v.keys[spot] == pairs
        ranks, at = v.key_rank[spot[known]], at[known]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        for r, part in zip(ranks[starts].tolist(), np.split(at, starts[1:])):
            if r not in self.lists and r not in self.singles:
                heapq.heappush(self.active, r)
            self.lists.setdefault(r, []).append(part)

    def _merge_many(self, r: int, at: np.ndarray) -> None:
        """Merge the pair of a rank at all listed positions at once."""
        v, symbol, after, before = self.v, self.symbol, self.after, self.before
        a, b, made = v.left[r], v.right[r], v.made[r]
        at = np.unique(at)
        q = after[at]
        there = (symbol[at] == a) & (q >= 0)
        there[there] = symbol[q[there]] == b  # else this pair has gone
        at, q = at[there], q[there]
        if a == b and len(at):  # of a chain a a a, every other pair from the left
            new = np.r_[True, at[1:] != q[:-1]]
            run = np.flatnonzero(new)[np.cumsum(new) - 1]
            take = (np.arange(len(at)) - run) % 2 == 0
            at, q = at[take], q[take]
        symbol[at], symbol[q] = made, -1
        s = after[q]
        after[at] = s
        before[s[s >= 0]] = at[s >= 0]
        o = before[at]
        right, left = s >= 0, o >= 0
        self._list(np.r_[made * v.n + symbol[s[right]], symbol[o[left]] * v.n + made], np.r_[at[right], o[left]])

    def _merge_few(self, r: int, at: list[int], views: tuple) -> None:
        """The same for a short list, one position after the other."""
        v, (symbol, after, before) = self.v, views
        a, b, made, n, rank = v.left[r], v.right[r], v.made[r], v.n, v.rank
        for p in sorted(at):
            q = after[p]
            if symbol[p] != a or q < 0 or symbol[q] != b:
                continue  # this pair has gone
            symbol[p], symbol[q] = made, -1
            s, o = after[q], before[p]
            after[p] = s
            new = []
            if s >= 0:
                before[s] = p
                new.append((rank.get(made * n + symbol[s]), p))
            if o >= 0:
                new.append((rank.get(symbol[o] * n + made), o))
            for k, place in new:
                if k is not None:
                    if k in self.singles:
                        self.singles[k].append(place)
                    else:
                        self.singles[k] = [place]
                        if k not in self.lists:
                            heapq.heappush(self.active, k)

    def merge(self) -> None:
        """Apply all active ranks in ascending order."""
        views = tuple(map(memoryview, (self.symbol, self.after, self.before)))
        while self.active:
            r = heapq.heappop(self.active)
            lists, few = self.lists.pop(r, []), self.singles.pop(r, [])
            if sum(map(len, lists)) + len(few) >= MANY:
                self._merge_many(r, np.concatenate([*lists, np.array(few, np.int64)]))
            else:
                self._merge_few(r, [*few, *(p for part in lists for p in part.tolist())], views)


def merged(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and the number of each word's ids."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = v.bytes_to_ids[np.frombuffer(b"".join(words), np.uint8)]
    if not len(flat):
        return flat, sizes
    ends = np.cumsum(sizes)
    follows = np.ones(len(flat), bool)
    follows[ends[sizes > 0] - 1] = False
    index = PairIndex(v, flat, follows)
    index.merge()
    alive = index.symbol >= 0
    total = np.r_[0, np.cumsum(alive)]
    return index.symbol[alive], total[ends] - total[ends - sizes]


def _gather(sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items idx of a ragged table one after the other, and their sizes."""
    n = sizes[idx]
    shift = np.repeat(starts[idx] - (np.cumsum(n) - n), n)
    return flat[np.arange(len(shift)) + shift], n


class Encoder:
    """Texts to ids, with the merged pre-tokens of earlier texts as a memo."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.pending: list[str] = []
        self.sizes = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int64)
        self.place.update(zip(self.v.special, range(len(self.v.special))))
        self._add(np.array(list(self.v.special.values()), np.int64), np.ones(len(self.v.special), np.int64))

    def _add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.sizes, self.flat = np.r_[self.sizes, sizes], np.r_[self.flat, flat]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _pieces(self, raw: bytes) -> Iterator[list[str]]:
        """Lists of pre-tokens and special tokens of a text, in order."""
        text = raw.decode("utf-8", "replace")
        newer = bool((np.frombuffer(raw, np.uint8) >= NEWER_BYTE).any())
        parts = self.v.split.split(text) if self.v.split and any(s in text for s in self.v.special) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield [part]
                continue
            words = _words_newer if newer and _has_newer.search(part) else _words
            at = 0
            while at < len(part):
                cut = _cut.search(part, at + PIECE_CHARS) if len(part) - at > PIECE_CHARS else None
                end = cut.start() if cut else len(part)
                yield words.findall(part[at:end] if at or cut else part)
                at = end

    def take(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' pre-tokens, and of each one's text. New
        pre-tokens wait for ``settle``."""
        idx, of = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for i, text in enumerate(texts):
            for words in self._pieces(text or b""):
                for w in set(words).difference(self.place):
                    self.place[w] = len(self.place)
                    self.pending.append(w)
                idx.append(np.fromiter(map(self.place.__getitem__, words), np.int32, len(words)))
                of.append(np.full(len(words), i, np.int32))
        return np.concatenate(idx), np.concatenate(of)

    def settle(self) -> None:
        """Merge the new pre-tokens, all at once."""
        self._add(*merged(self.v, [w.encode() for w in self.pending]))
        self.pending = []

    def ids(self, idx: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, and the number of each text's."""
        flat, n = _gather(self.sizes, self.starts, self.flat, idx)
        return flat, np.bincount(of, n, texts).astype(np.int64)


def decoded(v: Vocabulary, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of the tokens one after the other, and each token's number of
    bytes. Ids that the vocabulary has not got have none."""
    starts = np.cumsum(v.token_size) - v.token_size
    known = (ids >= 0) & (ids < v.n)
    size = np.where(known, v.token_size[np.where(known, ids, 0)], 0)
    ids = ids[known]
    parts = [_gather(v.token_size, starts, v.token_bytes, ids[i:i + DECODE_TOKENS])[0].tobytes() for i in range(0, len(ids), DECODE_TOKENS)]
    return b"".join(parts), size


# -- the operator ---------------------------------------------------------------------


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _carried(df: DataFrame, drop: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != drop]


def encode(df: DataFrame, vocab: bytes, text_col: str = "text", out_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Adds ``out_col``, the ids (array of int) of each whole text.

    ``vocab`` is a vocabulary file's content; ``carry`` names the columns to
    keep (all). As the tokenizers library encodes without truncation, padding
    and added special tokens: a special token's string inside a text is that
    token. Defined results: a NULL or empty text has an empty array; a column
    of the name ``out_col`` is replaced; all rows stay, repeated ones too.
    """
    spark = df.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(vocab)  # one vocabulary file
    fields = [f for f in _carried(df, out_col) if carry is None or f.name in carry]
    schema = T.StructType([*fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, waiting, size = Encoder(vocabulary(sent.value)), [], 0

        def done() -> Iterator[pa.RecordBatch]:
            enc.settle()
            for part, idx, of in waiting:
                ids, n = enc.ids(idx, of, part.num_rows)
                offsets = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [*names, out_col])
            waiting.clear()
            if len(enc.place) > MEMO_WORDS:
                enc.forget()

        for part, texts in text_slices(batches, "_text"):
            waiting.append((part, *enc.take(texts)))
            size += sum(len(t or b"") for t in texts)
            if size >= INDEX_BYTES:
                yield from done()
                size = 0
        yield from done()

    return df.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)], F.col(text_col).alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, vocab: bytes, ids_col: str = "ids", out_col: str = "decoded", carry: list[str] | None = None) -> DataFrame:
    """Adds ``out_col``, the text of each array of ids, special tokens written
    out. Defined results: NULL and empty arrays give an empty text; NULL and
    unknown ids give nothing; bytes that are no UTF-8 become U+FFFD; a column
    of the name ``out_col`` is replaced; all rows stay."""
    spark = df.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(vocab)  # one vocabulary file
    fields = [f for f in _carried(df, out_col) if carry is None or f.name in carry]
    schema = T.StructType([*fields, T.StructField(out_col, T.StringType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(sent.value)
        for batch in batches:
            lists = batch.column("_ids")
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            n = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, size = decoded(v, flat)
            ends = np.r_[0, np.cumsum(size)][np.cumsum(n)]
            start, texts = 0, []
            for e in ends.tolist():
                texts.append(data[start:e].decode("utf-8", "replace"))
                start = e
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*names, out_col])

    return df.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)], F.col(ids_col).cast("array<int>").alias("_ids")).mapInArrow(run, schema)


def default_vocabulary() -> bytes:
    import public_tokenizers
    return read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = default_vocabulary()
    ids = encode(read(spark, sf_dir, "documents", "doc_id", "text"), vocab, carry=["doc_id"])
    both = decode(ids, vocab)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
