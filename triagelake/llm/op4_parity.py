"""N-gram Jaccard join by parity sketches.

A document is the set of its hashed word shingles. Two linked sets of similar
size differ in at most d shingles. Per size band, shingles are dealt into
k > d blocks by their hash, and a block's parity is the XOR of its shingles:
at most d blocks of linked sets differ, so they agree in one of the others,
and joining on (band, block, parity) misses no link. Longer bit sketches (one
parity bit per hash slot) then reject pairs: every differing shingle flips
one bit, so their Hamming distance is a lower bound of the difference. What
is left is verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, joined, keep, maybe_in, read, small_batches, text_slices
from .shingles import WordHasher, mix, shingle_sets

#: Rows of one key that are compared in one piece; larger groups are compared
#: block by block in different tasks.
GROUP_BLOCK = 2048
#: Smallest sets of its keys that a set is compared with first, and nearest
#: sets that it is compared with next.
STARS = 2
NEAREST = 2


class Bands:
    """Size bands and block counts for similarity >= num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.first = [1]  # smallest size of each band; linked sizes lie in one band or in neighbours

    def band(self, size: int) -> int:
        while self.first[-1] <= size:
            self.first.append(self.first[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.first, size, "right")) - 1

    def differ(self, total: int) -> int:
        """Most shingles in which two linked sets of ``total`` size differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def blocks(self, band: int) -> tuple[int, int]:
        """(blocks, spare) of pairs whose larger set is in ``band``. Linked
        sets agree in 1 + spare blocks at least, so a set with at most
        ``spare`` empty blocks need not name its empty ones."""
        while len(self.first) <= band + 1:
            self.band(self.first[-1])
        d = self.differ(2 * (self.first[band + 1] - 1))
        if d == 0:
            return 0, 0  # only equal sets are linked: they are one class anyway
        spare = 1 + -(-(d + 1) // 10)
        return d + 1 + spare, spare


def parities(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, XOR of its hashes) of every block that is not empty."""
    block = ((mix(hashes) >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    order = np.argsort(block, kind="stable")
    block = block[order]
    start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    return block[start], np.bitwise_xor.reduceat(hashes[order], start)


def join_keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a set, as the larger (own band) or smaller (next band) of a pair."""
    keys = []
    own = bands.band(len(hashes))
    for band in (own, own + 1):
        k, spare = bands.blocks(band)
        if not k:
            continue
        block, parity = parities(hashes, k)
        place = block + np.uint64(band << 32)
        keys.append(mix(mix(place) ^ parity))
        if k - len(block) > spare:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), block)
            keys.append(mix(mix(empty + np.uint64(band << 32)) ^ np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def bit_sketch(hashes: np.ndarray) -> bytes:
    """Parity bits of the hashes over 2 to 4 slots per shingle."""
    bits = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch over fewer slots: slots that fall together are XORed."""
    return sketch if len(sketch) == size else np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def may_link(bands: Bands, na: int, sa: np.ndarray, nb: int, sb: np.ndarray) -> bool:
    if bands.den * min(na, nb) < bands.num * max(na, nb):
        return False
    size = min(len(sa), len(sb))
    return int(np.bitwise_count(folded(sa, size) ^ folded(sb, size)).sum()) <= bands.differ(na + nb)


def set_digest(hashes: np.ndarray) -> int:
    """64-bit name of a set of hashes."""
    h = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    both = np.array([h.sum(dtype=np.uint64), np.bitwise_xor.reduce(h), len(h)], np.uint64)
    out = np.uint64(0)
    for x in both:
        out = mix(np.array([out ^ x], np.uint64))[0]
    return int(out.astype(np.int64))


def _signatures(n: int):
    """One row per document: its set's size, digest (node) and bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch, texts in text_slices(batches, "_text"):
            sets = shingle_sets(hasher, texts, n)
            yield pa.record_batch([
                batch.column("_id"), batch.column("_th"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_digest(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([bit_sketch(s) if len(s) else None for s in sets], pa.binary())],
                ["_id", "_th", "n", "node", "sketch"])

    return run


def _keys(n: int, num: int, den: int):
    """(key, node) rows of every document; a task's equal sets give theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bands, seen = WordHasher(), Bands(num, den), set()
        for batch, texts in text_slices(batches, "_text"):
            keys, nodes = [], []
            for s in shingle_sets(hasher, texts, n):
                if len(s) and (node := set_digest(s)) not in seen:
                    seen.add(node)
                    keys.append(join_keys(s, bands).view(np.int64))
                    nodes.append(np.full(len(keys[-1]), node, np.int64))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["key", "node"])

    return run


def _screen(num: int, den: int):
    """Pairs (a, b, na, nb, sa, sb) that their bit sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            ok = [may_link(bands, w, np.frombuffer(x, np.uint8), y, np.frombuffer(z, np.uint8)) for w, x, y, z in zip(na, sa, nb, sb)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verify(n: int, num: int, den: int):
    """Pairs (a, b, ta, tb) whose shingle sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch, ta in text_slices(batches, "ta"):
            tb = batch.column("tb").cast(pa.binary()).to_pylist()
            ok = []
            for i in range(0, len(ta), 64):
                for x, y in zip(shingle_sets(hasher, ta[i:i + 64], n), shingle_sets(hasher, tb[i:i + 64], n)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(common > 0 and den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def nearest(bands: Bands, group: list[tuple], most: int | None) -> set[tuple[int, int]]:
    """Pairs of a group's sets (node, component, size, sketch, part; ``part``
    None: compare all, else sets of different parts only) in different
    components that their sketches don't rule out: of every set at most
    ``most``, the ones of the smallest distance."""
    group = sorted(group, key=lambda r: (r[2], r[0]))
    size = np.array([r[2] for r in group])
    comp = np.array([r[1] for r in group])
    part = np.array([-1 if r[4] is None else r[4] for r in group])
    whole = np.array([r[4] is None for r in group])
    last = np.searchsorted(size, size * bands.den // bands.num, "right")
    byte = np.array([len(r[3]) for r in group])
    rows = {w: np.stack([r[3] for r in group if len(r[3]) == w]) for w in set(byte.tolist())}
    begin = {w: int(np.argmax(byte == w)) for w in rows}  # sketches grow with the sets
    left, right, apart = [], [], []
    for i in range(len(group)):
        w = int(byte[i])
        for v in sorted(rows):
            x, y = max(i + 1, begin[v]), min(int(last[i]), begin[v] + len(rows[v]))
            if v < w or x >= y:
                continue
            j = np.arange(x, y)
            j = j[(comp[x:y] != comp[i]) & (whole[i] | (part[x:y] != part[i]))]
            if not len(j):
                continue
            other = rows[v][j - begin[v]]
            if v > w:
                other = np.bitwise_xor.reduce(other.reshape(len(j), -1, w), axis=1)
            far = np.bitwise_count(other ^ rows[w][i - begin[w]]).sum(1)
            ok = far <= (size[j] + size[i]) * (bands.den - bands.num) // (bands.den + bands.num)
            left.append(np.full(int(ok.sum()), i))
            right.append(j[ok])
            apart.append(far[ok])
    if not left:
        return set()
    i, j, far = np.concatenate(left), np.concatenate(right), np.concatenate(apart)
    if most is not None:
        who, mate = np.concatenate((i, j)), np.concatenate((j, i))
        order = np.lexsort((mate, np.concatenate((far, far)), who))
        who, mate = who[order], mate[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        i, j = who[rank < most], mate[rank < most]
    node = [r[0] for r in group]
    return {(min(node[x], node[y]), max(node[x], node[y])) for x, y in zip(i.tolist(), j.tolist())}


def _compare(num: int, den: int, most: int | None):
    """Rows sorted by (key, bi, bj), with (node, comp, n, sketch, part): the
    ``nearest`` pairs of each piece; a piece of two blocks pairs one set of
    either. A task gives a pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, now, group, found, told = Bands(num, den), None, [], set(), set()

        def table(pairs: set) -> pa.RecordBatch:
            return pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "bi", "bj", "node", "comp", "n", "sketch", "part")]
            for key, bi, bj, node, comp, n, sketch, part in zip(*cols):
                if (key, bi, bj) != now:
                    if len(group) > 1:
                        found |= nearest(bands, group, most) - told
                    now, group = (key, bi, bj), []
                group.append((node, comp, n, np.frombuffer(sketch, np.uint8), part if bi != bj else None))
            if len(found) > 10_000:
                yield table(found)
                told = told | found if len(told) < 1_000_000 else found
                found = set()
        if len(group) > 1:
            found |= nearest(bands, group, most) - told
        yield table(found)

    return run


def link_components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100,
                    id_col: str = "doc_id", text_col: str = "text", with_label: bool = False) -> DataFrame:
    """One row per document: id, ``n_shingles`` (its set's size),
    ``component_id`` (smallest id reachable by links, its own included) and
    ``text_hash`` (xxhash64 of the text, which tells rows with one id apart).

    Documents link when den * |A and B| >= num * |A or B|. A NULL text or one
    without words has no shingle and no link. Documents with equal sets are
    one class, which is compared once. A NULL id never names a component;
    such a document still links others. Repeated rows are equal sets.

    No pair list of a group is made. First every set is compared with the
    smallest ones of its keys (a star per key; the STARS it shares most keys
    with); what they link is joined into components. Then sets of one key that
    are still in different components are compared by their sketches, in
    pieces of GROUP_BLOCK: first only the nearest of every set are verified
    and joined, and what is then still apart is verified in full.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    signed = keep(rows.mapInArrow(_signatures(shingle), f"_id {kind}, _th long, n long, node long, sketch binary"), "parity-docs")
    # of each class, the smallest document, its text's hash, and the set's sketch
    heads = keep(signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_th", "n", "sketch")).alias("one"))
        .select("node", F.col("one._id").alias("head"), F.col("one._th").alias("_oth"), "one.n", "one.sketch"), "parity-classes")

    keyed = rows.mapInArrow(_keys(shingle, num, den), "key long, node long")
    by_key = Window.partitionBy("key")
    grouped = keep(keyed.withColumn("hub", F.min("node").over(by_key)).withColumn("top", F.max("node").over(by_key))
                   .where("hub < top").select("key", "node", "hub"), "parity-keys")

    stars = grouped.where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("shared"))
    turn = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "hub"))
    best = keep(stars.withColumn("turn", turn).where(F.col("turn") <= STARS)
                .select(F.col("node").alias("a"), F.col("hub").alias("b")), "parity-stars")
    links = _linked(rows, heads, best, shingle, num, den)
    comp = components(links)
    for most in (NEAREST, None):
        more = _apart(grouped, comp, heads, num, den, most)
        if more.isEmpty():
            break
        comp = joined(comp, _verified(rows, heads, more, shingle, num, den))

    label = heads.join(comp, "node", "left").select("node", "head", F.coalesce("component", "node").alias("label"))
    low = keep(label.groupBy("label").agg(F.min("head").alias("component_id")), "parity-labels")
    named = keep(label.join(low, "label").select(F.col("node").alias("_node"), "component_id", "label"), "parity-named")
    # sets without a shingle go their own way: their NULL node must not gather in one task
    out = [F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("_th").alias("text_hash")]
    # the component's own name: ids of different texts may repeat
    out += [F.col("label")] if with_label else []
    some = signed.where("node IS NOT NULL").select("_id", "_th", "n", "node").join(named, F.col("node") == F.col("_node"))
    none = signed.where("node IS NULL").withColumn("component_id", F.col("_id")).withColumn("label", F.lit(None).cast("long"))
    return some.select(*out).unionByName(none.select(*out))


def one_per_group(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one document of every component: the one with
    the smallest id (of repeated rows one stays). Documents without words and
    rows without an id are all kept."""
    found = keep(link_components(docs, shingle, num, den, id_col, text_col, with_label=True), "parity-found")
    linked = found.where(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0)).withColumnRenamed(id_col, "_id")
    first = linked.groupBy("label").agg(F.min(F.struct("_id", "text_hash")).alias("first")).select("first.*")
    stay = keep(linked.groupBy("_id", "text_hash").agg(F.count(F.lit(1)).alias("_rows"))
                .join(first.withColumn("_head", F.lit(True)), ["_id", "text_hash"], "left")
                .select(F.col("_id").alias("_gid"), F.col("text_hash").alias("_gth"), "_rows", F.coalesce("_head", F.lit(False)).alias("_head")), "parity-stay")
    rows = docs.withColumn("_th", F.xxhash64(text_col))
    same = (F.col(id_col) == F.col("_gid")) & (F.col("_th") == F.col("_gth"))
    one = rows.join(stay.where("NOT _head OR _rows > 1"), same, "left_anti").drop("_th")
    # heads that are repeated rows: few, so their texts are found by a broadcast or skewed join
    again = rows.join(stay.where("_head AND _rows > 1"), same).withColumn(
        "_nth", F.row_number().over(Window.partitionBy("_gid", "_gth").orderBy("_gid")))
    return one.unionByName(again.where("_nth = 1").select(*docs.columns))




def _apart(grouped: DataFrame, comp: DataFrame, heads: DataFrame, num: int, den: int, most: int | None) -> DataFrame:
    """Pairs of sets that share a key, are in different components, and are
    not ruled out: of every set's, the ``most`` nearest."""
    now = keep(grouped.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp")), "parity-comps")
    mixed = keep(now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows"))
                 .where("lo < hi").select("key", F.ceil(F.col("rows") / GROUP_BLOCK).alias("pieces")), "parity-mixed")
    rest = now.join(mixed, "key").withColumn("part", F.expr("pmod(xxhash64(node), pieces)"))
    rest = rest.withColumn("other", F.explode(F.expr("sequence(0L, pieces - 1)")))
    rest = rest.select("key", F.least("part", "other").alias("bi"), F.greatest("part", "other").alias("bj"), "node", "comp", "part")
    rest = rest.join(heads.select("node", "n", "sketch"), "node").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return keep(rest.mapInArrow(_compare(num, den, most), "a long, b long").distinct(), "parity-rest")


def _linked(rows: DataFrame, heads: DataFrame, pairs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The linked ones of pairs of nodes (a, b): by sketches, then by texts."""
    both = (pairs.join(heads.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
            .join(heads.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b"))
    passed = keep(both.mapInArrow(_screen(num, den), "a long, b long"), "parity-screened")
    return _verified(rows, heads, passed, shingle, num, den)


def _verified(rows: DataFrame, heads: DataFrame, pairs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = keep(heads.join(nodes, "node").select("node", F.col("head").alias("_one"), "_oth"), "parity-wanted")
    rows = maybe_in(rows, "_th", wanted, "_oth")
    texts = (rows.join(wanted, rows["_id"].eqNullSafe(wanted["_one"]) & (rows["_th"] == wanted["_oth"]))
             .select("node", F.col("_text").alias("text")).dropDuplicates(["node"]))
    texts = keep(texts, "parity-texts")
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"))
    return keep(both.mapInArrow(_verify(shingle, num, den), "a long, b long"), "parity-links")


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_components(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")
