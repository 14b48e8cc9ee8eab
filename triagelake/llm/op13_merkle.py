"""Operator 13: Merkle dataset manifest.

Every row is a leaf. The leaves of a group (a source) in order are the bottom
of a tree whose inner nodes hash runs of three; the groups' roots are hashed
the same way into one root. The tree is stored as a postorder append log: a
node is written when its last child is, so a builder never looks ahead.

With ``last`` the number of the last leaf below a node of ``level``, the log
position is ``level + sum(last // 3**k for k = 0, 1, ...)``: the sizes of all
subtrees closed before it. A position therefore needs no search, and

* builders work on aligned blocks of 3**BLOCK_LEVELS nodes each on their own
  and still write global positions; the blocks' roots are the next round's
  leaves, so a group of a third of all rows is many small blocks;
* a proof addresses a node's siblings by their positions.

Leaves get their place by range partitions, whose rows of one group are
numbered from the counts of the partitions before; no group is in one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.corpus import dense_ordinal
from .common import keep, read

#: Children of a node.
ARITY = 3
#: Levels that one builder task completes: blocks of 3**7 = 2,187 nodes.
BLOCK_LEVELS = 7

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOG_SCHEMA = "tree long, size long, block long, position long, level int, idx long, digest string"
PATH = "before array<string>, after array<string>, subroot string, root string"


def leaf_digest(*cols: Column) -> Column:
    """SHA-256 of the columns as text, each ``-`` if NULL, else its UTF-8 byte
    count, a colon and the value."""
    parts = []
    for c in cols:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(digest: Column, before: Column, after: Column) -> Column:
    """The root that a leaf digest and its siblings, level by level, lead to."""
    steps = F.arrays_zip(before.alias("b"), after.alias("a"))
    return F.aggregate(steps, digest, lambda d, s: F.sha2(F.concat(s["b"], d, s["a"]), 256))


def height(size: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    h = 0
    while ARITY ** h < size:
        h += 1
    return h


def positions(level: int, idx: np.ndarray, size: int) -> np.ndarray:
    """Log positions of the nodes ``idx`` of a level of a tree of ``size`` leaves."""
    last = np.minimum((np.asarray(idx, np.int64) + 1) * ARITY ** level, size) - 1
    out, k = np.full(last.shape, level, np.int64), 1
    while True:
        out += last // k
        k *= ARITY
        if k >= size:
            return out


def _append(first_idx: int, digests: list[str], level: int, size: int, levels: int) -> list[tuple[int, int, str]]:
    """(level, idx, digest) of a block's subtree in the order of completion.

    ``digests`` are the block's nodes of ``level`` from ``first_idx`` on; a run
    is closed by its third node, or by the last node of the tree's level.
    """
    width = [-(-size // ARITY ** (level + l)) for l in range(levels + 1)]
    log: list[tuple[int, int, str]] = []
    runs: list[list[str]] = [[] for _ in range(levels + 1)]
    for i, digest in enumerate(digests):
        idx, l = first_idx + i, 0
        while True:
            log.append((level + l, idx, digest))
            if l == levels:
                break
            runs[l].append(digest)
            if len(runs[l]) < ARITY and idx + 1 < width[l]:
                break
            digest = hashlib.sha256("".join(runs[l]).encode()).hexdigest()
            runs[l] = []
            idx, l = idx // ARITY, l + 1
    return log


def _builder(level: int):
    def build(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        tree, size, number = (block.column(c)[0].as_py() for c in ("tree", "size", "block"))
        levels = min(BLOCK_LEVELS, height(size) - level)
        log = _append(block.column("idx")[0].as_py(), block.column("digest").to_pylist(), level, size, levels)
        n = len(log)
        at = np.array([x[0] for x in log], np.int32)
        idx = np.array([x[1] for x in log], np.int64)
        place = np.empty(n, np.int64)
        for l in np.unique(at):
            place[at == l] = positions(int(l), idx[at == l], size)
        return pa.table({"tree": pa.array(np.full(n, tree)), "size": pa.array(np.full(n, size)), "block": pa.array(np.full(n, number)),
                         "position": pa.array(place), "level": pa.array(at), "idx": pa.array(idx),
                         "digest": pa.array([x[2] for x in log], pa.string())})
    return build


def _block_of(idx: str = "idx") -> Column:
    return F.floor(F.col(idx) / F.lit(ARITY ** BLOCK_LEVELS)).cast("long")


def append_logs(leaves: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """Log parts of all trees, one per round of BLOCK_LEVELS levels. ``leaves``
    has tree, size, idx, digest; ``largest`` is the size of the largest tree."""
    logs, nodes, level = [], leaves.select("tree", "size", "idx", "digest"), 0
    while True:
        blocks = nodes.withColumn("block", _block_of()).groupBy("tree", "block")
        logs.append(keep(blocks.applyInArrow(_builder(level), LOG_SCHEMA), f"{name}-{level}"))
        level += BLOCK_LEVELS
        if height(largest) <= level:
            return logs
        nodes = logs[-1].where((F.col("level") == level) & (F.col("size") > ARITY ** level)).select("tree", "size", "idx", "digest")


def tree_roots(logs: list[DataFrame]) -> DataFrame:
    """tree and digest of every tree's root, its last log entry."""
    out = None
    for r, log in enumerate(logs):
        low = r * BLOCK_LEVELS
        root = F.lit(False)
        for l in range(low + (r > 0), low + BLOCK_LEVELS + 1):  # the level whose one node spans the tree
            spans = (F.col("size") <= ARITY ** l) & (F.col("size") > (ARITY ** (l - 1) if l else 0))
            root = root | ((F.col("level") == l) & spans)
        part = log.where(root).select("tree", "digest")
        out = part if out is None else out.unionByName(part)
    return out


def _prover(level: int, payload: list[str]):
    def prove(block: pa.Table) -> pa.Table:
        top = block.filter(pa.compute.is_valid(block.column("root"))).slice(0, 1).to_pylist()[0]
        block = block.filter(pa.compute.is_null(block.column("root"))).sort_by([("level", "ascending"), ("idx", "ascending")])
        size = block.column("size")[0].as_py()
        levels = min(BLOCK_LEVELS, height(size) - level)
        at, idx = block.column("level").to_numpy(), block.column("idx").to_numpy()
        place = np.empty(len(at), np.int64)
        for l in np.unique(at):
            place[at == l] = positions(int(l), idx[at == l], size)
        order = np.argsort(place)
        log, digests = place[order], np.array(block.column("digest").to_pylist(), object)[order]
        bottom = np.flatnonzero(at == level)
        mine = idx[bottom]
        before, after = [], []
        for l in range(levels):
            nodes, of = np.unique(mine // ARITY ** l, return_inverse=True)
            width = -(-size // ARITY ** (level + l))
            first = nodes - nodes % ARITY
            b, a = [""] * len(nodes), [""] * len(nodes)
            for k in range(ARITY):
                child = first + k
                there = np.flatnonzero((child < width) & (child != nodes))
                found = digests[np.searchsorted(log, positions(level + l, child[there], size))]
                for i, d in zip(there.tolist(), found):
                    if child[i] < nodes[i]:
                        b[i] += d
                    else:
                        a[i] += d
            before.append([b[i] for i in of])
            after.append([a[i] for i in of])
        n = len(bottom)
        rows = block.take(pa.array(bottom))
        out = {c: rows.column(c) for c in payload}
        out["before"] = pa.array([[*x, *top["before"]] for x in zip(*before)] if levels else [top["before"]] * n, pa.list_(pa.string()))
        out["after"] = pa.array([[*x, *top["after"]] for x in zip(*after)] if levels else [top["after"]] * n, pa.list_(pa.string()))
        out["subroot"] = pa.array([top["subroot"]] * n, pa.string())
        out["root"] = pa.array([top["root"]] * n, pa.string())
        return pa.table(out)
    return prove


def _round(log: DataFrame, paths: DataFrame, level: int, payload: dict[str, str]) -> DataFrame:
    """Paths of the bottom nodes of one round's blocks: their siblings inside
    the block, then the path of the block's root. ``paths`` has tree, block and
    the path columns; ``payload`` names the log's columns to hand on."""
    names = list(dict.fromkeys(["tree", "size", "block", "level", "idx", "digest", *payload]))
    rows = log.select(*names).unionByName(paths.select("tree", "block", "before", "after", "subroot", "root"), allowMissingColumns=True)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in payload.items()), PATH])
    return rows.groupBy("tree", "block").applyInArrow(_prover(level, list(payload)), schema)


@dataclass
class Manifest:
    """``leaves``: tree, size, idx, block, level, digest and the carried columns;
    ``trees``: tree, the group, size, subroot; ``logs`` and ``top_logs``: the
    append logs of the groups and of the tree over their roots, by round."""

    leaves: DataFrame
    trees: DataFrame
    logs: list[DataFrame]
    top_logs: list[DataFrame]
    carried: dict[str, str]

    @property
    def log(self) -> DataFrame:
        """The whole append log: tree (-1: the tree of the groups' roots),
        position, level, idx, digest."""
        out = None
        for r, part in enumerate([*self.logs, *self.top_logs]):
            low = (r if r < len(self.logs) else r - len(self.logs)) * BLOCK_LEVELS
            part = part.where(F.col("level") > low) if low else part  # a round's bottom is the round before's top
            part = part.select("tree", "position", "level", "idx", "digest")
            out = part if out is None else out.unionByName(part)
        return out


def numbered(leaves: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with tree (place of the group in order, NULL first), size and
    idx (place inside the group by ``order``, NULL first); and the trees."""
    spark = leaves.sparkSession
    by = [group, *order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = leaves.repartitionByRange(n, *by).sortWithinPartitions(*by)
    r = keep(r.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "merkle-ordered")
    cells = keep(r.groupBy("_pid", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")), "merkle-cells")
    trees = cells.groupBy(group).agg(F.sum("_n").alias("size"))
    trees = keep(dense_ordinal(trees, [group], "tree", start=0), "merkle-trees")
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_base")
    cells = cells.select("_pid", group, base)
    cells = cells.join(trees.withColumnRenamed(group, "_t"), cells[group].eqNullSafe(F.col("_t"))).select(
        F.col("_pid").alias("_p"), F.col(group).alias("_g"), "_base", "tree", "size")
    placed = r.join(cells, (F.col("_pid") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    placed = placed.withColumn("idx", F.col("_pos") + F.col("_base")).drop("_pid", "_pos", "_p", "_g", "_base")
    return keep(placed, "merkle-leaves"), trees


def build(rows: DataFrame, *, key: str = "doc_id", group: str = "source", digest: str = "digest") -> Manifest | None:
    """The manifest of a table with a leaf digest per row. Leaves of a group
    ascend by ``key`` (NULL first; rows with one key by digest, equal rows are
    interchangeable); other columns are carried to the proofs. None for an
    empty table."""
    carried = {c: t for c, t in rows.dtypes}
    inner = {c: f"c_{i}" for i, c in enumerate(rows.columns)}  # no column of the caller can clash with the tree's
    rows = rows.select(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()])
    rows = keep(rows.withColumn("_tie", F.monotonically_increasing_id()), "merkle-rows")
    leaves, trees = numbered(rows, inner[group], [inner[key], inner[digest], "_tie"])
    largest = trees.agg(F.max("size")).first()[0]
    if largest is None:
        return None
    leaves = leaves.withColumn("digest", F.col(inner[digest])).withColumn("level", F.lit(0)).withColumn("block", _block_of())
    logs = append_logs(leaves, largest, "merkle-log")
    trees = keep(trees.join(tree_roots(logs).withColumnRenamed("digest", "subroot"), "tree"), "merkle-subroots")
    tops = trees.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"))
    n_trees = trees.count()
    top_logs = append_logs(tops.withColumn("size", F.lit(n_trees).cast("long")), n_trees, "merkle-top")
    return Manifest(leaves, trees, logs, top_logs, carried)


def _paths(logs: list[DataFrame], paths: DataFrame, last: DataFrame, payload: dict[str, str]) -> DataFrame:
    """Paths of all bottom nodes of the trees, round by round from the top.
    ``paths`` (tree, path columns) hold what stands above each tree's root;
    ``last`` replaces the log's bottom level in the last round."""
    here = None
    for r in range(len(logs) - 1, -1, -1):
        level, log = r * BLOCK_LEVELS, logs[r]
        # a tree ends in this round if one block holds it whole
        of_tree = log.where((F.col("size") <= ARITY ** (level + BLOCK_LEVELS)) & (F.col("level") == level) & (F.col("idx") == 0))
        ends = of_tree.select("tree", "block").join(paths, "tree").select("tree", "block", "before", "after", "subroot", "root")
        at = ends if here is None else ends.unionByName(here.select("tree", F.col("idx").alias("block"), "before", "after", "subroot", "root"))
        if r == 0:
            whole = log.where(F.col("level") > 0).unionByName(last, allowMissingColumns=True)
            return _round(whole, at, 0, payload)
        here = keep(_round(log, at, level, {"tree": "long", "idx": "long"}), "merkle-paths")
    return here


def prove(m: Manifest) -> DataFrame:
    """One row per leaf: the carried columns (c_0, c_1, ... in the caller's
    order), its siblings level by level up to the root (``before`` and
    ``after`` the node, concatenated), ``subroot`` and ``root``."""
    top = tree_roots(m.top_logs).select("tree", F.col("digest").alias("root"))
    empty = F.array().cast("array<string>")
    start = top.select("tree", empty.alias("before"), empty.alias("after"), F.lit("").alias("subroot"), "root")
    over = _paths(m.top_logs, start, m.top_logs[0].where("level = 0"), {"idx": "long", "digest": "string"})
    over = keep(over.select(F.col("idx").alias("tree"), "before", "after", F.col("digest").alias("subroot"), "root"), "merkle-over")
    payload = {f"c_{i}": t for i, t in enumerate(m.carried.values())}
    return _paths(m.logs, over, m.leaves, payload)


def manifest_proofs(docs: DataFrame) -> DataFrame:
    """Leaf, proof and verification of every row of a documents table.

    Returns doc_id, leaf, subroot, root, before, after, folded_root and
    verified. A tampered row (even crc32 of the doc_id) is folded from the leaf
    of its text without line feeds; all siblings are the original ones.

    Defined results: a NULL field is hashed as ``-``; a NULL source is a group
    of its own, before all others; a NULL doc_id comes first in its group and
    is never tampered; rows with one doc_id are ordered by their leaf, equal
    rows are equal leaves side by side; an empty text is hashed as ``0:``; an
    empty table gives no rows; columns other than the five fields are not read.
    """
    d = docs.select(*FIELDS)
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampers = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    cols = [F.col(c) for c in FIELDS]
    leaves = d.select("doc_id", "source", leaf_digest(*cols).alias("leaf"),
                      F.when(tampers, leaf_digest(*cols[:-1], text)).alias("tampered"))
    m = build(leaves, digest="leaf")
    if m is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {d.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, "
                                                     "before array<string>, after array<string>, folded_root string, verified boolean")
    p = prove(m).select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(leaves.columns)], "before", "after", "subroot", "root")
    p = p.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("before"), F.col("after")))
    return p.select("doc_id", "leaf", "subroot", "root", "before", "after", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = manifest_proofs(read(spark, sf_dir, "documents", *FIELDS))
    proof = F.array_join(F.zip_with("before", "after", lambda b, a: F.concat(b, a)), "")
    return p.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", "verified")


def _sql_leaf(text: str) -> str:
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    return "sha256(" + " || ".join(field(c) for c in [*FIELDS[:-1], text]) + ")"


def _sql_levels(name: str, count: int) -> list[str]:
    """CTEs of a forest's levels: {name}0 (tree, j, d) is given; runs hold the
    digests of three neighbours, levels above a single node repeat it."""
    out = []
    for l in range(count):
        out.append(f"{name}run{l} as materialized (select tree, j // 3 as p, list(d order by j) as ds, sum(count(*)) over (partition by tree) as n "
                   f"from {name}{l} group by tree, j // 3)")
        out.append(f"{name}{l + 1} as materialized (select tree, p as j, case when n > 1 then sha256(array_to_string(ds, '')) else ds[1] end as d from {name}run{l})")
    return out


def _sql_walk(name: str, walk: str, start: str, count: int) -> list[str]:
    """CTEs that fold every leaf of ``start`` (key, tree, j, proof, fold) upwards."""
    out = [f"{walk}0 as (select key, tree, j, proof, fold from {start})"]
    for l in range(count):
        before, after = "array_to_string(ds[1:j % 3], '')", "array_to_string(ds[j % 3 + 2:], '')"
        out.append(f"{walk}{l + 1} as materialized (select key, w.tree, j // 3 as j, case when n > 1 then proof || {before} || {after} else proof end as proof, "
                   f"case when n > 1 then sha256({before} || fold || {after}) else fold end as fold "
                   f"from {walk}{l} w join {name}run{l} r on r.tree = w.tree and r.p = w.j // 3)")
    return out


#: Levels that the twin spells out: groups of up to 3**12 rows, up to 3**8 groups.
SQL_LEVELS, SQL_TOP_LEVELS = 12, 8

OP13_SQL = "with recursive " + ",\n".join([
    # the table of CRC-32, by eight shifts of each byte
    "crc_bits(i, c, k) as (select i, i, 0 from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_bits where k < 8)",
    "crc_table as materialized (select list(c order by i) as tbl from crc_bits where k = 8)",
    "crc as materialized (select doc_id as id, xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint), "
    "lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) as crc from (select distinct doc_id from documents where doc_id is not null), crc_table)",
    f"leaf as materialized (select row_number() over () as key, d.doc_id, source, {_sql_leaf('text')} as leaf, "
    f"case when crc % 2 = 0 then {_sql_leaf("replace(text, chr(10), '')")} else {_sql_leaf('text')} end as start "
    "from documents d left join crc on crc.id = d.doc_id)",
    "placed as materialized (select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf, key) - 1 as j from leaf)",
    "n0 as (select tree, j, leaf as d from placed)", *_sql_levels("n", SQL_LEVELS),
    "t0 as (select 0 as tree, tree as j, d from n%d)" % SQL_LEVELS, *_sql_levels("t", SQL_TOP_LEVELS),
    "begin as (select key, tree, j, '' as proof, start as fold from placed)", *_sql_walk("n", "w", "begin", SQL_LEVELS),
    "again as (select key, 0 as tree, tree as j, proof, fold from w%d)" % SQL_LEVELS, *_sql_walk("t", "v", "again", SQL_TOP_LEVELS),
]) + f"""
select p.doc_id, p.leaf, s.d as subroot, r.d as root, sha256(v.proof) as proof_sha256, v.fold as folded_root, v.fold = r.d as verified
from placed p join v{SQL_TOP_LEVELS} v using (key) join n{SQL_LEVELS} s on s.tree = p.tree cross join t{SQL_TOP_LEVELS} r"""
