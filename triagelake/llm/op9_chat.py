"""Chat formatting: a hidden Markov model over line features recovers the
role of every line by Viterbi, then turns are rendered in one form.

Input rows are blocks of text in the order of a conversation: a message each,
or a transcript with speaker markers inside. Every line has a hidden state,
(role, first line of a turn or a later one). Long conversations are cut into
chunks of blocks; a chunk is a max-plus matrix from the state before it to
the state at its end, so the best path is found by combining matrices and
tracing each chunk back between its known end states.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.corpus import dense_ordinal
from .common import by_group, keep, read, small_batches, training_rows

# ---- Fixed values: roles, markers and the canonical form ---------------------
ROLES = ["system", "user", "assistant"]
MARKERS = [
    ("system", r"system|instructions?|context"),
    ("user", r"user|human|customer|client|question|q|me"),
    ("assistant", r"assistant|ai|bot|agent|model|answer|a"),
]
TURN = "<|im_start|>{role}\n{text}<|im_end|>"
# ---- End of fixed values ----------------------------------------------------

STATES = 2 * len(ROLES)  # role * 2 + (1 if not the first line of a turn)
START = STATES  # the state before a conversation's first line
MARKER = re.compile(r"^\s*[\[\*#<(]*\s*(?:" + "|".join(f"(?P<{r}>{p})" for r, p in MARKERS) + r")\s*[\])>\*]*\s*[:>\-]\s*[\*]*\s*", re.I)
#: Line features and their numbers of values.
FEATURES = {"marker": 1 + len(ROLES), "block": 2, "length": 6, "question": 2, "opening": 2}
#: Pseudo-lines for every value of a feature.
SMOOTH = 0.5
#: The marker feature: pseudo-lines for every value, and the share of its own
#: marker on the first line of a role's turn (MARKER_LEAST pseudo-lines at
#: least), whether or not labelled rows have markers.
MARKER_SMOOTH, MARKER_SHARE, MARKER_LEAST = 1e-3, 0.1, 200.0
#: Blocks of one chunk, and chunks combined at a time.
CHUNK = 128
COMBINE = 1024


def line_features(lines: list[str], opening: bool) -> np.ndarray:
    """One row per line of a block: FEATURES in order."""
    out = np.zeros((len(lines), len(FEATURES)), np.int64)
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        out[i, 0] = 1 + ROLES.index(m.lastgroup) if m else 0
        out[i, 1] = i == 0 or m is not None
        out[i, 2] = min(5, len(line).bit_length() // 2)
        out[i, 3] = line.rstrip().endswith("?")
        out[i, 4] = opening and i == 0
    return out


def lines_of(text: str | None) -> list[str]:
    """Lines of a block; an empty or NULL block is one empty line."""
    return (text or "").split("\n")


class ChatModel:
    """Log probabilities: ``move`` (from any state or START, to any state;
    nothing leads to START) and one table (state, value) per feature."""

    def __init__(self, move: np.ndarray, emit: list[np.ndarray]) -> None:
        self.move, self.emit = move, emit

    def lines(self, feats: np.ndarray) -> np.ndarray:
        """One row per line: its log probability in every state."""
        out = np.full((len(feats), STATES + 1), -np.inf)
        out[:, :STATES] = sum(e[:, feats[:, k]].T for k, e in enumerate(self.emit))
        return out


def model_of(moves: np.ndarray, seen: list[np.ndarray]) -> ChatModel:
    """Smoothed log probabilities from counts. A role's turn may follow any
    turn; a later line must follow a line of the same role's turn."""
    state = np.arange(STATES + 1)
    first = (state % 2 == 0) & (state != START)
    allowed = first[None, :] | ((state[None, :] == state[:, None] // 2 * 2 + 1) & (state[:, None] != START) & (state[None, :] != START))
    move = np.where(allowed, moves + SMOOTH, 0.0)
    with np.errstate(divide="ignore"):
        move = np.log(move / move.sum(1, keepdims=True))
    emit = []
    for k, counts in enumerate(seen):
        c = counts + (SMOOTH if k else MARKER_SMOOTH)
        if k == 0:
            c[:, 0] += MARKER_LEAST
            for s in range(0, STATES, 2):
                c[s, 1 + s // 2] += max(MARKER_LEAST, MARKER_SHARE * c[s].sum())
        if k == 1:  # a turn begins where a block or a marker does
            c[::2, 1] += MARKER_LEAST
            c[1::2, 0] += MARKER_LEAST
        emit.append(np.log(c / c.sum(1, keepdims=True)))
    return ChatModel(move, emit)


def step(best: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return (best[:, :, None] + move[None]).max(1)


def chunk_matrix(model: ChatModel, feats: np.ndarray) -> np.ndarray:
    """[i, j]: best log probability from state i before the lines to j at the last."""
    obs = model.lines(feats)
    best = model.move + obs[0][None, :]
    for o in obs[1:]:
        best = step(best, model.move) + o[None, :]
    return best


def trace(model: ChatModel, feats: np.ndarray, before: int, end: int) -> list[int]:
    """States of the best path from ``before`` that ends in ``end``. Of equal
    paths the one with the lowest states, from the end."""
    obs = model.lines(feats)
    v, back = model.move[before] + obs[0], []
    for o in obs[1:]:
        w = v[:, None] + model.move
        back.append(w.argmax(0))
        v = w.max(0) + o
    path = [end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _count(key: tuple, blocks: list[tuple]) -> list[tuple]:
    """Counts of one chunk's labelled blocks (text, opening, role, learn):
    transitions, features, and the states at the chunk's ends (-1: not
    labelled)."""
    conv, chunk = key
    rows: dict[tuple[str, int, int], int] = {}

    def add(*what) -> None:
        rows[what] = rows.get(what, 0) + 1

    last, heads = -1, []
    for text, opening, role, known in blocks:
        if not known or role not in ROLES:
            last = -1
            heads.append(-1)
            continue
        feats = line_features(lines_of(text), bool(opening))
        s = 2 * ROLES.index(role)
        heads.append(s)
        for i, line in enumerate(feats.tolist()):
            if line[4]:
                add("move", START, s)
            elif last >= 0:
                add("move", last, s + (i > 0))
            last = s + (i > 0)
            for k, value in enumerate(line):
                add(f"f{k}", last, value)
    return [*((conv, a, b, c, n, chunk) for (a, b, c), n in rows.items()), (conv, "edge", heads[0], last, 0, chunk)]


def learn(blocks: DataFrame) -> ChatModel:
    """Model from the counts of all prepared blocks that have a role and a
    training id."""
    kind = blocks.schema["_conv"].dataType.simpleString()
    counts = keep(by_group(blocks, ["_conv", "_chunk"], ["_ord"], ["_text", "_opening", "_role", "_learn"], _count,
                           f"conv {kind}, kind string, a int, b int, n long, chunk long"), "chat-counts")
    order = Window.partitionBy("conv").orderBy("chunk")  # one row per chunk
    edges = (counts.where("kind = 'edge'").withColumn("before", F.lag("b").over(order))
             .where("a >= 0 AND before >= 0").groupBy(F.lit("move").alias("kind"), F.col("before").alias("x"), F.col("a").alias("y"))
             .agg(F.count(F.lit(1)).alias("n")).select("kind", F.col("x").alias("a"), F.col("y").alias("b"), "n"))
    total = counts.where("kind <> 'edge'").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).unionByName(edges).collect()
    moves = np.zeros((STATES + 1, STATES + 1))
    seen = [np.zeros((STATES, n)) for n in FEATURES.values()]
    for r in total:  # at most states * (states + feature values) rows, whatever the input
        table = moves if r["kind"] == "move" else seen[int(r["kind"][1:])]
        table[r["a"], r["b"]] += r["n"]
    return model_of(moves, seen)


def prepare(rows: DataFrame, conv_col: str, pos_col: str, text_col: str, role_col: str | None) -> DataFrame:
    """Blocks numbered over all conversations in their order (``_ord``), with
    their chunk -- CHUNK numbers, of one conversation -- and whether they open
    their conversation. Repeated rows are told apart by where they are stored,
    so that tied blocks are numbered, and dealt out, like others."""
    role = F.lower(F.col(role_col)) if role_col else F.lit(None).cast("string")
    out = rows.select(F.col(conv_col).alias("_conv"), F.col(pos_col).cast("long").alias("_pos"), F.col(text_col).alias("_text"),
                      role.alias("_role"), training_rows(conv_col).alias("_learn"))
    out = keep(out.withColumn("_hash", F.xxhash64("_text")).withColumn("_sha", F.sha2("_text", 256)), "chat-rows")
    order = ["_conv", "_pos", "_hash", "_sha", "_role", "_tie"]
    out = dense_ordinal(out.withColumn("_tie", F.monotonically_increasing_id()), order, "_ord", start=0).drop("_hash", "_sha", "_tie")
    out = out.withColumn("_chunk", F.floor(F.col("_ord") / CHUNK))
    opens = out.groupBy("_conv").agg(F.min("_ord").alias("_open")).select("_open")
    return out.join(opens, F.col("_ord") == F.col("_open"), "left").withColumn("_opening", F.col("_open").isNotNull()).drop("_open")


def _features(blocks: list[tuple]) -> np.ndarray:
    """Features of all lines of blocks (text, opening, ...)."""
    return np.concatenate([line_features(lines_of(b[0]), bool(b[1])) for b in blocks])


def _matrices(model):
    def run(key: tuple, blocks: list[tuple]) -> list[tuple]:
        return [(*key, chunk_matrix(model.value, _features(blocks)).ravel().tolist())]

    return run


def _square(m) -> np.ndarray:
    return np.asarray(m).reshape(STATES + 1, STATES + 1)


def _combine(key: tuple, rows: list[tuple]) -> list[tuple]:
    """One matrix for consecutive ones (m)."""
    best = _square(rows[0][0])
    for m, in rows[1:]:
        best = step(best, _square(m))
    return [(*key, best.ravel().tolist())]


def _borders(key: tuple, rows: list[tuple]) -> list[tuple]:
    """States before and at the end of each of a sequence's matrices (idx, m,
    before, end), given those of the whole sequence (``end`` -1: any, the
    best)."""
    before, end = rows[0][2], rows[0][3]
    v, back = _square(rows[0][1])[before], []
    for _, m, _, _ in rows[1:]:
        w = v[:, None] + _square(m)
        back.append(w.argmax(0))
        v = w.max(0)
    ends = [int(np.argmax(v)) if end < 0 else end]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return [(key[0], r[0], s, e) for r, s, e in zip(rows, [before, *ends[:-1]], ends)]


def chunk_borders(matrices: DataFrame) -> DataFrame:
    """``_conv``, ``idx``, ``before``, ``end`` of every chunk's best path.

    COMBINE matrices at a time are combined until each conversation has a
    sequence of at most COMBINE, whose states are then handed down."""
    kind = matrices.schema["_conv"].dataType.simpleString()
    levels = [matrices]
    while levels[-1].groupBy("_conv").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] > COMBINE:
        grouped = levels[-1].withColumn("grp", F.floor(F.col("idx") / COMBINE))
        levels.append(keep(by_group(grouped.repartition("_conv", "grp"), ["_conv", "grp"], ["idx"], ["m"], _combine,
                                    f"_conv {kind}, idx long, m array<double>"), "chat-matrices"))
    shape = f"_conv {kind}, idx long, before int, end int"
    top = levels[-1].withColumn("before", F.lit(START)).withColumn("end", F.lit(-1))
    cols = ["idx", "m", "before", "end"]
    borders = keep(by_group(top.repartition("_conv"), ["_conv"], ["idx"], cols, _borders, shape), "chat-borders")
    for below in reversed(levels[:-1]):
        upper = borders.select(F.col("_conv").alias("_c"), F.col("idx").alias("grp"), "before", "end")
        rows = below.withColumn("grp", F.floor(F.col("idx") / COMBINE))
        rows = rows.join(upper.withColumnRenamed("grp", "_g"), rows["_conv"].eqNullSafe(F.col("_c")) & (rows["grp"] == F.col("_g")))
        borders = keep(by_group(rows.repartition("_conv", "grp"), ["_conv", "grp"], ["idx"], cols, _borders, shape), "chat-borders")
    return borders


def _roles(model):
    """Lines of one chunk (text, opening, pos, before, end) with their states
    and place."""

    def run(key: tuple, blocks: list[tuple]) -> list[tuple]:
        path = iter(trace(model.value, _features(blocks), blocks[0][3], blocks[0][4]))
        out = []
        for text, _, pos, _, _ in blocks:
            for k, line in enumerate(lines_of(text)):
                s = next(path)
                m = MARKER.match(line)
                out.append((*key, pos, len(out), k, s // 2, s % 2 == 0, line[m.end():] if m else line))
        return out

    return run


def format_chats(rows: DataFrame, conv_col: str = "conv_id", pos_col: str = "turn", text_col: str = "text",
                 role_col: str | None = "role") -> DataFrame:
    """One row per recovered turn: conversation id, ``turn_no`` (from 1),
    ``first_pos`` (position of the block it begins in), ``role``, ``n_lines``,
    ``content`` and ``rendered`` (canonical form).

    ``role_col`` is only learnt from (conversations whose crc32 mod 3 is not
    1); roles are recovered from the lines alone. Blocks are ordered by
    position (NULL first), then by two hashes of the text and the role. A NULL or
    empty text is one empty line. NULL ids form one conversation. Repeated
    rows are blocks of their own. A speaker marker is cut from its line.
    """
    spark = rows.sparkSession
    small_batches(spark)
    # a chunk is little data but much work: as many tasks as the session has shuffle partitions, not fewer
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = keep(prepare(rows, conv_col, pos_col, text_col, role_col), "chat-blocks").repartition(tasks, "_conv", "_chunk")
    model = learn(blocks)
    sent = spark.sparkContext.broadcast(model)
    kind = blocks.schema["_conv"].dataType.simpleString()
    chunk = ["_conv", "_chunk"]
    matrices = keep(by_group(blocks, chunk, ["_ord"], ["_text", "_opening"], _matrices(sent), f"_conv {kind}, idx long, m array<double>"), "chat-matrices")
    borders = chunk_borders(matrices).withColumnsRenamed({"_conv": "_bc", "idx": "_bi"})
    placed = blocks.join(borders, blocks["_conv"].eqNullSafe(borders["_bc"]) & (blocks["_chunk"] == borders["_bi"])).drop("_bc", "_bi")
    lines = keep(by_group(placed.repartition(tasks, *chunk), chunk, ["_ord"], ["_text", "_opening", "_pos", "before", "end"], _roles(sent),
                          f"conv {kind}, chunk long, pos long, at long, line int, role int, begins boolean, text string"), "chat-lines")
    # turn numbers: turns begun in earlier chunks, plus those begun before in the chunk
    begun = lines.groupBy("conv", "chunk").agg(F.count_if("begins").alias("_n"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select(F.col("conv").alias("_c"), F.col("chunk").alias("_k"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("conv", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = (lines.withColumn("_in", F.sum(F.col("begins").cast("long")).over(within))
             .join(begun, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k")))
             .withColumn("turn_no", F.col("_before") + F.col("_in")))
    names = F.array(*[F.lit(r) for r in ROLES])
    turns = lines.groupBy("conv", "turn_no").agg(
        F.min(F.struct("chunk", "at", "pos")).alias("_first"), F.min("role").alias("_role"), F.count(F.lit(1)).alias("n_lines"),
        F.array_sort(F.collect_list(F.struct("chunk", "at", "text"))).alias("_lines"))
    content = F.array_join(F.transform("_lines", lambda x: x["text"]), "\n")
    before, between, after = re.split(r"\{role\}|\{text\}", TURN)
    return (turns.withColumn("role", F.element_at(names, F.col("_role") + 1)).withColumn("content", content)
            .select(F.col("conv").alias(conv_col), "turn_no", F.col("_first.pos").alias("first_pos"), "role", "n_lines", "content",
                    F.concat(F.lit(before), "role", F.lit(between), "content", F.lit(after)).alias("rendered")))


def op9_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
