"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Every source has a target of words. Document rates are the maximum-entropy
rates that meet the targets: ``rate = min(cap, exp(lambda_source * size / mean
size))``, where lambda solves the convex dual of the source's word constraint
by Newton steps over a table of (source, size, documents). Rates become whole
copies by systematic rounding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, read

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: Documents of equal source and size are rounded in sub-cells of about this many rows.
CELL_ROWS = 256
#: Newton stops when every source is within this share of its target.
TOLERANCE = 1e-6
MAX_STEPS = 60


def word_count(text: str):
    """Number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source``, ``source_size``, ``n``, ``target`` from rows of (source, size).

    Sources in code-point order (NULL last) take the weights in turn. A target
    stops at ``cap`` times its source's size; the excess is shared by weight
    among the others until none is above. That fixed point is
    ``min(cap * size, level * weight)``: sources sorted by cap * size / weight
    reach their cap in that order, so running sums give the level. The windows
    run over one row per source, after aggregation.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    top = F.lit(float(cap)) * F.col("source_size")
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = (src.withColumn("ratio", top / F.col("w"))
           .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum(top).over(before), F.lit(0.0)))
                       / F.sum("w").over(after)))
    # the level of the first source that stays below its cap holds for all
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)["level"]
    return (src.withColumn("shared", level)
            .select("source", "source_size", "n",
                    F.least(top, F.coalesce(F.col("shared") * F.col("w"), top)).alias("target")))


def solve_rates(cells: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """``source``, ``lam``, ``mean``: the dual solution per source (lam NULL:
    every rate is the cap).

    Each Newton step is one aggregate over ``cells`` (source, size, n) joined
    with the sources; the new values are a written table. A bracket around
    each root keeps the steps safe where capped rates bend the dual. Only the
    largest relative error comes to the driver.
    """
    state = targets.select(
        F.col("source").alias("src"), "target", F.col("source_size").cast("double").alias("total"),
        (F.col("source_size") / F.greatest(F.col("n"), F.lit(1))).alias("mean"),
        F.when(F.col("target") < F.lit(float(cap) * (1 - 1e-12)) * F.col("source_size"), F.lit(0.0)).alias("lam"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    state = keep(state, "mix-dual")
    for _ in range(MAX_STEPS):
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        step = (cells.join(state, cells["source"].eqNullSafe(state["src"]))
                .where("lam IS NOT NULL AND size > 0")
                .groupBy("src").agg(
                    F.sum(words * F.least(raw, F.lit(float(cap)))).alias("got"),
                    F.sum(F.when(raw < float(cap), words * x * raw).otherwise(0.0)).alias("slope"))
                .withColumnRenamed("src", "_s"))
        now = state.join(step, state["src"].eqNullSafe(step["_s"]), "left")
        gap = F.col("got") - F.col("target")
        now = now.withColumn("err", F.abs(gap) / F.col("target"))
        now = (now.withColumn("lo", F.when(gap < 0, F.greatest("lo", "lam")).otherwise(F.col("lo")))
               .withColumn("hi", F.when(gap > 0, F.least("hi", "lam")).otherwise(F.col("hi"))))
        limit = F.lit(4.0) + 2 * F.abs("lam")
        newton = F.when(F.col("slope") > 0, F.col("lam") - F.greatest(-limit, F.least(limit, gap / F.col("slope")))) \
            .otherwise(F.col("lam") - F.signum(gap) * limit)
        bisect = (F.col("lo") + F.col("hi")) / 2
        outside = (newton <= F.col("lo")) | (newton >= F.col("hi"))
        now = now.withColumn("lam", F.when(F.col("lam").isNull() | F.col("got").isNull() | (F.col("err") <= TOLERANCE), F.col("lam"))
                             .otherwise(F.when(outside & bisect.isNotNull(), bisect).otherwise(newton)))
        state = keep(now.select("src", "target", "total", "mean", "lam", "lo", "hi", "err"), "mix-dual")
        if (state.agg(F.max("err")).first()[0] or 0.0) <= TOLERANCE:
            break
        state = state.drop("err")
    return state.select(F.col("src").alias("source"), "lam", "mean")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, ``size`` (words), ``source_size``,
    ``target``, ``rate`` (balanced rate, 0 to ``cap``), ``copies`` (0 to
    ``cap``) and ``taken`` (copies * size). Repeated runs agree.

    NULL text has size 0; NULL is a source of its own; documents of size 0
    keep one copy, which takes no words. Repeated rows are separate documents.
    Rounding: (source, size) cells are dealt into sub-cells of about CELL_ROWS
    documents by a hash of the id, so a size that a third of all rows share is
    many small groups; running sums of the expected copies, from long to
    short documents within a band of sizes, are rounded, so a band is at most
    half of its longest document off; what is left of each source is then
    evened out by single documents that fit the rest.
    """
    base = keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                            word_count(text_col).alias("size")), "mix-sizes")
    cells = keep(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    totals = cells.select("source", "size", "n")
    targets = keep(_targets_of_cells(totals, weights, cap), "mix-targets")
    dual = solve_rates(cells, targets, cap)

    rated = (cells.join(dual.withColumnRenamed("source", "_src"), cells["source"].eqNullSafe(F.col("_src")))
             .withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam").isNull(), F.lit(float(cap)))
                         .otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0))))))
             .select(F.col("source").alias("_src"), F.col("size").alias("_size"), "rate",
                     F.ceil(F.col("n") / CELL_ROWS).alias("deal")))
    rows = (base.join(rated, base["source"].eqNullSafe(rated["_src"]) & (base["size"] == rated["_size"]))
            .select("id", "source", "size", "rate", F.expr("pmod(xxhash64(id, 17), deal)").alias("salt")))
    cell = ["source", "size", "salt"]
    sub = rows.groupBy(*cell, "rate").agg(F.count(F.lit(1)).alias("n"))
    band = Window.partitionBy("source", F.length(F.bin("size"))).orderBy(F.desc("size"), "salt")
    run = F.sum(F.col("n") * F.col("rate")).over(band.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sub = (sub.withColumn("run", run)
           .withColumn("units", F.greatest(F.lit(0), F.least(F.col("n") * cap,
                       F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("n") * F.col("rate") + 0.5))).cast("long"))
           .select(*cell, "n", "rate", "units"))
    sub = keep(sub, "mix-units")
    for _ in range(4):
        sub = keep(_even_out(sub, targets, cap), "mix-units")

    targets = targets.select(F.col("source").alias("_t"), "source_size", "target")
    plan = sub.join(targets, sub["source"].eqNullSafe(targets["_t"])).select(
        *[F.col(c).alias(f"_{c}") for c in cell], F.col("n").alias("_n"), F.col("units").alias("_units"), "source_size", "target")
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["_source"]) & (rows["size"] == plan["_size"])
                     & (rows["salt"] == plan["_salt"]))
    turn = F.row_number().over(Window.partitionBy(*cell).orderBy(F.xxhash64("id", F.lit(29)), "id"))
    copies = F.floor(F.col("_units") / F.col("_n")) + (turn <= F.col("_units") % F.col("_n")).cast("long")
    out = rows.withColumn("copies", copies.cast("long"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its ``copies`` say
    (``copy`` counts from 1), with all its columns, ``size``, ``target`` (its
    source's) and ``copies``; columns of these names are replaced. Rows with
    equal id and text take equal copies."""
    rows = docs.withColumn("_th", F.xxhash64(text_col)).withColumn("_key", F.struct(id_col, "_th"))
    plan = mix(rows, weights, cap, "_key", text_col, source_col)
    plan = keep(plan.groupBy("_key").agg(*[F.max(c).alias(c) for c in ("size", "target", "copies")])
                .where("copies > 0").select(F.col(f"_key.{id_col}").alias("_pid"), F.col("_key._th").alias("_pth"),
                                            F.col("size").alias("_size"), F.col("target").alias("_target"), F.col("copies").alias("_copies")), "mix-plan")
    out = rows.join(plan, rows[id_col].eqNullSafe(plan["_pid"]) & (rows["_th"] == plan["_pth"]))
    new = ("size", "target", "copies", "copy")
    return out.select(*[out[c] for c in docs.columns if c not in new], F.col("_size").alias("size"), F.col("_target").alias("target"),
                      F.col("_copies").alias("copies"), F.explode(F.expr("sequence(1, cast(_copies AS int))")).alias("copy"))


def _targets_of_cells(cells: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """source_targets over (source, size, n) cells."""
    src = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("docs"))
    return (source_targets(src, weights, cap).drop("n")
            .join(src.select(F.col("source").alias("_s"), F.col("docs").alias("n")),
                  F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))


def _even_out(sub: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """Give or take copies of the longest documents that fit what each source
    is still off its target, in one sub-cell a source."""
    got = sub.groupBy("source").agg(F.sum(F.col("units") * F.col("size")).alias("got"))
    off = (got.join(targets.select(F.col("source").alias("_t"), "target"), F.col("source").eqNullSafe(F.col("_t")))
           .select(F.col("source").alias("_os"), (F.col("target") - F.col("got")).alias("off")))
    room = F.when(F.col("off") > 0, F.col("n") * cap - F.col("units")).otherwise(F.col("units"))
    fit = (sub.join(off, F.col("source").eqNullSafe(F.col("_os")))
           .withColumn("k", F.least(room, F.floor(F.abs("off") / F.col("size"))))
           .where("size > 0 AND k > 0")
           .groupBy("source").agg(F.max(F.struct("size", "salt", (F.col("k") * F.signum("off")).cast("long").alias("k"))).alias("pick"))
           .select(F.col("source").alias("_ps"), "pick.size", "pick.salt", "pick.k"))
    fit = fit.select("_ps", F.col("size").alias("_pz"), F.col("salt").alias("_pt"), "k")
    return (sub.join(fit, sub["source"].eqNullSafe(fit["_ps"]) & (sub["size"] == fit["_pz"]) & (sub["salt"] == fit["_pt"]), "left")
            .select("source", "size", "salt", "n", "rate", (F.col("units") + F.coalesce("k", F.lit(0))).alias("units")))


def op1_mix_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
