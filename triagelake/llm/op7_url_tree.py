"""URL filters by path-template trees.

Per host, paths are cut into segments; variable segments become wildcards, so
paths fall together into templates. At every level, sibling branches that are
statistically alike in structure (what follows, how often, how many pages) and
in their labels are merged. A template is rejected if the blocked share of its
branch's labelled pages, smoothed level by level from the domain and the host
down, is high; a branch without labels has what its parent tells, pulled to the
prior by the share of the parent's pages that have none. Labels are the
verdicts of the rules; a page under a rule takes the rule's verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, read

#: (verdict, host and path prefix); a rule fits its host and all subdomains.
RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]
#: Levels of the tree; segments below the last level are one segment.
DEPTH = 6
#: A segment value stays literal if it has at least this share of its node's
#: pages, or this many of them.
LEAST_SHARE = 0.02
LEAST_PAGES = 50
#: Smoothing: pseudo-pages and the blocked share they are given.
PSEUDO = 4.0
PRIOR = 0.25
REJECT = 0.75
#: Two branches are alike if their shares and counts differ by less than this many standard errors.
ALIKE = 1.96
SCHEME = "://"


def url_host(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    after = F.regexp_replace(_rest(url), r"(?s)^[^/?#]*", "")
    return F.regexp_replace(after, r"(?s)[?#].*$", "")


def _rest(url: Column) -> Column:
    at = F.instr(url, SCHEME)
    return F.when(at > 0, F.substring(url, at + len(SCHEME), F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule (equal lengths: first in byte order) or NULL."""
    best = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), [-b for b in r[1].encode()])):  # the last that fits stays
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        best = F.when(fits, F.lit(rule)).otherwise(best)
    return best


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, name in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _generic(segment: Column) -> Column:
    """Numbers and long hexadecimal runs inside a segment become '*': they
    never name a branch."""
    s = F.regexp_replace(segment, r"(?i)\b[0-9a-f]{8}(-?[0-9a-f]{4}){3}-?[0-9a-f]{12}\b", "*")
    s = F.regexp_replace(s, r"(?i)\b(?=[a-f]*[0-9])[0-9a-f]{8,}\b", "*")
    return F.regexp_replace(s, r"[0-9]+", "*")


def templates(paths: DataFrame) -> DataFrame:
    """``host``, ``raw`` (path with generic segments), ``n``, ``blocked``,
    ``labelled`` -> the same rows with ``nodes``: the template's prefixes, one
    per level. Level by level, a segment value with few of its node's pages
    becomes a wildcard."""
    tree = (paths.withColumn("seg", F.filter(F.split("raw", "/", DEPTH + 1), lambda x: x != ""))
            .withColumn("node", F.lit("")).withColumn("nodes", F.array().cast("array<string>")))
    for level in range(1, DEPTH + 1):
        value = F.try_element_at(F.col("seg"), F.lit(level))
        tree = tree.withColumn("value", value)
        child = tree.where("value IS NOT NULL").groupBy("host", "node", "value").agg(F.sum("n").alias("cn"))
        total = child.groupBy("host", "node").agg(F.sum("cn").alias("tn"), F.max("cn").alias("mx"))
        named = (child.join(total, ["host", "node"])
                 .where((F.col("cn") >= LEAST_SHARE * F.col("tn")) | (F.col("cn") >= LEAST_PAGES))
                 .select("host", "node", F.col("value").alias("literal")))
        named = named.select(F.col("host").alias("_h"), F.col("node").alias("_n"), "literal")
        tree = tree.join(named, (tree["host"] == named["_h"]) & (tree["node"] == named["_n"]) & (tree["value"] == named["literal"]), "left")
        step = F.concat(F.col("node"), F.lit("/"), F.coalesce("literal", F.lit("*")))
        tree = (tree.withColumn("nodes", F.when(F.col("value").isNull(), F.col("nodes")).otherwise(F.array_append("nodes", step)))
                .withColumn("node", F.when(F.col("value").isNull(), F.col("node")).otherwise(step))
                .drop("value", "literal", "_h", "_n"))
        tree = keep(tree, "url-level") if level % 3 == 0 else tree
    return tree.drop("seg")


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _evidence(purity: Column, labelled: Column, n: Column) -> Column:
    """What a branch tells its children: its purity, pulled to PRIOR by the
    share of its pages that have no label."""
    covered = labelled / n
    return covered * purity + (1 - covered) * PRIOR


def _smoothed(blocked: Column, labelled: Column, above: Column) -> Column:
    return (blocked + PSEUDO * above) / (labelled + PSEUDO)


def alike(a: Column, b: Column) -> Column:
    """Whether two branches (n, labelled, blocked, wild, ends) are statistically
    alike: the shares of pages that go on with a whole wildcard, or end, differ by
    less than ALIKE standard errors, and so do the page counts and, if both
    have labels, the blocked shares."""
    def near(x: Column, nx: Column, y: Column, ny: Column) -> Column:
        both = (x + y) / (nx + ny)
        error = F.sqrt(both * (1 - both) * (1 / nx + 1 / ny)) + 0.5 * (1 / nx + 1 / ny)
        return F.abs(x / nx - y / ny) <= ALIKE * error
    labels = F.when((a["labelled"] > 0) & (b["labelled"] > 0), near(a["blocked"], a["labelled"], b["blocked"], b["labelled"])).otherwise(F.lit(True))
    return (near(a["wild"], a["n"], b["wild"], b["n"]) & near(a["ends"], a["n"], b["ends"], b["n"])
            & (F.abs(a["n"] - b["n"]) <= ALIKE * F.sqrt(a["n"] + b["n"])) & labels)


def branch_purity(tree: DataFrame) -> DataFrame:
    """``host``, ``node``, ``purity`` of every template: from the domain through
    the host and each level's merged branch, the blocked share of the branch's
    labelled pages, smoothed towards what stands above it.

    Level by level, the children of a branch stand in the order of their
    shares, page count and name; neighbours that are alike become one branch,
    and so do their children of one name. A branch is compared with two
    others, however many siblings it has."""
    counts = ["n", "labelled", "blocked"]
    sums = [F.sum(c).alias(c) for c in counts]
    whole = tree.groupBy("host").agg(*sums)
    domain = whole.groupBy(domain_of(F.col("host")).alias("_d")).agg(*sums)
    domain = domain.select("_d", _evidence(_smoothed(F.col("blocked"), F.col("labelled"), F.lit(PRIOR)), F.col("labelled"), F.col("n")).alias("above"))
    host = whole.join(domain, domain_of(F.col("host")) == F.col("_d"))
    host = host.withColumn("purity", _smoothed(F.col("blocked"), F.col("labelled"), F.col("above")))
    host = host.select(F.col("host").alias("_h"), "purity", _evidence(F.col("purity"), F.col("labelled"), F.col("n")).alias("above"))
    leaf = tree.groupBy("host", "node").agg(F.any_value("nodes").alias("nodes"), *sums)  # a template has one path
    # what a level adds to the path before it (the last level's segment may hold slashes)
    segs = F.transform("nodes", lambda x, i: F.substring(x, F.length(F.coalesce(F.get("nodes", i - 1), F.lit(""))) + 2, F.length(x)))
    state = leaf.select("host", "node", segs.alias("segs"), *counts, F.lit("").alias("branch"))
    state = keep(state.join(host, F.col("host") == F.col("_h")).drop("_h"), "url-branches")
    for level in range(1, DEPTH + 1):
        now = state.withColumn("seg", F.get("segs", F.lit(level - 1))).withColumn("next", F.coalesce(F.get("segs", F.lit(level)), F.lit("")))
        part = now.where("seg IS NOT NULL").groupBy("host", "branch", "seg").agg(
            *sums, F.sum(F.when(F.col("next") == "*", F.col("n")).otherwise(0)).alias("wild"),
            F.sum(F.when(F.col("next") == "", F.col("n")).otherwise(0)).alias("ends"))
        part = part.select("host", "branch", "seg", F.struct(*counts, "wild", "ends").alias("own"))
        siblings = Window.partitionBy("host", "branch").orderBy(
            F.round(F.col("own.wild") / F.col("own.n"), 1), F.round(F.col("own.ends") / F.col("own.n"), 1), "own.n", "seg")
        part = part.withColumn("before", F.lag("own").over(siblings))
        apart = F.when(F.coalesce(alike(F.col("own"), F.col("before")), F.lit(False)), 0).otherwise(1)
        part = part.withColumn("grp", F.sum(apart).over(siblings.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        merged = part.groupBy("host", "branch", "grp").agg(
            F.sum("own.n").alias("gn"), F.sum("own.labelled").alias("gl"), F.sum("own.blocked").alias("gb"), F.min("seg").alias("name"))
        part = part.select("host", "branch", "grp", "seg").join(merged, ["host", "branch", "grp"]).drop("grp")
        state = now.drop("next").join(part, ["host", "branch", "seg"], "left")
        purity = _smoothed(F.col("gb"), F.col("gl"), F.col("above"))
        has = F.col("gn").isNotNull()
        state = state.select("host", "node", "segs", *counts, F.when(has, F.concat("branch", F.lit("/"), F.col("name"))).otherwise(F.col("branch")).alias("branch"),
                             F.when(has, purity).otherwise(F.col("purity")).alias("purity"),
                             F.when(has, _evidence(purity, F.col("gl"), F.col("gn"))).otherwise(F.col("above")).alias("above"))
        state = keep(state, "url-branches") if level % 2 == 0 else state
    return state.select("host", "node", "purity")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (NULL if none
    fits), ``verdict``, ``template`` and ``purity`` of its branch.

    A NULL url or one without '://' has empty host and path; it is judged as
    such. Repeated rows count as pages and give repeated results. Pages are
    counted per (host, generic path) before anything is shuffled, so a host
    with a third of all pages is as small as its number of templates.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("ruled", verdict_of(F.col("rule"), rules)).withColumn(
        "raw", F.array_join(F.transform(F.split("path", "/"), _generic), "/"))
    paths = rows.groupBy("host", "raw").agg(
        F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    tree = keep(templates(keep(paths, "url-paths")), "url-tree")
    purity = branch_purity(tree)
    found = keep(tree.join(purity, ["host", "node"]).select(
        F.col("host").alias("_h"), F.col("raw").alias("_r"), F.col("node").alias("template"), "purity"), "url-purity")
    return (rows.join(found, (rows["host"] == found["_h"]) & (rows["raw"] == found["_r"]))
            .select(F.col("_id").alias(id_col), "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"),
                    "template", "purity"))


def op7_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages", "page_id", "url"))
