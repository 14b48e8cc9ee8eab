"""Operator 7's tree against a plain version over dicts."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from triagelake.llm import op7_url_tree as o7


def near(x, nx, y, ny):
    both = (x + y) / (nx + ny)
    error = math.sqrt(both * (1 - both) * (1 / nx + 1 / ny)) + 0.5 * (1 / nx + 1 / ny)
    return abs(x / nx - y / ny) <= o7.ALIKE * error


def alike(a, b):
    labels = near(a["b"], a["l"], b["b"], b["l"]) if a["l"] and b["l"] else True
    return near(a["w"], a["n"], b["w"], b["n"]) and near(a["e"], a["n"], b["e"], b["n"]) and abs(a["n"] - b["n"]) <= o7.ALIKE * math.sqrt(a["n"] + b["n"]) and labels


def smoothed(b, l, above):
    return (b + o7.PSEUDO * above) / (l + o7.PSEUDO)


def evidence(p, l, n):
    return l / n * p + (1 - l / n) * o7.PRIOR


def half_up(x):
    return math.floor(x * 10 + 0.5) / 10


def named_paths(rows):
    """rows: host, raw, n, labelled, blocked -> {(host, raw): named segments}, level by level."""
    segs = {}
    for host, raw, *_ in rows:
        parts = raw.split("/", o7.DEPTH)
        segs[host, raw] = [p for p in parts if p]
    out = {k: [] for k in segs}
    for level in range(o7.DEPTH):
        count = defaultdict(lambda: defaultdict(int))
        for host, raw, n, _, _ in rows:
            if level < len(segs[host, raw]):
                count[host, tuple(out[host, raw])][segs[host, raw][level]] += n
        named = {k: {v for v, c in vs.items() if c >= o7.LEAST_SHARE * sum(vs.values()) or c >= o7.LEAST_PAGES} for k, vs in count.items()}
        for host, raw, *_ in rows:
            if level < len(segs[host, raw]):
                v = segs[host, raw][level]
                out[host, raw] = out[host, raw] + [v if v in named[host, tuple(out[host, raw])] else "*"]
    return out


def brute(rows):
    """{(host, raw): purity}."""
    paths = named_paths(rows)
    host_sum, dom_sum = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0])
    for host, raw, n, l, b in rows:
        for t in (host_sum[host], dom_sum[".".join(host.split(".")[-2:])]):
            t[0] += n
            t[1] += l
            t[2] += b
    state = {}
    for host, raw, *_ in rows:
        n, l, b = dom_sum[".".join(host.split(".")[-2:])]
        above = evidence(smoothed(b, l, o7.PRIOR), l, n)
        n, l, b = host_sum[host]
        p = smoothed(b, l, above)
        state[host, raw] = ["", p, evidence(p, l, n)]
    for level in range(o7.DEPTH):
        own = defaultdict(lambda: defaultdict(lambda: dict(n=0, l=0, b=0, w=0, e=0)))
        for host, raw, n, l, b in rows:
            segs = paths[host, raw]
            if level < len(segs):
                o = own[host, state[host, raw][0]][segs[level]]
                after = segs[level + 1] if level + 1 < len(segs) else ""
                for k, v in (("n", n), ("l", l), ("b", b), ("w", n if after == "*" else 0), ("e", n if after == "" else 0)):
                    o[k] += v
        group = {}
        for key, children in own.items():
            order = sorted(children, key=lambda s: (half_up(children[s]["w"] / children[s]["n"]), half_up(children[s]["e"] / children[s]["n"]), children[s]["n"], s.encode()))
            runs = []
            for i, s in enumerate(order):
                if i and alike(children[s], children[order[i - 1]]):
                    runs[-1].append(s)
                else:
                    runs.append([s])
            for run in runs:
                total = [sum(children[s][k] for s in run) for k in "nlb"]
                for s in run:
                    group[(*key, s)] = (min(run, key=str.encode), total)
        for host, raw, *_ in rows:
            segs = paths[host, raw]
            if level < len(segs):
                st = state[host, raw]
                name, (n, l, b) = group[host, st[0], segs[level]]
                p = smoothed(b, l, st[2])
                state[host, raw] = [f"{st[0]}/{name}", p, evidence(p, l, n)]
    return {k: st[1] for k, st in state.items()}


def test_tree_is_the_plain_version(spark):
    rng = random.Random(5)
    hosts = ["a.example.com", "b.example.com", "example.org", "", "x.y.net"]
    rows = {}
    for _ in range(700):
        host = rng.choice(hosts)
        segs = [rng.choice(["de", "en", "fr", "*", "shop*", f"rare{rng.randint(0, 400)}", "*.html"]) for _ in range(rng.randint(0, 8))]
        raw = "/" + "/".join(segs)
        n = rng.choice([1, 1, 2, 5, 40])
        l = rng.choice([0, 0, n])
        rows[host, raw] = (host, raw, n, l, rng.choice([0, l]))
    rows = list(rows.values())
    df = spark.createDataFrame(rows, "host string, raw string, n long, labelled long, blocked long").repartition(4)
    tree = o7.templates(df)
    got = tree.join(o7.branch_purity(tree), ["host", "node"]).select("host", "raw", "purity").collect()
    # several spellings of a path ("//") are several rows of one template
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["purity"] - want[r["host"], r["raw"]]) < 1e-9, r


def test_a_branch_without_labels_is_judged_by_its_like(spark):
    # /de is blocked by the rule; /fr is like it, /en is much larger, /blog is of another structure
    rules = [("block", "h.com/de/")]
    urls = [f"http://h.com/de/{i}" for i in range(60)] + [f"http://h.com/fr/{i}" for i in range(62)] + [f"http://h.com/en/{i}" for i in range(600)]
    urls += [f"http://h.com/blog/x/y/{i}" for i in range(61)]
    got = o7.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules)
    verdicts = {tuple(r) for r in got.select(F.split("path", "/")[1], "verdict").distinct().collect()}
    assert verdicts == {("de", "block"), ("fr", "block"), ("en", "allow"), ("blog", "allow")}


def test_query_decides_pages_without_a_rule(spark):
    got = o7.op7_url_tree(spark, "/root/testdata/sf0.1").where("rule IS NULL").groupBy("verdict").count().collect()
    assert {r["verdict"] for r in got} == {"allow", "block"}
