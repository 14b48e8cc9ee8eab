"""Mixing, language, decontamination, toxicity, URL, licence and chat operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.llm import op1_mixing as o1
from triagelake.llm import op2_language as o2
from triagelake.llm import op3_wu_manber as o3
from triagelake.llm import op5_toxicity as o5
from triagelake.llm import op7_url_tree as o7
from triagelake.llm import op8_license as o8
from triagelake.llm import op9_chat as o9
from triagelake.llm.common import read

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(None, None, None, None, None), (None, "no id here", "en", "s", 1), (1, None, "en", "a", 0), (2, "", "de", None, 0),
        (3, " \n\t", None, "a", 3), (4, "twice the same row", "en", "a", 9), (4, "twice the same row", "en", "a", 9),
        (5, "long " * 30_000, "en", "b", 9), (6, "12 34", "en", "b", 5), (7, "é ü 中文 🙂", "fr", "b", 5)]
#: Columns of the same names as the operators' own.
CLASH = ["size", "target", "_id", "_th", "_text", "score", "n", "node", "component_id", "spans", "text_hash", "_src", "runs", "u", "v"]


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def edge(spark):
    return clashing(spark.createDataFrame(EDGE, DOCS))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- mixing --------------------------------------------------------------------

def water_fill(sizes, weights, cap):
    """Share, clip, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), sum(sizes.values())
    while free:
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s] + 1e-9}
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
        free -= over
    return out


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * min(3000, int(rng.paretovariate(1) * 20)), "en", rng.choice(["a"] * 30 + ["b"] * 9 + ["é", "Z", "c", None]), 1)
            for i in range(1500)]
    got = o1.mix(spark.createDataFrame(rows, DOCS)).collect()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(r[1].split())
    want = water_fill(size, o1.WEIGHTS, o1.CAP)
    source = {r[0]: r[3] for r in rows}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size and -1e-9 <= r.rate <= 3
        taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]) for s in want), (taken, want)
    # the rates are the exponential family's: their logarithm is linear in size, below the cap
    a = sorted((r.size, r.rate) for r in got if source[r.doc_id] == "a" and 0 < r.rate < 2.999 and r.size)
    slope = {round(np.log(y) / x, 9) for x, y in a}
    assert len(slope) == 1
    again = {r.doc_id: r.copies for r in o1.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(5)).collect()}
    assert again == {r.doc_id: r.copies for r in got}


def test_mixing_edges(spark, edge, none):
    got = o1.mix(edge).collect()
    assert len(got) == len(EDGE) and all(r.taken <= 3 * r.size for r in got)
    assert {r["size"] for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert o1.mix(none).count() == 0
    mixed = o1.mixed(spark.createDataFrame(EDGE, DOCS))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "target", "copies", "copy"]
    assert all(1 <= r["copy"] <= r.copies for r in mixed.collect())


def test_hot_cell_is_dealt_into_small_groups(spark):
    rows = [(i, "one two three", "en", "hot", 1) for i in range(2000)] + [(5000 + i, "w " * (i + 1), "en", "cold", 1) for i in range(50)]
    got = o1.mix(spark.createDataFrame(rows, DOCS)).collect()
    for s, test in (("hot", lambda r: r.doc_id < 5000), ("cold", lambda r: r.doc_id >= 5000)):
        part = [r for r in got if test(r)]
        assert sum(r.taken for r in part) == pytest.approx(part[0].target, abs=3), s


# ---- language ------------------------------------------------------------------

def test_language_held_out_accuracy(spark, sf_small):
    model = o2.learn(read(spark, sf_small, "documents", "doc_id", "text", "lang"))
    docs = read(spark, sf_small, "documents", "doc_id", "text", "lang")
    got = o2.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, edge, none):
    got = {(r.doc_id, r.held_out): r for r in o2.identify(edge, o2.learn(edge)).collect()}
    for i in (1, 2, 3, 6):
        assert [r.lang_pred for k, r in got.items() if k[0] == i] == ["und"]
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1 if i is not None else False) for i, h in got)
    assert o2.learn(none) is None and o2.identify(none, None).count() == 0
    assert {r.lang_pred for r in o2.identify(edge, None).collect()} == {"und"}


def test_presence_kernel_is_the_overlap_of_sets():
    a = np.array([[1, 1, 0, 1], [0, 0, 0, 0]], np.float32)
    assert o2.presence_kernel(a, a)[0, 0] == pytest.approx(1) and o2.presence_kernel(a, a)[1, 0] == 0


# ---- decontamination -----------------------------------------------------------

def brute_windows(docs, items, n=13):
    tokens = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower())
    out = []
    for i, t in docs:
        w = tokens(t)
        hit, found = set(), set()
        for item, it in items:
            iw = tokens(it)
            for s in range(max(1, len(iw) - n + 1)) if iw else ():
                win = iw[s:s + n]
                for a in range(len(w) - len(win) + 1):
                    if w[a:a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        found |= {str(item)} if item is not None else set()
        names = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pass_bytes", [32_000_000, 200])
def test_windows_match_brute_force(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(o3, "PASS_BYTES", pass_bytes)
    rng = random.Random(2)
    w = lambda n, k=4: " ".join(rng.choice("ab cd é9 X y".split()[:k]) for _ in range(n))
    items = [(1, w(20)), (2, w(13)), (3, w(3)), (10, "Ab"), (11, None), (12, "..!"), (None, w(5)), (3, w(15))]
    docs = [(i, w(rng.choice([0, 1, 5, 40, 700]), 5)) for i in range(25)]
    docs += [(100, "zz " + items[0][1].upper() + ", zz"), (101, None), (102, ""), (103, items[1][1]), (103, items[1][1]), (None, items[0][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = o3.decontaminate(clashing(d), clashing(b)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == brute_windows(docs, items)
    clean = o3.without_contaminated(d, b).collect()
    bad = {i for i, *_, c in brute_windows(docs, items) if c}
    assert sorted((r.doc_id for r in clean), key=repr) == sorted((i for i, _ in docs if i not in bad), key=repr)


def test_tables_of_many_items_are_bounded():
    rng = random.Random(0)
    size, matcher = {}, None
    for n in (80_000, 320_000):  # words of the items
        items = [(str(i), " ".join(rng.choice(VOCABULARY) for _ in range(100)).encode()) for i in range(n // 100)]
        items += items[:50]  # repeated items own the same strings
        matcher = o3.Matcher(items)
        size[n] = matcher.nbytes / sum(len(t) for _, t in items)
    assert all(x < 16 for x in size.values()), size  # bytes of arrays for a byte of text, whatever the size
    got = list(matcher.scan([items[7][1], b"none of these"]))
    assert got[0] == (100, [0, 100], ["7"]) and got[1] == (3, [], [])


def test_windows_of_one_hash_stay_apart(monkeypatch):
    words = np.array([1, 2, 1, 2, 3, 1, 2, 1, 2], np.int32)
    at = np.arange(8, dtype=np.int32)
    starts, of = o3.distinct_windows(words, at, 2)
    pairs = [tuple(words[a:a + 2]) for a in at]
    assert [tuple(words[starts[k]:starts[k] + 2]) for k in of] == pairs and len(starts) == len(set(pairs))


def test_windows_edges(spark, edge, none):
    b = spark.createDataFrame([], "item_id long, text string")
    got = o3.decontaminate(edge, b).collect()
    assert len(got) == len(EDGE) and not any(r.contaminated or r.n_hit for r in got)
    assert next(r.n_words for r in got if r.doc_id == 5) == 30_000
    assert o3.decontaminate(none, b).count() == 0


# ---- toxicity ------------------------------------------------------------------

def test_toxicity_held_out(spark):
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in "ba ce di fo gu ly".split() for b in "ran sel tim pod lun".split()]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.choice([5, 40, 300]))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "vilething", "awfulness"]))
        rows.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, DOCS)
    model = o5.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    got = [r for r in o5.score(docs, model).collect() if r.held_out]
    assert len(got) > 200
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = {r.doc_id for r in o5.without_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in o5.score(docs, model).collect() if not r.predicted}


def test_one_labelled_id_in_many_rows_is_learnt_from_once(spark, monkeypatch):
    seen = []
    fit = o5.fit_logistic
    monkeypatch.setattr(o5, "fit_logistic", lambda rows, cols, values, y, width: (seen.append(len(y)), fit(rows, cols, values, y, width))[1])
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = [(i, f"{'awful slur words ' if i % 2 else 'gentle kind words '}{i}") for i in ids] + [(ids[0], f"copy {n}") for n in range(30_000)]
    model = o5.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int"))
    assert seen == [len(ids)] and model.score(b"awful slur words") > 0.5 > model.score(b"gentle kind words")


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (1, 0), (6, 0)], "doc_id long, toxic int")
    model = o5.learn(edge, clashing(labels))
    assert len(o5.score(edge, model).collect()) == len(EDGE)
    nothing = o5.learn(none, labels.limit(0))
    assert {r.predicted for r in o5.score(edge, nothing).collect()} == {0}
    assert o5.score(none, model).count() == 0


def test_log_count_ratios_pull_rare_grams_to_zero():
    r = o5.log_count_ratios(np.array([0.0, 0, 500]), np.array([100.0, 1, 50]), 1000, 100)
    assert r[0] > r[1] > 0 and abs(r[2]) < 0.1


# ---- URLs ----------------------------------------------------------------------

def brute_rule(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for verdict, rule in o7.RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            fits.append((-len(rule), rule, verdict))
    return host, path, *(min(fits)[1:] if fits else (None, None))


def test_url_rules_and_verdicts(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/de/1", "https://example.com/de", "x://example.com/de/?q", "http://net",
            "http://net/", "http://a.net/x/y", "http://example.net/en/1", "http://b.example.net/en/2?x=/", "http://myexample.net/en/3",
            "http://q.org/fr/1", "http://q.org/fr", "http://h.org#/fr/", "http://h.org?/fr/", "a://b://c/d", "http://é.org/fr/é", "http://x.com/" + "a/" * 300]
    urls += [f"http://s.example.com/de/{i}.html" for i in range(40)] + [f"http://s.example.com/en/{i}" for i in range(40)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(1, urls[5])]
    got = o7.judge(clashing(spark.createDataFrame(rows, "page_id long, url string"))).collect()
    assert len(got) == len(rows)
    want = {}
    for i, u in rows:
        want.setdefault(i, []).append(brute_rule(u))
    for r in got:
        match = [w for w in want[r.page_id] if w[:3] == (r.host, r.path, r.rule)]
        assert match, r
        assert r.verdict in ("allow", "block") and (match[0][3] is None or r.verdict == match[0][3])
        if r.host == "s.example.com" and r.path.startswith("/en/"):
            assert r.verdict == "allow" and r.template == "/en/*"
    empty = o7.judge(spark.createDataFrame([], "page_id long, url string"))
    assert empty.count() == 0


def test_url_tree_rejects_what_shares_a_blocked_template(spark):
    # "/shop" pages: the rule blocks those of one prefix, their template also holds others
    rules = [("block", "h.com/shop/1")]
    rows = [(i, f"http://h.com/shop/{i}") for i in range(100, 200)] + [(500 + i, f"http://h.com/shop/2{i}") for i in range(10)]
    rows += [(900 + i, f"http://h.com/news/{i}") for i in range(50)]
    got = {r.page_id: r for r in o7.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()}
    assert all(got[500 + i].verdict == "block" and got[500 + i].rule is None for i in range(10))
    assert all(got[900 + i].verdict == "allow" for i in range(50))


VOCABULARY = [f"word{i}" for i in range(5000)]


# ---- licences ------------------------------------------------------------------

def test_licenses(spark, edge, none):
    mit = dict(o8.TEXTS)["MIT"]
    rows = [(1, mit), (2, mit.upper().replace("Copyright (c) <year> <copyright holders>", "(C) 2020 Someone").replace(",", " ,")),
            (3, "Intro.\nReleased under the MIT licence.\nEnd\nReleased under the MIT License."), (4, "nothing"), (5, None), (6, ""),
            (7, "Licensed under CC BY-NC 4.0.\nfoo"), (7, "Licensed under CC BY-NC 4.0.\nfoo"), (None, "Licensed under the Apache License, Version 2.0."),
            (8, "SPDX-License-Identifier: GPL-3.0\nThis work is licensed under the GNU General Public License, version 3.")]
    got = o8.scan_licenses(clashing(spark.createDataFrame(rows, "doc_id long, text string")), o8.known_licenses(spark)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].license == by[2].license == "MIT" and by[1].text_sha256 == by[2].text_sha256
    assert (by[3].license, by[3].n_notices, by[3].notices) == (None, 2, "MIT")
    assert (by[4].license, by[4].n_notices, by[4].notices, by[4].n_lines) == (None, 0, "", 1)
    assert by[5].text_sha256 == by[6].text_sha256 == hashlib.sha256(b"").hexdigest() and by[5].n_lines == 0
    assert (by[7].n_notices, by[7].notices) == (1, "CC-BY-NC-4.0")
    assert by[None].license == "Apache-2.0" and by[8].notices == "GPL-3.0" and by[8].n_notices == 2
    assert o8.scan_licenses(edge, o8.known_licenses(spark)).count() == len(EDGE)
    assert o8.scan_licenses(none, o8.known_licenses(spark)).count() == 0


def test_full_licenses(spark):
    texts = o8.full_texts()
    missing = {i for i, _ in o8.NAMES} - {i for i, _ in texts}
    assert missing == {"AGPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0"}  # as in the README
    rows = [(n, i, " ".join(text.upper().split(" "))) for n, (i, text) in enumerate(texts)]
    bsd = dict(texts)["BSD-2-Clause"]
    rows += [(1000, "BSD-2-Clause", bsd.replace("1. ", "* ").replace("2. ", "* ").replace("<year> <owner>", "2019, A. Person")),
             (1001, "MIT", dict(o8.TEXTS)["MIT"].replace("MIT License", "", 1)), (1002, None, dict(o8.TEXTS)["MIT"] + " And more.")]
    got = o8.scan_licenses(spark.createDataFrame([(n, t) for n, _, t in rows], "doc_id long, text string"), o8.known_licenses(spark)).collect()
    assert {r.doc_id: r.license for r in got} == {n: i for n, i, _ in rows}


# ---- chat ----------------------------------------------------------------------

def brute_path(model, feats):
    import itertools

    obs = model.lines(feats)
    best = None
    for path in itertools.product(range(o9.STATES), repeat=len(feats)):
        p, last = 0.0, o9.START
        for o, s in zip(obs, path):
            p += model.move[last, s] + o[s]
            last = s
        if best is None or p > best[0] + 1e-12:
            best = (p, path)
    return best


def test_chunked_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    seen = [rng.integers(0, 50, (o9.STATES, n)).astype(float) for n in o9.FEATURES.values()]
    model = o9.model_of(rng.integers(0, 30, (o9.STATES + 1, o9.STATES + 1)).astype(float), seen)
    feats = np.column_stack([rng.integers(0, n, 5) for n in o9.FEATURES.values()])
    want, path = brute_path(model, feats)
    a, b = o9.chunk_matrix(model, feats[:2]), o9.chunk_matrix(model, feats[2:])
    both = o9.step(a, b)
    assert both[o9.START].max() == pytest.approx(want)
    end = int(both[o9.START].argmax())
    mid = int((a[o9.START] + b[:, end]).argmax())
    assert [*o9.trace(model, feats[:2], o9.START, mid), *o9.trace(model, feats[2:], mid, end)] == list(path)


CHAT = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("combine", [1024, 2])
def test_chat_roles(spark, monkeypatch, combine):
    monkeypatch.setattr(o9, "CHUNK", 4)
    monkeypatch.setattr(o9, "COMBINE", combine)
    rng = random.Random(1)
    rows = []
    for c in range(120):
        for t in range(rng.choice([2, 5, 30])):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, "\n".join("word " * rng.randint(2, 5) + "?" if role == "user" else "answer text " * rng.randint(20, 40)
                                               for _ in range(rng.choice([1, 2])))))
    rows += [(900, 0, None, "User: hi\nthere\nAssistant: hello you\nHuman: thanks"), (901, 0, None, None), (902, 0, "user", ""),
             (None, None, "user", "x?"), (903, 1, "user", "same?"), (903, 1, "user", "same?")]
    got = o9.format_chats(clashing(spark.createDataFrame(rows, CHAT)).repartition(3)).collect()
    role = {(c, t): r for c, t, r, _ in rows}
    held = [r for r in got if r.conv_id is not None and r.conv_id < 900 and zlib.crc32(str(r.conv_id).encode()) % 3 == 1]
    assert sum(role[r.conv_id, r.first_pos] == r.role for r in held) >= 0.97 * len(held) > 50
    for c in (0, 5, 7):  # rendering keeps every line, in order
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.turn_no)
        assert [r.turn_no for r in mine] == list(range(1, len(mine) + 1))
        assert "\n".join(r.content for r in mine) == "\n".join(x[3] for x in sorted((x for x in rows if x[0] == c), key=lambda x: x[1]))
    chat = sorted((r for r in got if r.conv_id == 900), key=lambda r: r.turn_no)
    assert [(r.role, r.content) for r in chat] == [("user", "hi\nthere"), ("assistant", "hello you"), ("user", "thanks")]
    assert chat[0].rendered == "<|im_start|>user\nhi\nthere<|im_end|>"
    assert sum(r.n_lines for r in got if r.conv_id == 903) == 2


def test_chat_chunks_are_bounded_in_rows(spark):
    rows = [(1, t % 8, "user", f"text {t}") for t in range(700)] + [(2, None, "user", f"text {t % 3}") for t in range(500)]
    rows += [(None, t, "user", "x?") for t in range(300)] + [(3, 5, "user", "same") for _ in range(400)]
    blocks = o9.prepare(spark.createDataFrame(rows, CHAT).repartition(5), "conv_id", "turn", "text", "role").collect()
    sizes = {}
    for r in blocks:
        sizes[r._conv, r._chunk] = sizes.get((r._conv, r._chunk), 0) + 1
    assert len(blocks) == len(rows) and max(sizes.values()) <= o9.CHUNK
    assert sorted(r._ord for r in blocks) == list(range(len(rows)))
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in blocks if r._conv == conv), key=lambda r: r._ord)
        assert [r._opening for r in mine] == [True] + [False] * (len(mine) - 1)
        assert [r._chunk for r in mine] == sorted(r._chunk for r in mine)
        places = [-1 if r._pos is None else r._pos for r in mine]
        assert places == sorted(places)
    got = o9.format_chats(spark.createDataFrame(rows, CHAT)).collect()
    assert sum(r.n_lines for r in got) == len(rows)


def test_chat_without_rows(spark):
    assert o9.format_chats(spark.createDataFrame([], CHAT)).count() == 0
