"""Corpus build, ordinal, sources and sinks."""

import html
import json
import os
import tempfile
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triagelake import rules
from triagelake.functions.text import html_to_text, page_text, render
from triagelake.operators import corpus as P
from triagelake.sources import files
from triagelake.sources.sinks import manifest
from triagelake.sources.tables import read_table


class _Text(HTMLParser):
    """Text nodes joined by newline, script/style/comments skipped (stdlib)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def py_html_text(s):
    p = _Text()
    p.feed(s)
    p.close()
    return "\n".join(p.parts).strip()


def test_html_to_text_matches_stdlib_parser(spark, sf_small):
    pages = read_table(spark, sf_small, "pages").select("page_id", "html", html_to_text("html").alias("t")).collect()
    assert len(pages) > 0
    for r in pages:
        assert r["t"] == py_html_text(r["html"]), r["page_id"]


class _Nodes(HTMLParser):
    """Text nodes as they stand between tags, comments and declarations (stdlib)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.node, self.skip = [], [], 0

    def cut(self, *_):
        if any(self.node):
            self.nodes.append("".join(self.node))
        self.node = []

    handle_startendtag = handle_comment = handle_decl = unknown_decl = handle_pi = cut

    def handle_starttag(self, tag, attrs):
        self.cut()
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.cut()
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.node.append(data)


PIECES = ["<p>", "</p>", '<a href="x>y">', "<a title='a>b' b=\"c>d\" e=f>", "text ", "a & b", "&amp;", "&lt;x&gt;", "<br/>", "<!-- c > -->", "<!DOCTYPE html>",
          '<script>if (a<b) "</p>"</script>', "<style>x{}</style >", " < ", "<", "\n", ">", '"', "'", "<b x='>>' y=\"<\">", "<!---->", "<?php echo 1?>", "</ x>",
          '<img ' + "".join(f'a{i}="{i}>{i}" ' for i in range(9)) + ">", "é", '<a href=x"y>z</a>', '<SCRIPT type="a>b">z</Script>', '<div  a = "b>c"  >', "<p/ >"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_page_text_is_the_stdlib_parsers(pieces):
    page, p = "".join(pieces), _Nodes()
    p.feed(page)
    p.close()
    p.cut()
    assert page_text(page).strip() == "\n".join(p.nodes).strip()


@pytest.mark.parametrize("page", ['<a b="' * 100_000, "<b>" * 300_000, "<a ='" * 100_000 + "'", "<!--" * 200_000, "<script>" * 100_000, "<a " * 200_000, '<a x=">" ' * 100_000])
def test_page_text_is_linear(page):
    t0 = time.time()
    page_text(page)
    assert time.time() - t0 < 5


def test_entities_decoded_once(spark):
    df = spark.createDataFrame([("<p>a &amp;lt; b &copy; &quot;x&quot; &amp;</p>",)], "h string")
    assert df.select(html_to_text("h")).first()[0] == html.unescape("a &amp;lt; b &copy; &quot;x&quot; &amp;")


def test_clean_incidents_and_template(spark):
    df = spark.createDataFrame([("INC1", "Printer jam", None, None, None), ("INC2", None, "g", "c", "r"),
                                ("INC3", "", "g", "c", "r")], ", ".join(f"{c} string" for c in P.INCIDENT_COLUMNS))
    rows = {r["number"]: r for r in P.incident_training_text(P.clean_incidents(df)).collect()}
    assert set(rows) == {"INC1", "INC3"}                # NULL dropped, '' kept
    assert rows["INC1"]["training_text"] == ("Issue: Printer jam\nResolution: No resolution provided."
                                             "\nAssignment Group: Not Provided\nConfiguration Item: Not Provided")


def test_prepare_text_boundaries_and_code_points(spark):
    s10, s11 = "a" * 10, "b" * 11
    emoji = "x" * 1999 + "😀" + "tail"
    df = spark.createDataFrame([(1, s10), (2, s11), (3, None), (4, emoji)], "id long, training_text string")
    assert {r["id"]: r["training_text"] for r in P.prepare_text(df).collect()} == {2: s11, 4: emoji}
    rows = {r["id"]: r["training_text"] for r in P.prepare_text(df, max_chars=2000).collect()}
    assert set(rows) == {2, 4}
    assert rows[4] == emoji[:2000] and rows[4].endswith("😀")
    st = P.drop_stats(df).first()
    assert (st["n_before"], st["n_after"], st["n_dropped"]) == (4, 2, 2)


def test_require_columns_raises(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        P.prepare_text(df, "training_text")


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_dense_ordinal_independent_of_partitioning(spark, parts):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    got = P.dense_ordinal(df, ["k"], num_partitions=parts).collect()
    assert sorted((r["k"], r["ordinal"]) for r in got) == [(k, k + 1) for k in range(1000)]


def test_union_keeps_duplicates_and_missing_column_default(spark):
    inc = spark.createDataFrame([("INC1", "t")], "number string, training_text string")
    kb = spark.createDataFrame([(1, "t"), (2, "t")], "ordinal long, training_text string")
    u = P.union_corpus(P.incidents_to_corpus(inc), P.kb_to_corpus(kb)).collect()
    assert len(u) == 3
    assert u[0]["assignment_group"] == rules.NOT_PROVIDED and u[0]["category"] == rules.NOT_APPLICABLE
    assert {r["id"] for r in u[1:]} == {"KB_1", "KB_2"} and u[1]["category"] == ""


def test_kb_null_text_rendering(spark):
    df = spark.createDataFrame([("T", None)], "title string, body string")
    assert P.kb_training_text(df).first()["training_text"] == "Title: T\nContent: "
    assert P.kb_training_text(df, null_text="nan").first()["training_text"] == "Title: T\nContent: nan"
    assert df.select(render("{title}-{{x}}")).first()[0] == "T-{x}"


def test_csv_round_trip_multiline(spark):
    d = tempfile.mkdtemp(prefix="tl-csv-")
    rows = [("Where can I obtain\n\t\tupdates?", "", "a"), ('Say "hi"', "body", None)]
    df = spark.createDataFrame(rows, "title string, body string, category string")
    files.write_csv(df.coalesce(1), os.path.join(d, "kb"))
    back = files.read_csv(spark, os.path.join(d, "kb"), df.schema).collect()
    assert sorted((r[0], r[1] or "", r[2]) for r in back) == sorted((a, b, c) for a, b, c in rows)


def test_kb_export_json(spark):
    d = tempfile.mkdtemp(prefix="tl-json-")
    doc = {"result": [{"short_description": "A", "article_body": "<p>x &amp; y</p>", "category": "c"},
                      {"short_description": "B"}, {"short_description": "C", "category": None}]}
    with open(os.path.join(d, "page1.json"), "w") as f:
        json.dump(doc, f, indent=2)
    rows = sorted(files.read_kb_export(spark, d).collect(), key=lambda r: r['title'])
    assert rows[0]["body"] == "x & y" and rows[0]["category"] == "c"
    assert rows[1]["title"] == "B" and rows[1]["body"] == "" and rows[1]["category"] == ""
    assert rows[2]["title"] == "C" and rows[2]["category"] is None     # present null stays null


def test_parquet_sink_index_and_manifest(spark, sf_small):
    d = tempfile.mkdtemp(prefix="tl-pq-")
    e = read_table(spark, sf_small, "embeddings")
    files.write_parquet(e, os.path.join(d, "idx"))
    idx = files.load_index(spark, os.path.join(d, "idx"))
    m = manifest(idx, "embedding", "m").first()
    assert m["num_records"] == e.count() and m["embedding_dim"] == 64 and m["date_created"] is not None
    idx.unpersist()

    inc = spark.createDataFrame([("INC1", "a", None, None, None)],
                                ", ".join(f"{c} string" for c in P.INCIDENT_COLUMNS))
    inc.write.json(os.path.join(d, "inc"))
    assert files.read_incidents(spark, os.path.join(d, "inc"), "json").first()["number"] == "INC1"


def test_checkpoint_dir_uses_the_configured_folder(spark):
    from triagelake.session import checkpoint_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    d = checkpoint_dir(spark)
    if named:
        assert d == named                    # the cluster's shared folder, as named
    assert spark.sparkContext.getCheckpointDir() is not None
    assert checkpoint_dir(spark) == d        # stable across calls


def test_html_survives_hostile_pages(spark):
    from triagelake.functions.text import html_to_text
    pages = ["<b>" * 100_000 + "x", "<p title='x > y'>z</p>", '<a href="1>2" title="3>4">k</a>', "<p>a<script>b" * 2000,
             "&#233;&eacute;&amp;lt;&notit;&#x41;&nbsp;", "<!-- open", "a<br>b<br/><br>c", "x < y", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").repartition(3)
    got = {r["i"]: r["t"] for r in df.select("i", html_to_text("p").alias("t")).collect()}
    assert got[0] == "x" and got[1] == "z" and got[2] == "k" and got[3] == "a"
    assert got[4] == "éé&lt;¬it;A" and got[5] == "" and got[6] == "a\nb\nc" and got[7] == "x < y" and got[8] is None


def test_ordinal_offsets_by_position(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    got = [r["ordinal"] for r in P.dense_ordinal(df, ["k"], num_partitions=37).orderBy("k").collect()]
    assert got == list(range(1, 501))
