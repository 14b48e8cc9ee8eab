"""CSV in byte ranges against the reader that takes one task per file."""

import csv
import io
import random

import pytest

from triagelake.sources import csv_ranges, files


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "1")]
    for k, v in old.items():
        spark.conf.set(k, v)


VALUES = ["plain", "", "a,b", 'say "hi"', "two\nlines", '"\n"', "\n\n,\n", "ünï", " lead", "trail ", '""', "x" * 90, "q\"\nw\"\ne", "1", ",", 'ends with "', "\nstarts"]


def written(path, rows, newline="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(["id", "text", "more"])
        w.writerows(rows)


@pytest.mark.parametrize("size", [60, 333, 100_000])
def test_records_are_the_csv_modules(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    want = []
    for f in range(2):
        rows = [[str(i), rng.choice(VALUES), rng.choice(VALUES)] for i in range(120)]
        written(tmp_path / f"{f}.csv", rows)
        want += rows
    small_ranges(size)
    lines = csv_ranges._lines(spark, str(tmp_path))
    if size < 100:
        assert lines.rdd.getNumPartitions() > 50
    got = csv_ranges.csv_records(spark, str(tmp_path)).collect()
    assert sum(r["first"] for r in got) == 2
    assert sorted(next(csv.reader(io.StringIO(r["record"], newline=""))) for r in got if not r["first"]) == sorted(want)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_equal_to_the_reader_of_whole_files(spark, tmp_path, small_ranges, newline):
    rng = random.Random(1)
    path = str(tmp_path / "f.csv")
    written(path, [[str(i), rng.choice(VALUES), rng.choice(VALUES)] for i in range(400)], newline)
    whole = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    want = sorted([tuple(r) for r in whole.collect()], key=str)
    small_ranges(300)
    got = files.read_csv(spark, path)
    assert got.columns == whole.columns
    assert sorted([tuple(r) for r in got.collect()], key=str) == want


def test_round_trip_through_the_sink(spark, tmp_path, small_ranges):
    rows = [(i, VALUES[i % len(VALUES)], None if i % 5 == 0 else VALUES[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, `more text` string").repartition(3)
    files.write_csv(df, str(tmp_path / "out"))
    small_ranges(100)
    got = files.read_csv(spark, str(tmp_path / "out"), df.schema)
    # an empty value is read as NULL, as Spark's reader does
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([tuple(v if v != "" else None for v in r) for r in rows], key=str)
    by_header = files.read_csv(spark, str(tmp_path / "out"))
    assert by_header.columns == ["id", "text", "more text"] and by_header.count() == 300


def test_empty_files_and_one_long_record(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "a.csv")).count() == 0
    long = "line\n" * 500
    written(tmp_path / "b.csv", [["1", long, "end"], ["2", "x", "y"]])
    small_ranges(50)
    got = files.read_csv(spark, str(tmp_path / "b.csv")).collect()
    assert sorted(tuple(r) for r in got) == [("1", long, "end"), ("2", "x", "y")]
    (tmp_path / "c.csv").write_text("﻿id,text\n1,a\n\n2,b")  # BOM, empty line, no last newline
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "c.csv")).collect()) == [("1", "a"), ("2", "b")]
