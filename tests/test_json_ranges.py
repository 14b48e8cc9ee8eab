"""Export documents in byte ranges against the json module."""

import json
import random

import pytest

from test_csv_ranges import small_ranges  # noqa: F401
from triagelake.operators import corpus as P
from triagelake.sources import files, json_ranges

STRINGS = ["plain", "", "}", "{", '"', "\\", '\\"}', "[{}]", "a\nb", "ünï", "x" * 70, "result", "}}}]"]


def value(rng, deep=0):
    kind = rng.randint(0, 5 if deep < 3 else 2)
    if kind <= 2:
        return [rng.choice(STRINGS), rng.randint(0, 99), None][kind]
    if kind == 3:
        return [value(rng, deep + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(STRINGS): value(rng, deep + 1) for _ in range(rng.randint(0, 3))}


def documents(seed):
    rng = random.Random(seed)
    out = []
    for n in range(4):
        items = [{rng.choice(STRINGS): value(rng, 1), "id": i, "v": value(rng, 1)} for i in range(rng.choice([0, 1, 40]))]
        doc = {"meta": value(rng), "other": [{"no": 1}, {"no": 2}], "note": "} result ["}
        out.append({**doc, "result": items, "after": {"deep": {"x": {}}, "list": [{"no": 3}]}} if n else {"result": items})
    return out


@pytest.mark.parametrize("size", [150, 1500, 1_000_000])
def test_objects_are_the_json_modules(spark, tmp_path, small_ranges, size):  # noqa: F811
    docs, want = documents(size), []
    for n, doc in enumerate(docs):
        (tmp_path / f"{n}.json").write_text(json.dumps(doc, indent=n % 2 or None, ensure_ascii=n < 2) + "\n" * n)
        want += [json.dumps(r, sort_keys=True) for r in doc["result"]]
    small_ranges(size)
    if size < 200:
        assert json_ranges._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    got = json_ranges.array_objects(spark, str(tmp_path)).collect()
    assert sorted(json.dumps(json.loads(r["r"]), sort_keys=True) for r in got) == sorted(want)


def test_equal_to_whole_documents(spark, tmp_path, small_ranges):  # noqa: F811
    rng = random.Random(2)
    items = [{k: rng.choice(["<p>a } b</p>", "t & u", None, "{x}"]) for k in ("short_description", "article_body", "category") if rng.random() < 0.8} for _ in range(300)]
    (tmp_path / "one.json").write_text(json.dumps({"result": items}))
    whole = P.kb_export_rows(spark.read.text(str(tmp_path), wholetext=True))
    want = sorted([tuple(r) for r in whole.collect()], key=str)
    small_ranges(600)
    assert sorted([tuple(r) for r in files.read_kb_export(spark, str(tmp_path)).collect()], key=str) == want and len(want) == 300


@pytest.mark.parametrize("text", ["", "{}", '{"result": []}', "[]", '[{"result": [{"a": 1}]}]', '{"result": {"a": {"b": 1}}}', '{"result": null, "x": [{"a": 1}]}'])
def test_documents_without_rows(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert json_ranges.array_objects(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("step", [1, 2, 3, 7, 50])
def test_cut_of_ranges_of_any_length(step):
    """The second pass alone, with ranges of ``step`` pieces and true states."""
    import pyarrow as pa
    extra = {"total": {"of": [{"x": 1}]}, "result": [{"a": 1}, [1, {"q": 2}], {"b": [{"c": 1}]}], "z": [{"n": 1}]}
    for doc in [d for s in range(8) for d in documents(s)] + [extra]:
        pieces, inside, depth, rows = json.dumps(doc).split("}"), False, 0, []
        for i in range(0, len(pieces), step):
            rows += [("f", i, inside, depth, p) for p in pieces[i:i + step]]
            for p in pieces[i:i + step]:
                inside, d = json_ranges.after(p, inside)
                depth += d
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "start", "inside", "depth", "value"])
        found = sorted((r for b in json_ranges._cut("result")(iter([batch])) for r in b.to_pylist()), key=lambda r: (r["start"], r["kind"]))
        before, got, owner = False, [], None
        for r in found:
            mine = before if r["mine"] is None else r["mine"]
            if r["kind"] == json_ranges.WHOLE:
                got.append([mine, r["part"]])
            elif r["kind"] == json_ranges.OPEN:
                owner = [mine, r["part"]]
                got.append(owner)
            elif r["kind"] == json_ranges.GOES_ON:
                owner[1] += r["part"]
            else:
                before = mine
        assert sorted(str(json.loads(p)) for m, p in got if m) == sorted(str(r) for r in doc["result"] if isinstance(r, dict))
