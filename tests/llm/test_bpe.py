"""Operator 12 against the tokenizers library on the same vocabulary file."""

import hashlib
import json
import os

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from triagelake.llm import op12_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(texts, v=None):
    enc = B.Encoder(v or B.vocabulary(B.read_vocabulary(PATH)))
    idx, of = enc.take([None if t is None else t.encode() for t in texts])
    enc.settle()
    flat, n = enc.ids(idx, of, len(texts))
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


HARD = ["", " ", "a<|endoftext|>b<|endoftext|><|endoftext|>  c  ", "<|endoftext|>", "<|endoftext", "aaaaaaaaaaaaaaa" * 9, "  \n\n \t x  ", "it's 'S 'll",
        "abcabcabc" * 300, "  x　", "ünïcödé 你好 🙂 ՘٠½", "\x00\x1c\x85", "x" * 5000 + " " * 3000 + "7" * 2000]


@pytest.mark.parametrize("many", [1, 48, 1 << 60])
def test_hard_texts_by_array_and_by_position(lib, monkeypatch, many):
    monkeypatch.setattr(B, "MANY", many)
    assert ids_of(HARD) == [e.ids for e in lib.encode_batch(HARD, add_special_tokens=False)]


def test_every_code_point(lib):
    enc = B.Encoder(B.vocabulary(B.read_vocabulary(PATH)))
    texts = [f"a{chr(c)}b 1{chr(c)}2  {chr(c)}\n {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for s in range(0, len(texts), 50_000):
        part = texts[s:s + 50_000]
        idx, of = enc.take([t.encode() for t in part])
        enc.settle()
        flat, n = enc.ids(idx, of, len(part))
        want = [e.ids for e in lib.encode_batch(part, add_special_tokens=False)]
        assert flat.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 'st\n1.é<|endoftx>"), max_size=60), max_size=5))
def test_any_text(texts):
    lib = Tokenizer.from_file(PATH)
    texts = [*texts, "<|endoftext|>".join(texts)]
    assert ids_of(texts) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_pieces_of_long_texts(lib, monkeypatch):
    monkeypatch.setattr(B, "PIECE_CHARS", 7)
    texts = ["some words, 12 and more 'll do\n\n  ok " * 20, "nocuthere" * 30, "a b c d e f g h i j k l m n o p", "x <|endoftext|> some more words here"]
    assert ids_of(texts) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_other_ranks_and_files():
    spec = json.load(open(PATH))
    spec["model"]["merges"] = [["a", "b"], ["b", "a"], ["ab", "a"], ["ab", "ab"], ["a", "a"]]
    spec["model"]["vocab"] = {**{c: i for i, c in enumerate(B.byte_symbols())}, "ab": 256, "ba": 257, "aba": 258, "abab": 259, "aa": 260}
    spec["added_tokens"] = []
    texts = ["abababa", "aaaaa", "babab", "aab aba", "b"]
    want = Tokenizer.from_str(json.dumps(spec)).encode_batch(texts, add_special_tokens=False)
    assert ids_of(texts, B.Vocabulary(json.dumps(spec).encode())) == [e.ids for e in want]
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"decoder": None}):
        with pytest.raises(ValueError):
            B.Vocabulary(json.dumps({**spec, **change}).encode())


def test_rows_of_any_kind(spark, lib):
    texts = [*HARD, None, None, "same", "same", "long text " * 30_000]
    rows = [(i % 4 if i % 5 else None, t, "x", i, "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded long, _text string").repartition(3)
    vocab = B.read_vocabulary(PATH)
    out = B.decode(B.encode(df, vocab), vocab)
    assert out.columns == ["doc_id", "text", "_text", "ids", "decoded"]  # a column of the result's name is replaced
    got = [(r["text"], r["ids"], r["decoded"]) for r in out.collect()]
    assert len(got) == len(rows)
    for text, ids, back in got:
        assert ids == lib.encode(text or "", add_special_tokens=False).ids and back == (text or "")
    assert B.decode(B.encode(df.where("false"), vocab), vocab).count() == 0


def test_decoding_ids_as_they_come(spark, lib):
    lists = [[], None, [50256, 0, 50256], [220, 98, 99, 100], [None, 0, 60_000, -5, 1], [10, 188, 255, 94]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>")
    got = {r["i"]: r["decoded"] for r in B.decode(df, B.read_vocabulary(PATH)).collect()}
    for i, x in enumerate(lists):
        fine = [t for t in x or [] if t is not None and 0 <= t < 50257]
        assert got[i] == lib.decode(fine, skip_special_tokens=False)


def test_query_against_the_library(spark, sf_small, lib):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(os.path.join(sf_small, "documents.parquet")).select("doc_id", "text").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = B.op12_bpe_codec(spark, sf_small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_one_pass_without_shuffle(spark, sf_small):
    plan = B.op12_bpe_codec(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
