import os
import random

import pyarrow as pa
import pyarrow.parquet  # noqa: F401
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terracell.llm import tokens

path = tokens.default_path()
pytestmark = pytest.mark.skipif(not os.path.exists(path), reason="no vocabulary files")
ODD = [
    None, "", " ", "  \n ", "<|endoftext|> x", "it's we'll 's 'S ''s l'été", "a\x1cb\x85 c", "日本語 اب 😀😀", "aaaa aaa", "-" * 4000,
    "ab" * 3000, "x y  z", "1234567 ½²³", "é́", "\r\n\r\n\tq",
]


@pytest.fixture(scope="module")
def library():
    tk = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    return lambda t: tk.encode(t or "", add_special_tokens=False).ids


def encoded(texts):
    ids, n = tokens.encoder_of(tokens.vocabulary(path)).encode(pa.array(texts, pa.string()))
    out, at = [], 0
    for k in n.tolist():
        out.append(ids[at : at + k].tolist())
        at += k
    return out


def test_documents_match_the_library(spark, sf, library):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text").collect()}
    want = {r.doc_id: library(r.text) for r in df.collect()}
    assert got == want
    counts = {r.doc_id: r.tokens for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert counts == {k: len(v) for k, v in want.items()}


def test_odd_texts(library):
    assert encoded(ODD) == [library(t) for t in ODD]
    assert encoded([]) == []


@given(st.lists(st.text(st.sampled_from("ab'sreLl tmd\n 12½é-._ 　😀")), max_size=20))
@settings(max_examples=60, deadline=None)
def test_any_text_matches(library, texts):
    assert encoded(texts) == [library(t) for t in texts]


def test_words_without_end(library, sf):
    """Long words are cut and encoded in the memory given, and still equal the library's."""
    rng = random.Random(3)
    docs = pa.parquet.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    run = "".join(c for t in docs for c in t or "" if c.isalpha())[:60_000]
    code = "".join(rng.choice("ABCDEFGHabcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    texts = [run, code, "x " + "a" * 70_001 + " y", "日本語の文字" * 5_000, "é" * 999, "short"]
    assert encoded(texts) == [library(t) for t in texts]


@given(st.text(st.sampled_from("abcdethinosr"), min_size=65, max_size=400))
@settings(max_examples=60, deadline=None)
def test_any_long_word_matches(library, word):
    assert encoded([word, "a " + word]) == [library(word), library("a " + word)]


def test_nothing_is_spilled(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    tokens.Encoder(tokens.vocabulary(path)).learn(["ab" * 200_000])
    assert os.listdir(tmp_path) == []


def test_words_match_the_pattern():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab'sreLl tmd\n 12½é-._ ") for _ in range(rng.randint(1, 15)))
        points, row = tokens.to_codepoints(pa.array([text]))
        starts = tokens.word_starts(points, row).nonzero()[0].tolist()
        words = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        assert words == tokens._WORD.findall(text)


def test_round_trip_and_columns(spark):
    df = spark.createDataFrame([(k, t, [1], "x") for k, t in enumerate(ODD)], "doc_id bigint, text string, ids array<int>, __text string")
    back = tokens.decode(tokens.encode(df, "doc_id", "text"), "doc_id", "ids")
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(ODD)}
    assert tokens.encode(df.limit(0), "doc_id", "text").collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert tokens.decode(none, "doc_id", "ids").first().text is None


def test_word_cache_starts_anew(monkeypatch, library):
    monkeypatch.setattr(tokens, "MOST_WORDS", 2)
    assert encoded(["one two three"]) == [library("one two three")]
    assert encoded(["four one five"]) == [library("four one five")]
