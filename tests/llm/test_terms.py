from collections import Counter

import regex

from terracell.llm import terms
from tests.conftest import rows

SCHEMA = "t string, u string, field string, term string, records int"


def frame(spark, texts):
    return spark.createDataFrame([(t, u, "f", "x", 1) for t, u in texts], SCHEMA)


def brute(texts, k, field):
    n, r = Counter(), Counter()
    for row in texts:
        words = regex.findall(r"[\p{L}\p{M}\p{N}]+", (row[k] or "").lower())
        n.update(words)
        r.update(set(words))
    return [(field, w, n[w], r[w]) for w in n]


TEXTS = [("Oak oak ASH", "a b a"), (None, None), ("", " "), ("oak", "a"), ("oak", "a"), ("É1 é1 e2", "x" * 300_000), ("d'oak-ash", "½ É")]


def test_counts_match_brute_force(spark):
    got = terms.term_counts(frame(spark, TEXTS).repartition(3), {"t": "one", "u": "two"})
    assert rows(got) == sorted(brute(TEXTS, 0, "one") + brute(TEXTS, 1, "two"), key=repr)


def test_flushing_counts_no_record_twice(spark, monkeypatch):
    monkeypatch.setattr(terms, "FLUSH_TERMS", 0)
    got = terms.term_counts(frame(spark, TEXTS * 5).coalesce(1), {"t": "one"})
    assert rows(got) == sorted(brute(TEXTS * 5, 0, "one"), key=repr)


def test_marks(spark):
    df = frame(spark, [("common", None)] * 20 + [("some", None)] * 3 + [("few", None)] * 2 + [(None, None)] * 50)
    counts = terms.marked_terms(terms.term_counts(df, {"t": "f"}), terms.field_sizes(df, {"t": "f"}), 2, 0.3)
    assert rows(counts.select("term", "mark")) == [("common", "common"), ("few", "rare"), ("some", None)]


def test_empty(spark):
    df = frame(spark, [])
    assert rows(terms.marked_terms(terms.term_counts(df, {"t": "f"}), terms.field_sizes(df, {"t": "f"}))) == []
