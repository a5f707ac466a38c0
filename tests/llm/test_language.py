import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terracell.llm import language


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_labels(spark):
    names = {"fr": "fr", "FR": "fr", "fr-FR": "fr", "French": "fr", " français ": "fr", "en_US": "en", "ger": "de", "dut": "nl", "xx": None, "??": None, "und": None, "": None, None: None, "unknown": None, "de-AT": "de"}
    df = spark.createDataFrame([(k,) for k in names], "label string")
    assert {r.label: r.named for r in df.withColumn("named", language.named_language(F.col("label"))).collect()} == names


def test_products_are_the_cosines_of_bundles():
    """The table adds up to what binding and bundling give directly."""
    counts = np.zeros((language.SYMBOLS**3, 2))
    rng = np.random.default_rng(0)
    counts[rng.integers(0, language.SYMBOLS**3, 50), rng.integers(0, 2, 50)] = rng.integers(1, 9, 50)
    d = 512
    table = language.products(counts, d)
    letter = language.letter_vectors(d)

    def bound(code):
        a, b, c = code // language.SYMBOLS**2, code // language.SYMBOLS % language.SYMBOLS, code % language.SYMBOLS
        return np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c]

    share = counts / counts.sum(0)
    weight = np.log1p(share * 20_000)
    weight = np.where((counts.sum(1) > 0)[:, None], weight - weight.mean(1, keepdims=True), 0)
    prototype = sum(weight[k][None, :] * bound(k)[:, None] for k in np.flatnonzero(counts.sum(1)))
    prototype /= np.linalg.norm(prototype, axis=0)
    some = rng.integers(0, language.SYMBOLS**3, 20)
    direct = np.stack([bound(k) @ prototype for k in some]) / np.sqrt(d)
    assert np.allclose(table[some], direct, atol=1e-3)


def test_held_out_accuracy(spark, documents):
    """Trained on one half of the labelled texts, right on the other (labels are wrong for about one text in twenty)."""
    train = documents.where("doc_id % 2 = 0")
    sample = language.training_sample(train, "doc_id", "text", "lang", 400)
    assert 0 < sample.count() <= 400
    table = language.train(sample)
    test = documents.where("doc_id % 2 = 1").withColumn("named", language.named_language(F.col("lang"))).where("named is not null and length(text) > 40").collect()
    units = language.Units(pa.array([r.text for r in test]))
    path = language.best_path(units.evidence(table), units.of, units.sentence)
    got = [language.LANGUAGES[np.bincount(path[units.of == k], weights=units.letters[units.of == k], minlength=7).argmax()] for k in range(len(test))]
    assert np.mean([g == r.named for g, r in zip(got, test, strict=True)]) > 0.9


MIXED = "Le ruisseau coule à moins de vingt mètres, mais la berge est trop humide. The stream runs less than twenty metres away, yet the bank is too wet for us. Le ruisseau coule encore un peu plus bas dans la vallée."


def test_segments_of_a_mixed_text(spark, documents):
    extra = [(10**9, MIXED), (10**9 + 1, None), (10**9 + 2, ""), (10**9 + 3, "12;13;0.5\n14;15;0.6"), (10**9 + 4, "Le ruisseau (no mushrooms at all) coule à moins de vingt mètres de la vieille grange."), (10**9 + 5, MIXED[:75] * 2000)]
    more = spark.createDataFrame(extra, "doc_id bigint, text string").withColumns({"lang": F.lit("xx"), "segment": F.lit(1), "letters": F.lit("q")})
    df = documents.select("doc_id", "text", "lang").withColumns({"segment": F.lit(1), "letters": F.lit("q")}).unionByName(more)
    found = {}
    for r in language.segments(df, "doc_id", "text", "lang", 600).where("doc_id >= 1000000000").orderBy("doc_id", "segment").collect():
        found.setdefault(r.doc_id - 10**9, []).append(r)
    assert [r.lang for r in found[0]] == ["fr", "en", "fr"]
    assert "".join(MIXED[r.begins : r.begins + r.characters] for r in found[0]) == MIXED
    assert 1 not in found and 2 not in found
    assert [(r.lang, r.confidence) for r in found[3]] == [(None, 0.0)]
    assert [r.lang for r in found[4]] == ["fr"] and [r.lang for r in found[5]] == ["fr"]
    main = {r.doc_id - 10**9: (r.lang_main, r.languages) for r in language.document_languages(df, language.segments(df, "doc_id", "text", "lang", 600), "doc_id").where("doc_id >= 1000000000").collect()}
    assert main[0] == ("fr", ["en", "fr"]) and main[1] == main[2] == main[3] == (None, [])
    assert len(main) == len(extra)


def test_short_texts_have_a_language_and_a_low_confidence(spark, documents):
    df = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**9, "the", ""), (10**9 + 1, "le bois", ""), (10**9 + 2, "La strada è chiusa. Oui.", "")], "doc_id bigint, text string, lang string"))
    got = {r.doc_id - 10**9: r for r in language.document_languages(df, language.segments(df, "doc_id", "text", "lang", 600), "doc_id").where("doc_id >= 1000000000").collect()}
    assert got[0].lang_main == "en" and got[0].languages == [] and got[1].lang_main == "fr" and got[1].languages == []
    assert 0 < got[0].confidence < got[2].confidence and got[2].lang_main == "it"


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert language.segments(df, "doc_id", "text", "lang").collect() == []
    one = spark.createDataFrame([(1, "some text without a label", None)], df.schema)
    assert [r.lang for r in language.segments(one, "doc_id", "text", "lang").collect()] == [None]
