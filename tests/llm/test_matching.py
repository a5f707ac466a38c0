import pytest

from terracell.llm import matching

LABELS = [(1, "f", "Hêtre", "Fagus sylvatica|fayard"), (2, "f", "Chêne sessile", None), (3, "f", "Chêne pubescent", ""), (4, "f", "Pin noir", None), (5, "g", "Grès verdâtres micacés", None), (6, "f", None, None)]


@pytest.fixture(scope="module")
def match(spark):
    labels = spark.createDataFrame(LABELS, "ref_id int, field string, label string, aliases string")

    def run(*values, field="f"):
        df = spark.createDataFrame([(field, v, v, 1.0) for v in values], "field string, value string, text string, score double")
        return {r.value: r.ref_id for r in matching.match_values(df, labels).collect()}

    return run


def test_variants(match):
    want = {
        "Hêtre": 1, "hetre": 1, "HÊTRES": 1, "htêre": 1, "fayard": 1, "Fagus sylvatica L.": 1, "surtout Hêtre": 1, "Hêtre - 2e étage": 1,
        "chene sess.": 2, "sessile, Chêne": 2, "Chêne pubesent (revoir)": 3, "pin nior": 4, "Ｐｉｎ noіr": 4,
    }
    assert match(*want) == want


def test_others_mean_none(match):
    assert set(match("Chêne", "parcelle vide", "Eucalyptus", "xxxx", "", " ", "???", "123").values()) == {0}
    assert match(None) == {None: 0}
    assert match("Hêtre", field="no such field") == {"Hêtre": 0}


def test_ties_give_none(spark):
    labels = spark.createDataFrame([(1, "f", "Même nom", None), (2, "f", "Même nom", None)], "ref_id int, field string, label string, aliases string")
    df = spark.createDataFrame([("f", "Même nom", "Même nom")], "field string, value string, text string")
    assert matching.match_values(df, labels).first().ref_id == 0


def test_long_and_empty(spark, match):
    assert match("hêtre " + "x" * 50_000) == {"hêtre " + "x" * 50_000: 0}
    labels = spark.createDataFrame([], "ref_id int, field string, label string, aliases string")
    df = spark.createDataFrame([("f", "a", "a")], "field string, value string, text string")
    assert matching.match_values(df, labels).first().ref_id == 0
    assert matching.match_values(df.limit(0), labels).collect() == []


def test_edit_distance():
    assert [matching.edits(*p) for p in (("abc", "abc"), ("abc", "acb"), ("", "ab"), ("kitten", "sitting"))] == [0, 1, 2, 3]


CODES = [(1, "c", "FF1-09-09", None), (2, "c", "FF2-09-09", None), (3, "c", "FF1-10-10", None), (4, "c", "Сосна обыкновенная", None), (5, "c", "松林", "混交林")]


def test_digits_and_other_scripts_tell_entries_apart(spark):
    labels = spark.createDataFrame(CODES, "ref_id int, field string, label string, aliases string")
    values = ["ff1 09 09", "FF2-09-09", "FF1_10_10", "сосна обыкн.", "松林", "混交林", "FF9-77-77"]
    df = spark.createDataFrame([("c", v, v) for v in values], "field string, value string, text string")
    assert {r.value: r.ref_id for r in matching.match_values(df, labels).collect()} == dict(zip(values, (1, 2, 3, 4, 5, 5, 0), strict=True))


def test_numbers_beside_a_list_without_numbers(match):
    assert match("Hêtre 2019", "Hêtre") == {"Hêtre 2019": 1, "Hêtre": 1}


def test_lists_longer_than_a_block(spark, match, monkeypatch):
    values = ["hetre", "fayard", "Chêne", "chene sess.", "pin nior", "xxxx", "", "Grès verdâtres"]
    labels = spark.createDataFrame(LABELS, "ref_id int, field string, label string, aliases string")
    df = spark.createDataFrame([("f", v, v) for v in values], "field string, value string, text string")

    def found():
        return {r.value: (r.ref_id, round(r.score, 9), round(r.runner_up, 9)) for r in matching.match_values(df, labels).collect()}

    whole = found()
    monkeypatch.setattr(matching, "BLOCK", 2)
    assert found() == whole


def test_candidates_equal_the_whole_comparison():
    names = ["pin noir", "pin sylvestre", "pin à crochets", "sapin", "sapin pectiné", "hêtre", "chêne sessile", "chêne vert", "a", "frêne"]
    index = matching.Index(list(enumerate(names)))
    for text in ("pin", "sapn pectine", "chene", "pn nor", "zzz", "frene hetre", "a b c"):
        mine = {g: m * index.weight.get(g, index.unknown) for g, m in matching.grams(text).items()}
        size = sum(w * w for w in mine.values()) ** 0.5
        want = {}
        for k, name in enumerate(index.text):
            theirs = {g: m * index.weight[g] for g, m in matching.grams(name).items()}
            norm = sum(w * w for w in theirs.values()) ** 0.5
            cosine = sum(w * theirs.get(g, 0.0) for g, w in mine.items()) / size / norm
            if cosine >= matching.FLOOR:
                want[k] = cosine
        assert dict((k, pytest.approx(c)) for c, k in index.candidates(text)) == want
