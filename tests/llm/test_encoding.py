import random

import pytest

from terracell.llm import encoding

WORDS = ["hêtre", "chêne", "pédonculé", "épicéa", "érable", "champêtre", "pectiné", "calcaires", "lités", "à", "débris", "côte", "œillés", "grès", "sapin", "pin"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    return [" ".join(rng.choice(WORDS) for _ in range(3)) for _ in range(400)]


DAMAGE = {
    "utf-8 as windows": lambda v: v.encode("utf-8").decode("cp1252", "ignore"),
    "utf-8 as mac": lambda v: v.encode("utf-8").decode("mac_roman"),
    "utf-8 as dos": lambda v: v.encode("utf-8").decode("cp850"),
    "windows as dos": lambda v: v.encode("cp1252").decode("cp850"),
    "twice": lambda v: v.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1"),
    "lost": lambda v: v.encode("cp1252").decode("utf-8", "replace"),
}


def repaired(spark, texts):
    df = spark.createDataFrame([(t, "v", 1, "s") for t in texts], "text string, value string, n int, span string")
    return {r.value: (r.restored, r.whole) for r in encoding.repair(df, {"text": "text"}).collect()}


def test_all_kinds_of_damage_are_restored(spark, corpus):
    clean = ["Hêtre pectiné", "chêne pédonculé", "grès à débris", "côte champêtre"]
    bad = {f(v): v for v in clean for f in DAMAGE.values() if f(v) != v}
    got = repaired(spark, corpus + clean + list(bad))
    assert not set(clean) & set(got) and not set(corpus) & set(got)
    assert set(bad) == set(got)
    right = sum(got[b][0] == v for b, v in bad.items())
    assert right >= 0.9 * len(bad)


def test_genuine_signs_stay(spark, corpus):
    fine = ["São Weißbach", "hêtre ½ § 9 ± 5 70°", "chêne Ω4 (lot Δ)", "© levé « têtard »", "Dvořec – Ålviken", "hê​tre", "SÃO"]
    assert repaired(spark, corpus + fine * 3) == {}


def test_nothing_and_odd_values(spark):
    assert repaired(spark, []) == {}
    assert repaired(spark, [None, "", " ", "plain"]) == {}
    got = repaired(spark, ["\x85\x96", "�"])
    assert set(got) == {"\x85\x96", "�"}


def test_very_long_value(spark, corpus):
    long = "hêtre " * 20_000 + "hÃªtre"
    got = repaired(spark, [*corpus, long])
    assert got[long][0] == "hêtre " * 20_000 + "hêtre"


def test_rare_letter_of_the_corpus(spark, corpus):
    right = "lignites xyloïdes"
    bad = [right.encode("cp1252").decode(page) for page in ("mac_roman", "cp850")] + ["lignites xylo�des"]
    got = repaired(spark, corpus * 6 + [right] * 3 + bad)
    assert {b: got.get(b, ("not found",))[0] for b in bad} == dict.fromkeys(bad, right)
