from terracell.llm import visual
from tests.conftest import rows


def test_forms(spark):
    df = spark.createDataFrame([(v, "f") for v in ("Нêtrе", "hêtre", " a  b", None, "", "​", "a\u00a0b", "é" * 100_000)], "value string, form string")
    got = {r.value: (r.form, r.imitates) for r in visual.visual_forms(df).collect()}
    assert got["Нêtrе"] == ("Hêtre", True) and got["hêtre"] == ("hêtre", False) and got[" a  b"] == ("a b", False)
    assert got[None] == (None, False) and got[""] == ("", False) and got["​"] == ("", True) and got["a\u00a0b"] == ("a b", True)
    assert got["é" * 100_000] == ("é" * 100_000, False)


def test_plain_values_need_no_work(spark):
    df = spark.createDataFrame([("hêtre",), ("Нêtrе",), (None,), ("a–b’½ Œ",), ("a\u00a0b",), ("Ω4",)], "t string")
    got = visual.with_forms(df.withColumnRenamed("t", "value"), "value")
    assert got.count() == df.count() and rows(got.where("imitates").select("value", "form")) == sorted([("Нêtrе", "Hêtre"), ("a\u00a0b", "a b")], key=repr)


def test_empty(spark):
    assert visual.visual_forms(spark.createDataFrame([], "value string")).collect() == []
