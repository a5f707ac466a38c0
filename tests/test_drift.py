import json

from terracell.functions.treediff import assign, diff, tree
from terracell.operators import drift
from tests.conftest import rows


def tables(spark, files, with_extra=True):
    """files: {(feed, edition): [payloads]}"""
    f, r = [], []
    for k, ((feed, edition), records) in enumerate(files.items(), 1):
        f.append((k, feed, edition, "x", "y"))
        r += [(k, n, p if p is None or isinstance(p, str) else json.dumps(p), "v", "k") for n, p in enumerate(records, 1)]
    raw = spark.createDataFrame(r, "file_id bigint, line_no int, payload string, name string, value string")
    return raw, spark.createDataFrame(f, "file_id bigint, feed_code string, edition int, name string, fields string")


def found(spark, files):
    return rows(drift.top_level(drift.changes(*tables(spark, files))))


def rec(n, **k):
    return {"feature_code": f"f{n}", **k}


def test_kinds_of_change(spark):
    files = {
        ("A", 1): [rec(n, DESCR=f"d{n}", gone=n, num=n, same=True) for n in range(5)],
        ("A", 2): [rec(n, descr=f"d{n}", new=[n], num=str(n), same=True) for n in range(5)],
        ("A", 3): [rec(n, descr=f"d{n}", new=[n], num=str(n), same=None) for n in range(5)],
    }
    assert found(spark, files) == sorted([(2, "renamed", "DESCR", "descr"), (2, "removed", "gone", ""), (2, "added", "", "new"), (2, "retyped", "num", "num")], key=repr)


def test_integer_and_decimal_differ(spark):
    files = {("A", 1): [rec(1, a=1, b=1.0)], ("A", 2): [rec(1, a=1.0, b=2.5)]}
    assert found(spark, files) == [(2, "retyped", "a", "a")]


def test_values_decide_a_rename(spark):
    files = {("A", 1): [rec(n, a=n) for n in range(4)], ("A", 2): [rec(n, b=n + 1) for n in range(4)]}
    assert found(spark, files) == [(2, "added", "", "b"), (2, "removed", "a", "")]


def test_nulls_odd_payloads_and_repeats(spark):
    files = {
        ("A", 1): [rec(1, a=None), None, "", "no json", "[1]", '{"a":1,"a":2}', rec(1, a="x"), rec(1, a="x")],
        ("A", 2): [rec(1, b="x"), rec(2, b=None)],
        ("A", 3): [],
        ("B", 1): [rec(1, z=1)],
    }
    assert found(spark, files) == [(2, "renamed", "a", "b"), (3, "removed", "b", "")]
    raw, names = tables(spark, files)
    assert rows(drift.changes(raw.limit(0), names.limit(0))) == []


def nested(spark, files):
    return {(r.file_id, r.drift_kind, r.old_name, r.new_name) for r in drift.dotted(drift.changes(*tables(spark, files))).collect()}


def test_nested_changes(spark):
    files = {("A", 1): [rec(1, box={"x": 1, "y": 2}, o={})], ("A", 2): [rec(1, box={"x": "1", "z": 3}, o={})]}
    assert nested(spark, files) == {(2, "retyped", "box.x", "box.x"), (2, "removed", "box.y", ""), (2, "added", "", "box.z")}
    assert found(spark, files) == []


def test_nested_rename(spark):
    files = {("A", 1): [rec(n, box={"y": n}, list=[{"a": n}]) for n in range(3)], ("A", 2): [rec(n, box={"z": n}, list=[{"b": n}]) for n in range(3)]}
    assert nested(spark, files) == {(2, "renamed", "box.y", "box.z"), (2, "renamed", "list.[].a", "list.[].b")}
    assert found(spark, files) == []


def test_field_moves_into_and_out_of_an_object(spark):
    files = {
        ("A", 1): [rec(n, LITHO=f"l{n}", info={"b": 1}) for n in range(3)],
        ("A", 2): [rec(n, info={"b": 1, "LITHO": f"l{n}"}) for n in range(3)],
        ("A", 3): [rec(n, rock=f"l{n}", info={"b": 1}) for n in range(3)],
    }
    assert nested(spark, files) == {(2, "moved", "LITHO", "info.LITHO"), (3, "moved", "info.LITHO", "rock")}
    assert found(spark, files) == [(2, "removed", "LITHO", ""), (3, "added", "", "rock")]
    raw, names = tables(spark, files)
    out = drift.unified(raw, names, drift.changes(raw, names), {"LITHO": "text"}).select("file_id", "feature_code", "litho")
    assert rows(out) == sorted((f, f"f{n}", f"l{n}") for f in (1, 2, 3) for n in range(3))


def test_names_with_odd_signs(spark):
    files = {("A", 1): [rec(n, **{"a.b": n, "it's": 1, "": 2}) for n in range(3)], ("A", 2): [rec(n, **{"c?": n, "it's": "x", "": 2}) for n in range(3)]}
    assert found(spark, files) == [(2, "renamed", "a.b", "c?"), (2, "retyped", "it's", "it's")]
    raw, names = tables(spark, files)
    out = drift.unified(raw, names, drift.changes(raw, names), {"a.b": "long"}).select("file_id", "feature_code", "`a.b`")
    assert rows(out) == sorted((f, f"f{n}", n) for f in (1, 2) for n in range(3))


def test_one_table(spark):
    files = {
        ("A", 1): [rec(1, DESCR="two words", sheet_no=3)],
        ("A", 2): [rec(1, descr="two words", sheet_no=3)],
        ("A", 3): [rec(1, descr=["two", "words"], sheet_no="x", more=1, nil=None), "no json", rec(2, descr={"fr": "two words", "niv": 2})],
    }
    raw, names = tables(spark, files)
    out = drift.unified(raw, names, drift.changes(raw, names), {"DESCR": "text", "sheet_no": "long"})
    assert rows(out.select("file_id", "line_no", "descr", "sheet_no")) == sorted(
        [(1, 1, "two words", 3), (2, 1, "two words", 3), (3, 1, "two words", None), (3, 2, None, None), (3, 3, "two words", None)], key=repr
    )
    assert out.where("file_id = 3 and line_no = 1").first()["other"] == {"more": "1", "sheet_no": "x"}  # what the column cannot hold is kept
    assert out.where("file_id = 3 and line_no = 3").first()["other"] == {"descr": '{"fr":"two words","niv":2}'}


def test_both_names_in_a_record_are_kept(spark):
    files = {("A", 1): [rec(n, DESCR=f"d{n}") for n in range(3)], ("A", 2): [rec(n, descr=f"d{n}") for n in range(3)], ("A", 3): [rec(1, descr="d1", DESCR="other text")]}
    raw, names = tables(spark, files)
    out = drift.unified(raw, names, drift.changes(raw, names), {"DESCR": "text"}).where("file_id = 3").first()
    assert (out["descr"], out["other"]) == ("other text", {"descr": "d1"})


def test_each_feed_has_its_own_projection(spark):
    """B is a name of A in one feed and of C in another: neither makes A and C one field."""
    files = {
        ("x", 1): [rec(n, A=f"a{n}") for n in range(3)],
        ("x", 2): [rec(n, B=f"a{n}") for n in range(3)],
        ("y", 1): [rec(n, C=f"c{n}") for n in range(3)],
        ("y", 2): [rec(n, B=f"c{n}") for n in range(3)],
        ("z", 1): [rec(n, B=f"b{n}", A=None) for n in range(3)],
    }
    raw, names = tables(spark, files)
    out = rows(drift.unified(raw, names, drift.changes(raw, names), {"A": "text", "C": "text"}).where("feature_code = 'f1'").select("file_id", "a", "c"))
    assert out[:4] == [(1, "a1", None), (2, "a1", None), (3, None, "c1"), (4, None, "c1")]


def test_a_name_known_from_another_feed(spark):
    files = {("x", 1): [rec(1, A="a")], ("x", 2): [rec(1, B="a")], ("y", 1): [rec(2, B="b", extra=1)]}
    raw, names = tables(spark, files)
    out = drift.unified(raw, names, drift.changes(raw, names), {"A": "text"}).where("file_id = 3").first()
    assert (out["a"], out["other"]) == ("b", {"extra": "1"})


def test_empty_tables(spark):
    raw, names = tables(spark, {("A", 1): [rec(1, a=1)]})
    empty = drift.changes(raw.limit(0), names.limit(0))
    assert rows(drift.unified(raw.limit(0), names.limit(0), empty, {"a": "long"})) == []


def test_least_cost_script():
    old, new = tree([(("a",), "string"), (("b",), "string")]), tree([(("b",), "string"), (("c",), "string")])
    assert [(e.kind, e.old, e.new) for e in diff(old, new, lambda x, y: (x, y) == (("a",), ("c",)))] == [("renamed", ("a",), ("c",))]
    assert assign([[4.0, 1.0, 3.0], [2.0, 0.0, 5.0], [3.0, 2.0, 2.0]]) == [1, 0, 2]


def test_cost_of_what_remains_when_a_part_has_moved():
    old = tree([(("o",), "object"), (("o", "a"), "string"), (("o", "b"), "string")])
    new = tree([(("a",), "string")])
    script = diff(old, new, lambda x, y: (x, y) == (("o", "a"), ("a",)))
    assert [(e.kind, e.old, e.new, e.cost) for e in script] == [("removed", ("o",), (), 2.0), ("moved", ("o", "a"), ("a",), 1.0)]
