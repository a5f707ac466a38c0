from terracell.operators import filling
from tests.conftest import rows

SCHEMA = "row_id bigint, stand string, year int, v string, n double, filled string, method string, distance int"


def frame(spark, data):
    return spark.createDataFrame([(i, s, y, v, n, "x", "y", 1) for i, s, y, v, n in data], SCHEMA)


def fill(df, **k):
    return rows(filling.fill_category(df, "row_id", "stand", "year", "v", **k))


def test_same_period_and_neighbours(spark):
    data = [
        (1, "a", 2010, "oak", None), (2, "a", 2010, None, None), (3, "a", 2012, " ", None), (4, "a", 2014, "oak", None),
        (5, "a", 2016, "unknown", None), (6, "b", 2010, "oak", None), (7, "b", 2012, "n/a", None), (8, "b", 2014, "ash", None),
        (9, "c", 2010, "oak", None), (10, "c", 2010, "ash", None), (11, "c", 2010, "-", None), (12, "d", 2010, None, None),
        (13, None, 2010, None, None), (14, "a", None, None, None),
    ]
    assert fill(frame(spark, data)) == sorted(
        [
            (2, "oak", "same_period", 0), (3, "oak", "neighbours", 2), (5, "oak", "neighbours", 2), (7, None, None, None),
            (11, None, None, None), (12, None, None, None), (13, None, None, None), (14, None, None, None),
        ],
        key=repr,
    )


def test_forms_compare_equal(spark):
    data = [(1, "a", 2010, "hêtre", None), (2, "a", 2010, "hêtrе", None), (3, "a", 2010, "hêtre\xa0", None), (4, "a", 2010, None, None)]
    assert fill(frame(spark, data)) == [(4, "hêtre", "same_period", 0)]
    codes = [(1, "a", 2010, " ff1-00", None), (2, "a", 2010, "FF1-00 ", None), (3, "a", 2010, "nr", None)]
    assert fill(frame(spark, codes), upper=True) == [(3, "FF1-00", "same_period", 0)]


def test_gap_limit(spark):
    data = [(1, "a", 2000, "oak", None), (2, "a", 2009, None, None), (3, "a", 2010, "ash", None), (4, "a", 2020, None, None)]
    assert fill(frame(spark, data), gap_limit=5) == [(2, "ash", "neighbours", 1), (4, None, None, None)]


def test_empty_table_and_long_values(spark):
    assert fill(frame(spark, [])) == []
    long = "é" * 100_000
    assert fill(frame(spark, [(1, "a", 1, long, None), (2, "a", 1, "", None)])) == [(2, long, "same_period", 0)]


def test_numbers(spark):
    data = [(1, "a", 2010, None, 1.0), (2, "a", 2012, None, None), (3, "a", 2018, None, 5.0), (4, "a", 2020, None, float("nan")), (5, "a", 2010, None, None), (6, "b", 1, None, None)]
    got = rows(filling.fill_number(frame(spark, data), "row_id", "stand", "year", "n"))
    assert got == [(2, 2.0, "interpolated", 2), (4, 5.0, "carried", 2), (5, 1.0, "same_period", 0), (6, None, None, None)]
    assert rows(filling.fill_number(frame(spark, []), "row_id", "stand", "year", "n")) == []
