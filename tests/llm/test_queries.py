import pytest

from terracell.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, con, name):
    compare(QUERIES[name](spark, sf), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name, columns", [
    ("p1_found", ["field", "term", "mark"]), ("p2_found", ["field", "row_id"]), ("p3_found", ["field", "row_id", "ref_id"]),
    ("p4_found", ["field", "row_id"]), ("p8_ids", ["doc_id", "ids"]), ("p10_found", ["doc_id", "lang_found"]),
])
def test_columns(spark, sf, name, columns):
    assert QUERIES[name](spark, sf).columns == columns
