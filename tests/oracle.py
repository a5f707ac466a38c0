"""Compare a query with its SQL on DuckDB."""

import datetime
import decimal
import glob
import math
import os

import duckdb

RELATIVE, ABSOLUTE = 1e-9, 1e-9


def connect(sf):
    con = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else float(v)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def parted(row):
    """The exact values of a row as texts, and its floats."""
    return tuple("float" if isinstance(v, float) else str(v) for v in row), tuple(v for v in row if isinstance(v, float))


def compare(df, con, sql):
    """The rows are the same: exact values equal, floats within a relative tolerance, none rounded."""
    names = sorted(df.columns)
    got = sorted(parted([plain(r[c]) for c in names]) for r in df.collect())
    answer = con.execute(sql)
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    want = sorted(parted([plain(r[k]) for k in at]) for r in answer.fetchall())
    assert len(got) == len(want)
    assert [g[0] for g in got] == [w[0] for w in want]
    off = [(g, w) for g, w in zip(got, want, strict=True) if not all(math.isclose(a, b, rel_tol=RELATIVE, abs_tol=ABSOLUTE) for a, b in zip(g[1], w[1], strict=True))]
    assert not off, off[:3]
