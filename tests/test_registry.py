"""Every registered query with SQL equals DuckDB on the smallest driver tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, names, order):
    def value(v):
        return ("n", round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else ("s", str(v))

    return sorted(tuple(value(r[names.index(c)]) for c in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns, order) == canonical(result.fetchall(), names, order)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert not entry.queries()[name](spark, SF_DIR).isEmpty()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_approximate_counts_stay_near_exact(spark, duck):
    approx = {r.event_type: r.users_approx for r in entry.queries()["approx_users_by_type"](spark, SF_DIR).collect()}
    exact = dict(duck.execute("SELECT event_type, count(DISTINCT user_id) FROM events GROUP BY 1").fetchall())
    assert all(math.isclose(approx[k], n, rel_tol=0.03) for k, n in exact.items())
