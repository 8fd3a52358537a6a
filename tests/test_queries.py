"""Every query of the library against its SQL on the smallest tables, if they are there."""

import glob
import math
import os

import pytest

from vectrine.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(rows):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(([plain(v) for v in r] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    sql = registry.oracle_sql().get(name)
    if not sql:
        from test_algebra_queries import CHECKED

        assert name in CHECKED  # against NumPy, there
        return
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(tuple(r[c] for c in columns) for r in got.collect()) == canonical(want.fetchall())
