"""Every registered query of the library against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from countloom import plans

DIR = "/root/testdata/sf0.001"
TABLES = ("lineitem", "customer", "events")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def _same(a, b) -> bool:
    a, b = (None if not isinstance(x, (list, np.ndarray)) and pd.isna(x) else x for x in (a, b))
    if a is None or b is None:
        return a is b
    return abs(a - b) <= 2e-6 * max(1, abs(a)) if isinstance(a, (int, float, np.number)) and not isinstance(a, bool) else str(a) == str(b)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    got = plans.QUERIES[name](spark, DIR).toPandas()
    sql = plans.ORACLE_SQL.get(name)
    if sql is None:
        assert len(got)
        return
    want = db.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in columns if got[c].dtype.kind != "f"] or columns
    a, b = (x.sort_values(keys, key=lambda v: v.astype(str)).reset_index(drop=True) for x in (got, want))
    assert all(_same(x, y) for c in columns for x, y in zip(a[c], b[c], strict=True))


def test_every_query_has_a_name_of_its_own():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())
