"""Every query of the catalog against its SQL on the smallest tables."""

import math

import pytest

from codelake import catalog
from codelake.plans.views import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("key", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, key):
    df = catalog.QUERIES[key](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    cur = duck.execute(catalog.SQL[key])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert _sorted(got) == _sorted([tuple(_plain(r[i]) for i in at) for r in cur.fetchall()])


@pytest.mark.parametrize("key", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, key):
    rows = catalog.QUERIES[key](spark, DIR).collect()
    assert rows and len({len(r) for r in rows}) == 1


def test_flagship_and_names():
    assert catalog.FLAGSHIP in catalog.QUERIES and set(catalog.SQL) <= set(catalog.QUERIES)
