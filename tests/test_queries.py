"""Every query with SQL against DuckDB at the smallest scale; the others run."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def names():
    from lorespark.plans import registry

    return sorted(registry.queries())


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from lorespark.plans import registry

    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in cols) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        own = [d[0] for d in found.description]
        assert sorted(own) == cols
        assert got == sorted(tuple(value(r[own.index(c)]) for c in cols) for r in found.fetchall())


def test_entry_imports_without_the_corpus_operators():
    import __spark_entry__ as e

    assert set(names()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
