"""Every registered query against its SQL on the smallest tables, outside the optional subpackage's own tests."""

import duckdb
import pytest

from quarrel.plans import registry
from quarrel.plans.relational import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else int(v) if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    if name not in registry.ORACLES:
        assert got
        return
    rel = oracle.sql(registry.ORACLES[name])
    order = sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == sorted((tuple(plain(r[k]) for k in order) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize(("name", "table"), [("o1_sort", "events"), ("f2_math", "lineitem")])
def test_whole_tables(spark, oracle, name, table):
    n = oracle.sql(f"SELECT COUNT(*) FROM {table}").fetchall()[0][0]
    assert registry.QUERIES[name](spark, SF).count() == n == oracle.sql(f"SELECT COUNT(*) FROM ({registry.ORACLES[name]})").fetchall()[0][0]
