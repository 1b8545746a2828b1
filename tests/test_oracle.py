"""Every registered query against its DuckDB oracle on the smallest tables,
plus the driver contract of ``__spark_entry__``."""

import duckdb
import pytest

import __spark_entry__ as E
from parcelscope.plans.registry import QUERIES
from tools.check_oracle import TABLES, rows_of

NAMES = sorted(QUERIES)
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def duck(smoke_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smoke_dir}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, smoke_dir, duck, name):
    got = E.queries()[name](spark, smoke_dir).toPandas()
    want = duck.execute(SQL[name]).df()
    c1, r1 = rows_of(got)
    c2, r2 = rows_of(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_schema_is_stable(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema
    assert [f.name for f in a.schema.fields] == ["city", "total_shipments", "total_fails", "fail_rate_pct"]
    assert a.count() >= 0
