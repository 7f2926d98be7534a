"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from riskloom.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def comparable(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return (1, 0)
        return (0, v if isinstance(v, str) else float(v))

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_are_those_of_sql(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    result = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = comparable([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()])
    assert comparable(df.select(*columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_the_entry_module_works_alone():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
