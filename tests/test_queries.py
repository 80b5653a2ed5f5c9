"""Every query with SQL against DuckDB, and the driver's contract."""

import math

import pytest

import __spark_entry__ as entry
from sparkloom.plans import queries as plans


def rows(df):
    def norm(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "<NA>":
            return ""
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(norm(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_like_duckdb(spark, duck, data, name):
    got, want = plans.QUERIES[name](spark, data).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_contract():
    every = entry.queries()
    assert set(entry.oracle_sql()) <= set(every) and set(plans.QUERIES) <= set(every)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
