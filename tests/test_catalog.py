"""Every registered query against its DuckDB twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from tests.oracle import compare, open_duckdb

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


#: Queries that may have no rows on the smallest tables.
MAY_BE_EMPTY = set()


@pytest.fixture(scope="module")
def duck():
    return open_duckdb(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    fault = compare(QUERIES[name](spark, SF), duck, ORACLES[name])
    assert fault is None or (fault == "both empty" and name in MAY_BE_EMPTY)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and df.columns
    for column in {"score", "f1_macro", "f1", "bal_acc", "auroc", "confidence", "n_rows"} & set(df.columns):
        values = [r[column] for r in rows if r[column] is not None]
        assert values and all(isinstance(v, str) or (v == v and abs(v) < 1e300) for v in values)
    if {"label", "p"} <= set(df.columns):
        assert {r["p"] for r in rows} <= {r["label"] for r in rows} | {0, 1}


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
