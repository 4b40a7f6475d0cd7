"""Neighbours by two levels of cells, against brute force; what the driver gathers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import neighbours as N


def clustered(n, dims=5, seed=3):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(12, dims))[rng.integers(0, 12, n)] * 4 + rng.normal(size=(n, dims))
    m[: n // 3] = m[0]  # a third of the rows are one vector
    return m


def frame(spark, m, groups=(0, 1, None)):
    rows = [(i, groups[i % len(groups)], v.tolist()) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "log_id long, g int, vec array<double>").repartition(5)


def brute(m, k, group_of=lambda i: 0, include_self=False):
    out = set()
    for i, v in enumerate(m):
        d = np.sqrt(((m - v) ** 2).sum(1))
        by = {}
        for j in sorted(range(len(m)), key=lambda j: (d[j], j)):
            if j != i or include_self:
                by.setdefault(group_of(j), []).append(j)
        out |= {(g, i, j, r + 1) for g, near in by.items() for r, j in enumerate(near[:k])}
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(N, "CELL", 16)
    monkeypatch.setattr(N, "TOP_PIVOTS", 6)
    monkeypatch.setattr(N, "ROUTE_NUMBERS", 500)


def test_two_levels(spark, small):
    m = clustered(600)
    df = frame(spark, m)
    got = {(0, r.q_id, r.b_id, r.rank) for r in N.knn_join(df, df, 4).collect()}
    assert got == brute(m, 4)
    alone = {(0, r.q_id, r.b_id, r.rank) for r in N.knn_join(df, df, 3, exclude_self=False).collect()}
    assert alone == brute(m, 3, include_self=True)


def test_two_levels_by_group(spark, small):
    m = clustered(300)
    df = frame(spark, m)
    got = {(r.g, r.q_id, r.b_id, r.rank) for r in N.knn_join(df, df, 3, group="g").collect()}
    assert got == brute(m, 3, lambda i: (0, 1, None)[i % 3])


def test_levels_agree_where_k_passes_the_base(spark):
    m = clustered(40)
    df = frame(spark, m)
    found = [{tuple(r) for r in N.knn_join(df, df, 60, levels=n).select("q_id", "b_id", "rank").collect()} for n in (1, 2)]
    assert found[0] == found[1] and len(found[0]) == 40 * 39
    assert N.knn_join(df, df.limit(0), 3, levels=2).count() == 0
    assert N.knn_join(df.limit(0), df, 3, levels=2).count() == 0


def test_the_driver_gathers_no_more_of_a_larger_base(spark, small, monkeypatch):
    gathered, collect = [], type(spark.range(1)).collect

    def counted(df):
        rows = collect(df)
        gathered[-1] += len(rows)
        return rows

    for n in (200, 2000):
        df = frame(spark, clustered(n))
        gathered.append(0)
        with monkeypatch.context() as patch:
            patch.setattr(type(df), "collect", counted)
            out = N.knn_join(df.filter("log_id < 20"), df, 2)
        assert out.select(F.count_distinct("q_id")).first()[0] == 20
    assert gathered[0] == gathered[1] == 6


@pytest.mark.parametrize("levels", [1, 2])
def test_routes_are_not_broadcast(spark, small, levels):
    """Routes are many rows in a small file; they meet the queries by a shuffle."""
    df = frame(spark, clustered(120), (0,))
    plan = N.knn_join(df, df, 3, levels=levels, n_pivots=4)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [q_id" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
