"""Queries meet small cells in bundles: as many rows as before are found, far fewer travel."""

import numpy as np
import pytest

from emberlog.operators import neighbours as N


@pytest.mark.parametrize("levels", [1, 2])
def test_a_query_travels_once_to_the_cells_of_a_bundle(spark, monkeypatch, levels):
    routes = []

    def kept(df, *args, settle=N.settle):
        out = settle(df, *args)
        if {"q_id", "lot", "parts"} <= set(out.columns):
            routes.append(out)
        return out

    monkeypatch.setattr(N, "settle", kept)
    rng = np.random.default_rng(6)
    m = rng.normal(0, 1, (300, 24))
    label = [None if i % 50 == 0 else i % 3 for i in range(300)]
    df = spark.createDataFrame([(i, label[i], [float(x) for x in v]) for i, v in enumerate(m)], "log_id long, label int, vec array<double>")
    got = N.knn_join(df, df, 1, group="label", normalize=True, n_pivots=20, levels=levels).collect()
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    d = np.linalg.norm(unit[:, None] - unit[None], axis=2)
    np.fill_diagonal(d, np.inf)
    best = {(r["q_id"], r["label"]): r["b_id"] for r in got}
    for g in (0, 1, 2):
        own = [j for j in range(300) if label[j] == g]
        assert all(best[i, g] == own[int(d[i, own].argmin())] for i in range(300))
    assert routes and sum(r.count() for r in routes) <= 2 * 300 * 4  # a group is one bundle; 20 cells of a group were 20 rows


def test_bundles_hold_about_a_block(spark):
    cells = spark.createDataFrame([(g, c) for g in (0, None) for c in range(12) for _ in range(40 if c == 5 else 3)], "grp int, cell int")
    rows = N._bundles(cells, 16).collect()
    assert len(rows) == 24
    for g in (0, None):
        size = {}
        for r in rows:
            if r["grp"] == g:
                n, _ = size.get(r["bundle"], (0, 0))
                size[r["bundle"]] = (n + (40 if r["cell"] == 5 else 3), r["parts"])
        assert sum(n for n, _ in size.values()) == 73 and all(-(-n // 16) == parts for n, parts in size.values())


def test_ids_that_come_twice_count_as_before(spark):
    """Each of two equal queries is asked twice, so two equal base rows fill four ranks."""
    rows = [(i, [float(i), float(i * i)]) for i in range(12)]
    df = spark.createDataFrame(rows * 2, "log_id long, vec array<double>")
    got = N.knn_join(df, df, 9, n_pivots=4).filter("q_id = 3").orderBy("rank").collect()
    assert [r["b_id"] for r in got] == [2] * 8 + [4]


def test_tiles_hold_whole_bundles(spark):
    cells = spark.createDataFrame([(0, c) for c in range(40) for _ in range(300 if c == 20 else 3)], "grp int, cell int")
    rows = N._bundles(cells, 16, 64).collect()
    tiles = {}
    for r in rows:
        tiles.setdefault(r["tile"], []).append(r)
    assert {b for t in tiles.values() for b in {r["bundle"] for r in t}} == {r["bundle"] for r in rows}
    assert len({(r["bundle"], r["tile"]) for r in rows}) == len({r["bundle"] for r in rows}) > len(tiles)
    for t in tiles.values():
        n = sum(300 if r["cell"] == 20 else 3 for r in t)
        assert {r["parts"] for r in t} == {-(-n // 64)}


@pytest.mark.parametrize("levels", [1, 2])
def test_tiles_and_slices_find_the_same(spark, monkeypatch, levels):
    """Small tiles, lots and slices; floats travel as floats and are compared as doubles."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "TILE_BYTES", 8 * 6 * 20)
    monkeypatch.setattr(N, "COMPARED", 30)
    m = np.random.default_rng(8).normal(0, 1, (200, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "log_id long, vec array<float>")
    out = N.knn_join(df, df, 4, n_pivots=12, block=8, levels=levels)
    assert "cast(lambda" not in out._jdf.queryExecution().analyzed().toString()
    m = m.astype(float)
    d = np.linalg.norm(m[:, None] - m[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :4]
    got = {(r["q_id"], r["rank"]): (r["b_id"], r["dist"]) for r in out.collect()}
    assert len(got) == 800 and all(got[i, j + 1] == (near[i, j], pytest.approx(d[i, near[i, j]])) for i in range(200) for j in range(4))


def test_lots_do_not_multiply_with_the_rows():
    assert N._held(600_000, 64, N.BLOCK) > 10 * N.BLOCK and 8 * 64 * N._held(10**9, 64, N.BLOCK) <= N.TILE_BYTES
    assert N._held(100, 64, N.BLOCK) == N.BLOCK and N._held(10**6, 10**7, N.BLOCK) == N.BLOCK
