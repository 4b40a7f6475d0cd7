"""Cells of mutual information from columns and from one array of them, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import selection as S


def test_columns_and_array_agree(spark):
    rng = np.random.default_rng(3)
    names = [f"x{i}" for i in range(S.SKETCHES + 3)]
    rows = [(str(i % 3) if i % 10 else None, *[float(x) if x < 8 else None for x in rng.integers(0, 10, len(names))]) for i in range(200)]
    df = spark.createDataFrame(rows, "label string, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    packed = df.select("label", F.array(*names).alias("v"))
    edges = S.bin_edges(df, names)
    assert edges == S.bin_edges(packed, names, values="v")
    single = {n: S.bin_edges(df, [n])[n] for n in names}  # one column goes without an explode
    assert edges == single
    got = {r["feature"]: r["mi"] for r in S.mutual_information(df, names).collect()}
    for i, n in enumerate(names):
        cells = [(r[0], sum(r[i + 1] is not None and r[i + 1] > e for e in edges[n])) for r in rows]
        want = 0.0
        for label, cell in set(cells):
            if label is not None:  # rows without a label count in the totals only
                n_both, total = cells.count((label, cell)), len(cells)
                want += n_both / total * np.log(n_both * total / (sum(c == cell for _, c in cells) * sum(k == label for k, _ in cells)))
        assert got[n] == pytest.approx(want)
    assert {r["feature"]: pytest.approx(r["mi"]) for r in S.mutual_information(packed, names, values="v").collect()} == got


def test_rows_are_counted_once(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(20)], "label int, a double")
    plan = S.mutual_information(df, ["a"], edges={"a": [5.0]})._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" not in plan and "LogicalRDD" not in plan  # it reads a table of counts, not the rows
