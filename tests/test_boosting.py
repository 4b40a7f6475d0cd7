"""AdaBoost on balanced bags, against a plain version."""

import numpy as np
import pytest

from emberlog.operators import boosting as B
from emberlog.operators import models as M


def data(n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    x[:, 2] = 4.0  # a feature of one value
    y = ((x[:, 0] + x[:, 1] > 0.2) ^ (rng.random(n) < 0.05)).astype(int)
    return x, y, rng.integers(0, 2, n)


def plain(x, y, cuts, rounds):
    """Stumps and errors of one bag."""
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for f, c in enumerate(cuts):
            for t in c:
                for left in (0, 1):
                    miss = np.where(x[:, f] <= t, left, 1 - left) != y
                    e = w[miss].sum() / w.sum()
                    if best is None or e < best[0] - 1e-12:
                        best = (e, f, t, left, miss)
        e, f, t, left, miss = best
        a = np.log((1 - e) / e)
        w = w * np.exp(a * miss)
        out.append((f, t, left, a, e))
    return out


def test_rounds_equal_the_plain_version(spark):
    x, y, bag = data()
    df = spark.createDataFrame([(int(b), int(l), v.tolist()) for b, l, v in zip(bag, y, x)], "bag int, label int, vec array<double>").repartition(4)
    model, errors = B.boost_bags(df, 2, 5)
    cuts = B.cut_points(df.selectExpr("vec AS x"), B.F.col("x"))
    assert cuts[2] == [] and max(map(len, cuts)) < B.BINS
    for k in range(2):
        want = plain(x[bag == k], y[bag == k], cuts, 5)
        assert len(model.members[k]) == 5
        for (f, t, l, r, a), e, (wf, wt, wl, wa, we) in zip(model.members[k], (row[k] for row in errors), want):
            assert (f, t, l, r) == (wf, wt, wl, 1 - wl) and a == pytest.approx(wa) and e == pytest.approx(we)
    got = M.predict(model, df.withColumn("log_id", B.F.monotonically_increasing_id())).collect()
    for r in got:
        p = np.mean([1 / (1 + np.exp(-sum(a * (2 * (l if r.vec[f] <= t else q) - 1) for f, t, l, q, a in m))) for m in model.members])
        assert r.score == pytest.approx(p) and r.p == int(p > 0.5)


def test_bags_that_are_parted_at_once_or_not_at_all(spark):
    rows = [(0, i % 2, [float(i % 2)]) for i in range(20)] + [(1, i % 2, [0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "bag int, label int, vec array<double>")
    model, errors = B.boost_bags(df, 2, 4)
    assert len(model.members[0]) == 1 and model.members[1] == [] and len(errors) == 1
    same = spark.createDataFrame([(0, i % 2, [1.0, 1.0]) for i in range(10)], "bag int, label int, vec array<double>")
    assert B.boost_bags(same, 1, 3)[0].members == [[]]


def test_easy_ensemble_learns_from_balanced_bags(spark):
    x, y, _ = data(400, 3)
    rows = [(i, int(l), v.tolist()) for i, (v, l) in enumerate(zip(x, y)) if l == 0 or i % 4 == 0]
    df = spark.createDataFrame(rows, "log_id long, label int, vec array<double>")
    got = M.predict(M.train(df, "easy_ensemble", {"members": 4, "maxIter": 8}), df).collect()
    recall = lambda c: np.mean([r.p == c for r in got if r.label == c])
    assert min(recall(0), recall(1)) > 0.8
