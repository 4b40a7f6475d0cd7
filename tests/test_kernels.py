"""The RBF map and the smoothed Bayes model."""

import numpy as np
from pyspark.ml import PipelineModel

from emberlog.operators import kernels as K
from emberlog.operators import models as M
from emberlog.operators.evaluate import metrics


def rings(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 2, n)
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.where(label, 1.0, 3.0) + rng.normal(0, 0.2, n)
    rows = [(i, int(l), [float(r * np.cos(a)), float(r * np.sin(a))]) for i, (l, r, a) in enumerate(zip(label, radius, angle))]
    df = spark.createDataFrame(rows, "log_id long, label int, vec array<double>")
    return df.filter("log_id < 400"), df.filter("log_id >= 400")


def f1(model, held):
    return metrics(M.predict(model, held).withColumnRenamed("label", "y")).first()["f1_macro"]


def test_rings_need_the_kernel(spark, tmp_path):
    rest, held = rings(spark)
    kernel = M.train(rest, "svc_rbf", {"maxIter": 20}, sampler=None)
    assert f1(kernel, held) >= 0.95 and f1(M.train(rest, "svc", {"maxIter": 10}, sampler=None), held) < 0.7
    kernel.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert M.predict(back, held).collect() == M.predict(kernel, held).collect()


def test_the_map_is_close_to_the_kernel():
    directions, phases = K.fourier_draws(4000, 3, 42)
    x, y = np.array([0.3, -1.0, 0.5]), np.array([0.1, 0.2, 0.4])
    z = [np.sqrt(2 / 4000) * np.cos(directions @ p * np.sqrt(2 * 0.7) + phases) for p in (x, y)]
    assert abs(z[0] @ z[1] - np.exp(-0.7 * ((x - y) ** 2).sum())) < 0.05


def test_smoothing_keeps_constant_features_finite(spark):
    rows = [(i, i % 2, [float(i % 2), 1.0, float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "log_id long, label int, vec array<double>")
    _, table = M.grid_search(df, "bayes", k=2, sampler=None)
    assert table.count() == 3
    got = M.predict(M.train(df, "bayes", {"smoothing": 1e-7}, sampler=None), df).collect()
    assert all(r.p == r.label and 0 <= r.score <= 1 for r in got)


def test_neighbours_are_a_model_like_the_others(spark):
    rest, held = rings(spark, 500)
    assert f1(M.train(rest, "knn", {"k": 5, "weights": "distance"}, sampler=None), held) >= 0.95
    # a row of the base is its own nearest neighbour
    assert f1(M.train(rest, "knn", {"k": 1}, sampler=None), rest) == 1.0
