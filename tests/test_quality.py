"""Metrics on ties, one class, equal scores and no rows; resampling and model invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import evaluate as E
from emberlog.operators import models as M
from emberlog.operators import resample as R
from emberlog.operators import sampling as S
from emberlog.operators import scoring as SC
from emberlog.operators import selection as FS
from emberlog.operators import templates as T

SCHEMA = "y int, score double, p int"


def scores(spark, rows):
    return spark.createDataFrame([(y, float(s), int(s >= 0.5)) for y, s in rows], SCHEMA)


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_auroc_and_auprc_with_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(200)]
    df = scores(spark, rows)
    assert E.auroc(df).first()["auroc"] == pytest.approx(brute_auc(rows))
    points = sorted({s for _, s in rows}, reverse=True)
    total, area, seen = sum(y for y, _ in rows), 0.0, 0
    for t in points:
        hits, n = sum(y for y, s in rows if s >= t), sum(s >= t for _, s in rows)
        area += (hits - seen) / total * hits / n
        seen = hits
    assert E.auprc(df).first()["auprc"] == pytest.approx(area)


def test_one_class_and_equal_scores(spark):
    one = scores(spark, [(0, 0.2), (0, 0.7)])
    assert E.auroc(one).first()["auroc"] is None and E.auprc(one).first()["auprc"] is None
    assert E.sensitivity_gmean(one).first()["g_mean"] == 0.0
    assert E.auroc(scores(spark, [(0, 0.4), (1, 0.4), (1, 0.4)])).first()["auroc"] == 0.5
    m = E.metrics(one).first()
    assert m["acc"] == 0.5 and m["mcc"] == 0.0


def test_no_rows(spark):
    empty = scores(spark, [(0, 0.1)]).limit(0)
    named = empty.withColumn("model", F.lit("m"))
    assert E.metrics(named, ["model"]).count() == 0
    assert E.auroc(named, ["model"]).count() == 0


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)], "y int, p int")
    m = E.metrics(df).first()
    assert m["acc"] == pytest.approx(9 / 12) and m["bal_acc"] == pytest.approx((6 / 8 + 3 / 4) / 2)
    assert m["f1_macro"] == pytest.approx((12 / 15 + 6 / 9) / 2)
    assert m["mcc"] == pytest.approx((3 * 6 - 2 * 1) / (5 * 4 * 8 * 7) ** 0.5)
    got = {(r["y"], r["p"]): r["n"] for r in E.confusion(df).collect()}
    assert got == {(0, 0): 6, (0, 1): 2, (1, 0): 1, (1, 1): 3}


def test_threshold_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(300)]
    best = E.tune_threshold(scores(spark, rows)).first()

    def macro(t):
        out = []
        for k in (0, 1):
            tp = sum((s >= t) == k and y == k for y, s in rows)
            bad = sum(((s >= t) == k) != (y == k) for y, s in rows)
            out.append(2 * tp / (2 * tp + bad))
        return sum(out) / 2

    top = max(macro(t) for t in E.GRID)
    assert best["f1_macro"] == pytest.approx(top)
    assert best["threshold"] == min(t for t in E.GRID if macro(t) == pytest.approx(top, abs=1e-12))


def test_percentile_bound_without_groups(spark):
    df = spark.range(1000).select((F.col("id") >= 950).cast("int").alias("y"), F.col("id").cast("double").alias("error"))
    r = E.tune_percentile(df).first()
    assert r["percentile"] == 95 and r["f1_macro"] > 0.99


def test_ensemble_ties_go_low(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.9), (2, 1, 0.9), (2, 1, 0.6)], "log_id int, p int, score double")
    got = {r["log_id"]: r["p"] for r in SC.ensemble(df).collect()}
    assert got == {1: 0, 2: 1}


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"s{i % 3}", 0, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(180)]
    rows += [(i, f"s{i % 3}", 1, [float(x) for x in rng.normal(2.5, 1, 4)]) for i in range(180, 210)]
    return spark.createDataFrame(rows, "log_id long, source string, label int, vec array<double>").cache()


@pytest.mark.parametrize("make", [R.smote, R.borderline_smote])
def test_synthetic_rows_balance_and_lie_between_parents(cloud, make):
    out = make(cloud).collect()
    vec = {r["log_id"]: np.array(r["vec"]) for r in cloud.collect()}
    assert len(out) == 150
    for r in out:
        a, b = vec[r["parent"]], vec[r["mate"]]
        assert r["parent"] >= 180 and r["mate"] >= 180 and 0 <= r["u"] < 1
        assert np.allclose(np.array(r["vec"]), a + r["u"] * (b - a))


def test_samples_are_whole_and_repeat(cloud):
    parts = S.stratified_split(cloud).groupBy("label", "part").count().collect()
    assert {(r["label"], r["part"]): r["count"] for r in parts} == {(0, "train"): 144, (0, "test"): 36, (1, "train"): 24, (1, "test"): 6}
    folds = S.kfold(cloud, 3).groupBy("label", "fold").count().collect()
    assert all(r["count"] in (60, 10) for r in folds) and len(folds) == 6
    a = sorted(r["log_id"] for r in S.cap_rows(cloud, 20).collect())
    assert a == sorted(r["log_id"] for r in S.cap_rows(cloud.repartition(5), 20).collect()) and len(a) == 60
    bags = S.balanced_bags(cloud, 3).groupBy("bag", "label").count().collect()
    assert len(bags) == 6 and all(r["count"] == 30 for r in bags)
    assert abs(S.weighted_resample(cloud).count() - 210) < 30


def test_models_beat_the_majority(cloud):
    parts = S.stratified_split(cloud, 0.7)
    rest, held = parts.filter("part = 'train'").drop("part"), parts.filter("part = 'test'").drop("part")
    majority = held.select(F.col("label").alias("y"), F.lit(0).alias("p"))
    floor = E.metrics(majority).first()["f1_macro"]
    for name, params in (("lr", {}), ("rf", {"numTrees": 10, "maxDepth": 4}), ("nb", {}), ("balanced_rf", {"members": 5})):
        out = M.predict(M.train(rest, name, params), held).withColumnRenamed("label", "y")
        assert E.metrics(out).first()["f1_macro"] > floor + 0.2, name


def test_resampled_rows_stay_in_training(cloud, monkeypatch):
    seen = []
    real = M.predict
    monkeypatch.setattr(M, "predict", lambda model, df, vec="vec": seen.append(df.count()) or real(model, df, vec))
    _, table = M.grid_search(cloud, "lr", {"regParam": [0.1]}, k=3, sampler="smote")
    assert sum(seen) == cloud.count() and table.count() == 1


def test_held_out_sources(cloud):
    out = M.run_loso(cloud, ["nb"]).collect()
    assert sorted(r["source"] for r in out) == ["s0", "s1", "s2"] and all(r["test_rows"] == 70 for r in out)


def test_scaler_is_fitted_on_train_only(spark):
    train = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    test = spark.createDataFrame([(4.0,)], "x double")
    assert FS.scale(test, FS.fit_scaler(train, ["x"])).first()["x"] == pytest.approx(3.0)


def test_label_columns_are_off_by_default(spark):
    df = spark.createDataFrame([("s", "a", 1), ("s", "b", 0)], "source string, template string, label int")
    out = T.add_template_features(df, T.template_stats(df))
    assert not set(out.columns) & set(T.LABEL_BASED)


def test_one_feature_list_for_all_sources(cloud):
    df = cloud.select("label", *[F.col("vec")[i].alias(f"x{i}") for i in range(4)])
    out = FS.select_features(df, [f"x{i}" for i in range(4)], k=2, trees=5).collect()
    assert [r["rank"] for r in out] == [1, 2]


def test_pipeline_rule():
    assert M.sampler_for({0: 100, 1: 50}) == (None, 5)
    assert M.sampler_for({0: 100, 1: 20}) == ("smote", 5)
    assert M.sampler_for({0: 100, 1: 4}) == ("borderline", 3)
    assert M.sampler_for({0: 1000, 1: 1}) == ("adasyn", 1)
