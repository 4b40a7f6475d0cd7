"""Feature store against numpy: eight variants, moments by source, stored selection."""

import numpy as np
import pytest

from emberlog.plans import feature_store as FS

GROUPS = {"statistical": ["a"], "sentence": ["b", "e"], "template": ["c"], "anomaly": ["d"], "complexity": ["e"], "rolling": ["a", "f"]}
ORDER = {  # columns after the vector; repeated ones enter once
    "bert_only": "", "bert_enhanced": "abe", "anomaly_focused": "dc", "imbalance_aware_full": "acdef", "sentence_focused": "bec",
}


def table(n=60):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(n, 3)).round(3)
    numbers = rng.normal(size=(n, 6)).round(3)
    numbers[:, 3] = 5.0  # constant
    labels = (numbers[:, 2] > 0).astype(int)
    sources = ["hot" if i % 3 else "7" for i in range(n)]
    return vectors, numbers, labels, sources


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    vectors, numbers, labels, sources = table()
    rows = [(i, sources[i], int(labels[i]), vectors[i].tolist(), *map(float, numbers[i]), "other") for i in range(len(labels))]
    rows.append((60, "hot", None, None, *[None] * 6, "other"))  # nothing but a source
    df = spark.createDataFrame(rows, "log_id long, source string, label int, vec array<double>, a double, b double, c double, d double, e double, f double, mean string")
    path = str(tmp_path_factory.mktemp("store") / "s")
    FS.write_store(df, path, groups=GROUPS, train="log_id < 60", k=4, trees=5)
    return path


def read(spark, store, name):
    return {r["log_id"]: r for r in FS.read_variant(spark, store, name).collect()}


def test_plain_variants(spark, store):
    vectors, numbers, labels, sources = table()
    for name, columns in ORDER.items():
        got = read(spark, store, name)
        assert len(got) == 61
        for i in range(60):
            want = [*vectors[i], *[numbers[i]["abcdef".index(c)] for c in columns]]
            assert got[i]["features"] == pytest.approx(want) and (got[i]["source"], got[i]["label"]) == (sources[i], labels[i])
        assert got[60]["features"] == [0.0] * (3 + len(columns)) and got[60]["label"] is None
    assert read(spark, store, "template_enhanced")[5]["features"] == [numbers[5][2]]


def test_scaled_and_selected(spark, store):
    vectors, numbers, _, sources = table()
    full = np.hstack([vectors, numbers[:, [0, 2, 3, 4, 5]]])
    want = np.zeros_like(full)
    for s in set(sources):
        own = np.array([x == s for x in sources])
        spread = full[own].std(axis=0)
        want[own] = (full[own] - full[own].mean(axis=0)) / np.where(spread < 1e-12, 1, spread)
    got = read(spark, store, "scaled")
    names = FS.variant_features(spark, store, "scaled")
    assert names == ["vec_0", "vec_1", "vec_2", "a", "c", "d", "e", "f"]
    assert np.allclose([got[i]["features"] for i in range(60)], want, atol=1e-9)
    chosen = FS.variant_features(spark, store, "selected")
    assert len(chosen) == 4 and chosen[0] == "c"  # the label is its sign
    picked = read(spark, store, "selected")
    assert np.allclose([picked[i]["features"] for i in range(60)], want[:, [names.index(c) for c in chosen]], atol=1e-9)
    assert {r["total_features"] for r in FS.read_selection(spark, store).collect()} == {8}


def test_reader_scans_its_columns_only(spark, store):
    plan = FS.read_variant(spark, store, "template_enhanced")._jdf.queryExecution().executedPlan().toString()
    assert "vec" not in plan.split("ReadSchema")[1] and "<log_id:bigint,label:int,c:double>" in plan


def test_empty_and_single_class(spark, tmp_path):
    schema = "log_id long, source string, label int, vec array<double>, a double"
    for name, rows in (("empty", []), ("one", [(1, "s", 0, [1.0, 2.0], 3.0), (2, "s", 0, None, None)])):
        path = str(tmp_path / name)
        FS.write_store(spark.createDataFrame(rows, schema), path, groups={"statistical": ["a"]})
        got = read(spark, path, "scaled")
        assert len(got) == len(rows) and all(len(r["features"]) == 3 for r in got.values())
        assert all(r["features"] == [] for r in read(spark, path, "selected").values())


def test_selected_scales_each_kept_feature_once(spark, store):
    plan = FS.read_variant(spark, store, "selected").select("features")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 1 and "transform(" not in plan


def test_selected_of_a_source_without_moments(spark, tmp_path):
    rows = [(i, "ab"[i % 2], i % 2 if i < 8 else 0, [float(i), 1.0], float(i * i)) for i in range(10)] + [(10, "c", 1, [2.0, 3.0], 4.0)]
    path = str(tmp_path / "s")
    FS.write_store(spark.createDataFrame(rows, "log_id long, source string, label int, vec array<double>, a double"), path,
                   groups={"statistical": ["a"]}, train="source != 'c'", k=2, trees=3)
    assert read(spark, path, "selected")[10]["features"] == [None, None] and read(spark, path, "scaled")[10]["features"] is None
    assert None not in read(spark, path, "selected")[3]["features"]
