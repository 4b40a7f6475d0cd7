"""Order operators on skewed input: one source holds most rows, many with one timestamp."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.operators import windows as W
from emberlog.operators.draws import hash_rank
from emberlog.operators.ordering import exact_quantiles, mid_ranks, over_rows, running_totals, with_sequence


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 3000
    source = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    seconds = np.where(rng.random(n) < 0.4, 500, rng.integers(0, 200_000, n))
    pdf = pd.DataFrame({
        "log_id": rng.permutation(n), "source": source, "ts": pd.to_datetime(seconds, unit="s"),
        "label": rng.integers(0, 2, n), "value": rng.integers(0, 50, n).astype(float),
    })
    return pdf.sort_values(["source", "ts", "log_id"]).reset_index(drop=True)


def frame(spark, pdf):
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("n", [1, 4, 32])
def test_sequence(spark, skewed, n):
    got = with_sequence(frame(spark, skewed), ["source"], ["ts", "log_id"], total="size", slices=n).toPandas()
    got = got.set_index("log_id").sort_index()
    want = skewed.set_index("log_id")
    assert (got["seq"] == want.groupby("source").cumcount().sort_index()).all()
    assert (got["size"] == want.groupby("source")["label"].transform("size").sort_index()).all()


@pytest.mark.parametrize("n", [1, 4, 32])
def test_running_totals(spark, skewed, n):
    got = running_totals(frame(spark, skewed), ["source"], ["ts", "log_id"], {"upto": F.col("value")}, slices=n).toPandas()
    want = skewed.assign(upto=skewed.groupby("source")["value"].cumsum()).set_index("log_id")["upto"]
    assert np.allclose(got.set_index("log_id")["upto"].sort_index(), want.sort_index())


def test_running_totals_without_keys(spark, skewed):
    got = running_totals(frame(spark, skewed), [], ["log_id"], {"upto": F.col("value")}).toPandas().set_index("log_id")
    want = skewed.sort_values("log_id").set_index("log_id")["value"].cumsum()
    assert np.allclose(got["upto"].sort_index(), want)


@pytest.mark.parametrize("chunk", [9, 50, 100_000])
def test_row_frames_cross_chunks(spark, skewed, chunk):
    ranked = with_sequence(frame(spark, skewed), ["source"], ["ts", "log_id"])
    got = over_rows(ranked, ["source"], 9, lambda w: {"s": F.sum("value").over(w.rowsBetween(-9, 0))}, chunk=chunk).toPandas()
    want = skewed.groupby("source")["value"].rolling(10, min_periods=1).sum().reset_index(level=0, drop=True)
    assert len(got) == len(skewed)
    assert np.allclose(got.set_index("log_id")["s"].sort_index(), want.set_axis(skewed["log_id"]).sort_index())


def test_trailing_counts_with_ties_and_nulls(spark, skewed):
    df = frame(spark, skewed).withColumn("ts", F.when(F.col("log_id") % 10 != 0, F.col("ts")))
    got = W.add_trailing_counts(df, {"x": 3600}).toPandas().set_index("log_id")["log_count_x"]
    kept = skewed[skewed["log_id"] % 10 != 0]
    sec = kept["ts"].astype("int64") // 10**9
    for source, part in kept.groupby("source"):
        s = np.sort(sec[part.index].to_numpy())
        own = sec[part.index].to_numpy()
        want = np.searchsorted(s, own, "right") - np.searchsorted(s, own - 3600, "left")
        assert (got[part["log_id"]].to_numpy() == want).all()
    assert (got[got.index % 10 == 0] == 0).all()


def test_sessions_and_gap(spark, skewed):
    got = W.sessionize(frame(spark, skewed), 300).toPandas().set_index("log_id")
    gap = skewed.groupby("source")["ts"].diff().dt.total_seconds().fillna(0)
    session = (gap > 300).groupby(skewed["source"]).cumsum()
    want = pd.DataFrame({"g": gap.values, "s": session.values}, index=skewed["log_id"])
    assert np.allclose(got["time_diff_seconds"].sort_index(), want["g"].sort_index())
    assert (got["session"].sort_index() == want["s"].sort_index()).all()


def test_hash_rank_is_a_permutation_and_repeats(spark, skewed, slices):
    df = frame(spark, skewed)
    first = hash_rank(df, ["source"], "log_id").toPandas().set_index("log_id")["draw_rank"]
    slices(3)
    again = hash_rank(df, ["source"], "log_id").toPandas().set_index("log_id")["draw_rank"]
    assert (first.sort_index() == again.sort_index()).all()
    for source, part in skewed.groupby("source"):
        assert sorted(first[part["log_id"]]) == list(range(1, len(part) + 1))
    cut = hash_rank(df, ["source"], "log_id", keep=20).toPandas()
    assert (cut.groupby("source").size() == 20).all()
    assert (first[cut["log_id"]].to_numpy() <= 20).all()


def test_quantiles_and_mid_ranks(spark, skewed):
    df = frame(spark, skewed)
    got = exact_quantiles(df, "value", [0.1, 0.5, 0.95], ["source"]).toPandas()
    for r in got.itertuples():
        assert r.quantile == pytest.approx(np.quantile(skewed[skewed["source"] == r.source]["value"], r.fraction))
    whole = exact_quantiles(df, "value", [0.25]).first()["quantile"]
    assert whole == pytest.approx(np.quantile(skewed["value"], 0.25))
    ranks = mid_ranks(df, ["source"], "value").toPandas().set_index("log_id")["mid_rank"]
    want = skewed.groupby("source")["value"].rank(method="average").set_axis(skewed["log_id"])
    assert np.allclose(ranks.sort_index(), want.sort_index())


def test_empty_input(spark, skewed):
    df = frame(spark, skewed).limit(0)
    assert with_sequence(df, ["source"], ["ts"]).count() == 0
    assert W.add_time_gap(df).count() == 0
    assert W.add_trailing_counts(df).count() == 0
    assert hash_rank(df, ["source"], "log_id").count() == 0


def test_trailing_sums_step_once_per_row(spark):
    """A second of totals costs a step and not its whole span; sums without a value stay null."""
    rows = [("a", 0, 1), ("a", 0, None), ("a", 5, None), ("a", 70, 4), ("a", 130, None), ("a", 200, None), ("b", 60, 2)]
    df = spark.createDataFrame(rows, "source string, s long, m int").select("source", F.timestamp_seconds("s").alias("ts"), "m")
    out = W.trailing_sums(df, {"m": F.sum("m"), "x": F.sum(F.col("m") / 2)}, {"1min": 60, "2min": 120})
    frames = re.findall(r"RangeFrame, ([^,]+),[^)]*\)+ AS m_", out._jdf.queryExecution().analyzed().toString())
    frames += re.findall(r"sum\(m#\d+L?\) windowspecdefinition\([^$]*RangeFrame, ([^,]+),", out._jdf.queryExecution().analyzed().toString())
    assert frames and all(f.startswith("unboundedpreceding") for f in frames)
    got = {(r["source"], r["_sec"]): (r["m_1min"], r["m_2min"], r["x_1min"]) for r in out.collect()}
    assert got == {
        ("a", 0): (1, 1, 0.5), ("a", 5): (1, 1, 0.5), ("a", 70): (4, 5, 2.0), ("a", 130): (4, 4, 2.0), ("a", 200): (None, None, None),
        ("b", 60): (2, 2, 1.0)}
