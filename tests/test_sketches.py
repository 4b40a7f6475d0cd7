"""Mergeable quantile sketches against exact ranks."""

import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from emberlog.operators import embeddings as E
from emberlog.operators import sketches as K


def rows(spark, n=60_000):
    """A third of all rows in one group and of one value, three days, nulls and values that are no numbers."""
    g = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5))
    x = F.when(F.col("id") % 9 == 0, 7.0).otherwise(F.pow(F.rand(3), 4) * 100)
    odd = F.when(F.col("id") % 1001 == 0, None).when(F.col("id") % 1003 == 0, float("nan")).when(F.col("id") % 1009 == 0, float("inf")).otherwise(x)
    return spark.range(n).select("id", g.alias("g"), F.timestamp_seconds(F.col("id") % 3 * 86_400).alias("ts"), odd.alias("x"))


def sound(df):
    return df.filter("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')")


def test_merged_days_stay_within_the_bound(spark, tmp_path):
    df, path = rows(spark).cache(), str(tmp_path / "days")
    K.write_daily(df, path, "x", ["g"], k=256)
    K.write_daily(df.filter("ts >= '1970-01-02'"), path, "x", ["g"], k=256)  # days again: nothing counts twice
    merged = K.read_span(spark, path, ["g"], k=256)
    cuts = K.quantiles(merged, [0.01, 0.2, 0.5, 0.9, 0.99], ["g"])
    got = K.exact_ranks(sound(df), cuts, "x", ["g"]).collect()
    assert len(got) == 6 * 5 and sum(r.n for r in got) == 5 * sound(df).count()
    error = 2 * K.rank_error(256)
    for r in got:
        assert r.below - error <= r.fraction <= r.up_to + error, r


def test_a_span_reads_its_days_only(spark, tmp_path):
    path = str(tmp_path / "days")
    K.write_daily(rows(spark, 3000), path, "x", ["g"])
    part = K.read_span(spark, path, [], "1970-01-02", "1970-01-02")
    out = io.StringIO()
    with redirect_stdout(out):
        part.explain("formatted")
    assert "PartitionFilters: [isnotnull(day" in out.getvalue()
    assert part.first().n == sound(rows(spark, 3000)).filter("to_date(ts) = '1970-01-02'").count()


def test_small_groups_are_exact(spark):
    values = [5.0, 1.0, 1.0, 9.0, 3.0]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = {r.fraction: r.quantile for r in K.quantiles(K.sketch(df, "x"), [0.2, 0.5, 1.0]).collect()}
    assert got == {0.2: 1.0, 0.5: 3.0, 1.0: 9.0}
    assert K.quantiles(K.sketch(df.limit(0), "x", ["x"]), [0.5], ["x"]).count() == 0
    ranks = K.exact_ranks(df, K.quantiles(K.sketch(df, "x"), [0.5]), "x").first()
    assert (ranks.below, ranks.up_to) == (0.4, 0.6)


def test_the_norm_score_takes_a_sketched_cut(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)))], "log_id long, vec array<double>")
    norms = df.select(E.vector_columns()["emb_magnitude"].alias("x"))
    cut = K.quantiles(K.sketch(norms, "x"), [0.75]).first().quantile
    assert E.norm_score(df, cut=cut).filter("predicted = 1").count() == 100
