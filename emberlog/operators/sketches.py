"""Quantiles from mergeable KLL sketches, kept per group and day.

A day is sketched once, when it is complete; thresholds over any span of days come from merging
its sketches, without reading the rows again. A sketch holds a few thousand numbers at most,
whatever the rows behind it, and is built map-side, so a hot group is no hot task. With fewer
than about ``k`` values it is exact; beyond, the rank of an answer is off by at most
``rank_error(k)`` of the rows with a probability of 99 in 100. Merging does not widen that. Sketches draw at random: what is read from
one twice has to be written first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.durable import settle

K = 4096


def rank_error(k=K):
    """Published bound of a KLL sketch's rank error for a single quantile, as a share of the rows (99 % confidence)."""
    return 2.296 / k**0.9723


def sketch(df, value, by=(), k=K):
    """(by, n, sketch) of the non-null, finite values."""
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def write_daily(df, path, value, by=(), ts="ts", k=K):
    """Sketches by group and day below ``path``; a day that is written again replaces itself, other days stay."""
    days = sketch(df.withColumn("day", F.to_date(ts)), value, [*by, "day"], k)
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merge(sketches, by=(), k=K):
    """Sketches of groups of sketches."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def read_span(spark, path, by=(), first=None, last=None, k=K):
    """Merged sketches of the days from ``first`` to ``last``, ends included; only their folders are read."""
    days = spark.read.parquet(path)
    if first is not None:
        days = days.filter(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        days = days.filter(F.col("day") <= F.lit(last).cast("date"))
    return merge(days, by, k)


def quantiles(sketches, fractions, by=()):
    """(by, n, fraction, quantile): the value that at least ``fraction`` of the rows don't exceed, as the sketch knows it."""
    made = F.array(*[
        F.struct(F.lit(float(f)).alias("fraction"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(f))).alias("quantile"))
        for f in fractions])
    return sketches.select(*by, "n", F.explode(made).alias("q")).select(*by, "n", "q.*")


def exact_ranks(df, cuts, value, by=()):
    """``cuts`` with the exact shares of rows below and up to each quantile."""
    v, cuts = F.col(value).cast("double"), settle(cuts)  # a sketch that is made twice may answer otherwise
    arrays = cuts.groupBy(*by).agg(F.array_sort(F.collect_set("quantile")).alias("_cuts"))
    rows = df.select(*by, v.alias("_v")).join(arrays, list(by)) if by else df.select(v.alias("_v")).withColumn(
        "_cuts", F.array(*[F.lit(x) for x in arrays.first()["_cuts"]]))
    # one row per group and place among the cuts, whatever the number of rows
    place = lambda keep: F.size(F.filter("_cuts", keep))
    counted = rows.groupBy(*by, place(lambda c: c < F.col("_v")).alias("_above"), place(lambda c: c <= F.col("_v")).alias("_from"), "_cuts").agg(
        F.count("*").alias("_n"))
    spread = counted.select(*by, F.posexplode("_cuts").alias("_i", "quantile"), "_above", "_from", "_n")
    ranks = spread.groupBy(*by, "quantile").agg(
        (F.sum(F.when(F.col("_from") <= F.col("_i"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("below"),
        (F.sum(F.when(F.col("_above") <= F.col("_i"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("up_to"))
    return cuts.join(ranks, [*by, "quantile"])
