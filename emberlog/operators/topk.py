"""Ranked lists, paging, and operators on sets of sources and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from emberlog.operators.ordering import with_sequence


def top_anomalies(df, n=10, p="p", score="score", key="log_id"):
    return df.filter(F.col(p) == 1).orderBy(F.col(score).desc(), key).limit(n)


def rank_sources(profile, done=None, by="source"):
    """Labelling priority of the sources not done yet, highest first."""
    if done is not None:
        profile = profile.join(done.select(by), by, "left_anti")
    priority = (
        F.col("anomaly_rate") * 0.4
        + F.greatest(F.lit(0.0), 100 - F.col("templates") / 20) * 0.3
        + F.least(F.lit(100.0), F.col("efficiency") / 10) * 0.3
    )
    return profile.withColumn("priority", priority).orderBy(F.col("priority").desc(), by)


def leaderboard(df, by="model_type", score="f1", name="model"):
    """Best run per model type, best first."""
    best = df.groupBy(by).agg(F.max(F.struct(score, name)).alias("b"))
    return best.select(by, F.col(f"b.{name}").alias(name), F.col(f"b.{score}").alias(score)).orderBy(F.col(score).desc(), by)


def page(df, after=None, size=50, max_size=1000, ts="ts", key="log_id"):
    """Newest first. ``after`` is the (ts, key) of the last row seen; no offset is counted."""
    if size > max_size:
        raise ValueError(f"a page holds {max_size} rows at most")
    if after is not None:
        when, last = after
        when = F.lit(when).cast("timestamp")
        df = df.filter((F.col(ts) <= when) & ((F.col(ts) < when) | (F.col(key) < last)))
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(size)


def split_sources(ratios, share=0.8, by="source", ratio="imbalance_ratio"):
    """Sources by rising imbalance; the first share trains, the rest validates."""
    ranked = with_sequence(ratios, [], [ratio, by], name="rank", total="_n")
    return ranked.withColumn("part", F.when(F.col("rank") < F.floor(F.col("_n") * share), "train").otherwise("validate")).drop("_n")


def combine(frames):
    """Union by name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_sources(frames, by="source"):
    return reduce(lambda a, b: a.intersect(b), [f.select(by) for f in frames])


def validate_classes(train, test, label="label"):
    """Every class with where it occurs: both, unseen (test only), missing (train only)."""
    a = train.select(label).distinct().withColumn("in_train", F.lit(1))
    b = test.select(label).distinct().withColumn("in_test", F.lit(1))
    return a.join(b, label, "full").select(
        label,
        F.when(F.col("in_train").isNull(), "unseen").when(F.col("in_test").isNull(), "missing").otherwise("both").alias("status"),
    )
