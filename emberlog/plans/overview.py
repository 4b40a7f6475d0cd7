"""The flagship plan: scan, calendar, gaps, trailing load and class balance per source."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.functions.temporal import add_calendar
from emberlog.operators import profile as P
from emberlog.operators import windows as W
from emberlog.operators.ordering import attach


def source_overview(logs):
    """One row per source, ordered by anomaly rate."""
    gaps = W.add_gap_flags(add_calendar(W.add_time_gap(logs.select("log_id", "source", "ts", "label"))))
    rows = gaps.groupBy("source").agg(
        F.count("*").alias("n_rows"),
        F.sum("label").alias("anomalies"),
        (F.sum("label") * 100.0 / F.count("*")).alias("anomaly_rate"),
        F.sum("is_burst").alias("bursts"),
        F.sum("is_isolated").alias("isolated"),
        F.sum("is_weekend").alias("weekend_rows"),
        F.sum("is_night").alias("night_rows"),
    )
    peaks = W.trailing_sums(logs, {"load": F.count("*")}, {"5min": 300}).groupBy("source").agg(
        F.max("load_5min").alias("peak_5min")
    )
    ratios = P.imbalance(logs).select("source", "imbalance_ratio")
    out = attach(attach(rows, peaks, ["source"]), ratios, ["source"])
    return out.withColumn("tier", P.imbalance_tier("imbalance_ratio")).orderBy(F.col("anomaly_rate").desc(), "source")
