from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.checks.base import check, r6
from emberlog.functions.text import error_flag_columns
from emberlog.operators import windows as W

ORDER = "PARTITION BY source ORDER BY ts, log_id"
GAP_SQL = (
    f"coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER ({ORDER})) / 1000000.0::DOUBLE, 0.0)::DOUBLE"
)


@check("win1_time_gap", "wide", f"""
SELECT log_id, round({GAP_SQL}, 6) AS time_diff_seconds FROM wide""")
def _(v):
    return W.add_time_gap(v.wide).select("log_id", r6("time_diff_seconds").alias("time_diff_seconds"))


@check("win1_time_gap_logs", "logs", f"""
SELECT log_id, round({GAP_SQL}, 6) AS time_diff_seconds FROM logs""")
def _(v):
    return W.add_time_gap(v.logs).select("log_id", r6("time_diff_seconds").alias("time_diff_seconds"))


@check("win2_burst_and_isolated", "logs", f"""
WITH g AS (SELECT log_id, {GAP_SQL} AS gap FROM logs)
SELECT log_id, CASE WHEN gap < 1 THEN 1 ELSE 0 END AS is_burst, CASE WHEN gap > 300 THEN 1 ELSE 0 END AS is_isolated FROM g""")
def _(v):
    return W.add_gap_flags(W.add_time_gap(v.logs)).select("log_id", "is_burst", "is_isolated")


@check("win3_log_index", "wide", f"SELECT log_id, row_number() OVER ({ORDER}) - 1 AS log_index FROM wide")
def _(v):
    return W.add_log_index(v.wide).select("log_id", "log_index")


SECOND_ORDER = "PARTITION BY source ORDER BY epoch_us(ts) // 1000000"


@check("win4_trailing_counts", "logs", f"""
SELECT log_id, {', '.join(f"count(*) OVER ({SECOND_ORDER} RANGE BETWEEN {s} PRECEDING AND CURRENT ROW) AS log_count_{n}"
  for n, s in W.SPANS.items())} FROM logs""")
def _(v):
    return W.add_trailing_counts(v.logs).drop("source", "ts", "content", "label", "value")


@check("win4_trailing_counts_wide", "wide", f"""
SELECT log_id, count(*) OVER ({SECOND_ORDER} RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW) AS log_count_2d FROM wide""")
def _(v):
    return W.add_trailing_counts(v.wide, {"2d": 172800}).select("log_id", "log_count_2d")


@check("win5_minute_count", "logs", """
SELECT log_id, count(*) OVER (PARTITION BY source, date_trunc('minute', ts)) AS logs_last_10 FROM logs""")
def _(v):
    return W.add_minute_count(v.logs).select("log_id", "logs_last_10")


LAST10 = f"OVER ({ORDER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@check("win6_rolling_stats", "logs", f"""
WITH g AS (SELECT log_id, source, ts, length(content) AS content_length, {GAP_SQL} AS gap FROM logs)
SELECT log_id, round(avg(content_length) {LAST10}, 4) AS content_length_mean_10,
  round(coalesce(stddev_samp(content_length) {LAST10}, 0), 4) AS content_length_std_10,
  round(avg(gap) {LAST10}, 4) AS time_diff_mean_10, round(coalesce(stddev_samp(gap) {LAST10}, 0), 4) AS time_diff_std_10 FROM g""")
def _(v):
    out = W.add_rolling_stats(v.logs)
    names = ["content_length_mean_10", "content_length_std_10", "time_diff_mean_10", "time_diff_std_10"]
    return out.select("log_id", *[r6(n, 4).alias(n) for n in names])


@check("win7_error_density", "logs", f"""
WITH f AS (SELECT log_id, source, ts, CASE WHEN regexp_matches(lower(content), '(^|[^\\p{{L}}\\p{{N}}_])(error|critical|alert|emergency)([^\\p{{L}}\\p{{N}}_]|$)')
  THEN 1 ELSE 0 END AS flags FROM logs)
SELECT log_id, {', '.join(f"(sum(flags) OVER ({SECOND_ORDER} RANGE BETWEEN {s} PRECEDING AND CURRENT ROW))::BIGINT AS error_density_{n}"
  for n, s in W.SPANS.items())} FROM f""")
def _(v):
    flags = error_flag_columns()
    flagged = v.logs.withColumns(flags)
    out = W.add_error_density(flagged, list(flags))
    return out.select("log_id", *[f"error_density_{n}" for n in W.SPANS])


@check("win8_same_class_ratio", "logs", f"""
WITH w AS (SELECT log_id, label, sum(label) OVER ({ORDER} ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) AS ones,
  count(*) OVER ({ORDER} ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) AS n FROM logs)
SELECT log_id, round(CASE WHEN label = 1 THEN ones ELSE n - ones END / n::DOUBLE, 6) AS same_class_ratio,
  CASE WHEN label = 1 THEN 1 ELSE 0 END AS minority_class_indicator FROM w""")
def _(v):
    return W.same_class_ratio(v.logs).select("log_id", r6("same_class_ratio").alias("same_class_ratio"), "minority_class_indicator")


@check("win9_scaled_position", "logs", f"""
SELECT log_id, round((row_number() OVER ({ORDER}) - 1) / (count(*) OVER (PARTITION BY source) - 1 + 1e-8), 6)::DOUBLE AS position FROM logs""")
def _(v):
    return W.add_position(v.logs).select("log_id", r6("position").alias("position"))


RESULTS_SQL = """r AS (SELECT model, source, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS f1 FROM preds GROUP BY model, source)"""


def results(v):
    return v.preds.groupBy("model", "source").agg(
        r6(F.avg(F.when(F.col("y") == F.col("p"), 1.0).otherwise(0.0))).alias("f1")
    )


@check("win10_best_model_per_split", "preds", f"""
WITH {RESULTS_SQL}
SELECT model, source, f1 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f1 DESC, model) AS k FROM r) WHERE k = 1""")
def _(v):
    return W.best_per_split(results(v))


@check("win12_consecutive_in_template", "logs", """
WITH n AS (SELECT log_id, lead(log_id) OVER (PARTITION BY source, content ORDER BY log_id) AS next_id FROM logs)
SELECT log_id, next_id FROM n WHERE next_id IS NOT NULL""")
def _(v):
    out = W.next_in_group(v.logs, "content").filter("prev_id IS NOT NULL")
    return out.select(F.col("prev_id").alias("log_id"), F.col("log_id").alias("next_id"))


@check("win13_sessions", "logs", f"""
WITH g AS (SELECT log_id, source, ts, {GAP_SQL} AS gap FROM logs)
SELECT log_id, (sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END) OVER ({ORDER} ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM g""")
def _(v):
    return W.sessionize(v.logs, 3600).select("log_id", "session")


@check("jn2_hour_frequency", "logs", """
SELECT log_id, count(*) OVER (PARTITION BY source, hour(ts)) AS hour_frequency FROM logs""")
def _(v):
    return W.add_hour_frequency(v.logs).select("log_id", "hour_frequency")
