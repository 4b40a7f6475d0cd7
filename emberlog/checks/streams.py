from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.checks.base import check, r6
from emberlog.checks.series import GAP_SQL
from emberlog.checks.vectors import SERVING_SQL
from emberlog.durable import fresh_path
from emberlog.functions.text import error_flag_columns
from emberlog.operators import models as M
from emberlog.operators.draws import uniform
from emberlog.operators.windows import _gap
from emberlog.streaming import history as H
from emberlog.streaming import jobs as J
from emberlog.streaming import leaders as ST


def table_stream(v, name):
    """A table as a file stream. The pattern finds a single file as well as a folder of files."""
    return v.spark.readStream.schema(v.table(name).schema).parquet(f"{v.sf_dir}/{name}.parque[t]")


def log_stream(v):
    """The events table as a file stream, in the shape of the logs view."""
    return table_stream(v, "events").select(
        F.col("event_id").alias("log_id"),
        F.concat(F.lit("s"), F.col("user_id") % 16).alias("source"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        "value",
    )


def _times(df):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias(c)
    return df.select(*[text(c) if c in ("window_start", "window_end") else F.col(c) for c in df.columns])


# a window is final once the watermark, ten minutes behind the newest row, has passed its end
FINAL = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM logs)"


@check("st1_tumbling_counts", "logs", f"""
WITH w AS (SELECT date_trunc('minute', ts) AS b, source, count(*) AS n, sum(label)::BIGINT AS anomalies, avg(label) AS rate FROM logs GROUP BY 1, 2)
SELECT strftime(b, '%Y-%m-%d %H:%M:%S.%g') AS window_start, strftime(b + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S.%g') AS window_end, source, n, anomalies,
  round(rate, 6) AS anomaly_rate FROM w WHERE b + INTERVAL 1 MINUTE <= {FINAL}""")
def _(v):
    return _times(J.collect_stream(J.stream_counts(log_stream(v))).withColumn("anomaly_rate", r6("anomaly_rate")))


@check("st2_sliding_counts", "logs", f"""
WITH f AS (SELECT source, ts, label AS hit FROM logs),
e AS (SELECT source, hit, time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 1 MINUTE * unnest(range(5)) AS b FROM f),
w AS (SELECT b, source, count(*) AS n, sum(hit)::BIGINT AS error_density FROM e GROUP BY b, source)
SELECT strftime(b, '%Y-%m-%d %H:%M:%S.%g') AS window_start, strftime(b + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S.%g') AS window_end, source, n, error_density
FROM w WHERE b + INTERVAL 5 MINUTE <= {FINAL}""")
def _(v):
    flags = error_flag_columns()
    stream = log_stream(v).withColumns(flags)
    return _times(J.collect_stream(J.stream_sliding(stream, flags=list(flags))))


@check("st3_session_windows", "logs", f"""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY source ORDER BY ts, log_id) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM logs),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
w AS (SELECT source, min(ts) AS a, max(ts) + INTERVAL 1 HOUR AS b, count(*) AS n, sum(label)::BIGINT AS anomalies, avg(label) AS rate FROM s GROUP BY source, k)
SELECT strftime(a, '%Y-%m-%d %H:%M:%S.%g') AS window_start, strftime(b, '%Y-%m-%d %H:%M:%S.%g') AS window_end, source, n, anomalies, round(rate, 6) AS anomaly_rate
FROM w WHERE b <= {FINAL}""")
def _(v):
    out = J.collect_stream(J.stream_sessions(log_stream(v), "1 hour"))
    return _times(out.withColumn("anomaly_rate", r6("anomaly_rate")))


@check("st4_stream_history", "logs", f"SELECT log_id, round({GAP_SQL}, 6) AS time_diff_seconds FROM logs")
def _(v):
    out = J.stream_history(log_stream(v).select("log_id", "source", "ts"), lambda w: {"time_diff_seconds": _gap(w, "ts")})
    return out.select("log_id", r6("time_diff_seconds").alias("time_diff_seconds"))


@check("st4_keyed_history", "logs", f"SELECT log_id, source, round({GAP_SQL}, 6) AS time_diff_seconds FROM logs")
def _(v):
    out = H.run_history(log_stream(v).select("log_id", "source", "ts"))
    return out.select("log_id", "source", r6("gap").alias("time_diff_seconds"))


@check("st4_keyed_vectors", "vecs", SERVING_SQL)
def _(v):
    stream = table_stream(v, "embeddings").select(
        F.col("vec_id").alias("log_id"), F.concat(F.lit("s"), F.col("label") % 4).alias("source"),
        F.timestamp_seconds(F.col("vec_id") + 86_400).alias("ts"), F.col("embedding").alias("vec"))
    out = H.run_history(stream, vec="vec").drop("gap", "source")
    return out.select("log_id", *[r6(c, 5).alias(c) for c in out.columns if c != "log_id"])


@check("st5_stream_templates", "logs", "SELECT content AS template, count(*) AS n FROM logs GROUP BY content")
def _(v):
    stream = log_stream(v).withColumnRenamed("content", "template")
    return J.collect_stream(J.stream_templates(stream), "update", ["template"])


@check("st5_mined_templates", "logs", """
SELECT source, count(*) AS n_lines, count(*) AS n_counted, TRUE AS has_templates FROM logs WHERE trim(content) <> '' GROUP BY source""")
def _(v):
    # three files, a batch each
    folder = fresh_path(v.spark, "mined-in")
    v.logs.select("log_id", "source", "content").repartition(3).write.parquet(folder)
    stream = v.spark.readStream.schema("log_id long, source string, content string").option("maxFilesPerTrigger", 1).parquet(folder)
    store = ST.stream_mined(stream)
    lines = store.lines().filter("template_id >= 0").groupBy("source").agg(F.count("*").alias("n_lines"), F.count_distinct("template_id").alias("_ids"))
    counted = store.templates().groupBy("source").agg(F.sum("n").alias("n_counted"), F.count("*").alias("_templates"))
    return lines.join(counted, "source").select("source", "n_lines", "n_counted", (F.col("_ids") == F.col("_templates")).alias("has_templates"))


@check("st6_stream_scoring")
def _(v):
    # fitted on a drawn half of the rows; the stream brings the other half
    drawn = uniform("log_id") < 0.5
    model = M.train_text(v.logs.filter(drawn))
    later = log_stream(v).filter(~drawn)
    return J.stream_score(later, lambda b: M.score_text(model, b).select("log_id", "source", "label", "p"))


@check("st7_late_rows", "logs", """
WITH l AS (SELECT *, row_number() OVER (ORDER BY ts, log_id) AS k, max(ts) OVER (ORDER BY ts, log_id) AS upto FROM logs),
e AS (SELECT min(CASE WHEN log_id % 10 <> 0 THEN ts END) AS a, max(CASE WHEN log_id % 10 <> 0 THEN ts END) AS b FROM logs),
late AS (SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE <= b - INTERVAL 1 HOUR AS dropped FROM logs, e WHERE log_id % 10 = 0)
SELECT (SELECT count(*) FROM late WHERE dropped) AS dropped, (SELECT count(*) FROM logs) - (SELECT count(*) FROM late WHERE dropped) AS kept""")
def _(v):
    # two parts, each of the files its tasks write: nine rows of ten first, the rest a batch later, most of it behind the watermark
    folder, out = fresh_path(v.spark, "late"), fresh_path(v.spark, "late-out")
    rows = v.logs.withColumn("second", F.col("log_id") % 10 == 0)
    dropped = kept = 0
    for second in (False, True):
        rows.filter(F.col("second") == second).drop("second").write.mode("append").parquet(folder)
        stream = v.spark.readStream.schema(v.logs.schema).parquet(folder)
        query, path = J.run_available(J.stream_counts(stream, "1 minute", "1 hour"), "update", out)
        dropped += J.late_rows(query)
    # in update mode a window is reported with its whole count whenever it changes
    windows = v.spark.read.parquet(path).groupBy("window_start", "source").agg(F.max_by("n", "batch").alias("n"))
    return windows.agg(F.lit(dropped).cast("long").alias("dropped"), F.sum("n").alias("kept"))
