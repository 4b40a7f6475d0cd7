from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.checks.base import check, r6
from emberlog.checks.fits import split
from emberlog.checks.labelled import STATS_SQL
from emberlog.checks.profiles import IMBALANCE_SQL
from emberlog.checks.vectors import two_classes
from emberlog.durable import fresh_path
from emberlog.functions.labels import source_type_from_text
from emberlog.operators import models as M
from emberlog.operators import profile as P
from emberlog.sources import log_files as L
from emberlog.sources import readers as R
from emberlog.sources import writers as S


@check("src1_csv_log_scan", "logs", """
SELECT log_id::VARCHAR AS "LineId", strftime(ts, '%y%m%d') AS "Date", strftime(ts, '%H%M%S') AS "Time", content AS "Content" FROM logs""")
def _(v):
    path = fresh_path(v.spark, "csv")
    v.logs.select(
        F.col("log_id").alias("LineId"), F.date_format("ts", "yyMMdd").alias("Date"), F.date_format("ts", "HHmmss").alias("Time"),
        F.col("content").alias("Content"),
    ).write.csv(path, header=True, escape='"')
    return R.read_logs(v.spark, path)


#: How the sixteen sources write their times (column -> pattern), and the part of a time they keep.
LAYOUTS = {
    "Android": ({"Date": "MM-dd", "Time": "HH:mm:ss.SSS"}, "milliseconds"),
    "Apache": ({"Time": "EEE MMM dd HH:mm:ss yyyy"}, "second"),
    "BGL": ({"Date": "yyyy.MM.dd"}, "day"),
    "Hadoop": ({"Date": "yyyy-MM-dd", "Time": "HH:mm:ss,SSS"}, "milliseconds"),
    "HDFS": ({"Date": "yyMMdd", "Time": "HHmmss"}, "second"),
    "HealthApp": ({"Time": "yyyyMMdd-H:m:s:SSS"}, "milliseconds"),
    "HPC": ({"Time": None}, "second"),
    "Linux": ({"Month": "MMM", "Date": "d", "Time": "HH:mm:ss"}, "second"),
    "Mac": ({"Month": "MMM", "Date": "d", "Time": "HH:mm:ss"}, "second"),
    "OpenSSH": ({"Date": "MMM", "Day": "d", "Time": "HH:mm:ss"}, "second"),
    "OpenStack": ({"Date": "yyyy-MM-dd", "Time": "HH:mm:ss.SSS"}, "milliseconds"),
    "Proxifier": ({"Time": "MM.dd HH:mm:ss"}, "second"),
    "Spark": ({"Date": "yy/MM/dd", "Time": "HH:mm:ss"}, "second"),
    "Thunderbird": ({"Month": "MMM", "Day": "d", "Time": "HH:mm:ss"}, "second"),
    "Windows": ({"Date": "yyyy-MM-dd", "Time": "HH:mm:ss"}, "second"),
    "Zookeeper": ({"Date": "yyyy-MM-dd", "Time": "HH:mm:ss,SSS"}, "milliseconds"),
}
MESSAGES = {"Proxifier": "Message", "Mac": "content"}  # the others write Content


def write_sources(v, folder, message=lambda i, name: name):
    """The logs as CSV files of every source in a folder of its own, each file with its header."""
    for i, (name, (times, _)) in enumerate(LAYOUTS.items()):
        made = [F.unix_seconds("ts").alias(c) if p is None else F.date_format("ts", p).alias(c) for c, p in times.items()]
        column = message(i, MESSAGES.get(name, "Content"))
        rows = v.logs.filter(F.col("source") == f"s{i}").select(F.col("log_id").alias("LineId"), *made, F.col("content").alias(column))
        rows.write.csv(f"{folder}/{name}", header=True, escape='"')
    return f"{folder}/*/part-*.csv"


def _kept_sql():
    names = " ".join(f"WHEN 's{i}' THEN '{n.lower()}'" for i, n in enumerate(LAYOUTS))
    parts = " ".join(f"WHEN 's{i}' THEN date_trunc('{p}', ts)" for i, (_, p) in enumerate(LAYOUTS.values()))
    return f"SELECT CASE source {names} END AS source, log_id, content, strftime(CASE source {parts} END, '%Y-%m-%d %H:%M:%S.%g') AS ts FROM logs"


@check("src2_sources_by_file_name", "logs", _kept_sql())
def _(v):
    from emberlog.functions.labels import canonical_source
    from emberlog.functions.timestamps import normalize_timestamps

    columns = sorted({c for times, _ in LAYOUTS.values() for c in times} | {"LineId"})
    logs, _ = L.read_log_files(v.spark, write_sources(v, fresh_path(v.spark, "sources")), columns, by="folder")
    year = v.logs.agg(F.year(F.min("ts"))).first()[0] or 1970
    return normalize_timestamps(logs, "source", default_year=year).select(
        canonical_source("source").alias("source"), F.col("LineId").cast("long").alias("log_id"), F.col("Content").alias("content"),
        F.col("timestamp_normalized").alias("ts"))


@check("src2_skipped_sources", "logs", f"""
SELECT CASE source {" ".join(f"WHEN 's{i}' THEN '{n}'" for i, n in enumerate(LAYOUTS))} END AS source, count(*) AS n_rows, NULL AS fault
FROM logs WHERE substr(source, 2)::INT % 4 <> 3 GROUP BY source
UNION ALL SELECT unnest({[n for i, n in enumerate(LAYOUTS) if i % 4 == 3]}), 0, 'no message column'""")
def _(v):
    # every fourth source writes its messages under a name that is none of a message
    glob = write_sources(v, fresh_path(v.spark, "sources"), lambda i, name: "Body" if i % 4 == 3 else name)
    logs, faults = L.read_log_files(v.spark, glob, by="folder")
    read = logs.groupBy("source").agg(F.count("*").alias("n_rows"), F.lit(None).cast("string").alias("fault"))
    return read.unionByName(faults.groupBy("source").agg(F.lit(0).cast("long").alias("n_rows"), F.min("fault").alias("fault")))


@check("src3_raw_text_lines", "lines", "SELECT source, count(*) AS n_lines, min(length(content)) AS shortest, max(length(content)) AS longest, count(*) AS last_id FROM lines GROUP BY source")
def _(v):
    path = fresh_path(v.spark, "text")
    v.documents.select("source", F.col("text").alias("value")).repartition("source").write.partitionBy("source").text(path)
    lines = R.read_raw_lines(v.spark, path + "/source=*")
    named = lines.withColumn("source", F.regexp_extract("file", "source=([^/]+)/", 1))
    return named.groupBy("source").agg(
        F.count("*").alias("n_lines"), F.min(F.length("content")).alias("shortest"), F.max(F.length("content")).alias("longest"),
        F.max("line_id").alias("last_id"),
    )


@check("src4_content_column", sql="SELECT doc_id, text AS content FROM documents")
def _(v):
    docs = v.documents
    return docs.select("doc_id", R.resolve_content(docs).alias("content"))


@check("src5_metric_load", "preds", """
SELECT model AS model_name, round(avg(score), 6) AS f1_score, 0.0::DOUBLE AS balanced_accuracy,
  CASE WHEN model <> 'm37' THEN round(max(score), 6) END AS auroc, count(*) AS test_samples FROM preds GROUP BY model""")
def _(v):
    path = fresh_path(v.spark, "json")
    per = v.preds.groupBy("model").agg(
        F.avg("score").alias("f1_macro"), F.max(F.when(F.col("model") != "m37", F.col("score"))).alias("auroc"),
        F.count("*").alias("test_samples"),
    )
    whole = per.agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("f1_macro", "auroc", "test_samples")))).alias("models"))
    whole.write.json(path)
    out = R.read_metrics(v.spark, path)
    return out.select("model_name", r6("f1_score").alias("f1_score"), "balanced_accuracy", r6("auroc").alias("auroc"), "test_samples")


@check("snk1_enhanced_log_writer", "logs", "SELECT log_id, content, label, source FROM logs")
def _(v):
    path = fresh_path(v.spark, "logs")
    S.write_logs(v.logs.select("log_id", "content", "label", "source"), path)
    return v.spark.read.parquet(path)


@check("snk2_feature_store", "vecs", "SELECT log_id, label, len(vec) AS width, round(vec[1]::DOUBLE, 5) AS first_value, source FROM vecs")
def _(v):
    path = fresh_path(v.spark, "features")
    S.write_features(M.prepare(v.vecs).withColumnRenamed("raw", "bert_only"), path)
    from pyspark.ml.functions import vector_to_array

    back = v.spark.read.parquet(path).withColumn("a", vector_to_array("bert_only"))
    return back.select("log_id", "label", F.size("a").alias("width"), r6(F.get("a", F.lit(0)), 5).alias("first_value"), "source")


@check("snk3_profile_writer", "texts", f"""
WITH {IMBALANCE_SQL.format(view='texts')} SELECT source, n_rows, n_classes, round(ratio, 6) AS imbalance_ratio FROM i""")
def _(v):
    path = fresh_path(v.spark, "profile")
    S.write_profile(P.imbalance(v.texts).withColumn("imbalance_ratio", r6("imbalance_ratio")), path)
    return v.spark.read.schema("source string, n_rows long, n_classes long, imbalance_ratio double").json(path)


def _scored(v):
    return v.texts.select(
        "log_id", F.col("content").alias("raw"), "content", source_type_from_text("content").alias("source_type"),
        F.col("label").alias("predicted_class"), F.when(F.col("label") == 1, "anomaly").otherwise("normal").alias("predicted_class_name"),
        F.lit(0.9).alias("confidence"), F.array(F.lit(0.1), F.lit(0.9)).alias("probabilities"),
        F.when(F.length("content") < 10, F.lit("too short")).alias("error"), F.lit("2024-01-01").alias("day"),
    )


@check("snk4_prediction_store", "texts", """
SELECT predicted_class, count(*) AS n FROM (SELECT label AS predicted_class, length(content) AS k FROM texts) WHERE k >= 10 GROUP BY predicted_class""")
def _(v):
    base = fresh_path(v.spark, "store")
    for _ in range(2):  # the second run brings nothing new
        S.save_predictions(_scored(v), base)
    return S.read_predictions(v.spark, base).groupBy("predicted_class").agg(F.count("*").alias("n"))


@check("snk4_new_sources_anti_join", "texts", """
WITH t AS (SELECT CASE WHEN contains(lower(content), 'apache') OR contains(lower(content), 'httpd') THEN 'apache'
  WHEN contains(lower(content), 'ssh') THEN 'openssh' WHEN contains(lower(content), 'kernel') OR contains(lower(content), 'systemd') THEN 'linux'
  WHEN contains(lower(content), 'hdfs') OR contains(lower(content), 'datanode') THEN 'hdfs' WHEN contains(lower(content), 'hadoop') THEN 'hadoop'
  WHEN contains(lower(content), 'android') THEN 'android' ELSE 'unknown' END AS name FROM texts)
SELECT DISTINCT name, 'Auto-detected ' || name || ' logs' AS description FROM t WHERE name <> 'unknown'""")
def _(v):
    known = v.spark.createDataFrame([("unknown",)], "name string")
    return S.new_sources(_scored(v), known).select("name", "description")


@check("snk5_labelling_progress", "tpl", """
WITH r AS (SELECT source, template, content, row_number() OVER (PARTITION BY source, template ORDER BY log_id) AS k, count(*) OVER (PARTITION BY source, template) AS n FROM tpl)
SELECT source, template, n, string_agg(content, ' || ' ORDER BY k) AS samples FROM r WHERE k <= 3 GROUP BY source, template, n""")
def _(v):
    path = fresh_path(v.spark, "progress")
    table = P.template_table(v.tpl).select("source", "template", "n", "samples")
    S.save_progress(table, path, fmt="csv")
    back = S.load_progress(v.spark, path, "csv", "source string, template string, n long, samples string")
    return back.withColumn("samples", F.array_join("samples", " || "))


@check("snk6_model_store")
def _(v):
    rest, held = split(v)
    path = fresh_path(v.spark, "model")
    S.save_model(M.train(rest, "lr"), path, v.spark, model="lr", f1=0.5)
    model, meta = S.load_model(path, v.spark)
    return M.predict(model, held).select("log_id", "p", "score", F.lit(meta["model"]).alias("model"))


@check("snk6_model_round_trip", "vecs", "SELECT log_id, TRUE AS same FROM vecs")
def _(v):
    # a model that is saved and loaded scores every row as before
    rows, path = two_classes(v), fresh_path(v.spark, "model")
    fitted = M.train(rows, "bayes", sampler=None)
    S.save_model(fitted, path, v.spark, model="bayes")
    loaded, _ = S.load_model(path, v.spark)
    before, after = (M.predict(m, rows).select("log_id", F.struct("p", "score").alias(n)) for m, n in ((fitted, "a"), (loaded, "b")))
    return before.join(after, "log_id").select("log_id", (F.col("a") == F.col("b")).alias("same"))
