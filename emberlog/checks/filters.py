from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.checks.base import check, r6
from emberlog.functions import labels as L
from emberlog.operators import profile as P


def _first_hit_sql(col, rules):
    cases = " ".join(f"WHEN contains(lower({col}), '{w}') THEN '{n}'" for w, n in rules)
    return f"CASE {cases} ELSE 'unknown' END"


NAME_SQL = "lang || '_' || source || '_' || text || '.csv'"


@check("flt1_source_type_from_name", sql=f"""
SELECT doc_id, {_first_hit_sql(NAME_SQL, L.NAME_RULES)} AS source_type FROM documents""")
def _(v):
    name = F.concat(F.concat_ws("_", "lang", "source", "text"), F.lit(".csv"))
    return v.documents.select("doc_id", L.source_type_from_name(name).alias("source_type"))


@check("flt2_source_type_from_text", sql=f"""
SELECT doc_id, {_first_hit_sql('text', L.TEXT_RULES)} AS source_type FROM documents""")
def _(v):
    return v.documents.select("doc_id", L.source_type_from_text("text").alias("source_type"))


@check("flt3_log_record_shape", "logs", f"""
SELECT content AS raw, content, {_first_hit_sql('content', L.TEXT_RULES)} AS source_type,
  0 AS has_timestamp FROM logs""")
def _(v):
    return L.parse_logs(v.logs).withColumn("has_timestamp", F.col("timestamp").isNotNull().cast("int")).drop(
        "timestamp"
    )


def raw_label():
    """-1 to 8 and null, from user_id."""
    return F.when(F.col("user_id") % 11 == 10, None).otherwise((F.col("user_id") % 11 - 1).cast("int"))


RAW_LABEL_SQL = "CASE WHEN user_id % 11 = 10 THEN NULL ELSE user_id % 11 - 1 END"


@check("flt4_binary_label_ingest", sql=f"""
SELECT event_id, CASE WHEN greatest(0, least(6, coalesce({RAW_LABEL_SQL}, 0))) > 0 THEN 1 ELSE 0 END AS label
FROM events""")
def _(v):
    return v.table("events").select("event_id", L.binarize_label(raw_label()).alias("label"))


@check("flt5_binary_label_feature", sql=f"""
WITH raw AS (SELECT event_id, coalesce({RAW_LABEL_SQL}, 0) AS l FROM events)
SELECT event_id, CASE WHEN l < 0 OR l > 6 THEN 0 WHEN l > 0 THEN 1 ELSE 0 END AS label FROM raw""")
def _(v):
    return v.table("events").select("event_id", L.binarize_label(raw_label(), "feature").alias("label"))


@check("flt6_label_name", sql=f"""
WITH raw AS (SELECT event_id, {RAW_LABEL_SQL} AS l FROM events)
SELECT event_id, CASE l {' '.join(f"WHEN {k} THEN '{n}'" for k, n in L.LABEL_NAMES.items())} ELSE 'unlabeled' END AS label_name
FROM raw""")
def _(v):
    return v.table("events").select("event_id", L.label_name(raw_label()).alias("label_name"))


@check("flt7_log_query", "logs", """
SELECT log_id, source, content, value FROM logs
WHERE source = 's3' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""")
def _(v):
    return L.query_logs(v.logs, "s3", "2024-01-05 00:00:00", "2024-01-20 12:00:00").select(
        "log_id", "source", "content", "value"
    )


@check("flt8_prediction_query", "preds", """
SELECT model AS model_type, log_id, p AS predicted_class, score FROM preds WHERE model = 'm37' AND p = 1""")
def _(v):
    stored = v.preds.select(F.col("model").alias("model_type"), "log_id", F.col("p").alias("predicted_class"), "score")
    return L.query_predictions(stored, "m37", 1)


@check("flt9_labelled_only", "tpl", """
SELECT log_id, source, label FROM (SELECT log_id, source, coalesce(label, -1) AS label FROM tpl) WHERE label >= 0""")
def _(v):
    return L.labelled(v.tpl.select("log_id", "source", F.coalesce("label", F.lit(-1)).alias("label")))


@check("flt10_usable_sources", "tpl", """
WITH ok AS (SELECT source FROM tpl WHERE source <> 'src3' GROUP BY source
  HAVING count(DISTINCT label) >= 2 AND count(*) FILTER (label IS NULL) < count(*))
SELECT log_id, source FROM tpl WHERE source IN (SELECT source FROM ok)""")
def _(v):
    return P.usable_sources(v.tpl, exclude=["src3"], null_labels="any_labelled").select("log_id", "source")


@check("flt10_usable_sources_strict", "texts", """
WITH ok AS (SELECT source FROM texts GROUP BY source HAVING count(DISTINCT label) >= 2 AND count(*) = count(label))
SELECT source, count(*) AS n_rows FROM texts WHERE source IN (SELECT source FROM ok) GROUP BY source""")
def _(v):
    return P.usable_sources(v.texts).groupBy("source").agg(F.count("*").alias("n_rows"))


@check("flt11_fill_features", "tpl", """
SELECT log_id, coalesce(label, 0) AS label, coalesce(CASE WHEN label = 1 THEN 2.5 END, 0.0)::DOUBLE AS score FROM tpl""")
def _(v):
    return L.fill_features(
        v.tpl.select("log_id", "label", F.when(F.col("label") == 1, 2.5).alias("score")), ["label", "score"]
    )


@check("flt12_viable_classes", "logs", """
WITH seven AS (SELECT source, label * 3 + CAST(floor(value) AS BIGINT) % 3 AS label FROM logs),
t AS (SELECT label, count(*) AS n, count(DISTINCT source) AS n_sources FROM seven GROUP BY label)
SELECT label, n, n_sources, CASE WHEN n >= 100 AND n_sources >= 0.3 * (SELECT count(DISTINCT source) FROM seven)
  THEN 1 ELSE 0 END AS recommended FROM t WHERE n >= 50""")
def _(v):
    seven = v.logs.withColumn("label", F.col("label") * 3 + F.floor("value") % 3)
    return P.viable_classes(seven)
