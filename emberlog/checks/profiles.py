from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.checks.base import check, r6
from emberlog.functions.temporal import add_calendar
from emberlog.operators import labelling as LAB
from emberlog.operators import profile as P
from emberlog.operators import windows as W


@check("ag1_class_distribution", "logs", """
WITH t AS (SELECT source, count(*) AS total FROM logs GROUP BY source),
g AS (SELECT source, total, unnest([0, 1, 2]) AS label FROM t),
n AS (SELECT source, label, count(*) AS n FROM logs GROUP BY source, label)
SELECT g.source, g.label, coalesce(n.n, 0) AS n, round(coalesce(n.n, 0) * 100.0 / total, 6)::DOUBLE AS percent
FROM g LEFT JOIN n ON g.source = n.source AND g.label = n.label""")
def _(v):
    return P.class_distribution(v.logs, classes=(0, 1, 2)).withColumn("percent", r6("percent"))


@check("ag1_class_distribution_overall", "logs", """
SELECT label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM logs), 6)::DOUBLE AS percent FROM logs GROUP BY label""")
def _(v):
    return P.class_distribution(v.logs, by=()).withColumn("percent", r6("percent"))


IMBALANCE_SQL = """c AS (SELECT source, label, count(*) AS n FROM {view} GROUP BY source, label),
i AS (SELECT source, sum(n)::BIGINT AS n_rows, count(*) AS n_classes, min(n) AS smallest,
  CASE WHEN count(*) > 1 THEN max(n) / min(n)::DOUBLE END AS ratio FROM c GROUP BY source)"""


@check("ag2_imbalance_ratio", "texts", f"""
WITH {IMBALANCE_SQL.format(view='texts')}
SELECT source, n_rows, n_classes, smallest, round(ratio, 6) AS imbalance_ratio,
  CASE WHEN n_classes = 1 THEN 1 ELSE 0 END AS single_class FROM i""")
def _(v):
    return P.imbalance(v.texts).withColumn("imbalance_ratio", r6("imbalance_ratio"))


@check("ag3_class_presence", "texts", """
SELECT source, string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR) AS present,
  coalesce((SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM (SELECT unnest([0, 1, 2]) AS k)
    WHERE k NOT IN (SELECT label FROM texts u WHERE u.source = t.source)), '') AS missing FROM texts t GROUP BY source""")
def _(v):
    out = P.class_presence(v.texts, classes=(0, 1, 2))
    return out.select("source", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))


@check("ag4_class_availability", "texts", """
WITH s AS (SELECT DISTINCT source, label FROM texts), k AS (SELECT unnest([0, 1, 2]) AS label),
a AS (SELECT count(DISTINCT source) AS n_all FROM s),
h AS (SELECT k.label, count(s.source) AS n
  FROM k LEFT JOIN s ON k.label = s.label GROUP BY k.label)
SELECT label, n AS n_sources, round(n * 100.0 / n_all, 6)::DOUBLE AS coverage,
  CASE WHEN n * 100.0 / n_all < 50 THEN 1 ELSE 0 END AS low, CASE WHEN n < n_all * 0.3 THEN 1 ELSE 0 END AS rare,
  CASE WHEN n = 0 THEN 1 ELSE 0 END AS missing FROM h, a""")
def _(v):
    out = P.class_availability(v.texts, classes=(0, 1, 2))
    return out.withColumn("coverage", r6("coverage"))


@check("ag4_class_sources", "texts", "SELECT source, label, count(*) AS n FROM texts GROUP BY source, label")
def _(v):
    return P.class_sources(v.texts).select("source", "label", "n")


@check("ag5_minority_classes", "texts", """
WITH c AS (SELECT source, label, count(*) AS n FROM texts GROUP BY source, label),
w AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS k FROM c)
SELECT source, coalesce(string_agg(CASE WHEN k > 1 AND n < total * 0.05 THEN label END::VARCHAR, ',' ORDER BY label), '') AS minority,
  coalesce(string_agg(CASE WHEN k > 1 AND n < total * 0.01 THEN label END::VARCHAR, ',' ORDER BY label), '') AS extreme
FROM w GROUP BY source""")
def _(v):
    out = P.minority_classes(v.texts)
    return out.select("source", F.array_join("minority", ",").alias("minority"), F.array_join("extreme", ",").alias("extreme"))


@check("ag6_imbalance_tier", "texts", f"""
WITH {IMBALANCE_SQL.format(view='texts')}, r AS (SELECT source, smallest, coalesce(ratio, 1.0) AS ratio FROM i)
SELECT source,
  CASE WHEN ratio > 100 THEN 'extreme' WHEN ratio > 10 THEN 'high' WHEN ratio > 5 THEN 'moderate' ELSE 'balanced' END AS flag,
  CASE WHEN ratio > 100 THEN 'Extreme (>100:1)' WHEN ratio > 10 THEN 'High (10-100:1)' WHEN ratio > 5 THEN 'Moderate (5-10:1)'
    ELSE 'Balanced (≤5:1)' END AS named,
  CASE WHEN ratio > 100 OR smallest < 15 THEN 'extreme_imbalance' WHEN ratio > 10 THEN 'high_imbalance'
    WHEN ratio > 3 THEN 'moderate_imbalance' ELSE 'balanced' END AS strategy,
  CASE WHEN ratio > 100 OR smallest < 15 THEN 150 WHEN ratio > 10 THEN 120 ELSE 100 END AS epochs FROM r""")
def _(v):
    im = P.imbalance(v.texts, single_class=1.0)
    plan = P.training_strategy("imbalance_ratio", "smallest")
    return im.select(
        "source",
        P.imbalance_tier("imbalance_ratio").alias("flag"),
        P.imbalance_tier("imbalance_ratio", rules="named").alias("named"),
        plan["name"].alias("strategy"),
        plan["epochs"].alias("epochs"),
    )


@check("ag7_class_cooccurrence", "texts", """
WITH s AS (SELECT DISTINCT source, label FROM texts)
SELECT a.label AS class_i, count(*) FILTER (b.label = 0) AS "0", count(*) FILTER (b.label = 1) AS "1"
FROM s a JOIN s b USING (source) GROUP BY a.label""")
def _(v):
    return P.class_cooccurrence(v.texts)


def _contains_any(col, phrases):
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in phrases) + ")"


HITS_SQL = " + ".join(
    f"CASE WHEN {_contains_any('low', ps)} THEN 1 ELSE 0 END" for ps in LAB.normalized_seed_patterns().values()
)
PROFILE_SQL = rf"""l AS (SELECT source, template, trim(regexp_replace(regexp_replace(lower(content), '\d+', '<num>', 'g'),
  '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS low FROM tpl),
h AS (SELECT source, template, {HITS_SQL} AS hits FROM l),
per AS (SELECT source, template, count(*) AS n, sum(hits) AS hits FROM h GROUP BY source, template),
prof AS (SELECT source, sum(n)::BIGINT AS logs, count(*) AS templates, sum(n) / count(*)::DOUBLE AS efficiency,
  sum(hits) * 100.0 / sum(n)::DOUBLE AS anomaly_rate FROM per GROUP BY source)"""


@check("ag8_source_profile", "tpl", f"""
WITH {PROFILE_SQL},
top AS (SELECT source, template, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, template) AS k FROM per)
SELECT prof.source, logs, templates, round(efficiency, 6) AS efficiency, round(anomaly_rate, 6)::DOUBLE AS anomaly_rate,
  t.n AS top_count, t.template AS top_template FROM prof JOIN top t ON prof.source = t.source AND t.k = 1""")
def _(v):
    out = P.profile_sources(v.tpl, LAB.normalized_seed_patterns())
    best = F.col("top_templates")[0]
    return out.select(
        "source", "logs", "templates", r6("efficiency").alias("efficiency"), r6("anomaly_rate").alias("anomaly_rate"),
        best["n"].alias("top_count"), best["template"].alias("top_template"),
    )


@check("ag9_template_table", "tpl", """
WITH r AS (SELECT source, template, content, row_number() OVER (PARTITION BY source, template ORDER BY log_id) AS k,
  count(*) OVER (PARTITION BY source, template) AS n, count(*) OVER (PARTITION BY source) AS total FROM tpl)
SELECT source, template, n, round(n * 100.0 / total, 6)::DOUBLE AS percent, string_agg(content, ' || ' ORDER BY k) AS samples
FROM r WHERE k <= 3 GROUP BY source, template, n, total""")
def _(v):
    out = P.template_table(v.tpl)
    return out.withColumns({"percent": r6("percent"), "samples": F.array_join("samples", " || ")})


LABELLED_TPL_SQL = """lt AS (SELECT source, template, count(*) AS n, max(label) * 3 + max(label) * (count(*) % 4) AS label FROM tpl GROUP BY source, template)"""


def labelled_templates(v):
    """Templates with a label where their document has one; several classes, from the counts."""
    out = v.tpl.groupBy("source", "template").agg(F.count("*").alias("n"), F.max("label").alias("m"))
    return out.select("source", "template", "n", (F.col("m") * 3 + F.col("m") * (F.col("n") % 4)).cast("int").alias("label"))


@check("ag10_labelling_progress", "tpl", f"""
WITH {LABELLED_TPL_SQL}
SELECT source, count(*) AS templates, count(label) AS templates_labelled, sum(n)::BIGINT AS logs,
  coalesce(sum(n) FILTER (label IS NOT NULL), 0)::BIGINT AS logs_labelled,
  round(coalesce(sum(n) FILTER (label IS NOT NULL), 0) * 100.0 / sum(n), 6)::DOUBLE AS log_coverage,
  coalesce(sum(n) FILTER (label > 0), 0)::BIGINT AS logs_anomalous FROM lt GROUP BY source""")
def _(v):
    return P.labelling_progress(labelled_templates(v)).withColumn("log_coverage", r6("log_coverage"))


@check("ag11_label_mix", "tpl", f"""
WITH {LABELLED_TPL_SQL}
SELECT source, {', '.join(f"round(coalesce(sum(n) FILTER (label = {k}), 0) * 100.0 / sum(n), 6)::DOUBLE AS label_{k}" for k in range(8))}
FROM lt WHERE label IS NOT NULL GROUP BY source""")
def _(v):
    out = P.label_mix(labelled_templates(v))
    return out.select("source", *[r6(f"label_{k}").alias(f"label_{k}") for k in range(8)])


@check("ag12_completion_stats", "tpl", """
SELECT coalesce(source, 'TOTAL') AS source, count(*) AS logs, count(*) FILTER (label >= 0) AS labelled,
  count(*) FILTER (label > 0) AS anomalies,
  round(coalesce(count(*) FILTER (label > 0) * 100.0 / nullif(count(*) FILTER (label >= 0), 0), 0), 6)::DOUBLE AS anomaly_rate
FROM tpl GROUP BY ROLLUP (source)""")
def _(v):
    return P.completion_stats(v.tpl).withColumn("anomaly_rate", r6("anomaly_rate"))


@check("ag21_rollup_source_label", "logs", """
SELECT coalesce(source, 'TOTAL') AS source, coalesce(label, -1) AS label, count(*) AS n FROM logs GROUP BY ROLLUP (source, label)""")
def _(v):
    out = v.logs.rollup("source", "label").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("source", F.lit("TOTAL")).alias("source"), F.coalesce("label", F.lit(-1)).alias("label"), "n")


@check("ag13_score_summary", "preds", """
SELECT count(*) AS total_logs, count(*) FILTER (p = 1) AS anomaly_count, round(count(*) FILTER (p = 1) * 100.0 / count(*), 6)::DOUBLE AS anomaly_rate,
  round(avg(score), 6) AS avg_confidence, count(*) FILTER (p = 0) AS normal_rows FROM preds""")
def _(v):
    named = v.preds.select(
        F.col("p").alias("predicted_class"),
        F.when(F.col("p") == 1, "anomaly").otherwise("normal").alias("predicted_class_name"),
        F.col("score").alias("confidence"),
    )
    out = P.score_summary(named)
    return out.select(
        "total_logs", "anomaly_count", r6("anomaly_rate").alias("anomaly_rate"), r6("avg_confidence").alias("avg_confidence"),
        F.try_element_at("class_distribution", F.lit("normal")).alias("normal_rows"),
    )


@check("ag14_prediction_stats", "preds", """
SELECT coalesce(model, 'ALL') AS model_type, count(*) AS n, round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS anomaly_rate
FROM preds GROUP BY ROLLUP (model)""")
def _(v):
    stored = v.preds.select(F.col("model").alias("model_type"), F.col("p").alias("predicted_class"))
    return P.prediction_stats(stored).withColumn("anomaly_rate", r6("anomaly_rate"))


@check("ag15_distribution", "logs", "SELECT source, count(*) AS n FROM logs GROUP BY source")
def _(v):
    return P.distribution(v.logs, "source")


@check("ag15_distribution_newest", "logs", """
SELECT source, count(*) AS n FROM (SELECT source FROM logs ORDER BY log_id DESC LIMIT 1000) GROUP BY source""")
def _(v):
    return P.distribution(v.logs, "source", limit=1000)


RUNS_SQL = """r AS (SELECT model, source, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END)::DOUBLE AS f1, avg(score) AS bal FROM preds GROUP BY model, source)"""


def runs(v):
    return v.preds.groupBy("model", "source").agg(
        F.avg(F.when(F.col("y") == F.col("p"), 1.0).otherwise(0.0)).alias("f1"), F.avg("score").alias("bal")
    )


for _name, _kind in (("sample", "stddev_samp"), ("population", "stddev_pop")):

    @check(f"ag16_metric_summary_{_name}", "preds", f"""
WITH {RUNS_SQL}
SELECT model, count(*) AS n_runs, round(avg(f1), 6) AS f1_mean, round(avg(bal), 6) AS bal_mean,
  round({_kind}(f1), 6) AS f1_std, round({_kind}(bal), 6) AS bal_std FROM r GROUP BY model""")
    def _(v, kind=_name):
        out = P.summarize_metrics(runs(v), "model", ["f1", "bal"], std=kind)
        return out.select("model", "n_runs", *[r6(c).alias(c) for c in out.columns[2:]])


@check("ag17_best_model_frequency", "preds", f"""
WITH {RUNS_SQL}, b AS (SELECT model FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f1 DESC, model) AS k FROM r) WHERE k = 1)
SELECT model, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM b), 6)::DOUBLE AS percent FROM b GROUP BY model""")
def _(v):
    return P.value_frequency(W.best_per_split(runs(v)), "model").withColumn("percent", r6("percent"))


@check("ag18_metric_pivot", "preds", f"""
WITH {RUNS_SQL}
SELECT model, round(avg(f1), 6) AS f1, round(avg(bal), 6) AS bal FROM r GROUP BY model""")
def _(v):
    long = runs(v).unpivot(["model", "source"], ["f1", "bal"], "metric", "value")
    return P.metric_pivot(long, ["f1", "bal"]).select("model", r6("f1").alias("f1"), r6("bal").alias("bal"))


@check("ag19_recommendations", "texts", """
WITH c AS (SELECT source, label, count(*) AS n FROM texts GROUP BY source, label),
s AS (SELECT source, max(n) AS hi, min(n) AS lo, count(*) AS k FROM c GROUP BY source),
k AS (SELECT unnest([0, 1, 2, 3]) AS label),
h AS (SELECT k.label, count(c.source) AS n FROM k LEFT JOIN c ON c.label = k.label GROUP BY k.label),
f AS (SELECT (SELECT count(*) FROM s WHERE k > 1 AND hi > lo * 100) AS x,
  (SELECT count(*) FROM h WHERE n < 0.3 * (SELECT count(*) FROM s)) AS r, (SELECT count(*) FROM h WHERE n = 0) AS m)
SELECT 'extreme_imbalance' AS code, 'critical' AS level, x AS figure FROM f WHERE x > 0
UNION ALL SELECT 'rare_classes', 'warning', r FROM f WHERE r > 0
UNION ALL SELECT 'missing_classes', 'critical', m FROM f WHERE m > 0
UNION ALL SELECT 'balanced', 'info', 0 FROM f WHERE x + r + m = 0""")
def _(v):
    return P.recommendations(v.texts, classes=(0, 1, 2, 3)).select("code", "level", "figure")


@check("ag20_loso_profile", "texts", """
WITH c AS (SELECT source, label, count(*) AS n FROM texts GROUP BY source, label),
s AS (SELECT DISTINCT source FROM c),
r AS (SELECT s.source, c.label, sum(c.n) AS n FROM s JOIN c ON c.source <> s.source GROUP BY s.source, c.label)
SELECT source, sum(n)::BIGINT AS train_rows, round(max(n) / min(n)::DOUBLE, 6) AS train_ratio,
  (sum(n) FILTER (label = 1))::BIGINT AS train_anomalies FROM r GROUP BY source""")
def _(v):
    out = P.loso_profile(v.texts)
    return out.select(
        "source", "train_rows", r6("train_ratio").alias("train_ratio"), F.col("train_counts")[F.lit(1)].alias("train_anomalies")
    )


@check("ag22_health_rollup", "logs", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak
FROM logs GROUP BY 1""")
def _(v):
    out = P.health_rollup(v.logs)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", r6("mean").alias("mean"), "peak")


@check("flagship_source_overview", "logs", f"""
WITH g AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY source ORDER BY ts, log_id)) / 1000000.0::DOUBLE, 0.0) AS gap,
  count(*) OVER (PARTITION BY source ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS peak FROM logs)
SELECT source, count(*) AS n_rows, sum(label)::BIGINT AS anomalies, round(sum(label) * 100.0 / count(*), 6)::DOUBLE AS anomaly_rate,
  round(greatest(sum(label), count(*) - sum(label)) / least(sum(label), count(*) - sum(label))::DOUBLE, 6) AS imbalance_ratio,
  CASE WHEN greatest(sum(label), count(*) - sum(label)) / least(sum(label), count(*) - sum(label))::DOUBLE > 100 THEN 'extreme'
    WHEN greatest(sum(label), count(*) - sum(label)) / least(sum(label), count(*) - sum(label))::DOUBLE > 10 THEN 'high'
    WHEN greatest(sum(label), count(*) - sum(label)) / least(sum(label), count(*) - sum(label))::DOUBLE > 5 THEN 'moderate' ELSE 'balanced' END AS tier,
  count(*) FILTER (gap < 1) AS bursts, count(*) FILTER (gap > 300) AS isolated,
  count(*) FILTER (isodow(ts) >= 6) AS weekend_rows, count(*) FILTER (hour(ts) BETWEEN 0 AND 6) AS night_rows,
  max(peak) AS peak_5min FROM g GROUP BY source""")
def _(v):
    from emberlog.plans.overview import source_overview

    out = source_overview(v.logs)
    return out.withColumns({"anomaly_rate": r6("anomaly_rate"), "imbalance_ratio": r6("imbalance_ratio")})
