from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.checks.base import check, r6
from emberlog.functions.text import ERROR_FLAGS, error_flag_columns
from emberlog.operators import evaluate as E
from emberlog.operators import scoring as S

CLASS_SQL = """c AS (SELECT model, y, p, count(*) AS n FROM preds GROUP BY model, y, p),
k AS (SELECT model, y AS cls FROM c UNION SELECT model, p FROM c),
s AS (SELECT k.model, k.cls, coalesce(sum(n) FILTER (y = cls), 0)::BIGINT AS support, coalesce(sum(n) FILTER (p = cls), 0)::BIGINT AS predicted,
  coalesce(sum(n) FILTER (y = cls AND p = cls), 0)::BIGINT AS hits FROM k JOIN c USING (model) GROUP BY k.model, k.cls),
d AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0 END AS recall, 2.0::DOUBLE * hits / (support + predicted) AS f1 FROM s)"""


@check("ev1_confusion_matrix", "preds", """
WITH k AS (SELECT DISTINCT model FROM preds), g AS (SELECT model, y, p FROM k, (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(p))
SELECT g.model, g.y, g.p, count(preds.log_id) AS n FROM g LEFT JOIN preds ON g.model = preds.model AND g.y = preds.y AND g.p = preds.p
GROUP BY g.model, g.y, g.p""")
def _(v):
    return E.confusion(v.preds, ["model"])


METRIC_SQL = {
    "acc": "sum(hits) / sum(support)::DOUBLE",
    "f1_micro": "sum(hits) / sum(support)::DOUBLE",
    "bal_acc": "avg(recall) FILTER (support > 0)",
    "f1_macro": "avg(f1)",
    "f1_weighted": "sum(f1 * support) / sum(support)",
    "mcc": """coalesce((sum(hits) * sum(support)::DOUBLE - sum(predicted * support)) / nullif(sqrt((sum(support)::DOUBLE * sum(support) - sum(predicted * predicted))
  * (sum(support)::DOUBLE * sum(support) - sum(support * support))), 0), 0)""",
    "geometric_mean": "exp(avg(ln(greatest(recall, 1e-10))) FILTER (support > 0))",
    "iba": "(1 + 0.1::DOUBLE * exp(avg(ln(greatest(recall, 1e-10))) FILTER (support > 0))) * avg(recall) FILTER (support > 0)",
}

for _name, _columns in {
    "ev2_accuracy_micro_f1": ["acc", "f1_micro"],
    "ev3_balanced_accuracy": ["bal_acc"],
    "ev4_macro_weighted_f1": ["f1_macro", "f1_weighted"],
    "ev5_mcc": ["mcc"],
    "ev6_geometric_mean": ["geometric_mean"],
    "ev7_iba": ["iba"],
}.items():

    @check(_name, "preds", f"WITH {CLASS_SQL} SELECT model, "
           + ", ".join(f"round({METRIC_SQL[c]}, 6) AS {c}" for c in _columns) + " FROM d GROUP BY model")
    def _(v, columns=_columns):
        return E.metrics(v.preds, ["model"]).select("model", *[r6(c).alias(c) for c in columns])


@check("ev6_sensitivity_gmean", "preds", """
WITH c AS (SELECT model, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 1 AND p = 0) AS fn,
  count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp FROM preds GROUP BY model)
SELECT model, round(sqrt(tp / (tp + fn + 1e-8::DOUBLE) * (tn / (tn + fp + 1e-8::DOUBLE))), 6) AS g_mean FROM c""")
def _(v):
    return E.sensitivity_gmean(v.preds, ["model"]).withColumn("g_mean", r6("g_mean"))


AUROC_SQL = """r AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE AS rk FROM preds),
roc AS (SELECT model, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE AS auroc FROM r GROUP BY model)"""
PR_SQL = """h AS (SELECT model, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM preds GROUP BY model, score),
w AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC)::DOUBLE AS tp, sum(neg) OVER (PARTITION BY model ORDER BY score DESC)::DOUBLE AS fp,
  sum(pos) OVER (PARTITION BY model)::DOUBLE AS all_pos FROM h),
pr AS (SELECT model, score, pos, all_pos, tp / (tp + fp) AS precision, tp / all_pos AS recall FROM w)"""


@check("ev8_auroc", "preds", f"WITH {AUROC_SQL} SELECT model, round(auroc, 6) AS auroc FROM roc")
def _(v):
    return E.auroc(v.preds, ["model"]).withColumn("auroc", r6("auroc"))


@check("win11_mid_rank", "preds", """
SELECT model, log_id, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE AS mid_rank FROM preds""")
def _(v):
    from emberlog.operators.ordering import mid_ranks

    return mid_ranks(v.preds, ["model"], "score").select("model", "log_id", "mid_rank")


@check("ev9_auprc", "preds", f"WITH {PR_SQL} SELECT model, round(sum(pos / all_pos * precision), 6) AS auprc FROM pr GROUP BY model")
def _(v):
    return E.auprc(v.preds, ["model"]).withColumn("auprc", r6("auprc"))


@check("ev10_per_class_table", "preds", f"""
WITH {CLASS_SQL}
SELECT model, cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support,
  round(support / sum(support) OVER (PARTITION BY model)::DOUBLE, 6) AS frequency FROM d WHERE support > 0""")
def _(v):
    out = E.per_class(v.preds, ["model"])
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "frequency")})


MACRO_SQL = """(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END
  + CASE WHEN 2 * tn + fp + fn > 0 THEN 2.0::DOUBLE * tn / (2 * tn + fp + fn) ELSE 0 END)
  / nullif((2 * tp + fp + fn > 0)::INT + (2 * tn + fp + fn > 0)::INT, 0)"""
SWEEP_SQL = f"""t AS (SELECT round(0.10 + 0.01 * unnest(range(81)), 2)::DOUBLE AS threshold),
q AS (SELECT model, threshold, count(*) FILTER (y = 1 AND score >= threshold) AS tp, count(*) FILTER (y = 0 AND score >= threshold) AS fp,
  count(*) FILTER (y = 1 AND score < threshold) AS fn, count(*) FILTER (y = 0 AND score < threshold) AS tn FROM preds, t GROUP BY model, threshold),
f AS (SELECT *, {MACRO_SQL} AS f1_macro FROM q)"""


@check("jn10_threshold_sweep", "preds", f"WITH {SWEEP_SQL} SELECT model, threshold, tp, fp, fn, tn, round(f1_macro, 6) AS f1_macro FROM f")
def _(v):
    return E.threshold_sweep(v.preds, ["model"]).withColumn("f1_macro", r6("f1_macro"))


@check("ev11_threshold_tuning", "preds", f"""
WITH {SWEEP_SQL} SELECT model, threshold, round(f1_macro, 6) AS f1_macro
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1_macro DESC, threshold) AS k FROM f) WHERE k = 1""")
def _(v):
    return E.tune_threshold(v.preds, ["model"]).withColumn("f1_macro", r6("f1_macro"))


@check("ev12_percentile_threshold", "preds", f"""
WITH pc AS (SELECT unnest(range(90, 100)) AS percentile),
qs AS (SELECT model, quantile_cont(score, [{', '.join(str(p / 100) for p in E.PERCENTILES)}]) AS cuts FROM preds GROUP BY model),
t AS (SELECT model, percentile, cuts[percentile - 89] AS threshold FROM qs, pc),
q AS (SELECT model, percentile, threshold, count(*) FILTER (y = 1 AND score > threshold) AS tp, count(*) FILTER (y = 0 AND score > threshold) AS fp,
  count(*) FILTER (y = 1 AND score <= threshold) AS fn, count(*) FILTER (y = 0 AND score <= threshold) AS tn
  FROM preds JOIN t USING (model) GROUP BY model, percentile, threshold),
f AS (SELECT *, {MACRO_SQL} AS f1_macro FROM q)
SELECT model, percentile::INT AS percentile, round(threshold, 6) AS threshold, round(f1_macro, 6) AS f1_macro
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1_macro DESC, percentile) AS k FROM f) WHERE k = 1""")
def _(v):
    out = E.tune_percentile(v.preds, ["model"], error="score")
    return out.withColumns({"threshold": r6("threshold"), "f1_macro": r6("f1_macro")})


@check("ev13_pr_optimum", "preds", f"""
WITH {PR_SQL}, f AS (SELECT model, score, 2 * precision * recall / (precision + recall + 1e-8) AS f1 FROM pr)
SELECT model, score AS optimal_threshold, round(f1, 6) AS optimal_f1
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) AS k FROM f) WHERE k = 1""")
def _(v):
    return E.pr_optimum(v.preds, ["model"]).withColumn("optimal_f1", r6("optimal_f1"))


@check("ev14_model_comparison", "preds", f"""
WITH {CLASS_SQL}, {AUROC_SQL}, {PR_SQL}, ap AS (SELECT model, sum(pos / all_pos * precision) AS auprc FROM pr GROUP BY model),
m AS (SELECT model, sum(support)::BIGINT AS n_rows, {', '.join(f'{e} AS {c}' for c, e in METRIC_SQL.items())} FROM d GROUP BY model)
SELECT model, n_rows, {', '.join(f'round({c}, 6) AS {c}' for c in METRIC_SQL)}, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc
FROM m JOIN roc USING (model) JOIN ap USING (model)""")
def _(v):
    out = E.compare_models(v.preds)
    return out.withColumns({c: r6(c) for c in [*METRIC_SQL, "auroc", "auprc"]})


@check("sc2_confidence", "preds", """
SELECT model, log_id, round(greatest(score, 1 - score), 6) AS top, round(2 * abs(score - 0.5), 6) AS margin FROM preds""")
def _(v):
    return v.preds.select(
        "model", "log_id", r6(S.confidence("score")).alias("top"), r6(S.confidence("score", "margin")).alias("margin")
    )


@check("sc3_threshold_choice", "preds", """
WITH t AS (SELECT source, avg(score) AS threshold FROM preds WHERE y = 1 GROUP BY source)
SELECT model, log_id, CASE WHEN score >= coalesce(t.threshold, 0.5) THEN 1 ELSE 0 END AS p FROM preds LEFT JOIN t USING (source)""")
def _(v):
    table = v.preds.filter("y = 1").groupBy("source").agg(F.avg("score").alias("threshold"))
    return S.apply_threshold(v.preds.drop("p"), table).select("model", "log_id", "p")


@check("sc4_ensemble_voting", "preds", """
SELECT log_id, round(avg(score), 6) AS score, CASE WHEN sum(p) * 2 > count(*) THEN 1 ELSE 0 END AS p FROM preds GROUP BY log_id""")
def _(v):
    return S.ensemble(v.preds, "voting").withColumn("score", r6("score"))


@check("sc5_ensemble_averaging", "preds", """
SELECT log_id, round(avg(score), 6) AS score, CASE WHEN avg(score) > 0.5 THEN 1 ELSE 0 END AS p FROM preds GROUP BY log_id""")
def _(v):
    return S.ensemble(v.preds, "averaging").withColumn("score", r6("score"))


@check("sc6_wide_comparison", "preds", "SELECT log_id, " + ", ".join(
    f"max(p) FILTER (model = '{m}') AS {m}_prediction, max(score) FILTER (model = '{m}') AS {m}_probability, "
    f"round(2 * abs(max(score) FILTER (model = '{m}') - 0.5), 6) AS {m}_confidence" for m in ("m100", "m37", "m53"))
    + " FROM preds GROUP BY log_id")
def _(v):
    out = S.compare_wide(v.preds, ["m100", "m37", "m53"])
    return out.withColumns({f"{m}_confidence": r6(f"{m}_confidence") for m in ("m100", "m37", "m53")})


@check("sc7_error_to_probability", "preds", """
SELECT model, log_id, round(greatest(0, least(1, score / (0.3::DOUBLE * 2))), 6) AS probability FROM preds""")
def _(v):
    return v.preds.select("model", "log_id", r6(S.error_to_prob("score", 0.3)).alias("probability"))


LAST_FLAGS = list(ERROR_FLAGS)[-5:]


@check("sc8_rule_score", "texts", "WITH f AS (SELECT log_id, "
       + " + ".join(
           f"CASE WHEN regexp_matches(lower(content), '(^|[^\\p{{L}}\\p{{N}}_])({ERROR_FLAGS[n]})([^\\p{{L}}\\p{{N}}_]|$)') THEN 1 ELSE 0 END"
           for n in LAST_FLAGS)
       + " AS hits FROM texts) SELECT log_id, round(hits / 5.0::DOUBLE, 6) AS rule_score, CASE WHEN hits / 5.0 > 0.5 THEN 1 ELSE 0 END AS p FROM f")
def _(v):
    flags = error_flag_columns()
    share, p = S.rule_score(LAST_FLAGS)
    return v.texts.withColumns({n: flags[n] for n in LAST_FLAGS}).select("log_id", r6(share).alias("rule_score"), p.alias("p"))
