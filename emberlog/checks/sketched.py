from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.checks.base import check, r6
from emberlog.checks.quality import MACRO_SQL
from emberlog.durable import fresh_path, settle
from emberlog.operators import evaluate as E
from emberlog.operators import sketches as K

FRACTIONS = (0.25, 0.5, 0.75, 0.9, 0.99)


@check("ag16_sketched_quantiles", "logs", f"""
SELECT source, count(value) AS n, unnest({list(FRACTIONS)}::DOUBLE[]) AS fraction, TRUE AS within FROM logs GROUP BY source""")
def _(v):
    # a day is sketched once, the span is merged; small sketches, so that they have to estimate
    k = 64
    rows, path = v.logs.select("source", "ts", "value"), fresh_path(v.spark, "sketches")
    K.write_daily(rows, path, "value", ["source"], k=k)
    cuts = settle(K.quantiles(K.read_span(v.spark, path, ["source"], k=k), FRACTIONS, ["source"]))
    ranked = K.exact_ranks(rows.filter("value IS NOT NULL"), cuts, "value", ["source"])
    # twice the bound: five fractions of sixteen sources are asked
    error = 2 * K.rank_error(k)
    return ranked.select("source", "n", "fraction", (
        (F.col("below") - error <= F.col("fraction")) & (F.col("fraction") <= F.col("up_to") + error)).alias("within"))


@check("ev12_percentile_by_sketch", "preds", f"""
WITH pc AS (SELECT unnest(range(90, 100)) AS percentile),
qs AS (SELECT model, quantile_disc(score, [{', '.join(str(p / 100) for p in E.PERCENTILES)}]) AS cuts FROM preds GROUP BY model),
t AS (SELECT model, percentile, cuts[percentile - 89] AS threshold FROM qs, pc),
q AS (SELECT model, percentile, threshold, count(*) FILTER (y = 1 AND score > threshold) AS tp, count(*) FILTER (y = 0 AND score > threshold) AS fp,
  count(*) FILTER (y = 1 AND score <= threshold) AS fn, count(*) FILTER (y = 0 AND score <= threshold) AS tn
  FROM preds JOIN t USING (model) GROUP BY model, percentile, threshold),
f AS (SELECT *, {MACRO_SQL} AS f1_macro FROM q)
SELECT model, percentile::INT AS percentile, round(threshold, 6) AS threshold, round(f1_macro, 6) AS f1_macro
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1_macro DESC, percentile) AS k FROM f) WHERE k = 1""")
def _(v):
    # fewer scores a model than a sketch keeps: its quantiles are the exact ones here
    cuts = K.quantiles(K.sketch(v.preds, "score", ["model"]), [p / 100 for p in E.PERCENTILES], ["model"])
    out = E.tune_percentile(v.preds, ["model"], error="score", cuts=cuts)
    return out.withColumns({"threshold": r6("threshold"), "f1_macro": r6("f1_macro")})
