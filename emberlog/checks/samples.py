from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.checks.base import check, draw_sql, r6
from emberlog.checks.vectors import two_classes
from emberlog.durable import settle
from emberlog.functions.text import mask_variables
from emberlog.operators import joins as J
from emberlog.operators import profile as P
from emberlog.operators import sampling as S
from emberlog.operators import topk as K
from emberlog.operators.draws import hash_rank
from emberlog.checks.profiles import IMBALANCE_SQL, PROFILE_SQL, RUNS_SQL, runs
from emberlog.operators import labelling as LAB


def rank_sql(part, seed=42, ids="log_id"):
    over = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({over}ORDER BY {draw_sql(ids, seed)}, {ids})"


@check("smp1_row_cap", "logs", f"""
SELECT log_id, source FROM (SELECT log_id, source, {rank_sql('source')} AS k FROM logs) WHERE k <= 300""")
def _(v):
    return S.cap_rows(v.logs, 300).select("log_id", "source")


@check("smp2_stratified_split", "texts", f"""
WITH r AS (SELECT log_id, label, {rank_sql('label')} AS k, count(*) OVER (PARTITION BY label) AS n FROM texts)
SELECT log_id, label, CASE WHEN k <= round(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM r""")
def _(v):
    return S.stratified_split(v.texts).select("log_id", "label", "part")


@check("smp3_stratified_kfold", "texts", f"""
SELECT log_id, label, (({rank_sql('label')} - 1) % 3)::INT AS fold FROM texts""")
def _(v):
    return S.kfold(v.texts).select("log_id", "label", "fold")


@check("smp4_class_weights", "texts", """
SELECT label, count(*) AS n, round((SELECT count(*) FROM texts) / (2.0::DOUBLE * count(*)), 6) AS weight FROM texts GROUP BY label""")
def _(v):
    return S.class_weights(v.texts).withColumn("weight", r6("weight"))


@check("smp5_focal_weights", "texts", """
WITH c AS (SELECT label, count(*) AS n, 0.25 * pow(1 - count(*) / (SELECT count(*) FROM texts)::DOUBLE, 2) AS w FROM texts GROUP BY label)
SELECT label, n, round(w / sum(w) OVER () * count(*) OVER (), 6) AS weight FROM c""")
def _(v):
    return S.focal_weights(v.texts).withColumn("weight", r6("weight"))


@check("smp6_weighted_resample", "texts", f"""
WITH c AS (SELECT label, count(*) AS n FROM texts GROUP BY label),
x AS (SELECT max(n) / min(n)::DOUBLE AS ratio, min(n) AS lo, sum(n)::DOUBLE AS total FROM c),
w AS (SELECT label, n, 1.0::DOUBLE / n * CASE WHEN ratio > 100 AND n = lo THEN 2 ELSE 1 END AS w, total FROM c, x),
e AS (SELECT label, total * w / (SELECT sum(w * n) FROM w) AS e FROM w),
k AS (SELECT log_id, t.label, (floor(e) + CASE WHEN {draw_sql('log_id', 42)} / pow(2, 52) < e - floor(e) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM texts t JOIN e ON t.label = e.label)
SELECT log_id, label, copies FROM k WHERE copies > 0""")
def _(v):
    return S.weighted_resample(v.texts).groupBy("log_id", "label").agg(F.count("*").alias("copies"))


@check("smp7_resampler_choice", "tpl", """
WITH n AS (SELECT source, content, count(*) AS c FROM tpl GROUP BY source, content),
m AS (SELECT source, content, c AS minority, (length(content) + c) / c::DOUBLE AS ratio FROM n)
SELECT source, content, CASE WHEN ratio < 3 THEN 'none' WHEN ratio > 100 THEN 'adasyn' WHEN ratio > 10 THEN 'borderline' ELSE 'smote' END AS ml,
  CASE WHEN ratio < 3 OR minority <= 1 THEN 'none' WHEN minority <= 12 THEN 'smote' WHEN ratio > 100 THEN 'adasyn' WHEN ratio > 10 THEN 'borderline' ELSE 'smote' END AS dl,
  CASE WHEN ratio < 5 OR minority <= 1 THEN 'none' WHEN ratio > 100 THEN 'adasyn' WHEN ratio > 10 THEN 'borderline' ELSE 'smote' END AS text,
  greatest(1, least(5, minority - 1))::INT AS k FROM m""")
def _(v):
    m = v.tpl.groupBy("source", "content").agg(F.count("*").alias("minority"))
    m = m.withColumn("ratio", (F.length("content") + F.col("minority")) / F.col("minority"))
    pick = {p: S.choose_sampler("ratio", "minority", p) for p in ("ml", "dl", "text")}
    return m.select("source", "content", *[c["sampler"].alias(p) for p, c in pick.items()], pick["ml"]["k"].alias("k"))


@check("smp11_balanced_bags", "texts", f"""
WITH s AS (SELECT min(n) AS size FROM (SELECT count(*) AS n FROM texts GROUP BY label)),
g AS (SELECT log_id, label, unnest(range(4))::INT AS bag FROM texts),
r AS (SELECT *, row_number() OVER (PARTITION BY bag, label ORDER BY {draw_sql('log_id, bag', 42)}, log_id) AS k FROM g)
SELECT log_id, label, bag FROM r, s WHERE k <= size""")
def _(v):
    return S.balanced_bags(v.texts, 4).select("log_id", "label", "bag")


#: Support and query sizes that the smallest class carries: a quarter of it, five at most, for support.
CARRIED_SQL = """c AS (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM texts GROUP BY label)),
k AS (SELECT lo, hi, greatest(1, least(5, lo // 4)) AS k FROM c),
e AS (SELECT *, least(15, lo - k) AS q, least(15, lo - k, hi - 2 * k) AS qi FROM k)"""


def carried(v):
    lo, hi = v.texts.groupBy("label").count().agg(F.min("count"), F.max("count")).first()
    k = max(1, min(5, lo // 4))
    return k, min(15, lo - k), min(15, lo - k, hi - 2 * k)


@check("smp12_few_shot_episode", "texts", f"""
WITH {CARRIED_SQL}, r AS (SELECT log_id, label, {rank_sql('label')} AS r FROM texts)
SELECT log_id, label, CASE WHEN r <= k THEN 'support' ELSE 'query' END AS role FROM r, e WHERE r <= k + q""")
def _(v):
    k, q, _ = carried(v)
    return S.episode(v.texts, k=k, q=q).select("log_id", "label", "role")


@check("smp13_ratio_matched_episode", "texts", f"""
WITH c AS (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM texts GROUP BY label)),
k AS (SELECT lo, hi, least(10, greatest(2, lo // 4)) AS kl FROM c),
q AS (SELECT lo, hi, kl, greatest(kl, least(floor(kl * least(hi / lo::DOUBLE, 5.0))::BIGINT, hi // 4)) AS kh FROM k),
s AS (SELECT *, least(15, greatest(3, lo - kl)) AS ql, least(15, greatest(3, hi - kh)) AS qh FROM q),
r AS (SELECT log_id, label, {rank_sql('label')} AS k FROM texts)
SELECT log_id, label, k AS pick, CASE WHEN k <= CASE WHEN label = 1 THEN kl ELSE kh END THEN 'support' ELSE 'query' END AS role
FROM r, s WHERE k <= CASE WHEN label = 1 THEN kl + ql ELSE kh + qh END""")
def _(v):
    return S.episode_matched(v.texts).select("log_id", "label", "pick", "role")


@check("smp14_imbalanced_episode", "texts", f"""
WITH {CARRIED_SQL}, r AS (SELECT log_id, label, {rank_sql('label')} AS r FROM texts),
s AS (SELECT *, CASE WHEN label = 1 THEN k ELSE 2 * k END AS support FROM r, e)
SELECT log_id, label, CASE WHEN r <= support THEN 'support' ELSE 'query' END AS role FROM s WHERE r <= support + qi""")
def _(v):
    k, _, q = carried(v)
    return S.episode_imbalanced(v.texts, k_min=k, k_maj=2 * k, q=q).select("log_id", "label", "role")


@check("smp15_kshot_plan", "logs", """
WITH m AS (SELECT source, min(n) AS minority FROM (SELECT source, label, count(*) AS n FROM logs GROUP BY source, label) GROUP BY source HAVING count(*) > 1),
k AS (SELECT *, greatest(2, least(5, minority // 4)) AS k_min FROM m)
SELECT source, minority, k_min, greatest(k_min, least(10, minority // 2)) AS k_maj FROM k""")
def _(v):
    return S.kshot_plan(v.logs)


for _phase, _bound in enumerate((5, 20, 100, None)):

    @check(f"smp17_curriculum_phase_{_phase}", "texts", f"""
WITH {IMBALANCE_SQL.format(view='texts')}, r AS (SELECT source, round(coalesce(ratio, 1.0), 6) AS ratio FROM i)
SELECT source, ratio FROM r{f' WHERE ratio <= {_bound}' if _bound else ''}""")
    def _(v, phase=_phase):
        ratios = P.imbalance(v.texts, single_class=1.0).select("source", r6("imbalance_ratio").alias("ratio"))
        return S.curriculum(ratios, phase, "ratio")


WEIGHT_SQL = """s AS (SELECT source, count(*) AS n_rows, count(DISTINCT content) AS n_templates FROM logs GROUP BY source),
i AS (SELECT source, max(n) / min(n)::DOUBLE AS ratio FROM (SELECT source, label, count(*) AS n FROM logs GROUP BY source, label) GROUP BY source),
raw AS (SELECT s.*, ratio, 0.3::DOUBLE * n_rows + 0.4::DOUBLE * n_templates + 0.3::DOUBLE / (ratio + 1e-6) AS raw FROM s JOIN i USING (source)),
wt AS (SELECT source, n_rows, n_templates, ratio, raw / sum(raw) OVER () AS weight FROM raw)"""


@check("smp18_source_weights", "logs", f"""
WITH {WEIGHT_SQL} SELECT source, n_rows, n_templates, round(ratio, 6) AS ratio, round(weight, 6) AS weight FROM wt""")
def _(v):
    return S.source_weights(v.logs, "content").withColumns({"ratio": r6("ratio"), "weight": r6("weight")})


@check("smp19_federated_average", "logs", f"""
WITH {WEIGHT_SQL}, pr AS (SELECT source, 'coef' AS param, hour(ts) AS idx, avg(value) AS value FROM logs GROUP BY source, hour(ts))
SELECT param, idx, round(sum(weight * value), 6) AS value FROM pr JOIN wt USING (source) GROUP BY param, idx""")
def _(v):
    params = v.logs.groupBy("source", F.hour("ts").alias("idx")).agg(F.avg("value").alias("value")).withColumn("param", F.lit("coef"))
    return S.federated_average(params, S.source_weights(v.logs, "content")).withColumn("value", r6("value"))


@check("jn1_template_label_propagation", "tpl", """
WITH k AS (SELECT template, max(label)::INT AS label FROM tpl WHERE label IS NOT NULL GROUP BY template)
SELECT log_id, source, coalesce(k.label, -1) AS anomaly_label,
  CASE k.label WHEN 0 THEN 'normal' WHEN 1 THEN 'security_anomaly' ELSE 'unlabeled' END AS anomaly_label_name
FROM tpl LEFT JOIN k ON tpl.template = k.template""")
def _(v):
    known = v.tpl.filter("label IS NOT NULL").groupBy("template").agg(F.max("label").alias("label"))
    out = J.apply_template_labels(v.tpl.drop("label"), known)
    return out.select("log_id", "source", "anomaly_label", "anomaly_label_name")


@check("jn3_method_comparison", "preds", f"""
WITH {RUNS_SQL}, w AS (SELECT a.source, a.f1 AS maml_f1, b.f1 AS proto_f1, c.f1 AS transfer_f1 FROM r a JOIN r b USING (source) JOIN r c USING (source)
  WHERE a.model = 'm100' AND b.model = 'm37' AND c.model = 'm53')
SELECT source, round(maml_f1, 6) AS maml_f1, round(proto_f1, 6) AS proto_f1, round(transfer_f1, 6) AS transfer_f1,
  CASE WHEN maml_f1 >= proto_f1 AND maml_f1 >= transfer_f1 THEN 'MAML' WHEN proto_f1 >= transfer_f1 THEN 'Prototypical' ELSE 'Transfer' END AS best_method FROM w""")
def _(v):
    r = runs(v)
    a, b, c = (r.filter(F.col("model") == m) for m in ("m100", "m37", "m53"))
    out = J.compare_methods(a, b, c)
    return out.withColumns({n: r6(n) for n in ("maml_f1", "proto_f1", "transfer_f1")})


@check("jn4_loso_splits", "texts", """
WITH s AS (SELECT source, count(*) AS n FROM texts GROUP BY source)
SELECT a.source AS test_source, count(*) AS train_sources, a.n AS test_rows, sum(b.n)::BIGINT AS train_rows
FROM s a JOIN s b ON a.source <> b.source GROUP BY a.source, a.n""")
def _(v):
    return J.loso_splits(v.texts)


@check("jn5_logs_with_predictions", "texts preds", """
WITH l AS (SELECT log_id, string_agg(model || ':' || p, ',' ORDER BY model) AS predictions, count(*) AS n FROM preds GROUP BY log_id)
SELECT t.log_id, t.source, coalesce(predictions, '') AS predictions, coalesce(n, 0)::INT AS n FROM texts t LEFT JOIN l USING (log_id)""")
def _(v):
    out = J.logs_with_predictions(v.texts.select("log_id", "source"), v.preds)
    text = F.transform("predictions", lambda s: F.concat(s["model"], F.lit(":"), s["p"]))
    return out.select("log_id", "source", F.array_join(text, ",").alias("predictions"), F.size("predictions").alias("n"))


FUZZY_SQL = """WITH k AS (SELECT content AS template, min(label) AS label FROM logs WHERE source < 's3' GROUP BY content),
n AS (SELECT DISTINCT content AS template FROM logs),
p AS (SELECT n.template, k.template AS match, k.label, 100.0::DOUBLE * (1 - levenshtein(n.template, k.template) / greatest(length(n.template), length(k.template))::DOUBLE) AS score
  FROM n CROSS JOIN k),
b AS (SELECT * FROM p WHERE score >= {t} - 1e-9 QUALIFY row_number() OVER (PARTITION BY template ORDER BY score DESC, match) = 1)
SELECT n.template, b.match, round(b.score, 6) AS score, b.label AS suggested, CASE WHEN b.match IS NULL THEN 'low' ELSE 'medium' END AS confidence
FROM n LEFT JOIN b USING (template)"""

for _threshold in (80, 90):

    @check(f"jn6_fuzzy_transfer_{_threshold}", "logs", FUZZY_SQL.format(t=_threshold))
    def _(v, threshold=_threshold):
        known = settle(v.logs.filter(F.col("source") < "s3").groupBy(F.col("content").alias("template")).agg(F.min("label").alias("label")))
        new = settle(v.logs.select(F.col("content").alias("template")).distinct()).withColumn("confidence", F.lit("low"))
        return J.fuzzy_transfer(new, known, threshold).withColumn("score", r6("score"))


@check("jn6_fuzzy_transfer_lines")
def _(v):
    # one reading of the lines for both sides
    per = settle(v.tpl.groupBy("template").agg(F.min("label").alias("label"), F.bool_or(F.col("label").isNull()).alias("unlabelled")), packed=True)
    known = per.filter(F.col("label").isNotNull()).select("template", "label")
    new = per.filter("unlabelled").select("template").withColumn("confidence", F.lit("low"))
    return J.fuzzy_transfer(new, known, 90)


@check("jn8_template_pairs", "logs", """
WITH n AS (SELECT log_id, label, lead(log_id) OVER w AS next_id, lead(label) OVER w AS next_label FROM logs WINDOW w AS (PARTITION BY source, content ORDER BY log_id))
SELECT log_id AS first, next_id AS second FROM n WHERE next_id IS NOT NULL AND label = next_label""")
def _(v):
    return J.contrastive_pairs(v.logs).filter("kind = 'template'").select("first", "second")


@check("jn8_label_pairs", "logs", f"""
WITH r AS (SELECT log_id, label, {rank_sql('label')} AS k, count(*) OVER (PARTITION BY label) AS n FROM logs),
w AS (SELECT log_id, label, (k - 1 + 1 + {draw_sql('log_id', 43)} % (n - 1)) % n + 1 AS pick FROM r),
o AS (SELECT r.log_id, 1 - r.label AS label, {draw_sql('r.log_id', 45)} % c.n + 1 AS pick FROM r JOIN (SELECT label, count(*) AS n FROM logs GROUP BY label) c ON c.label = 1 - r.label)
SELECT w.log_id AS first, r.log_id AS second, 1 AS same FROM w JOIN r ON r.label = w.label AND r.k = w.pick
UNION ALL SELECT o.log_id, r.log_id, 0 FROM o JOIN r ON r.label = o.label AND r.k = o.pick""")
def _(v):
    return J.contrastive_pairs(v.logs).filter("kind IN ('label', 'other_label')").select("first", "second", "same")


@check("jn8_minority_pairs", "logs", f"""
WITH r AS (SELECT log_id, {rank_sql('label')} AS k, label FROM logs), c AS (SELECT label, count(*) AS n FROM logs GROUP BY label ORDER BY n, label LIMIT 1),
p AS (SELECT n, unnest(range(3 * n)) AS id FROM c), d AS (SELECT n, {draw_sql('id', 46)} % n + 1 AS a, 1 + {draw_sql('id', 47)} % (n - 1) AS s FROM p),
m AS (SELECT r.log_id, r.k FROM r JOIN c USING (label))
SELECT x.log_id AS first, y.log_id AS second FROM d JOIN m x ON x.k = a JOIN m y ON y.k = (a - 1 + s) % n + 1""")
def _(v):
    return J.contrastive_pairs(v.logs, augment=True).filter("kind = 'minority'").select("first", "second")


@check("top1_top_anomalies", "preds", """
SELECT model, log_id, score FROM preds WHERE p = 1 ORDER BY score DESC, log_id, model LIMIT 25""")
def _(v):
    return K.top_anomalies(v.preds.withColumn("key", F.struct("log_id", "model")), 25, key="key").select("model", "log_id", "score")


@check("top2_source_priority", "tpl", f"""
WITH {PROFILE_SQL}
SELECT source, round(anomaly_rate * 0.4 + greatest(0, 100 - templates / 20.0::DOUBLE) * 0.3 + least(100, efficiency / 10) * 0.3, 6)::DOUBLE AS priority
FROM prof WHERE source <> 'src1'""")
def _(v):
    prof = P.profile_sources(v.tpl, LAB.normalized_seed_patterns())
    done = prof.select("source").filter("source = 'src1'")
    return K.rank_sources(prof, done).select("source", r6("priority").alias("priority"))


@check("top3_leaderboard", "preds", f"""
WITH {RUNS_SQL} SELECT model AS model_type, source AS model, round(f1, 6) AS f1
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, source DESC) AS k FROM r) WHERE k = 1""")
def _(v):
    r = runs(v).select(F.col("model").alias("model_type"), F.col("source").alias("model"), "f1")
    return K.leaderboard(r).withColumn("f1", r6("f1"))


@check("top4_paged_listing", "logs", """
SELECT log_id, source, content FROM logs WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, log_id DESC LIMIT 50""")
def _(v):
    return K.page(v.logs, after=("2024-01-20 00:00:00", 1 << 62)).select("log_id", "source", "content")


@check("top5_top_templates", "tpl", """
WITH c AS (SELECT source, template, count(*) AS n FROM tpl GROUP BY source, template)
SELECT source, template, n, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, template) AS k FROM c) WHERE k <= 3""")
def _(v):
    counts = v.tpl.groupBy("source", "template").agg(F.count("*").alias("n"))
    return P.top_of_group(counts, "source", [F.col("n").desc(), F.col("template")], 3)


@check("top6_split_sources", "texts", f"""
WITH {IMBALANCE_SQL.format(view='texts')}, r AS (SELECT source, coalesce(ratio, 1.0) AS ratio FROM i),
k AS (SELECT *, row_number() OVER (ORDER BY ratio, source) - 1 AS rank, count(*) OVER () AS n FROM r)
SELECT source, round(ratio, 6) AS imbalance_ratio, rank, CASE WHEN rank < floor(n * 0.8) THEN 'train' ELSE 'validate' END AS part FROM k""")
def _(v):
    ratios = P.imbalance(v.texts, single_class=1.0).select("source", "imbalance_ratio")
    return K.split_sources(ratios).withColumn("imbalance_ratio", r6("imbalance_ratio"))


@check("set1_union_of_sources", "logs texts", """
SELECT log_id, source, label, lang, value FROM (SELECT log_id, source, label, NULL AS lang, value FROM logs UNION ALL SELECT log_id, source, label, lang, NULL FROM texts)""")
def _(v):
    return K.combine([v.logs.select("log_id", "source", "label", "value"), v.texts.select("log_id", "source", "label", "lang")])


@check("set2_common_sources", "logs vecs", "SELECT DISTINCT source FROM logs WHERE source IN (SELECT source FROM vecs)")
def _(v):
    return K.common_sources([v.logs, v.vecs])


@check("set3_class_validation", "logs vecs", """
WITH a AS (SELECT DISTINCT label FROM logs), b AS (SELECT DISTINCT label FROM vecs)
SELECT coalesce(a.label, b.label) AS label, CASE WHEN a.label IS NULL THEN 'unseen' WHEN b.label IS NULL THEN 'missing' ELSE 'both' END AS status
FROM a FULL JOIN b ON a.label = b.label""")
def _(v):
    return K.validate_classes(v.logs, v.vecs)
