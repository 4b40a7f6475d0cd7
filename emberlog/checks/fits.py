from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.checks.base import check, draw_sql, r6
from emberlog.checks.vectors import DOUBLES, two_classes
from emberlog.operators import embeddings as E
from emberlog.operators import evaluate as EV
from emberlog.operators import kernels as K
from emberlog.operators import models as M
from emberlog.operators import scoring as SC
from emberlog.operators import selection as FS
from emberlog.operators.sampling import add_class_weight, stratified_split
from emberlog.functions.text import add_text_features

NUMBERS = ["msg_length", "msg_word_count", "msg_unique_chars", "number_ratio"]
NUMBERS_SQL = r"""nm AS (SELECT log_id, source, label, length(content)::DOUBLE AS msg_length, len(regexp_extract_all(content, '\S+'))::DOUBLE AS msg_word_count,
  len(list_distinct(string_split(content, '')))::DOUBLE AS msg_unique_chars,
  length(regexp_replace(content, '[^\p{Nd}]', '', 'g')) / (length(content) + 1.0)::DOUBLE AS number_ratio FROM texts)"""


def numbers(v):
    from emberlog.functions.text import text_columns

    made = text_columns()
    return v.texts.select("log_id", "source", "label", *[made[c].cast("double").alias(c) for c in NUMBERS])


@check("fs1_standard_scaling", "texts", f"WITH {NUMBERS_SQL} SELECT log_id, "
       + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) AS {c}" for c in NUMBERS) + " FROM nm")
def _(v):
    df = numbers(v)
    out = FS.scale(df, FS.fit_scaler(df, NUMBERS))
    return out.select("log_id", *[r6(c, 5).alias(c) for c in NUMBERS])


def _mi_sql():
    parts = []
    for c in NUMBERS:
        parts.append(f"""SELECT '{c}' AS feature, label, (SELECT count(*) FROM (SELECT DISTINCT unnest(quantile_disc({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM nm) q
  WHERE nm.{c} > q.e) AS bin FROM nm""")
    return " UNION ALL ".join(parts)


@check("fs2_mutual_information", "texts", f"""
WITH {NUMBERS_SQL}, x AS ({_mi_sql()}), c AS (SELECT feature, bin, label, count(*) AS n FROM x GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, label) AS nl, sum(n) OVER (PARTITION BY feature) AS nt FROM c)
SELECT feature, round(sum(n / nt::DOUBLE * ln(n * nt / (nb * nl)::DOUBLE)), 6) AS mi FROM w GROUP BY feature""")
def _(v):
    return FS.mutual_information(numbers(v), NUMBERS).withColumn("mi", r6("mi"))


@check("fs3_forest_importance")
def _(v):
    return FS.forest_importance(numbers(v), NUMBERS, trees=20)


@check("fs4_feature_selection")
def _(v):
    return FS.select_features(numbers(v), NUMBERS, k=3, trees=20)


GROUPS = {"sentence": ["emb_magnitude", "emb_sparsity", "emb_entropy"], "complexity": ["emb_entropy"], "template": ["norm_len"]}


@check("emb8_variant_assembly", "vecs", f"""
WITH {DOUBLES}, a AS (SELECT log_id, list_transform(vec, lambda x: abs(x)) AS a FROM v), s AS (SELECT log_id, a, list_sum(a) AS t FROM a)
SELECT log_id, 68 AS width, round(sqrt(list_dot_product(a, a)) + len(list_filter(a, lambda x: x < 0.01)) / len(a)::DOUBLE
  - list_sum(list_transform(a, lambda x: x / (t + 1e-8) * ln(x / (t + 1e-8) + 1e-8))) + 64, 4) AS tail FROM s""")
def _(v):
    from pyspark.ml.functions import vector_to_array

    df = E.add_vector_features(v.vecs).withColumn("norm_len", F.size("vec").cast("double"))
    out = E.assemble_variant(df, "sentence_focused", GROUPS).withColumn("a", vector_to_array("features"))
    # complexity repeats a sentence column: the variant holds it once
    tail = F.aggregate(F.slice("a", 65, 10), F.lit(0.0), lambda s, x: s + x)
    return out.select("log_id", F.size("a").alias("width"), F.round(tail, 4).alias("tail"))


@check("emb8_scaled_variant", "vecs", f"""
WITH {DOUBLES}, f AS (SELECT avg(vec[1]) AS m, stddev_samp(vec[1]) AS s, avg(sqrt(list_dot_product(vec, vec))) AS nm,
  stddev_samp(sqrt(list_dot_product(vec, vec))) AS ns FROM v)
SELECT log_id, 65 AS width, round((vec[1] - m) / s, 5) AS first, round((sqrt(list_dot_product(vec, vec)) - nm) / ns, 2) AS norm FROM v, f""")
def _(v):
    from pyspark.ml.functions import vector_to_array

    df = E.add_vector_features(v.vecs)
    out = E.assemble_variant(df, "scaled", {"rolling": ["emb_magnitude"]}).withColumn("a", vector_to_array("features"))
    return out.select("log_id", F.size("a").alias("width"), F.round(F.get("a", F.lit(0)), 5).alias("first"), F.round(F.get("a", F.lit(64)), 2).alias("norm"))


def split(v):
    """Three quarters of every class train, the rest is held out."""
    parts = stratified_split(two_classes(v), 0.75)
    return parts.filter("part = 'train'").drop("part"), parts.filter("part = 'test'").drop("part")


QUICK = {
    "mod1_logistic_regression": ("lr", {}),
    "mod2_random_forest": ("rf", {"numTrees": 20, "maxDepth": 6}),
    "mod3_boosted_trees": ("gbt", {"maxIter": 8}),
    "mod4_linear_svm": ("svc", {"maxIter": 30}),
    "mod6_decision_tree": ("dt", {"maxDepth": 6}),
    "mod7_gaussian_naive_bayes": ("nb", {}),
    "mod4_rbf_svm": ("svc_rbf", {"maxIter": 30, "size": 64}),
    "mod11_multi_layer": ("mlp", {"hidden": [32, 16], "maxIter": 40}),
    "mod8_balanced_rf": ("balanced_rf", {"members": 6, "maxDepth": 5}),
    "mod8_balanced_bagging": ("balanced_bagging", {"members": 2, "maxIter": 4}),
    "mod8_easy_ensemble": ("easy_ensemble", {"members": 2, "maxIter": 4}),
}

for _name, (_kind, _params) in QUICK.items():

    @check(_name)
    def _(v, kind=_kind, params=_params):
        rest, held = split(v)
        return M.predict(M.train(rest, kind, params), held).select("log_id", "label", "p", "score")


@check("mod7_class_means_and_variances", "vecs", f"""
WITH {DOUBLES}, b AS (SELECT CASE WHEN label < 3 THEN 1 ELSE 0 END AS label, i, vec[i] AS x FROM v, range(1, 65) t(i))
SELECT label, (i - 1)::INT AS idx, round(avg(x), 5) AS mean, round(var_pop(x), 5) AS variance FROM b GROUP BY label, i""")
def _(v):
    # figures of the fitted model, for features scaled by the pipeline; brought back to raw scale
    scaler, model = M.build_pipeline("nb").fit(M.prepare(two_classes(v))).stages
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    theta, sigma = model.theta.toArray(), model.sigma.toArray()
    rows = [(int(c), i, float(theta[c, i] * std[i] + mean[i]), float(sigma[c, i] * std[i] ** 2)) for c in range(2) for i in range(64)]
    out = v.spark.createDataFrame(rows, "label int, idx int, mean double, variance double")
    return out.select("label", "idx", r6("mean", 5).alias("mean"), r6("variance", 5).alias("variance"))


@check("mod1_residual_equations", "vecs", """
SELECT DISTINCT (generate_subscripts(vec, 1) - 1)::INT AS idx, TRUE AS balanced, (SELECT count(*) FROM vecs) AS n_rows FROM vecs""")
def _(v):
    # at the optimum the weighted residuals of every feature balance its penalty, which Spark takes per weighted deviation
    rows, penalty = two_classes(v), 0.1
    fitted = M.train(rows, "lr", {"regParam": penalty, "maxIter": 300, "tol": 1e-10}, sampler=None)
    weights = [float(b) for b in fitted.stages[-1].coefficients]
    scored = add_class_weight(fitted.transform(M.prepare(rows)), label="label").select(
        "weight", (vector_to_array("probability")[1] - F.col("label")).alias("residual"), vector_to_array("features").alias("x"))
    terms = scored.select("weight", "residual", F.posexplode("x").alias("idx", "x")).groupBy("idx").agg(
        (F.sum(F.col("weight") * F.col("residual") * F.col("x")) / F.sum("weight")).alias("pull"), F.count("*").alias("n_rows"),
        ((F.sum(F.col("weight") * F.col("x") * F.col("x")) - F.pow(F.sum(F.col("weight") * F.col("x")), 2) / F.sum("weight"))
         / (F.sum("weight") - F.sum(F.col("weight") * F.col("weight")) / F.sum("weight"))).alias("variance"))
    held = F.get(F.array(*[F.lit(penalty * b) for b in weights]), F.col("idx")) * F.col("variance")
    return terms.select("idx", (F.abs(F.col("pull") + held) < 1e-4).alias("balanced"), "n_rows")


SIZE = 6  # features of the kernel map in its twin


@check("mod4_rbf_map", "vecs", f"""
WITH {DOUBLES}, x AS (SELECT log_id, (i - 1)::INT AS i, vec[i] AS x FROM v, range(1, 65) t(i)),
g AS (SELECT 1 / (64 * var_pop(x)) AS gamma FROM x),
w AS (SELECT j::INT AS j, i::INT AS i, sqrt(-2 * ln(({draw_sql('j, i', 42)} + 0.5) / pow(2, 52))) * cos(2 * pi() * ({draw_sql('j, i', 43)} + 0.5) / pow(2, 52)) AS w
  FROM range({SIZE}) a(j), range(64) b(i)),
p AS (SELECT j::INT AS j, 2 * pi() * ({draw_sql('j', 44)} + 0.5) / pow(2, 52) AS phase FROM range({SIZE}) a(j))
SELECT log_id, j AS idx, round(sqrt(2.0 / {SIZE}) * cos(sum(x * w) * sqrt(2 * any_value(gamma)) + any_value(phase)), 5) AS z
FROM x JOIN w USING (i) JOIN p USING (j), g GROUP BY log_id, j""")
def _(v):
    rows = M.prepare(v.vecs.select("log_id", "vec"))
    out = K.RandomFourier(inputCol="raw", size=SIZE).fit(rows).transform(rows)
    return out.select("log_id", F.posexplode(vector_to_array("mapped")).alias("idx", "z")).withColumn("z", r6("z", 5))


for _k, _smoothing in enumerate((1e-9, 0.05)):

    @check(f"mod7_log_odds_{_k}", "vecs", f"""
WITH {DOUBLES}, b AS (SELECT log_id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label, i, vec[i] AS x FROM v, range(1, 65) t(i)),
e AS (SELECT {_smoothing} * max(s) AS e FROM (SELECT var_pop(x) AS s FROM b GROUP BY i)),
c AS (SELECT label, i, avg(x) AS m, var_pop(x) + any_value(e) AS s, count(*) AS n FROM b, e GROUP BY label, i),
j AS (SELECT log_id, c.label, ln(any_value(n)) - sum(0.5 * ln(2 * pi() * s) + (x - m) * (x - m) / (2 * s)) AS joint
  FROM b JOIN c USING (i) GROUP BY log_id, c.label)
SELECT log_id, round(sum(CASE WHEN label = 1 THEN joint ELSE -joint END), 4) AS log_odds,
  CASE WHEN sum(CASE WHEN label = 1 THEN joint ELSE -joint END) > 0 THEN 1 ELSE 0 END AS p FROM j GROUP BY log_id""")
    def _(v, smoothing=_smoothing):
        rows = M.prepare(two_classes(v))
        out = K.SmoothedBayes(featuresCol="raw", smoothing=smoothing).fit(rows).transform(rows)
        raw = vector_to_array("rawPrediction")
        return out.select("log_id", F.round(raw[1] - raw[0], 4).alias("log_odds"), F.col("prediction").cast("int").alias("p"))


@check("mod9_grid_search")
def _(v):
    rest, _ = split(v)
    return M.grid_search(rest, "lr", {"regParam": [1.0, 0.1]}, k=2, sampler=None)[1]


@check("mod10_stage_rule")
def _(v):
    # one class in ten: the rule picks a resampler for the training rows, and no class weights
    df = v.vecs.select("log_id", F.when(F.col("label") == 0, 1).otherwise(0).alias("label"), "vec")
    parts = stratified_split(df, 0.75)
    rest, held = parts.filter("part = 'train'").drop("part"), parts.filter("part = 'test'").drop("part")
    sampler, _ = M.sampler_for(M.class_sizes(rest))
    return M.predict(M.train(rest, "lr"), held).select("log_id", "label", "p", F.lit(sampler).alias("sampler"))


@check("mod12_reconstruction_error")
def _(v):
    rest, held = split(v)
    return M.detect_by_error(rest, held).select("log_id", "label", "error", "p")


def text_parts(v):
    """Four fifths of every class to fit on, the rest to score."""
    parts = stratified_split(v.texts, 0.8)
    return parts.filter("part = 'train'").drop("part"), parts.filter("part = 'test'").drop("part")


@check("mod13_text_classifier")
def _(v):
    rest, held = text_parts(v)
    model = M.train_text(rest)
    return M.score_text(model, held).select("log_id", "label", "p", F.get("probabilities", F.lit(1)).alias("score"))


LOSO = ["lr", "bayes", "dt", "knn"]


@check("mod14_leave_one_source_out", "vecs", f"""
SELECT source, unnest({LOSO}) AS model, count(*) AS test_rows, TRUE AS sound, TRUE AS one_best FROM vecs GROUP BY source""")
def _(v):
    df = v.vecs.select("log_id", "source", F.when(F.col("label") < 5, 1).otherwise(0).alias("label"), "vec")
    # all figures lie where they must, and exactly the first of the best macro F1 of a source is its best
    whole = Window.partitionBy("source")
    within = lambda c, low=0: F.col(c).between(low, 1)
    return M.run_loso(df, LOSO).select(
        "source", "model", "test_rows", (within("f1") & within("bal_acc") & within("mcc", -1) & within("auroc")).alias("sound"),
        ((F.sum(F.col("best").cast("int")).over(whole) == 1) & (F.max("f1").over(whole) == F.max(F.when(F.col("best"), F.col("f1"))).over(whole))
         ).alias("one_best"))


@check("mod14_final_fit", "vecs", "SELECT log_id, TRUE AS named, TRUE AS scored FROM vecs")
def _(v):
    df = v.vecs.select("log_id", "source", F.when(F.col("label") < 5, 1).otherwise(0).alias("label"), "vec")
    names = ["bayes", "dt"]
    name, model = M.final_model(df, M.run_loso(df, names))
    return M.predict(model, df).select("log_id", F.lit(name).isin(names).alias("named"), (F.col("p").isin(0, 1) & F.col("score").between(0, 1)).alias("scored"))


@check("mod15_few_shot_adaptation")
def _(v):
    return M.adapt_and_score(two_classes(v)).select("log_id", "label", "p", "score")


@check("sc1_batch_scoring")
def _(v):
    rest, held = text_parts(v)
    model = M.train_text(rest)
    ready = held.withColumn("text", F.col("content"))
    return SC.score(ready, model, "text").select("log_id", "source_type", "predicted_class", "predicted_class_name", "confidence", "error")


@check("udf2_user_scorer", "vecs", f"""
WITH {DOUBLES} SELECT log_id, round(1 / (1 + exp(-list_sum(vec))), 5) AS score FROM v""")
def _(v):
    M.register_scorer("logit_of_sum", lambda m: 1.0 / (1.0 + np.exp(-m.sum(1))))
    return M.score_with(v.vecs, "logit_of_sum").select("log_id", r6("score", 5).alias("score"))


@check("udf1_builtin_text_columns", "texts", r"""
SELECT log_id, length(content) AS msg_length, len(regexp_extract_all(content, '\S+')) AS msg_word_count,
  len(list_distinct(string_split(content, ''))) AS msg_unique_chars,
  round(length(regexp_replace(content, '[^\p{Lu}]', '', 'g')) / (length(content) + 1.0)::DOUBLE, 6) AS uppercase_ratio FROM texts""")
def _(v):
    out = add_text_features(v.texts)
    return out.select("log_id", "msg_length", "msg_word_count", "msg_unique_chars", r6("uppercase_ratio").alias("uppercase_ratio"))
