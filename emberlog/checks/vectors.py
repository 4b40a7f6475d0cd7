from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.checks.base import check, draw_sql, r6
from emberlog.operators import embeddings as E
from emberlog.operators import resample as R
from emberlog.operators.neighbours import knn_classify, knn_join

DOUBLES = "v AS (SELECT log_id, source, label, vec::DOUBLE[] AS vec FROM vecs)"


@check("jn7_knn_join", "vecs", f"""
WITH {DOUBLES},
p AS (SELECT a.log_id AS q_id, b.log_id AS b_id, list_distance(a.vec, b.vec) AS d FROM v a JOIN v b ON a.log_id <> b.log_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, b_id) AS rank FROM p)
SELECT q_id, b_id, round(d, 6) AS dist, rank FROM r WHERE rank <= 5""")
def _(v):
    return knn_join(v.vecs, v.vecs, 5).withColumn("dist", r6("dist"))


@check("mod5_k_nearest_neighbours", "vecs", f"""
WITH {DOUBLES},
p AS (SELECT a.log_id AS q_id, b.log_id AS b_id, b.label, list_distance(a.vec, b.vec) AS d FROM v a JOIN v b ON a.log_id <> b.log_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d, b_id) AS rank FROM p),
w AS (SELECT q_id, label, count(*) AS n FROM r WHERE rank <= 7 GROUP BY q_id, label),
t AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY n DESC, label) AS k FROM w)
SELECT q_id AS log_id, label AS prediction, round(n / 7.0::DOUBLE, 6) AS share FROM t WHERE k = 1""")
def _(v):
    return knn_classify(v.vecs, v.vecs, 7).withColumn("share", r6("share"))


PROTO_SQL = """u AS (SELECT label, i, avg(vec[i]) AS m FROM v, range(1, 65) t(i) GROUP BY label, i),
protos AS (SELECT label, list(m ORDER BY i) AS prototype FROM u GROUP BY label)"""
DIST_SQL = "d AS (SELECT v.log_id, protos.label, list_distance(v.vec, prototype) AS d FROM v CROSS JOIN protos)"


@check("emb3_class_prototypes", "vecs", f"""
WITH {DOUBLES}, {PROTO_SQL}
SELECT label, (SELECT count(*) FROM v WHERE v.label = protos.label) AS n, array_to_string(list_transform(prototype, lambda x: round(x * 10000)::BIGINT), ',') AS prototype FROM protos""")
def _(v):
    out = E.class_prototypes(v.vecs)
    rounded = F.transform("prototype", lambda x: F.round(x * 10000).cast("long"))
    return out.withColumn("prototype", F.array_join(rounded, ","))


@check("jn9_prototype_distance_join", "vecs", f"""
WITH {DOUBLES}, {PROTO_SQL}, {DIST_SQL}
SELECT log_id, label AS predicted, round(d, 6) AS proto_distance
FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY d, label) AS k FROM d) WHERE k = 1""")
def _(v):
    out = E.nearest_prototype(v.vecs, E.class_prototypes(v.vecs))
    return out.select("log_id", "predicted", r6("proto_distance").alias("proto_distance"))


@check("emb4_prototype_soft_score", "vecs", f"""
WITH {DOUBLES}, {PROTO_SQL}, {DIST_SQL}
SELECT log_id, round(exp(-min(d)) / sum(exp(-d)), 6) AS proto_probability FROM d GROUP BY log_id""")
def _(v):
    out = E.nearest_prototype(v.vecs, E.class_prototypes(v.vecs))
    return out.select("log_id", r6("proto_probability").alias("proto_probability"))


@check("emb5_smoothed_prototypes", "vecs", f"""
WITH {DOUBLES}, b AS (SELECT label, log_id // 100 AS batch, i, avg(vec[i]) AS m FROM v, range(1, 65) t(i) GROUP BY label, log_id // 100, i),
k AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY batch) - 1 AS b, count(*) OVER (PARTITION BY label, i) AS n FROM b),
s AS (SELECT label, i, max(n) AS n_batches, sum(m * pow(0.9, n - 1 - b) * CASE WHEN b = 0 THEN 1 ELSE 0.1 END::DOUBLE) AS m FROM k GROUP BY label, i)
SELECT label, max(n_batches) AS n_batches, array_to_string(list(round(m * 10000)::BIGINT ORDER BY i), ',') AS prototype FROM s GROUP BY label""")
def _(v):
    out = E.ema_prototypes(v.vecs.withColumn("batch", F.floor(F.col("log_id") / 100)), "batch")
    rounded = F.transform("prototype", lambda x: F.round(x * 10000).cast("long"))
    return out.withColumn("prototype", F.array_join(rounded, ","))


@check("emb6_max_cosine", "vecs", f"""
WITH {DOUBLES}, p AS (SELECT a.log_id, b.label, list_cosine_similarity(a.vec, b.vec) AS c FROM v a JOIN v b ON a.log_id <> b.log_id)
SELECT log_id, label, round(max(c), 5) AS cosine FROM p GROUP BY log_id, label""")
def _(v):
    return E.max_cosine(v.vecs, v.vecs).select("log_id", "label", r6("cosine", 5).alias("cosine"))


@check("emb7_norm_score", "vecs", f"""
WITH {DOUBLES}, n AS (SELECT log_id, sqrt(list_dot_product(vec, vec)) AS norm FROM v),
s AS (SELECT quantile_cont(norm, 0.75) AS q, min(norm) AS lo, max(norm) AS hi FROM n)
SELECT log_id, CASE WHEN norm > q THEN 1 ELSE 0 END AS predicted, round((norm - lo) / (hi - lo + 1e-8), 4) AS score FROM n, s""")
def _(v):
    # norms of unit vectors differ in the last digits only, so the vectors are stretched by their id
    return E.norm_score(v.vecs.select("log_id", "vec")).select("log_id", "predicted", r6("score", 4).alias("score"))


@check("emb2_vector_features", "vecs", f"""
WITH {DOUBLES}, a AS (SELECT log_id, list_transform(vec, lambda x: abs(x)) AS a FROM v), s AS (SELECT log_id, a, list_sum(a) AS t FROM a)
SELECT log_id, round(sqrt(list_dot_product(a, a)), 5) AS emb_magnitude, round(len(list_filter(a, lambda x: x < 0.01)) / len(a)::DOUBLE, 6) AS emb_sparsity,
  round(-list_sum(list_transform(a, lambda x: x / (t + 1e-8) * ln(x / (t + 1e-8) + 1e-8))), 5) AS emb_entropy FROM s""")
def _(v):
    out = E.add_vector_features(v.vecs)
    return out.select("log_id", r6("emb_magnitude", 5).alias("emb_magnitude"), r6("emb_sparsity").alias("emb_sparsity"),
                      r6("emb_entropy", 5).alias("emb_entropy"))


@check("emb9_fit_width", "vecs", """
WITH f AS (SELECT log_id, list_concat(vec, list_transform(range(200), lambda x: 0.0::FLOAT))[1:200] AS f, vec[1:48] AS cut FROM vecs)
SELECT log_id, len(f) AS n, round(list_sum(f::DOUBLE[]), 4) AS total, len(cut) AS n_cut, round(list_sum(cut::DOUBLE[]), 4) AS total_cut FROM f""")
def _(v):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    wide, cut = E.fit_width("vec", 200), E.fit_width("vec", 48)
    return v.vecs.select("log_id", F.size(wide).alias("n"), total(wide).alias("total"), F.size(cut).alias("n_cut"),
                         total(cut).alias("total_cut"))


def _rolling_sql(w):
    return f"""p{w} AS (SELECT a.log_id, a.vec AS own, b.vec AS other FROM r a JOIN r b ON a.source = b.source AND b.rn BETWEEN a.rn - {w} AND a.rn),
c{w} AS (SELECT log_id, i, avg(other[i]) AS m, stddev_pop(other[i]) AS s FROM p{w}, range(1, 65) t(i) GROUP BY log_id, i),
m{w} AS (SELECT log_id, list(m ORDER BY i) AS mean, avg(s) AS avg_std FROM c{w} GROUP BY log_id),
d{w} AS (SELECT log_id, any_value(own) AS own, count(*) AS n, min(list_distance(own, other)) AS lo, max(list_distance(own, other)) AS hi,
  quantile_cont(list_distance(own, other), [0.25, 0.5, 0.75]) AS q FROM p{w} GROUP BY log_id),
s{w} AS (SELECT log_id, list_distance(own, mean) AS mean_dist, avg_std, CASE WHEN n > 1 THEN lo ELSE 0 END AS min_dist,
  CASE WHEN n > 1 THEN hi ELSE 0 END AS max_dist, CASE WHEN n > 1 THEN q[2] ELSE 0 END AS median_dist,
  CASE WHEN n > 1 AND list_distance(own, mean) > q[3] + 1.5 * (q[3] - q[1]) THEN 1.0 ELSE 0.0 END::DOUBLE AS is_outlier,
  list_dot_product(own, mean) / (sqrt(list_dot_product(own, own)) * sqrt(list_dot_product(mean, mean)) + 1e-8) AS cosine_mean
  FROM d{w} JOIN m{w} USING (log_id))"""


@check("emb1_rolling_embedding_stats", "vecs", f"""
WITH {DOUBLES}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY log_id) AS rn FROM v),
{', '.join(_rolling_sql(w) for w in E.WINDOWS)}
SELECT s5.log_id, {', '.join(f'round(s{w}.{n}, 5) AS {n}_{w}' for w in E.WINDOWS for n in E.ROLLING)}
FROM s5 JOIN s10 USING (log_id) JOIN s20 USING (log_id) JOIN s50 USING (log_id)""")
def _(v):
    out = E.rolling_embedding_stats(v.vecs)
    return out.select("log_id", *[r6(c, 5).alias(c) for c in out.columns if c != "log_id"])


def _serving_sql(w):
    """Figures of a row against the window of ``w`` rows that ends with it."""
    return f"""m{w} AS (SELECT log_id, source, rn, sqrt(sum(power(x - mu, 2))) AS mean_dist, avg(sd) AS avg_std,
    sum(x * mu) / (sqrt(sum(x * x)) * sqrt(sum(mu * mu)) + 1e-8) AS cosine_mean FROM (
      SELECT log_id, source, rn, x, avg(x) OVER o AS mu, stddev_pop(x) OVER o AS sd FROM comps
      WINDOW o AS (PARTITION BY source, comp ORDER BY rn ROWS {w - 1} PRECEDING)) GROUP BY ALL),
d{w} AS (SELECT a.log_id, min(list_distance(a.v, b.v)) AS min_dist, max(list_distance(a.v, b.v)) AS max_dist,
    median(list_distance(a.v, b.v)) AS median_dist, quantile_cont(list_distance(a.v, b.v), 0.25) AS q25, quantile_cont(list_distance(a.v, b.v), 0.75) AS q75
  FROM r a JOIN r b ON a.source = b.source AND b.rn BETWEEN a.rn - {w - 1} AND a.rn - 1 GROUP BY 1),
s{w} AS (SELECT m.log_id, mean_dist, avg_std, coalesce(min_dist, 0) AS min_dist, coalesce(max_dist, 0) AS max_dist, coalesce(median_dist, 0) AS median_dist,
    CASE WHEN mean_dist > q75 + 1.5 * (q75 - q25) THEN 1.0 ELSE 0.0 END AS is_outlier, cosine_mean FROM m{w} m LEFT JOIN d{w} USING (log_id))"""


SERVING_SQL = f"""
WITH r AS (SELECT log_id, source, list_transform(vec, lambda x: x::DOUBLE) AS v, row_number() OVER (PARTITION BY source ORDER BY log_id) AS rn FROM vecs),
comps AS (SELECT log_id, source, rn, unnest(v) AS x, generate_subscripts(v, 1) AS comp FROM r),
{', '.join(_serving_sql(w) for w in E.WINDOWS)}
SELECT s5.log_id, {', '.join(f'round(s{w}.{n}, 5)::DOUBLE AS {n}_{w}' for w in E.WINDOWS for n in E.ROLLING)}
FROM s5 JOIN s10 USING (log_id) JOIN s20 USING (log_id) JOIN s50 USING (log_id)"""


@check("emb1_rolling_serving_frame", "vecs", SERVING_SQL)
def _(v):
    out = E.rolling_embedding_stats(v.vecs, exclude_self=True, frame="serving")
    return out.select("log_id", *[r6(c, 5).alias(c) for c in out.columns if c != "log_id"])


BINARY = "b AS (SELECT log_id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label, vec FROM v), m AS (SELECT log_id, vec FROM b WHERE label = 1)"


def two_classes(v):
    return v.vecs.select("log_id", F.when(F.col("label") < 3, 1).otherwise(0).alias("label"), "vec")


def _synthetic_sql(quota, pool="m"):
    return f"""nn AS (SELECT a.log_id, c.log_id AS mate, row_number() OVER (PARTITION BY a.log_id ORDER BY list_distance(a.vec, c.vec), c.log_id) AS rank
  FROM {pool} a JOIN m c ON a.log_id <> c.log_id),
need AS (SELECT count(*) FILTER (label = 0) - count(*) FILTER (label = 1) AS g FROM b),
{quota},
spread AS (SELECT log_id, unnest(range(1, copies + 1)) AS copy FROM quotas WHERE copies > 0),
drawn AS (SELECT log_id, copy, {draw_sql('log_id, copy', 42)} % 5 + 1 AS rank, {draw_sql('log_id, copy', 43)} / pow(2, 52) AS u FROM spread),
made AS (SELECT d.log_id AS parent, nn.mate, copy, u, a.vec AS x, c.vec AS y FROM drawn d JOIN nn ON nn.log_id = d.log_id AND nn.rank = d.rank
  JOIN m a ON a.log_id = d.log_id JOIN m c ON c.log_id = nn.mate)
SELECT parent, mate, copy, round(u, 6) AS u, 1 AS label, round(list_sum(x) + u * (list_sum(y) - list_sum(x)), 4) AS total FROM made"""


EVEN_SQL = """pool_n AS (SELECT count(*) AS n FROM {pool}),
quotas AS (SELECT log_id, g // n + CASE WHEN row_number() OVER (ORDER BY {draw}, log_id) <= g % n THEN 1 ELSE 0 END AS copies FROM {pool}, need, pool_n)"""


def synthetic_rows(made):
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return made.select("parent", "mate", "copy", r6("u").alias("u"), "label", F.round(total, 4).alias("total"))


@check("smp8_smote", "vecs", f"WITH {DOUBLES}, {BINARY}, {_synthetic_sql(EVEN_SQL.format(pool='m', draw=draw_sql('log_id', 44)))}")
def _(v):
    return synthetic_rows(R.smote(two_classes(v)))


SHARE_SQL = """an AS (SELECT a.log_id, c.label, row_number() OVER (PARTITION BY a.log_id ORDER BY list_distance(a.vec, c.vec), c.log_id) AS rank
  FROM m a JOIN b c ON a.log_id <> c.log_id),
share AS (SELECT log_id, avg(CASE WHEN label = 1 THEN 0.0 ELSE 1.0 END)::DOUBLE AS share FROM an WHERE rank <= {k} GROUP BY log_id)"""


@check("smp9_borderline_smote", "vecs", f"""WITH {DOUBLES}, {BINARY}, {SHARE_SQL.format(k=10)},
danger AS (SELECT log_id, vec FROM m WHERE log_id IN (SELECT log_id FROM share WHERE share >= 0.5 AND share < 1)),
{_synthetic_sql(EVEN_SQL.format(pool='danger', draw=draw_sql('log_id', 44)), 'danger')}""")
def _(v):
    return synthetic_rows(R.borderline_smote(two_classes(v)))


@check("smp10_adasyn", "vecs", f"""WITH {DOUBLES}, {BINARY}, {SHARE_SQL.format(k=5)},
{_synthetic_sql("quotas AS (SELECT log_id, round(share / (SELECT sum(share) FROM share) * g)::BIGINT AS copies FROM share, need)")}""")
def _(v):
    return synthetic_rows(R.adasyn(two_classes(v)))


@check("smp16_vector_augmentation")
def _(v):
    return R.augment_vectors(two_classes(v))
