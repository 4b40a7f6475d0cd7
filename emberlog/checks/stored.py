from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from emberlog.checks.base import check, r6
from emberlog.durable import fresh_path
from emberlog.plans import feature_store as FS

#: What is compared of every variant: the feature of that name.
PROBES = {
    "bert_only": "vec_0", "bert_enhanced": "content_length", "anomaly_focused": "vec_1", "imbalance_aware_full": "log_count_1H",
    "sentence_focused": "emb_magnitude", "scaled": "hour", "selected": "hour",
}
VALUES_SQL = {
    "vec_0": "coalesce(vec[1], 0)", "vec_1": "coalesce(vec[2], 0)", "content_length": "length(content)", "log_count_1H": "recent",
    "emb_magnitude": "coalesce(sqrt(list_dot_product(vec, vec)), 0)", "hour": "coalesce((hour(ts) - h_mean) / nullif(h_std, 0), 0)",
}


def built(v):
    path = fresh_path(v.spark, "features")
    vectors = v.table("embeddings").select(F.col("vec_id").alias("log_id"), F.col("embedding").alias("vec"))
    FS.write_store(FS.build_rows(v.logs, vectors), path, trees=10)
    return path


@check("snk2_feature_variants", "logs", """
WITH j AS (SELECT l.*, e.embedding::DOUBLE[] AS vec, avg(hour(ts)) OVER (PARTITION BY source) AS h_mean, stddev_pop(hour(ts)) OVER (PARTITION BY source) AS h_std,
  count(*) OVER (PARTITION BY source ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent
  FROM logs l LEFT JOIN embeddings e ON e.vec_id = l.log_id)
""" + " UNION ALL ".join(
    f"SELECT '{n}' AS variant, '{p}' AS feature, log_id, source, label, round(({VALUES_SQL[p]})::DOUBLE, 5) + 0.0::DOUBLE AS value FROM j" for n, p in PROBES.items()))
def _(v):
    path = built(v)
    parts = []
    for name, probe in PROBES.items():
        at = FS.variant_features(v.spark, path, name).index(probe)
        parts.append(FS.read_variant(v.spark, path, name).select(
            F.lit(name).alias("variant"), F.lit(probe).alias("feature"), "log_id", "source", "label",
            (r6(F.get("features", F.lit(at)), 5) + F.lit(0.0)).alias("value")))
    return reduce(lambda a, b: a.unionByName(b), parts)
