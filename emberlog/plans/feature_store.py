"""Feature store of all sources: one table of named columns, read as any of eight variants.

A variant is a list of columns, so a vector is stored once and not once for each variant, and a
reader scans the columns of its variant only. Beside the rows lie the columns of every group, one
row of moments per source for the scaled variants, and the ranked list of selected features.

A row without a vector gets zeros, a missing number becomes 0, a constant feature scales to 0.
Log ids are unique, labels whole numbers. Sources come back as text.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.functions.text import ERROR_FLAGS, word_count
from emberlog.operators import embeddings as E
from emberlog.operators.ordering import attach
from emberlog.operators.selection import TOP, select_features
from emberlog.operators.templates import LABEL_FREE
from emberlog.operators.windows import SPANS
from emberlog.plans.features import CALENDAR, build_features

NAMES = [*E.VARIANTS, "scaled", "selected"]
COUNTS = [f"log_count_{s}" for s in SPANS]

# The columns of every group; those that a table lacks are left out.
GROUPS = {
    "statistical": [f"{n}_{w}" for w in E.WINDOWS for n in E.ROLLING],
    "sentence": ["content_length", "word_count", "emb_magnitude", "emb_sparsity", "emb_entropy"],
    "template": LABEL_FREE,
    "anomaly": list(ERROR_FLAGS),
    "complexity": [
        "msg_length", "msg_word_count", "msg_unique_chars", "msg_entropy", "special_char_ratio", "number_ratio", "uppercase_ratio",
        "repeated_words", "repeated_chars",
    ],
    "temporal": [*CALENDAR, "time_diff_seconds", *COUNTS, "is_burst", "is_isolated"],
    "stat_numbers": [
        "content_length", "word_count", "content_length_mean_10", "content_length_std_10", "time_diff_mean_10", "time_diff_std_10",
        "hour_frequency",
    ],
    "rolling": ["content_length_mean_10", "content_length_std_10", "time_diff_mean_10", "time_diff_std_10"],
    "time": [*COUNTS, *[f"error_density_{s}" for s in SPANS]],
}


def build_rows(logs, vectors, vec="vec", content="content", windows=E.WINDOWS):
    """Every figure of the groups per log. ``vectors`` holds log_id and ``vec``; vectors of unknown logs are left out."""
    rows = build_features(logs, content)
    rows = rows.withColumns({"content_length": F.length(F.coalesce(content, F.lit(""))), "word_count": word_count(F.coalesce(content, F.lit("")))})
    known = vectors.filter(F.col(vec).isNotNull()).select("log_id", vec)
    timed = settle(logs.select("log_id", "source", "ts").join(known, "log_id"))
    past = E.rolling_embedding_stats(timed, windows, order=("ts", "log_id"), vec=vec)
    own = E.add_vector_features(timed, vec).drop("source", "ts")
    return rows.drop(content).join(own.join(past, "log_id"), "log_id", "left")


def write_store(rows, path, vec="vec", groups=None, label="label", by="source", train=None, k=TOP, trees=100):
    """Write the store. Moments and selection read the rows for which the condition ``train`` holds (all by default)."""
    spark = rows.sparkSession
    groups = {g: [c for c in cols if c in rows.columns] for g, cols in (groups or GROUPS).items()}
    named = E.variant_columns("imbalance_aware_full", {**groups, "sentence": []})[1:]
    named += [c for c in groups.get("sentence", []) if c not in named]
    width = rows.agg(F.max(F.size(vec))).first()[0] or 0
    width = max(width, 0)  # the size of no array is -1
    vector = E.fit_width(F.coalesce(F.col(vec).cast("array<double>"), F.array().cast("array<double>")), width)
    kept = rows.select("log_id", F.col(label).cast("int").alias(label), vector.cast("array<double>").alias("vec"), by,
                       *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in named])
    kept.write.partitionBy(by).parquet(f"{path}/rows")
    listed = [(g, groups.get(g, [])) for g in GROUPS] + [("embedding", _components(width))]
    spark.createDataFrame(listed, "part string, columns array<string>").coalesce(1).write.parquet(f"{path}/groups")
    stored = spark.read.schema(kept.schema).parquet(f"{path}/rows")  # names of sources stay text
    fit = stored if train is None else stored.filter(train)
    full = E.variant_columns("imbalance_aware_full", groups)
    _moments(fit, full, by).write.parquet(f"{path}/moments")
    features = _feature_names(full, width)
    known = fit.select(F.col(label).alias("label"), _joined(full).alias("values")).filter("label IS NOT NULL")
    if known.select("label").distinct().limit(2).count() > 1:  # one class has nothing to select by
        chosen = select_features(known, features, "label", k, trees, values="values")
    else:
        chosen = spark.createDataFrame([], "rank int, feature string, score double")
    chosen.withColumn("total_features", F.lit(len(features))).coalesce(1).write.parquet(f"{path}/selection")


def read_groups(spark, path):
    """Columns of every group, and under ``embedding`` the names of the vector's components."""
    return {r["part"]: r["columns"] for r in spark.read.parquet(f"{path}/groups").collect()}  # ten rows


def read_selection(spark, path):
    """(rank, feature, score, total_features), best first."""
    return spark.read.parquet(f"{path}/selection")


def variant_features(spark, path, name):
    """Names of the features of a variant, in the order of its vector."""
    groups = read_groups(spark, path)
    if name == "selected":
        return [r["feature"] for r in read_selection(spark, path).orderBy("rank").collect()]  # the features kept
    return _feature_names(E.variant_columns(name, groups), len(groups["embedding"]))


def read_variant(spark, path, name, label="label", by="source"):
    """(log_id, source, label, features) of a variant; ``scaled`` and ``selected`` by the moments of the row's own source.

    A source without moments (no training row) is scaled by those of no source: its features are null.
    """
    groups = read_groups(spark, path)
    columns = E.variant_columns("scaled" if name == "selected" else name, groups)
    types = ", ".join(f"`{c}` double" for c in columns if c != "embedding")
    rows = spark.read.schema(f"log_id long, `{label}` int, vec array<double>{', ' + types if types else ''}, `{by}` string").parquet(f"{path}/rows")
    if name not in ("scaled", "selected"):
        return rows.select("log_id", by, label, _joined(columns).alias("features"))
    fit = spark.read.parquet(f"{path}/moments")
    if name == "scaled":
        values, fit = _joined(columns), fit.select(by, F.arrays_zip("mean", "spread").alias("_fit"))
        none = F.lit(None)
    else:
        # the columns kept are picked before they are scaled: a pick from the scaled ones would scale them all for each
        features = _feature_names(columns, len(groups["embedding"]))
        chosen = variant_features(spark, path, name)
        if not chosen:
            return rows.select("log_id", by, label, F.array().cast("array<double>").alias("features"))
        parts = {f: F.get("vec", F.lit(i)) for i, f in enumerate(groups["embedding"])}
        values = F.array(*[parts[f] if f in parts else F.col(f) for f in chosen])
        pairs = [F.struct(*[F.get(m, F.lit(features.index(f))).alias(m) for m in ("mean", "spread")]) for f in chosen]
        fit = fit.select(by, F.array(*pairs).alias("_fit"))
        none = F.array_repeat(F.lit(None).cast("double"), len(chosen))
    out = attach(rows.select("log_id", by, label, values.alias("features")), fit, [by])
    scaled = F.zip_with("features", "_fit", lambda x, f: (x - f["mean"]) / f["spread"])
    return out.select("log_id", by, label, F.coalesce(scaled, none).alias("features"))


def _components(width):
    return [f"vec_{i}" for i in range(width)]


def _feature_names(columns, width):
    return [f for c in columns for f in (_components(width) if c == "embedding" else [c])]


def _joined(columns):
    """One array of the vector and the named columns, in order."""
    parts, run = [], []
    for c in columns:
        if c == "embedding":
            parts += [F.array(*run)] if run else []
            parts, run = [*parts, F.col("vec")], []
        else:
            run.append(F.col(c))
    parts += [F.array(*run)] if run else []
    return F.concat(*parts) if parts else F.array().cast("array<double>")


def _moments(rows, columns, by):
    """One row per source: mean and population std of every feature, 1 where a feature is constant."""
    found = Summarizer.metrics("mean", "std", "count").summary(array_to_vector(_joined(columns)))
    got = rows.groupBy(by).agg(found.alias("m"))
    n = F.col("m.count")
    spread = F.transform(vector_to_array("m.std"), lambda s: F.when(s == 0, 1.0).otherwise(s * F.sqrt((n - 1) / n)))
    return got.select(by, vector_to_array("m.mean").alias("mean"), spread.alias("spread"))
