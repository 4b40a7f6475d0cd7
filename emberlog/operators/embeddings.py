"""Vectors per log: rolling statistics, prototypes, similarity, assembled variants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from emberlog.durable import settle
from emberlog.operators.neighbours import knn_join, pairwise
from emberlog.operators.ordering import attach, exact_quantiles, literals, with_halo, with_sequence

# Rolling window sizes, and the near-zero bound of a sparse component.
WINDOWS = (5, 10, 20, 50)
SPARSE = 0.01
ROLLING = ("mean_dist", "avg_std", "min_dist", "max_dist", "median_dist", "is_outlier", "cosine_mean")


SQUARES = 256  # rows whose windows are held at once


def _window_stats(m, at, w, back, exclude_self):
    """Seven figures of the rows ``at`` of a matrix against the window of ``w`` rows before each.

    All windows of equal length are one strided view; the few short ones at the start come one length at a time.
    """
    out = np.zeros((len(at), len(ROLLING)))
    length = np.minimum(at + 1, w + 1 - back)
    for n in np.unique(length):
        same = np.flatnonzero(length == n)
        views = np.lib.stride_tricks.sliding_window_view(m, n, axis=0)  # (start, component, place)
        for part in np.array_split(same, -(-len(same) // SQUARES)):
            past, own = views[at[part] - n + 1].transpose(0, 2, 1), m[at[part]]
            mean = past.mean(1)
            to_mean = np.linalg.norm(own - mean, axis=1)
            out[part, 0], out[part, 1] = to_mean, past.std(1).mean(1)
            if n > 1:
                d = np.linalg.norm((past[:, :-1] if exclude_self else past) - own[:, None], axis=2)
                q25, mid, q75 = np.percentile(d, [25, 50, 75], axis=1)
                out[part, 2], out[part, 3], out[part, 4] = d.min(1), d.max(1), mid
                out[part, 5] = to_mean > q75 + 1.5 * (q75 - q25)
            dot = np.einsum("ij,ij->i", own, mean)
            out[part, 6] = dot / (np.linalg.norm(own, axis=1) * np.linalg.norm(mean, axis=1) + 1e-8)
    return out


def rolling_embedding_stats(df, windows=WINDOWS, exclude_self=False, frame="batch", by="source", order=("log_id",),
                            vec="vec", key="log_id", chunk=2000):
    """Distance and spread figures of a row against the rows before it.

    frame="batch" looks at w earlier rows and the row itself, "serving" at w rows with it.
    exclude_self leaves the row out of the distances (not of the mean).
    """
    reach = max(windows)
    ranked = with_sequence(df.select(key, by, *[o for o in order if o not in (key, by)], vec), [by], list(order))
    cut = with_halo(ranked.select(key, by, vec, "seq"), reach, chunk=chunk)
    names = [f"{n}_{w}" for w in windows for n in ROLLING]
    schema = StructType(
        [StructField(key, LongType()), *[StructField(n, DoubleType()) for n in names]]
    )
    back = 0 if frame == "batch" else 1

    def run(pdf):
        pdf = pdf.sort_values("seq")
        m = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec]])
        own, keys = pdf["_own"].to_numpy(), pdf[key].to_numpy()
        at = np.flatnonzero(own)
        figures = np.concatenate([_window_stats(m, at, w, back, exclude_self) for w in windows], axis=1)
        out = pd.DataFrame(figures, columns=names)
        out.insert(0, key, keys[at])
        return out

    return cut.groupBy(by, "_chunk").applyInPandas(run, schema)


def vector_columns(vec="vec"):
    """norm, share of near-zero components, entropy (natural log) of absolute shares."""
    v = F.transform(F.col(vec), lambda x: F.abs(x.cast("double")))
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))
    size = F.size(v)
    return {
        "emb_magnitude": F.sqrt(total(lambda x: x * x)),
        "emb_sparsity": F.size(F.filter(v, lambda x: x < SPARSE)) / size,
        "emb_sum": total(lambda x: x),
    }


def add_vector_features(df, vec="vec", content=None):
    out = df.withColumns(vector_columns(vec))
    share = lambda x: F.abs(x.cast("double")) / (F.col("emb_sum") + F.lit(1e-8))
    entropy = -F.aggregate(F.col(vec), F.lit(0.0), lambda a, x: a + share(x) * F.ln(share(x) + F.lit(1e-8)))
    out = out.withColumn("emb_entropy", entropy).drop("emb_sum")
    if content:
        from emberlog.functions.text import word_count

        out = out.withColumns({"text_len": F.length(content), "word_count": word_count(content)})
    return out


def class_prototypes(df, label="label", vec="vec"):
    """Mean vector per class; partial sums are vectors, nothing is exploded."""
    mean = Summarizer.mean(array_to_vector(F.transform(F.col(vec), lambda x: x.cast("double"))))
    out = df.groupBy(label).agg(F.count("*").alias("n"), mean.alias("_m"))
    return out.select(label, "n", vector_to_array("_m").alias("prototype"))


PROTO_BLOCK = 256  # centroids that a batch is compared with at once
PROTO_BYTES = 32 << 20  # centroids that travel with a task


def nearest_prototype(df, protos, vec="vec", label="label"):
    """Nearest class centroid and softmax(-distance) of it; of equal distances the smallest label.

    Rows pass over the centroids in blocks of at most PROTO_BYTES, of which the driver and a task
    hold one at a time. Each block folds into a running nearest one and a running sum, so any
    number of classes is handled exactly; between blocks the rows are written.
    """
    ranked = settle(with_sequence(protos.select(label, "prototype"), [], [label], name="_nth"))
    size = ranked.agg(F.count("*").alias("n"), F.max(F.size("prototype")).alias("w")).first()
    in_pass = max(1, PROTO_BYTES // (8 * max(size["w"] or 1, 1)))
    state = [StructField("predicted", protos.schema[label].dataType), StructField("proto_distance", DoubleType()), StructField("_mass", DoubleType())]
    out = df
    for first in range(0, max(size["n"], 1), in_pass):
        out = settle(out) if first else out
        rows = ranked.filter(F.col("_nth").between(first, first + in_pass - 1)).orderBy("_nth").collect()  # one block
        out = out.mapInPandas(_fold_block(rows, label, vec), StructType([*df.schema.fields, *state]))
    return out.withColumn("proto_probability", F.try_divide(F.lit(1.0), "_mass")).drop("_mass")


def _fold_block(rows, label, vec):
    labels = np.array([r[label] for r in rows])
    matrix = np.array([r["prototype"] for r in rows], dtype=np.float64)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec]])
            seen = "_mass" in pdf
            best = pdf["proto_distance"].to_numpy(copy=True) if seen else np.full(len(m), np.inf)
            mass = pdf["_mass"].to_numpy(copy=True) if seen else np.zeros(len(m))
            name = pdf["predicted"].to_numpy(copy=True) if seen else np.full(len(m), labels[0] if len(labels) else None)
            for start in range(0, len(matrix), PROTO_BLOCK):
                d = pairwise(m, matrix[start:start + PROTO_BLOCK])
                low, at = d.min(1), d.argmin(1)
                better = low < best
                shift = np.where(better, low, best)
                mass = mass * np.exp(shift - np.where(np.isinf(best), shift, best)) + np.exp(shift[:, None] - d).sum(1)
                name = np.where(better, labels[start + at], name)
                best = shift
            pdf["predicted"], pdf["proto_distance"], pdf["_mass"] = name, best, mass
            yield pdf

    return run


def ema_prototypes(df, batch_col, momentum=0.9, label="label", vec="vec"):
    """Class means smoothed over batches in order.

    The fold is a weighted mean: the first batch weighs m^(B-1), batch b weighs
    (1-m) m^(B-1-b), and the weights sum to one.
    """
    means = class_prototypes(df.withColumn("_key", F.struct(label, batch_col)), "_key", vec).select(
        F.col(f"_key.{label}").alias(label), F.col(f"_key.{batch_col}").alias(batch_col), "prototype"
    )
    ranked = with_sequence(means, [label], [batch_col], name="_nth", total="_batches")
    age = F.pow(F.lit(momentum), F.col("_batches") - 1 - F.col("_nth"))
    weight = F.when(F.col("_nth") == 0, age).otherwise(age * (1 - momentum))
    mean = Summarizer.mean(array_to_vector(F.col("prototype")), weight)
    out = ranked.groupBy(label).agg(F.max("_batches").alias("n_batches"), mean.alias("_m"))
    return out.select(label, "n_batches", vector_to_array("_m").alias("prototype"))


def max_cosine(queries, corpus, label="label", vec="vec", key="log_id"):
    """Best cosine of every query to the corpus vectors of each label.

    On unit vectors the best cosine belongs to the nearest one: cos = 1 - d^2 / 2.
    """
    near = knn_join(queries, corpus, 1, vec, key, group=label, normalize=True)
    return near.select(
        F.col("q_id").alias(key), label, F.col("b_id").alias("match"), (1 - F.col("dist") * F.col("dist") / 2).alias("cosine")
    )


def norm_score(df, vec="vec", fraction=0.75, cut=None):
    """Norm above the percentile, or above a ``cut`` known from sketches, is an anomaly; min-max scaled norm is the score."""
    out = df.withColumn("norm", vector_columns(vec)["emb_magnitude"])
    norms = settle(out.select("norm"))
    if cut is None:
        cut = exact_quantiles(norms, "norm", [fraction]).first()["quantile"]
    span = literals(norms.agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")))
    return out.withColumns({
        "predicted": F.when(F.col("norm") > F.lit(cut), 1).otherwise(0),
        "score": (F.col("norm") - span["lo"]) / (span["hi"] - span["lo"] + F.lit(1e-8)),
    })


def fit_width(vec, n=200):
    """Pad with zeros or cut to n components."""
    v = F.col(vec) if isinstance(vec, str) else vec
    zero = F.array_repeat(F.lit(0.0).cast("float"), n)
    return F.slice(F.concat(v, zero), 1, n)


def assemble_variant(df, name, groups, vec="vec", out="features", selected=None, train=None):
    """Feature vector of a named variant from groups of columns; repeated columns enter once.

    ``groups`` maps statistical, sentence, template, anomaly, complexity, temporal,
    stat_numbers, rolling and time to column lists. ``scaled`` is the full variant, scaled by
    the rows for which the condition ``train`` holds (all by default).
    """
    columns = variant_columns(name, groups, selected)
    work = df
    if "embedding" in columns:
        work = df.withColumn("_vec", array_to_vector(F.transform(F.col(vec), lambda x: x.cast("double"))))
        columns = ["_vec" if c == "embedding" else c for c in columns]
    made = VectorAssembler(inputCols=columns, outputCol=out).transform(work)
    if name == "scaled":
        scaler = StandardScaler(inputCol=out, outputCol="_scaled", withMean=True, withStd=True)
        fitted = scaler.fit(made if train is None else made.filter(train))
        made = fitted.transform(made).drop(out).withColumnRenamed("_scaled", out)
    return made.drop("_vec")


# Column groups of every variant.
VARIANTS = {
    "bert_only": ["embedding"],
    "bert_enhanced": ["embedding", "statistical", "sentence"],
    "template_enhanced": ["template"],
    "anomaly_focused": ["embedding", "anomaly", "template"],
    "imbalance_aware_full": [
        "embedding", "statistical", "template", "anomaly", "complexity", "temporal", "stat_numbers", "rolling", "time",
    ],
    "sentence_focused": ["embedding", "sentence", "template", "complexity"],
}


def variant_columns(name, groups, selected=None):
    """Distinct column names of a variant in order. scaled and selected build on the full one."""
    if name == "selected":
        return list(dict.fromkeys(selected))
    parts = VARIANTS["imbalance_aware_full" if name == "scaled" else name]
    names = []
    for part in parts:
        names += ["embedding"] if part == "embedding" else groups.get(part, [])
    return list(dict.fromkeys(names))
