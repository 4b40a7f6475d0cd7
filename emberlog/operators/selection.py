"""Scaling and feature selection, fitted on training rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.operators.sampling import add_class_weight

# Weights of the two scores and the features kept.
MI_WEIGHT, FOREST_WEIGHT, TOP = 0.6, 0.4, 200
SKETCHES = 4  # columns whose quantile sketches one task merges


def fit_scaler(train, cols):
    """Mean and population std of every column, in one pass; {column: (mean, std)}."""
    row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(cols)}


def scale(df, fitted):
    """(x - mean) / std with the fitted figures; a constant column becomes 0."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in fitted.items()})


def _values(cols, values):
    """All columns as one array of doubles. A reader that has one hands it over: rows of hundreds of columns are slow."""
    return F.array(*[F.col(c).cast("double") for c in cols]) if values is None else F.col(values)


def bin_edges(df, cols, bins=10, accuracy=10_000, values=None):
    """Inner quantile edges of all columns from mergeable sketches, in one pass; ``values`` is an array of the columns."""
    points = [i / bins for i in range(1, bins)]
    if len(cols) <= SKETCHES and values is None:
        row = df.agg(*[F.percentile_approx(c, points, accuracy).alias(f"e{i}") for i, c in enumerate(cols)]).first()
        return {c: sorted(set(row[f"e{i}"])) for i, c in enumerate(cols)}
    # one task would merge the sketches of all columns and partitions one after the other
    parts = [F.struct(F.lit(at).alias("part"), F.slice("v", at * SKETCHES + 1, SKETCHES).alias("v")) for at in range(-(-len(cols) // SKETCHES))]
    found = df.select(_values(cols, values).alias("v")).select(F.explode(F.array(*parts)).alias("p")).groupBy("p.part").agg(
        *[F.percentile_approx(F.get("p.v", F.lit(j)), points, accuracy).alias(f"e{j}") for j in range(SKETCHES)])
    rows = {r["part"]: r for r in found.collect()}  # one row per SKETCHES columns
    return {c: sorted(set(rows[i // SKETCHES][f"e{i % SKETCHES}"])) for i, c in enumerate(cols)}


def mutual_information(df, cols, label="label", bins=10, edges=None, values=None):
    """(feature, mi) in nats between the binned feature and the label.

    Every task counts its rows into (feature, bin, label) cells before the shuffle.
    """
    edges = edges or bin_edges(df, cols, bins, values=values)
    kind = df.schema[label].dataType.simpleString()
    cells = df.select(F.col(label).alias("label"), _values(cols, values).alias("values")).mapInArrow(
        _count_cells([np.array(edges[c], dtype=float) for c in cols]), f"feature int, bin int, label {kind}, n long")
    named = F.get(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    # read four times; written once, for else every reading counts all rows anew
    counts = settle(cells.groupBy("feature", "bin", "label").agg(F.sum("n").alias("n")).withColumn("feature", named))
    bin_n = counts.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    label_n = counts.groupBy("feature", "label").agg(F.sum("n").alias("nl"))
    total = counts.groupBy("feature").agg(F.sum("n").alias("nt"))
    j = counts.join(bin_n, ["feature", "bin"]).join(label_n, ["feature", "label"]).join(total, "feature")
    p = F.col("n") / F.col("nt")
    return j.groupBy("feature").agg(F.sum(p * F.log(F.col("n") * F.col("nt") / (F.col("nb") * F.col("nl")))).alias("mi"))


def _count_cells(edges):
    wide = max(len(e) for e in edges) + 1

    def run(batches):
        held, kind = {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = batch.column(0).dictionary_encode(null_encoding="encode")
            kind, names = batch.column(0).type, marks.dictionary.to_pylist()
            code = marks.indices.to_numpy(zero_copy_only=False) * wide
            # a null lies above no edge
            values = batch.column(1).flatten().fill_null(float("-inf")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            found = np.stack([np.bincount(code + np.searchsorted(e, values[:, i]), minlength=len(names) * wide) for i, e in enumerate(edges)])
            for k, name in enumerate(names):
                held[name] = held.get(name, 0) + found[:, k * wide:(k + 1) * wide]
        for name, n in held.items():
            feature, cell = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([
                pa.array(feature, pa.int32()), pa.array(cell, pa.int32()), pa.array([name] * len(cell), kind), pa.array(n[feature, cell], pa.int64())],
                names=["feature", "bin", "label", "n"])

    return run


def forest_importance(df, cols, label="label", trees=100, seed=42, values=None):
    """(feature, importance) from a class-weighted forest."""
    known = F.transform("_a", lambda x: F.coalesce(x, F.lit(float("nan"))))
    made = add_class_weight(df, label, "_w").select(label, "_w", _values(cols, values).alias("_a")).select(label, "_w", array_to_vector(known).alias("_f"))
    forest = RandomForestClassifier(featuresCol="_f", labelCol=label, weightCol="_w", numTrees=trees, seed=seed).fit(made)
    values = forest.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, values)], "feature string, importance double")


def select_features(df, cols, label="label", k=TOP, trees=100, seed=42, values=None):
    """One ranked list for all sources: 0.6 MI/max + 0.4 importance/max."""
    mi = {r["feature"]: r["mi"] for r in mutual_information(df, cols, label, values=values).collect()}  # one row per feature
    rf = {r["feature"]: r["importance"] for r in forest_importance(df, cols, label, trees, seed, values).collect()}
    top_mi, top_rf = max(mi.values()) + 1e-9, max(rf.values()) + 1e-9
    scored = [(c, MI_WEIGHT * mi[c] / top_mi + FOREST_WEIGHT * rf[c] / top_rf) for c in cols]
    scored.sort(key=lambda x: (-x[1], x[0]))
    rows = [(i, c, float(s)) for i, (c, s) in enumerate(scored[:k], 1)]
    return df.sparkSession.createDataFrame(rows, "rank int, feature string, score double")
