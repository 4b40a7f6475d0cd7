"""Synthetic minority rows. Neighbours come from the exact join, choices from digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.operators.draws import draw, hash_rank, uniform
from emberlog.operators.neighbours import knn_join
from emberlog.operators.ordering import attach


def _sizes(df, label):
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}


def _minority(sizes):
    return min(sizes, key=lambda c: (sizes[c], c))


def _interpolate(quotas, pairs, rows, cls, seed, vec, key, label):
    """quotas: (log_id, copies). Each copy sits between the row and one drawn neighbour."""
    spread = quotas.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    counts = pairs.groupBy(F.col("q_id").alias(key)).agg(F.max("rank").alias("_k"))
    drawn = spread.join(counts, key).select(
        key, "copy",
        (F.pmod(draw(key, "copy", seed=seed), F.col("_k")) + 1).alias("rank"),
        uniform(key, "copy", seed=seed + 1).alias("u"),
    )
    linked = drawn.join(pairs.select(F.col("q_id").alias(key), "rank", F.col("b_id").alias("mate")), [key, "rank"])
    own = rows.select(key, F.col(vec).alias("_a"))
    mate = rows.select(F.col(key).alias("mate"), F.col(vec).alias("_b"))
    made = linked.join(own, key).join(mate, "mate")
    point = F.zip_with("_a", "_b", lambda a, b: a + F.col("u") * (b - a))
    return made.select(F.col(key).alias("parent"), "mate", "copy", "u", F.lit(cls).alias(label), point.alias(vec))


def _even_quotas(rows, need, n, seed, key):
    """Copies per row that sum to ``need``; the remainder goes to the first draws."""
    base, rest = divmod(need, n)
    ranked = hash_rank(rows.select(key), [], key, seed=seed + 2)
    return ranked.select(key, (F.lit(base) + F.when(F.col("draw_rank") <= rest, 1).otherwise(0)).alias("copies"))


def _doubles(df, vec):
    return df.withColumn(vec, F.transform(F.col(vec), lambda x: x.cast("double")))


def smote(df, k=5, seed=42, vec="vec", key="log_id", label="label"):
    """Synthetic rows that bring the smallest class to the size of the largest.

    Returns parent, mate, copy, u, label and the point; append them to the train rows only.
    """
    sizes = _sizes(df, label)
    cls = _minority(sizes)
    rows = settle(_doubles(df.filter(F.col(label) == cls).select(key, vec), vec))
    k = max(1, min(k, sizes[cls] - 1))
    pairs = settle(knn_join(rows, rows, k, vec, key))
    quotas = _even_quotas(rows, max(sizes.values()) - sizes[cls], sizes[cls], seed, key)
    return _interpolate(quotas, pairs, rows, cls, seed, vec, key, label)


def _majority_share(df, rows, m, cls, vec, key, label):
    """Share of other classes among the m nearest rows of any class."""
    pairs = knn_join(rows, df, m, vec, key)
    marks = df.select(F.col(key).alias("b_id"), F.col(label).alias("_label"))
    return pairs.join(marks, "b_id").groupBy(F.col("q_id").alias(key)).agg(
        F.avg(F.when(F.col("_label") == cls, 0.0).otherwise(1.0)).alias("share")
    )


def borderline_smote(df, k=5, m=10, seed=42, vec="vec", key="log_id", label="label"):
    """SMOTE from rows whose m neighbours are mostly, but not all, of other classes."""
    df = settle(_doubles(df.select(key, label, vec), vec))
    sizes = _sizes(df, label)
    cls = _minority(sizes)
    rows = df.filter(F.col(label) == cls).select(key, vec)
    share = _majority_share(df, rows, m, cls, vec, key, label)
    danger = settle(share.filter((F.col("share") >= 0.5) & (F.col("share") < 1)).select(key))
    n = danger.count()
    if n == 0:
        danger, n = rows.select(key), sizes[cls]
    pairs = settle(knn_join(rows.join(danger, key), rows, max(1, min(k, sizes[cls] - 1)), vec, key))
    quotas = _even_quotas(danger, max(sizes.values()) - sizes[cls], n, seed, key)
    return _interpolate(quotas, pairs, rows, cls, seed, vec, key, label)


def adasyn(df, k=5, seed=42, vec="vec", key="log_id", label="label"):
    """Synthetic rows in proportion to the share of other classes around each minority row."""
    df = settle(_doubles(df.select(key, label, vec), vec))
    sizes = _sizes(df, label)
    cls = _minority(sizes)
    rows = df.filter(F.col(label) == cls).select(key, vec)
    k = max(1, min(k, sizes[cls] - 1))
    share = settle(_majority_share(df, rows, k, cls, vec, key, label))
    need = max(sizes.values()) - sizes[cls]
    mass = share.agg(F.sum("share").alias("s")).first()["s"] or 0.0
    if mass == 0:
        quotas = _even_quotas(rows, need, sizes[cls], seed, key)
    else:
        quotas = share.select(key, F.round(F.col("share") / F.lit(mass) * need).cast("long").alias("copies"))
    pairs = settle(knn_join(rows, rows, k, vec, key))
    return _interpolate(quotas, pairs, rows, cls, seed, vec, key, label)


def augment_vectors(df, seed=42, sigma=0.01, alpha=0.2, vec="vec", key="log_id", label="label"):
    """Two noisy copies and one mixup of every minority row: parent, kind, label, point."""
    import numpy as np
    import pandas as pd

    sizes = _sizes(df, label)
    cls = _minority(sizes)
    rows = settle(_doubles(df.filter(F.col(label) == cls).select(key, vec), vec))
    n = sizes[cls]
    ranked = settle(hash_rank(rows, [], key, seed=seed, name="r"))
    step = 1 + F.pmod(draw(key, seed=seed + 1), F.lit(max(n - 1, 1)))
    mates = ranked.select(F.col("r").alias("want"), F.col(vec).alias("mate"))
    paired = ranked.withColumn("want", F.pmod(F.col("r") - 1 + step, F.lit(n)) + 1).join(mates, "want").select(key, vec, "mate")

    def run(batches):
        for pdf in batches:
            out = []
            for i, own, mate in zip(pdf[key], pdf[vec], pdf["mate"]):
                rng = np.random.default_rng([seed, int(i) & 0x7FFFFFFF])
                own, mate = np.asarray(own), np.asarray(mate)
                for c in (1, 2):
                    out.append((i, f"noise{c}", cls, own + rng.normal(0.0, sigma, len(own))))
                lam = rng.beta(alpha, alpha)
                out.append((i, "mixup", cls, lam * own + (1 - lam) * mate))
            yield pd.DataFrame(out, columns=["parent", "kind", label, vec])

    return paired.mapInPandas(run, f"parent long, kind string, {label} int, {vec} array<double>")
