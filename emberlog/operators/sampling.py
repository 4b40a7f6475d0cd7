"""Splits, weights and samples. All draws come from digests of the row id, so reruns agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.operators.draws import BITS, draw, hash_rank, uniform
from emberlog.operators.ordering import attach
from emberlog.operators.profile import class_counts

SEED = 42


def _counts(df, label="label"):
    """Class sizes as a dict; one entry per class. Rows without a label belong to none."""
    return {r[label]: r["n"] for r in df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}


def _per_class(values, label="label"):
    """Value of the row's class from a small dict."""
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col(label)]


def cap_rows(df, n=5000, seed=SEED, by="source", key="log_id"):
    """Exactly min(n, size) drawn rows per source."""
    return hash_rank(df, [by], key, seed=seed, keep=n).drop("draw_rank")


def stratified_split(df, frac=0.8, seed=SEED, label="label", key="log_id"):
    """Adds ``part``: round(frac * size) train rows of every class; the only row of a class trains."""
    out = hash_rank(df, [label], key, seed=seed, size="_n")
    part = F.when((F.col("_n") == 1) | (F.col("draw_rank") <= F.round(F.col("_n") * frac)), "train").otherwise("test")
    return out.withColumn("part", part).drop("draw_rank", "_n")


def fold_count(df, k=3, label="label"):
    return max(2, min([k, *_counts(df, label).values()]))


def kfold(df, k=None, seed=SEED, label="label", key="log_id"):
    """Adds ``fold``; folds of a class differ by one row at most. k defaults to min(3, smallest class)."""
    k = k or fold_count(df, 3, label)
    out = hash_rank(df, [label], key, seed=seed)
    return out.withColumn("fold", ((F.col("draw_rank") - 1) % k).cast("int")).drop("draw_rank")


def class_weights(df, label="label"):
    """total / (classes * count) per class."""
    n = _counts(df, label)
    total = sum(n.values())
    rows = df.groupBy(label).agg(F.count("*").alias("n"))
    return rows.withColumn("weight", F.lit(float(total)) / (F.lit(len(n)) * F.col("n")))


def add_class_weight(df, label="label", name="weight"):
    n = _counts(df, label)
    total = sum(n.values())
    return df.withColumn(name, _per_class({k: total / (len(n) * c) for k, c in n.items()}, label))


def focal_weights(df, label="label", alpha=0.25, gamma=2.0):
    """alpha (1 - share)^gamma, scaled to sum to the number of classes."""
    n = _counts(df, label)
    total = sum(n.values())
    raw = {k: alpha * (1 - c / total) ** gamma for k, c in n.items()}
    scale = sum(raw.values())
    rows = df.groupBy(label).agg(F.count("*").alias("n"))
    weight = F.lit(alpha) * F.pow(1 - F.col("n") / F.lit(float(total)), F.lit(gamma))
    return rows.withColumn("weight", F.try_divide(weight, F.lit(scale)) * len(n))


def weighted_resample(df, seed=SEED, label="label", key="log_id"):
    """Rows repeated in proportion to 1/class size, about as many as came in.

    Copies are the floor of the expected number plus a drawn remainder.
    """
    n = _counts(df, label)
    total = sum(n.values())
    w = {k: 1.0 / c for k, c in n.items()}
    if max(n.values()) / min(n.values()) > 100:
        w[min(n, key=lambda k: (n[k], k))] *= 2.0
    mass = sum(w[k] * n[k] for k in n)
    expected = _per_class({k: total * w[k] / mass for k in n}, label)
    copies = F.floor(expected) + F.when(uniform(key, seed=seed) < expected - F.floor(expected), 1).otherwise(0)
    out = df.withColumn("_copies", copies.cast("int")).filter("_copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


def choose_sampler(ratio, minority, profile="ml"):
    """Resampler name and neighbour count as a struct, from imbalance and minority size."""
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    m = F.col(minority) if isinstance(minority, str) else minority
    floor = {"ml": 3, "dl": 3, "text": 5}[profile]
    name = F.when(ratio < floor, "none")
    if profile != "ml":
        name = name.when(m <= 1, "none")
    if profile == "dl":
        name = name.when(m <= 12, "smote")
    name = name.when(ratio > 100, "adasyn").when(ratio > 10, "borderline").otherwise("smote")
    return F.struct(name.alias("sampler"), F.greatest(F.lit(1), F.least(F.lit(5), m - 1)).cast("int").alias("k"))


def balanced_bags(df, n_bags=10, seed=SEED, label="label", key="log_id"):
    """Every bag holds all classes at the size of the smallest; adds ``bag``. Rows without a label are in none.

    A row enters the ranking of a bag only if its draw lies below a bound that its class passes
    with a margin of eight standard deviations, so rows x bags are drawn but neither counted nor
    shuffled. Should a bag fall short of rows below the bound, all rows are ranked.
    """
    n = _counts(df, label)
    if not n:
        return df.limit(0).withColumn("bag", F.lit(0))
    size = min(n.values())
    bound = _per_class({k: int(min(1.0, (size + 8 * size**0.5 + 64) / n[k]) * 2**BITS) for k in n}, label)
    bags, df = F.sequence(F.lit(0), F.lit(n_bags - 1)), df.filter(F.col(label).isNotNull())
    low = settle(df.withColumn("bag", F.explode(F.filter(bags, lambda b: draw(key, b, seed=seed) <= bound))))
    held = low.groupBy("bag", label).agg(F.count("*").alias("n")).filter(F.col("n") >= size).count()
    spread = low if held == n_bags * len(n) else df.withColumn("bag", F.explode(bags))
    return hash_rank(spread, ["bag", label], [key, "bag"], seed=seed, keep=size).drop("draw_rank")


def _roles(df, support, query, seed, label, key):
    """Rows of the drawn episode with their role; sizes per class come as dicts."""
    need = {k: support[k] + query[k] for k in support}
    rows = df.filter(F.col(label).isin(list(need)))
    out = hash_rank(rows, [label], key, seed=seed, keep=_per_class(need, label))
    role = F.when(F.col("draw_rank") <= _per_class(support, label), "support").otherwise("query")
    return out.withColumn("role", role).drop("draw_rank")


def episode(df, n_way=2, k=5, q=15, seed=SEED, label="label", key="log_id"):
    """k support and q query rows for n drawn classes; no rows if a class is too small."""
    n = _counts(df, label)
    if len(n) < n_way:
        return df.limit(0).withColumn("role", F.lit(""))
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in n], f"{label} {df.schema[label].dataType.simpleString()}")
    drawn = [r[label] for r in names.orderBy(draw(label, seed=seed), label).limit(n_way).collect()]
    if any(n[c] < k + q for c in drawn):
        return df.limit(0).withColumn("role", F.lit(""))
    return _roles(df, {c: k for c in drawn}, {c: q for c in drawn}, seed, label, key)


def episode_imbalanced(df, k_min=5, k_maj=10, q=15, seed=SEED, label="label", key="log_id"):
    """Own support size for minority and majority; no rows if either is too small."""
    n = _counts(df, label)
    if len(n) != 2:
        return df.limit(0).withColumn("role", F.lit(""))
    low, high = min(n, key=lambda c: (n[c], c)), max(n, key=lambda c: (n[c], -c))
    support = {low: k_min, high: k_maj}
    if any(n[c] < support[c] + q for c in support):
        return df.limit(0).withColumn("role", F.lit(""))
    return _roles(df, support, {low: q, high: q}, seed, label, key)


def matched_sizes(n_low, n_high, k_max=10, q=15, ratio_cap=5.0):
    """Support and query sizes that follow the classes' own ratio."""
    k_low = min(k_max, max(2, n_low // 4))
    k_high = max(k_low, min(int(k_low * min(n_high / max(n_low, 1), ratio_cap)), n_high // 4))
    return k_low, k_high, min(q, max(3, n_low - k_low)), min(q, max(3, n_high - k_high))


def episode_matched(df, k_max=10, q=15, seed=SEED, label="label", key="log_id"):
    """Episode whose sizes follow the source's ratio, capped at 5; short classes draw with replacement."""
    n = _counts(df, label)
    if len(n) != 2:
        return df.limit(0).withColumns({"role": F.lit(""), "pick": F.lit(0)})
    low, high = min(n, key=lambda c: (n[c], c)), max(n, key=lambda c: (n[c], -c))
    k_low, k_high, q_low, q_high = matched_sizes(n[low], n[high], k_max, q)
    parts = []
    for cls, k, query in ((low, k_low, q_low), (high, k_high, q_high)):
        need = k + query
        ranked = hash_rank(df.filter(F.col(label) == cls), [label], key, seed=seed, keep=min(need, n[cls]))
        spins = df.sparkSession.range(1, need + 1).select(F.col("id").alias("pick"))
        if need > n[cls]:
            spins = spins.withColumn("draw_rank", F.pmod(draw("pick", seed=seed), F.lit(n[cls])) + 1)
        else:
            spins = spins.withColumn("draw_rank", F.col("pick"))
        chosen = ranked.join(spins, "draw_rank").drop("draw_rank")
        parts.append(chosen.withColumn("role", F.when(F.col("pick") <= k, "support").otherwise("query")))
    return parts[0].unionByName(parts[1])


def kshot_plan(df, k_minority=5, k_majority=10, by="source", label="label"):
    """Support sizes per source from its smallest class."""
    per = class_counts(df, (by,), label).groupBy(by).agg(F.min("n").alias("m"), F.count("*").alias("c")).filter("c > 1")
    quarter, half = F.floor(F.col("m") / 4), F.floor(F.col("m") / 2)
    k_min = F.greatest(F.lit(2), F.least(F.lit(k_minority), quarter))
    return per.select(by, F.col("m").alias("minority"), k_min.alias("k_min"),
                      F.greatest(k_min, F.least(F.lit(k_majority), half)).alias("k_maj"))


# Imbalance bounds of the curriculum phases; later phases take every source.
CURRICULUM = [5, 20, 100]


def curriculum(ratios, phase, ratio="imbalance_ratio"):
    return ratios.filter(F.col(ratio) <= CURRICULUM[phase]) if phase < len(CURRICULUM) else ratios


def source_weights(df, template="template", by="source", label="label"):
    """0.3 rows + 0.4 templates + 0.3 / (ratio + 1e-6), scaled to sum to one."""
    # templates of a source are counted from distinct pairs, never by a set in one task
    pairs = df.groupBy(by, template).agg(F.count("*").alias("n"))
    sizes = pairs.groupBy(by).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_templates"))
    ratio = class_counts(df.filter(F.col(label).isNotNull()), (by,), label).groupBy(by).agg(
        (F.max("n") / F.min("n")).alias("ratio")
    )
    raw = settle(attach(sizes, ratio, [by]).withColumn(
        "raw",
        0.3 * F.col("n_rows") + 0.4 * F.col("n_templates") + 0.3 / (F.coalesce("ratio", F.lit(1.0)) + F.lit(1e-6)),
    ))
    total = raw.agg(F.sum("raw").alias("t")).first()["t"]
    return raw.select(by, "n_rows", "n_templates", "ratio", (F.col("raw") / F.lit(total)).alias("weight"))


def federated_average(params, weights, by="source"):
    """Weighted mean of the sources' parameters: (param, idx, value) from (source, param, idx, value)."""
    joined = attach(params, settle(weights.select(by, "weight")), [by], "inner")
    return joined.groupBy("param", "idx").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
