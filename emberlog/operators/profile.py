"""Counts and ratios by source and class. Everything is pre-aggregated by (source, label)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.operators.ordering import attach, literals


def class_counts(df, by=("source",), label="label"):
    """One row per (source, label); all profiles start here, so the logs are read once."""
    return df.groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("n"))


def class_distribution(df, by=("source",), classes=(0, 1), label="label"):
    """Count and percent per class, with 0 for absent ones."""
    by = list(by)
    counts = settle(class_counts(df, by, label))
    grid = F.explode(F.array(*[F.lit(c) for c in classes]))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    dense = totals.withColumn("label", grid)
    out = attach(dense, counts, [*by, "label"])
    n = F.coalesce("n", F.lit(0))
    return out.select(*by, "label", n.alias("n"), (n * 100.0 / F.col("total")).alias("percent"))


def imbalance(df, by=("source",), label="label", single_class=None):
    """Largest over smallest present class; one class gives null or ``single_class``."""
    counts = class_counts(df, by, label)
    out = counts.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_classes"),
        F.max("n").alias("largest"),
        F.min("n").alias("smallest"),
    )
    return out.select(
        *by, "n_rows", "n_classes", "smallest",
        F.when(F.col("n_classes") == 1, F.lit(single_class).cast("double"))
        .otherwise(F.col("largest") / F.col("smallest")).alias("imbalance_ratio"),
        F.when(F.col("n_classes") == 1, 1).otherwise(0).alias("single_class"),
    )


def class_presence(df, classes=(0, 1), by="source", label="label"):
    present = class_counts(df, (by,), label).groupBy(by).agg(F.array_sort(F.collect_set("label")).alias("present"))
    every = F.array(*[F.lit(c) for c in classes])
    return present.withColumn("missing", F.array_except(every, F.col("present")))


def class_availability(df, classes=(0, 1), by="source", label="label"):
    """How many sources hold each class. ``class_sources`` lists them as rows."""
    counts = settle(class_counts(df, (by,), label))
    n_sources = counts.select(F.countDistinct(by).alias("n_all"))
    held = counts.groupBy("label").agg(F.count("*").alias("n_sources"))
    grid = n_sources.withColumn("label", F.explode(F.array(*[F.lit(c) for c in classes])))
    out = attach(grid, held, ["label"])
    n = F.coalesce("n_sources", F.lit(0))
    share = n * 100.0 / F.col("n_all")
    return out.select(
        "label", n.alias("n_sources"), share.alias("coverage"),
        F.when(share < 50, 1).otherwise(0).alias("low"),
        F.when(n < F.col("n_all") * 0.3, 1).otherwise(0).alias("rare"),
        F.when(n == 0, 1).otherwise(0).alias("missing"),
    )


def class_sources(df, by="source", label="label"):
    """One row per class and source that holds it, with its rows."""
    return class_counts(df, (by,), label)


def minority_classes(df, by="source", label="label"):
    """Classes below 5 % and below 1 % of their source; none for one-class sources."""
    counts = class_counts(df, (by,), label)
    share = counts.withColumn("total", F.sum("n").over(Window.partitionBy(by))).withColumn(
        "n_classes", F.count("*").over(Window.partitionBy(by))
    )
    several = F.col("n_classes") > 1
    return share.groupBy(by).agg(
        F.array_sort(F.collect_list(F.when(several & (F.col("n") < F.col("total") * 0.05), F.col("label")))).alias("minority"),
        F.array_sort(F.collect_list(F.when(several & (F.col("n") < F.col("total") * 0.01), F.col("label")))).alias("extreme"),
    )


# Bounds and names of the tiers.
TIERS = {
    "flag": [(100, "extreme"), (10, "high"), (5, "moderate")],
    "named": [(100, "Extreme (>100:1)"), (10, "High (10-100:1)"), (5, "Moderate (5-10:1)")],
    "strategy": [(100, "extreme_imbalance"), (10, "high_imbalance"), (3, "moderate_imbalance")],
}
TIER_REST = {"flag": "balanced", "named": "Balanced (≤5:1)", "strategy": "balanced"}
SCARCE = 15

# Training choices that go with a strategy tier.
STRATEGIES = {
    "extreme_imbalance": (False, True, 150, 64, ["vae", "stacked_ae"]),
    "high_imbalance": (True, True, 120, 128, ["flnn", "tabnet", "stacked_ae"]),
    "moderate_imbalance": (True, True, 100, 128, ["flnn", "cnn_attention", "transformer", "tabnet"]),
    "balanced": (False, False, 100, 128, ["transformer", "cnn_attention", "tabnet", "flnn"]),
}


def imbalance_tier(ratio, minority=None, rules="flag"):
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    tiers = TIERS[rules]
    first = ratio > tiers[0][0]
    if rules == "strategy":
        first = first | ((F.col(minority) if isinstance(minority, str) else minority) < SCARCE)
    out = F.when(first, tiers[0][1])
    for bound, name in tiers[1:]:
        out = out.when(ratio > bound, name)
    return out.otherwise(TIER_REST[rules])


def training_strategy(ratio, minority):
    """Strategy struct: name, use_smote, use_class_weights, epochs, batch_size, preferred_models."""
    tier = imbalance_tier(ratio, minority, "strategy")
    fields = ("use_smote", "use_class_weights", "epochs", "batch_size", "preferred_models")
    columns = []
    for i, field in enumerate(fields):
        col = None
        for name, values in STRATEGIES.items():
            col = F.when(tier == name, F.lit(values[i])) if col is None else col.when(tier == name, F.lit(values[i]))
        columns.append(col.alias(field))
    return F.struct(tier.alias("name"), *columns)


def class_cooccurrence(df, classes=(0, 1), by="source", label="label"):
    """Sources that hold both classes i and j. Works on the class set of a source, not on its rows."""
    held = class_counts(df, (by,), label).groupBy(by).agg(F.collect_set("label").alias("held"))
    pairs = held.select(F.explode("held").alias("class_i"), "held").select("class_i", F.explode("held").alias("class_j"))
    return pairs.groupBy("class_i").pivot("class_j", list(classes)).agg(F.count(F.lit(1))).na.fill(0)


def usable_sources(df, exclude=(), by="source", label="label", null_labels="none"):
    """Rows of sources with two or more classes.

    null_labels="none" also drops a source with any unlabelled row; "any_labelled" keeps it.
    """
    counts = class_counts(df, (by,), label)
    ok = counts.groupBy(by).agg(
        F.count("label").alias("n_classes"), F.sum(F.when(F.col("label").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    ).filter(F.col("n_classes") >= 2)
    if null_labels == "none":
        ok = ok.filter(F.col("n_null") == 0)
    if exclude:
        ok = ok.filter(~F.col(by).isin(list(exclude)))
    return df.join(settle(ok.select(by)), by, "left_semi")


def viable_classes(df, min_rows=50, good_rows=100, good_share=0.3, by="source", label="label"):
    counts = settle(class_counts(df, (by,), label))
    per = counts.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("n_sources"))
    return (
        per.withColumns(literals(counts.select(F.countDistinct(by).alias("n_all"))))
        .filter(F.col("n") >= min_rows)
        .select(
            "label", "n", "n_sources",
            F.when((F.col("n") >= good_rows) & (F.col("n_sources") >= F.col("n_all") * good_share), 1)
            .otherwise(0).alias("recommended"),
        )
    )


def profile_sources(df, patterns, content="content", template="template", by="source"):
    """Rows, templates, rows per template, keyword rate and three top templates.

    ``patterns`` maps a category to its phrases; a row counts once for every category it hits.
    """
    from emberlog.functions.text import normalize_label_text

    low = normalize_label_text(content)
    hits = reduce(
        lambda a, b: a + b,
        [
            F.when(reduce(lambda a, b: a | b, [low.contains(p) for p in phrases]), 1).otherwise(0)
            for phrases in patterns.values()
        ],
    )
    # one row per (source, template): the ranking never sees raw logs
    per = settle(df.groupBy(by, template).agg(F.count("*").alias("n"), F.sum(hits).alias("hits")))
    totals = per.groupBy(by).agg(
        F.sum("n").alias("logs"),
        F.count("*").alias("templates"),
        (F.sum("n") / F.count("*")).alias("efficiency"),
        (F.sum("hits") * 100.0 / F.sum("n")).alias("anomaly_rate"),
    )
    top = top_of_group(per, by, [F.col("n").desc(), F.col(template)], 3)
    best = top.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", template, "n"))).alias("top_templates"))
    return attach(totals, best, [by])


def top_of_group(df, by, order, k, salt_buckets=64):
    """k first rows per group: first inside salted parts, then among their survivors."""
    keys = [by] if isinstance(by, str) else list(by)
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(salt_buckets)))
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    survivors = salted.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return (
        survivors.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("rank") <= k)
        .drop("_part")
    )


def template_table(df, content="content", template="template", by="source", order="log_id", n_samples=3):
    """Count, percent and first samples of every template of a source."""
    # Spark keeps n_samples rows of a template in every task before it shuffles them, so a frequent template never
    # gathers its rows; counts go by the digest of the template, whose text travels with the samples
    short = F.unhex(F.md5(template)).alias("_key")
    ordered = Window.partitionBy(by, "_key").orderBy(order)
    first = df.select(by, short, order, content, F.col(template).alias("_text")).withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= n_samples)
    found = F.array_sort(F.collect_list(F.struct("rank", F.col(content).alias("content"), "_text")))
    samples = first.groupBy(by, "_key").agg(found.alias("_found")).select(
        by, "_key", F.get("_found", F.lit(0))["_text"].alias(template), F.transform("_found", lambda s: s["content"]).alias("samples"))
    counts = settle(df.groupBy(by, short).agg(F.count("*").alias("n")))
    totals = settle(counts.groupBy(by).agg(F.sum("n").alias("_total")))  # few: Spark sees it and leaves the counts in place
    out = attach(samples, attach(counts, totals, [by]), [by, "_key"], "inner")
    return out.select(by, template, "n", (F.col("n") * 100.0 / F.col("_total")).alias("percent"), "samples")


def labelling_progress(tpl, by="source", label="label", n="n"):
    """Templates and logs that carry a label, and coverage of both."""
    done = F.col(label).isNotNull()
    return tpl.groupBy(by).agg(
        F.count("*").alias("templates"),
        F.sum(F.when(done, 1).otherwise(0)).alias("templates_labelled"),
        F.sum(n).alias("logs"),
        F.sum(F.when(done, F.col(n)).otherwise(0)).alias("logs_labelled"),
        (F.sum(F.when(done, F.col(n)).otherwise(0)) * 100.0 / F.sum(n)).alias("log_coverage"),
        F.sum(F.when(F.col(label) > 0, F.col(n)).otherwise(0)).alias("logs_anomalous"),
    )


def label_mix(tpl, labels=tuple(range(8)), by="source", label="label", n="n"):
    """Percent of labelled logs per label, one column per label."""
    some = tpl.filter(F.col(label).isNotNull())
    sums = [F.sum(F.when(F.col(label) == k, F.col(n)).otherwise(0)) * 100.0 / F.sum(n) for k in labels]
    return some.groupBy(by).agg(*[s.alias(f"label_{k}") for k, s in zip(labels, sums)])


def completion_stats(df, by="source", label="label"):
    """Logs, labelled, anomalies and rate per source, with a total row from rollup."""
    counts = class_counts(df, (by,), label)
    known = F.col("label") >= 0
    out = counts.rollup(by).agg(
        F.sum("n").alias("logs"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("labelled"),
        F.sum(F.when(F.col("label") > 0, F.col("n")).otherwise(0)).alias("anomalies"),
    )
    return out.select(
        F.coalesce(by, F.lit("TOTAL")).alias(by), "logs", "labelled", "anomalies",
        F.coalesce(F.try_divide(F.col("anomalies") * 100.0, F.col("labelled")), F.lit(0.0)).alias("anomaly_rate"),
    )


def score_summary(preds, cls="predicted_class", name="predicted_class_name", confidence="confidence"):
    """One row: totals, count per class name, rate in percent, mean confidence. Empty input gives zeros."""
    per = preds.groupBy(name).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col(cls) > 0, 1).otherwise(0)).alias("bad"),
        F.sum(confidence).alias("conf"),
        F.count(confidence).alias("n_conf"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return per.agg(
        zero(F.sum("n")).alias("total_logs"),
        F.map_from_entries(
            F.filter(F.array_sort(F.collect_list(F.struct(name, "n"))), lambda s: s[name].isNotNull())
        ).alias("class_distribution"),
        zero(F.sum("bad")).alias("anomaly_count"),
        zero(F.try_divide(F.sum("bad") * 100.0, F.sum("n"))).alias("anomaly_rate"),
        zero(F.try_divide(F.sum("conf"), F.sum("n_conf"))).alias("avg_confidence"),
    )


def prediction_stats(preds, model="model_type", cls="predicted_class"):
    """Count and anomaly rate per model type, and for all rows together."""
    out = preds.rollup(model).agg(
        F.count("*").alias("n"), (F.avg(F.when(F.col(cls) > 0, 1.0).otherwise(0.0))).alias("anomaly_rate")
    )
    return out.withColumn(model, F.coalesce(model, F.lit("ALL")))


def distribution(df, col, limit=None, newest="log_id"):
    """Counts per value, over all rows or the newest ``limit``."""
    if limit:
        df = df.orderBy(F.col(newest).desc()).limit(limit)
    return df.groupBy(col).agg(F.count("*").alias("n"))


def summarize_metrics(df, by, metrics, std="sample"):
    spread = F.stddev_samp if std == "sample" else F.stddev_pop
    return df.groupBy(by).agg(
        F.count("*").alias("n_runs"),
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[spread(m).alias(f"{m}_std") for m in metrics],
    )


def value_frequency(df, col):
    """Value counts with percent of all rows."""
    counts = settle(df.groupBy(col).agg(F.count("*").alias("n")))
    return counts.withColumns(literals(counts.agg(F.sum("n").alias("_all")))).select(col, "n", (F.col("n") * 100.0 / F.col("_all")).alias("percent"))


def metric_pivot(df, metrics, row="model", metric="metric", value="value"):
    return df.groupBy(row).pivot(metric, list(metrics)).agg(F.avg(value))


# Advice codes and the profile figure that triggers them when above zero.
RECOMMENDATIONS = [
    ("extreme_imbalance", "n_extreme", "critical", "SMOTE with careful k; class weights; focal loss"),
    ("rare_classes", "n_rare", "warning", "stratified cross-validation; hierarchical classes; transfer learning"),
    ("missing_classes", "n_missing", "critical", "reduce the classes or make synthetic data"),
]


def recommendations(df, classes=(0, 1), by="source", label="label"):
    """Advice rows whose rule fires; a single balanced row if none does."""
    counts = settle(class_counts(df, (by,), label))
    per_source = counts.groupBy(by).agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.count("*").alias("k"))
    sources = per_source.agg(
        F.count("*").alias("n_all"),
        F.sum(F.when((F.col("k") > 1) & (F.col("hi") > F.col("lo") * 100), 1).otherwise(0)).alias("n_extreme"),
    )
    held = counts.groupBy("label").agg(F.count("*").alias("n_sources"))
    grid = sources.withColumn("label", F.explode(F.array(*[F.lit(c) for c in classes])))
    figures = attach(grid, held, ["label"]).withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
    summary = figures.agg(
        F.max("n_extreme").alias("n_extreme"),
        F.sum(F.when(F.col("n_sources") < F.col("n_all") * 0.3, 1).otherwise(0)).alias("n_rare"),
        F.sum(F.when(F.col("n_sources") == 0, 1).otherwise(0)).alias("n_missing"),
    )
    rules = F.array(*[
        F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), F.col(figure).alias("figure"), F.lit(text).alias("advice"))
        for code, figure, level, text in RECOMMENDATIONS
    ])
    fired = F.filter(rules, lambda r: r["figure"] > 0)
    calm = F.array(F.struct(
        F.lit("balanced").alias("code"), F.lit("info").alias("level"), F.lit(0).cast("long").alias("figure"),
        F.lit("class weights and stratified sampling").alias("advice"),
    ))
    return summary.select(F.explode(F.when(F.size(fired) > 0, fired).otherwise(calm)).alias("r")).select("r.*")


def loso_profile(df, classes=(0, 1), by="source", label="label"):
    """Per held-out source: class counts and ratio over all other sources, as total minus own."""
    counts = settle(class_counts(df, (by,), label))
    totals = counts.groupBy("label").agg(F.sum("n").alias("_all"))
    grid = counts.select(by).distinct().withColumn("label", F.explode(F.array(*[F.lit(c) for c in classes])))
    rest = attach(attach(grid, counts, [by, "label"]), totals, ["label"])
    rest = rest.withColumn("n_train", F.coalesce("_all", F.lit(0)) - F.coalesce("n", F.lit(0)))
    rest = rest.filter(F.col("n_train") > 0)
    return rest.groupBy(by).agg(
        F.sum("n_train").alias("train_rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n_train")))).alias("train_counts"),
        F.when(F.count("*") > 1, F.max("n_train") / F.min("n_train")).alias("train_ratio"),
    )


def health_rollup(df, window="1 hour", ts="ts", value="value"):
    """Count, mean and maximum of a metric per time window."""
    out = df.groupBy(F.window(ts, window).alias("w")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak")
    )
    return out.select(F.col("w.start").alias("window_start"), "n", "mean", "peak")
