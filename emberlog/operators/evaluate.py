"""Classification metrics from counts.

Rows are first reduced to (y, p) counts or to one row per distinct score; ranks and
curves are prefix sums over those, so no sort gathers a model's scores in one task.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.operators.ordering import attach, exact_quantiles, running_totals

# The threshold grid and its default, the percentiles of reconstruction error.
GRID = [round(0.10 + 0.01 * i, 2) for i in range(81)]
DEFAULT_THRESHOLD = 0.5
PERCENTILES = [90, 91, 92, 93, 94, 95, 96, 97, 98, 99]


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df, by=(), y="y", p="p", classes=(0, 1)):
    """Counts on a dense grid: rows of y among ``classes``, every predicted class."""
    by = list(by)
    counts = settle(df.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n")))
    every = F.array(*[F.lit(c) for c in classes])
    heads = counts.select(*by).distinct() if by else counts.limit(1).select()
    grid = heads.withColumn("y", F.explode(every)).withColumn("p", F.explode(every))
    out = attach(grid, counts, [*by, "y", "p"])
    return out.select(*by, "y", "p", F.coalesce("n", F.lit(0)).alias("n"))


def class_totals(df, by=(), y="y", p="p"):
    """support, predicted and hits of every class in y or p."""
    counts = df.groupBy(*by, F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("hits")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    tall = counts.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    return tall.groupBy(*by, "cls").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )


def _class_scores(totals):
    return totals.withColumns({
        "precision": _ratio(F.col("hits"), F.col("predicted")),
        "recall": _ratio(F.col("hits"), F.col("support")),
        "f1": _ratio(F.col("hits") * 2.0, F.col("support") + F.col("predicted")),
    })


def per_class(df, by=(), y="y", p="p"):
    """precision, recall, f1, support and frequency of classes with support."""
    by = list(by)
    scored = _class_scores(class_totals(df, by, y, p))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return (
        scored.withColumn("frequency", F.col("support") / F.sum("support").over(group))
        .filter(F.col("support") > 0)
        .select(*by, "cls", "precision", "recall", "f1", "support", "frequency")
    )


def metrics(df, by=(), y="y", p="p"):
    """Accuracy, balanced accuracy, F1 kinds, MCC, geometric mean and IBA per group."""
    scored = _class_scores(class_totals(df, by, y, p))
    true = F.col("support") > 0
    total, hits = F.sum("support"), F.sum("hits")
    pt = F.sum(F.col("predicted").cast("double") * F.col("support"))
    pp = F.sum(F.col("predicted").cast("double") * F.col("predicted"))
    tt = F.sum(F.col("support").cast("double") * F.col("support"))
    n = total.cast("double")
    bal = F.avg(F.when(true, F.col("recall")))
    gmean = F.exp(F.avg(F.when(true, F.ln(F.greatest(F.col("recall"), F.lit(1e-10))))))
    return scored.groupBy(*by).agg(
        total.alias("n_rows"),
        (hits / total).alias("acc"),
        bal.alias("bal_acc"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1_weighted"),
        (hits / total).alias("f1_micro"),
        _ratio(hits * n - pt, F.sqrt((n * n - pp) * (n * n - tt))).alias("mcc"),
        gmean.alias("geometric_mean"),
        ((F.lit(1.0) + F.lit(0.1) * gmean) * bal).alias("iba"),
    )


def sensitivity_gmean(df, by=(), y="y", p="p"):
    """sqrt(sensitivity * specificity) of a binary task with 1e-8 in the denominators; 0 with one class."""
    t, q = F.col(y) == 1, F.col(p) == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = df.groupBy(*by).agg(
        count(t & q).alias("tp"), count(t & ~q).alias("fn"), count(~t & ~q).alias("tn"), count(~t & q).alias("fp")
    )
    value = F.sqrt(F.col("tp") / (F.col("tp") + F.col("fn") + 1e-8) * (F.col("tn") / (F.col("tn") + F.col("fp") + 1e-8)))
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    return out.select(*by, F.when(both, value).otherwise(0.0).alias("g_mean"))


def score_histogram(df, by=(), y="y", score="score"):
    one = F.when(F.col(y) == 1, 1).otherwise(0)
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(one).alias("pos"), F.sum(1 - one).alias("neg")
    )


def auroc(df, by=(), y="y", score="score"):
    """Area under ROC from mid-ranks; null with a single class."""
    by = list(by)
    ranked = running_totals(score_histogram(df, by, y, score), by, ["score"], {"neg_upto": F.col("neg")})
    below = F.col("neg_upto") - F.col("neg") / 2.0
    wins, pos, neg = F.sum(F.col("pos") * below), F.sum("pos"), F.sum("neg")
    return ranked.groupBy(*by).agg(F.try_divide(wins, pos.cast("double") * neg).alias("auroc"))


def pr_points(df, by=(), y="y", score="score"):
    """precision and recall at every distinct score taken as threshold."""
    by = list(by)
    hist = score_histogram(df, by, y, score)
    ranked = running_totals(
        hist, by, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}
    )
    totals = settle(hist.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")))
    if by:
        ranked = attach(ranked, totals, by)
    else:
        ranked = ranked.withColumns({c: F.lit(x) for c, x in totals.first().asDict().items()})
    return ranked.withColumns({
        "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
        "recall": _ratio(F.col("tp"), F.col("all_pos")),
    })


def auprc(df, by=(), y="y", score="score"):
    """Step sum of precision over recall; null with a single class."""
    pts = pr_points(df, by, y, score)
    both = (F.first("all_pos") > 0) & (F.first("all_neg") > 0)
    area = F.sum(F.try_divide("pos", "all_pos") * F.col("precision"))
    return pts.groupBy(*by).agg(F.when(both, area).alias("auprc"))


def pr_optimum(df, by=(), y="y", score="score"):
    """Threshold with the best 2PR/(P+R+1e-8); the lowest one on ties."""
    pts = pr_points(df, by, y, score)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8)
    best = pts.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("neg"))).alias("b"))
    return best.select(*by, (-F.col("b.neg")).alias("optimal_threshold"), F.col("b.f1").alias("optimal_f1"))


def binary_macro_f1(tp, fp, fn, tn):
    """Macro F1 over the classes that occur in truth or prediction."""
    parts = [(2.0 * tp, 2 * tp + fp + fn), (2.0 * tn, 2 * tn + fp + fn)]
    total = sum((_ratio(a, b) for a, b in parts[1:]), _ratio(*parts[0]))
    present = sum((F.when(b > 0, 1).otherwise(0) for _, b in parts[1:]), F.when(parts[0][1] > 0, 1).otherwise(0))
    return _ratio(total, present)


def _sweep(counts, by, n_bins):
    """Counts per bin (number of thresholds a row passes) to tp/fp/fn/tn of every threshold."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    heads = counts.select(*by).distinct() if by else counts.limit(1).select()
    grid = heads.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins))))
    dense = attach(grid, counts, [*by, "bin"]).na.fill(0, ["pos", "neg"])
    passed = group.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = dense.withColumns({
        "tp": F.sum("pos").over(passed), "fp": F.sum("neg").over(passed),
        "_p": F.sum("pos").over(group), "_n": F.sum("neg").over(group),
    })
    out = out.withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")})
    f1 = binary_macro_f1(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return out.filter(F.col("bin") > 0).withColumn("f1_macro", f1).drop("_p", "_n", "pos", "neg")


def threshold_sweep(df, by=(), y="y", score="score"):
    """Macro F1 at each of the 81 grid thresholds; every row is read once."""
    by = list(by)
    grid = F.array(*[F.lit(t) for t in GRID])
    s = F.col(score)
    near = F.greatest(F.lit(0), F.least(F.lit(80), F.round(s * 100 - 10).cast("int")))
    bins = F.when(s >= F.get(grid, near), near + 1).otherwise(near)
    one = F.when(F.col(y) == 1, 1).otherwise(0)
    counts = settle(df.groupBy(*by, bins.alias("bin")).agg(F.sum(one).alias("pos"), F.sum(1 - one).alias("neg")))
    out = _sweep(counts, by, len(GRID))
    return out.withColumn("threshold", F.get(grid, F.col("bin") - 1)).drop("bin")


def tune_threshold(df, by=(), y="y", score="score"):
    """First grid threshold with the highest macro F1; 0.5 if none is above zero."""
    swept = threshold_sweep(df, by, y, score)
    best = swept.groupBy(*by).agg(F.max(F.struct("f1_macro", (-F.col("threshold")).alias("t"))).alias("b"))
    good = F.col("b.f1_macro") > 0
    return best.select(
        *by, F.when(good, -F.col("b.t")).otherwise(DEFAULT_THRESHOLD).alias("threshold"), F.col("b.f1_macro").alias("f1_macro")
    )


def tune_percentile(df, by=(), y="y", error="error", percentiles=tuple(PERCENTILES), cuts=None):
    """Percentile of the error whose value, as a strict bound, has the best macro F1.

    ``cuts`` (by, fraction, quantile) may come from sketches; they are made exactly otherwise.
    """
    by = list(by)
    cuts = settle(exact_quantiles(df, error, [p / 100 for p in percentiles], by) if cuts is None else cuts.select(*by, "fraction", "quantile"))
    arrays = cuts.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fraction", "quantile"))), lambda s: s["quantile"]).alias("cuts")
    )
    if by:
        rows = attach(df, settle(arrays), by)
    else:
        rows = df.withColumn("cuts", F.array(*[F.lit(x) for x in arrays.first()["cuts"]]))
    passed = F.size(F.filter("cuts", lambda t: F.col(error) > t))
    one = F.when(F.col(y) == 1, 1).otherwise(0)
    counts = settle(rows.groupBy(*by, passed.alias("bin")).agg(F.sum(one).alias("pos"), F.sum(1 - one).alias("neg")))
    swept = _sweep(counts, by, len(percentiles))
    swept = swept.withColumn("fraction", F.get(F.array(*[F.lit(p / 100) for p in percentiles]), F.col("bin") - 1))
    swept = attach(swept, cuts, [*by, "fraction"]) if by else swept.join(cuts, "fraction")
    best = swept.groupBy(*by).agg(
        F.max(F.struct("f1_macro", (-F.col("fraction")).alias("f"), F.col("quantile").alias("threshold"))).alias("b")
    )
    return best.select(
        *by, F.round(-F.col("b.f") * 100).cast("int").alias("percentile"), F.col("b.threshold").alias("threshold"),
        F.col("b.f1_macro").alias("f1_macro"),
    )


def compare_models(df, model="model", y="y", p="p", score="score"):
    """One row per model over the same rows, best macro F1 first."""
    out = metrics(df, [model], y, p)
    for part in (auroc(df, [model], y, score), auprc(df, [model], y, score)):
        out = attach(out, part, [model])
    return out.orderBy(F.col("f1_macro").desc(), model)
