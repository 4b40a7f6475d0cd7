"""Classifiers as Spark ML jobs: pipelines, grid search, ensembles, held-out sources."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import HashingTF, IDF, NGram, PCA, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from emberlog.durable import fresh_path, settle
from emberlog.functions.text import normalize_label_text
from emberlog.operators import resample
from emberlog.operators.boosting import boost_bags
from emberlog.operators.evaluate import auroc, metrics, tune_percentile
from emberlog.operators.kernels import RandomFourier, SmoothedBayes
from emberlog.operators.neighbours import knn_classify
from emberlog.operators.sampling import SEED, add_class_weight, balanced_bags, fold_count, kfold, stratified_split, weighted_resample

# The parameter grids. C of the linear models is 1 / regParam; tree depth
# is at most 30 in Spark.
GRIDS = {
    "lr": {"regParam": [10.0, 1.0, 0.1]},
    "rf": {"numTrees": [100, 200], "maxDepth": [10, 20, 30]},
    "gbt": {"maxIter": [100, 200], "stepSize": [0.01, 0.1], "maxDepth": [3, 5]},
    "svc": {"regParam": [1.0, 0.1]},
    "dt": {"maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 5]},
    "svc_rbf": {"regParam": [1.0, 0.1], "gamma": ["scale", "auto"]},
    "nb": {},  # Spark's own Gaussian model takes no smoothing
    "bayes": {"smoothing": [1e-9, 1e-8, 1e-7]},
    "knn": {"k": [5, 7, 9], "weights": ["uniform", "distance"]},
    "mlp": {},
}
FIRST = {
    "lr": {"regParam": 0.1, "maxIter": 100},
    "rf": {"numTrees": 100, "maxDepth": 10},
    "gbt": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3},
    "svc": {"regParam": 0.1, "maxIter": 100},
    "dt": {"maxDepth": 10},
    "svc_rbf": {"regParam": 0.1, "maxIter": 100, "size": 256, "gamma": "scale"},
    "nb": {},
    "bayes": {"smoothing": 1e-9},
    "mlp": {"hidden": [512, 256, 128], "maxIter": 100},
}
UNSCALED = {"rf", "gbt", "dt", "balanced_bagging", "balanced_rf", "easy_ensemble"}
NO_WEIGHT = {"mlp", "knn"}
# Members of the balanced ensembles and the model in each. Bagging takes boosted trees, the
# forest single trees on drawn features, the easy ensemble AdaBoost of stumps.
BALANCED = {"balanced_bagging": ("gbt", 50, {}), "balanced_rf": ("rf", 100, {"numTrees": 1, "featureSubsetStrategy": "sqrt"}),
            "easy_ensemble": ("stumps", 50, {"maxIter": 50})}


def _estimator(name, params, weighted, width):
    p = dict(FIRST[name]) | dict(params or {})
    common = {"featuresCol": "features", "labelCol": "label"}
    if weighted:
        common["weightCol"] = "weight"
    if name == "mlp":
        hidden = p.pop("hidden")
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[width, *hidden, 2], seed=SEED, **p)
    if name == "svc_rbf":
        kernel = RandomFourier(size=p.pop("size"), gamma=p.pop("gamma"), seed=p.pop("seed", SEED))
        return Pipeline(stages=[kernel, LinearSVC(**common | {"featuresCol": "mapped"}, **p)])
    if name == "bayes":
        return SmoothedBayes(**common, **p)
    if name == "nb":
        return NaiveBayes(modelType="gaussian", **common, **p)
    kinds = {"lr": LogisticRegression, "rf": RandomForestClassifier, "gbt": GBTClassifier, "svc": LinearSVC, "dt": DecisionTreeClassifier}
    if name in ("rf", "gbt", "dt"):
        p.setdefault("seed", SEED)
    return kinds[name](**common, **p)


def feature_stage(name):
    """Trees work on raw features, the others on scaled ones."""
    if name in UNSCALED:
        return VectorAssembler(inputCols=["raw"], outputCol="features")
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)


def build_pipeline(name, params=None, weighted=False, width=0):
    return Pipeline(stages=[feature_stage(name), _estimator(name, params, weighted, width)])


def prepare(df, vec="vec"):
    """Add the vector column ``raw`` from an array column."""
    return df.withColumn("raw", array_to_vector(F.transform(F.col(vec), lambda x: x.cast("double"))))


def class_sizes(df, label="label"):
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}


def sampler_for(sizes):
    """Resampler the imbalance asks for, and its neighbour count."""
    if len(sizes) < 2:
        return None, 0
    low, high = min(sizes.values()), max(sizes.values())
    k = max(1, min(5, low - 1))
    if high / low < 3:
        return None, k
    return ("adasyn" if high / low > 100 else "borderline" if high / low > 10 else "smote"), k


def resampled(df, sampler, k, key="log_id", label="label", vec="vec"):
    """Training rows with synthetic minority rows added."""
    make = {"smote": resample.smote, "borderline": resample.borderline_smote, "adasyn": resample.adasyn}[sampler]
    extra = make(df, k=k, vec=vec, key=key, label=label).select(label, vec)
    own = df.select(label, F.transform(F.col(vec), lambda x: x.cast("double")).alias(vec))
    return settle(own.unionByName(extra))


def training_rows(df, name, sampler="auto", vec="vec", key="log_id", label="label"):
    """What a model of this kind is fitted on: (feature stage, rows with ``features``, weighted, width).

    The scaler is fitted on the real rows; neighbours for synthetic rows are searched among
    scaled rows. Class weights are used only without a sampler; the multi-layer model, which
    takes none, gets rows drawn in inverse proportion to their class instead.
    """
    rows = df.select(key, F.col(label).alias("label"), vec).filter(F.col("label").isNotNull())
    k = 5
    if sampler == "auto":
        sampler, k = sampler_for(class_sizes(rows))
    if sampler is None and name in NO_WEIGHT:
        rows = weighted_resample(rows, SEED, "label", key)
    scaler = feature_stage(name)
    prepared = prepare(rows, vec)
    scaler = scaler.fit(prepared) if hasattr(scaler, "fit") else scaler
    ready = scaler.transform(prepared)
    if sampler:
        flat = ready.select(key, "label", vector_to_array("features").alias(vec))
        made = resampled(flat, sampler, k, key, "label", vec)
        ready = made.select("label", array_to_vector(vec).alias("features"))
    weighted = sampler is None and name not in NO_WEIGHT
    if weighted:
        ready = add_class_weight(ready)
    return scaler, ready, weighted, len(df.select(vec).first()[0])


def fit_on(rows, name, params=None):
    """Fit one parameter set on the outcome of ``training_rows``."""
    scaler, ready, weighted, width = rows
    if name == "knn":
        return Neighbours(scaler, ready, **{"k": 5, "weights": "uniform"} | dict(params or {}))
    return PipelineModel([scaler, _estimator(name, params, weighted, width).fit(ready)])


def train(df, name, params=None, sampler="auto", vec="vec", key="log_id", label="label"):
    """Fit a model on (key, label, vec) rows: scaler, then sampler, then classifier."""
    if name in BALANCED:
        return train_balanced(df, name, params, vec=vec, key=key, label=label)
    return fit_on(training_rows(df, name, sampler, vec, key, label), name, params)


class Neighbours:
    """Votes of the nearest training rows, which are kept as a table; probabilities are shares of the vote."""

    def __init__(self, scaler, ready, k, weights):
        self.scaler, self.k, self.weights = scaler, k, weights
        self.train = settle(ready.select(vector_to_array("features").alias("_vec"), F.col("label").alias("_label"), F.monotonically_increasing_id().alias("_row")))

    def transform(self, df):
        rows = settle(self.scaler.transform(df).withColumn("_row", F.monotonically_increasing_id()).withColumn(
            "_vec", vector_to_array("features")).drop("features"))
        votes = knn_classify(self.train, rows.select("_row", "_vec"), self.k, self.weights, "_vec", "_row", "_label", exclude_self=False)
        near = votes.select(F.col("_row").alias("_voted"), F.col("prediction").alias("_class"), "share")
        one = F.when(F.col("_class") == 1, F.col("share")).otherwise(1 - F.col("share"))
        return rows.join(near, F.col("_row") == F.col("_voted"), "left").withColumns({
            "prediction": F.col("_class").cast("double"), "probability": array_to_vector(F.array(1 - one, one)),
        }).drop("_row", "_vec", "_voted", "_class", "share")


class BalancedEnsemble:
    """Mean probability of models fitted on balanced bags."""

    def __init__(self, models):
        self.models = models

    def transform(self, df):
        out = df
        for i, m in enumerate(self.models):
            scored = m.transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1])
            out = scored.drop("features", "rawPrediction", "probability", "prediction")
        names = [f"_p{i}" for i in range(len(self.models))]
        p = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
        return out.withColumn("_p", p).withColumns({
            "probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))),
            "prediction": F.when(F.col("_p") > 0.5, 1.0).otherwise(0.0),
        }).drop("_p", *names)


def train_balanced(df, name, params=None, members=None, vec="vec", key="log_id", label="label"):
    """One model per bag that under-samples the larger classes."""
    base, default, own = BALANCED[name]
    members = members or (params or {}).get("members", default)
    rest = own | {k: x for k, x in (params or {}).items() if k != "members"}
    made = balanced_bags(df.select(key, F.col(label).alias("label"), vec).filter(F.col("label").isNotNull()), members, SEED, "label", key)
    path = fresh_path(df.sparkSession, "bags")
    made.write.partitionBy("bag").parquet(path)  # a fit reads the files of its own bag
    bags = df.sparkSession.read.schema(made.schema).parquet(path)

    if base == "stumps":
        return boost_bags(bags, members, rest["maxIter"], vec=vec)[0]

    def fit(i):
        return build_pipeline(base, rest | {"seed": SEED + i}).fit(prepare(bags.filter(F.col("bag") == i), vec))

    with ThreadPoolExecutor(4) as pool:
        return BalancedEnsemble(list(pool.map(fit, range(members))))


def predict(model, df, vec="vec"):
    """p (class) and score (probability or margin) per row."""
    out = model.transform(prepare(df, vec))
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    else:
        score = vector_to_array("rawPrediction")[1]
    return out.select(*df.columns, F.col("prediction").cast("int").alias("p"), score.alias("score"))


def grid_search(df, name, grid=None, k=None, sampler="auto", vec="vec", key="log_id", label="label"):
    """Best parameters by mean macro F1 over stratified folds, then a fit on all rows.

    Rows are resampled inside the training part of a fold and never reach its test part.
    """
    grid = GRIDS[name] if grid is None else grid
    folds = settle(kfold(df, k, SEED, label, key))
    n_folds = k or fold_count(df, 3, label)
    options = [dict(zip(grid, values)) for values in product(*grid.values())]

    def fold_scores(i):
        """Scores of all options on one fold, whose training rows are resampled once."""
        rest, held = folds.filter(F.col("fold") != i).drop("fold"), folds.filter(F.col("fold") == i).drop("fold")
        rows = None if name in BALANCED else training_rows(rest, name, sampler, vec, key, label)
        out = []
        for params in options:
            model = train(rest, name, params, sampler, vec, key, label) if rows is None else fit_on(rows, name, params)
            out.append(metrics(predict(model, held, vec).withColumnRenamed(label, "y")).first()["f1_macro"])
        return out

    with ThreadPoolExecutor(4) as pool:
        scores = list(pool.map(fold_scores, range(n_folds)))
    means = [sum(s[j] for s in scores) / n_folds for j in range(len(options))]
    best = max(range(len(options)), key=lambda j: means[j])
    table = df.sparkSession.createDataFrame(
        [(name, str(o), float(m), j == best) for j, (o, m) in enumerate(zip(options, means))],
        "model string, params string, f1_macro double, best boolean",
    )
    return train(df, name, options[best], sampler, vec, key, label), table


def run_loso(df, names, params=None, sampler="auto", vec="vec", key="log_id", label="label", by="source", threads=4):
    """Every model on every held-out source: (source, model, figures, best of its source), all on one table.

    Rows are resampled inside the training side. ``final_model`` fits the winner on all sources.
    """
    path = fresh_path(df.sparkSession, "loso")
    rows = df.select(key, F.col(label).cast("int").alias("label"), vec, F.col(by)).filter(F.col(label).isNotNull())
    rows.write.partitionBy(by).parquet(path)  # a split reads the files of its sides
    table = df.sparkSession.read.schema(rows.schema).parquet(path)
    usable = [r[by] for r in table.groupBy(by).agg(F.countDistinct("label").alias("c")).filter("c > 1").orderBy(by).collect()]

    def one(job):
        source, name = job
        rest, held = table.filter(F.col(by) != source), table.filter(F.col(by) == source)
        model = train(rest, name, (params or {}).get(name), sampler, vec, key, "label")
        out = settle(predict(model, held, vec).withColumnRenamed("label", "y"))
        m, a = metrics(out).first(), auroc(out).first()
        return (source, name, m["n_rows"], m["f1_macro"], m["bal_acc"], m["mcc"], a["auroc"])

    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(one, [(s, n) for s in usable for n in names]))
    top = {}
    for r in rows:
        top[r[0]] = max(top.get(r[0], (-1.0, "")), (r[3], r[1]))
    return df.sparkSession.createDataFrame(
        [(*r, top[r[0]] == (r[3], r[1])) for r in rows],
        f"{by} string, model string, test_rows long, f1 double, bal_acc double, mcc double, auroc double, best boolean",
    )


def final_model(df, figures, params=None, sampler="auto", vec="vec", key="log_id", label="label"):
    """(name, model) of the model that wins most held-out sources, ties by mean F1, fitted on all rows."""
    name = figures.groupBy("model").agg(F.sum(F.col("best").cast("int")).alias("wins"), F.avg("f1").alias("f1")).orderBy(
        F.desc("wins"), F.desc("f1"), "model").first()["model"]
    return name, train(df, name, (params or {}).get(name), sampler, vec, key, label)


def reconstruction_error(train_rows, rows, k=10, vec="vec", label="label"):
    """PCA on normal rows; the error is the squared distance of a row to its projection."""
    normal = prepare(train_rows.filter(F.col(label) == 0), vec)
    center = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=False)
    model = Pipeline(stages=[center, PCA(k=k, inputCol="features", outputCol="parts")]).fit(normal)
    square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)
    out = model.transform(prepare(rows, vec))
    return out.withColumn("error", F.greatest(square("features") - square("parts"), F.lit(0.0))).drop("raw", "features", "parts")


def detect_by_error(train_rows, rows, k=10, vec="vec", label="label"):
    """Error detector with its bound tuned on the training rows."""
    bound = tune_percentile(reconstruction_error(train_rows, train_rows, k, vec, label), y=label).first()["threshold"]
    out = reconstruction_error(train_rows, rows, k, vec, label)
    return out.withColumn("p", F.when(F.col("error") > F.lit(bound), 1).otherwise(0))


def text_pipeline(width=1 << 18, min_df=2, content="text"):
    """1-3 gram TF-IDF over hashed terms and a weighted logistic model; no vocabulary is gathered."""
    tokens = RegexTokenizer(inputCol=content, outputCol="w1", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)
    stages = [tokens]
    for n in (2, 3):
        stages.append(NGram(n=n, inputCol="w1", outputCol=f"w{n}"))
    stages.append(_Joined())
    stages.append(HashingTF(inputCol="grams", outputCol="tf", numFeatures=width))
    stages.append(IDF(inputCol="tf", outputCol="features", minDocFreq=min_df))
    stages.append(LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=200, regParam=0.01))
    return Pipeline(stages=stages)


def _Joined():
    from pyspark.ml.feature import SQLTransformer

    return SQLTransformer(statement="SELECT *, concat(w1, w2, w3) AS grams FROM __THIS__")


def train_text(df, content="content", template=None, label="label", min_texts=2, **options):
    """Text classifier on labelled rows; an error below ``min_texts`` of them."""
    known = df.filter(F.col(label) >= 0)
    text = normalize_label_text(content)
    if template:
        text = F.concat_ws(" ", normalize_label_text(template), text)
    rows = known.select(F.col(label).cast("int").alias("label"), text.alias("text"))
    if rows.limit(min_texts).count() < min_texts:
        raise ValueError(f"a text classifier needs {min_texts} labelled rows")
    stages = text_pipeline(**options).getStages()
    at = next(i for i, stage in enumerate(stages) if isinstance(stage, IDF))
    # each fit below reads all rows, more than once; texts are cut into terms for the first only
    terms = PipelineModel(stages[:at]).transform(add_class_weight(rows)).select("label", "weight", "tf")
    # every iteration sends a gradient as wide as the terms per partition: as many as the cores need, however many files there are
    rows = settle(terms, packed=True).coalesce(2 * terms.sparkSession.sparkContext.defaultParallelism)
    fitted = Pipeline(stages=stages[at:]).fit(rows)
    return PipelineModel([*stages[:at], *fitted.stages])


def score_text(model, df, content="content", template=None):
    text = normalize_label_text(content)
    if template:
        text = F.concat_ws(" ", normalize_label_text(template), text)
    keep = df.columns
    out = model.transform(df.withColumn("text", text))
    return out.select(*keep, F.col("prediction").cast("int").alias("p"), vector_to_array("probability").alias("probabilities"))


def adapt_and_score(df, support=0.3, vec="vec", key="log_id", label="label"):
    """Fit on a stratified share of a source's own rows, score the rest."""
    parts = settle(stratified_split(df, support, SEED, label, key))
    model = train(parts.filter("part = 'train'"), "lr", None, None, vec, key, label)
    return predict(model, parts.filter("part = 'test'").drop("part"), vec)


_SCORERS = {}


def register_scorer(name, fn):
    """Name a vectorised scorer: takes a 2-D numpy array, returns one probability per row."""
    _SCORERS[name] = fn


def score_with(df, name, vec="vec", out="score"):
    """Run a registered scorer over Arrow batches of an array column."""
    fn = _SCORERS[name]

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(fn(np.stack([np.asarray(v, dtype=np.float64) for v in values])), dtype=np.float64))

    return df.withColumn(out, run(F.col(vec)))
