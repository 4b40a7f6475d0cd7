"""Two models Spark ML lacks: an RBF kernel map and Gaussian Bayes with a variance floor.

Both are pipeline stages that are saved and loaded with the pipeline they stand in.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from emberlog.operators.draws import BITS


def _uniform(*ids, seed):
    """The draw of ``draws.uniform`` for one key, in (0, 1)."""
    text = "|".join(map(str, (*ids, seed)))
    return (int(hashlib.md5(text.encode()).hexdigest()[: BITS // 4], 16) + 0.5) / 2**BITS


@cache
def fourier_draws(size, width, seed):
    """(directions, phases): standard normal numbers, size x width, and angles; by digest, so the same everywhere."""
    directions = np.array([[
        np.sqrt(-2 * np.log(_uniform(j, i, seed=seed))) * np.cos(2 * np.pi * _uniform(j, i, seed=seed + 1)) for i in range(width)
    ] for j in range(size)]).reshape(size, width)
    return directions, np.array([2 * np.pi * _uniform(j, seed=seed + 2) for j in range(size)])


class _FourierParams(HasInputCol, HasOutputCol):
    size = Param(Params._dummy(), "size", "number of features of the map", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "scale, auto or a number", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "components of a vector", TypeConverters.toInt)


class RandomFourier(Estimator, _FourierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of the kernel exp(-gamma |x - y|^2): a linear model on them is close to one with that kernel.

    gamma is 1 / (components * variance of all numbers) for ``scale``, 1 / components for ``auto``.
    """

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="mapped", size=256, gamma="scale", seed=42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="mapped", size=256, gamma="scale", seed=42)
        self._set(**{k: str(x) if k == "gamma" else x for k, x in self._input_kwargs.items()})

    def _fit(self, df):
        x = vector_to_array(self.getInputCol()) if dict(df.dtypes)[self.getInputCol()] == "vector" else F.col(self.getInputCol())
        flat = df.select(F.size(x).alias("d"), F.explode(x).alias("v"))
        d, variance = flat.agg(F.max("d"), F.var_pop("v")).first()
        asked, d = self.getOrDefault("gamma"), d or 1
        gamma = 1 / d if asked == "auto" else 1 / (d * (variance or 1.0)) if asked == "scale" else float(asked)
        made = RandomFourierModel()
        made._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), size=self.getOrDefault("size"),
                  seed=self.getOrDefault("seed"), gamma=repr(gamma), width=d)
        return made


class RandomFourierModel(Model, _FourierParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df):
        size, seed, width = (self.getOrDefault(n) for n in ("size", "seed", "width"))
        reach = np.sqrt(2 * float(self.getOrDefault("gamma")))

        @F.pandas_udf("array<double>")
        def mapped(vectors: pd.Series) -> pd.Series:
            directions, phases = fourier_draws(size, width, seed)
            if not len(vectors):
                return pd.Series([], dtype=object)
            m = np.stack(vectors.to_numpy())
            return pd.Series(list(np.sqrt(2 / size) * np.cos(m @ directions.T * reach + phases)))

        return df.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(self.getInputCol()))))


class _BayesParams(HasFeaturesCol, HasLabelCol):
    smoothing = Param(Params._dummy(), "smoothing", "share of the largest variance that is added to all", TypeConverters.toFloat)
    weightCol = Param(Params._dummy(), "weightCol", "weight of a row's class in the prior", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "labels", TypeConverters.toListFloat)
    priors = Param(Params._dummy(), "priors", "log share of each class", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means, class by class", TypeConverters.toListFloat)
    variances = Param(Params._dummy(), "variances", "smoothed variances, class by class", TypeConverters.toListFloat)


class SmoothedBayes(Estimator, _BayesParams, DefaultParamsReadable, DefaultParamsWritable):
    """Gaussian naive Bayes; ``smoothing`` times the largest variance of a feature is added to all variances.

    Fitted from counts, means and central moments per class and feature, which Spark merges
    map-side: what is shuffled and gathered is classes x features, whatever the rows.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", smoothing=1e-9, weightCol=None):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", smoothing=1e-9)
        self._set(**{k: x for k, x in self._input_kwargs.items() if x is not None})

    def _fit(self, df):
        weight = F.col(self.getOrDefault("weightCol")) if self.isDefined("weightCol") else F.lit(1.0)
        rows = df.select(F.col(self.getLabelCol()).cast("double").alias("c"), weight.cast("double").alias("w"),
                         F.posexplode(vector_to_array(self.getFeaturesCol())).alias("i", "x"))
        found = rows.groupBy("c", "i").agg(
            F.count("*").alias("n"), F.sum("w").alias("w"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).orderBy("c", "i").collect()
        classes = sorted({r["c"] for r in found})
        shape = (len(classes), -1)
        n, w, m, v = (np.array([r[k] for r in found], dtype=float).reshape(shape) for k in "nwmv")
        whole = n.sum(0)
        center = (n * m).sum(0) / whole
        largest = ((n * (v + m**2)).sum(0) / whole - center**2).max()
        made = SmoothedBayesModel()
        made._set(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), smoothing=self.getOrDefault("smoothing"), classes=classes,
                  priors=np.log(w[:, 0] / w[:, 0].sum()).tolist(), means=m.ravel().tolist(),
                  variances=(v + self.getOrDefault("smoothing") * largest).ravel().tolist())
        return made


class SmoothedBayesModel(Model, _BayesParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df):
        classes, priors = self.getOrDefault("classes"), self.getOrDefault("priors")
        m, v = (np.array(self.getOrDefault(k)).reshape(len(classes), -1) for k in ("means", "variances"))
        x = vector_to_array(self.getFeaturesCol())

        def joint(c):
            known = F.array(*[F.struct(F.lit(float(a)).alias("m"), F.lit(float(0.5 / b)).alias("k")) for a, b in zip(m[c], v[c])])
            far = F.aggregate(F.zip_with(x, known, lambda y, p: (y - p["m"]) * (y - p["m"]) * p["k"]), F.lit(0.0), lambda s, y: s + y)
            return F.lit(float(priors[c] - 0.5 * np.log(2 * np.pi * v[c]).sum())) - far

        out = df.withColumn("_joint", F.array(*[joint(c) for c in range(len(classes))]))
        top = F.array_max("_joint")
        raised = F.transform("_joint", lambda y: F.exp(y - top))
        total = F.aggregate(raised, F.lit(0.0), lambda s, y: s + y)
        named = F.array(*[F.lit(c) for c in classes])
        return out.withColumns({
            "rawPrediction": array_to_vector("_joint"),
            "probability": array_to_vector(F.transform(raised, lambda y: y / total)),
            "prediction": F.get(named, (F.array_position("_joint", top) - 1).cast("int")),
        }).drop("_joint")
