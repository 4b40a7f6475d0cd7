"""AdaBoost of stumps on many balanced bags at once.

All bags go through a round together: one aggregation sums the weights of both classes by bag,
feature and bin, map-side, so what is shuffled and gathered is bags x features x bins whatever
the rows. The best stump of each bag is chosen from these sums. Weights have a closed form,
exp of the summed alphas of the stumps that missed the row, and are an expression on the row:
no round writes them, and plans don't grow with the rounds.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from emberlog.durable import settle

BINS = 32
STUMP = "array<array<struct<f:int,t:double,l:int,r:int,a:double>>>"
LEAST_ERROR = 1e-10


def cut_points(rows, x, bins=BINS):
    """At most ``bins - 1`` cuts of every feature: quantiles of its values, the largest value left out."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = rows.select(F.posexplode(x).alias("f", "v")).groupBy("f").agg(
        F.percentile_approx("v", shares, 10_000).alias("cuts"), F.max("v").alias("top")).orderBy("f").collect()
    return [sorted({c for c in r["cuts"] if c < r["top"]}) for r in found]  # features x bins numbers


def best_stumps(sums, cuts):
    """Per bag the stump of least weighted error: (feature, cut, left class, right class, error).

    ``sums``: bags x features x bins x classes. Ties go to the lower feature, cut and left class 0.
    """
    below = sums.cumsum(2)[:, :, :-1]
    whole = sums.sum((2,), keepdims=True)
    total = sums[:, :1].sum((1, 2, 3))
    wrong = np.stack([below[..., 1] + (whole - below)[..., 0], below[..., 0] + (whole - below)[..., 1]], -1)  # left is 0, left is 1
    for f, c in enumerate(cuts):
        wrong[:, f, len(c) :] = np.inf
    out = []
    for bag, errors in enumerate(wrong):
        if not np.isfinite(errors).any():  # no feature has two values: the larger class for all rows
            heavy = int(whole[bag, 0, 0, 1] > whole[bag, 0, 0, 0])
            out.append((0, 0.0, heavy, heavy, float(whole[bag, 0, 0, 1 - heavy] / total[bag]) if total[bag] else 0.5))
        else:
            f, b, left = np.unravel_index(np.argmin(errors), errors.shape)
            out.append((int(f), float(cuts[f][b]), int(left), 1 - int(left), float(errors[f, b, left] / total[bag])))
    return out


def _votes(x, stumps, of):
    """Sum over the stumps of ``of(alpha, class the stump says)``; ``stumps`` is an array column."""
    said = lambda s: F.when(F.get(x, s["f"]) <= s["t"], s["l"]).otherwise(s["r"])
    return F.aggregate(stumps, F.lit(0.0), lambda total, s: total + of(s["a"], said(s)))


def literal_stumps(members):
    """The stumps of all members as one constant column."""
    return F.from_json(F.lit(json.dumps([[dict(zip("ftlra", s)) for s in m] for m in members])), STUMP)


def boost_bags(bags, members, rounds=50, label="label", vec="vec"):
    """(``BoostedBags``, errors by round and bag) from rows with ``bag`` (0 to members - 1), label 0 or 1 and vector."""
    x = F.transform(F.col(vec), lambda v: v.cast("double"))
    rows = settle(bags.select("bag", F.col(label).cast("int").alias("y"), x.alias("x")))
    cuts = cut_points(rows, F.col("x"))
    edges = F.from_json(F.lit(json.dumps(cuts)), "array<array<double>>")
    binned = settle(rows.select("bag", "y", "x", F.transform("x", lambda v, i: F.size(F.filter(F.get(edges, i), lambda c: c < v))).alias("bins")))
    made, errors, open_ = [[] for _ in range(members)], [], set(range(members))
    width = max(map(len, cuts), default=0) + 1
    for _ in range(rounds):
        missed = _votes(F.col("x"), F.get(literal_stumps(made), F.col("bag")), lambda a, c: F.when(c != F.col("y"), a).otherwise(0.0))
        found = binned.withColumn("w", F.exp(missed)).select("bag", "y", "w", F.posexplode("bins").alias("f", "bin")).groupBy(
            "bag", "f", "bin", "y").agg(F.sum("w").alias("w")).collect()
        sums = np.zeros((members, len(cuts), width, 2))
        for r in found:
            sums[r["bag"], r["f"], r["bin"], r["y"]] = r["w"]
        told = [0.0] * members
        for bag, (f, t, l, r, error) in enumerate(best_stumps(sums, cuts)):
            told[bag] = error
            if bag not in open_:
                continue
            if error >= 0.5:  # no better than a coin: the member is done
                open_.discard(bag)
                continue
            alpha = float(np.log((1 - max(error, LEAST_ERROR)) / max(error, LEAST_ERROR)))
            made[bag].append((f, t, l, r, alpha))
            if error <= LEAST_ERROR:
                open_.discard(bag)
        errors.append(told)
        if not open_:
            break
    return BoostedBags(made), errors


class BoostedBags:
    """Mean of the members' probabilities; all members are scored by one expression."""

    def __init__(self, members):
        self.members = members

    def transform(self, df):
        x = vector_to_array("raw")
        one = lambda stumps: 1 / (1 + F.exp(-_votes(x, stumps, lambda a, c: a * (2 * c - 1))))
        p = F.aggregate(literal_stumps(self.members), F.lit(0.0), lambda total, m: total + one(m)) / len(self.members)
        return df.withColumn("_p", p).withColumns({
            "probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))),
            "prediction": F.when(F.col("_p") > 0.5, 1.0).otherwise(0.0),
        }).drop("_p")
