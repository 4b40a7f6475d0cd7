"""Fuzzy transfer by tiles of lengths: against brute force, and without a row for every 3-gram."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import joins as J
from tests.test_matching import edits


def copies(rng, base, times, most):
    out = []
    for s in base * times:
        t = list(s)
        for _ in range(rng.integers(0, most + 1)):
            at = rng.integers(0, len(t) + 1)
            t[at:at + rng.integers(0, 2)] = list("xé€"[rng.integers(0, 3)] * rng.integers(0, 2))
        out.append("".join(t))
    return out


def texts(rng, n, low, high):
    return ["".join(rng.choice(list("abcdefgh "), k)) for k in rng.integers(low, high, n)]


@pytest.mark.parametrize("threshold", [80, 90, 99, 100])
def test_many_tiles_find_what_brute_force_finds(spark, monkeypatch, threshold):
    from emberlog.operators import edits as E

    monkeypatch.setattr(E, "UNIT", (900, 900))
    monkeypatch.setattr(E, "LOT", (700, 700))
    rng = np.random.default_rng(11)
    base = [*texts(rng, 25, 1, 150), "aaaaaaaaaaaaaaaaaaaaaaaa", "", "é€é€é€é€é€é€é€é€"]
    new = sorted({*copies(rng, base, 3, 8), *base[:5], "zzzzzzzzzzzzzzzzzzzz"})
    known = [(t, label) for i, t in enumerate(base) for label in ((None, 3 + i) if i % 3 else (7 - i % 7, 1 - i % 7))]
    left = spark.createDataFrame([*[(t, "low") for t in new], (None, "low")], "template string, confidence string")
    right = spark.createDataFrame([*known, *known, (None, 1)], "template string, label int")
    got = {r["template"]: r for r in J.fuzzy_transfer(left, right, threshold).collect()}
    assert len(got) == len(new) + 1 and got[None]["match"] is None
    labels = {}
    for t, label in known:
        if label is not None:
            labels[t] = min(label, labels.get(t, label))
    for t in new:
        score, match = min((-(1.0 - edits(t, b) / (max(len(t), len(b)) or 1)) * 100, b) for b in base)
        if -score >= threshold - 1e-9:
            assert got[t]["match"] == match and got[t]["score"] == pytest.approx(-score)
            assert got[t]["suggested"] == labels[match] and got[t]["confidence"] == "medium"
        else:
            assert got[t]["match"] is None and got[t]["confidence"] == "low"


def test_distance_against_the_table():
    from emberlog.operators import edits as E

    rng = np.random.default_rng(12)
    base = texts(rng, 12, 1, 400)
    for a in base:
        for b in [*copies(rng, [a], 2, 30), base[0], base[1]]:
            want = edits(a, b)
            for most in (0, want - 1, want, want + 3, 60):
                assert E.distance(a, b, most) == (want if want <= most else None)


def test_no_row_for_every_gram(spark):
    rng = np.random.default_rng(13)
    rows = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts(rng, 200, 100, 200))], "template string, label int")
    out = J.fuzzy_transfer(rows.select("template"), rows, 90)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "Generate" not in plan  # the grams of a text were rows, ranked by a window
    assert out.filter("score = 100 AND match = template").count() == out.select(F.count("*")).first()[0] == 200
