"""Fuzzy matching, nearest neighbours and template mining against brute force."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.durable import shared_root
from emberlog.operators import joins as J
from emberlog.operators import templates as T
from emberlog.operators.embeddings import nearest_prototype
from emberlog.operators.neighbours import knn_join


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def phrases():
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcd "), n)) for n in rng.integers(1, 40, 60)]
    near = []
    for s in base * 4:
        t = list(s)
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, len(t) + 1)
            kind = rng.integers(0, 3)
            if kind == 0:
                t.insert(at, "x")
            elif t and at < len(t):
                t[at:at + 1] = [] if kind == 1 else ["y"]
        near.append("".join(t))
    return sorted(set(base)), sorted({x for x in near if x})


@pytest.mark.parametrize("threshold", [80, 90, 100])
def test_fuzzy_transfer_misses_nothing(spark, phrases, threshold):
    base, near = phrases
    known = spark.createDataFrame([(t, i % 8) for i, t in enumerate(base)], "template string, label int")
    new = spark.createDataFrame([(t, "low") for t in near], "template string, confidence string")
    got = {r["template"]: r for r in J.fuzzy_transfer(new, known, threshold).collect()}
    assert len(got) == len(near)
    for t in near:
        best = min((-(1 - edits(t, b) / max(len(t), len(b))) * 100, b) for b in base)
        if -best[0] >= threshold - 1e-9:
            assert got[t]["match"] == best[1] and got[t]["score"] == pytest.approx(-best[0])
            assert got[t]["confidence"] == "medium"
        else:
            assert got[t]["match"] is None and got[t]["confidence"] == "low"


@pytest.mark.parametrize("pivots,block", [(1, 4096), (7, 16), (20, 5)])
def test_knn_is_exact(spark, pivots, block):
    rng = np.random.default_rng(2)
    m = np.concatenate([rng.normal(0, 0.01, (60, 6)), rng.normal(0, 1, (60, 6))])  # half the rows in one cell
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "log_id long, vec array<double>")
    got = knn_join(df, df, 4, n_pivots=pivots, block=block).toPandas().sort_values(["q_id", "rank"])
    d = np.linalg.norm(m[:, None] - m[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert (got["b_id"].to_numpy().reshape(-1, 4) == want).all()


def test_prototypes_in_blocks(spark, monkeypatch):
    from emberlog.operators import embeddings

    rng = np.random.default_rng(4)
    protos, rows = rng.normal(0, 1, (11, 3)), rng.normal(0, 1, (30, 3))
    p = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(protos)], "label int, prototype array<double>")
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "log_id long, vec array<double>")
    one = nearest_prototype(df, p).toPandas().sort_values("log_id")
    d = np.linalg.norm(rows[:, None] - protos[None], axis=2)
    e = np.exp(-d)
    assert (one["predicted"].to_numpy() == d.argmin(1)).all()
    assert np.allclose(one["proto_probability"], e.max(1) / e.sum(1))
    monkeypatch.setattr(embeddings, "PROTO_BLOCK", 4)
    two = nearest_prototype(df, p).toPandas().sort_values("log_id")
    assert np.allclose(one["proto_probability"], two["proto_probability"])
    monkeypatch.setattr(embeddings, "PROTO_BYTES", 3 * 8 * 5)  # three passes over the rows
    three = nearest_prototype(df, p).toPandas().sort_values("log_id")
    assert list(three.columns) == list(one.columns) and (three["predicted"].to_numpy() == one["predicted"].to_numpy()).all()
    assert np.allclose(one["proto_probability"], three["proto_probability"]) and np.allclose(one["proto_distance"], three["proto_distance"])


LINES = (
    ["connect to node7 port 80 ok", "connect to node8 port 81 ok", "connect to node7 port 99 failed"] * 5
    + ["disk full on volume alpha", "disk full on volume beta", "disk slow on volume beta"] * 3
    + ["", "   ", "single"]
)


def mined(spark, lines, **options):
    df = spark.createDataFrame([(i, "app", l) for i, l in enumerate(lines)], "log_id long, source string, content string")
    rows, templates = T.mine_templates(df, **options)
    return {r["log_id"]: (r["template_id"], r["template"]) for r in rows.collect()}, templates.toPandas()


def test_mined_templates(spark):
    rows, templates = mined(spark, LINES)
    assert rows[LINES.index("")] == (-1, None) and rows[LINES.index("   ")] == (-1, None)
    assert rows[LINES.index("single")][1] == "single"
    assert templates["n"].sum() == len(LINES) - 2
    top = templates[templates["template_id"] == 0].iloc[0]
    assert top["template"] == "connect to node<NUM> port <NUM> <*>" and top["n"] == 15


def test_mining_ignores_row_order(spark, slices):
    first, _ = mined(spark, LINES)
    slices(3)
    order = np.random.default_rng(1).permutation(len(LINES))
    again, _ = mined(spark, [LINES[i] for i in order])
    assert [first[i] for i in order] == [again[j] for j in range(len(LINES))]


def test_rounds_agree_with_whole_leaves(spark):
    rng = np.random.default_rng(8)
    lines = ["go now " + " ".join(rng.choice(["a", "b", "c", "d", "e", "f"], 6)) for _ in range(300)]
    whole, _ = mined(spark, lines)
    T_rows = T.LEAF_ROWS
    rounds, _ = mined(spark, lines, leaf_rows=1)
    assert whole == rounds and T.LEAF_ROWS == T_rows


def test_pairs_for_contrast(spark):
    rows = [(i, "hot" if i % 3 else "b", 1 if i % 50 == 0 else 0, f"t{i % 4}") for i in range(600)]
    df = spark.createDataFrame(rows, "log_id long, source string, label int, content string")
    out = J.contrastive_pairs(df, augment=True).toPandas()
    label = {r[0]: r[2] for r in rows}
    same = out["first"].map(label) == out["second"].map(label)
    assert (same == (out["same"] == 1)).all() and (out["first"] != out["second"]).all()
    assert (out["kind"] == "label").sum() == 600 and (out["kind"] == "other_label").sum() == 600
    assert (out["kind"] == "minority").sum() == 36


def test_salted_lookup_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "LOAD", 10)
    rows = [(i, "s", 1 if i < 3 else 0, "t") for i in range(400)]
    df = spark.createDataFrame(rows, "log_id long, source string, label int, content string")
    out = J.contrastive_pairs(df).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in out if r["kind"] != "template"} == {"label": 400, "other_label": 400}


def test_mining_writes_a_text_few_times(spark):
    """Lines of one cluster, alone in their leaf, and repeated, over two sources: what is settled stays near the text."""
    rng = np.random.default_rng(3)
    draws = ["".join(w) for w in rng.choice(list("abcdefghij"), (4000, 60))]
    lines = [f"w{d[:5]} {d[5:25]} {d[25:45]} {d[45:]}" for d in draws] + [f"go to {d}" for d in draws[:50]] * 2
    rows = [(i, ("a", "b", None)[i % 3], l) for i, l in enumerate(lines)]
    df = spark.createDataFrame(rows, "log_id long, source string, content string")
    before = _settled_bytes(spark)
    got, templates = T.mine_templates(df)
    got = got.collect()
    assert _settled_bytes(spark) - before < 4 * sum(map(len, lines))
    assert templates.agg({"n": "sum"}).first()[0] == len(lines)
    assert {r["template"] for r in got if r["content"].startswith("go")} == {"go to <*>"}
    named = {(t["source"], t["template_id"]): t["template"] for t in templates.collect()}
    assert all(named[r["source"], r["template_id"]] == r["template"] for r in got)


def _settled_bytes(spark):
    root = Path(shared_root(spark).removeprefix("file:"))
    return sum(f.stat().st_size for f in root.rglob("*.parquet"))
