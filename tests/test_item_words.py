"""Word scores folded by slices of the items, and tokens that are found once."""

import pytest
from pyspark.sql import functions as F

from emberlog.operators import labelling as L


def folded(rows, alpha=1.0, beta=0.2):
    """The scores item by item, as they are learnt."""
    scores = {}
    for item, text, label, n in sorted((r for r in rows if r[2] is not None and r[1] is not None), key=lambda r: r[0]):
        for word in {w for w in text.split() if len(w) > 2}:
            for (w, l) in [k for k in scores if k[0] == word and k[1] != label]:
                scores[w, l] *= 1 - beta
            scores[word, label] = scores.get((word, label), 0.0) + alpha * n
    return scores


@pytest.mark.parametrize("fold", [1, 9, 500_000])
def test_slices_change_no_score(spark, monkeypatch, fold):
    monkeypatch.setattr(L, "FOLD", fold)
    words = ["disk", "login", "kernel", "port", "ab"]
    rows = [(i * 7 % 41, " ".join(words[j] for j in range(5) if (i >> j) & 1 or i % 3 == j), (i * i) % 4 if i % 5 else None, i % 6 + 1) for i in range(40)]
    rows += [(50, None, 1, 3), (51, "", 2, 3), (52, "ab", 0, 3)]
    items = spark.createDataFrame(rows, "item long, template string, label int, n long").repartition(3)
    want = folded(rows)
    for df in (items, L.with_words(items)):
        got = {(r["word"], r["label"]): r["score"] for r in L.word_scores(df).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_counts_that_are_null_score_null(spark):
    items = spark.createDataFrame([(1, "disk", 0, None), (2, "disk port", 1, 4), (3, "port", 1, None)], "item long, template string, label int, n long")
    got = {(r["word"], r["label"]): r["score"] for r in L.word_scores(items).collect()}
    assert got == {("disk", 0): None, ("disk", 1): 4.0, ("port", 1): 4.0}


def test_no_labelled_item_no_score(spark):
    items = spark.createDataFrame([(1, "disk", None, 2)], "item long, template string, label int, n long")
    assert L.word_scores(items).count() == 0


def test_items_are_made_and_cut_into_words_once(spark, tmp_path):
    from emberlog.checks.base import Views
    from emberlog.checks.labelled import suggestions

    docs = [(i, f"s{i % 2}", f"disk {i} failed\nlogin of user{i} denied", i) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 20, 3)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = suggestions(Views(spark, tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "_words" not in out.columns
    assert out.filter(F.col("suggested").isNull()).count() == 0 and out.agg(F.sum("n")).first()[0] == 40
