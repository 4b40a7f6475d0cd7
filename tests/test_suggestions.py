"""Label suggestion from word scores with idf, cosine and classifier evidence."""

import pytest

from emberlog.operators import labelling as L


@pytest.fixture(scope="module")
def tables(spark):
    templates = spark.createDataFrame(
        [(1, "disk failure reported"), (2, "login accepted"), (3, "zebra quagga")], "item long, template string")
    scores = spark.createDataFrame(
        [("disk", 3, 2.0), ("disk", 1, 2.0), ("failure", 3, 4.0), ("login", 0, 1.0), ("login", 2, 1.0), ("nothing", 4, 0.0)],
        "word string, label int, score double")
    return templates, scores


def by_item(df):
    return {r["item"]: r for r in df.collect()}


def test_words_alone(tables):
    got = by_item(L.suggest_labels(*tables))
    assert got[1].suggested == 3 and got[3].suggested == 0 and got[3].best == 0.0 and got[3].confidence == "low"
    # a tie goes to the lower label; the lift is 1.1 for each of the item's own words
    assert got[2].suggested == 0 and got[2].best == pytest.approx(0.5 * 1.1**2)
    assert got[1].best == pytest.approx(1.5 * 1.1**3)


def test_idf_weighs_the_words(spark, tables):
    idf = spark.createDataFrame([("disk", 3.0), ("unknown", 9.0)], "term string, idf double")
    got = by_item(L.suggest_labels(*tables, idf=idf))
    assert got[1].best == pytest.approx((0.5 * 3.0 + 1.0) * 1.1**3)  # words without an idf weigh 1
    assert got[2].best == pytest.approx(0.5 * 1.1**2)


def test_cosines_help_where_words_say_little(spark, tables):
    cosines = spark.createDataFrame(
        [(1, 5, 0.9), (2, 2, 0.8), (2, 7, 0.5), (3, 6, 0.6), (3, 4, -0.5)], "item long, label int, cosine double")
    got = by_item(L.suggest_labels(*tables, cosines=cosines))
    base = 0.5 * 1.1**2
    assert got[1].suggested == 3 and got[1].best == pytest.approx(1.5 * 1.1**3)  # strong words: no cosine counts
    assert got[2].suggested == 2 and got[2].best == pytest.approx(base + 0.75 * 0.8)  # weak words: three quarters
    assert got[3].suggested == 6 and got[3].best == pytest.approx(0.6)  # no words: the whole cosine


def test_probabilities_and_all_evidence(spark, tables):
    probabilities = spark.createDataFrame([(1, 1, 0.9), (3, 0, 0.7), (3, 6, 0.3)], "item long, label int, probability double")
    got = by_item(L.suggest_labels(*tables, probabilities=probabilities))
    assert got[1].suggested == 3 and got[3].suggested == 0 and got[3].best == pytest.approx(1.25 * 0.7)
    cosines = spark.createDataFrame([(3, 6, 0.6)], "item long, label int, cosine double")
    both = by_item(L.suggest_labels(*tables, cosines=cosines, probabilities=probabilities))
    assert both[3].suggested == 6 and both[3].best == pytest.approx(0.6 + 1.25 * 0.3)
    margin = both[3].best - 1.25 * 0.7
    assert margin == pytest.approx(0.1) and both[3].confidence == "low"
