"""Terms below the least document frequency stay out of the shuffle, and no other does."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog.operators import tfidf as X


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"common word{i % 40} rare{i} rare{i} seldom{i // 2}") for i in range(3000)] + [(3000, ""), (3001, None), (3002, "common")]
    return spark.createDataFrame(rows, "log_id long, content string")


def counted(df):
    return {r["term"]: r["df"] for r in df.collect()}


@pytest.mark.parametrize("bits", [6, 12, 20])  # so few cells that every term stays, and so many that few do
def test_same_table(texts, bits):
    plain = X.idf_table(texts, ngrams=(1, 1), min_df=3)
    assert counted(X.idf_table(texts, ngrams=(1, 1), min_df=3, sketch_bits=bits)) == counted(plain)
    assert set(counted(plain)) == {"common", *[f"word{i}" for i in range(40)]}


def test_rare_terms_are_not_shuffled(texts):
    once = texts.select(F.explode(F.array_distinct(X.terms("content", (1, 1)))).alias("term"))
    every = {r["term"] for r in once.distinct().collect()}
    left = Counter(r["term"] for r in X.maybe_frequent(once, 3, 20).collect())
    assert len(every) > 4500 and len(left) <= len(every) / 2
    assert left["common"] == 3001 and all(left[f"word{i}"] == 75 for i in range(40))
    plan = X.maybe_frequent(once, 3, 20)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_no_texts(spark):
    nothing = spark.createDataFrame([], "log_id long, content string")
    assert X.idf_table(nothing, min_df=2, sketch_bits=12).count() == 0
