"""Weights and document frequencies by blocks: any block size, repeated and null keys, and no term is shuffled."""

import math
from collections import Counter, defaultdict

import pytest

from emberlog.operators import ngrams as G
from emberlog.operators import tfidf as X

ROWS = [(1, "disk disk full now"), (1, "disk full"), (2, "Disk FULL again"), (None, "full now"), (None, "again now"), (3, None), (4, ""),
        *[(10 + i, f"unit{i % 3} disk full unit{i % 2}") for i in range(20)]]


def grams(text):
    words = [w for w in (text or "").lower().split() if len(w) > 1]
    return [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_against_counting(spark, monkeypatch, block):
    monkeypatch.setattr(G, "BLOCK_WORDS", block)
    df = spark.createDataFrame(ROWS, "log_id long, content string")
    freq = Counter(t for _, text in ROWS for t in set(grams(text)))
    assert {(r["term"], r["df"]) for r in X.idf_table(df, min_df=2).collect()} == {x for x in freq.items() if x[1] > 1}
    tf = defaultdict(Counter)
    for key, text in ROWS:
        tf[key].update(t for t in grams(text) if freq[t] > 1)
    want = {}
    for key, terms in tf.items():
        w = {t: k * (math.log((1 + len(ROWS)) / (1 + freq[t])) + 1) for t, k in terms.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(key, t): x / norm for t, x in w.items()}
    got = [((r["log_id"], r["term"]), r["weight"]) for r in X.tfidf(df, min_df=2).collect()]
    assert len(got) == len(want) and dict(got) == pytest.approx(want)


def test_terms_are_not_shuffled(spark):
    df = spark.createDataFrame(ROWS, "log_id long, content string")
    for made in (X.idf_table(df, min_df=2), X.tfidf(df, min_df=2)):
        assert "hashpartitioning(term" not in made._jdf.queryExecution().executedPlan().toString()
