"""Pattern hits by blocks against plain sums, and what the labelling chain moves."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import labelling as L
from emberlog.operators import profile as P
from emberlog.plans.labelling import label_source


def test_blocks_add_up(spark, monkeypatch):
    monkeypatch.setattr(L, "HIT_WORDS", 40)  # several blocks
    rng = np.random.default_rng(5)
    items = [(i if i % 9 else None, [f"w{w}" for w in rng.integers(0, 30, rng.integers(0, 8))]) for i in range(60)]
    items += [(7, ["w1", "w2"]), (8, None)]  # an item that comes twice adds up
    scores = [(f"w{w}", k, float(s)) for w in range(25) for k, s in enumerate(rng.integers(0, 4, 3))]
    total = defaultdict(float)
    for w, _, s in scores:
        total[w] += s
    want = defaultdict(float)
    for item, words in items:
        for w in words or []:
            for v, k, s in scores:
                if v == w and total[w] > 0:
                    want[item, k] += s / total[w]
    frame = spark.createDataFrame(items, "item long, _words array<string>")
    table = spark.createDataFrame(scores, "word string, label int, score double")
    for words in (frame, frame.select("item", F.explode("_words").alias("word"))):
        got = {(r["item"], r["label"]): r["score"] for r in L.pattern_hits(words, table).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert L.pattern_hits(frame.filter("item < 0"), table).count() == 0
    unknown = table.filter("word = 'w0'").withColumn("word", F.lit("none"))
    assert L.pattern_hits(frame, unknown).count() == 0


def test_words_do_not_meet_labels_row_by_row(spark):
    frame = spark.createDataFrame([(1, ["disk"])], "item long, _words array<string>")
    plan = L.pattern_hits(frame, spark.createDataFrame([("disk", 3, 1.0)], "word string, label int, score double"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in text and "sum(share" not in text


def test_template_table_keeps_null_templates(spark):
    df = spark.createDataFrame([(1, "s", "t", "c"), (2, "s", None, "d")], "log_id long, source string, template string, content string")
    table = P.template_table(df)
    assert {(r["template"], r["n"], tuple(r["samples"])) for r in table.collect()} == {("t", 1, ("c",)), (None, 1, ("d",))}


def test_chain_labels_logs_and_items(spark):
    rows = [(i, "ab"[i % 2], f"disk failure {i % 4}", None if i == 9 else f"disk failure <{i % 4}>") for i in range(10)]
    logs = spark.createDataFrame(rows, "log_id long, source string, content string, template string")
    library = spark.createDataFrame([("disk", 3, 8.0), ("failure", 3, 8.0)], "word string, label int, score double")
    labelled, items, issues = label_source(logs, library, rest=7)
    assert "_k__key" in labelled._jdf.queryExecution().analyzed().toString()  # by digest, not by text
    got = {r["log_id"]: r["anomaly_label"] for r in labelled.collect()}
    assert got == {i: 3 if i != 9 else got[9] for i in range(10)}
    assert labelled.columns == [*logs.columns, "anomaly_label", "anomaly_label_name"]
    assert items.columns == ["source", "template", "n", "percent", "samples", "item", "suggested", "best", "confidence", "label", "notes"]
    assert {r["notes"] for r in items.filter("template IS NOT NULL").collect()} == {"Auto-labeled (high confidence)"} and items.count() == 5
    assert issues.columns == ["source", "template", "label", "issue"]
