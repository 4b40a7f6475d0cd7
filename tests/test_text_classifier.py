"""The text classifier: one pass over the texts, the model of the whole pipeline."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from emberlog.functions.text import normalize_label_text
from emberlog.operators import models as M
from emberlog.operators.sampling import add_class_weight


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, f"disk {i} failed on node{i % 4} again" if i % 3 == 0 else f"login of user{i % 5} accepted", int(i % 3 == 0)) for i in range(60)]
    return spark.createDataFrame([*made, (60, "", 0), (61, "no label here", -1), (62, None, 1)], "log_id long, content string, label int")


def test_texts_are_read_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    known = rows.filter("content IS NOT NULL")
    M.train_text(known.withColumn("content", counted.asNondeterministic()("content")), width=1 << 10)
    assert seen.value <= 62


def test_model_is_that_of_the_pipeline(rows):
    known = rows.filter("content IS NOT NULL")
    model = M.train_text(known, width=1 << 10)
    texts = known.filter("label >= 0").select("label", normalize_label_text("content").alias("text"))
    whole = M.text_pipeline(width=1 << 10).fit(add_class_weight(texts))
    one = F.get(vector_to_array("probability"), F.lit(1)).alias("one")
    want = {r["text"]: r["one"] for r in whole.transform(texts).select("text", one).collect()}
    got = M.score_text(model, known).select(normalize_label_text("content").alias("text"), "label", F.get("probabilities", F.lit(1)).alias("one")).collect()
    assert len(got) == 62 and {r["text"] for r in got} > {""}
    assert all(r["one"] == pytest.approx(want[r["text"]], rel=1e-6) for r in got if r["label"] >= 0)


def test_gradients_do_not_grow_with_the_files(spark, rows, monkeypatch):
    seen, fit = [], M.Pipeline.fit

    def kept(self, df, *args):
        seen.append(df.rdd.getNumPartitions())
        return fit(self, df, *args)

    monkeypatch.setattr(M.Pipeline, "fit", kept)
    monkeypatch.setattr(M, "settle", lambda df, **kw: df.repartition(60))
    M.train_text(rows.filter("content IS NOT NULL"), width=1 << 10)
    assert seen == [2 * spark.sparkContext.defaultParallelism]
