"""Literal rows for labels, time formats, calendar and text columns."""

import math

import pytest
from pyspark.sql import functions as F

from emberlog.functions import labels as L
from emberlog.functions import text as X
from emberlog.functions.temporal import add_calendar
from emberlog.functions.timestamps import normalize_timestamps

# One written time per format, with the text it stands for.
TIMES = [
    ("android", None, "03-17", None, "16:13:38.907", "2020-03-17 16:13:38.907"),
    ("apache", None, None, None, "Sun Dec 04 04:51:37 2005", "2005-12-04 04:51:37.000"),
    ("bgl", None, "2005.06.05", None, None, "2005-06-05 00:00:00.000"),
    ("hadoop", None, "2015-10-18", None, "18:01:50,588", "2015-10-18 18:01:50.588"),
    ("hdfs", None, "081109", None, "204324", "2008-11-09 20:43:24.000"),
    ("hdfs", None, "81109", None, "4324", "2008-11-09 00:43:24.000"),
    ("healthapp", None, None, None, "20171223-22:15:29:792", "2017-12-23 22:15:29.792"),
    ("hpc", None, None, None, "1145552100", "2006-04-20 16:55:00.000"),
    ("linux", "Jun", "15", None, "02:04:59", "2020-06-15 02:04:59.000"),
    ("mac", "Jul", "1", None, "09:21:57", "2020-07-01 09:21:57.000"),
    ("openssh", None, "Dec", "10", "07:07:38", "2020-12-10 07:07:38.000"),
    ("openstack", None, "2017-05-16", None, "00:00:07.864", "2017-05-16 00:00:07.864"),
    ("proxifier", None, None, None, "10.30 16:49:08", "2020-10-30 16:49:08.000"),
    ("spark", None, "17/06/09", None, "20:10:42", "2017-06-09 20:10:42.000"),
    ("thunderbird", "Nov", None, "9", "12:01:01", "2020-11-09 12:01:01.000"),
    ("thunderbird", None, "2005.11.09", None, None, "2005-11-09 00:00:00.000"),
    ("windows", None, "2016-09-28", None, "04:30:31", "2016-09-28 04:30:31.000"),
    ("zookeeper", None, "2015-07-29", None, "19:14:54,354", "2015-07-29 19:14:54.354"),
]
BAD = [(k, "bad", "bad", "bad", "bad", None) for k in sorted({t[0] for t in TIMES})]
NOTHING = [(k, None, None, None, None, None) for k in sorted({t[0] for t in TIMES})]


def test_time_formats(spark):
    schema = "source_type string, Month string, Date string, Day string, Time string, want string"
    df = spark.createDataFrame(TIMES + BAD + NOTHING + [("other", "Jun", "15", "1", "02:04:59", None)], schema)
    for r in normalize_timestamps(df, default_year=2020).collect():
        assert r["timestamp_normalized"] == r["want"], r


def test_labels(spark):
    df = spark.createDataFrame([(None,), (-1,), (0,), (1,), (6,), (7,), (8,)], "l int")
    rows = df.select(L.binarize_label("l").alias("a"), L.binarize_label("l", "feature").alias("b"), L.label_name("l").alias("n")).collect()
    assert [r["a"] for r in rows] == [0, 0, 0, 1, 1, 1, 1]
    assert [r["b"] for r in rows] == [0, 0, 0, 1, 1, 0, 0]
    assert [r["n"] for r in rows] == ["unlabeled", "unlabeled", "normal", "security_anomaly", "hardware_issue", "unknown_anomaly", "unlabeled"]


def test_source_names(spark):
    names = {"Hadoop_HDFS.csv": "hadoop", "zookeper_1": "zookeeper", "HealthApp_2k": "healthapp", "x": "unknown"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", L.source_type_from_name("n").alias("t")).collect():
        assert r["t"] == names[r["n"]]
    assert spark.createDataFrame([("Apache_2k",)], "n string").select(L.canonical_source("n")).first()[0] == "apache"


def test_calendar_defaults(spark):
    df = spark.sql("SELECT CAST(NULL AS timestamp) AS ts")
    r = add_calendar(df, defaults=True).first()
    assert (r["hour"], r["day_of_week"], r["day_of_month"], r["month"], r["is_business_hours"]) == (12, 3, 15, 6, 1)
    sunday = add_calendar(spark.sql("SELECT TIMESTAMP '2024-01-07 03:00:00' AS ts")).first()
    assert (sunday["day_of_week"], sunday["is_weekend"], sunday["is_night"], sunday["is_weekend_night"]) == (6, 1, 1, 1)


@pytest.mark.parametrize("text", ["", "a", "aa bb aa", "Déjà vu été", "12345", "x\n\ty  z", "ÀÀ b😀😀"])
def test_text_columns_against_python(spark, text):
    r = spark.createDataFrame([(text,)], "content string").select(*[c.alias(n) for n, c in X.text_columns().items()]).first()
    words = text.lower().split()
    assert r["msg_length"] == len(text)
    assert r["msg_word_count"] == len(words)
    assert r["msg_unique_chars"] == len(set(text))
    assert r["repeated_words"] == sum(words.count(w) > 1 for w in set(words))
    assert r["repeated_chars"] == sum(a == b for a, b in zip(text, text[1:]))
    share = [text.count(c) / len(text) for c in set(text)]
    assert r["msg_entropy"] == pytest.approx(-sum(p * math.log2(p) for p in share), abs=1e-9)
    assert r["uppercase_ratio"] == pytest.approx(sum(c.isupper() for c in text) / (len(text) + 1))
    assert r["special_char_ratio"] == pytest.approx(sum(not c.isalnum() and not c.isspace() for c in text) / (len(text) + 1))


def test_masks(spark):
    cases = {
        "from 10.0.0.1 at 12:30:01": ("from <IP> at <TIME>",),
        "id 123e4567-e89b-12d3-a456-426614174000": ("id <UUID>",),
        "on 2024-01-02 wrote /var/log/x.1 as deadbeef01 5": ("on <DATE> wrote <PATH> as <HEX> <NUM>",),
    }
    df = spark.createDataFrame([(c,) for c in cases], "content string")
    for r in df.select("content", X.mask_variables("content").alias("m"), X.mask_variables("content", "reference").alias("o")).collect():
        assert r["m"] == cases[r["content"]][0]
    assert spark.sql("SELECT '10.0.0.1' AS c").select(X.mask_variables("c", "reference")).first()[0] == "<NUM>.<NUM>.<NUM>.<NUM>"


def test_flags_respect_word_edges(spark):
    df = spark.createDataFrame([("Timed out",), ("éfail",), ("disk failed",), ("failing",)], "content string")
    rows = X.add_error_flags(df).collect()
    assert [r["has_timeout"] for r in rows] == [1, 0, 0, 0]
    assert [r["has_failure"] for r in rows] == [0, 0, 1, 0]


def test_source_flags_use_canonical_names(spark):
    df = spark.createDataFrame([("Apache_2k", "error 404"), ("hdfs", "block 7"), ("mac", "error")], "s string, content string")
    rows = X.add_source_flags(df.withColumn("source_type", L.canonical_source("s"))).collect()
    assert (rows[0]["has_error_level"], rows[0]["has_http_error"]) == (1, 1)
    assert rows[1]["has_system_failure"] == 1
    assert rows[2]["has_error_level"] == 0


def test_augmented_text(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.range(400).select(F.col("id").alias("log_id"), F.lit(text).alias("content"), (F.col("id") % 2).cast("int").alias("label"))
    out = X.augment_text(df).collect()
    assert 30 < len(out) < 100 and all(r["log_id"] % 2 == 1 for r in out)
    kinds = set()
    for r in out:
        words = r["content"].split()
        if "<MASK>" in words:
            kinds.add("mask")
            assert len(words) == 10
        elif len(words) == 9:
            kinds.add("drop")
        else:
            kinds.add("swap")
            assert sorted(words) == sorted(text.split()) and r["content"] != text
    assert kinds == {"mask", "drop", "swap"}
    assert sorted(map(tuple, out)) == sorted(map(tuple, X.augment_text(df.repartition(7)).collect()))
