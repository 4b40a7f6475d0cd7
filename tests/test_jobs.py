"""Streams over several batches, plans, sources and sinks."""

import io
from contextlib import redirect_stdout
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.checks.base import Views
from emberlog.functions import labels as L
from emberlog.functions import text as X
from emberlog.functions.timestamps import normalize_timestamps
from emberlog.operators import joins as JN
from emberlog.operators import sampling as SMP
from emberlog.operators import topk as TOP
from emberlog.operators import windows as W
from emberlog.sources import readers, writers
from emberlog.streaming import jobs as J

SF = "/root/testdata/sf0.001"
SCHEMA = "log_id long, source string, ts timestamp, label int"
START = datetime(2024, 1, 1)


def files(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def row(i, minutes, source="a", label=0):
    return (i, source, START + timedelta(minutes=minutes), label)


def test_history_crosses_batches(spark, tmp_path):
    batches = [[row(i, i * 2, "hot" if i % 3 else "b") for i in range(a, a + 20)] for a in (0, 20, 40)]
    stream = files(spark, tmp_path, batches)
    got = J.stream_history(stream, lambda w: {"gap": W._gap(w, "ts")}, tail=5)
    want = W.add_time_gap(spark.createDataFrame(sum(batches, []), SCHEMA))
    pairs = lambda df, c: sorted((r["log_id"], r[c]) for r in df.collect())
    assert pairs(got, "gap") == pairs(want, "time_diff_seconds")


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    stream = files(spark, tmp_path, [[row(1, 0), row(2, 60)], [row(3, 120)], [row(4, 1)], [row(5, 180)]])
    query, _ = J.run_available(J.stream_counts(stream, "1 minute", "5 minutes"))
    assert J.late_rows(query) == 1


def test_template_counts_over_batches(spark, tmp_path):
    stream = files(spark, tmp_path, [[row(1, 0, "a"), row(2, 1, "b")], [row(3, 2, "a")]]).withColumnRenamed("source", "template")
    got = {r["template"]: r["n"] for r in J.collect_stream(J.stream_templates(stream), "update", ["template"]).collect()}
    assert got == {"a": 2, "b": 1}


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_text_features_stay_in_the_jvm(spark):
    v = Views(spark, SF)
    text = plan(X.add_error_flags(X.add_text_features(v.texts)))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_filters_reach_the_scan(spark, tmp_path):
    v = Views(spark, SF)
    path = str(tmp_path / "logs")
    writers.write_logs(v.logs, path)
    text = plan(L.query_logs(spark.read.parquet(path), "s3", "2024-01-05", "2024-01-20").select("log_id"))
    assert "PartitionFilters: [isnotnull(source" in text and "GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<log_id:bigint,ts:timestamp>" in text


def test_no_window_over_a_whole_source(spark):
    v = Views(spark, SF)
    for df in (W.add_time_gap(v.logs), W.add_rolling_stats(v.logs), W.same_class_ratio(v.logs)):
        assert "windowspecdefinition(source#" not in plan(df) or "_chunk" in plan(df)
    assert "_day" in plan(W.trailing_sums(v.logs, {"n": F.count("*")}))


@pytest.mark.parametrize("n", [4, 32])
def test_results_do_not_depend_on_partitions(spark, slices, n):
    v = Views(spark, SF)
    base = sorted(map(tuple, W.add_rolling_stats(v.logs).select("log_id", F.round("time_diff_std_10", 6)).collect()))
    slices(n)
    assert base == sorted(map(tuple, W.add_rolling_stats(v.logs).select("log_id", F.round("time_diff_std_10", 6)).collect()))


def test_csv_keeps_leading_zeros_and_names_sources(spark, tmp_path):
    for name in ("HDFS_2k_labeled", "Mac_2k_labeled"):
        (tmp_path / f"{name}.csv").write_text('Date,Time,Content\n081109,004324,"a, ""b"""\n')
    df = readers.read_sources(spark, str(tmp_path / "*_labeled.csv"))
    rows = df.orderBy("source").collect()
    assert [r["source"] for r in rows] == ["HDFS_2k", "Mac_2k"]
    assert rows[0]["Date"] == "081109" and rows[0]["Content"] == 'a, "b"'


def test_raw_lines_are_numbered_in_file_order(spark, tmp_path):
    lines = [f"line {i}" if i % 5 else "  " for i in range(200)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    got = readers.read_raw_lines(spark, str(tmp_path / "a.log")).orderBy("line_id").collect()
    assert [r["content"] for r in got] == [l for l in lines if l.strip()]
    assert [r["line_id"] for r in got] == list(range(1, 161))


def test_content_column_order(spark):
    df = spark.createDataFrame([("a", "b")], "message string, Content string")
    assert df.select(readers.resolve_content(df)).first()[0] == "b"
    assert readers.resolve_content(df.select(F.lit(1).alias("x"))) is None


def test_prediction_store_skips_errors_and_known_sources(spark, tmp_path):
    schema = ("log_id long, raw string, content string, source_type string, predicted_class int, predicted_class_name string, "
              "confidence double, probabilities array<double>, error string, day string")
    rows = [(1, "x", "x", "apache", 1, "anomaly", 0.9, [0.1, 0.9], None, "d1"), (2, "", "", "linux", None, None, None, None, "empty", "d1")]
    base = str(tmp_path / "store")
    for _ in range(2):
        writers.save_predictions(spark.createDataFrame(rows, schema), base)
    assert [writers.read_predictions(spark, base, part).count() for part in ("sources", "entries", "predictions")] == [2, 1, 1]


def test_sources_with_different_headers_and_the_readme_lines(spark, tmp_path):
    (tmp_path / "Apache_2k_labeled.csv").write_text('LineId,Time,Level,Content\n1,Sun Dec 04 04:51:37 2005,error,lost\n')
    (tmp_path / "HDFS_2k_labeled.csv").write_text('LineId,Date,Time,Pid,Level,Content\n7,081109,204324,148,INFO,kept message\n')
    (tmp_path / "Mac_2k_labeled.csv").write_text('LineId,Month,Date,Time,message\n9,Jul,1,09:21:57,hello\n')
    (tmp_path / "Odd_2k_labeled.csv").write_text('a,b\n1,2\n')
    logs = normalize_timestamps(readers.read_sources(spark, str(tmp_path / "*_labeled.csv")), "source", default_year=2024)
    got = {r["source"]: (r["Content"], r["timestamp_normalized"]) for r in logs.collect()}
    assert got == {
        "Apache_2k": ("lost", "2005-12-04 04:51:37.000"), "HDFS_2k": ("kept message", "2008-11-09 20:43:24.000"),
        "Mac_2k": ("hello", "2024-07-01 09:21:57.000"),
    }
    counted = W.add_trailing_counts(logs.withColumn("log_id", F.col("LineId").cast("long")))
    assert counted.count() == 3


def test_streams_go_on_where_they_ended(spark, tmp_path):
    schema = "log_id long, source string, ts timestamp"
    rows = spark.range(40).selectExpr("id AS log_id", "'s' AS source", "timestamp_seconds(id * 10) AS ts")
    for half in (rows.filter("log_id < 20"), rows.filter("log_id >= 20")):
        half.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = J.stream_history(stream, lambda w: {"before": F.lag("log_id").over(w)}, path=str(tmp_path / "run"))
    assert {r.log_id: r.before for r in out.collect()} == {i: i - 1 if i else None for i in range(40)}


def test_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, "s", "m", None if i % 5 == 0 else i % 2, f"t{i % 3}") for i in range(40)],
                               "log_id long, source string, content string, label int, template string")
    weights = {r.label: r.weight for r in SMP.add_class_weight(df).select("label", "weight").distinct().collect()}
    assert weights[None] is None and weights[0] == weights[1] == 1.0
    parts = SMP.stratified_split(df).groupBy("label", "part").count().collect()
    assert {r["label"] for r in parts} == {None, 0, 1}
    pairs = JN.contrastive_pairs(df, augment=True).collect()
    assert pairs and not {r["first"] for r in pairs} & {i for i in range(0, 40, 5)}


def test_a_class_of_one_row_keeps_the_others_stratified(spark):
    df = spark.createDataFrame([(i, 2 if i == 0 else i % 2) for i in range(101)], "log_id long, label int")
    parts = {(r["label"], r["part"]): r["count"] for r in SMP.stratified_split(df).groupBy("label", "part").count().collect()}
    assert parts == {(2, "train"): 1, (0, "train"): 40, (0, "test"): 10, (1, "train"): 40, (1, "test"): 10}


def test_a_page_is_never_cut(spark):
    with pytest.raises(ValueError):
        TOP.page(spark.range(3).withColumn("ts", F.current_timestamp()), size=1001, key="id")
