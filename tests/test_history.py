"""Keyed state of a stream: batches, restarts, expiry, and equality with the batch form."""

import random
from datetime import datetime, timedelta

from emberlog.checks.base import Views
from emberlog.checks.streams import table_stream
from emberlog.operators import embeddings as E
from emberlog.operators import windows as W
from emberlog.streaming import history as H
from emberlog.streaming import jobs as J

SCHEMA = "log_id long, source string, ts timestamp, vec array<float>"
START = datetime(2024, 1, 1)


def row(i, seconds, source, rnd):
    return (i, source, START + timedelta(seconds=seconds), [rnd.random() for _ in range(6)])


def read(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_state_goes_on_over_batches_and_restarts(spark, tmp_path):
    rnd = random.Random(4)
    rows = [row(i, i * 3, "hot" if i % 4 else "rare", rnd) for i in range(180)]
    rows[7] = (7, "hot", rows[6][2], rows[7][3])  # a tie in time goes by id
    folder, run = str(tmp_path / "in"), str(tmp_path / "run")
    write(spark, folder, rows[:60])
    write(spark, folder, rows[60:70])
    H.run_history(read(spark, folder), run, vec="vec")
    write(spark, folder, rows[70:])  # the state has to come from the checkpoint
    got = {r.log_id: r for r in H.run_history(read(spark, folder), run, vec="vec").collect()}
    frame = spark.createDataFrame(rows, SCHEMA)
    gaps = {r.log_id: r.time_diff_seconds for r in W.add_time_gap(frame).collect()}
    want = E.rolling_embedding_stats(frame, exclude_self=True, frame="serving", order=("ts", "log_id")).collect()
    assert {i: r.gap for i, r in got.items()} == gaps
    for r in want:
        mine = got[r.log_id].asDict()
        assert all(abs(mine[n] - x) < 1e-9 for n, x in r.asDict().items())
    assert spark.conf.get(H.PROVIDER, "") != H.ROCKS


def test_idle_sources_expire(spark, tmp_path):
    rnd = random.Random(5)
    folder, run = str(tmp_path / "in"), str(tmp_path / "run")
    options = {"watermark": "10 seconds", "idle_seconds": 60}
    write(spark, folder, [row(1, 0, "idle", rnd), row(2, 1, "busy", rnd)])
    H.run_history(read(spark, folder), run, **options)
    assert {r.source for r in H.kept_sources(spark, run).collect()} == {"idle", "busy"}
    write(spark, folder, [row(3, 500, "busy", rnd)])
    write(spark, folder, [row(4, 510, "busy", rnd)])
    H.run_history(read(spark, folder), run, **options)
    held = {r.source: r.last_ts for r in H.kept_sources(spark, run).collect()}
    assert set(held) == {"busy"}
    write(spark, folder, [row(5, 520, "idle", rnd), row(6, 521, "busy", rnd)])
    got = {r.log_id: r.gap for r in H.run_history(read(spark, folder), run, **options).collect()}
    assert got[5] == 0.0 and got[6] == 11.0 and got[3] == 499.0


def test_late_rows_leave_the_state_alone(spark, tmp_path):
    rnd = random.Random(6)
    folder, run = str(tmp_path / "in"), str(tmp_path / "run")
    for rows in ([row(1, 1000, "a", rnd)], [row(2, 1001, "a", rnd)], [row(3, 5, "a", rnd)], [row(4, 1002, "a", rnd)]):
        write(spark, folder, rows)
    got = {r.log_id: r.gap for r in H.run_history(read(spark, folder), run, watermark="10 seconds").collect()}
    assert got == {1: 0.0, 2: 1.0, 4: 1.0}


def test_a_table_of_one_file_or_many_is_streamed(spark, tmp_path):
    """The tables of a folder are files or folders of files."""
    rows = spark.createDataFrame([(i, i % 8, [float(i), 1.0]) for i in range(40)], "vec_id long, label int, embedding array<float>")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "embeddings.parquet"))
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one" / "embeddings.parquet")
    seen = {k: J.collect_stream(table_stream(Views(spark, tmp_path / k), "embeddings")) for k in ("many", "one")}
    assert seen["many"].count() == seen["one"].count() == 40
