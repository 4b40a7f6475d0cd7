"""The data source for log files: layouts, ranges, broken files."""

import gzip

import pytest

from emberlog.sources import log_files as L
from emberlog.sources import readers


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "HDFS_2k_labeled.csv").write_text('﻿LineId,Date,Content\n1,081109,"a, ""b"""\n2,081110,\n3,081111\n4,081112,d,more\n', encoding="utf-8")
    (tmp_path / "Mac_2k_labeled.csv").write_text("content,Time\nwörld,1\n,2\n\"\",3\n", encoding="utf-8")
    with gzip.open(tmp_path / "Linux_2k_labeled.csv.gz", "wt") as f:
        f.write("Message,Date\n" + "".join(f"line {i},{i}\n" for i in range(5000)))
    return tmp_path


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_every_file_by_its_own_header(spark, folder):
    logs, faults = L.read_log_files(spark, f"{folder}/*_labeled.csv*", ["Date", "Time"])
    assert faults.collect() == []
    assert rows(logs.filter("source = 'HDFS_2k'"), "Content", "Date", "Time") == sorted([
        ('a, "b"', "081109", None), (None, "081110", None), (None, "081111", None), ("d", "081112", None)], key=repr)
    assert rows(logs.filter("source = 'Mac_2k'"), "Content", "Time") == [("wörld", "1"), (None, "2"), (None, "3")]
    assert logs.filter("source = 'Linux_2k'").count() == 5000


def test_broken_files_are_reported_and_skipped(spark, folder):
    whole = gzip.compress(b"Content\n" + bytes(str(list(range(90000))), "ascii").replace(b",", b"\n"))
    (folder / "Torn_2k_labeled.csv.gz").write_bytes(whole[: len(whole) // 2])
    (folder / "Empty_2k_labeled.csv").write_text("")
    (folder / "Other_2k_labeled.csv").write_text("a,b\n1,2\n")
    (folder / "Twice_2k_labeled.csv").write_text("Content,Content\n1,2\n")
    (folder / "folder_labeled.csv").mkdir()
    logs, faults = L.read_log_files(spark, f"{folder}/*_labeled.csv*")
    found = {r.source: r.fault for r in faults.collect()}
    assert found.pop("Torn_2k")
    assert found == {"Empty_2k": "no header", "Other_2k": "no message column", "Twice_2k": "a column stands twice"}
    assert {r.source for r in logs.select("source").distinct().collect()} == {"HDFS_2k", "Mac_2k", "Linux_2k"}


@pytest.mark.parametrize("size", [1, 7, 100, 4096])
def test_ranges_lose_and_repeat_nothing(spark, tmp_path, size):
    lines = [f"{i},{'x' * (i % 23)}" for i in range(40 if size < 50 else 3000)]
    (tmp_path / "a.csv").write_text("LineId,Content\n" + "\n".join(lines))  # no line end at the end
    df = L.scan_log_files(spark, f"{tmp_path}/*.csv", range_bytes=size)
    got = sorted(int(r.fields["LineId"]) for r in df.collect())
    assert got == list(range(len(lines)))


def test_small_files_share_a_task_and_the_driver_opens_none(spark, tmp_path, monkeypatch):
    files = [(f"f{i}.csv", 100) for i in range(1000)] + [("big.csv", 250), ("z.gz", 10**9)]
    lots = L.lots_of(files, 200)
    assert sorted(r for lot in lots for r in lot.ranges if r[0] == "big.csv") == [("big.csv", 0, 200), ("big.csv", 200, 250)]
    assert max(sum((b or 0) - a for _, a, b in lot.ranges) for lot in lots) <= 200 and len(lots) < 510
    (tmp_path / "a.csv").write_text("Content\nx\n")
    monkeypatch.setattr(L.LogReader, "of_range", None)  # planning never reads
    assert len(L.LogReader(f"{tmp_path}/*.csv", "file", "", 100).partitions()) == 1


def test_same_rows_as_sparks_reader(spark, folder):
    logs, _ = L.read_log_files(spark, f"{folder}/*_labeled.csv", ["Date", "Time", "LineId"])
    theirs = readers.read_sources(spark, f"{folder}/*_labeled.csv")
    names = ("source", "Content", "Date", "Time", "LineId")
    assert rows(logs, *names) == rows(theirs, *names)


def test_nothing_there(spark, tmp_path):
    logs, faults = L.read_log_files(spark, f"{tmp_path}/*.csv")
    assert logs.count() == 0 and faults.count() == 0


def test_folders_may_name_the_source(spark, tmp_path):
    for name, part in (("Mac", "a"), ("Mac", "b"), ("HDFS", "a")):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / f"part-{part}.csv").write_text(f"Content\n{name}{part}\n")
    (tmp_path / "HDFS" / "_SUCCESS").write_text("")
    logs, faults = L.read_log_files(spark, f"file://{tmp_path}/*/part-*.csv", by="folder")
    assert rows(logs, "source", "Content") == [("HDFS", "HDFSa"), ("Mac", "Maca"), ("Mac", "Macb")] and faults.count() == 0
