"""CSV log files as a data source of its own.

The driver lists names and sizes; files are opened by tasks alone. Large plain files are cut
into ranges of ``RANGE_BYTES`` (a record ends with its line), small ones share a task, and
compressed ones are streamed whole. Every file is read by its own header. A row is the file,
its source, the message and all fields by name, so files of any layout are one scan. A file
that can't be read, is empty or has no message column becomes a row with a ``fault`` and
fails nothing; ``read_log_files`` keeps none of the rows of such a file.

Short rows end in nulls, surplus fields are dropped. Any store that ``pyarrow.fs`` opens can
be read; for the others ``readers.read_sources`` does it with Spark's own CSV reader.
"""

from __future__ import annotations

import csv
import fnmatch
import posixpath
import re

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from emberlog.durable import settle
from emberlog.sources.readers import CONTENT_NAMES

RANGE_BYTES = 32 << 20
SCHEMA = "file string, source string, Content string, fields map<string,string>, fault string"
ARROW = pa.schema([("file", pa.string()), ("source", pa.string()), ("Content", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("fault", pa.string())])
#: Name endings of compressed files.
COMPRESSED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd", ".lz4": "lz4"}


def open_store(path):
    """(file system, path on it)."""
    local = re.sub(r"^file:/*", "/", path)
    return (pa.fs.LocalFileSystem(), local) if local != path or "://" not in path else pa.fs.FileSystem.from_uri(path)


class Lot(InputPartition):
    """Ranges (path, from, to) that one task reads; ``to`` is None for a whole compressed file."""

    def __init__(self, ranges):
        self.ranges = ranges


def lots_of(files, range_bytes=RANGE_BYTES):
    """Cut (path, size) into lots: ranges of large files alone, small files together."""
    lots, small, held = [], [], 0
    for path, size in files:
        if posixpath.splitext(path)[1] in COMPRESSED:
            lots.append(Lot([(path, 0, None)]))
            continue
        for at in range(0, max(size, 1), range_bytes):
            end = min(size, at + range_bytes)
            if end - at == range_bytes:
                lots.append(Lot([(path, at, end)]))
                continue
            if held + end - at > range_bytes and small:
                lots.append(Lot(small))
                small, held = [], 0
            small, held = [*small, (path, at, end)], held + end - at
    return [*lots, Lot(small)] if small else lots


def line_end(stream, at, size, step=1 << 16):
    """Place behind the first line end at or after ``at``."""
    stream.seek(at)
    while at < size:
        block = stream.read(step)
        if (k := block.find(b"\n")) >= 0:
            return at + k + 1
        at += len(block)
    return size


def record_batches(source, names):
    """Record batches of a stream of CSV lines without header; rows of another width come last, filled or cut."""
    odd = []

    def other_width(row):
        odd.append(row.text)
        return "skip"

    texts = pa.csv.ConvertOptions(
        column_types={n: pa.string() for n in names}, check_utf8=False, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True)
    try:
        reader = pa.csv.open_csv(
            source, read_options=pa.csv.ReadOptions(column_names=names, block_size=4 << 20, use_threads=False),
            parse_options=pa.csv.ParseOptions(invalid_row_handler=other_width), convert_options=texts)
    except pa.ArrowInvalid as none:
        if "Empty CSV" not in str(none):
            raise
        reader = ()
    yield from reader
    width = len(names)
    rows = [[x or None for x in (r + [""] * width)[:width]] for r in csv.reader(odd)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)


def as_rows(batch, path, source, message):
    """The batch in the source's schema: one map of all fields per row."""
    n, width = batch.num_rows, batch.num_columns
    order = pa.array([r + c * n for r in range(n) for c in range(width)], pa.int64())
    names = pa.DictionaryArray.from_arrays(pa.array(list(range(width)) * n, pa.int32()), pa.array(batch.schema.names)).cast(pa.string())
    values = pa.concat_arrays([c.cast(pa.string()) for c in batch.columns]).take(order)
    fields = pa.MapArray.from_arrays(pa.array(range(0, (n + 1) * width, width), pa.int32()), names, values)
    same = lambda x: pa.repeat(pa.scalar(x, pa.string()), n)
    return pa.RecordBatch.from_arrays([same(path), same(source), batch.column(message), fields, same(None)], schema=ARROW)


class LogReader(DataSourceReader):
    def __init__(self, glob, by, suffix, range_bytes):
        self.glob, self.by, self.suffix, self.range_bytes = glob, by, suffix, range_bytes

    def partitions(self):
        store, pattern = open_store(self.glob)
        parts = pattern.split("/")
        fixed = next((i for i, x in enumerate(parts) if set("*?[") & set(x)), len(parts) - 1)
        found = store.get_file_info(pa.fs.FileSelector(
            "/".join(parts[:fixed]) or "/", allow_not_found=True, recursive=fixed < len(parts) - 1))
        fits = lambda path: len(x := path.split("/")) == len(parts) and all(map(fnmatch.fnmatchcase, x, parts))
        files = sorted((f.path, f.size or 0) for f in found if f.type == pa.fs.FileType.File and fits(f.path))
        return lots_of(files, self.range_bytes) or [Lot([])]

    def source_of(self, path):
        if self.by == "folder":
            return posixpath.basename(posixpath.dirname(path))
        return re.sub(rf"^(.*?)({self.suffix})?\.[A-Za-z]+(?:\.[a-z0-9]+)?$", r"\1", posixpath.basename(path))

    def read(self, partition):
        store, _ = open_store(self.glob)
        for path, start, end in partition.ranges:
            try:
                yield from self.of_range(store, path, start, end)
            except (OSError, ValueError, pa.ArrowException, csv.Error) as broken:
                yield self.fault(path, str(broken).split("\n")[0][:200] or type(broken).__name__)

    def of_range(self, store, path, start, end):
        if end is None:
            stream = pa.CompressedInputStream(store.open_input_stream(path, compression=None), COMPRESSED[posixpath.splitext(path)[1]])
            head, rest = self.first_line(stream.read)
        else:
            stream = store.open_input_file(path)
            head, rest = self.first_line(stream.read)
        names = next(csv.reader([head.decode("utf-8", "replace").lstrip("﻿").rstrip("\r\n")]), [])
        message = next((n for n in CONTENT_NAMES if n in names), None)
        if message is None or len(set(names)) < len(names):
            if start == 0:
                yield self.fault(path, "no message column" if names and message is None else "a column stands twice" if names else "no header")
            return
        if end is None:
            lines = Rest(rest, stream)
        else:
            size = stream.size()
            body = min(size, len(head))
            begin = body if start == 0 else max(body, line_end(stream, start - 1, size))
            stop = line_end(stream, end - 1, size)
            if begin >= stop:
                return
            stream.seek(begin)
            lines = pa.BufferReader(stream.read(stop - begin))
        for batch in record_batches(lines, names):
            for at in range(0, batch.num_rows, 20_000):
                yield as_rows(batch.slice(at, 20_000), path, self.source_of(path), names.index(message))

    @staticmethod
    def first_line(read):
        """The first line and what was read behind it."""
        held = b""
        while b"\n" not in held:
            block = read(1 << 16)
            if not block:
                return held, b""
            held += block
        at = held.index(b"\n") + 1
        return held[:at], held[at:]

    def fault(self, path, why):
        return pa.RecordBatch.from_arrays(
            [pa.array([path]), pa.array([self.source_of(path)]), pa.array([None], pa.string()), pa.array([None], ARROW.field("fields").type), pa.array([why])], schema=ARROW)


class Rest:
    """What was read ahead of a stream, then the stream."""

    closed = False

    def __init__(self, held, stream):
        self.held, self.stream = held, stream

    def read(self, n=-1):
        if self.held:
            out, self.held = (self.held, b"") if n < 0 else (self.held[:n], self.held[n:])
            return out
        return self.stream.read(n if n >= 0 else None)

    def readable(self):
        return True

    def close(self):
        self.closed = True


class LogFiles(DataSource):
    """``spark.read.format("log_files").load(glob)``; options: by (file or folder: what names the source), suffix, rangeBytes."""

    @classmethod
    def name(cls):
        return "log_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LogReader(
            self.options["path"], self.options.get("by", "file"), self.options.get("suffix", "_labeled"), int(self.options.get("rangeBytes", RANGE_BYTES)))


def scan_log_files(spark, glob, by="file", suffix="_labeled", range_bytes=RANGE_BYTES):
    spark.dataSource.register(LogFiles)
    return spark.read.format("log_files").options(by=by, suffix=suffix, rangeBytes=range_bytes).load(glob)


def read_log_files(spark, glob, columns=(), by="file", suffix="_labeled", range_bytes=RANGE_BYTES):
    """(logs, faults): rows with ``source``, ``Content`` and the named ``columns`` (null where a file
    lacks one), and file, source and fault of the files that were left out."""
    read = settle(scan_log_files(spark, glob, by, suffix, range_bytes))
    faults = read.filter("fault IS NOT NULL").groupBy("file", "source").agg(F.min("fault").alias("fault"))
    rows = read.filter("fault IS NULL").join(faults.select("file"), "file", "left_anti")
    return rows.select("source", "Content", *[F.col("fields")[c].alias(c) for c in columns if c != "Content"]), faults
