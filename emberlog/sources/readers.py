"""Log sources: structured CSV, many files at once, raw text, metric files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, MapType, StringType, StructField, StructType

from emberlog.operators.ordering import with_sequence

# Column names that may hold the message, in order of preference.
CONTENT_NAMES = ["Content", "content", "Message", "message", "Text", "text"]

def spread(df):
    """Hand the rows of a few large row groups to all cores; many-file inputs stay as they are.

    One parquet row group is one task, which text columns make a long one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_logs(spark, path, fmt="csv", schema=None):
    """Structured logs. CSV columns stay text unless a schema is given: a date such as 081109 keeps its zero."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", multiLine=False, escape='"')
    return reader.format(fmt).load(path)


def _headers(spark, glob):
    """header line -> paths of the files with it. Opens every file for one line, as schema inference does."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(glob)
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for status in fs.globStatus(pattern) or []:
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(status.getPath()), "UTF-8"))
        header = lines.readLine()
        lines.close()
        if header:
            found.setdefault(header.lstrip("\ufeff"), []).append(status.getPath().toString())
    return found


def read_sources(spark, glob, suffix="_labeled", fmt="csv", schema=None):
    """Many files at once, each by its own header; the source is the file stem without its suffix.

    Files with one header are one scan. Columns that a file lacks are null. The message is
    in ``Content`` whatever the file calls it; files without a message column are left out.
    A given schema, or another format than CSV, is read as it stands.
    """
    stem = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*?)({suffix})?\.[A-Za-z]+$", 1)
    if schema is not None or fmt != "csv":
        return read_logs(spark, glob, fmt, schema).select("*", stem.alias("source"))
    parts = []
    for _, paths in sorted(_headers(spark, glob).items()):
        df = read_logs(spark, paths)
        name = next((n for n in CONTENT_NAMES if n in df.columns), None)
        if name is not None:
            parts.append(df.select("*", stem.alias("source")).withColumnRenamed(name, "Content"))
    if not parts:
        raise ValueError(f"no file of {glob} has a message column")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_raw_lines(spark, path):
    """Non-blank lines of text files with a 1-based id in file order."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("content"),
    ).filter(F.trim("content") != "")
    ranked = with_sequence(lines, ["file"], ["block", "pos"])
    return ranked.select("file", (F.col("seq") + 1).alias("line_id"), "content")


def resolve_content(df):
    """The message column, or None if the source has none of the known names."""
    exact = set(df.columns)
    for name in CONTENT_NAMES:
        if name in exact:
            return F.col(name)
    return None


METRICS = StructType([
    StructField("models", MapType(StringType(), StructType([
        StructField("f1_macro", DoubleType()),
        StructField("balanced_acc", DoubleType()),
        StructField("auroc", DoubleType()),
        StructField("mcc", DoubleType()),
        StructField("test_samples", LongType()),
    ])))
])


def metric_rows(df, column="models"):
    """One row per model of a map column; missing F1, accuracy and row count become 0."""
    m = df.select(F.explode(column).alias("model_name", "m"))
    return m.select(
        "model_name",
        F.coalesce("m.f1_macro", F.lit(0.0)).alias("f1_score"),
        F.coalesce("m.balanced_acc", F.lit(0.0)).alias("balanced_accuracy"),
        F.col("m.auroc").alias("auroc"),
        F.col("m.mcc").alias("mcc"),
        F.coalesce("m.test_samples", F.lit(0)).alias("test_samples"),
    )


def read_metrics(spark, path):
    return metric_rows(spark.read.schema(METRICS).json(path, multiLine=True))
