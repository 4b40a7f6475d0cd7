"""Registry of the subpackage's queries, and small column helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from emberlog.session import tune

QUERIES = {}
ORACLES = {}

#: What separates words of the whitespace kind: space and the controls 0x09 to 0x0D.
BLANKS = r"[\x20\x09-\x0D]+"


def query(name, sql=None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is its DuckDB twin."""

    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), str(sf_dir).rstrip("/"))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df, rows=2000):
    """Limit the Arrow batches of the session, so that a Python worker holds few whole texts at a time."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))


def extend(schema, ddl):
    """``schema`` with the fields of a DDL string behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def split_words(text, separators=BLANKS):
    """Array of the non-empty pieces between ``separators``; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")
