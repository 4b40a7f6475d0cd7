"""Run a registered query on Spark and its twin in DuckDB, and compare all values."""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def open_duckdb(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, Decimal):
        return ("decimal", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("float", v + 0.0)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, datetime):
        return ("ts", v.replace(tzinfo=None))
    if v is None:
        return ("null",)
    if isinstance(v, (list, tuple)):
        return ("list", tuple(_plain(x) for x in v))
    return ("str", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(df, con, sql):
    """None if equal, else a short account of the difference."""
    spark_rows = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    duck_rows = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} / {len(duck_rows)}"
    if not spark_rows:
        return "both empty"
    wrong = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(spark_rows)} rows differ, columns {sorted(columns)}\n  {str(wrong[0][0])[:600]}\n  {str(wrong[0][1])[:600]}"
    return None
