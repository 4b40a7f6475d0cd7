"""Repeatable randomness: every draw is a digest of the row id and a seed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.operators.ordering import attach

BITS = 52
RANK_BITS = 16


def draw(*ids, seed=42):
    """52-bit integer from the first hex digits of md5(id|...|seed)."""
    ids = [F.col(i) if isinstance(i, str) else i for i in ids]
    text = F.concat_ws("|", *[i.cast("string") for i in ids], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def uniform(*ids, seed=42):
    """Draw in [0, 1)."""
    return draw(*ids, seed=seed) / F.lit(float(2**BITS))


def _starts(df, keys, seed_col):
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most 2**RANK_BITS rows for a key, whatever its size
    return settle(
        counts.select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(group).alias("_size"),
        )
    )


def hash_rank(df, keys, ids, seed=42, name="draw_rank", size=None, keep=None):
    """1-based rank of every row within keys by its draw.

    Rows fall into buckets by the top bits of the draw, so that a hot key is spread
    over many windows. ``keep`` (number or Column over keys and ``_size``) drops rows
    ranked above it, most of them before the shuffle.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    marked = df.withColumn("_draw", draw(*ids, seed=seed)).withColumn(
        "_bucket", F.shiftright("_draw", BITS - RANK_BITS)
    )
    out = attach(marked, _starts(marked, keys, "_draw"), [*keys, "_bucket"], "inner")
    if keep is not None:
        keep = F.lit(keep) if isinstance(keep, (int, float)) else keep
        out = out.filter(F.col("_before") < keep)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_draw", *ids)
    out = out.withColumn(name, F.col("_before") + F.row_number().over(inside))
    if keep is not None:
        out = out.filter(F.col(name) <= keep)
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_draw", "_bucket", "_before", "_size")
