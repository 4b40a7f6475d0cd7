"""Row order at scale.

A window over a whole source is one task, and one source may hold a third of all
rows. These operators sort by range instead, so every task holds an even slice,
and carry only per-slice totals from one slice to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.durable import settle

CHUNK = 20_000  # rows of one group that a row-frame window sees at a time


SLICE_BYTES = 64 << 20


def slice_count(df):
    """Slices for a sort: one per 64 MB of the tables read, at least one per core.

    The estimate of the whole plan isn't used: it multiplies the sides of joins. Sources
    whose size Spark doesn't know get spark.sql.shuffle.partitions slices at least.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = [n for n in sizes if n < 1 << 60]
    least = spark.sparkContext.defaultParallelism if len(known) == len(sizes) else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(max(1, least, sum(known) // SLICE_BYTES))


def literals(one_row):
    """Columns of a one-row frame as literals, so that no join is needed to use them."""
    return {n: F.lit(v) for n, v in one_row.first().asDict().items()}


def attach(df, stats, on, how="left"):
    """Join a table with unique keys ``on``; null keys match null keys."""
    renamed = stats.select(*[F.col(n).alias(f"_k_{n}") if n in on else F.col(n) for n in stats.columns])
    condition = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_k_{n}")) for n in on])
    joined = df.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_k_{n}" for n in on])


def place(df, keys, order, slices=None, packed=False):
    """Sort by range and number the rows; ``_m`` rises with (keys, order)."""
    keys = [F.col(k) for k in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    n = slices or slice_count(df)
    placed = (
        df.repartitionByRange(n, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    # written once: a second evaluation could draw other range bounds
    return settle(placed, packed).withColumn("_slice", F.shiftright("_m", 33))


def with_sequence(df, keys, order, name="seq", total=None, slices=None, packed=False):
    """0-based position of every row within its keys, in a total ``order``.

    ``total`` also adds the row count of the group under that name.
    """
    placed = place(df, keys, order, slices, packed)
    runs = placed.groupBy(*keys, "_slice").agg(F.min("_m").alias("_first"), F.count("*").alias("_rows_here"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        earlier = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows_here").over(earlier), F.lit(0)))
    if total:
        runs = runs.withColumn(total, F.sum("_rows_here").over(whole))
    starts = settle(runs.drop("_rows_here"))
    out = attach(placed, starts, [*keys, "_slice"])
    return out.withColumn(name, F.col("_m") - F.col("_first") + F.col("_before")).drop(
        "_m", "_slice", "_first", "_before"
    )


def running_totals(df, keys, order, sums, slices=None):
    """Inclusive prefix sums of ``sums`` (name -> Column) along ``order`` within keys."""
    made = df.select("*", *[c.alias(f"_in_{n}") for n, c in sums.items()])
    placed = place(made, keys, order, slices)
    group = [F.col(k) for k in keys] or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy(*keys, "_slice").agg(*[F.sum(f"_in_{n}").alias(f"_s_{n}") for n in sums])
    carried = settle(
        carried.select(
            *keys, "_slice", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
        )
    )
    within = Window.partitionBy(*keys, "_slice").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select("*", *[F.sum(f"_in_{n}").over(within).alias(f"_w_{n}") for n in sums])
    out = attach(inside, carried, [*keys, "_slice"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_w_{n}") + F.col(f"_c_{n}"))
    return out.select(*df.columns, *sums)


def with_halo(df, before, seq="seq", chunk=CHUNK):
    """Cut sequenced rows into chunks; each chunk also gets the ``before`` rows ahead of it.

    Adds ``_chunk`` and ``_own``. Window by (keys, _chunk), then keep ``_own`` rows.
    """
    chunk = max(chunk, before)
    own = F.floor(F.col(seq) / F.lit(chunk)).cast("long")
    late = F.col(seq) % F.lit(chunk) >= F.lit(chunk - before)
    copies = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_chunk", F.explode(copies)).withColumn("_own", F.col("_chunk") == own)


def over_rows(df, keys, before, make, seq="seq", chunk=CHUNK):
    """Row-frame window columns over sequenced rows.

    ``make(ordered)`` gets the ordered window of one chunk and returns name -> Column;
    no frame may reach back more than ``before`` rows.
    """
    ordered = Window.partitionBy(*keys, "_chunk").orderBy(seq)
    made = make(ordered)
    wide = with_halo(df, before, seq, chunk).select("*", *[c.alias(n) for n, c in made.items()])
    return wide.filter("_own").drop("_chunk", "_own")


def mid_ranks(df, keys, column, name="mid_rank"):
    """1-based rank with ties sharing their mean rank; ranks are made per distinct value."""
    counted = df.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    upto = running_totals(counted, keys, [column], {"_upto": F.col("_n")})
    ranks = upto.select(*keys, column, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return attach(df, settle(ranks), [*keys, column])


def exact_quantiles(df, column, fractions, keys=()):
    """Linear-interpolation quantiles without gathering a group in one task.

    Returns keys, ``fraction``, ``quantile``. Nulls are left out.
    """
    keys = list(keys)
    values = df.select(*keys, F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counted = values.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    cum = running_totals(counted, keys, ["_v"], {"_upto": F.col("_n")})
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    ranked = attach(cum, settle(sizes), keys) if keys else cum.withColumns(literals(sizes))
    first = F.col("_upto") - F.col("_n")

    def value_at(p):
        return F.max(F.when((p >= first) & (p < F.col("_upto")), F.col("_v")))

    # one pass: the values around every wanted position, then interpolation on the few results
    made = []
    for i, f in enumerate(fractions):
        pos = F.lit(float(f)) * (F.col("_size") - 1)
        made += [value_at(F.floor(pos)).alias(f"lo{i}"), value_at(F.ceil(pos)).alias(f"hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"w{i}")]
    picked = ranked.groupBy(*keys).agg(*made)
    rows = F.array(*[
        F.struct(
            F.lit(float(f)).alias("fraction"),
            (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias("quantile"),
        )
        for i, f in enumerate(fractions)
    ])
    return picked.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
