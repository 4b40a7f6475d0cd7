"""Connected components by large-star and small-star rounds on written edge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.durable import settle


def _state(edges):
    """Count and sum of digests of an edge table; equal tables have equal ones."""
    digest = F.xxhash64("hi", "lo").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(digest)).first())


def components(edges, a="a", b="b"):
    """(node, root) for every node with an edge; the root is the smallest node reachable.

    Every round is a written table, so lost executors cost a task, not the lineage. A node
    with many edges is split by Spark's skew join; minima are combined before shuffling.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = settle(edges.filter(F.col(a) != F.col(b)).select(high.alias("hi"), low.alias("lo")).distinct())
    state = _state(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(roots, "hi").select(
            F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        following = settle(small.select("e.hi", "e.lo").filter(F.col("hi") != F.col("lo")).distinct())
        before, state, now = state, _state(following), following
        if state == before:
            break
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)
