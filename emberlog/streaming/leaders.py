"""Template mining over a stream, with ids that never change.

The store is a list of versions, one per micro-batch: the leaders that the batch added, what
it saw of every template (lines, and the least and greatest token of each position), and the
id of each of its lines. A batch matches its distinct masked texts against the leaders of all
earlier versions, oldest first; only texts that fit none are mined, and what they are led by
gets the next ids. A batch that is run again finds the same earlier versions and replaces its
own, so nothing counts twice. All that is kept adds up: counts by sum, tokens by minimum and
maximum, so versions, and whole stores, merge in any order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.durable import fresh_path, settle
from emberlog.functions.text import mask_variables
from emberlog.operators.ordering import attach, with_sequence
from emberlog.operators.templates import ANY, leaf_keys, link_texts, masked_texts, share_of_tokens

LEADERS = "template_id long, source string, leaf string, leader string, tokens array<string>, id long"
SEEN = "template_id long, n long, cells array<struct<pos int, lo string, hi string>>, id long"


def match(texts, leaders):
    """``texts`` with the ``template_id`` of the oldest leader of their leaf that is close enough, or null."""
    wanted = attach(leaders, texts.select("leaf").distinct(), ["leaf"], "left_semi")
    lists = settle(wanted.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("template_id", "tokens"))).alias("_leaders")))
    near = F.filter("_leaders", lambda l: share_of_tokens(l["tokens"]) >= F.col("sim"))
    return attach(texts, lists, ["leaf"]).withColumn("template_id", F.get(near, F.lit(0))["template_id"]).drop("_leaders")


def _cells(rows):
    """Per template: lines, and least and greatest token of every position."""
    cells = rows.select("template_id", F.posexplode("tokens").alias("pos", "token")).groupBy("template_id", "pos").agg(
        F.min("token").alias("lo"), F.max("token").alias("hi"))
    merged = cells.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("cells"))
    return rows.groupBy("template_id").agg(F.sum("n").alias("n")).join(merged, "template_id")


class LeaderStore:
    """Versions of templates below ``path``."""

    def __init__(self, spark, path=None, sim=None, depth=None):
        self.spark, self.path, self.sim, self.depth = spark, path or fresh_path(spark, "leaders"), sim, depth
        for part, schema in (("leaders", LEADERS), ("seen", SEEN)):  # so that a first read finds a table
            self.spark.createDataFrame([], schema).drop("id").write.mode("ignore").parquet(f"{self.path}/{part}/id=-1")

    def leaders(self, before=None):
        rows = self.spark.read.schema(LEADERS).option("basePath", f"{self.path}/leaders").parquet(f"{self.path}/leaders")
        return (rows if before is None else rows.filter(F.col("id") < before)).drop("id")

    def step(self, batch, batch_id, content="content", source="source", key="log_id"):
        """Take one batch in as version ``batch_id``; (key, source, template_id) of its lines, -1 for blank ones."""
        put = lambda df, part: df.write.mode("overwrite").parquet(f"{self.path}/{part}/id={batch_id}")
        texts = settle(leaf_keys(masked_texts(batch, content, source), self.sim, self.depth))
        known = settle(self.leaders(batch_id))
        matched = settle(match(texts, known))
        missed = settle(matched.filter("template_id IS NULL").drop("template_id"))
        links = settle(link_texts(missed))
        heads = attach(missed, links.select("source", F.col("leader").alias("masked")).distinct(), ["source", "masked"], "left_semi")
        first = known.agg(F.max("template_id")).first()[0]
        fresh = settle(with_sequence(heads, [], ["source", F.desc("n"), "masked"]).select(
            (F.col("seq") + (0 if first is None else first + 1)).alias("template_id"), "source", "leaf", F.col("masked").alias("leader"), "tokens"))
        put(fresh, "leaders")
        new = attach(links, fresh.select("source", "leader", "template_id"), ["source", "leader"]).select("source", "masked", "template_id")
        ids = settle(matched.filter("template_id IS NOT NULL").select("source", "masked", "template_id").unionByName(new))
        put(_cells(attach(texts, ids, ["source", "masked"])), "seen")
        lines = batch.select(key, F.col(source).alias("source"), mask_variables(F.trim(F.col(content))).alias("masked"))
        put(attach(lines, ids, ["source", "masked"]).select(key, "source", F.coalesce("template_id", F.lit(-1).cast("long")).alias("template_id")), "lines")
        return self.spark.read.parquet(f"{self.path}/lines/id={batch_id}")

    def lines(self):
        return self.spark.read.option("basePath", f"{self.path}/lines").parquet(f"{self.path}/lines").drop("id")

    def templates(self):
        """template_id, source, n and the template text, over all versions."""
        return templates_of(self.leaders(), self.spark.read.schema(SEEN).parquet(f"{self.path}/seen"))


def templates_of(leaders, seen):
    counts = seen.groupBy("template_id").agg(F.sum("n").alias("n"))
    cells = seen.select("template_id", F.explode("cells").alias("c")).groupBy("template_id", "c.pos").agg(
        F.min("c.lo").alias("lo"), F.max("c.hi").alias("hi"))
    word = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(ANY)
    text = cells.groupBy("template_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", word.alias("w")))), lambda s: s["w"]), " ").alias("template"))
    return leaders.select("template_id", "source").join(counts, "template_id").join(text, "template_id")


def absorb(store, other, batch_id):
    """Merge another store into ``store`` as one version: ids of ``store`` stay, templates that
    fit none get new ones. Returns (other_id, template_id)."""
    theirs = settle(leaf_keys(other.leaders().select(
        F.col("template_id").alias("other_id"), "source", F.col("leader").alias("masked"), "tokens", F.lit(1).cast("long").alias("n")),
        store.sim, store.depth))
    known = settle(store.leaders(batch_id))
    matched = match(theirs, known)
    first = known.agg(F.max("template_id")).first()[0]
    fresh = settle(with_sequence(matched.filter("template_id IS NULL").drop("template_id"), [], ["other_id"]).withColumn(
        "template_id", F.col("seq") + (0 if first is None else first + 1)))
    fresh.select("template_id", "source", "leaf", F.col("masked").alias("leader"), "tokens").write.mode("overwrite").parquet(
        f"{store.path}/leaders/id={batch_id}")
    ids = settle(matched.filter("template_id IS NOT NULL").select("other_id", "template_id").unionByName(fresh.select("other_id", "template_id")))
    seen = other.spark.read.schema(SEEN).parquet(f"{other.path}/seen").withColumnRenamed("template_id", "other_id").join(ids, "other_id")
    seen.select("template_id", "n", "cells").write.mode("overwrite").parquet(f"{store.path}/seen/id={batch_id}")
    return ids


def stream_mined(stream, path=None, content="content", source="source", key="log_id", sim=None, depth=None):
    """Mine what is there of a stream; the store so far. A second run with the same ``path`` goes on."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, "mined")
    store = LeaderStore(spark, f"{path}/store", sim, depth)
    query = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(
        lambda batch, batch_id: store.step(batch, batch_id, content, source, key) and None).trigger(availableNow=True).start()
    query.awaitTermination()
    return store
