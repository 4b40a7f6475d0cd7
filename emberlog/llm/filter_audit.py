"""Audit of how filters interact, over every order in which they can be applied.

Each filter is a letter and a bit. Documents are counted once, by part and by the mask of
the filters they fail; there are at most 2^filters masks, whatever the input's size. A
recursive CTE then starts from the empty prefix with these mask cells, extends every prefix
by each letter it doesn't hold, and carries the bits applied so far; each level of the
recursion emits that step's rows. Counts of a prefix serve all orders that begin with it.

Texts are compared by their SHA-256. One pass makes bits and digests; from there only short
rows move: copies are combined before the shuffle, so a text that a third of all documents
share is a few rows.

Nulls: a null text is the empty one, a null language the empty string, a null id comes after
all others (it has no smaller ones among nulls). Repeated rows count each; equal ids aren't
smaller than one another. Repeated labels of a document: it is good, or toxic, if any row
says so. Texts of any length are read whole. Columns beside the ones named are left alone,
so clashing names do no harm. No documents: no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.llm.base import query, split_words, table

#: The recursion carries at most 2^filters rows for each prefix: 125,248 for six.
MOST_FILTERS = 6


def text_failures(text):
    """letter -> failure condition of a single text (E, the one on copies, is made by ``mask_cells``)."""
    body = F.coalesce(text, F.lit(""))
    words = F.col("_words")
    capitals = F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(body),
        "D": body.rlike("[#$%&*|]"),
    }


def mask_cells(docs, labels, failures=text_failures, copies="E", id="doc_id", text="text", part="lang"):
    """(``letters``, cells): documents by ``part`` and failure ``mask``: ``n``, ``good``, ``toxic``.

    ``failures(text column)`` gives letter -> condition and may use the array ``_words``; the
    letter ``copies`` fails documents whose text a smaller id has too.
    """
    rows = docs.select(
        F.col(id).alias("_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(text).alias("_text"),
        split_words(F.col(text)).alias("_words"))
    tests = failures(F.col("_text"))
    letters = [*tests, copies]
    bits = [F.when(cond, 1 << k).otherwise(0) for k, cond in enumerate(tests.values())]
    narrow = rows.select(
        "_id", "part", F.unhex(F.sha2(F.coalesce("_text", F.lit("")), 256)).alias("_digest"),
        reduce(lambda a, b: a.bitwiseOR(b), bits).cast("int").alias("mask"))
    counted = narrow.groupBy("_id", "part", "_digest", "mask").agg(F.count("*").alias("_n"))
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic"))
    marked = counted.join(marks, "_id", "left").withColumns({
        "_good": F.coalesce("_good", F.lit(0)), "_toxic": F.coalesce("_toxic", F.lit(0))})
    place = F.struct(F.isnull("_id").alias("late"), F.col("_id").alias("id"), F.col("_n").alias("n"))
    alike = marked.groupBy("_digest", "part", "mask", "_good", "_toxic").agg(
        F.sum("_n").alias("_n"), F.min(place).alias("_first"))
    # a digest has as many rows here as parts and marks, not as copies
    least = F.min(F.struct("_first.late", "_first.id")).over(Window.partitionBy("_digest"))
    passing = F.when(F.struct("_first.late", "_first.id").eqNullSafe(F.col("_least")), F.col("_first.n")).otherwise(0)
    split = alike.withColumn("_least", least).withColumn("_pass", passing).withColumn("_c", F.explode(F.array(
        F.struct(F.col("mask"), F.col("_pass").cast("long").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(tests))).alias("mask"), (F.col("_n") - F.col("_pass")).alias("n")))))
    return letters, split.filter("_c.n > 0").groupBy("part", F.col("_c.mask").alias("mask")).agg(
        F.sum("_c.n").alias("n"), F.sum(F.col("_c.n") * F.col("_good")).alias("good"),
        F.sum(F.col("_c.n") * F.col("_toxic")).alias("toxic"))


LEVELS = """
WITH RECURSIVE grown(prefix, letter, applied, bit, step, mask) AS (
  SELECT '', '', 0, 0, 0, mask FROM {masks}
  UNION ALL
  SELECT concat(g.prefix, f.letter), f.letter, g.applied | f.bit, f.bit, g.step + 1, g.mask
  FROM grown g JOIN {unused} f ON g.applied = f.without)
SELECT * FROM grown WHERE step > 0"""


def audit(cells, letters):
    """One row per ``part``, ``filter_order`` and ``step``, from cells (part, mask, n, good, toxic)."""
    if not 1 <= len(letters) <= MOST_FILTERS or len(set("".join(letters))) != len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} filters of one letter each are asked for")
    spark, cells = cells.sparkSession, settle(cells)
    unused = spark.createDataFrame(  # at most 2^filters times filters rows
        [(a, x, 1 << k) for a in range(1 << len(letters)) for k, x in enumerate(letters) if not a >> k & 1],
        "without int, letter string, bit int")
    levels = settle(spark.sql(LEVELS, masks=cells.select("mask").distinct(), unused=unused))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    alive = F.col("mask").bitwiseAND(F.col("applied") - F.col("bit")) == 0
    total = lambda cond, what="n": F.sum(F.when(cond, F.col(what)).otherwise(0)).cast("long")
    metrics = settle(levels.join(cells, "mask").groupBy("part", "prefix", "letter", "step").agg(
        total(F.col("mask").bitwiseAND(F.col("applied")) == 0).alias("kept"),
        total(alive & fails).alias("removed"), total(~alive & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(alive & fails, "good").alias("good_lost"), total(alive & fails, "toxic").alias("toxic_lost")))
    ahead = reduce(  # orders that begin with a prefix of this many letters
        lambda c, k: c.when(F.col("step") == k, math.factorial(len(letters) - k)), range(2, len(letters) + 1),
        F.when(F.col("step") == 1, math.factorial(len(letters) - 1)))
    shapley = metrics.groupBy("part", "letter").agg(F.sum(F.col("removed") * ahead).cast("long").alias("shapley"))
    orders = levels.filter(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    steps = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at")).withColumn(
        "prefix", F.expr("substring(filter_order, 1, at)")).drop("at")
    return metrics.join(steps, "prefix").join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP12_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
firsts AS (SELECT t, min(doc_id) AS first_id FROM docs GROUP BY 1),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'), docs.doc_id > first_id] AS f
  FROM docs JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || c FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) l(c) WHERE NOT contains(o, c)),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders WHERE length(o) = 5),
judged AS (
  SELECT part, o, step, n, good, toxic, f[ascii(o[step]) - 64] AS fails,
    len(list_filter(range(1, step), lambda k: f[ascii(o[k]) - 64])) > 0 AS gone,
    len(list_filter(f, lambda x: x)) AS failures
  FROM cells, steps),
counted AS (
  SELECT part, o AS filter_order, step::INT AS step, o[step] AS letter,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails AND failures = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT * EXCLUDE (letter), sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM counted"""


@query("op12_filter_audit", OP12_SQL)
def op12_filter_audit(spark, sf_dir):
    letters, cells = mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(cells, letters)
