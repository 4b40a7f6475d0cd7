"""Benchmark decontamination by a broadcast set of the benchmark's word windows.

The windows of all benchmark items (ten words; a shorter item is one window of its own
length) are hashed. Every document's windows are hashed on whole texts and looked up;
each hit is verified word by word. The set is broadcast only up to a stated number of
windows; a larger benchmark takes Spark's own join instead, with the same result.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z.
Nulls and texts without a word have no windows. Items may repeat. ``id`` is the key of
the documents: rows that share it are reported as one, and go or stay together.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.llm.base import query, split_words, table

WINDOW = 10
MAX_BROADCAST_WINDOWS = 1_000_000  # about 100 MB as a hash table

#: The separators of words before and after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded_words(text):
    """Words in full lower case, for lookup only: words equal under A-Z folding stay equal.

    Capital sigma goes first, as its lower case depends on what surrounds it.
    """
    return split_words(F.lower(F.replace(text, F.lit("Σ"), F.lit("σ"))), SEPARATORS)


def window_hashes(words, length):
    """xxhash64 of every run of ``length`` words (SQL text over an array column)."""
    return F.expr(
        f"transform(slice({words}, 1, greatest(size({words}) - {length - 1}, 0)),"
        f" (x, i) -> struct(xxhash64(slice({words}, i + 1, {length})) AS hash, i AS at, {length} AS len))"
    )


def benchmark_windows(items, item="item_id", text="text", window=WINDOW):
    """One row per distinct window: ``b_hash``, ``b_len``, ``b_text``, ``b_items`` (as strings)."""
    words = items.select(
        F.col(item).cast("string").alias("item"),
        split_words(F.translate(F.col(text), UPPER, LOWER), SEPARATORS).alias("words"),
        folded_words(F.col(text)).alias("folded"),
    ).filter(F.size("words") > 0)
    words = words.withColumn("len", F.least(F.size("words"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1))
    rows = words.select("item", "len", "words", "folded", starts.alias("at"))
    return settle(rows.select(
        "item",
        F.xxhash64(F.slice("folded", F.col("at"), F.col("len"))).alias("b_hash"),
        F.col("len").alias("b_len"),
        F.array_join(F.slice("words", F.col("at"), F.col("len")), " ").alias("b_text"),
    ).groupBy("b_hash", "b_len", "b_text").agg(F.collect_set("item").alias("b_items")))


def scan(docs, windows, id="doc_id", text="text", most=MAX_BROADCAST_WINDOWS):
    """Verified hits of every document, one row per ``id``.

    Returns ``id``, ``n_words``, ``hits`` (sorted array of (at, until) word positions) and
    ``items`` (sorted item ids). Window rows never leave the task that makes them unless they hit.
    """
    lengths = [r[0] for r in windows.select("b_len").distinct().orderBy("b_len").collect()]  # ten values at most
    small = windows.limit(most + 1).count() <= most
    words = docs.select(
        F.col(id).alias("_id"),
        split_words(F.col(text), SEPARATORS).alias("_words"),
        folded_words(F.col(text)).alias("_folded"),
    )
    end = F.array(F.struct(F.lit(None).cast("long").alias("hash"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("len")))
    probes = words.select(
        "_id", "_words", F.explode(F.concat(end, *[window_hashes("_folded", n) for n in lengths])).alias("p"))
    found = probes.join(
        F.broadcast(windows) if small else windows,
        (F.col("p.hash") == F.col("b_hash")) & (F.col("p.len") == F.col("b_len")), "left")
    exact = F.translate(F.array_join(F.slice("_words", F.col("p.at") + 1, F.col("p.len")), " "), UPPER, LOWER)
    # the row without a window stands for the document itself
    kept = found.filter(F.col("p.at").isNull() | (F.col("b_hash").isNotNull() & (exact == F.col("b_text"))))
    per_doc = kept.groupBy("_id").agg(
        F.max(F.when(F.col("p.at").isNull(), F.size("_words"))).cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("p.at").isNotNull(), F.struct(
            F.col("p.at").alias("at"), (F.col("p.at") + F.col("p.len")).alias("until"))))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("b_items")))).alias("items"),
    )
    return per_doc.withColumnRenamed("_id", id)


def covered_words(hits="hits"):
    """Words inside any of the sorted, possibly overlapping spans."""
    return F.expr(
        f"aggregate({hits}, named_struct('n', 0L, 'until', 0), (a, x) -> named_struct("
        "'n', a.n + greatest(x.until - greatest(a.until, x.at), 0), 'until', greatest(a.until, x.until)), a -> a.n)")


def decontaminate(docs, items, id="doc_id", text="text", item="item_id", item_text="text", max_hit_share=0.0):
    """``docs`` without the documents of which more than ``max_hit_share`` of the words are hit."""
    windows = benchmark_windows(items, item, item_text)
    hits = scan(docs.select(F.col(id), F.col(text)), windows, id, text)
    n = covered_words()
    bad = settle(hits.filter(n > 0).filter(n > max_hit_share * F.col("n_words")).select(F.col(id).alias("_bad_id")))
    return docs.join(bad.hint("merge"), docs[id].eqNullSafe(F.col("_bad_id")), "left_anti")


def remove_spans(docs, items, id="doc_id", text="text", item="item_id", item_text="text"):
    """``docs`` with every hit word, and what separates it from the next hit word, cut out of the text."""
    windows = benchmark_windows(items, item, item_text)
    hits = scan(docs.select(F.col(id), F.col(text)), windows, id, text)
    spans = settle(hits.filter(F.size("hits") > 0).select(F.col(id).alias("_hit_id"), F.col("hits").alias("_hits")))
    joined = docs.join(spans.hint("merge"), docs[id].eqNullSafe(F.col("_hit_id")), "left")
    # one piece per word with the separators in front of it, and the rest
    pieces = joined.withColumn("_pieces", F.regexp_extract_all(
        F.col(text), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    rest = F.expr(f"substr(`{text}`, length(array_join(_pieces, '')) + 1)")
    kept = F.expr("filter(_pieces, (x, i) -> NOT exists(_hits, h -> i >= h.at AND i < h.until))")
    cut = F.when(F.col("_hits").isNull(), F.col(text)).otherwise(F.concat(F.array_join(kept, ""), rest))
    return pieces.withColumn(text, cut).select(*[f"`{n}`" for n in docs.columns])


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bx AS (SELECT item_id, w, least(len(w), 10) AS l FROM bw WHERE len(w) > 0),
bp AS (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bx),
bg AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM bp),
ls AS (SELECT DISTINCT l FROM bg),
dp AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, ls WHERE len(w) >= l),
h AS (SELECT doc_id, i, p.l, item_id FROM (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM dp) p JOIN bg USING (l, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM h)) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


@query("op8_benchmark_decontamination", SQL)
def op8_benchmark_decontamination(spark, sf_dir):
    windows = benchmark_windows(table(spark, sf_dir, "benchmark"))
    hits = scan(table(spark, sf_dir, "documents"), windows)
    return hits.select(
        "doc_id", "n_words", covered_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
