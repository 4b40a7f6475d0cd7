"""Quality rules with thresholds read from mergeable quantile sketches.

Every document gets a few integer measures. For each of them a sketch counts the
documents of one language and source by bin: values below 64 have a bin each,
larger ones share the bins of their six leading bits, so a bin's start is within
1/32 of each value in it. Sketches are plain counts; they are made with map-side
combine and merged by addition, so the sketch of a language is the sum of those of
its sources. Fences around the middle half of a group replace fixed cutoffs, and
documents are filtered by a join with the fences of their group.

Nulls: a null text counts as empty; null languages and sources form groups of their
own. Repeated rows are judged alike and all stay or go. An empty table gives an
empty result. Further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.llm.base import query, split_words, table

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
MIN_GROUP = 50  # documents below which a source falls back on its language, and a language on all
REACH = 3  # widths of the middle half between it and a fence

#: measure -> (has a lower fence, least distance of a fence from the middle half)
MEASURES = {"word_len": (True, 150), "symbol_share": (False, 100), "dup_line_share": (False, 600)}


def with_features(docs, text="text"):
    """Base counts of the whole text, as columns with the prefix ``_q_``."""
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_q_words", split_words(F.col(text)))
    docs = docs.withColumn("_q_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    docs = docs.withColumns({
        "_q_n_words": F.size("_q_words").cast("long"),
        "_q_word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "_q_n_symbols": (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long"),
        "_q_n_lines": F.size("_q_lines").cast("long"),
        "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        # three-word windows, sorted so that equal ones are neighbours
        "_q_sorted": F.expr(
            "sort_array(transform(slice(_q_words, 1, greatest(size(_q_words) - 2, 0)),"
            " (x, i) -> struct(xxhash64(x, get(_q_words, i + 1), get(_q_words, i + 2)) AS h, i AS p)))"
        ),
    })
    docs = docs.withColumn("_q_starts", F.expr(
        "sort_array(transform(filter(_q_sorted, (x, i) -> x.h <=> get(_q_sorted, i - 1).h"
        " OR x.h <=> get(_q_sorted, i + 1).h), x -> x.p))"
    ))
    docs = docs.withColumn("_q_n_repeat_words", F.expr(
        "aggregate(transform(_q_starts, (p, i) -> least(3, coalesce(get(_q_starts, i + 1) - p, 3))), 0L, (a, x) -> a + x)"
    ))
    docs = docs.withColumn("_q_base_failed", (F.col("_q_n_words") < MIN_WORDS) | (
        100 * F.col("_q_n_repeat_words") > MAX_REPEATED * F.col("_q_n_words")))
    return docs.drop("_q_words", "_q_lines", "_q_sorted", "_q_starts")


def _measures():
    """The measures as whole numbers: hundredths of a character, and per mille."""
    over = lambda a, b, k: F.when(F.col(b) > 0, F.floor(k * F.col(a) / F.col(b))).otherwise(0).cast("long")
    return {
        "word_len": over("_q_word_chars", "_q_n_words", 100),
        "symbol_share": over("_q_n_symbols", "_q_word_chars", 1000),
        "dup_line_share": over("_q_n_dup_lines", "_q_n_lines", 1000),
    }


def bin_start(value):
    """Start of the sketch bin that holds a whole number >= 0."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(measured, keys):
    """One row per group, measure and bin with its count; adding counts merges sketches."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("measure"), bin_start(F.col(f"_q_m_{n}")).alias("bin")) for n in MEASURES
    ]))
    return measured.select(*keys, rows.alias("r")).groupBy(*keys, "r.measure", "r.bin").agg(F.count("*").alias("n"))


def merge(sketches, keys):
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches, keys):
    """First and third quartile (bin starts) and size of every group and measure."""
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as a sketch has bins
    cum = sketches.withColumns({"upto": F.sum("n").over(upto), "size": F.sum("n").over(group)})
    return cum.groupBy(*keys, "measure").agg(
        F.max("size").alias("size"),
        F.min(F.when(4 * F.col("upto") >= F.col("size"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("size"), F.col("bin"))).alias("q3"),
    )


def thresholds(measured, lang="lang", source="source", min_group=MIN_GROUP, reach=REACH):
    """One row per (lang, source) with lower and upper fence of every measure.

    A source below ``min_group`` documents takes the merged sketch of its language, a
    language below it that of all documents.
    """
    fine = settle(sketch(measured, [lang, source]))
    coarse = settle(merge(fine.drop(source), [lang]))
    by_source = quartiles(fine, [lang, source]).alias("s")
    by_lang = quartiles(coarse, [lang]).alias("l")
    overall = quartiles(merge(coarse.drop(lang), []), []).alias("a")
    same_lang = F.col(f"s.{lang}").eqNullSafe(F.col(f"l.{lang}")) & (F.col("s.measure") == F.col("l.measure"))
    picked = by_source.join(by_lang, same_lang, "left").join(overall, F.col("s.measure") == F.col("a.measure"), "left")
    pick = lambda q: F.when(F.col("s.size") >= min_group, F.col(f"s.{q}")).when(
        F.col("l.size") >= min_group, F.col(f"l.{q}")).otherwise(F.col(f"a.{q}"))
    chosen = picked.select(
        F.col(f"s.{lang}").alias(lang), F.col(f"s.{source}").alias(source), F.col("s.measure").alias("measure"),
        pick("q1").alias("q1"), pick("q3").alias("q3"),
    )
    width = reach * (F.col("q3") - F.col("q1"))
    made = []
    for n, (two_sided, least) in MEASURES.items():
        here = F.col("measure") == n
        made.append(F.max(F.when(here, F.col("q3") + F.greatest(width, F.lit(least)))).alias(f"_q_hi_{n}"))
        low = F.when(here, F.col("q1") - F.greatest(width, F.lit(least)))
        made.append(F.max(low if two_sided else F.when(here, F.lit(-1))).alias(f"_q_lo_{n}"))
    return settle(chosen.groupBy(lang, source).agg(*made))


def judge(docs, text="text", lang="lang", source="source", keep=None, min_group=MIN_GROUP, reach=REACH):
    """``docs`` with the base counts (``_q_*``), the fences, and ``_q_kept``.

    Rows with their counts are written once; the sketches and the filter read that table.
    ``keep`` names the columns of ``docs`` to write, all by default.
    """
    measured = with_features(docs, text).withColumns({f"_q_m_{n}": c for n, c in _measures().items()})
    if keep is not None:
        measured = measured.select(*keep, *[n for n in measured.columns if n.startswith("_q_")])
    measured = settle(measured)
    fences = thresholds(measured.filter(~F.col("_q_base_failed")), lang, source, min_group, reach)
    fences = fences.withColumnsRenamed({lang: "_q_lang", source: "_q_source"})
    joined = measured.join(
        fences, F.col(lang).eqNullSafe(F.col("_q_lang")) & F.col(source).eqNullSafe(F.col("_q_source")), "left")
    within = F.lit(True)
    for n in MEASURES:
        value = F.col(f"_q_m_{n}")
        within = within & (value <= F.col(f"_q_hi_{n}")) & (value >= F.col(f"_q_lo_{n}"))
    return joined.withColumn("_q_kept", ~F.col("_q_base_failed") & F.coalesce(within, F.lit(False)))


def quality_filter(docs, **options):
    """The rows of ``docs`` that pass the base rules and the fences of their group."""
    names = docs.columns
    return judge(docs, **options).filter("_q_kept").select(*[f"`{n}`" for n in names])


SQL = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(list_zip(ws[1:len(ws) - 2], ws[2:len(ws) - 1], ws[3:len(ws)])) AS g, generate_subscripts(ws[1:len(ws) - 2], 1) AS p
  FROM w WHERE len(ws) >= 3),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p + d) AS n FROM rep, (VALUES (0), (1), (2)) o(d) GROUP BY 1),
f AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS m1,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS m2,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS m3 FROM f),
v AS (SELECT lang, source, 'm1' AS m, m1 AS x FROM b WHERE NOT base_failed UNION ALL SELECT lang, source, 'm2', m2 FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'm3', m3 FROM b WHERE NOT base_failed),
z AS (SELECT lang, source, m, ((x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0)) AS bin FROM v),
q AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'all' WHEN grouping(source) = 1 THEN 'lang' ELSE 'source' END AS k, lang, source, m, count(*) AS size,
    quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM z GROUP BY GROUPING SETS ((lang, source, m), (lang, m), (m))),
c AS (SELECT s.lang, s.source, s.m,
    CASE WHEN s.size >= 50 THEN s.q1 WHEN l.size >= 50 THEN l.q1 ELSE a.q1 END AS q1,
    CASE WHEN s.size >= 50 THEN s.q3 WHEN l.size >= 50 THEN l.q3 ELSE a.q3 END AS q3
  FROM q s JOIN q l ON l.k = 'lang' AND l.lang IS NOT DISTINCT FROM s.lang AND l.m = s.m JOIN q a ON a.k = 'all' AND a.m = s.m WHERE s.k = 'source'),
e AS (SELECT lang, source, max(q1 - greatest(3 * (q3 - q1), 150)) FILTER (m = 'm1') AS lo1, max(q3 + greatest(3 * (q3 - q1), 150)) FILTER (m = 'm1') AS hi1,
    max(q3 + greatest(3 * (q3 - q1), 100)) FILTER (m = 'm2') AS hi2, max(q3 + greatest(3 * (q3 - q1), 600)) FILTER (m = 'm3') AS hi3 FROM c GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(m1 >= lo1 AND m1 <= hi1 AND m2 <= hi2 AND m3 <= hi3, false) AS kept
FROM b LEFT JOIN e ON b.lang IS NOT DISTINCT FROM e.lang AND b.source IS NOT DISTINCT FROM e.source
"""


@query("op3_quality_rules", SQL)
def op3_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    judged = judge(docs, keep=["doc_id", "lang", "source"])
    return judged.select(
        "doc_id", *[F.col(f"_q_{n}").alias(n) for n in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
