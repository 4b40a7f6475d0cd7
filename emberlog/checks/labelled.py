from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.checks.base import check, draw_sql, r6
from emberlog.checks.samples import rank_sql
from emberlog.durable import settle
from emberlog.functions.text import mask_variables
from emberlog.operators import labelling as LAB
from emberlog.operators import profile as P
from emberlog.operators import templates as T
from emberlog.operators import tfidf as X
from emberlog.operators.ordering import attach

LEAF_SQL = r"""d AS (SELECT source, trim(template) AS masked, count(*) AS n FROM tpl GROUP BY source, trim(template)),
k AS (SELECT *, regexp_extract_all(masked, '\S+') AS tokens FROM d),
c1 AS (SELECT *, len(tokens) AS n_tokens, CASE WHEN regexp_matches(tokens[1], '<|\d') THEN '<*>' ELSE tokens[1] END AS child FROM k),
s1 AS (SELECT source, n_tokens, child, sum(n) AS size FROM c1 GROUP BY ALL),
k1 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY source, n_tokens ORDER BY size DESC, child) <= 100),
l1 AS (SELECT c1.source, c1.n_tokens, c1.tokens, c1.n, CASE WHEN k1.child IS NULL THEN '<*>' ELSE c1.child END AS a FROM c1 LEFT JOIN k1 USING (source, n_tokens, child)),
c2 AS (SELECT source, n_tokens, a, n, CASE WHEN tokens[2] IS NULL THEN '' WHEN regexp_matches(tokens[2], '<|\d') THEN '<*>' ELSE tokens[2] END AS child FROM l1),
s2 AS (SELECT source, n_tokens, a, child, sum(n) AS size FROM c2 GROUP BY ALL),
k2 AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY source, n_tokens, a ORDER BY size DESC, child) <= 100),
l2 AS (SELECT c2.source, c2.n_tokens, c2.a, c2.n, CASE WHEN k2.child IS NULL THEN '<*>' ELSE c2.child END AS b FROM c2 LEFT JOIN k2 USING (source, n_tokens, a, child))"""


@check("tpl1_mask_and_group", "tpl", f"""
WITH {LEAF_SQL} SELECT source, n_tokens::INT AS n_tokens, a, b, count(*) AS n_texts, sum(n)::BIGINT AS n_lines FROM l2 GROUP BY source, n_tokens, a, b""")
def _(v):
    out = T.leaf_keys(T.masked_texts(v.lines))
    parts = F.split("leaf", "\u0001")
    return out.groupBy("source", F.size("tokens").alias("n_tokens"), F.get(parts, F.lit(2)).alias("a"), F.get(parts, F.lit(3)).alias("b")).agg(
        F.count("*").alias("n_texts"), F.sum("n").alias("n_lines")
    )


@check("tpl1_template_mining")
def _(v):
    return T.mine_templates(v.lines)[1]


@check("tpl1_template_of_each_line")
def _(v):
    return T.mine_templates(v.lines)[0].select("log_id", "source", "template_id", "template")


@check("tpl1_mining_coverage", "lines", """
SELECT source, count(*) AS n_lines, count(*) AS n_counted, TRUE AS dense, TRUE AS fitting FROM lines GROUP BY source""")
def _(v):
    rows, templates = T.mine_templates(v.lines)
    # a line has as many tokens as its template, and each agrees with it or meets a wildcard
    token = F.regexp_extract_all(mask_variables(F.trim("content")), F.lit(r"\S+"), 0)
    word = F.split("template", " ")
    fits = (F.size(token) == F.size(word)) & F.forall(F.zip_with(token, word, lambda t, w: (t == w) | (w == T.ANY)), lambda x: x)
    lines = rows.filter("template_id >= 0").groupBy("source").agg(F.count("*").alias("n_lines"), F.bool_and(fits).alias("fitting"))
    kept = templates.groupBy("source").agg(
        F.sum("n").alias("n_counted"), ((F.min("template_id") == 0) & (F.max("template_id") == F.count("*") - 1)).alias("dense"))
    return lines.join(kept, "source").select("source", "n_lines", "n_counted", "dense", "fitting")


STATS_SQL = """s AS (SELECT source, template, count(*) AS n, count(*) FILTER (label = 0) AS n_normal, count(*) FILTER (label = 1) AS n_anomaly FROM tpl GROUP BY source, template),
t AS (SELECT *, n_normal / (n + 1e-6::DOUBLE) AS normal_score, n_anomaly / (n + 1e-6::DOUBLE) AS anomaly_score FROM s)"""


@check("tpl2_template_stats", "tpl", f"""
WITH {STATS_SQL} SELECT source, template, n, n_normal, n_anomaly, round(normal_score, 6) AS normal_score, round(anomaly_score, 6) AS anomaly_score FROM t""")
def _(v):
    out = T.template_stats(v.tpl)
    return out.withColumns({c: r6(c) for c in ("normal_score", "anomaly_score")})


@check("tpl3_template_features", "tpl", rf"""
WITH {STATS_SQL}, f AS (SELECT *, n / (sum(n) OVER (PARTITION BY source))::DOUBLE AS share, len(regexp_extract_all(template, '\S+')) AS length,
  len(regexp_extract_all(template, '<NUM>')) + len(regexp_extract_all(template, '<IP>')) + len(regexp_extract_all(template, '<PATH>')) + len(regexp_extract_all(template, '<UUID>')) AS wild FROM t),
g AS (SELECT *, 1.0::DOUBLE / (share + 1e-6) AS rarity FROM f)
SELECT log_id, round(rarity, 4) AS rarity, length, wild AS n_wildcards, round(share, 6) AS frequency, round(length * wild / (share + 1e-6), 4)::DOUBLE AS complexity_score,
  round(normal_score, 6) AS normal_score, round(anomaly_score, 6) AS anomaly_score, round(rarity * (1 - greatest(normal_score, anomaly_score)), 3) AS uniqueness_score,
  round(normal_score, 6) AS class_prob_0, round(anomaly_score, 6) AS class_prob_1 FROM tpl JOIN g USING (source, template)""")
def _(v):
    out = T.add_template_features(v.tpl, T.template_stats(v.tpl), with_labels=True)
    places = {"rarity": 4, "complexity_score": 4, "uniqueness_score": 3}
    names = [c for c in T.LABEL_FREE + T.LABEL_BASED if c not in ("length", "n_wildcards")]
    return out.select("log_id", "length", "n_wildcards", *[r6(c, places.get(c, 6)).alias(c) for c in names])


@check("tpl4_global_template_ids", "logs", """
SELECT log_id, dense_rank() OVER (ORDER BY source, content) - 1 AS global_id FROM logs""")
def _(v):
    return T.global_template_ids(v.logs, template="content").select("log_id", "global_id")


@check("tpl4_capped_template_ids", "logs", """
SELECT log_id, least(dense_rank() OVER (ORDER BY source, content) - 1, 99) AS global_id FROM logs""")
def _(v):
    return T.global_template_ids(v.logs, cap=100, template="content").select("log_id", "global_id")


@check("tpl5_running_template_frequency", "logs", """
SELECT log_id, count(*) OVER (PARTITION BY content ORDER BY ts, log_id) AS template_count,
  round(count(*) OVER (PARTITION BY content ORDER BY ts, log_id) / (count(*) OVER (ORDER BY ts, log_id) + 1e-6::DOUBLE), 6) AS running_frequency FROM logs""")
def _(v):
    out = T.running_template_frequency(v.logs, "content")
    return out.select("log_id", "template_count", r6("running_frequency").alias("running_frequency"))


TERMS_SQL = r"""w AS (SELECT log_id, regexp_extract_all(lower(content), '[\p{L}\p{N}_]{2,}') AS w FROM texts),
b AS (SELECT log_id, w, list_transform(list_zip(w, w[2:], w[3:]), lambda x: x) AS z FROM w),
g AS (SELECT log_id, unnest(w) AS term FROM w
  UNION ALL SELECT log_id, unnest(list_transform(list_filter(z, lambda x: x[2] IS NOT NULL), lambda x: x[1] || ' ' || x[2])) FROM b
  UNION ALL SELECT log_id, unnest(list_transform(list_filter(z, lambda x: x[3] IS NOT NULL), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])) FROM b),
tc AS (SELECT log_id, term, count(*) AS tf FROM g GROUP BY log_id, term),
idf AS (SELECT term, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM texts)) / (1 + count(*))) + 1 AS idf FROM tc GROUP BY term HAVING count(*) >= 2)"""


@check("txt20_idf_table", "texts", f"WITH {TERMS_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(v):
    return X.idf_table(v.texts, min_df=2).withColumn("idf", r6("idf"))


@check("txt20_idf_sketched", "texts", f"WITH {TERMS_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf WHERE df >= 5")
def _(v):
    return X.idf_table(v.texts, min_df=5, sketch_bits=22).withColumn("idf", r6("idf"))


@check("txt20_tfidf_weights", "texts", f"""
WITH {TERMS_SQL}, r AS (SELECT log_id, term, tf * idf AS w FROM tc JOIN idf USING (term))
SELECT log_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY log_id)), 6) AS weight FROM r""")
def _(v):
    return X.tfidf(v.texts, min_df=2).withColumn("weight", r6("weight"))


@check("txt21_seed_phrase_expansion", "tpl", "WITH seeds(category, phrase) AS (VALUES "
       + ", ".join(f"('{k}', '{p}')" for k, ps in LAB.normalized_seed_patterns().items() for p in ps)
       + r"""), syn AS (SELECT DISTINCT 'error' AS phrase, 'error ' || event_type AS synonym FROM events),
allp AS (SELECT category, phrase FROM seeds UNION SELECT category, synonym FROM seeds JOIN syn USING (phrase)),
l AS (SELECT log_id, trim(regexp_replace(regexp_replace(lower(content), '\d+', '<num>', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS low FROM tpl)
SELECT category, phrase, (SELECT count(*) FROM l WHERE contains(low, phrase)) AS hits FROM allp""")
def _(v):
    from emberlog.functions.text import normalize_label_text

    synonyms = v.table("events").select(
        F.lit("error").alias("phrase"), F.concat(F.lit("error "), "event_type").alias("synonym")
    ).distinct()
    patterns = LAB.expand_patterns(v.spark, synonyms)
    # the phrase list is a small table; every line is searched once for all of them
    listed = [(r["category"], r["phrase"]) for r in patterns.select("category", "phrase").collect()]
    low = v.tpl.select(normalize_label_text("content").alias("low"))
    counts = low.select(F.explode(F.filter(
        F.array(*[F.when(F.col("low").contains(p), F.lit(f"{c}|{p}")) for c, p in listed]), lambda x: x.isNotNull()
    )).alias("hit")).groupBy("hit").agg(F.count("*").alias("hits"))
    keyed = patterns.withColumn("hit", F.concat_ws("|", "category", "phrase"))
    return keyed.join(counts, "hit", "left").select("category", "phrase", F.coalesce("hits", F.lit(0)).alias("hits"))


# Items: masked templates of a source in a fixed order, labelled where their document is.
ITEMS_SQL = r"""gi AS (SELECT source, template, count(*) AS n, max(label) AS m, min(log_id) AS item FROM tpl GROUP BY source, template),
items AS (SELECT source, template, n, item, m * 2 + m * (n % 3) AS label FROM gi),
nt AS (SELECT *, trim(regexp_replace(regexp_replace(lower(template), '\d+', '<num>', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM items),
iw AS (SELECT item, n, label, norm, unnest(list_distinct(list_filter(regexp_extract_all(norm, '[\p{L}\p{N}_]+'),
  lambda w: regexp_full_match(w, '[a-zA-Z]{3,}') AND NOT list_contains(['the', 'and', 'for', 'are', 'with', 'this', 'that', 'from', 'was', 'not'], w)))) AS word FROM nt)"""
SCORES_SQL = """sw AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY item DESC) - row_number() OVER (PARTITION BY word, label ORDER BY item DESC) AS later
  FROM iw WHERE label IS NOT NULL),
ws AS (SELECT word, label, sum(n * pow(0.8, later)) AS score FROM sw GROUP BY word, label)"""


def items(v):
    out = v.tpl.groupBy("source", "template").agg(
        F.count("*").alias("n"), F.max("label").alias("m"), F.min("log_id").alias("item")
    )
    label = (F.col("m") * 2 + F.col("m") * (F.col("n") % 3)).cast("int")
    # read by the scores, the words and the lift; else every reading masks and groups all lines
    return settle(LAB.with_words(out.select("source", "template", "n", "item", label.alias("label"))), packed=True)


@check("lab1_word_scores", "tpl", f"WITH {ITEMS_SQL}, {SCORES_SQL} SELECT word, label::INT AS label, round(score, 6) AS score FROM ws")
def _(v):
    return LAB.word_scores(items(v)).withColumn("score", r6("score"))


@check("jn11_pattern_library_join", "tpl", f"""
WITH {ITEMS_SQL}, {SCORES_SQL}, sh AS (SELECT word, label, score / sum(score) OVER (PARTITION BY word) AS share FROM ws)
SELECT item, sh.label::INT AS label, round(sum(share), 5) AS score FROM iw JOIN sh USING (word) GROUP BY item, sh.label""")
def _(v):
    it = items(v)
    return LAB.pattern_hits(LAB.item_words(it), LAB.word_scores(it)).withColumn("score", r6("score", 5))


@check("lab2_pattern_stats", "tpl", f"""
WITH {ITEMS_SQL}, k AS (SELECT label, count(DISTINCT word) AS keywords FROM iw WHERE label IS NOT NULL GROUP BY label)
SELECT i.label::INT AS label, count(*) AS templates, count(DISTINCT source) AS sources, sum(n)::BIGINT AS logs, any_value(keywords) AS keywords
FROM items i JOIN k ON i.label = k.label GROUP BY i.label""")
def _(v):
    return LAB.pattern_stats(items(v))


@check("lab3_feedback_update", "tpl", f"""
WITH {ITEMS_SQL}, mx AS (SELECT max(item) AS m FROM items),
fb AS (SELECT item + m + 1 AS item, 1 AS n, 5 AS label, norm FROM nt, mx WHERE nt.label = 0),
fw AS (SELECT item, n, label, unnest(list_distinct(list_filter(regexp_extract_all(norm, '[\\p{{L}}\\p{{N}}_]+'),
  lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}') AND NOT list_contains(['the', 'and', 'for', 'are', 'with', 'this', 'that', 'from', 'was', 'not'], w)))) AS word FROM fb),
ev AS (SELECT item, n, label, word FROM iw WHERE label IS NOT NULL UNION ALL SELECT item, n, label, word FROM fw),
lt AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY item DESC) - row_number() OVER (PARTITION BY word, label ORDER BY item DESC) AS later FROM ev),
sc AS (SELECT word, label, sum(n * pow(0.8, later)) AS score FROM lt GROUP BY word, label),
po AS (SELECT word, label, count(*) AS positive FROM fw GROUP BY word, label),
fi AS (SELECT word, label, min(item) AS first FROM ev GROUP BY word, label),
ne AS (SELECT fi.word, fi.label, count(*) AS negative FROM fw JOIN fi ON fw.word = fi.word AND fw.label <> fi.label AND fw.item > fi.first GROUP BY fi.word, fi.label)
SELECT word, label::INT AS label, round(score, 6) AS score, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative
FROM sc LEFT JOIN po USING (word, label) LEFT JOIN ne USING (word, label)""")
def _(v):
    it = items(v)
    feedback = it.filter("label = 0").select("template", F.lit(5).alias("label"), "item", "_words")
    return LAB.apply_feedback(it.select("template", "label", "n", "item", "_words"), feedback).withColumn("score", r6("score"))


SUGGEST_SQL = f"""{ITEMS_SQL}, {SCORES_SQL}, sh AS (SELECT word, label, score / sum(score) OVER (PARTITION BY word) AS share FROM ws),
li AS (SELECT item, pow(1.1, sum(contains(norm, word)::INT)) AS lift FROM iw GROUP BY item),
e AS (SELECT item, sh.label, sum(share) AS s FROM iw JOIN sh USING (word) GROUP BY item, sh.label),
f AS (SELECT item, label, s * lift AS score FROM e JOIN li USING (item)),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, label) AS k FROM f),
b AS (SELECT item, max(label) FILTER (k = 1) AS label, max(score) FILTER (k = 1) AS best, max(score) FILTER (k = 2) AS second FROM r GROUP BY item),
sg AS (SELECT i.item, i.source, i.template, i.n, i.label, coalesce(b.label, 0)::INT AS suggested, coalesce(best, 0) AS best,
  CASE WHEN best >= 2 AND best - coalesce(second, 0) >= 0.5 THEN 'high' WHEN best >= 1 AND best - coalesce(second, 0) >= 0.2 THEN 'medium' ELSE 'low' END AS confidence
  FROM items i LEFT JOIN b USING (item))"""


def suggestions(v):
    it = items(v)
    return LAB.suggest_labels(it, LAB.word_scores(it))


@check("lab4_label_suggestion", "tpl", f"WITH {SUGGEST_SQL} SELECT item, suggested, round(ln(1 + best), 6) AS log_best FROM sg")
def _(v):
    # the score spans many magnitudes; its logarithm is rounded to the same number of digits everywhere
    return suggestions(v).select("item", "suggested", r6(F.log1p("best")).alias("log_best"))


@check("lab5_suggestion_confidence", "tpl", f"WITH {SUGGEST_SQL} SELECT item, confidence FROM sg")
def _(v):
    return suggestions(v).select("item", "confidence")


@check("lab6_auto_accept", "tpl", f"""WITH {SUGGEST_SQL}
SELECT item, CASE WHEN label IS NULL AND confidence = 'high' THEN suggested ELSE label END::INT AS label,
  CASE WHEN label IS NULL AND confidence = 'high' THEN 'Auto-labeled (high confidence)' ELSE '' END AS notes FROM sg""")
def _(v):
    return LAB.auto_label(suggestions(v).withColumn("notes", F.lit(""))).select("item", "label", "notes")


@check("lab7_bulk_label", "tpl", f"""WITH {SUGGEST_SQL}
SELECT item, CASE WHEN label IS NOT NULL THEN label WHEN suggested IN (0, 2) THEN suggested ELSE 7 END::INT AS label,
  CASE WHEN label IS NOT NULL THEN '' WHEN suggested IN (0, 2) THEN 'Bulk labeled by suggestion' ELSE 'Bulk: Default unknown anomaly' END AS notes FROM sg""")
def _(v):
    return LAB.bulk_label(suggestions(v).withColumn("notes", F.lit("")), accept=(0, 2), rest=7).select("item", "label", "notes")


TABLE_SQL = """rr AS (SELECT source, template, content, label, row_number() OVER (PARTITION BY source, template ORDER BY log_id) AS k,
  count(*) OVER (PARTITION BY source, template) AS n, count(*) OVER (PARTITION BY source) AS total, max(label) OVER (PARTITION BY source, template) AS m FROM tpl),
tt AS (SELECT source, template, n, n * 100.0 / total AS percent, any_value(m) AS label, lower(string_agg(content, ' ' ORDER BY k)) AS low FROM rr WHERE k <= 3 GROUP BY source, template, n, total)"""


def labelled_table(v):
    marks = v.tpl.groupBy("source", T.digest("template").alias("_key")).agg(F.max("label").alias("label"))
    table = P.template_table(v.tpl).withColumn("_key", T.digest("template")).filter("source IS NOT NULL AND template IS NOT NULL")
    return attach(table, marks, ["source", "_key"], "inner").drop("_key")


def _any_sql(words):
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


ISSUES_SQL = f"""iss AS (SELECT source, template, label, 'security_without_keywords' AS issue FROM tt WHERE label = 1 AND NOT {_any_sql(LAB.SECURITY_WORDS)}
UNION ALL SELECT source, template, label, 'normal_with_error_words' FROM tt WHERE label = 0 AND {_any_sql(LAB.ERROR_WORDS)}
UNION ALL SELECT source, template, label, 'frequent_anomaly' FROM tt WHERE label > 0 AND percent > 15)"""


@check("lab8_label_quality_checks", "tpl", f"WITH {TABLE_SQL}, {ISSUES_SQL} SELECT * FROM iss")
def _(v):
    return LAB.validate_labels(labelled_table(v))


@check("lab9_completion_gate", "tpl", f"""WITH {TABLE_SQL}, {ISSUES_SQL},
g AS (SELECT source, avg(CASE WHEN label IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE AS completion, coalesce(sum(n) FILTER (label IS NOT NULL), 0) / sum(n)::DOUBLE AS coverage FROM tt GROUP BY source),
c AS (SELECT source, count(*) AS issues FROM iss GROUP BY source)
SELECT source, round(completion, 6) AS completion, round(coverage, 6) AS coverage, coalesce(issues, 0) AS issues,
  CASE WHEN completion < 0.7 THEN 'incomplete' WHEN coalesce(issues, 0) > 5 THEN 'review' ELSE 'complete' END AS gate FROM g LEFT JOIN c USING (source)""")
def _(v):
    table = settle(labelled_table(v), packed=True)  # read twice
    out = LAB.completion_gate(table, LAB.validate_labels(table))
    return out.withColumns({"completion": r6("completion"), "coverage": r6("coverage")})


@check("lab10_training_export", "tpl", rf"""
WITH k AS (SELECT * FROM tpl WHERE label >= 0), r AS (SELECT *, {rank_sql('label')} AS rk, count(*) OVER (PARTITION BY label) AS nn FROM k)
SELECT log_id, label, length(content) AS "ContentLength", regexp_matches(lower(content), 'error|fail|critical|exception')::INT AS "HasError",
  regexp_matches(content, '\d+')::INT AS "HasNumbers", CASE WHEN rk <= round(nn * 0.8) THEN 'train' ELSE 'test' END AS part FROM r""")
def _(v):
    return LAB.export_training(v.tpl).select("log_id", "label", "ContentLength", "HasError", "HasNumbers", "part")
