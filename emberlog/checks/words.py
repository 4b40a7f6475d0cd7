from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.checks.base import MASK_SQL, check, mask_sql, r6
from emberlog.functions import text as X
from emberlog.functions.labels import canonical_source

WORDS_SQL = r"regexp_extract_all(content, '\S+')"
CHARS_SQL = "string_split(content, '')"


def _text(name, column, sql, made=None, places=6):
    @check(name, "texts", f"SELECT log_id, {sql} AS {column} FROM texts")
    def _(v):
        col = made() if made else X.text_columns()[column]
        if column.endswith(("ratio", "entropy")):
            col = r6(col, places)
        return v.texts.select("log_id", col.alias(column))


NORMAL_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(lower(content), '[0-9a-f]{8,}', '<HEX>', 'g'),
  '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}', '<IP>', 'g'), '\b\d{4}-\d{2}-\d{2}\b', '<DATE>', 'g'),
  '\b\d{2}:\d{2}:\d{2}\b', '<TIME>', 'g'), '\d+', '<NUM>', 'g'),
  '[^\p{L}\p{N}_\s<>]', ' ', 'g'), '\s+', ' ', 'g'))"""
LABEL_TEXT_SQL = r"trim(regexp_replace(regexp_replace(lower(content), '\d+', '<num>', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'))"

_text("txt1_log_text_normaliser", "normalized", NORMAL_SQL, lambda: X.normalize_log_text("content"))
_text("txt2_label_text_normaliser", "normalized", LABEL_TEXT_SQL, lambda: X.normalize_label_text("content"))
_text("txt3_msg_length", "msg_length", "length(content)")
_text("txt4_msg_word_count", "msg_word_count", f"len({WORDS_SQL})")
_text("txt5_msg_unique_chars", "msg_unique_chars", f"len(list_distinct({CHARS_SQL}))")
_text("txt7_special_char_ratio", "special_char_ratio",
      r"round(length(regexp_replace(content, '[\p{L}\p{N}\s]', '', 'g')) / (length(content) + 1.0)::DOUBLE, 6)")
_text("txt8_number_ratio", "number_ratio",
      r"round(length(regexp_replace(content, '[^\p{Nd}]', '', 'g')) / (length(content) + 1.0)::DOUBLE, 6)")
_text("txt9_uppercase_ratio", "uppercase_ratio",
      r"round(length(regexp_replace(content, '[^\p{Lu}]', '', 'g')) / (length(content) + 1.0)::DOUBLE, 6)")
_text("txt11_repeated_chars", "repeated_chars",
      f"len(list_filter(list_zip({CHARS_SQL}[:-2], {CHARS_SQL}[2:]), lambda x: x[1] = x[2]))")


@check("txt6_msg_entropy", "texts", f"""
WITH chars AS (SELECT log_id, unnest({CHARS_SQL}) AS ch FROM texts),
n AS (SELECT log_id, ch, count(*) AS n FROM chars GROUP BY log_id, ch),
t AS (SELECT log_id, n, sum(n) OVER (PARTITION BY log_id) AS total FROM n)
SELECT log_id, round(-sum(n / total::DOUBLE * log2(n / total::DOUBLE)), 6) AS msg_entropy FROM t GROUP BY log_id""")
def _(v):
    return v.texts.select("log_id", r6(X.entropy("content")).alias("msg_entropy"))


@check("txt10_repeated_words", "texts", r"""
WITH w AS (SELECT log_id, unnest(regexp_extract_all(lower(content), '\S+')) AS w FROM texts),
n AS (SELECT log_id, w, count(*) AS n FROM w GROUP BY log_id, w),
r AS (SELECT log_id, count(*) AS k FROM n WHERE n > 1 GROUP BY log_id)
SELECT t.log_id, coalesce(r.k, 0) AS repeated_words FROM texts t LEFT JOIN r USING (log_id)""")
def _(v):
    return v.texts.select("log_id", X.repeated_words("content").alias("repeated_words"))


@check("txt12_word_length_stats", "texts", f"""
WITH w AS (SELECT log_id, length(unnest({WORDS_SQL})) AS n FROM texts),
s AS (SELECT log_id, avg(n) AS m, stddev_pop(n) AS d FROM w GROUP BY log_id)
SELECT t.log_id, round(coalesce(m, 0), 6) AS mean_length, round(coalesce(d, 0), 6) AS std_length
FROM texts t LEFT JOIN s USING (log_id)""")
def _(v):
    mean, spread = X.word_length_stats("content")
    return v.texts.select("log_id", r6(mean).alias("mean_length"), r6(spread).alias("std_length"))


OPEN, CLOSE = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def _flag_sql(words, col="lower(content)"):
    return f"CASE WHEN regexp_matches({col}, '{OPEN}({words}){CLOSE}') THEN 1 ELSE 0 END"


@check("txt13_error_flags", "texts",
       f"SELECT log_id, {', '.join(f'{_flag_sql(w)} AS {n}' for n, w in X.ERROR_FLAGS.items())} FROM texts")
def _(v):
    return v.texts.select("log_id", *[c.alias(n) for n, c in X.error_flag_columns().items()])


def _source_flag_sql():
    names = sorted({n for flags in X.SOURCE_FLAGS.values() for n in flags})
    out = []
    for name in names:
        cases = " ".join(
            f"WHEN source_type = '{s}' THEN {_flag_sql(flags[name], 'content')}"
            for s, flags in X.SOURCE_FLAGS.items() if name in flags
        )
        out.append(f"CASE {cases} ELSE 0 END AS has_{name}")
    return ", ".join(out)


_KINDS = list(X.SOURCE_FLAGS)


@check("txt14_source_error_flags", "texts", f"""
WITH typed AS (SELECT log_id, content, [{', '.join(f"'{k}'" for k in _KINDS)}][1 + log_id % {len(_KINDS)}] AS source_type FROM texts)
SELECT log_id, source_type, {_source_flag_sql()} FROM typed""")
def _(v):
    # the name with its suffix, as files carry it
    kinds = F.array(*[F.lit(k.capitalize() + "_2k") for k in _KINDS])
    typed = v.texts.select(
        "log_id", "content", canonical_source(F.get(kinds, (F.col("log_id") % len(_KINDS)).cast("int"))).alias("source_type")
    )
    return X.add_source_flags(typed).drop("content")


@check("txt15_export_flags", "tpl", r"""
SELECT log_id, length(content) AS "ContentLength", length(template) AS "TemplateLength",
  regexp_matches(lower(content), 'error|fail|critical|exception')::INT AS "HasError",
  regexp_matches(lower(content), 'auth|login|user|password')::INT AS "HasAuth",
  regexp_matches(lower(content), 'connection|network|timeout')::INT AS "HasNetwork",
  regexp_matches(lower(content), 'system|kernel|process')::INT AS "HasSystem",
  regexp_matches(content, '\d+')::INT AS "HasNumbers",
  regexp_matches(content, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')::INT AS "HasIPAddress" FROM tpl""")
def _(v):
    return v.tpl.select("log_id", *[c.alias(n) for n, c in X.export_flag_columns().items()])


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
# spaces around every other character, so that edge matches never share one
TOKENS_SQL = (
    r"list_sort(list_distinct(list_filter(regexp_extract_all(content, '[\p{L}\p{N}_]+'), "
    rf"lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}') AND NOT list_contains({STOP_SQL}, w))))"
)


@check("txt16_keyword_tokens", "texts", f"SELECT log_id, array_to_string({TOKENS_SQL}, ',') AS tokens FROM texts")
def _(v):
    tokens = F.array_join(F.array_sort(X.keyword_tokens("content")), ",")
    return v.texts.select("log_id", tokens.alias("tokens"))


@check("txt17_masking", "texts", f"SELECT log_id, {mask_sql('content')} AS masked FROM texts")
def _(v):
    return v.texts.select("log_id", X.mask_variables("content").alias("masked"))


@check("txt17_masking_reference_order", "texts", r"""
SELECT log_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\d+', '<NUM>', 'g'),
  '/[^\s]*', '<PATH>', 'g'), '\b[0-9a-fA-F]{8,}\b', '<HEX>', 'g'), '\b\d{2}:\d{2}:\d{2}\b', '<TIME>', 'g') AS masked
FROM texts""")
def _(v):
    return v.texts.select("log_id", X.mask_variables("content", order="reference").alias("masked"))


@check("txt18_structure_features", "texts", r"""
WITH c AS (SELECT log_id, len(regexp_extract_all(content, '\S+')) AS length,
  len(regexp_extract_all(content, '\d+')) + len(regexp_extract_all(content, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'))
  + len(regexp_extract_all(content, '/[^\s]*')) AS wild FROM texts)
SELECT log_id, round((length + wild) / 10.0, 6)::DOUBLE AS rarity, length, wild AS n_wildcards,
  round(1.0 / ((length + wild)::DOUBLE / 10.0 + 1e-6), 6)::DOUBLE AS frequency, 0.5::DOUBLE AS normal_score, 0.5::DOUBLE AS anomaly_score,
  round(length * wild / 10.0::DOUBLE, 6)::DOUBLE AS complexity_score, round((length + wild)::DOUBLE / 10.0 * 0.5, 6)::DOUBLE AS uniqueness_score,
  0.5::DOUBLE AS class_prob_0, 0.5::DOUBLE AS class_prob_1 FROM c""")
def _(v):
    made = X.structure_columns()
    for name in ("rarity", "frequency", "complexity_score", "uniqueness_score"):
        made[name] = r6(made[name])
    return v.texts.select("log_id", *[c.alias(n) for n, c in made.items()])


@check("txt19_text_augmentation")
def _(v):
    return X.augment_text(v.texts, p=0.3, seed=42)


@check("txt19_word_keep_augmentation")
def _(v):
    return X.augment_text(v.texts, p=0.3, seed=42, keep=0.9)
