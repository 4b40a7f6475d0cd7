"""License scans: MinHash bands over overlapping windows retrieve templates, shingles verify.

Templates are grouped by their number of words L. Windows of a document start every
L/4 words and are a quarter longer than L, so each run of L words lies within one. Only
windows that share a shingle with some template can contain one; these are found by a
lookup, and 64 bands of two MinHash values retrieve templates for them. At the least
similarity that a match can have (about 0.5, from the containment threshold and the
overhang), the bands miss it with probability (1 - 0.5^2)^64 < 2e-8. A retrieved template
counts if the window holds at least 80 % of its distinct five-word shingles.

Words are runs of letters, digits and non-ASCII characters in lower case. Nulls and texts of
fewer than five words match nothing. Matches are reported per id and license, so repeated
rows of an id add up. Templates need five words; their table is small by its nature and
joined by the size that Spark sees.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.llm.base import query, table
from emberlog.llm.decontamination import folded_words

WIDTH = 5
BANDS, ROWS = 64, 2
PERCENT = 80

#: Notices as their licenses word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]


def template_table(spark, templates=None):
    """``license``, ``words`` (count L), ``shingles`` of every template of at least five words."""
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES if templates is None else templates)]
    made = spark.createDataFrame(rows, "template int, license string, text string")
    made = made.withColumn("_w", folded_words(F.col("text"))).filter(F.size("_w") >= WIDTH)
    return settle(made.select("template", "license", F.size("_w").alias("words"), F.array_distinct(_shingles("_w")).alias("shingles")))


def _shingles(words):
    return F.expr(f"transform(slice({words}, 1, greatest(size({words}) - {WIDTH - 1}, 0)), (x, i) -> xxhash64(slice({words}, i + 1, {WIDTH})))")


def with_bands(df, shingles):
    """One row per band; its hash is made from the ROWS minima that belong to it."""
    minima = ", ".join(f"array_min(transform({shingles}, x -> xxhash64(x, b * {ROWS} + {r})))" for r in range(ROWS))
    return df.withColumn("_band", F.explode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, {minima}))")))


def scan(docs, templates, id="doc_id", text="text", percent=PERCENT):
    """One row per ``id`` and license: ``share`` (percent of the best match), ``first_word`` of the first matching window, ``windows``."""
    step = F.greatest(F.floor(F.col("words") / 4), F.lit(1)).cast("int")
    known = templates.select("words", F.explode("shingles").alias("known")).distinct()
    probes = docs.select(F.col(id).alias("_id"), F.xxhash64(text).alias("_text"), folded_words(F.col(text)).alias("_words"))
    probes = probes.select("_id", "_text", _shingles("_words").alias("_sh"))
    # the outer form keeps Spark from inferring a filter that would split the text again for every shingle
    probes = probes.select("_id", "_text", "_sh", F.posexplode_outer("_sh").alias("_at", "_one"))
    near = probes.join(known, F.col("_one") == F.col("known")).withColumn("_step", step)
    held = F.col("words") + F.col("_step") - WIDTH  # shingles of a window
    first = F.greatest(F.ceil((F.col("_at") - held + 1) / F.col("_step")), F.lit(0)).cast("int")
    near = near.withColumn("_k", F.explode(F.sequence(first, F.floor(F.col("_at") / F.col("_step")).cast("int"))))
    windows = near.withColumn("_in", F.slice("_sh", F.col("_k") * F.col("_step") + 1, held)).groupBy(
        "_id", "_text", "words", "_k").agg(F.first("_in").alias("_in"), F.first("_step").alias("_step"))
    banded = with_bands(templates, "shingles").select("template", F.col("words").alias("_w"), F.col("_band").alias("_b"))
    found = with_bands(windows, "_in").join(banded, (F.col("words") == F.col("_w")) & (F.col("_band") == F.col("_b")))
    found = found.groupBy("_id", "_text", "words", "_k", "template").agg(F.first("_in").alias("_in"), F.first("_step").alias("_step"))
    verified = found.join(templates.select("template", "license", "shingles"), "template")
    both, size = F.size(F.array_intersect("_in", "shingles")), F.size("shingles")
    verified = verified.withColumn("_share", F.floor(100 * both / size)).filter(100 * both >= percent * size)
    return verified.groupBy(F.col("_id").alias(id), "license").agg(
        F.max("_share").cast("long").alias("share"),
        F.min(F.col("_k") * F.col("_step")).cast("long").alias("first_word"),
        F.countDistinct("_text", "words", "_k").cast("long").alias("windows"),
    )


def _sql():
    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
    split = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH t(template, license, text) AS (VALUES {values}),
tw AS (SELECT template, license, {split} AS w FROM t),
tp AS (SELECT template, license, len(w) AS words, w, unnest(range(1, len(w) - 3)) AS i FROM tw WHERE len(w) >= 5),
ts AS (SELECT DISTINCT template, license, words, greatest(words // 4, 1) AS step, array_to_string(w[i:i + 4], ' ') AS g FROM tp),
tn AS (SELECT template, count(*) AS size FROM ts GROUP BY 1),
dw AS (SELECT doc_id, {split} AS w FROM documents),
dp AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM dw WHERE len(w) >= 5),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS g FROM dp),
h AS (SELECT doc_id, pos, dg.g, template, license, words, step FROM dg JOIN ts ON ts.g = dg.g),
k AS (SELECT *, unnest(range(greatest(ceil((pos - (words + step - 5) + 1) / step), 0)::BIGINT, pos // step + 1)) AS k FROM h),
c AS (SELECT doc_id, template, license, words, step, k, count(DISTINCT g) AS n FROM k GROUP BY ALL)
SELECT doc_id, license, max(100 * n // size)::BIGINT AS share, min(k * step)::BIGINT AS first_word, count(DISTINCT (words, k))::BIGINT AS windows
FROM c JOIN tn USING (template) WHERE 100 * n >= 80 * size GROUP BY doc_id, license
"""


@query("op6_license_scan", _sql())
def op6_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), template_table(spark))
