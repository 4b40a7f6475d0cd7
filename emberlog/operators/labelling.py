"""Weak labels for templates: word scores, suggestions, bulk rules and quality checks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.durable import settle
from emberlog.functions.labels import label_name
from emberlog.functions.text import export_flag_columns, keyword_tokens, normalize_label_text
from emberlog.operators.ordering import attach

# Seed phrases per category, and the label of each category.
SEED_PATTERNS = {
    "security": [
        "authentication failure", "invalid user", "break-in attempt", "failed password", "unauthorized",
        "access denied", "login failed", "permission denied", "security violation", "intrusion",
    ],
    "system": [
        "error", "critical", "fatal", "exception", "crash", "abort", "segmentation fault", "core dump",
        "kernel panic", "died",
    ],
    "performance": [
        "timeout", "slow", "overload", "resource exhausted", "quota exceeded", "memory pressure", "cpu spike",
        "bottleneck", "high latency", "response time",
    ],
    "network": [
        "connection refused", "host unreachable", "network unreachable", "connection timeout", "socket error",
        "dns error", "connection lost", "network down", "packet loss",
    ],
    "config": [
        "configuration error", "config invalid", "parameter error", "setting invalid", "option unknown",
        "syntax error", "parse error", "invalid configuration", "config mismatch",
    ],
    "hardware": [
        "hardware error", "disk error", "i/o error", "device error", "sensor error", "temperature", "voltage",
        "power failure", "component failure", "device timeout",
    ],
}
CATEGORY_LABELS = {"security": 1, "system": 2, "performance": 3, "network": 4, "config": 5, "hardware": 6}

# Words a security label should come with, and words a normal label should not.
SECURITY_WORDS = ["auth", "login", "password", "user", "invalid", "fail", "denied", "unauthorized"]
ERROR_WORDS = ["error", "fail", "critical", "exception", "crash", "fatal"]


def normalized_seed_patterns():
    """Seed phrases with punctuation as blanks, the form they are searched in."""
    tidy = lambda p: " ".join("".join(ch if ch.isalnum() else " " for ch in p.lower()).split())
    return {k: sorted({tidy(p) for p in ps}) for k, ps in SEED_PATTERNS.items()}


def expand_patterns(spark, synonyms=None):
    """(category, label, phrase): seed phrases, widened by a (phrase, synonym) table if given."""
    seeds = spark.createDataFrame(
        [(k, CATEGORY_LABELS[k], p) for k, ps in SEED_PATTERNS.items() for p in ps], "category string, label int, phrase string"
    ).withColumn("phrase", normalize_label_text("phrase"))
    if synonyms is None:
        return seeds.distinct()
    more = synonyms.select(normalize_label_text("phrase").alias("phrase"), normalize_label_text("synonym").alias("synonym"))
    wider = seeds.join(more, "phrase").select("category", "label", F.col("synonym").alias("phrase"))
    return seeds.unionByName(wider).distinct()


def _tokens(text, samples):
    full = normalize_label_text(text)
    if samples:
        parts = F.transform(F.col(samples), lambda s: normalize_label_text(s))
        full = F.concat_ws(" ", full, F.array_join(parts, " "))
    return keyword_tokens(full)


def with_words(items, text="template", samples=None):
    """Items with their keyword tokens in ``_words``, which the operators below then read instead of the texts."""
    return items.withColumn("_words", _tokens(text, samples))


def _words_of(items, text, samples):
    return F.col("_words") if "_words" in items.columns else _tokens(text, samples)


def item_words(items, text="template", samples=None):
    """(item columns, word): distinct keyword tokens of template and samples."""
    return items.withColumn("word", F.explode(_words_of(items, text, samples))).drop("_words")


FOLD = 500_000  # words of items that a task folds at a time


def word_scores(items, order="item", alpha=1.0, beta=0.2, text="template", samples=None, label="label", n="n"):
    """(word, label, score) learnt from labelled items in order.

    An item adds alpha * n to its label for each of its words and shrinks the word's
    other labels by 1 - beta. Closed form: a contribution shrinks once for every later
    item of the word with another label.
    """
    return _fold_words(_labelled_words(items, text, samples, label, n, order), alpha, beta)


def _labelled_words(items, text, samples, label, n, order):
    known = items.filter(F.col(label).isNotNull())
    # written before anything looks at the words: a filter or an explode on them would find them anew
    return settle(known.select(
        _words_of(items, text, samples).alias("_words"), F.col(label).alias("label"), F.col(n).cast("double").alias("n"), F.col(order).alias("_order"),
    ), packed=True)


def _fold_words(rows, alpha, beta):
    """Items stay whole and are cut into slices of their order, of about FOLD words each. Of a slice only a
    score and a count per word and label travel on; a slice's scores shrink by what later slices count."""
    rows = rows.filter(F.size("_words") > 0)
    words = rows.agg(F.sum(F.size("_words"))).first()[0] or 0
    # equal orders are told apart by a digest, so that they are spread as well; a slice is one partition of the sort
    order = ["_order", "_tie"]
    placed = rows.withColumn("_tie", F.xxhash64("label", "n", "_words")).repartitionByRange(-(-words // FOLD) or 1, *order).sortWithinPartitions(*order)
    placed = placed.select("label", "n", "_words", F.spark_partition_id().cast("long").alias("_slice"))

    def behind(code):
        """How many later rows have the code of a row."""
        by_code = np.argsort(code, kind="stable")
        n = np.bincount(code)
        n = n[n > 0]
        out = np.empty(len(code), dtype=np.int64)
        out[by_code] = np.repeat(np.cumsum(n), n) - 1 - np.arange(len(code))
        return out

    def fold(batches):
        held = [pdf for pdf in batches if len(pdf)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True)
        at = np.repeat(np.arange(len(pdf)), pdf["_words"].map(len))
        word, names = pd.factorize(np.concatenate(pdf["_words"].to_numpy()))
        mark, labels = pd.factorize(pdf["label"])
        pair, pairs = pd.factorize(word * len(labels) + mark[at])
        shrunk = pdf["n"].to_numpy(dtype=float)[at] * (1.0 - beta) ** (behind(word) - behind(pair))
        known = ~np.isnan(shrunk)
        score = np.bincount(pair, np.where(known, shrunk, 0.0))
        yield pd.DataFrame({
            "word": names[pairs // len(labels)], "label": labels[pairs % len(labels)], "_slice": pdf["_slice"].iloc[0],
            "_score": np.where(np.bincount(pair, known) > 0, score, np.nan), "_same": np.bincount(pair)})

    kind = rows.schema["label"].dataType.simpleString()
    # written once: a second evaluation could draw other range bounds
    parts = settle(placed.mapInPandas(fold, f"word string, label {kind}, _slice long, _score double, _same long"), packed=True)
    after = Window.partitionBy("word").orderBy(F.desc("_slice")).rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("word", "label").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.sum("_same").over(after), F.lit(0)) - F.coalesce(F.sum("_same").over(own), F.lit(0))
    return parts.withColumn("_later", later).groupBy("word", "label").agg(
        F.sum(F.lit(float(alpha)) * F.col("_score") * F.pow(F.lit(1.0 - beta), "_later")).alias("score"))


def pattern_stats(items, text="template", samples=None, label="label", n="n", source="source"):
    """Keywords, templates, sources and logs behind every label."""
    known = items.filter(F.col(label).isNotNull())
    words = item_words(known, text, samples).select(F.col(label).alias("label"), "word").distinct()
    base = known.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("templates"), F.countDistinct(source).alias("sources"), F.sum(n).alias("logs")
    )
    return attach(base, words.groupBy("label").agg(F.count("*").alias("keywords")), ["label"])


def apply_feedback(items, feedback, alpha=1.0, beta=0.2, order="item", text="template", label="label", n="n"):
    """Scores after corrections: feedback rows follow the items in order and count once.

    Also counts how often a label was chosen for a word, and how often another one was.
    """
    last = items.agg(F.max(order).alias("m")).first()["m"] or 0
    given = [_words_of(df, text, None).alias("_words") for df in (items, feedback)]
    later = feedback.select(given[1], F.col(label), F.lit(1).cast("long").alias(n), (F.col(order) + F.lit(last + 1)).alias(order))
    every = _labelled_words(items.select(given[0], label, n, order).unionByName(later), text, None, label, n, order)
    scores = _fold_words(every, alpha, beta)
    words = every.select(F.explode("_words").alias("word"), "label", F.col("_order").alias("o"))
    first = words.groupBy("word", "label").agg(F.min("o").alias("first"))
    given = words.filter(F.col("o") > last)
    positive = given.groupBy("word", "label").agg(F.count("*").alias("positive"))
    chosen = given.select("word", F.col("label").alias("chosen"), "o")
    # a word has at most eight labels, so a correction meets at most eight rows here
    negative = chosen.join(first, "word").filter((F.col("chosen") != F.col("label")) & (F.col("o") > F.col("first")))
    negative = negative.groupBy("word", "label").agg(F.count("*").alias("negative"))
    out = attach(attach(scores, positive, ["word", "label"]), negative, ["word", "label"])
    return out.na.fill(0, ["positive", "negative"])


def _margin(scores, key):
    """Best and second score per item; ties go to the lower label."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "label")
    ranked = scores.withColumn("rn", F.row_number().over(order)).filter("rn <= 2")
    return ranked.groupBy(key).agg(
        F.max(F.when(F.col("rn") == 1, F.col("label"))).alias("suggested"),
        F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("best"),
        F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("second"),
    )


def confidence_tier(best, margin):
    return F.when((best >= 2.0) & (margin >= 0.5), "high").when((best >= 1.0) & (margin >= 0.2), "medium").otherwise("low")


def pattern_hits(words, scores, key="item", idf=None):
    """Pattern-library join: per item and label the summed shares of the words it holds, a row each or in ``_words``.

    The share of a label in a word is its part of the word's scores, times the word's ``idf`` if given.
    """
    share = scores.withColumn("_total", F.sum("score").over(Window.partitionBy("word"))).filter("_total > 0")
    share = share.select("word", "label", (F.col("score") / F.col("_total")).alias("share"))
    if idf is not None:
        share = attach(share, idf.select(F.col("term").alias("word"), "idf"), ["word"])
        share = share.withColumn("share", F.col("share") * F.coalesce("idf", F.lit(1.0))).drop("idf")
    items = words.select(key, "_words") if "_words" in words.columns else words.select(key, F.array("word").alias("_words"))
    return _hits_by_blocks(items, share, key)


HIT_WORDS = 2_000_000  # words of items that a task matches at a time
SEP = "\u0001"  # between the words of an item, which travel as one text


def _hits_by_blocks(items, share, key):
    """(key, label, score): items go by blocks, and to a block each of its different words once, with its shares of all labels."""
    found = items.agg(F.sum(F.size("_words"))).first()[0] or 0
    block = F.pmod(F.xxhash64(key), F.lit(max(1, -(-max(found, 0) // HIT_WORDS)))).cast("int")
    placed = items.filter(F.size("_words") > 0).select(block.alias("_block"), key, "_words")
    by_word = settle(share.groupBy("word").agg(F.collect_list(F.struct("label", "share")).alias("_shares")))
    wanted = placed.select("_block", F.explode("_words").alias("word")).distinct().join(by_word, "word")
    wanted = wanted.select(*[F.col(c).alias(c) for c in wanted.columns])  # columns of their own, to be cogrouped with what they came from
    kind, number = (df.schema[c].dataType.simpleString() for df, c in ((items, key), (share, "label")))

    def match(left, right):
        shares = right.column("_shares").combine_chunks()
        label, part = (pc.struct_field(pc.list_flatten(shares), n) for n in ("label", "share"))
        marks = label.dictionary_encode(null_encoding="encode")
        marks, names = marks.indices.to_numpy(zero_copy_only=False).astype(np.int64), marks.dictionary
        part = part.to_numpy(zero_copy_only=False)
        many = pc.list_value_length(shares).to_numpy(zero_copy_only=False)
        start = np.cumsum(many) - many
        ids = left.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        held = pc.split_pattern(left.column("_words").combine_chunks(), SEP)
        at = np.repeat(ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(held).to_numpy(zero_copy_only=False))
        word = pc.fill_null(pc.index_in(pc.list_flatten(held), value_set=right.column("word").combine_chunks()), -1).to_numpy(zero_copy_only=False)
        at, word = at[word >= 0], word[word >= 0]
        each = many[word]
        from_ = np.repeat(start[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        pair, pairs = pd.factorize(np.repeat(at, each) * max(1, len(names)) + marks[from_])
        known = ~np.isnan(part[from_])
        score = np.bincount(pair, np.where(known, part[from_], 0.0), minlength=len(pairs))
        none = np.bincount(pair, known, minlength=len(pairs)) == 0
        return pa.table({
            key: ids.dictionary.take(pa.array(pairs // max(1, len(names)))), "label": names.take(pa.array(pairs % max(1, len(names)))),
            "score": pa.array(score, pa.float64(), mask=none)})

    packed = placed.withColumn("_words", F.array_join("_words", SEP))
    return packed.groupBy("_block").cogroup(wanted.groupBy("_block")).applyInArrow(match, f"{key} {kind}, label {number}, score double")


def suggest_labels(templates, scores, idf=None, cosines=None, probabilities=None, key="item", text="template", samples=None):
    """suggested, best score and confidence per template.

    ``scores`` come from word_scores; optional evidence: (term, idf), (key, label, cosine)
    and (key, label, probability).
    """
    found = _words_of(templates, text, samples)
    words = templates.select(key, found.alias("_words"))
    if samples:
        # the text stays in its own row; it is not copied to every word
        inside = F.get(F.transform(
            F.array(normalize_label_text(text)), lambda t: F.size(F.filter(found, lambda w: F.instr(t, w) > 0))
        ), F.lit(0))
    else:
        inside = F.size(found)  # the words of a text all lie in it
    lift = templates.select(key, F.pow(F.lit(1.1), inside).alias("lift"))
    evidence = pattern_hits(words, scores, key, idf)
    evidence = attach(evidence, lift, [key]).select(key, "label", (F.col("score") * F.col("lift")).alias("score"))
    if cosines is not None:
        evidence = settle(evidence)
        top = evidence.groupBy(key).agg(F.max("score").alias("_top"))
        sims = attach(cosines.filter("cosine > 0").select(key, "label", "cosine"), top, [key])
        weight = F.when(F.col("_top").isNull(), 1.0).when(F.col("_top") < 1.0, 0.75)
        more = sims.withColumn("score", F.col("cosine") * weight).filter("score IS NOT NULL").select(key, "label", "score")
        evidence = evidence.unionByName(more)
    if probabilities is not None:
        evidence = evidence.unionByName(
            probabilities.select(key, "label", (F.col("probability") * 1.25).alias("score"))
        )
    total = evidence.groupBy(key, "label").agg(F.sum("score").alias("score"))
    best = attach(templates.drop("_words"), _margin(total, key), [key])
    margin = F.col("best") - F.coalesce("second", F.lit(0.0))
    return best.withColumns({
        "confidence": F.coalesce(confidence_tier(F.col("best"), margin), F.lit("low")),
        "suggested": F.coalesce("suggested", F.lit(0)),
        "best": F.coalesce("best", F.lit(0.0)),
    }).drop("second")


def auto_label(items):
    """High-confidence suggestions become labels where none is set."""
    take = F.col("label").isNull() & (F.col("confidence") == "high")
    return items.withColumns({
        "label": F.when(take, F.col("suggested")).otherwise(F.col("label")),
        "notes": F.when(take, F.lit("Auto-labeled (high confidence)")).otherwise(F.col("notes")),
    })


def bulk_label(items, accept=(), rest=None):
    """Open items take suggestions listed in ``accept``; the remainder becomes ``rest`` (0 or 7) if given."""
    open_ = F.col("label").isNull()
    yes = open_ & F.col("suggested").isin(list(accept)) if accept else F.lit(False)
    label = F.when(yes, F.col("suggested"))
    notes = F.when(yes, F.lit("Bulk labeled by suggestion"))
    if rest is not None:
        label = label.when(open_, F.lit(rest))
        notes = notes.when(open_, F.lit({0: "Bulk: Default normal", 7: "Bulk: Default unknown anomaly"}[rest]))
    return items.withColumns({
        "label": label.otherwise(F.col("label")), "notes": notes.otherwise(F.col("notes"))
    })


def validate_labels(items, key="template", samples="samples"):
    """(item, issue) rows for labels that look wrong; an item may have several."""
    content = F.lower(F.array_join(samples, " "))
    has = lambda words: reduce(lambda a, b: a | b, [content.contains(w) for w in words])
    known = items.filter(F.col("label").isNotNull())
    rules = [
        ("security_without_keywords", (F.col("label") == 1) & ~has(SECURITY_WORDS)),
        ("normal_with_error_words", (F.col("label") == 0) & has(ERROR_WORDS)),
        ("frequent_anomaly", (F.col("label") > 0) & (F.col("percent") > 15)),
    ]
    found = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull())
    return known.select("source", key, "label", F.explode(found).alias("issue"))


def completion_gate(items, issues, by="source"):
    """Template completion, log coverage, issues, and whether a source needs review."""
    done = F.col("label").isNotNull()
    figures = items.groupBy(by).agg(
        F.avg(F.when(done, 1.0).otherwise(0.0)).alias("completion"),
        (F.sum(F.when(done, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"),
    )
    counts = issues.groupBy(by).agg(F.count("*").alias("issues"))
    out = attach(figures, counts, [by]).withColumn("issues", F.coalesce("issues", F.lit(0)))
    return out.withColumn(
        "gate",
        F.when(F.col("completion") < 0.7, "incomplete").when(F.col("issues") > 5, "review").otherwise("complete"),
    )


def export_training(logs, frac=0.8, seed=42, content="content", template="template", label="label", key="log_id"):
    """Labelled rows with text flags and an 80/20 part column."""
    from emberlog.operators.sampling import stratified_split

    known = logs.filter(F.col(label) >= 0)
    parts = stratified_split(known, frac, seed, label, key)
    return parts.select(
        key, content, template, *[c.alias(n) for n, c in export_flag_columns(content, template).items()], "source", label, "part"
    )
