"""Text columns from built-in expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
EDGE_BEFORE = rf"(?<!{WORD})"
EDGE_AFTER = rf"(?!{WORD})"

# Flag name and the words it looks for in lower-cased text.
ERROR_FLAGS = {
    "has_error_level": "error|critical|alert|emergency",
    "has_warning": "warning|warn",
    "has_timeout": "timeout|timed out",
    "has_connection": "connection|connect|disconnect|unreachable",
    "has_memory": "memory|oom|out of memory",
    "has_disk": "disk|storage|space|quota",
    "has_network": "network|socket|port",
    "has_auth": "auth|authentication|login|password|access denied",
    "has_permission": "permission|denied|forbidden|unauthorized",
    "has_null": "null|none|nil|nullptr",
    "has_exception": "exception|throw|thrown|stacktrace",
    "has_failure": "fail|failed|failure",
    "has_security": "attack|intrusion|breach|hack|malicious",
    "has_performance": "slow|latency|performance|bottleneck",
    "has_config": "config|configuration|setting|property",
}

# Per source type, flag name and the words it looks for, case kept.
SOURCE_FLAGS = {
    "apache": {
        "error_level": "error|critical|alert|emergency",
        "http_error": "40[0-9]|50[0-9]",
        "security_threat": "attack|intrusion|unauthorized|forbidden|hack",
        "resource_issue": "timeout|memory|disk|space|limit",
    },
    "linux": {
        "kernel_panic": "kernel|panic|oops|segfault|core dump",
        "auth_failure": "authentication failed|login failed|access denied",
        "resource_exhaustion": "out of memory|disk full|no space|quota exceeded",
        "hardware_error": "hardware|disk error|i/o error|bad sector",
    },
    "hadoop": {
        "job_failure": "job failed|task failed|exception|error",
        "performance_issue": "slow|timeout|latency|performance",
        "network_problem": "connection|unreachable|network|socket",
        "config_error": "configuration|config|property|setting",
    },
    "openssh": {
        "security_breach": "failed password|invalid user|break-in|attack",
        "connection_issue": "connection closed|timeout|refused",
    },
    "bgl": {
        "system_failure": "failure|failed|error|exception",
        "hardware_issue": "hardware|disk|memory|cpu|node",
        "config_error": "config|configuration|parameter",
    },
    "hdfs": {
        "system_failure": "block|replica|datanode|namenode|error",
        "network_problem": "connection|network|timeout",
    },
    "hpc": {
        "system_failure": "node|job|task|error|failure",
        "performance_issue": "slow|performance|latency|timeout",
        "network_problem": "network|connection|communication",
        "hardware_issue": "hardware|memory|disk|cpu",
    },
    "proxifier": {
        "network_anomaly": "connection|proxy|tunnel|network",
    },
    "zookeeper": {
        "system_failure": "error|exception|failure",
        "performance_issue": "timeout|slow|latency",
        "network_problem": "connection|network|socket",
        "config_error": "config|configuration|property",
    },
}

# Words left out of keyword tokens.
STOP_WORDS = ["the", "and", "for", "are", "with", "this", "that", "from", "was", "not"]

# Words behind the export flags.
EXPORT_FLAGS = {
    "HasError": "error|fail|critical|exception",
    "HasAuth": "auth|login|user|password",
    "HasNetwork": "connection|network|timeout",
    "HasSystem": "system|kernel|process",
}

# Mask tokens and the text they stand for.
MASKS = {
    "<UUID>": r"[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}",
    "<IP>": EDGE_BEFORE + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + EDGE_AFTER,
    "<DATE>": EDGE_BEFORE + r"\d{4}-\d{2}-\d{2}" + EDGE_AFTER,
    "<TIME>": EDGE_BEFORE + r"\d{2}:\d{2}:\d{2}" + EDGE_AFTER,
    "<PATH>": r"/[^\s]*",
    "<HEX>": EDGE_BEFORE + r"[0-9a-fA-F]{8,}" + EDGE_AFTER,
    "<NUM>": r"\d+",
}
MASK_ORDER = {
    "specific_first": ["<UUID>", "<IP>", "<DATE>", "<TIME>", "<PATH>", "<HEX>", "<NUM>"],
    "reference": ["<NUM>", "<UUID>", "<IP>", "<PATH>", "<HEX>", "<DATE>", "<TIME>"],
}


def _column(c):
    return F.col(c) if isinstance(c, str) else c


def _replace_all(col, steps):
    for pattern, token in steps:
        col = F.regexp_replace(col, pattern, token)
    return col


def _bounded(words):
    return f"{EDGE_BEFORE}({words}){EDGE_AFTER}"


def normalize_log_text(col):
    """Lower-case text with variable parts as tokens; a token's letters stay upper-case."""
    out = _replace_all(
        F.lower(_column(col)),
        [
            (r"[0-9a-f]{8,}", "<HEX>"),
            (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"),
            (MASKS["<DATE>"], "<DATE>"),
            (MASKS["<TIME>"], "<TIME>"),
            (r"\d+", "<NUM>"),
            (r"[^\p{L}\p{N}_\s<>]", " "),
            (r"\s+", " "),
        ],
    )
    return F.trim(out)


def normalize_label_text(col):
    """Form used to compare label words: digits become num, punctuation one blank."""
    out = _replace_all(F.lower(_column(col)), [(r"\d+", "<num>"), (r"[^\p{L}\p{N}]+", " ")])
    return F.trim(out)


def words(col):
    return F.regexp_extract_all(_column(col), F.lit(r"\S+"), 0)


def characters(col):
    """Single characters; empty text gives no characters."""
    c = _column(col)
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def word_count(col):
    return F.regexp_count(_column(col), F.lit(r"\S+"))


def entropy(col):
    """Shannon entropy of characters, base 2.

    The sorted characters fall into runs of equal ones, so the lambda steps once per
    distinct character and not once per character.
    """
    c = F.coalesce(_column(col), F.lit(""))
    size = F.length(c).cast("double")
    runs = F.regexp_extract_all(F.array_join(F.sort_array(characters(c)), ""), F.lit(r"(?s)(.)\1*"), 0)
    shares = F.transform(F.transform(runs, lambda r: F.length(r)), lambda n: n / size)
    return F.when(size == 0, F.lit(0.0)).otherwise(
        F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    )


def _ratio(col, pattern):
    """Share of the characters left after removing ``pattern``, over length + 1."""
    c = F.coalesce(_column(col), F.lit(""))
    return F.length(F.regexp_replace(c, pattern, "")) / (F.length(c) + 1)


def repeated_words(col):
    """Lower-cased words that occur more than once."""
    start = F.struct(F.lit("").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("hits"))

    def step(acc, w):
        again = acc["prev"] == w
        run = F.when(again, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("prev"), run.alias("run"),
                        (acc["hits"] + F.when(run == 2, 1).otherwise(0)).alias("hits"))

    ordered = F.sort_array(words(F.lower(F.coalesce(_column(col), F.lit("")))))
    return F.aggregate(ordered, start, step, lambda acc: acc["hits"])


def repeated_chars(col):
    """Adjacent equal pairs: a character goes when the same one follows it."""
    c = F.coalesce(_column(col), F.lit(""))
    return F.length(c) - F.length(F.regexp_replace(c, r"(?s)(.)(?=\1)", ""))


def text_columns(content="content"):
    c = F.coalesce(_column(content), F.lit(""))
    return {
        "msg_length": F.length(c),
        "msg_word_count": word_count(c),
        "msg_unique_chars": F.size(F.array_distinct(characters(c))),
        "msg_entropy": entropy(c),
        "special_char_ratio": _ratio(c, r"[\p{L}\p{N}\s]"),
        "number_ratio": _ratio(c, r"[^\p{Nd}]"),
        "uppercase_ratio": _ratio(c, r"[^\p{Lu}]"),
        "repeated_words": repeated_words(c),
        "repeated_chars": repeated_chars(c),
    }


def add_text_features(df, content="content"):
    return df.withColumns(text_columns(content))


def word_length_stats(col):
    """Mean and population std of word lengths, 0 without words."""
    lengths = F.transform(words(F.coalesce(_column(col), F.lit(""))), lambda w: F.length(w))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    sums = F.aggregate(
        lengths, start,
        lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"),
                              (a["q"] + x.cast("double") * x).alias("q")),
    )
    mean = F.coalesce(F.try_divide(sums["s"], sums["n"]), F.lit(0.0))
    spread = F.coalesce(F.try_divide(sums["q"], sums["n"]), F.lit(0.0)) - mean * mean
    return mean, F.sqrt(F.greatest(spread, F.lit(0.0)))


def error_flag_columns(content="content"):
    low = F.lower(F.coalesce(_column(content), F.lit("")))
    return {name: low.rlike(_bounded(w)).cast("int") for name, w in ERROR_FLAGS.items()}


def add_error_flags(df, content="content"):
    return df.withColumns(error_flag_columns(content))


def source_flag_columns(content="content", source_type="source_type"):
    """One has_* column per flag name; 0 where the source type does not know the flag."""
    c, kind = _column(content), _column(source_type)
    names = sorted({n for flags in SOURCE_FLAGS.values() for n in flags})
    out = {}
    for name in names:
        col = None
        for source, flags in SOURCE_FLAGS.items():
            if name in flags:
                hit = c.rlike(_bounded(flags[name])).cast("int")
                col = F.when(kind == source, hit) if col is None else col.when(kind == source, hit)
        out[f"has_{name}"] = F.coalesce(col, F.lit(0))
    return out


def add_source_flags(df, content="content", source_type="source_type"):
    return df.withColumns(source_flag_columns(content, source_type))


def export_flag_columns(content="content", template="template"):
    c = _column(content)
    out = {
        "ContentLength": F.length(c),
        "TemplateLength": F.length(_column(template)),
    }
    for name, pattern in EXPORT_FLAGS.items():
        out[name] = F.lower(c).rlike(pattern).cast("int")
    out["HasNumbers"] = c.rlike(r"\d+").cast("int")
    out["HasIPAddress"] = c.rlike(
        EDGE_BEFORE + r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}" + EDGE_AFTER
    ).cast("int")
    return out


def add_export_flags(df, content="content", template="template"):
    return df.withColumns(export_flag_columns(content, template))


def keyword_tokens(col):
    """Distinct ASCII words of three or more letters without stop words."""
    found = F.regexp_extract_all(_column(col), F.lit(f"{EDGE_BEFORE}[a-zA-Z]{{3,}}{EDGE_AFTER}"), 0)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def mask_variables(col, order="specific_first"):
    return _replace_all(_column(col), [(MASKS[t], t) for t in MASK_ORDER[order]])


def structure_columns(content="content"):
    """Ten template-like numbers for a line whose template is not known."""
    c = F.coalesce(_column(content), F.lit(""))
    wild = (
        F.regexp_count(c, F.lit(r"\d+"))
        + F.regexp_count(c, F.lit(MASKS["<IP>"]))
        + F.regexp_count(c, F.lit(MASKS["<PATH>"]))
    )
    length = word_count(c)
    rarity = (length + wild) / 10.0
    half = F.lit(0.5)
    return {
        "rarity": rarity,
        "length": length,
        "n_wildcards": wild,
        "frequency": 1.0 / (rarity + F.lit(1e-6)),
        "normal_score": half,
        "anomaly_score": half,
        "complexity_score": length * wild / 10.0,
        "uniqueness_score": rarity * 0.5,
        "class_prob_0": half,
        "class_prob_1": half,
    }


def add_structure_features(df, content="content"):
    return df.withColumns(structure_columns(content))


def augment_text(df, p=0.3, seed=42, content="content", label="label", log_id="log_id", keep=None):
    """Augmented copies of minority rows, repeatable by (log_id, seed).

    A share ``p`` of the rows with label 1 and more than three words loses a tenth of
    its words, has two words swapped, or one masked. ``keep`` switches to the second
    form, which keeps every word with that probability.
    """
    from emberlog.operators.draws import uniform

    w = words(content)
    base = (
        df.filter((F.col(label) == 1) & (uniform(log_id, seed=seed) < p))
        .withColumn("_w", w)
        .filter(F.size("_w") > 3)
        .withColumn("_n", F.size("_w"))
    )
    mark = lambda i, tag: F.xxhash64(F.col(log_id), F.lit(seed), F.lit(tag), i)
    if keep is not None:
        cut = F.lit(int(keep * 1000))
        kept = F.filter("_w", lambda x, i: F.pmod(mark(i, "keep"), F.lit(1000)) < cut)
        return base.withColumn(content, F.array_join(kept, " ")).drop("_w", "_n")
    spot = F.pmod(mark(F.lit(0), "spot"), F.col("_n")).cast("int")
    other = F.pmod(spot + 1 + F.pmod(mark(F.lit(1), "other"), F.col("_n") - 1), F.col("_n")).cast("int")
    base = base.withColumns({
        "_kind": F.pmod(mark(F.lit(2), "kind"), F.lit(3)),
        "_a": spot,
        "_b": other,
        "_drop": F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1).cast("int")),
    })
    scored = F.array_sort(F.transform("_w", lambda x, i: F.struct(mark(i, "drop").alias("h"), i.alias("i"))))
    dropped = F.transform(F.slice(scored, F.lit(1), F.col("_drop")), lambda s: s["i"])
    base = base.withColumn("_gone", F.when((F.col("_kind") == 0) & (F.col("_n") > 5), dropped))
    result = (
        F.when(F.col("_gone").isNotNull(), F.filter("_w", lambda x, i: ~F.array_contains(F.col("_gone"), i)))
        .when(
            F.col("_kind") == 1,
            F.transform("_w", lambda x, i: F.when(i == F.col("_a"), F.get("_w", F.col("_b")))
                        .when(i == F.col("_b"), F.get("_w", F.col("_a"))).otherwise(x)),
        )
        .when(F.col("_kind") == 2, F.transform("_w", lambda x, i: F.when(i == F.col("_a"), F.lit("<MASK>")).otherwise(x)))
        .otherwise(F.col("_w"))
    )
    return base.withColumn(content, F.array_join(result, " ")).drop("_w", "_n", "_kind", "_a", "_b", "_drop", "_gone")
