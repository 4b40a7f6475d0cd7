"""Label and source-name columns."""

from __future__ import annotations

from pyspark.sql import functions as F

# Label numbers and names.
LABEL_NAMES = {
    0: "normal",
    1: "security_anomaly",
    2: "system_failure",
    3: "performance_issue",
    4: "network_anomaly",
    5: "config_error",
    6: "hardware_issue",
    7: "unknown_anomaly",
}
BINARY_NAMES = {0: "normal", 1: "anomaly"}

# Substrings of a file name and the source type they mean, first hit wins.
NAME_RULES = [
    ("android", "android"),
    ("apache", "apache"),
    ("bgl", "bgl"),
    ("hadoop", "hadoop"),
    ("hdfs", "hdfs"),
    ("health", "healthapp"),
    ("hpc", "hpc"),
    ("linux", "linux"),
    ("mac", "mac"),
    ("openssh", "openssh"),
    ("openstack", "openstack"),
    ("proxifier", "proxifier"),
    ("spark", "spark"),
    ("thunderbird", "thunderbird"),
    ("windows", "windows"),
    ("zookeeper", "zookeeper"),
    ("zookeper", "zookeeper"),
]

# Words in a log line and the source type they mean, first hit wins.
TEXT_RULES = [
    ("apache", "apache"),
    ("httpd", "apache"),
    ("sshd", "openssh"),
    ("ssh", "openssh"),
    ("kernel", "linux"),
    ("systemd", "linux"),
    ("hdfs", "hdfs"),
    ("datanode", "hdfs"),
    ("hadoop", "hadoop"),
    ("android", "android"),
]


def _column(c):
    return F.col(c) if isinstance(c, str) else c


def _first_hit(col, rules):
    low = F.lower(_column(col))
    word, name = rules[0]
    out = F.when(low.contains(word), name)
    for word, name in rules[1:]:
        out = out.when(low.contains(word), name)
    return out.otherwise("unknown")


def source_type_from_name(col):
    return _first_hit(col, NAME_RULES)


def source_type_from_text(col):
    return _first_hit(col, TEXT_RULES)


def canonical_source(col):
    """Apache_2k -> apache."""
    return F.lower(F.regexp_replace(_column(col), "_2k$", ""))


def binarize_label(col, mode="ingest"):
    """ingest: clip to 0..6, then > 0. feature: values outside 0..6 count as normal."""
    label = F.coalesce(_column(col), F.lit(0))
    if mode == "ingest":
        return F.when(label > 0, 1).otherwise(0)
    if mode == "feature":
        return F.when((label > 0) & (label <= 6), 1).otherwise(0)
    raise ValueError(f"unknown mode {mode}")


def label_name(col, names=LABEL_NAMES, missing="unlabeled"):
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _column(col).cast("int")), F.lit(missing))


def parse_logs(df, content="content"):
    """raw, content, source_type, timestamp (null): the shape scoring starts from."""
    text = F.col(content)
    return df.select(
        text.alias("raw"),
        text.alias("content"),
        source_type_from_text(text).alias("source_type"),
        F.lit(None).cast("timestamp").alias("timestamp"),
    )


def labelled(df, label="label"):
    return df.filter(F.col(label) >= 0)


def query_logs(df, source=None, start=None, end=None):
    """Optional equality on source and closed time range; each becomes a pushed filter."""
    if source is not None:
        df = df.filter(F.col("source") == source)
    if start is not None:
        df = df.filter(F.col("ts") >= start)
    if end is not None:
        df = df.filter(F.col("ts") <= end)
    return df


def query_predictions(df, model_type=None, predicted_class=None):
    if model_type is not None:
        df = df.filter(F.col("model_type") == model_type)
    if predicted_class is not None:
        df = df.filter(F.col("predicted_class") == predicted_class)
    return df


def fill_features(df, cols):
    return df.na.fill(0, cols)
