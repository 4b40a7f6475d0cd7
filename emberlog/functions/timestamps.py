"""One expression that reads the time columns of sixteen log formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.labels import canonical_source

OUTPUT = "yyyy-MM-dd HH:mm:ss.SSS"
RAW_COLUMNS = ("Month", "Date", "Day", "Time")


def _spaced(*parts):
    return F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " ")


def _joined(*parts):
    """concat, so that one missing part makes the whole text null."""
    return F.concat(*parts)


def _parsers(raw, year):
    month, date, day, time = (raw[c] for c in RAW_COLUMNS)
    year = F.lit(str(year))
    space = F.lit(" ")
    dotted = F.regexp_replace(time, ",", ".")

    def at(text, pattern):
        return F.try_to_timestamp(text, F.lit(pattern))

    def month_day(m, d):
        return at(F.when(m.isNotNull() & d.isNotNull() & time.isNotNull(), _spaced(year, m, d, time)),
                  "yyyy MMM d HH:mm:ss")

    return {
        "android": at(_joined(year, F.lit("-"), date, space, time), "yyyy-MM-dd HH:mm:ss.SSS"),
        "apache": at(F.regexp_replace(time, r"^\w{3}\s+", ""), "MMM dd HH:mm:ss yyyy"),
        "bgl": at(date, "yyyy.MM.dd"),
        "hadoop": at(_joined(date, space, dotted), "yyyy-MM-dd HH:mm:ss.SSS"),
        "hdfs": at(
            _joined(F.substring(F.lpad(date, 6, "0"), 1, 6), space, F.substring(F.lpad(time, 6, "0"), 1, 6)),
            "yyMMdd HHmmss",
        ),
        "healthapp": at(time, "yyyyMMdd-H:m:s:SSS"),
        "hpc": F.timestamp_seconds(F.expr("try_cast(__time AS bigint)")),
        "linux": month_day(month, date),
        "mac": month_day(month, date),
        "openssh": month_day(date, day),
        "openstack": at(_joined(date, space, time), "yyyy-MM-dd HH:mm:ss.SSS"),
        "proxifier": at(_joined(year, F.lit("."), time), "yyyy.MM.dd HH:mm:ss"),
        "spark": at(_joined(date, space, time), "yy/MM/dd HH:mm:ss"),
        "thunderbird": F.coalesce(month_day(month, day), at(date, "yyyy.MM.dd")),
        "windows": at(_joined(date, space, time), "yyyy-MM-dd HH:mm:ss"),
        "zookeeper": at(_joined(date, space, dotted), "yyyy-MM-dd HH:mm:ss.SSS"),
    }


SOURCE_TYPES = (
    "android", "apache", "bgl", "hadoop", "hdfs", "healthapp", "hpc", "linux",
    "mac", "openssh", "openstack", "proxifier", "spark", "thunderbird", "windows", "zookeeper",
)


def normalize_timestamps(df, source_type_col="source_type", default_year=1970):
    """Add ts and timestamp_normalized (text); anything unreadable is null.

    Formats without a year take ``default_year``, so that a rerun gives the same rows.
    """
    held = [c for c in RAW_COLUMNS if c in df.columns]
    work = df.select("*", *[F.trim(F.col(c).cast("string")).alias(f"__{c.lower()}") for c in held])
    for c in RAW_COLUMNS:
        if c not in held:
            work = work.withColumn(f"__{c.lower()}", F.lit(None).cast("string"))
    raw = {c: F.col(f"__{c.lower()}") for c in RAW_COLUMNS}
    kind = canonical_source(source_type_col)
    parsers = _parsers(raw, default_year)
    ts = F.lit(None).cast("timestamp")
    for name in reversed(SOURCE_TYPES):
        ts = F.when(kind == name, parsers[name]).otherwise(ts)
    return (
        work.withColumn("ts", ts)
        .withColumn("timestamp_normalized", F.date_format("ts", OUTPUT))
        .drop(*[f"__{c.lower()}" for c in RAW_COLUMNS])
    )


def timestamp_coverage(df, by="source", ts="ts"):
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.count(ts).alias("n_parsed"),
        (F.count(ts) / F.count("*")).alias("coverage"),
    )
