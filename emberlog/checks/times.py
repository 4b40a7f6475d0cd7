from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.checks.base import check, r6
from emberlog.functions.temporal import add_calendar
from emberlog.functions.timestamps import SOURCE_TYPES, normalize_timestamps, timestamp_coverage

# How each format writes an event's time: raw columns as Spark patterns, and what survives.
DAY, SECOND, MILLI = "day", "second", "millisecond"
WRITTEN = {
    "android": ({"Date": "MM-dd", "Time": "HH:mm:ss.SSS"}, MILLI),
    "apache": ({"Time": "EEE MMM dd HH:mm:ss yyyy"}, SECOND),
    "bgl": ({"Date": "yyyy.MM.dd"}, DAY),
    "hadoop": ({"Date": "yyyy-MM-dd", "Time": "HH:mm:ss,SSS"}, MILLI),
    "hdfs": ({"Date": "yyMMdd", "Time": "HHmmss"}, SECOND),
    "healthapp": ({"Time": "yyyyMMdd-H:m:s:SSS"}, MILLI),
    "hpc": ({"Time": None}, SECOND),
    "linux": ({"Month": "MMM", "Date": "d", "Time": "HH:mm:ss"}, SECOND),
    "mac": ({"Month": "MMM", "Date": "d", "Time": "HH:mm:ss"}, SECOND),
    "openssh": ({"Date": "MMM", "Day": "d", "Time": "HH:mm:ss"}, SECOND),
    "openstack": ({"Date": "yyyy-MM-dd", "Time": "HH:mm:ss.SSS"}, MILLI),
    "proxifier": ({"Time": "MM.dd HH:mm:ss"}, SECOND),
    "spark": ({"Date": "yy/MM/dd", "Time": "HH:mm:ss"}, SECOND),
    "thunderbird": ({"Month": "MMM", "Day": "d", "Time": "HH:mm:ss"}, SECOND),
    "windows": ({"Date": "yyyy-MM-dd", "Time": "HH:mm:ss"}, SECOND),
    "zookeeper": ({"Date": "yyyy-MM-dd", "Time": "HH:mm:ss,SSS"}, MILLI),
}


def written(logs, kind):
    """Write the time of every log the way a source of this kind does; one in nine is broken."""
    columns, _ = WRITTEN[kind]
    out = logs.select("log_id", "source", F.lit(kind).alias("source_type"), F.col("ts").alias("at"))
    for name, pattern in columns.items():
        text = F.unix_seconds("at").cast("string") if pattern is None else F.date_format("at", pattern)
        out = out.withColumn(name, F.when(F.col("log_id") % 9 == 8, F.lit("n/a")).otherwise(text))
    return out.drop("at")


def _expected_sql(kind):
    kept = WRITTEN[kind][1]
    return (
        f"SELECT log_id, CASE WHEN log_id % 9 = 8 THEN NULL ELSE "
        f"strftime(date_trunc('{kept}', ts), '%Y-%m-%d %H:%M:%S.%g') END AS timestamp_normalized FROM logs"
    )


for _number, _kind in enumerate(SOURCE_TYPES, 1):

    @check(f"ts{_number}_{_kind}", "logs", _expected_sql(_kind))
    def _(v, kind=_kind):
        return normalize_timestamps(written(v.logs, kind), default_year=2024).select("log_id", "timestamp_normalized")


@check("ts17_parse_success_rate", "logs", """
SELECT source, count(*) AS n_rows, count(*) FILTER (log_id % 9 <> 8) AS n_parsed,
  round(count(*) FILTER (log_id % 9 <> 8) / count(*)::DOUBLE, 6) AS coverage FROM logs GROUP BY source""")
def _(v):
    out = timestamp_coverage(normalize_timestamps(written(v.logs, "hdfs"), default_year=2024))
    return out.withColumn("coverage", r6("coverage"))


CALENDAR_SQL = {
    "hour": "hour(ts)",
    "day_of_week": "isodow(ts) - 1",
    "day_of_month": "day(ts)",
    "month": "month(ts)",
    "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END",
    "is_business_hours": "CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1 ELSE 0 END",
    "is_night": "CASE WHEN hour(ts) BETWEEN 0 AND 6 THEN 1 ELSE 0 END",
    "is_off_hours": "CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 1 ELSE 0 END",
    "is_weekend_night": "CASE WHEN isodow(ts) >= 6 AND hour(ts) BETWEEN 0 AND 6 THEN 1 ELSE 0 END",
}

for _name, _columns in {
    "tmp1_calendar_parts": ["hour", "day_of_month", "month"],
    "tmp2_day_of_week": ["day_of_week"],
    "tmp3_is_weekend": ["is_weekend"],
    "tmp4_is_business_hours": ["is_business_hours"],
    "tmp5_is_night": ["is_night"],
    "tmp6_is_off_hours": ["is_off_hours"],
    "tmp7_is_weekend_night": ["is_weekend_night"],
}.items():

    @check(_name, "logs", f"SELECT log_id, {', '.join(f'{CALENDAR_SQL[c]} AS {c}' for c in _columns)} FROM logs")
    def _(v, columns=_columns):
        return add_calendar(v.logs).select("log_id", *columns)


@check("tmp8_missing_timestamp_defaults", "logs", f"""
WITH holes AS (SELECT log_id, CASE WHEN log_id % 7 = 3 THEN NULL ELSE ts END AS ts FROM logs)
SELECT log_id, {', '.join(f"CASE WHEN ts IS NULL THEN {d} ELSE {CALENDAR_SQL[c]} END AS {c}" for c, d in
  {'hour': 12, 'day_of_week': 3, 'day_of_month': 15, 'month': 6, 'is_weekend': 0, 'is_business_hours': 1,
   'is_night': 0, 'is_off_hours': 0, 'is_weekend_night': 0}.items())} FROM holes""")
def _(v):
    holes = v.logs.withColumn("ts", F.when(F.col("log_id") % 7 != 3, F.col("ts")))
    return add_calendar(holes, defaults=True).drop("source", "ts", "content", "label", "value")
