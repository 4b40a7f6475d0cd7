"""Time and row windows per source.

Range windows run over per-second totals cut into days; row windows run over
sequenced chunks. No window ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from emberlog.durable import settle
from emberlog.operators.ordering import CHUNK, attach, over_rows, with_halo, with_sequence

# Trailing spans in seconds.
SPANS = {"1min": 60, "5min": 300, "15min": 900, "1H": 3600, "6H": 21600}
DAY = 86_400


def add_log_index(df, by="source", order=("ts", "log_id"), name="log_index"):
    return with_sequence(df, [by], list(order), name)


def _gap(ordered, ts):
    return F.coalesce((F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(ordered)) / 1e6, F.lit(0.0))


def add_time_gap(df, by="source", ts="ts", log_id="log_id", name="time_diff_seconds"):
    """Seconds since the previous row of the source; 0 on its first row."""
    ranked = with_sequence(df, [by], [ts, log_id])
    return over_rows(ranked, [by], 1, lambda w: {name: _gap(w, ts)}).drop("seq")


def gap_flags(gap="time_diff_seconds"):
    return {
        "is_burst": F.when(F.col(gap) < 1, 1).otherwise(0),
        "is_isolated": F.when(F.col(gap) > 300, 1).otherwise(0),
    }


def add_gap_flags(df, gap="time_diff_seconds"):
    return df.withColumns(gap_flags(gap))


def add_rolling_stats(df, n=10, by="source", ts="ts", content="content", log_id="log_id"):
    """Mean and sample std of content length and time gap over the last n rows.

    With ``content=None`` the rows bring ``content_length``.
    """
    measured = df if content is None else df.withColumn("content_length", F.length(content))
    ranked = with_sequence(measured, [by], [ts, log_id])
    # one halo of n rows holds the frames and the row before them, from which the first gap comes
    cut = with_halo(ranked, n)
    ordered = Window.partitionBy(by, "_chunk").orderBy("seq")
    cut = cut.withColumn("time_diff_seconds", _gap(ordered, ts))

    def frames(w):
        last = w.rowsBetween(1 - n, 0)
        made = {}
        for source, label in (("content_length", "content_length"), ("time_diff_seconds", "time_diff")):
            made[f"{label}_mean_{n}"] = F.avg(source).over(last)
            made[f"{label}_std_{n}"] = F.coalesce(F.stddev_samp(source).over(last), F.lit(0.0))
        return made

    made = cut.select("*", *[c.alias(name) for name, c in frames(ordered).items()])
    return made.filter("_own").drop("_chunk", "_own", "seq")


def _per_second(df, by, ts, measures):
    second = F.unix_seconds(ts)
    return df.filter(F.col(ts).isNotNull()).groupBy(by, second.alias("_sec")).agg(
        *[c.alias(n) for n, c in measures.items()]
    )


def trailing_sums(df, measures, spans=SPANS, by="source", ts="ts"):
    """Totals over the trailing spans for every (source, second) that has rows.

    Both ends and all rows of the same second are inside. A day of seconds plus the
    longest span is all that one window can hold. Whole numbers are the difference of two
    running totals, a step per row; a sliding frame would add up all its rows for each row.
    """
    per = _per_second(df, by, ts, measures)
    reach = max(spans.values())
    width = max(DAY, reach)
    own = F.floor(F.col("_sec") / width).cast("long")
    late = F.pmod("_sec", F.lit(width)) >= width - reach
    cut = per.withColumn("_day", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    cut = cut.withColumn("_own", F.col("_day") == own)
    ordered = Window.partitionBy(by, "_day").orderBy("_sec")

    def trailing(m, span):
        if not isinstance(per.schema[m].dataType, IntegralType):
            return F.sum(m).over(ordered.rangeBetween(-span, 0))
        upto, before = (ordered.rangeBetween(Window.unboundedPreceding, end) for end in (0, -span - 1))
        total = F.sum(m).over(upto) - F.coalesce(F.sum(m).over(before), F.lit(0))
        return F.when(F.count(m).over(upto) > F.count(m).over(before), total)  # null where all are

    made = [trailing(m, span).alias(f"{m}_{label}") for m in measures for label, span in spans.items()]
    return cut.select("*", *made).filter("_own").drop("_day", "_own", *measures)


def _attach_timed(df, ts, name, value, stats, by):
    """Join figures per time; rows without a timestamp go round the join, where they would share one key."""
    timed = attach(df.filter(F.col(ts).isNotNull()).withColumn(name, value), stats, [by, name]).drop(name)
    return timed.unionByName(df.filter(F.col(ts).isNull()), allowMissingColumns=True)


def add_trailing_counts(df, spans=SPANS, by="source", ts="ts"):
    stats = settle(trailing_sums(df, {"log_count": F.count("*")}, spans, by, ts))
    out = _attach_timed(df, ts, "_sec", F.unix_seconds(ts), stats, by)
    return out.na.fill(0, [f"log_count_{s}" for s in spans])


def add_error_density(df, flags, spans=SPANS, by="source", ts="ts"):
    """Sum of all has_* flags over the trailing spans; flags are added up in the row first."""
    total = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    stats = settle(trailing_sums(df, {"error_density": F.sum(total)}, spans, by, ts))
    return _attach_timed(df, ts, "_sec", F.unix_seconds(ts), stats, by)


def add_minute_count(df, by="source", ts="ts", name="logs_last_10"):
    """Rows of the source in the same calendar minute; null without a timestamp."""
    minute = F.floor(F.unix_seconds(ts) / 60).cast("long")
    stats = settle(
        df.filter(F.col(ts).isNotNull()).groupBy(by, minute.alias("_minute")).agg(F.count("*").alias(name))
    )
    return _attach_timed(df, ts, "_minute", minute, stats, by)


def add_hour_frequency(df, by="source", ts="ts", name="hour_frequency"):
    """Rows of the source in the same hour of day: at most 25 totals for a source."""
    hour = F.hour(ts)
    stats = settle(df.groupBy(by, hour.alias("_hour")).agg(F.count("*").alias(name)))
    out = attach(df.withColumn("_hour", hour), stats, [by, "_hour"])
    return out.withColumn(name, F.when(F.col("_hour").isNull(), 0).otherwise(F.col(name))).drop("_hour")


def same_class_ratio(df, n=50, by="source", order=("ts", "log_id"), label="label", classes=(0, 1)):
    """Share of the last n+1 labels equal to the row's own. Reads labels: for profiling only."""
    ranked = with_sequence(df, [by], list(order))

    def frames(w):
        last = w.rowsBetween(-n, 0)
        same = None
        for k in classes:
            hits = F.sum(F.when(F.col(label) == k, 1).otherwise(0)).over(last)
            same = F.when(F.col(label) == k, hits) if same is None else same.when(F.col(label) == k, hits)
        return {"same_class_ratio": same / F.count("*").over(last)}

    out = over_rows(ranked, [by], n, frames).drop("seq")
    return out.withColumn("minority_class_indicator", F.when(F.col(label) == 1, 1).otherwise(0))


def add_position(df, by="source", order=("ts", "log_id"), name="position"):
    """Row order of a source scaled to 0..1."""
    ranked = with_sequence(df, [by], list(order), total="_rows")
    return ranked.withColumn(name, F.col("seq") / (F.col("_rows") - 1 + F.lit(1e-8))).drop("seq", "_rows")


def best_per_split(results, by="source", score="f1", model="model"):
    """Best model per held-out source; the results table has one row per (source, model)."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(model))
    return results.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def next_in_group(df, group, order="log_id", by="source"):
    """The next row's id and label inside (source, group)."""
    ranked = with_sequence(df, [by, group], [order])
    # lead is a lag in descending order: chunks carry one row back, so pairs are read from the later row
    return over_rows(
        ranked, [by, group], 1,
        lambda w: {"prev_id": F.lag(order).over(w), "prev_label": F.lag("label").over(w)},
    ).drop("seq")


def sessionize(df, gap=300, by="source", ts="ts", log_id="log_id"):
    """Sessions split where the gap exceeds ``gap`` seconds; numbers start at 0 in each source."""
    gapped = over_rows(with_sequence(df, [by], [ts, log_id]), [by], 1, lambda w: {"time_diff_seconds": _gap(w, ts)})
    chunk = F.floor(F.col("seq") / F.lit(CHUNK)).cast("long")
    flagged = settle(gapped.withColumns({"_chunk": chunk, "_start": F.when(F.col("time_diff_seconds") > gap, 1).otherwise(0)}))
    # rows are summed within their chunk; one total per chunk is carried on
    totals = flagged.groupBy(by, "_chunk").agg(F.sum("_start").alias("_sum"))
    earlier = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = settle(totals.select(by, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried")))
    within = Window.partitionBy(by, "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = attach(flagged.withColumn("_within", F.sum("_start").over(within)), carried, [by, "_chunk"])
    return out.withColumn("session", F.col("_within") + F.col("_carried")).drop("_chunk", "_start", "_within", "_carried", "seq")
