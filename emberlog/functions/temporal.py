"""Calendar columns. Day of week counts from Monday = 0."""

from __future__ import annotations

from pyspark.sql import functions as F

# What a row without a timestamp gets.
MISSING = {
    "hour": 12,
    "day_of_week": 3,
    "day_of_month": 15,
    "month": 6,
    "is_weekend": 0,
    "is_business_hours": 1,
    "is_night": 0,
    "is_off_hours": 0,
    "is_weekend_night": 0,
}


def _flag(condition):
    return F.when(condition, 1).otherwise(0)


def calendar_columns(ts="ts"):
    t = F.col(ts) if isinstance(ts, str) else ts
    hour, dow = F.hour(t), F.weekday(t)
    return {
        "hour": hour,
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(t),
        "month": F.month(t),
        "is_weekend": _flag(dow >= 5),
        "is_business_hours": _flag(hour.between(9, 17)),
        "is_night": _flag(hour.between(0, 6)),
        "is_off_hours": _flag((hour < 6) | (hour > 22)),
        "is_weekend_night": _flag((dow >= 5) & hour.between(0, 6)),
    }


def add_calendar(df, ts="ts", defaults=False):
    made = calendar_columns(ts)
    if defaults:
        made = {n: F.when(F.col(ts).isNull(), F.lit(MISSING[n])).otherwise(c) for n, c in made.items()}
    return df.withColumns(made)
