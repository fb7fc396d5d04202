"""When the next index cycle starts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARTER = 900


def next_quarter_hour(ts: Column) -> Column:
    """The next :00, :15, :30 or :45, strictly after the current minute's quarter."""
    return F.timestamp_seconds((F.floor(F.unix_seconds(ts) / QUARTER) + 1) * QUARTER)


def fmt_quarter_hour(ts: Column) -> Column:
    return F.concat(F.lit("~ "), F.date_format(next_quarter_hour(ts), "HH:mm"))


def next_slot(ts: Column, schedule: Column) -> Column:
    """First `base + i*step` minute of a `*:base/step` schedule after the current minute.

    Past the last slot of the hour it is `base` in the next hour. NULL for a schedule that
    cannot be read, a step below 1 or a base outside 0..59.
    """
    spec = r"^[^:]*:\s*(-?\d+)\s*/\s*(-?\d+)\s*(?::.*)?$"
    base = F.nullif(F.regexp_extract(schedule, spec, 1), F.lit("")).try_cast("int")
    step = F.nullif(F.regexp_extract(schedule, spec, 2), F.lit("")).try_cast("int")
    valid = base.between(0, 59) & (step > 0)
    slots = F.sequence(base, F.lit(59), step)
    minute = F.minute(ts)
    later = F.get(F.filter(slots, lambda m: m > minute), F.lit(0))
    offset = F.coalesce(later, base + 60)
    hour = F.date_trunc("hour", ts)
    return F.when(valid, hour + F.make_interval(mins=offset))
