"""Numbers and instants as a report shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1048576.0
KIB = 1024.0


def mib(size: Column, digits: int = 2) -> Column:
    return F.round(size / F.lit(MIB), digits)


def kib(size: Column, digits: int = 1) -> Column:
    return F.round(size / F.lit(KIB), digits)


def fmt_mib(size: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f MB", size / F.lit(MIB))


def fmt_kib(size: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", size / F.lit(KIB))


def fmt_percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value)


def fmt_thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def fmt_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "HH:mm:ss"), F.lit("N/A"))


def fmt_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def stamp(ts: Column) -> Column:
    """File-name stamp of an instant."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def progress_pct(done: Column, total: Column) -> Column:
    return F.round(F.lit(100.0) * done / F.nullif(total, F.lit(0)), 1)


def clamp0(n: Column) -> Column:
    return F.greatest(n, F.lit(0))


def backlog_band(raw: Column) -> Column:
    """low / mid / high for a pending count given as text; other text passes through."""
    n = F.btrim(raw).try_cast("int")
    return (
        F.when(n.isNull(), raw)
        .when(n == 0, F.lit("low"))
        .when(n < 50, F.lit("mid"))
        .otherwise(F.lit("high"))
    )
