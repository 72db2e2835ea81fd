"""Calendar column expressions (F1-F11, P15-P17). All work on TIMESTAMP_NTZ without a time zone."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed origin for integer hour ids; far enough back that ids stay positive for
# climate series that start in 1960.
HOUR_ORIGIN = "1900-01-01 00:00:00"

# Southern-hemisphere (NZ) seasons by month.
SEASON_OF_MONTH = {
    12: "Summer", 1: "Summer", 2: "Summer",
    3: "Autumn", 4: "Autumn", 5: "Autumn",
    6: "Winter", 7: "Winter", 8: "Winter",
    9: "Spring", 10: "Spring", 11: "Spring",
}
SEASON_ORDER = {"Summer": 1, "Autumn": 2, "Winter": 3, "Spring": 4}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _origin() -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{HOUR_ORIGIN}'")


def hour_id(ts) -> Column:
    """Whole hours since HOUR_ORIGIN (bigint); the row position of a gap-free hourly grid."""
    return F.timestamp_diff("HOUR", _origin(), _c(ts))


def from_hour_id(h) -> Column:
    return F.timestamp_add("HOUR", _c(h), _origin())


def trunc_hour(ts) -> Column:
    """F8: floor to the hour, staying TIMESTAMP_NTZ (date_trunc would return TIMESTAMP)."""
    return from_hour_id(hour_id(ts))


def trunc_month(ts) -> Column:
    """first instant of the month as TIMESTAMP_NTZ."""
    return F.make_timestamp_ntz(F.year(_c(ts)), F.month(_c(ts)), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def weekday_mon0(ts) -> Column:
    """Monday=0 .. Sunday=6 (Python convention)."""
    return F.weekday(_c(ts))


def weekday_sun1(ts) -> Column:
    """Sunday=1 .. Saturday=7 (R lubridate convention)."""
    return F.dayofweek(_c(ts))


def days_in_month(ts) -> Column:
    """the reference's ``mday`` is the number of days in the month, not the day of month."""
    return F.dayofmonth(F.last_day(_c(ts)))


def calendar_columns(ts: str = "ts") -> dict[str, Column]:
    """the calendar block of the feature table."""
    h = F.hour(F.col(ts))
    return {
        "hour": h,
        "wday": weekday_mon0(ts),
        "month": F.month(F.col(ts)),
        "mday": days_in_month(ts),
        "doy": F.dayofyear(F.col(ts)),
        "sin_hour": F.sin(F.lit(2 * math.pi) * h / F.lit(24.0)),
        "cos_hour": F.cos(F.lit(2 * math.pi) * h / F.lit(24.0)),
    }


def with_calendar(df, ts: str = "ts"):
    return df.withColumns(calendar_columns(ts))


def season(ts) -> Column:
    """NZ season label."""
    m = F.month(_c(ts))
    return (F.when(m.isin(12, 1, 2), "Summer").when(m.isin(3, 4, 5), "Autumn")
            .when(m.isin(6, 7, 8), "Winter").otherwise("Spring"))


def season_order(label) -> Column:
    c = _c(label)
    expr = None
    for name, k in SEASON_ORDER.items():
        expr = F.when(c == name, k) if expr is None else expr.when(c == name, k)
    return expr


def is_leap_day(ts) -> Column:
    """29 February."""
    return (F.month(_c(ts)) == 2) & (F.dayofmonth(_c(ts)) == 29)


def month_label(ts) -> Column:
    """short month name."""
    return F.date_format(_c(ts), "MMM")


def hourly_range(start, end) -> Column:
    """array of every hour from start to end inclusive (explode it)."""
    return F.sequence(_c(start), _c(end), F.expr("INTERVAL 1 HOUR"))
