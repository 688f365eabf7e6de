"""Column expressions shared by the operators.

The monitored scripts follow Oracle rules for clocks, text and NULLs; the
helpers below give those rules once, as built-in Spark expressions (all stay
inside whole-stage codegen, no Python UDFs).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsight.functions import texts as T

# Fixed status vocabularies of the load framework.
DONE_STATUSES = ("CLOSED", "SUCCESS")
OPEN_STATUSES = ("FAILED", "RUNABLE", "RUNNING", "PENDING", "WAITING")
BUCKET_STATUSES = ("RUNABLE", "RUNNING", "FAILED", "CLOSED", "SUCCESS")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(as_of: dt.datetime | str) -> Column:
    """Clock literal as TIMESTAMP_NTZ (fixture timestamps carry no zone)."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return F.expr(f"TIMESTAMP_NTZ'{as_of:%Y-%m-%d %H:%M:%S.%f}'")


def day_of(as_of: dt.datetime, minus_days: int = 0) -> Column:
    """``TRUNC(as_of - n)`` as a DATE literal."""
    d = (as_of - dt.timedelta(days=minus_days)).date()
    return F.expr(f"DATE'{d.isoformat()}'")


def day_start(c) -> Column:
    """``TRUNC(ts)``: midnight of the same day, keeping TIMESTAMP_NTZ."""
    return F.to_date(col(c)).cast("timestamp_ntz")


def days_ago(as_of: dt.datetime, days: float) -> Column:
    """``SYSDATE - days`` (fractions of a day allowed) as a literal."""
    return ts_lit(as_of - dt.timedelta(days=days))


def key_of(c) -> Column:
    """Date -> integer key ``yyyyMMdd``."""
    return F.date_format(col(c), "yyyyMMdd").cast("int")


def key_text(c) -> Column:
    return F.date_format(col(c), "yyyyMMdd")


def key_to_date(c) -> Column:
    """Integer or text key -> DATE; impossible keys (20160931) give NULL."""
    return F.try_to_date(col(c).cast("string"), "yyyyMMdd")


def micros_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def secs_between(start, end) -> Column:
    """``(end - start) * 86400`` in seconds, exact to the microsecond."""
    return micros_between(start, end) / F.lit(1_000_000.0)


def interval_between(start, end) -> Column:
    """``ts - ts``: a day-time interval."""
    return col(end) - col(start)


def numtodsinterval(n, unit: str = "SECOND") -> Column:
    """``NUMTODSINTERVAL(n, unit)``: a number of days, hours, minutes or seconds as a day-time interval, exact to the microsecond."""
    secs = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}[unit.upper()]
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, (col(n).cast("decimal(18,6)") * F.lit(secs)).cast("decimal(18,6)"))


def interval_text(iv: Column) -> Column:
    """An interval as the database prints it: sign, nine digits of days, and the time (``+000000001 02:03:04.500000``)."""
    part = lambda unit: F.abs(F.extract(F.lit(unit), iv))
    two = lambda unit: F.lpad(part(unit).cast("string"), 2, "0")
    sign = F.when(iv < F.expr("INTERVAL '0' SECOND"), "-").otherwise("+")
    return F.concat(sign, F.lpad(part("DAY").cast("string"), 9, "0"), F.lit(" "), two("HOUR"), F.lit(":"), two("MINUTE"), F.lit(":"),
                    F.lpad(part("SECOND").cast("string"), 9, "0"))


def txt(*parts) -> Column:
    """Oracle ``||`` over columns and literals: strings are literals."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def trunc_num(x, digits: int = 0) -> Column:
    """Oracle ``TRUNC(n, d)``: toward zero, as DOUBLE."""
    x = col(x)
    f = F.floor(x, F.lit(digits)) if digits else F.floor(x)
    c = F.ceil(x, F.lit(digits)) if digits else F.ceil(x)
    return F.when(x >= 0, f).otherwise(c).cast("double")


def ratio(num, den) -> Column:
    """``num / NULLIF(den, 0)``."""
    return F.try_divide(col(num).cast("double"), F.nullif(col(den), F.lit(0)).cast("double"))


def hms_text(secs, hour_tag: str = "H") -> Column:
    """Seconds -> ``xH:ym:zs`` with floors as in the duration columns."""
    a = col(secs)
    h = F.floor(a / 3600)
    m = F.floor(a / 60 - h * 60)
    s = F.floor(a - h * 3600 - m * 60)
    # Oracle concatenation: a NULL average leaves only the unit letters.
    return F.concat_ws("", h.cast("string"), F.lit(f"{hour_tag}:"), m.cast("string"), F.lit("m:"),
                       s.cast("string"), F.lit("s"))


def cnt_if(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as BIGINT."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def days_behind_text(days, unit: str = T.DAY_S_BEHIND, up: str = T.UP_TO_DATE) -> Column:
    """``n DAY/S BEHIND``, or ``UP TO DATE`` when n is 0."""
    d = col(days)
    return F.when(d == 0, F.lit(up)).otherwise(F.concat_ws("", d.cast("string"), F.lit(unit)))


def round_duration(start, end, unit_secs: float, digits: int) -> Column:
    """``ROUND((end - start) / unit, d)`` on the exact microsecond count.

    Oracle computes date differences in decimal; rounding a double would
    turn exact ties (8.7 s / 60 = 0.145) the wrong way.
    """
    us = micros_between(start, end).cast("decimal(38,0)")
    return F.round(us / F.lit(int(unit_secs * 1_000_000)), digits).cast("double")


def round_rate(amount, start, end, digits: int = 0) -> Column:
    """``ROUND(amount / NULLIF(seconds, 0), d)`` with exact decimal seconds."""
    us = F.nullif(micros_between(start, end), F.lit(0)).cast("decimal(38,0)")
    return F.round(col(amount).cast("decimal(38,0)") * F.lit(1_000_000) / us, digits).cast("double")


def num_text(x) -> Column:
    """``TO_CHAR(n, '999,999,999,999')``: grouped digits right-aligned in 16
    characters (one for the sign); ``#`` x 16 when the value needs more digits."""
    v = col(x)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
             .when(F.abs(v) >= F.lit(10 ** 12), F.lit("#" * 16))
             .otherwise(F.lpad(F.format_number(v.cast("double"), 0), 16, " ")))
