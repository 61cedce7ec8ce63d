"""Date and time functions over moments.

A moment is a Column of milliseconds since 1970-01-01 UTC, so that all
modifiers are native integer and calendar expressions.
"""

from __future__ import annotations

import datetime as calendar
import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
_JULIAN_OF_EPOCH = 2440587.5
_TEXT = (
    r"^\s*(?:(-?\d{4})-(\d{2})-(\d{2}))?(?:[ T]*(\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?)?\s*(?:(Z|z)|([+-])(\d{2}):(\d{2}))?\s*$"
)


def _day(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def _days(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date")).cast("bigint")


@dataclass
class Moment:
    """ms: the moment. excess: days by which the last month shift ran over its month's end. raw: the number a numeric input had."""

    ms: Column
    excess: Column | None = None
    raw: Column | None = None
    subsec: bool = False

    # --- parts

    def days(self) -> Column:
        return F.floor(self.ms / DAY).cast("bigint")

    def in_day(self) -> Column:
        return F.pmod(self.ms, F.lit(DAY))

    def date(self) -> Column:
        return _day(self.days())

    # --- modifiers

    def shifted(self, ms: Column) -> "Moment":
        return Moment(self.ms + ms, None, None, self.subsec)

    def months(self, n: Column) -> "Moment":
        """A shift by months keeps the day's number and runs over the month's end where it must."""
        d = self.date()
        total = F.year(d) * 12 + F.month(d) - 1 + n
        first = F.make_date(F.floor(total / 12).cast("int"), (F.pmod(total, F.lit(12)) + 1).cast("int"), F.lit(1))
        over = F.greatest(F.dayofmonth(d) - F.dayofmonth(F.last_day(first)), F.lit(0))
        ms = (_days(first) + F.dayofmonth(d) - 1) * DAY + self.in_day()
        return Moment(ms, over.cast("bigint"), None, self.subsec)

    def modified(self, modifier: str) -> "Moment":
        m = modifier.strip().lower()
        if m in ("utc", "localtime", "ceiling"):
            return self  # sessions run in UTC; running over is the default
        if m == "floor":
            return self if self.excess is None else Moment(self.ms - self.excess * DAY, None, None, self.subsec)
        if m in ("subsec", "subsecond"):
            return Moment(self.ms, self.excess, self.raw, True)
        if m == "unixepoch":
            return Moment(F.round(self.raw * 1000).cast("bigint"), None, None, self.subsec)
        if m == "julianday":
            return self
        if m == "auto":
            unix = F.round(self.raw * 1000).cast("bigint")
            return Moment(F.when((self.raw >= 0) & (self.raw < 5373484.5), self.ms).otherwise(unix), None, None, self.subsec)
        if m == "start of day":
            return Moment(self.days() * DAY, None, None, self.subsec)
        if m in ("start of month", "start of year"):
            return Moment(_days(F.trunc(self.date(), m[9:])) * DAY, None, None, self.subsec)
        if g := re.fullmatch(r"weekday ([0-6])(?:\.0*)?", m):
            ahead = F.pmod(F.lit(int(g[1])) - (F.dayofweek(self.date()) - 1), F.lit(7)).cast("bigint")
            return self.shifted(ahead * DAY)
        if g := re.fullmatch(r"([+-])(\d{4})-(\d{2})-(\d{2})(?: (\d{2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?)?", m):
            sign = -1 if g[1] == "-" else 1
            out = self.months(F.lit(sign * (int(g[2]) * 12 + int(g[3]))))
            rest = int(g[4]) * DAY + int(g[5] or 0) * 3_600_000 + int(g[6] or 0) * 60_000 + round(float(g[7] or 0) * 1000)
            return out.shifted(F.lit(sign * rest).cast("bigint")) if rest else out
        if g := re.fullmatch(r"([+-]?)(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?", m):
            ms = int(g[2]) * 3_600_000 + int(g[3]) * 60_000 + round(float(g[4] or 0) * 1000)
            return self.shifted(F.lit(-ms if g[1] == "-" else ms).cast("bigint"))
        if g := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*(second|minute|hour|day|month|year)s?", m):
            n, unit = float(g[1]), g[2]
            if unit in ("month", "year"):
                whole, each = int(n), 12 if unit == "year" else 1
                out = self.months(F.lit(whole * each))
                rest = round((n - whole) * (365 if unit == "year" else 30) * DAY)
                return out.shifted(F.lit(rest).cast("bigint")) if rest else out
            each = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY}[unit]
            return self.shifted(F.lit(round(n * each)).cast("bigint"))
        return Moment(F.lit(None).cast("bigint"))

    # --- results

    def text(self, pattern: str) -> Column:
        return strftime(pattern, self)


def moment(x: Column, *modifiers: str, numeric: bool = False) -> Moment:
    """The moment of ISO text (date, time or both, with an optional zone), or with `numeric` of a Julian day."""
    if numeric:
        raw = x.cast("double")
        out = Moment(F.round((raw - _JULIAN_OF_EPOCH) * DAY).cast("bigint"), None, raw)
    else:
        g = [F.regexp_extract(x, _TEXT, k) for k in range(12)]
        part = [F.when(c != "", c) for c in g]
        year, month, day, hour, minute, second = (part[k].try_cast("int") for k in (1, 2, 3, 4, 5, 6))
        fine = (
            (g[0] != "")
            & (part[1].isNotNull() | part[4].isNotNull())
            & (F.coalesce(month, F.lit(1)).between(1, 12))
            & (F.coalesce(day, F.lit(1)).between(1, 31))
            & (F.coalesce(hour, F.lit(0)) < 25)
            & (F.coalesce(minute, F.lit(0)) < 60)
            & (F.coalesce(second, F.lit(0)) < 60)
        )
        first = F.make_date(F.coalesce(year, F.lit(2000)), F.least(F.greatest(F.coalesce(month, F.lit(1)), F.lit(1)), F.lit(12)), F.lit(1))
        ms = (_days(first) + F.coalesce(day, F.lit(1)) - 1) * DAY
        ms = ms + F.coalesce(hour, F.lit(0)) * 3_600_000 + F.coalesce(minute, F.lit(0)) * 60_000 + F.coalesce(second, F.lit(0)) * 1000
        ms = ms + F.round(F.coalesce(part[7].try_cast("double"), F.lit(0.0)) * 1000).cast("bigint")
        zone = (F.coalesce(part[10].try_cast("int"), F.lit(0)) * 60 + F.coalesce(part[11].try_cast("int"), F.lit(0))) * 60_000
        ms = ms - F.when(g[9] == "-", -zone).otherwise(zone)
        out = Moment(F.when(fine, ms.cast("bigint")))
    for m in modifiers:
        out = out.modified(m)
    return out


def of_timestamp(ts: Column, *modifiers: str) -> Moment:
    """The moment of a timestamp column, zone-less or not."""
    out = Moment(F.unix_millis(ts.cast("timestamp")))
    for m in modifiers:
        out = out.modified(m)
    return out


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _iso_week(m: Moment) -> tuple[Column, Column]:
    d = m.date()
    thursday = F.date_add(d, 3 - F.weekday(d))
    return F.year(thursday), F.weekofyear(d)


def strftime(pattern: str, m: Moment) -> Column:
    """All format codes; a code that is not known makes the result null."""
    d, ms = m.date(), m.in_day()
    hour, minute, second = (F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60)
    of_year, week_day = F.dayofyear(d), F.dayofweek(d) - 1
    half = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    iso_year, iso_week = _iso_week(m)
    fraction = F.lpad((ms % 1000).cast("string"), 3, "0")
    four = F.lpad(F.year(d).cast("string"), 4, "0")
    date = F.concat_ws("-", four, _two(F.month(d)), _two(F.dayofmonth(d)))
    julian = m.ms / F.lit(float(DAY)) + _JULIAN_OF_EPOCH
    codes = {
        "d": _two(F.dayofmonth(d)), "e": F.lpad(F.dayofmonth(d).cast("string"), 2, " "),
        "f": F.concat_ws(".", _two(second), fraction), "F": date,
        "G": F.lpad(iso_year.cast("string"), 4, "0"), "g": _two(iso_year % 100),
        "H": _two(hour), "I": _two(half), "j": F.lpad(of_year.cast("string"), 3, "0"), "J": julian.cast("string"),
        "k": F.lpad(hour.cast("string"), 2, " "), "l": F.lpad(half.cast("string"), 2, " "),
        "m": _two(F.month(d)), "M": _two(minute),
        "p": F.when(hour < 12, "AM").otherwise("PM"), "P": F.when(hour < 12, "am").otherwise("pm"),
        "R": F.concat_ws(":", _two(hour), _two(minute)), "s": F.floor(m.ms / 1000).cast("string"), "S": _two(second),
        "T": F.concat_ws(":", _two(hour), _two(minute), _two(second)),
        "u": (F.weekday(d) + 1).cast("string"), "w": week_day.cast("string"),
        "U": _two(F.floor((of_year + 6 - week_day) / 7)), "V": _two(iso_week),
        "W": _two(F.floor((of_year + 6 - F.weekday(d)) / 7)), "Y": four, "%": F.lit("%"),
    }
    parts, k = [], 0
    while k < len(pattern):
        if pattern[k] == "%":
            if pattern[k + 1 : k + 2] not in codes:
                return F.lit(None).cast("string")
            parts.append(codes[pattern[k + 1]])
            k += 2
        else:
            end = pattern.find("%", k)
            end = len(pattern) if end < 0 else end
            parts.append(F.lit(pattern[k:end]))
            k = end
    return F.when(m.ms.isNotNull(), F.concat(*parts)) if parts else F.when(m.ms.isNotNull(), F.lit(""))


def date(m: Moment) -> Column:
    return strftime("%Y-%m-%d", m)


def time(m: Moment) -> Column:
    return strftime("%H:%M:%f" if m.subsec else "%H:%M:%S", m)


def datetime(m: Moment) -> Column:
    return strftime("%Y-%m-%d %H:%M:%f" if m.subsec else "%Y-%m-%d %H:%M:%S", m)


def julianday(m: Moment) -> Column:
    return m.ms / F.lit(float(DAY)) + _JULIAN_OF_EPOCH


def unixepoch(m: Moment) -> Column:
    return m.ms / F.lit(1000.0) if m.subsec else F.floor(m.ms / 1000).cast("bigint")


#: Days and years of the calendar's cycle.
_CYCLE_DAYS, _CYCLE_YEARS = 146_097, 400
_EPOCH = calendar.date(1970, 1, 1).toordinal()


def of_civil(year: int, month: int, day: int) -> int:
    """Milliseconds of a date of any year; days past the month's end run over."""
    cycles, year = divmod(year - 2000, _CYCLE_YEARS)
    first = calendar.date(2000 + year, month, 1).toordinal() - _EPOCH
    return (first + cycles * _CYCLE_DAYS + day - 1) * DAY


def civil(ms: float) -> tuple[int, int, int, int]:
    """Year, month, day and the milliseconds of the day."""
    days, rest = divmod(math.floor(ms), DAY)
    cycles, days = divmod(days, _CYCLE_DAYS)
    d = calendar.date.fromordinal(days + _EPOCH)
    return d.year + cycles * _CYCLE_YEARS, d.month, d.day, rest


def _difference(a: int, b: int) -> str:
    """Years, months, days and time from b to a, as ±YYYY-MM-DD HH:MM:SS.SSS."""
    sign, low, high = ("+", b, a) if a >= b else ("-", a, b)
    # the shorter span is taken from the later end going back for negative differences
    year, month, day, rest = civil(low if sign == "+" else high)

    def step(months: int) -> int:
        total = year * 12 + month - 1 + (months if sign == "+" else -months)
        return of_civil(total // 12, total % 12 + 1, day) + rest

    (y0, m0, *_), (y1, m1, *_) = civil(low), civil(high)
    months = (y1 - y0) * 12 + m1 - m0 + 1
    while months > 0 and (step(months) > high if sign == "+" else step(months) < low):
        months -= 1
    day, total = divmod(high - step(months) if sign == "+" else step(months) - low, DAY)
    hour, total = divmod(total, 3_600_000)
    minute, total = divmod(total, 60_000)
    return f"{sign}{months // 12:04d}-{months % 12:02d}-{day:02d} {hour:02d}:{minute:02d}:{total // 1000:02d}.{total % 1000:03d}"


def timediff(a: Moment, b: Moment) -> Column:
    @F.pandas_udf("string")
    def diff(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(p) or pd.isna(q) else _difference(int(p), int(q)) for p, q in zip(x, y)])

    return diff(a.ms, b.ms)
