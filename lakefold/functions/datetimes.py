"""Dates and times from text, Julian days or seconds, with modifiers applied left to right.

A moment is a timestamp without zone, in UTC. What can't be read is null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

DAY_US, JULIAN_1970 = 86_400_000_000, 2440587.5


def moment(x: Column, kind: str = "text") -> Column:
    """kind: text (ISO date, time or both), julian (day number), unix (seconds), auto (a number of either kind), timestamp."""
    if kind == "timestamp":
        return x.cast("timestamp_ntz")
    if kind == "unix":
        return _from_us((x.cast("double") * 1e6).cast("long"))
    if kind == "julian":
        return _from_us(F.round((x.cast("double") - JULIAN_1970) * DAY_US).cast("long"))
    if kind == "auto":
        return F.when(x.cast("double").between(0, 5373484.499999), moment(x, "julian")).otherwise(moment(x, "unix"))
    text = F.trim(x)
    only_time = text.rlike(r"^\d{2}:\d{2}")
    return F.when(only_time, F.concat(F.lit("2000-01-01 "), text)).when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text).try_cast("timestamp_ntz")


def _from_us(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def modify(t: Column, *modifiers: str) -> Column:
    """Each of: ±N second|minute|hour|day|month|year, ±HH:MM[:SS], start of day|month|year, weekday N, floor, ceiling."""
    clamp: list[bool] = []
    if "floor" in modifiers:
        clamp.append(True)
    for m in modifiers:
        t = _modify(t, m.strip().lower(), bool(clamp))
    return t


def _modify(t: Column, m: str, clamp: bool) -> Column:
    if m in ("floor", "ceiling", "subsec", "subsecond"):
        return t
    if m.startswith("start of "):
        return F.date_trunc(m[9:], t).cast("timestamp_ntz")
    if m.startswith("weekday "):
        return _from_us(micros(t) + F.pmod(F.lit(int(m[8:]) + 1) - F.dayofweek(t), F.lit(7)).cast("long") * DAY_US)
    if m == "localtime":
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), t)
    if m == "utc":
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), t)
    clock = re.fullmatch(r"([+-]?)(\d{2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?", m)
    if clock:
        seconds = (int(clock[2]) * 60 + int(clock[3])) * 60 + float(clock[4] or 0)
        return _from_us(micros(t) + int(seconds * 1e6) * (-1 if clock[1] == "-" else 1))
    move = re.fullmatch(r"([+-]?\d+(?:\.\d+)?) *(second|minute|hour|day|month|year)s?", m)
    if not move:
        return F.lit(None).cast("timestamp_ntz")
    n, unit = float(move[1]), move[2]
    if unit in ("month", "year"):
        return _add_months(t, int(n) * (12 if unit == "year" else 1), clamp)
    return _from_us(micros(t) + int(n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit] * 1_000_000))


def _add_months(t: Column, n: int, clamp: bool) -> Column:
    """A day beyond the month's end rolls into the next month, unless clamped."""
    first = F.trunc(t, "month")
    there = F.add_months(first, n)
    day = F.dayofmonth(t)
    day = F.least(day, F.dayofmonth(F.last_day(there))) if clamp else day
    whole = F.date_add(there, day - 1).cast("timestamp_ntz")
    return _from_us(micros(whole) + F.pmod(micros(t), F.lit(DAY_US)))


def date(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def time(t: Column, subsec: bool = False) -> Column:
    return F.date_format(t, "HH:mm:ss.SSS" if subsec else "HH:mm:ss")


def datetime(t: Column, subsec: bool = False) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS" if subsec else "yyyy-MM-dd HH:mm:ss")


def julianday(t: Column) -> Column:
    return micros(t) / F.lit(float(DAY_US)) + JULIAN_1970


def unixepoch(t: Column) -> Column:
    return F.floor(micros(t) / 1_000_000).cast("long")


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _week(t: Column, first_day: int) -> Column:
    """Week of the year, weeks beginning on Sunday (0) or Monday (1), days before the first such day in week 0."""
    weekday = F.pmod(F.dayofweek(t) - 1 - first_day, F.lit(7))
    return F.floor((F.dayofyear(t) + 6 - weekday) / 7)


_FIELDS = {
    "d": lambda t: F.date_format(t, "dd"), "e": lambda t: F.lpad(F.dayofmonth(t).cast("string"), 2, " "),
    "f": lambda t: F.date_format(t, "ss.SSS"), "F": date, "H": lambda t: F.date_format(t, "HH"),
    "G": lambda t: F.extract(F.lit("yearofweek"), t).cast("string"), "g": lambda t: _two(F.extract(F.lit("yearofweek"), t) % 100),
    "I": lambda t: F.date_format(t, "hh"), "j": lambda t: F.lpad(F.dayofyear(t).cast("string"), 3, "0"),
    "J": lambda t: julianday(t).cast("string"), "k": lambda t: F.lpad(F.hour(t).cast("string"), 2, " "),
    "l": lambda t: F.lpad((F.pmod(F.hour(t) + 11, F.lit(12)) + 1).cast("string"), 2, " "),
    "m": lambda t: F.date_format(t, "MM"), "M": lambda t: F.date_format(t, "mm"),
    "p": lambda t: F.when(F.hour(t) < 12, "AM").otherwise("PM"), "P": lambda t: F.when(F.hour(t) < 12, "am").otherwise("pm"),
    "R": lambda t: F.date_format(t, "HH:mm"), "s": lambda t: unixepoch(t).cast("string"), "S": lambda t: F.date_format(t, "ss"),
    "T": time, "u": lambda t: (F.weekday(t) + 1).cast("string"), "w": lambda t: (F.dayofweek(t) - 1).cast("string"),
    "U": lambda t: _two(_week(t, 0)), "W": lambda t: _two(_week(t, 1)), "V": lambda t: _two(F.weekofyear(t)),
    "Y": lambda t: F.date_format(t, "yyyy"), "%": lambda t: F.lit("%"),
}


def strftime(pattern: str, t: Column) -> Column:
    """Null for an unknown field."""
    parts, at = [], 0
    for m in re.finditer(r"%(.)", pattern, re.S):
        if m[1] not in _FIELDS:
            return F.lit(None).cast("string")
        parts += [F.lit(pattern[at : m.start()]), _FIELDS[m[1]](t)]
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def timediff(a: Column, b: Column) -> Column:
    """±YYYY-MM-DD HH:MM:SS.SSS: what to add to b to reach a."""
    ahead = a >= b
    high, low = F.when(ahead, a).otherwise(b), F.when(ahead, b).otherwise(a)
    # from b forwards, or from b backwards: whole months first, then the rest
    months = F.floor(F.months_between(high, low, False)).cast("int")
    reached = F.when(ahead, _shift_months(low, months)).otherwise(_shift_months(high, -months))
    over = F.when(ahead, reached > high).otherwise(reached < low)
    months = F.when(over, months - 1).otherwise(months)
    reached = F.when(ahead, _shift_months(low, months)).otherwise(_shift_months(high, -months))
    rest = F.abs(F.when(ahead, micros(high) - micros(reached)).otherwise(micros(reached) - micros(low)))
    days, inside = F.floor(rest / DAY_US), F.pmod(rest, F.lit(DAY_US))
    pad = lambda x, n=2: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.concat(F.when(ahead, "+").otherwise("-"), pad(F.floor(months / 12), 4), F.lit("-"), pad(months % 12), F.lit("-"), pad(days), F.lit(" "), F.date_format(_from_us(inside), "HH:mm:ss.SSS"))


def _shift_months(t: Column, n: Column) -> Column:
    there = F.add_months(F.trunc(t, "month"), n)
    return _from_us(micros(F.date_add(there, F.dayofmonth(t) - 1).cast("timestamp_ntz")) + F.pmod(micros(t), F.lit(DAY_US)))
