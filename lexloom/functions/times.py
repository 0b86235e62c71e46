"""``#time`` formats and the CURRENT/LOCAL words as native columns. The clock is always a parameter, never the machine's."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .expressions import roman_column
from .text import col


def _twelve(t):
    return (F.hour(t) + 11) % 12 + 1


#: Format letters; what they give for a timestamp is native code.
CODES = {
    "Y": lambda t: F.year(t).cast("string"),
    "y": lambda t: F.date_format(t, "yy"),
    "n": lambda t: F.month(t).cast("string"),
    "m": lambda t: F.date_format(t, "MM"),
    "M": lambda t: F.date_format(t, "MMM"),
    "F": lambda t: F.date_format(t, "MMMM"),
    "W": lambda t: F.lpad(F.weekofyear(t).cast("string"), 2, "0"),
    "j": lambda t: F.dayofmonth(t).cast("string"),
    "d": lambda t: F.date_format(t, "dd"),
    "z": lambda t: (F.dayofyear(t) - 1).cast("string"),
    "D": lambda t: F.date_format(t, "EEE"),
    "l": lambda t: F.date_format(t, "EEEE"),
    "N": lambda t: (F.weekday(t) + 1).cast("string"),
    "w": lambda t: ((F.weekday(t) + 1) % 7).cast("string"),
    "a": lambda t: F.when(F.hour(t) < 12, F.lit("am")).otherwise(F.lit("pm")),
    "A": lambda t: F.when(F.hour(t) < 12, F.lit("AM")).otherwise(F.lit("PM")),
    "g": lambda t: _twelve(t).cast("string"),
    "h": lambda t: F.lpad(_twelve(t).cast("string"), 2, "0"),
    "G": lambda t: F.hour(t).cast("string"),
    "H": lambda t: F.date_format(t, "HH"),
    "i": lambda t: F.date_format(t, "mm"),
    "s": lambda t: F.date_format(t, "ss"),
    "U": lambda t: F.unix_timestamp(t).cast("string"),
    "L": lambda t: F.when(((F.year(t) % 4 == 0) & (F.year(t) % 100 != 0)) | (F.year(t) % 400 == 0), F.lit("1")).otherwise(F.lit("0")),
    "c": lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
    "r": lambda t: F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss '+0000'"),
    "t": lambda t: F.dayofmonth(F.last_day(t)).cast("string"),
}


def format_time(fmt: str, timestamp):
    """A format over a timestamp column: letters as in CODES, ``xr`` turns the next number into Roman numerals, quotes and backslashes
    protect text."""
    t = col(timestamp)
    parts, roman = [], False
    for piece in re.findall(r'"[^"]*"|xr|\\.|.', fmt, re.S):
        if piece == "xr":
            roman = True
        elif piece in CODES:
            value = CODES[piece](t)
            if roman:
                value = F.when(value.rlike(r"^\d+$"), roman_column(value.try_cast("int"))).otherwise(value)
                roman = False
            parts.append(value)
        else:
            parts.append(F.lit(piece[1] if len(piece) == 2 and piece[0] == "\\" else piece[1:-1] if len(piece) >= 2 and piece[0] == '"' else piece))
    return F.trim(F.concat(*parts)) if parts else F.lit("")


#: Forms of dates that are understood, tried in this order.
PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy-M-d", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "d MMMM yyyy HH:mm:ss",
    "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMMM d yyyy", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "d.M.yyyy", "yyyyMMddHHmmss", "yyyyMMdd", "MMMM yyyy", "MMM yyyy",
)


def parse_time(text, clock):
    """A date in one of PATTERNS, with an optional tail ``+ n unit``; four digits are hours and minutes of the clock's day; null if not understood."""
    s, clock = F.trim(col(text)), col(clock)
    amount = F.regexp_extract(s, r"([+-])\s*(\d+)\s*(second|minute|hour|day|week|month|year)s?$", 2).try_cast("int")
    sign = F.when(F.regexp_extract(s, r"([+-])\s*(\d+)\s*(second|minute|hour|day|week|month|year)s?$", 1) == "-", -1).otherwise(1)
    unit = F.regexp_extract(s, r"([+-])\s*(\d+)\s*(second|minute|hour|day|week|month|year)s?$", 3)
    bare = F.trim(F.regexp_replace(s, r"\s*[+-]\s*\d+\s*(second|minute|hour|day|week|month|year)s?$", ""))
    bare = F.regexp_replace(bare, r"^0(\d )", "$1")
    found = F.coalesce(*[F.try_to_timestamp(bare, F.lit(p)) for p in PATTERNS], F.when(bare.isin("", "now"), clock))
    clock_time = F.make_timestamp(F.year(clock), F.month(clock), F.dayofmonth(clock), F.substring(s, 1, 2).try_cast("int"), F.substring(s, 3, 2).try_cast("int"), F.lit(0))
    moved = found
    n = F.coalesce(amount * sign, F.lit(0))
    for name, (months, weeks, days, hours, mins, secs) in {"year": (12, 0, 0, 0, 0, 0), "month": (1, 0, 0, 0, 0, 0), "week": (0, 1, 0, 0, 0, 0), "day": (0, 0, 1, 0, 0, 0), "hour": (0, 0, 0, 1, 0, 0), "minute": (0, 0, 0, 0, 1, 0), "second": (0, 0, 0, 0, 0, 1)}.items():
        step = F.make_interval(F.lit(0), n * months, n * weeks, n * days, n * hours, n * mins, (n * secs).cast("decimal(18,6)"))
        moved = F.when(unit == name, found + step).otherwise(moved)
    return F.when(s.rlike(r"^([01]\d|2[0-3])[0-5]\d$"), clock_time).otherwise(moved)


INVALID = '<strong class="error">Error: invalid time</strong>'


def time(fmt: str, text, clock):
    """``#time:fmt|text``; without a text the clock counts."""
    parsed = F.when(F.coalesce(F.trim(col(text)), F.lit("")) == "", col(clock)).otherwise(parse_time(text, clock))
    return F.when(parsed.isNull(), F.lit(INVALID)).otherwise(format_time(fmt, parsed))


#: The words CURRENTDAY and so on (and LOCALDAY and so on), as formats.
WORDS = {"DAY": "j", "DAY2": "d", "DAYNAME": "l", "DOW": "w", "MONTH": "m", "MONTHABBREV": "M", "MONTHNAME": "F", "TIME": "H:i", "WEEK": "W", "YEAR": "Y", "TIMESTAMP": "YmdHis"}


def clock_word(name: str, clock):
    """CURRENT... and LOCAL... words over a clock column (UTC for the former, the caller's local time for the latter)."""
    return format_time(WORDS[name.upper().removeprefix("CURRENT").removeprefix("LOCAL")], clock)
