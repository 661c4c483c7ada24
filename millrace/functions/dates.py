"""Date parts, formats and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

# The numbered formats. Those that name a year have a two-digit one; a hundred more gives four digits.
SHORT = {
    1: "%m/%d/%y",
    2: "%y.%m.%d",
    3: "%d/%m/%y",
    4: "%d.%m.%y",
    5: "%d-%m-%y",
    6: "%d %b %y",
    7: "%b %d, %y",
    8: "%I:%M:%S",
    9: "%b %d %y %I:%M:%S:mmmm%p",
    10: "%m-%d-%y",
    11: "%y/%m/%d",
    12: "%y%m%d",
    13: "%d %b %y %H:%M:%S:mmm",
    14: "%H:%M:%S:mmm",
    15: "%y-%m-%d",
    20: "%y-%m-%d %H:%M:%S",
    21: "%y-%m-%d %H:%M:%S.mmm",
}
LONG = {
    119: "%b %d %Y %I:%M:%S%p",
    126: "%Y-%m-%dT%H:%M:%S.mmm",
    127: "%Y-%m-%dT%H:%M:%S.mmmZ",
    130: "%d %b %Y %I:%M:%S:mmm%p",
    131: "%d/%b/%Y %I:%M:%S:mmm%p",
    136: "%Y-%m-%dT%H:%M:%S",
    137: "%Y-%m-%dT%H:%M:%SZ",
    140: "%d %b %Y %I:%M:%S%p",
    141: "%d/%b/%Y %I:%M:%S%p",
}
FORMATS = SHORT | {n + 100: f.replace("%y", "%Y") for n, f in SHORT.items()} | LONG
#: Directives of strftime as pattern letters.
LETTERS = {"a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "d": "dd", "D": "MM/dd/yy", "e": "d", "F": "yyyy-MM-dd", "h": "MMM", "H": "HH", "I": "hh", "j": "DDD", "m": "MM", "M": "mm", "p": "a", "R": "HH:mm", "S": "ss", "T": "HH:mm:ss", "y": "yy", "Y": "yyyy"}


def pattern(code: str) -> str:
    """A format number or strftime text as a Spark date pattern. mmm is milliseconds, mmmm the same in four digits."""
    if code.isdigit():
        if int(code) not in FORMATS:
            raise QueryError(f"{code} does not match any date formats")
        code = FORMATS[int(code)]
    out, plain, i = [], [], 0

    def flush():
        if plain:
            out.append("'" + "".join(plain).replace("'", "''") + "'")
            plain.clear()

    while i < len(code):
        if code.startswith("%%", i):
            plain.append("%")
            i += 2
        elif code[i] == "%" and i + 1 < len(code):
            if code[i + 1] not in LETTERS:
                raise QueryError(f"Date directive %{code[i + 1]} is not supported")
            flush()
            out.append(LETTERS[code[i + 1]])
            i += 2
        elif code.startswith("mmm", i):
            wide = code.startswith("mmmm", i)
            if wide:
                plain.append("0")
            flush()
            out.append("SSS")
            i += 3 + wide
        else:
            plain.append(code[i])
            i += 1
    flush()
    return "".join(out)


#: Date parts as int columns. A week starts every seventh day of the year; day is that of the week, 1 for Sunday.
PARTS = {
    "year": F.year,
    "month": F.month,
    "week": lambda d: F.floor(F.dayofyear(d) / 7) + 1,
    "day": F.dayofweek,
    "dayofweek": F.dayofweek,
    "dayofyear": F.dayofyear,
    "dayofmonth": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
}
NAMES = {"monthname": "MMMM", "dayname": "EEEE"}

_MICRO = "interval '0.000001' second"


def shift(date: Column, micros: Column, years: Column | None, sign: int) -> Column:
    """A date moved by a duration: by calendar years if it is whole years, else by its microseconds. 29 February moves to the 28th."""
    moved = date + F.lit(sign) * micros * F.expr(_MICRO)
    if years is None:
        return moved
    return F.when(years != 0, date + F.make_ym_interval(F.lit(sign) * years)).otherwise(moved)


def between(later: Column, earlier: Column) -> Column:
    """Microseconds from one date to another."""
    return F.timestamp_diff("MICROSECOND", earlier, later)


def now(utc: bool) -> Column:
    """The time at which the query began."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz") if utc else F.localtimestamp()
