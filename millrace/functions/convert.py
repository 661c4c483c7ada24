"""Values of the six kinds as Spark columns, and the ways between them.

int is bigint, float double, date timestamp_ntz, text string. A duration is a bigint of microseconds beside an int
column of whole years, which calendar arithmetic uses; years is 0 for durations that aren't whole years.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, TimestampNTZType, TimestampType

from ..errors import QueryError
from ..plans import types as T
from ..plans.types import Kind

SPARK_TYPES = {Kind.INT: "bigint", Kind.FLOAT: "double", Kind.DATE: "timestamp_ntz", Kind.DURATION: "bigint", Kind.TEXT: "string", Kind.NULL: "string"}
DATE_TEXT = "yyyy-MM-dd HH:mm:ss"


@dataclass(frozen=True)
class Expr:
    kind: Kind
    col: Column
    years: Column | None = None


def null(kind: Kind) -> Expr:
    return Expr(kind, F.lit(None).cast(SPARK_TYPES[kind]))


def years_of(e: Expr) -> Column:
    return F.lit(0) if e.years is None else e.years


@F.pandas_udf(StringType())
def float_text(values: pd.Series) -> pd.Series:
    """The C format %.10g, which Java's formatter lacks."""
    return values.map(lambda v: None if v is None else "%.10g" % v if v == v else "nan", na_action=None)


def _float_text(c: Column) -> Column:
    # Arrow hands a null double over as NaN.
    return F.when(c.isNotNull(), float_text(c))


def duration_text(micros: Column, years: Column) -> Column:
    """[-]NdNhNmNsNms, Ny for whole years, 0d for none."""
    size = F.abs(micros)
    unit = lambda n, sign: F.when(n > 0, F.concat(n.cast("string"), F.lit(sign))).otherwise("")
    part = lambda width, of: F.floor(size % F.lit(of) / F.lit(width)) if of else F.floor(size / F.lit(width))
    U = T.UNIT_MICROS
    rest = size % F.lit(U["s"])
    small = F.when(rest == 0, "").when(rest % 1000 == 0, F.concat(F.floor(rest / 1000).cast("string"), F.lit("ms"))).otherwise(F.concat(rest.cast("string"), F.lit("mcs")))
    text = F.concat(
        F.when(micros < 0, "-").otherwise(""),
        unit(part(U["d"], None), "d"),
        unit(part(U["h"], U["d"]), "h"),
        unit(part(U["m"], U["h"]), "m"),
        unit(part(U["s"], U["m"]), "s"),
        small,
    )
    whole = (years != 0) & (size % F.lit(U["y"]) == 0)
    return F.when(micros == 0, "0d").when(whole, F.concat(years.cast("string"), F.lit("y"))).otherwise(text)


def text_of(e: Expr) -> Column:
    match e.kind:
        case Kind.TEXT | Kind.NULL:
            return e.col
        case Kind.INT:
            return e.col.cast("string")
        case Kind.FLOAT:
            return _float_text(e.col)
        case Kind.DATE:
            return F.date_format(e.col, DATE_TEXT)
        case Kind.DURATION:
            return duration_text(e.col, years_of(e))
    raise AssertionError(e.kind)


def _int_of(text: Column) -> Column:
    """The number a text begins with; the whole text is tried first, as it is cheaper."""
    return F.coalesce(text.try_cast("bigint"), F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"))


def _float_of(text: Column) -> Column:
    # Java takes a type letter at the end.
    return F.when(~text.rlike(r"[dDfF]\s*$"), text.try_cast("double"))


def _iso(text: Column, pattern: str, year: int, month: Column, day: int) -> Column:
    get = lambda i: F.regexp_extract(text, pattern, i)
    two = lambda c: F.lpad(c, 2, "0")
    time = F.when(get(4) == "", "00:00:00").otherwise(F.concat(two(get(4)), F.lit(":"), get(5), F.lit(":"), F.when(get(6) == "", "00").otherwise(get(6))))
    return F.concat(get(year), F.lit("-"), two(month), F.lit("-"), two(get(day)), F.lit(" "), time).try_cast("timestamp_ntz")


def _date_of(text: Column) -> Column:
    get = lambda p, i: F.regexp_extract(text, p, i)
    name = F.lower(get(T.NAMED_DATE, 1))
    month = F.coalesce(*[F.when(F.startswith(F.lit(m), name), F.lit(str(i))) for i, m in enumerate(T.MONTHS, 1)])
    return (
        F.when(text.rlike(T.ISO_DATE), _iso(text, T.ISO_DATE, 1, get(T.ISO_DATE, 2), 3))
        .when(text.rlike(T.US_DATE), _iso(text, T.US_DATE, 3, get(T.US_DATE, 1), 2))
        .when(text.rlike(T.NAMED_DATE), _iso(text, T.NAMED_DATE, 3, month, 2))
    )


def _duration_of(text: Column) -> Expr:
    quantity = F.regexp_extract(text, T.DURATION, 1).try_cast("double")
    unit = F.regexp_extract(text, T.DURATION, 2)
    letter = F.when(unit == "ms", unit).otherwise(F.substring(unit, 1, 1))
    factor = F.coalesce(*[F.when(letter == u, F.lit(n)) for u, n in T.UNIT_MICROS.items()])
    n = F.floor(quantity)
    whole = (letter == "y") & (quantity == n)
    leap = F.when(letter == "y", (F.floor(n / 4) - F.floor(n / 100) + F.floor(n / 400)) * F.lit(T.UNIT_MICROS["d"])).otherwise(F.lit(0).cast("bigint"))
    micros = F.when(text.rlike(T.DURATION), (quantity * factor).cast("bigint") + leap)
    return Expr(Kind.DURATION, micros, F.when(whole, n.cast("int")).otherwise(0))


def from_text(text: Column, kind: Kind) -> Expr:
    match kind:
        case Kind.TEXT | Kind.NULL:
            return Expr(Kind.TEXT, text)
        case Kind.INT:
            return Expr(kind, _int_of(text))
        case Kind.FLOAT:
            return Expr(kind, _float_of(text))
        case Kind.DATE:
            return Expr(kind, _date_of(text))
        case Kind.DURATION:
            return _duration_of(text)
    raise AssertionError(kind)


def convert(e: Expr, kind: Kind) -> Expr:
    """e as another kind; only what the language converts."""
    if e.kind == kind or kind == Kind.NULL:
        return e
    if e.kind == Kind.NULL:
        return null(kind)
    if kind == Kind.TEXT:
        return Expr(kind, text_of(e))
    if e.kind == Kind.TEXT:
        return from_text(e.col, kind)
    if e.kind == Kind.INT and kind == Kind.FLOAT:
        return Expr(kind, e.col.cast("double"))
    if e.kind == Kind.FLOAT and kind == Kind.INT:
        return Expr(kind, e.col.try_cast("bigint"))
    raise QueryError(f"Cannot convert {e.kind.name.lower()} to {kind.name.lower()}")


def literal(text: str, kind: Kind) -> Expr:
    """A literal read as the kind that is asked for; null where it can't be."""
    value, years = None, None
    match kind:
        case Kind.TEXT | Kind.NULL:
            value = text
        case Kind.INT:
            m = T.re.match(r"\s*[+-]?[0-9]+", text)
            value = int(m[0]) if m else None
        case Kind.FLOAT:
            try:
                value = float(text)
            except ValueError:
                value = None
        case Kind.DATE:
            value = T.parse_date(text)
        case Kind.DURATION:
            if got := T.parse_duration(text):
                value, years = got[0], F.lit(got[1])
    if value is None:
        return null(kind)
    return Expr(Kind.TEXT if kind == Kind.NULL else kind, F.lit(value).cast(SPARK_TYPES[kind]), years)


def kind_of(spark_type: DataType) -> Kind:
    if isinstance(spark_type, IntegralType):
        return Kind.INT
    if isinstance(spark_type, (FloatType, DoubleType, DecimalType)):
        return Kind.FLOAT
    if isinstance(spark_type, (TimestampType, TimestampNTZType, DateType)):
        return Kind.DATE
    return Kind.TEXT
