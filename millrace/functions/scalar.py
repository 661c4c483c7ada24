"""The scalar functions other than conversions: what kind each takes and gives, and its column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.types import Kind
from . import cipher, dates

LOWER = "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Scalar:
    takes: Kind
    gives: Kind
    make: Callable[[Column], Column]


def _finite(c: Column, nan: bool) -> Column:
    """Without the NAN option, what is not a number is null."""
    return c if nan else F.when(~F.isnan(c), c)


def _log(of: Callable[[Column], Column], nan: bool) -> Callable[[Column], Column]:
    """Spark gives null up to 0. The logarithm of 0 is -inf where NAN asks for it; that of a negative number is never a number."""
    return lambda x: F.when(x < 0, F.lit(float("nan"))).when(x == 0, F.lit(float("-inf")) if nan else F.lit(None)).otherwise(of(x))


def scalars(nan: bool) -> dict[str, Scalar]:
    I, X, D, S = Kind.INT, Kind.FLOAT, Kind.DATE, Kind.TEXT
    digest = lambda f: lambda x: F.base64(F.unhex(f(x)))
    out = {
        "acos": Scalar(X, X, lambda x: _finite(F.acos(x), nan)),
        "asin": Scalar(X, X, lambda x: _finite(F.asin(x), nan)),
        "atan": Scalar(X, X, lambda x: _finite(F.atan(x), nan)),
        "cos": Scalar(X, X, F.cos),
        "sin": Scalar(X, X, F.sin),
        "tan": Scalar(X, X, F.tan),
        "exp": Scalar(X, X, F.exp),
        "log": Scalar(X, X, _log(F.ln, nan)),
        "log2": Scalar(X, X, _log(F.log2, nan)),
        "log10": Scalar(X, X, _log(F.log10, nan)),
        "sqrt": Scalar(X, X, lambda x: _finite(F.sqrt(x), nan)),
        "cbrt": Scalar(X, X, F.cbrt),
        "upper": Scalar(S, S, lambda x: F.translate(x, LOWER, LOWER.upper())),
        "lower": Scalar(S, S, lambda x: F.translate(x, LOWER.upper(), LOWER)),
        "len": Scalar(S, X, lambda x: F.coalesce(F.octet_length(x), F.lit(0)).cast("double")),
        "md5": Scalar(S, S, digest(F.md5)),
        "sha1": Scalar(S, S, digest(F.sha1)),
        "sha256": Scalar(S, S, digest(lambda x: F.sha2(x, 256))),
        "sip": Scalar(S, I, cipher.sip),
        "base64_encode": Scalar(S, S, lambda x: F.base64(x.cast("binary"))),
        "base64_decode": Scalar(S, S, lambda x: F.try_to_binary(x, F.lit("base64")).cast("string")),
    }
    out |= {n: Scalar(D, I, lambda x, f=f: f(x).cast("bigint")) for n, f in dates.PARTS.items()}
    out |= {n: Scalar(D, S, lambda x, p=p: F.date_format(x, p)) for n, p in dates.NAMES.items()}
    return out


def rounded(name: str, x: Column, digits: int) -> Column:
    """ceil, floor or round at so many digits; halves go away from zero. 0 keeps its sign off."""
    scale = F.lit(float(10 ** abs(digits)))
    up = x * scale if digits >= 0 else x / scale
    if name == "round":
        whole = F.when(up < 0, F.ceil(up - 0.5)).otherwise(F.floor(up + 0.5)).cast("double")
    else:
        whole = {"ceil": F.ceil, "floor": F.floor}[name](up).cast("double")
    # ceil and floor give bigint; beyond its range a double has no fraction to lose.
    whole = F.when(F.abs(up) < F.lit(9.0e15), whole).otherwise(up)
    return whole / scale if digits >= 0 else whole * scale


def substring(text: Column, start: int, n: int) -> Column:
    """n bytes from a place counted from 0; null from beyond the end."""
    raw = text.cast("binary")
    return F.when(F.octet_length(text) > start, F.substring(raw, start + 1, n).cast("string"))


def random() -> Column:
    """A whole number of 32 bits."""
    return F.floor(F.rand() * F.lit(float(1 << 32))).cast("double")
