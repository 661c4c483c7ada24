"""Band joins: a point of one side between two bounds of the other.

Spark compares all pairs for inequalities. Here points are dealt to bins by their quantiles, each interval is put under
the bins that it spans, and the two meet by a hash join on the bin; the exact condition decides. A point has one bin, so
no pair comes twice. An interval spans BINS bins at most, which bounds what is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 256
#: Quantiles are told to this share of the rows; they only balance the bins.
ACCURACY = 2048

_BIN, _BINS = "_bin", "_bins"


def is_large(df: DataFrame) -> bool:
    """Whether Spark would not broadcast it, by its own estimate and threshold."""
    session = df.sparkSession._jsparkSession.sessionState()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > session.conf().autoBroadcastJoinThreshold()


def _number(c: Column, is_date: bool) -> Column:
    """A coordinate that keeps the order: dates as seconds."""
    return F.unix_timestamp(c.cast("timestamp")).cast("double") if is_date else c.cast("double")


def band_join(points: DataFrame, intervals: DataFrame, point: Column, low: Column, high: Column, is_date: bool, condition: Column, keep_points: bool = False) -> DataFrame:
    """Pairs that meet the condition, which must hold only where low <= point <= high. keep_points: points without a pair stay, with nulls."""
    x = _number(point, is_date)
    cuts = points.agg(F.percentile_approx(x, F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), F.lit(ACCURACY)).alias("cuts")).first()["cuts"]  # BINS numbers at most
    cuts = sorted(set(cuts or []))
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    place = lambda c: F.size(F.filter(edges, lambda e: e <= c))
    here = points.withColumn(_BIN, place(x))
    lo, hi = _number(low, is_date), _number(high, is_date)
    spans = F.when(lo <= hi, F.sequence(place(lo), place(hi)))
    there = intervals.withColumn(_BINS, F.explode(spans))
    return here.join(there, (F.col(_BIN) == F.col(_BINS)) & condition, "left" if keep_points else "inner").drop(_BIN, _BINS)
