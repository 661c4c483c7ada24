"""Global row numbers without a global sort."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: monotonically_increasing_id() holds the partition above so many bits, and the place in it below.
_PLACE_BITS = 33


def number_rows(df: DataFrame, name: str, place: list[str] | None = None) -> DataFrame:
    """df with the row's number from 1, as a double, in partition order.

    Each partition counts its own rows; only the counts, a row for each partition, are summed up in one place. Counts and
    rows are two runs over the same plan, so df must deal its rows alike each time: a scan or a sort does. place: columns
    that come before that order, where the rows of a partition that share them stand together.
    """
    keys = [*(place or []), "_part"]
    numbered = df.withColumn(name, F.monotonically_increasing_id()).withColumn("_part", F.shiftright(name, _PLACE_BITS))
    counts = numbered.select(*keys, name).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(name).alias("_first"))
    before = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first", F.coalesce(F.sum("_n").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    # A row for each partition, or each part of a file in it: at most some thousands.
    out = numbered.join(F.broadcast(before), reduce(and_, same), "left")
    return out.withColumn(name, (F.col(name) - F.col("_first") + F.col("_before") + 1).cast("double")).drop("_part", "_first", "_before", *[f"_k{i}" for i in range(len(keys))])
