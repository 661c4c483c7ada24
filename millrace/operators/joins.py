"""Joins on predicates, so that Spark need not compare all pairs where there is another way.

An OR or XOR of equalities becomes a union of hash joins; two bounds on one value become a band join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..language import syntax as S
from .ranges import band_join, is_large

#: Beyond so many branches the plan stays one join.
MAX_BRANCHES = 8


@dataclass(frozen=True)
class Branch:
    """Branches of a predicate exclude each other; `keyed` ones hold an equality that a join can hash by."""

    condition: Column
    keyed: bool


def branches(node: S.Node, predicate, keyed) -> list[Branch]:
    """A predicate as branches of which a pair of rows meets one at most. keyed(node): whether a comparison can be hashed by."""
    if isinstance(node, S.Logic):
        left, right = branches(node.left, predicate, keyed), branches(node.right, predicate, keyed)
        if node.op == "and":
            return [Branch(a.condition & b.condition, a.keyed or b.keyed) for a in left for b in right]
        not_left, not_right = ~predicate(node.left), ~predicate(node.right)
        second = [Branch(b.condition & not_left, b.keyed) for b in right]
        if node.op == "or":
            return left + second
        return [Branch(a.condition & not_right, a.keyed) for a in left] + second
    return [Branch(predicate(node), keyed(node))]


@dataclass(frozen=True)
class Band:
    """A value of one side that two comparisons bound by the other side's."""

    point: Column
    low: Column
    high: Column
    is_date: bool
    #: Whether the value is the left table's.
    of_left: bool


def join(left: DataFrame, right: DataFrame, node: S.Node, kind: str, predicate: Callable, keyed: Callable, band: Callable[[S.Node], Band | None]) -> DataFrame:
    """left joined to right; kind is inner or left. Their columns have distinct names."""
    found = branches(node, predicate, keyed)
    if len(found) == 1 and not found[0].keyed and (b := band(node)) and (kind == "inner" or b.of_left) and is_large(left) and is_large(right):
        sides = (left, right) if b.of_left else (right, left)
        out = band_join(*sides, b.point, b.low, b.high, b.is_date, predicate(node), kind == "left")
        return out.select(*left.columns, *right.columns)
    if len(found) == 1 or len(found) > MAX_BRANCHES or not all(b.keyed for b in found):
        return left.join(right, predicate(node), kind)
    # Rows of the left side stay apart even if equal: each branch joins, and the branches exclude each other.
    out = left.join(right, found[0].condition, "inner")
    for b in found[1:]:
        out = out.unionByName(left.join(right, b.condition, "inner"))
    if kind == "left":
        lonely = left
        for b in found:
            lonely = lonely.join(right, b.condition, "left_anti")
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
        out = out.unionByName(lonely.select("*", *blank))
    return out
