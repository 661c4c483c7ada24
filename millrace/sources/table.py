"""A table of a query: a DataFrame whose columns the language can address."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.convert import Expr, from_text, kind_of, text_of
from ..plans.types import Kind


#: Columns of a DataFrame that say where a row of delimited text stands, beside its fields: file, and start of the split.
PLACE = ("_path", "_start")


@dataclass(frozen=True)
class Field:
    name: str
    kind: Kind
    #: Name in the table's DataFrame.
    column: str
    #: Raw text, of which each use reads the kind that it needs; else a typed column.
    raw: bool

    def bare(self) -> Expr:
        """As it stands: raw text unparsed, a typed column untouched."""
        if self.raw:
            return Expr(Kind.TEXT, F.nullif(F.col(self.column), F.lit("")))
        return Expr(self.kind, F.col(self.column))

    def typed(self) -> Expr:
        """A typed column as its kind's own Spark type."""
        c = F.col(self.column)
        cast = {Kind.INT: "bigint", Kind.FLOAT: "double", Kind.DATE: "timestamp_ntz", Kind.TEXT: "string"}[self.kind]
        return Expr(self.kind, c.cast(cast))

    def read(self, kind: Kind) -> Expr:
        """As the kind that an expression needs. Leaves are read anew for each use: text of a raw column is its own text."""
        if self.raw:
            return from_text(self.bare().col, kind)
        own = self.typed()
        if kind in (own.kind, Kind.NULL):
            return own
        if kind == Kind.FLOAT and own.kind == Kind.INT:
            return Expr(kind, own.col.cast("double"))
        if kind == Kind.INT and own.kind == Kind.FLOAT:
            return Expr(kind, own.col.try_cast("bigint"))
        return from_text(text_of(own), kind)


@dataclass
class Table:
    df: DataFrame
    fields: list[Field]
    #: Whether names come from a header or a schema, not from positions.
    named: bool
    names: set[str]
    #: Column that orders the rows, where the query needs one.
    ordinal: str
    #: Columns for file and split, where the rows come from several files.
    place: list[str]

    @staticmethod
    def of(df: DataFrame, names: list[str], kinds: list[Kind], raw: bool, named: bool, aliases: set[str], number: int, ordered: bool) -> Table:
        """df renamed apart from the query's other tables."""
        columns = [f"t{number}_{i}" for i in range(len(names))]
        ordinal = f"t{number}_ord"
        # The columns of the place come after those of the fields.
        place = [f"t{number}{p}" for p in PLACE if raw and len(df.columns) > len(names)]
        table = Table(df.toDF(*columns, *place), [Field(n, k, c, raw) for n, k, c in zip(names, kinds, columns, strict=True)], named, aliases, ordinal, place)
        if ordered:
            table.number()
        return table

    def number(self) -> None:
        """Adds the ordinal: by files and their splits, then by the scan, which reads a single file in order."""
        own = F.monotonically_increasing_id()
        self.df = self.df.withColumn(self.ordinal, F.struct(*self.place, own.alias("_row")) if self.place else own)

    def find(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def nth(self, i: int) -> Field | None:
        """By position from 1."""
        return self.fields[i - 1] if 1 <= i <= len(self.fields) else None


def typed_kinds(df: DataFrame) -> list[Kind]:
    return [kind_of(f.dataType) for f in df.schema.fields]
