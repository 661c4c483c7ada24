"""The engine: a session, its tables, and queries over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .errors import QueryError
from .language import syntax as S
from .language.grammar import parse
from .language.tokens import statements
from .plans.builder import Builder, Plan
from .plans.types import Kind
from .sources.catalog import Catalog


@dataclass(frozen=True)
class Options:
    #: Left-associative arithmetic and the usual levels of not, and, xor, or.
    standard_precedence: bool = False
    #: Commas between selections are optional, as by the option M of a query.
    optional_commas: bool = False
    #: Whether files without an option have a header is told by their first row; else they have one.
    guess_header: bool = True
    #: Quoted fields may span lines; without it Spark splits large files.
    multiline: bool = True
    #: Rows with fewer or more fields than the first: raise, pad or drop.
    ragged: str = "raise"
    #: For encrypt and decrypt without a password of their own.
    password: str | None = None
    #: JSON file of saved aliases; none keeps them for the session.
    catalog: str | None = None


@dataclass(frozen=True)
class Result:
    """A query's rows, with what a sink needs to know of them."""

    df: DataFrame
    kinds: tuple[Kind, ...]
    header: bool
    query: str

    @property
    def names(self) -> list[str]:
        return self.df.columns


class Engine:
    """Runs queries in a session, whose configuration it leaves as it is."""

    def __init__(self, spark: SparkSession, options: Options | None = None):
        self.spark, self.options = spark, options or Options()
        self.catalog = Catalog(spark, self.options.catalog, self.options.multiline, self.options.ragged, self.options.guess_header)

    def register(self, name: str, df: DataFrame) -> Engine:
        """Makes a DataFrame, batch or streaming, a table."""
        self.catalog.register(name, df)
        return self

    def query(self, text: str) -> Result:
        """One statement. Statements on saved aliases give the aliases."""
        tree = parse(text, self.options.standard_precedence, self.options.optional_commas)
        if isinstance(tree, S.Catalogue):
            return self._catalogue(tree, text)
        plan: Plan = Builder(self.catalog, self.options.password).build(tree)
        return Result(plan.df, tuple(plan.kinds), plan.header, text)

    def sql(self, text: str) -> DataFrame:
        """The rows of one statement."""
        return self.query(text).df

    def script(self, text: str) -> list[Result]:
        """Statements cut at semicolons, in order."""
        return [self.query(s) for s in statements(text)]

    def _catalogue(self, tree: S.Catalogue, text: str) -> Result:
        if tree.action == "add":
            self.catalog.add(tree.name, tree.path, tree.options)
        elif tree.action == "drop":
            self.catalog.drop(tree.name)
        rows = [(n, p, " ".join(o)) for n, (p, o) in sorted(self.catalog.aliases.items())]
        df = self.spark.createDataFrame(rows, "name string, path string, options string")
        return Result(df, (Kind.TEXT,) * 3, True, text)


__all__ = ["Engine", "Options", "QueryError", "Result"]
