"""From the name after `from` to a table: registered DataFrames, saved aliases, files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryError
from . import delimited
from .table import Table, typed_kinds

COLUMNAR = {".parquet": "parquet", ".orc": "orc"}


class Catalog:
    """Tables by name. Saved aliases are kept in a JSON file if one is named, else for the session."""

    def __init__(self, spark: SparkSession, path: str | None = None, multiline: bool = True, ragged: str = "raise", guess_header: bool = True):
        self.spark, self.path, self.multiline, self.ragged, self.guess_header = spark, path, multiline, ragged, guess_header
        self.frames: dict[str, DataFrame] = {}
        #: Streaming tables: rows as text, names, kinds, whether there is a header.
        self.streams: dict[str, tuple] = {}
        self.aliases: dict[str, tuple[str, list[str]]] = {}
        if path and os.path.exists(path):
            with open(path) as f:
                self.aliases = {k: (v[0], v[1]) for k, v in json.load(f).items()}
        #: What reading a file's first rows has told, by path and options.
        self.seen: dict[tuple, tuple] = {}

    def _settled(self, options: frozenset[str]) -> frozenset[str]:
        """Options with the header's when none is given and none is to be guessed."""
        return options if self.guess_header or options & {"H", "NH", "AH"} else options | {"H"}

    def register(self, name: str, df: DataFrame) -> None:
        self.frames[name] = df

    def add_stream(self, name: str, folder: str, options: frozenset[str], files_per_batch: int | None) -> None:
        self.streams[name] = delimited.read(self.spark, self.resolve(folder), self._settled(options), self.multiline, self.ragged, True, files_per_batch)

    def add(self, name: str, path: str, options: frozenset[str]) -> None:
        self.aliases[name] = (self.resolve(path), sorted(options))
        self._save()

    def drop(self, name: str) -> None:
        if name not in self.aliases:
            raise QueryError(f"Table '{name}' not found")
        del self.aliases[name]
        self._save()

    def _save(self) -> None:
        if self.path:
            temporary = f"{self.path}.new"
            with open(temporary, "w") as f:
                json.dump(self.aliases, f, indent=1)
            os.replace(temporary, self.path)

    def _exists(self, path: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    def resolve(self, path: str) -> str:
        """The path, or it with .csv; ~/ is the home folder. Paths are those of any store that Spark reads."""
        path = os.path.expanduser(path) if path.startswith("~/") else path
        if "://" not in path:
            path = os.path.abspath(path)
        for p in (path, f"{path}.csv"):
            if self._exists(p):
                return p
        raise QueryError(f"Could not open file '{path}'")

    def open(self, name: str, options: frozenset[str], alias: str | None, number: int, ordered: bool) -> Table:
        """Table number `number` of a query. options: those of the query, overridden by those at the file."""
        base = os.path.basename(name.rstrip("/")).rsplit(".", 1)[0]
        aliases = {f"_f{number}", base} | ({alias} if alias else set())
        if name in self.frames:
            df = self.frames[name]
            return Table.of(df, df.columns, typed_kinds(df), False, True, aliases | {name}, number, ordered)
        if name in self.streams:
            df, names, kinds, header = self.streams[name]
            return Table.of(df, names, kinds, True, header, aliases | {name}, number, ordered)
        if name in self.aliases:
            aliases.add(name)
            name, saved = self.aliases[name]
            options = merged(frozenset(saved), options)
        path = self.resolve(name)
        form = next((f for end, f in COLUMNAR.items() if path.rstrip("/").endswith(end)), None)
        if form:
            df = self.spark.read.format(form).load(path)
            return Table.of(df, df.columns, typed_kinds(df), False, True, aliases, number, ordered)
        options = self._settled(options)
        key = (path, options & {"H", "NH", "AH", "S", "P", "T"})
        if key not in self.seen:
            self.seen[key] = delimited.read(self.spark, path, options, self.multiline, self.ragged)
        df, names, kinds, header = self.seen[key]
        return Table.of(df, names, kinds, True, header, aliases, number, ordered)


def merged(outer: frozenset[str], inner: frozenset[str]) -> frozenset[str]:
    """Options at a file win over those before the query."""
    for group in ({"H", "NH", "AH"}, {"S", "P", "T"}):
        if inner & group:
            outer -= group
    return outer | inner
