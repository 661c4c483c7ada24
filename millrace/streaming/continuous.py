"""Queries over folders that go on receiving delimited files.

A query without groups is answered for new rows only; one with groups is answered anew for all rows so far. What Spark
cannot keep up over a stream - row numbers, the first or last row of a group, order without groups - it refuses.
"""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..language import syntax as S
from ..language.grammar import parse
from ..plans.scope import Scope


def add_stream(engine: Engine, name: str, folder: str, options: frozenset[str] = frozenset(), files_per_batch: int | None = None) -> Engine:
    """Makes a folder a streaming table. Names and kinds come from the files that are there already."""
    engine.catalog.add_stream(name, folder, options, files_per_batch)
    return engine


def is_grouped(query: S.Query) -> bool:
    scope = Scope([], dict(query.variables))
    return bool(query.group) or any(scope.aggregated(i.expr) for i in query.items)


def start(engine: Engine, text: str, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs a query over streaming tables.

    Rows of a query without groups are appended as Parquet files under `path`. The whole answer of one with groups
    replaces the files there after each batch. once: ends when what is there now has been read.
    """
    tree = parse(text, engine.options.standard_precedence, engine.options.optional_commas)
    df = engine.sql(text)
    writer = df.writeStream.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    if isinstance(tree, S.Query) and is_grouped(tree):
        return writer.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start()
    return writer.outputMode("append").format("parquet").option("path", path).start()
