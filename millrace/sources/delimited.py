"""Delimited text: every column is read as text, and kinds are inferred by the language's own lattice."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.convert import from_text
from ..plans import types as T
from ..plans.types import Kind
from . import quoted
from .table import PLACE

#: Rows that inference looks at.
SAMPLE = 10_000
#: Bytes of small files that it looks at together.
TOGETHER = 1 << 18
DELIMITERS = {"S": " ", "P": "|", "T": "\t"}
#: What happens to a row with fewer or more fields than the first one.
RAGGED = {"raise": "FAILFAST", "pad": "PERMISSIVE", "drop": "DROPMALFORMED"}

#: Names a column for rows to drop.
BAD = "_bad"


def narrowest(cell: Column) -> Column:
    """The kind of one cell; empty cells, null and NA say nothing."""
    number = lambda k: F.lit(int(k))
    return (
        F.when(cell.isNull() | (cell == "") | (F.lower(cell) == "null") | (cell == "NA"), number(Kind.NULL))
        .when(cell.rlike(T.LEADING_ZERO), number(Kind.TEXT))
        .when(cell.rlike(T.INTEGER), number(Kind.INT))
        .when(cell.rlike(T.DECIMAL), number(Kind.FLOAT))
        .when(cell.rlike(T.DURATION), number(Kind.DURATION))
        .when(from_text(cell, Kind.DATE).col.isNotNull(), number(Kind.DATE))
        .otherwise(number(Kind.TEXT))
    )


def kinds_of(parts: Iterable[DataFrame], width: int, sample: int = SAMPLE) -> list[Kind]:
    """The widest kind of each column over the first rows of the parts; text for a column without values."""
    rows: list[tuple] = []
    for df in parts:
        # A limit at the top takes the first rows in order and stops there; below an aggregate it would take some of every task.
        rows += df.select([narrowest(F.col(f"c{i}")) for i in range(width)]).limit(sample - len(rows)).collect()
        if len(rows) >= sample:
            break
    return [Kind(k) if k else Kind.TEXT for k in map(max, zip(*rows))] if rows else [Kind.TEXT] * width


def delimiter(path: str, options: frozenset[str]) -> str:
    found = next((DELIMITERS[o] for o in options if o in DELIMITERS), None)
    return found or ("\t" if path.endswith(".tsv") else ",")


def _options(sep: str, multiline: bool) -> dict[str, str]:
    out = {"sep": sep, "escape": '"', "multiLine": str(multiline).lower(), "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "emptyValue": ""}
    return out if sep == "," else out | {"quote": ""}  # quotes have a meaning with commas alone


def _by_name(spark: SparkSession, path: str) -> list[str]:
    """The path, or the files there by their names, as a reader takes them."""
    files = sorted(spark.read.schema("c0 string").csv(path).inputFiles())
    if len(files) < 2:
        return [path]
    jvm = spark._jvm
    # Names may hold the signs of patterns.
    return [T.re.sub(r"([\\{}\[\]*?])", r"\\\1", jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString()) for f in files]


def _parts(spark: SparkSession, paths: list[str], reader: Callable[[list[str]], DataFrame]) -> Iterator[DataFrame]:
    """Files by their names, one by one or small ones together: Spark reads the largest first."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def size(path: str) -> int:
        p = jvm.org.apache.hadoop.fs.Path(T.re.sub(r"\\(.)", r"\1", path))
        return p.getFileSystem(conf).getFileStatus(p).getLen()

    some, held = [], 0
    for p in paths:
        n = size(p)
        if some and held + n > TOGETHER:
            yield _ordered(reader(some), len(some))
            some, held = [], 0
        some.append(p)
        held += n
    yield _ordered(reader(some), len(some))


def _ordered(df: DataFrame, files: int) -> DataFrame:
    """A few small files in the order of their names."""
    if files == 1:
        return df
    return df.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.monotonically_increasing_id().alias("_row")).orderBy(PLACE[0], "_row")


def _breaks(spark: SparkSession, path: str) -> dict[str, str] | None:
    """The line break of each file, if some file is larger than a task should read and all can be cut at line feeds: neither compressed nor with carriage returns alone."""
    state, jvm = spark._jsparkSession.sessionState(), spark._jvm
    limit = state.conf().filesMaxPartitionBytes()
    files = spark.read.format("binaryFile").load(path).select("length", "_metadata.file_path")
    if files.agg(F.max("length")).first()[0] <= limit:
        return None
    conf = state.newHadoopConf()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out = {}
    for _, f in files.collect():
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        if codecs.getCodec(p) is not None:
            return None
        stream = p.getFileSystem(conf).open(p)
        try:
            # Spark's parser, too, goes by the first line break.
            out[f] = jvm.java.util.Scanner(stream, "ISO-8859-1").findWithinHorizon("\r\n|\r|\n", 1 << 20) or "\n"
        finally:
            stream.close()
    return None if "\r" in out.values() else out


def _parsed(rows: DataFrame, width: int, sep: str, ragged: str) -> DataFrame:
    """Records of `quoted` as the reader would give them. The delimiter after each makes one more field, which is empty."""
    columns = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{c} string" for c in [*columns, "_after", *([BAD] if ragged == "drop" else [])])
    options = _options(sep, False) | {"mode": "PERMISSIVE" if ragged == "drop" else RAGGED[ragged], "columnNameOfCorruptRecord": BAD}
    out = rows.select(F.from_csv(F.col("record").cast("string"), schema, options).alias("_f"), *PLACE).select("_f.*", *PLACE)
    return (out.where(F.col(BAD).isNull()) if ragged == "drop" else out).select(*columns, *PLACE)


def read(spark: SparkSession, path: str, options: frozenset[str], multiline: bool = True, ragged: str = "raise", stream: bool = False, files_per_batch: int | None = None) -> tuple[DataFrame, list[str], list[Kind], bool]:
    """Rows as text, names, kinds, and whether the names come from a header.

    Quoted fields may span lines. Files larger than a split are asked first, by all tasks, whether any does; if not,
    Spark splits them, else `quoted` does. `multiline=False` says that none does and saves the question. Of other files
    only the sample and the first row are looked at before the query runs. stream: the rows go on with files that come to
    the folder later, a file to a task.
    """
    if ragged not in RAGGED:
        raise QueryError(f"ragged must be one of {', '.join(RAGGED)}")
    sep = delimiter(path, options)
    paths = _by_name(spark, path)
    first = next((rows for p in paths if (rows := spark.read.options(**_options(sep, multiline)).csv(p).limit(1).collect())), None)
    if not first:
        raise QueryError(f"{path} has no rows")
    cells = [x or "" for x in first[0]]
    if "H" in options:
        header = True
    elif "NH" in options:
        header = False
    else:
        header = not any(T.re.match(T.INTEGER, x) or T.re.match(T.DECIMAL, x) for x in cells)
    schema = ", ".join(f"c{i} string" for i in range(len(cells)))
    whole = lambda reader, multiline: reader.options(**_options(sep, multiline)).schema(schema).option("header", header).option("enforceSchema", True).option("mode", RAGGED[ragged])
    names = [x if header and x else f"col{i}" for i, x in enumerate(cells, 1)]
    df = whole(spark.read, multiline).csv(path)
    parts = [df] if len(paths) == 1 else _parts(spark, paths, whole(spark.read, multiline).csv)
    if not stream:
        breaks = _breaks(spark, path) if multiline else None
        cut = breaks is not None
        start = quoted.starts(spark, path) if cut and sep == "," else None
        if start:
            df = _parsed(quoted.records(spark, path, start, header, {f for f, x in breaks.items() if x == "\r\n"}), len(cells), sep, ragged)
        else:
            df = whole(spark.read.option("lineSep", "\n") if cut else spark.read, multiline and not cut).csv(path)
            df = df.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]))
        if len(paths) == 1:
            df, parts = df.drop(*PLACE), [df]  # Spark reads files by size: the names of several tell their order.
    kinds = kinds_of(parts, len(cells))
    if stream:
        reader = whole(spark.readStream, multiline)
        df = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).csv(path)
    return df, names, kinds, header
