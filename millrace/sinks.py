"""Where results go: CSV, a box for the terminal, JSON, HTML. Text is made by Spark; capped forms fetch no more than their cap."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, TimestampNTZType, TimestampType

from .engine import Result
from .functions.convert import DATE_TEXT, Expr, text_of
from .plans.types import Kind

#: Values that a capped form shows at most.
SHOWN_VALUES = 20_000
BOX_ROWS = 100


def _text(c: Column, spark_type) -> Column:
    if isinstance(spark_type, (FloatType, DoubleType)):
        return text_of(Expr(Kind.FLOAT, c.cast("double")))
    if isinstance(spark_type, (TimestampType, TimestampNTZType)):
        return F.date_format(c, DATE_TEXT)
    return c.cast("string")


def rendered(result: Result) -> DataFrame:
    """Every value as the text that the language shows; null as the empty text."""
    # Names may repeat, so columns go by place.
    df = result.df.toDF(*[f"c{i}" for i in range(len(result.names))])
    return df.select(*[F.coalesce(_text(F.col(f"c{i}"), f.dataType), F.lit("")).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])


def csv_lines(result: Result) -> DataFrame:
    """One column, value: the rows as CSV. A field is quoted if it holds a comma, a quote's double or a line break."""
    quoted = lambda c: F.when(c.rlike('[,\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    df = rendered(result)
    return df.select(F.concat_ws(",", *[quoted(F.col(c)) for c in df.columns]).alias("value"))


def csv_header(result: Result) -> str:
    return ",".join(f'"{n}"' if "," in n else n for n in result.names)


def write_csv(result: Result, path: str) -> None:
    """A folder of CSV parts written by the executors, each with the header if the result has one."""
    lines = csv_lines(result)
    if result.header:
        lines = lines.withColumnRenamed("value", csv_header(result))
        lines.write.option("header", True).option("quote", "").option("emptyValue", "").option("sep", "\x01").csv(path)
    else:
        lines.write.text(path)


def csv_text(result: Result):
    """Lines one by one, partition by partition: the driver holds one partition at most."""
    if result.header:
        yield csv_header(result)
    for row in csv_lines(result).toLocalIterator():
        yield row[0]


def append_csv(result: Result, path: str) -> None:
    """To the end of one local file."""
    with open(path, "a") as f:
        for line in csv_text(result):
            f.write(line + "\n")


def _capped(result: Result) -> tuple[list[list[str]], int]:
    """The rows shown, and how many there are."""
    most = max(1, SHOWN_VALUES // max(1, len(result.names)))
    rows = [list(r) for r in rendered(result).limit(most).collect()]
    return rows, len(rows) if len(rows) < most else result.df.count()


def to_json(result: Result) -> str:
    rows, n = _capped(result)
    return json.dumps({"query": result.query, "numrows": n, "showrows": len(rows), "numcols": len(result.names), "colnames": result.names, "types": [k.name.lower() for k in result.kinds], "vals": rows}, ensure_ascii=False)


def to_html(result: Result) -> str:
    rows, n = _capped(result)
    row = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    return f"<table data-rows='{n}'>" + row("th", result.names) + "".join(row("td", r) for r in rows) + "</table>"


def boxes(result: Result, striped: bool = False):
    """Lines of terminal tables of BOX_ROWS rows each, as wide as their widest cells. striped: every other row has a background."""
    held: list[list[str]] = []

    def box():
        width = [max(len(x) for x in column) for column in zip(result.names, *held, strict=True)]
        rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
        line = lambda cells: "|" + "|".join(f" {c.ljust(w)} " for c, w in zip(cells, width, strict=True)) + "|"
        rows = [f"\x1b[100m{line(r)}\x1b[0m" if striped and i % 2 else line(r) for i, r in enumerate(held)]
        return [rule, line(result.names), rule, *rows, rule]

    for r in rendered(result).toLocalIterator():
        held.append(list(r))
        if len(held) == BOX_ROWS:
            yield from box()
            held = []
    yield from box() if held else ()


# What the browser did with a shown result, as queries on it.


def sorted_by(result: Result, column: str, descending: bool = False) -> DataFrame:
    return result.df.orderBy(F.col(column).desc() if descending else F.col(column).asc())


def having_value(result: Result, column: str, value) -> DataFrame:
    return result.df.where(F.col(column).eqNullSafe(F.lit(value)))


def without(result: Result, *columns: str) -> DataFrame:
    return result.df.drop(*columns)
