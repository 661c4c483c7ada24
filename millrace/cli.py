"""python -m millrace.cli: runs a query and prints, writes or shows its rows."""

from __future__ import annotations

import argparse
import os
import sys
from importlib import metadata

from . import sinks
from .engine import Engine, Options
from .errors import QueryError

#: Settings that a configuration file may hold, a line `name = value` for each.
SETTINGS = {"guess_file_header": "true", "table_or_csv": "csv", "need_comma_separator": "true"}


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="millrace", description="A query, a file that holds one, or the words of one. Each {} of a query takes one of the last words, in quotes.")
    p.add_argument("words", nargs="*", metavar="QUERY", help="the query; several words are joined by blanks")
    p.add_argument("-f", dest="file", help="show all rows of a file as a table")
    p.add_argument("-o", dest="output", help="append the rows to a file as CSV")
    p.add_argument("-d", dest="directory", help="write the rows to a folder as CSV parts, by the executors")
    p.add_argument("-m", dest="optional_commas", action="store_true", help="commas between selections are optional, but result names need 'as'")
    form = p.add_mutually_exclusive_group()
    form.add_argument("-t", dest="form", action="store_const", const="table", help="print a table")
    form.add_argument("-y", dest="form", action="store_const", const="striped", help="print a table with a background for every other line")
    form.add_argument("-c", dest="form", action="store_const", const="csv", help="print CSV")
    form.add_argument("-j", dest="form", action="store_const", const="json", help=f"print JSON, {sinks.SHOWN_VALUES} values at most")
    form.add_argument("-w", dest="form", action="store_const", const="html", help=f"print an HTML table, {sinks.SHOWN_VALUES} values at most")
    p.add_argument("-v", dest="version", action="store_true", help="show the versions")
    p.add_argument("--standard-precedence", action="store_true")
    p.add_argument("--password", help="for encrypt and decrypt")
    p.add_argument("--catalog", help="JSON file of saved aliases")
    p.add_argument("--config", help="file of settings: " + ", ".join(SETTINGS))
    return p.parse_args(argv)


def settings(path: str | None) -> dict[str, str]:
    found = dict(SETTINGS)
    if path:
        with open(path) as f:
            for line in f:
                name, _, value = line.partition("#")[0].partition("=")
                if name.strip():
                    if name.strip() not in SETTINGS:
                        raise QueryError(f"Unknown setting {name.strip()}")
                    found[name.strip()] = value.strip()
    return found


def query_text(args: argparse.Namespace) -> str:
    """The query that the words stand for."""
    if args.file:
        return f"select * from '{args.file}'"
    words = list(args.words)
    if len(words) == 1 and os.path.isfile(words[0]) and not words[0].endswith((".csv", ".tsv")):
        with open(words[0]) as f:
            return f.read()
    text = words.pop(0) if words else ""
    holes = text.count("{}")
    if holes > len(words):
        raise QueryError(f"Query with {holes} pairs of braces must have as many matching arguments. Found {len(words)}")
    text = " ".join([text, *words[: len(words) - holes]])
    for word in words[len(words) - holes :]:
        text = text.replace("{}", f"'{word}'", 1)
    return text


def lines(result, form: str):
    if form == "json":
        return [sinks.to_json(result)]
    if form == "html":
        return [sinks.to_html(result)]
    return sinks.csv_text(result) if form == "csv" else sinks.boxes(result, striped=form == "striped")


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    if args.version:
        print(f"pyspark {metadata.version('pyspark')}")
        return 0
    from pyspark.sql import SparkSession

    try:
        text, given = query_text(args), settings(args.config)
        spark = SparkSession.builder.appName("millrace").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        options = Options(
            standard_precedence=args.standard_precedence,
            password=args.password,
            catalog=args.catalog,
            guess_header=given["guess_file_header"] == "true",
            optional_commas=args.optional_commas or given["need_comma_separator"] == "false",
        )
        form = args.form or ("table" if args.file else given["table_or_csv"])
        for result in Engine(spark, options).script(text):
            if args.directory:
                sinks.write_csv(result, args.directory)
            elif args.output:
                sinks.append_csv(result, args.output)
            else:
                for line in lines(result, form):
                    print(line)
    except QueryError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
