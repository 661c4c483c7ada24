"""Quality rules by cross-document line frequency (operator 2), in DataFrame functions alone.

Lines are normalised (lower case, runs of white space as one space, trimmed) and hashed. For each host a line's
frequency is the number of distinct documents (ids) that hold it. A line above `max_documents` is boilerplate and is
removed from all of them. A document is depleted if less than `min_share` of the characters of its normalised lines
remain. Two departures are there to be asked for: `copies_once` counts distinct texts, where a later stage is to judge
exact copies, and `spare_first` leaves the lines in the first bearer (smallest id, and copies of its text).

Defined results: a null text is the empty text; a null host is a host of its own, and null ids are one document; empty
tables give empty results; copies of a row get the same verdict; a line goes at each place where it stands, with its
line break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, word_array, written

#: Documents of a host beyond which a line is boilerplate.
MAX_DOCUMENTS = 20
#: Share of the characters that must remain.
MIN_SHARE = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Lines above the limit beyond which they are joined by a shuffle.
MOST_BROADCAST = 100_000
SPACE = r"[\x20\x09-\x0D]+"


def line_structs(text: F.Column) -> F.Column:
    """(h, chars) of each normalised line that has a word."""
    norm = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " ")))
    return F.transform(F.filter(norm, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).cast("long").alias("chars")))


def _host(host_col: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit(""))


def _text_hash(text: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _distinct_lines(text: F.Column) -> F.Column:
    """Each line's hash once, with the characters of all places where it stands."""

    def runs(got):
        n = F.size(got)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(got, i)["h"] != F.get(got, i - 1)["h"]))
        # An array of one, so that what is in it is computed once.
        return F.flatten(
            F.transform(F.array(first), lambda f: F.transform(f, lambda s, k: F.struct(F.get(got, s)["h"].alias("h"), (F.get(got, s)["chars"] * (F.coalesce(F.get(f, k + 1), n) - s)).alias("chars"))))
        )

    return F.flatten(F.transform(F.filter(F.array(F.sort_array(line_structs(text))), lambda g: F.size(g) > 0), runs))


def lined(df: DataFrame, host_col: str, id_col: str, text_col: str, *more: F.Column) -> DataFrame:
    """(host, text_hash, id, lines, line_chars) of each row, and what more is asked for, written once: texts are read and cut into lines in this pass alone."""
    text = F.col(text_col)
    rows = df.select(_host(host_col).alias("host"), _text_hash(text).alias("text_hash"), F.col(id_col).alias("id"), _distinct_lines(text).alias("lines"), *more)
    return written(rows.withColumn("line_chars", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])))


def frequent(rows: DataFrame, max_documents: int, copies_once: bool, spare_first: bool) -> DataFrame:
    """(host, h[, first_hash]) of the lines above the limit. rows: as from lined()."""
    lines = rows.select("host", "text_hash", "id", F.explode("lines.h").alias("h"))
    by = "text_hash" if copies_once else "id"
    if not spare_first:
        often = lines.select("host", "h", by).distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    else:
        once = lines.groupBy("host", "h", by).agg(F.min(F.struct("id", "text_hash")).alias("m"))
        often = once.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.min("m")["text_hash"].alias("first_hash"))
    return often.where(F.col("n") > max_documents).drop("n")


def depletion(rows: DataFrame, max_documents: int = MAX_DOCUMENTS, copies_once: bool = False, spare_first: bool = False) -> DataFrame:
    """(host, text_hash, removed, line_chars, gone): characters of boilerplate lines, and of all, and the hashes of those lines, for each text of a host that has any. rows: as from lined()."""
    often = written(frequent(rows, max_documents, copies_once, spare_first))
    often = F.broadcast(often) if often.count() <= MOST_BROADCAST else often
    lines = rows.select("host", "text_hash", "line_chars", F.explode("lines").alias("line")).select("host", "text_hash", "line_chars", "line.h", "line.chars")
    hit = lines.join(often, ["host", "h"])
    hit = hit.where("text_hash <> first_hash") if spare_first else hit
    # Copies of a text bring the same lines.
    once = hit.groupBy("host", "text_hash", "h").agg(F.max("chars").alias("chars"), F.max("line_chars").alias("line_chars"))
    return once.groupBy("host", "text_hash").agg(F.sum("chars").alias("removed"), F.max("line_chars").alias("line_chars"), F.collect_set("h").alias("gone"))


def normal_line(line: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def without_lines(text: F.Column, gone: F.Column) -> F.Column:
    """The text without the lines whose hashes are in gone; null takes none. Other lines, and what has no word, stay as they are."""
    stays = F.filter(F.split(text, "\n"), lambda x: (normal_line(x) == "") | ~F.array_contains(gone, F.xxhash64(normal_line(x))))
    return F.when(gone.isNull(), text).otherwise(F.array_join(stays, "\n"))


def base_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; the text goes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    get, same = F.get, lambda a, b: F.coalesce(a == b, F.lit(False))
    df = df.withColumn("_text", text).drop(text_col)
    df = df.withColumn("_words", word_array(F.col("_text"))).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        *[c for c in df.columns if not c.startswith("_")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    h = F.col("_h")
    df = df.withColumn("_win", F.when(F.size(h) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[get(h, i + k) for k in range(WINDOW)]))))
    df = df.withColumn("_sorted", F.sort_array("_win"))
    s = F.col("_sorted")
    df = df.withColumn("_any", F.coalesce(F.size(F.array_distinct("_win")) < F.size("_win"), F.lit(False)))
    df = df.withColumn("_at", F.when(F.col("_any"), F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    at = F.col("_at")
    twice = F.filter(at, lambda x, i: same(x["h"], get(at, i - 1)["h"]) | same(x["h"], get(at, i + 1)["h"]))
    df = df.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(acc["end"], p.cast("long"))).alias("n"), (p + WINDOW).cast("long").alias("end")),
        lambda acc: acc["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def line_quality(df: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", max_documents: int = MAX_DOCUMENTS, min_share: float = MIN_SHARE, copies_once: bool = False, spare_first: bool = False) -> DataFrame:
    """(id, the base columns, line_chars, removed_chars, kept) for each row."""
    slim = df.select(F.col(id_col).alias("id"), F.col(host_col).alias("source"), F.col(text_col).alias("text"))
    based = base_columns(slim.withColumn("whole", F.col("text")), "text")
    rows = lined(based, "source", "id", "whole", *map(F.col, BASE))
    gone = depletion(rows, max_documents, copies_once, spare_first)
    out = rows.join(gone.select("host", "text_hash", "removed"), ["host", "text_hash"], "left")
    removed = F.coalesce("removed", F.lit(0).cast("long"))
    depleted = F.col("line_chars") - removed < F.lit(min_share) * F.col("line_chars")
    return out.select(F.col("id").alias(id_col), *BASE, "line_chars", removed.alias("removed_chars"), (~F.col("base_failed") & ~depleted).alias("kept"))


def kept_rows(
    df: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", max_documents: int = MAX_DOCUMENTS, min_share: float = MIN_SHARE, chars_col: str = "n_chars", copies_once: bool = False, spare_first: bool = False
) -> DataFrame:
    """The rows of df that line_quality keeps, with its columns; their texts are without the lines it removes, and the number of characters goes with them."""
    gone = depletion(lined(df, host_col, id_col, text_col), max_documents, copies_once, spare_first)
    gone = gone.withColumn("depleted", F.col("line_chars") - F.col("removed") < F.lit(min_share) * F.col("line_chars"))
    # Depleted texts go whole, so that their lines need not be known.
    gone = written(gone.select("host", "text_hash", "depleted", F.when(~F.col("depleted"), F.col("gone")).alias("gone")))
    # The lines to remove grow with the rows, so texts are shuffled to them once at every size, by one plan.
    gone = gone.hint("merge")
    text = F.col(text_col)
    rows = df.select(F.struct("*").alias("row"), _host(host_col).alias("host"), _text_hash(text).alias("text_hash"), text.alias("text"))
    # Behind a generator, so that the optimiser does not push the filter, and with it a copy of all that it rests on, below each step.
    judged = base_columns(rows, "text").select("row", "host", "text_hash", F.explode(F.array("base_failed")).alias("failed"))
    kept = judged.where(~F.col("failed")).join(gone, ["host", "text_hash"], "left").where(~F.coalesce("depleted", F.lit(False)))
    left = without_lines(F.col("row")[text_col], F.col("gone"))
    columns = {c: F.col("row")[c] for c in df.columns}
    columns[text_col] = left
    if chars_col in columns:
        columns[chars_col] = F.when(F.col("gone").isNull(), columns[chars_col]).otherwise(F.length(left).cast(df.schema[chars_col].dataType))
    return kept.select(*[c.alias(name) for name, c in columns.items()])


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"))


OP2_SQL = rf"""
with d as (select doc_id, coalesce('=' || source, '') as host, coalesce(text, '') as t from documents),
lines as (select doc_id, host, t, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) as line
          from (select doc_id, host, t, unnest(string_split(t, chr(10))) as x from d)),
own as (select doc_id, sum(length(line)) as line_chars from lines where line <> '' group by 1),
often as (select host, line from (select distinct host, line, doc_id from lines where line <> '') group by 1, 2 having count(*) > {MAX_DOCUMENTS}),
gone as (select l.doc_id, sum(length(l.line)) as removed from lines l join often o on l.host = o.host and l.line = o.line group by 1),
words as (select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
win as (select doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from words)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1),
covered as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + {WINDOW})) as p from twice) group by 1),
raw as (select doc_id, count(*) - count(distinct x) as n from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by 1),
base as (
  select d.doc_id, len(w.w)::bigint as n_words, length(array_to_string(w.w, ''))::bigint as word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, coalesce(raw.n, 0)::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
    coalesce(own.line_chars, 0)::bigint as line_chars, coalesce(g.removed, 0)::bigint as removed_chars
  from d join words w using (doc_id) left join raw using (doc_id) left join covered c using (doc_id) left join own using (doc_id) left join gone g using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed, line_chars, removed_chars,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and line_chars - removed_chars >= {MIN_SHARE} * line_chars as kept
from base
"""
