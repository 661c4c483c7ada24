"""License scans (operator 8), in DataFrame functions alone.

Units that speak of a licence are compared with templates by the cosine of their sparse TF-IDF vectors: terms of units
and templates meet in a join, and products are summed. Weights come from the template collection; a term that no
template has weighs as much as one in no template does by the same formula, more than any other. A template counts only
if the unit has the terms that name its licence and none that name a kin of it. A text gets, in this order: the licence
whose full text it is, or a comment block of it is, at `FILE_COSINE` or more; the licence that its SPDX identifier
names, exactly; the template of its best line at `MIN_COSINE` or more; that of its best run of two to four lines around
such a line, so that headers may be wrapped. Lines with an SPDX identifier are judged by it alone. A licence file, by
its name, as the full text of a licence or as a short text that states one, gives its licence to its directory, and what
has none of its own takes that of the nearest ancestor directory, found by joins on paths: directories are resolved
first, each once.

Defined results: null texts have no licence, null paths no directory; equal texts get equal licences; an identifier
without a template names nothing, and of an expression of several the first counts; of several best templates the first
in order of names wins, of several licence files in a directory the one of the greatest cosine, then of the smallest
id; repeated rows each keep a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, word_array, written

MIN_COSINE = 0.6
#: A document of at most so many words that states a licence is a licence file; so are those by name and by full text.
FILE_WORDS = 60
#: For whole texts and comment blocks against full licences: common words alone bring any two long texts near each other.
FILE_COSINE = 0.9
#: Lines that a wrapped statement may take.
HEADER_LINES = 4
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]es?|copying|copyright)([._-][^/]*)?$"
COMMENTS = r"(?:(?:^|\n)[ \t]*(?:#|//|/\*|\*|--|;|%|<!--)[^\n]*)+"
CUE = r"licen[cs]e|copyright|spdx|hereby granted|redistribution and use|public domain"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"

SPDX = r"spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+)"
_VARIANT = r"(-only|-or-later|\+)$"
_NC, _SA, _ND = "noncommercial|commercial|nc", "sharealike|alike|sa", "noderivatives|noderivs|derivatives|nd"
#: What each licence is called: groups of terms of which a unit must have one each ("a|b" either), and terms that it must not have.
NAMES = {
    "AGPL-3.0": ("affero 3|3.0", ""),
    "Apache-2.0": ("apache 2|2.0", ""),
    "BSD": ("bsd", ""),
    "CC-BY-4.0": ("attribution|by 4|4.0", f"{_NC}|{_SA}|{_ND}"),
    "CC-BY-NC-4.0": (f"{_NC} 4|4.0", f"{_SA}|{_ND}"),
    "CC-BY-SA-4.0": (f"{_SA} 4|4.0", f"{_NC}|{_ND}"),
    "CC0-1.0": ("cc0", ""),
    "GPL-2.0": ("gnu|gpl general public 2|2.0", "lesser|library|affero"),
    "GPL-3.0": ("general public 3|3.0", "lesser|affero"),
    "LGPL-3.0": ("lesser 3|3.0", ""),
    "MIT": ("mit", ""),
    "MPL-2.0": ("mozilla 2|2.0", ""),
}

#: (licence, text, terms it must have, terms it must not have)
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3.", *NAMES["AGPL-3.0"]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", *NAMES["Apache-2.0"]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", *NAMES["Apache-2.0"]),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "", ""),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", *NAMES["BSD"]),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License.", *NAMES["CC-BY-4.0"]),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", *NAMES["CC-BY-4.0"]),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", *NAMES["CC-BY-NC-4.0"]),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License.", *NAMES["CC-BY-NC-4.0"]),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", *NAMES["CC-BY-SA-4.0"]),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0.", *NAMES["CC0-1.0"]),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", *NAMES["GPL-2.0"]),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", *NAMES["GPL-3.0"]),
    ("GPL-3.0", "You can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.", *NAMES["GPL-3.0"]),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.", *NAMES["LGPL-3.0"]),
    ("MIT", "Released under the MIT License.", *NAMES["MIT"]),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "", ""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", *NAMES["MPL-2.0"]),
)

#: Full texts, by the licence that names their file.
FULL_TEXTS = tuple((p.stem, p.read_text(encoding="utf-8"), "", "") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


#: Licences by their SPDX identifiers in lower case.
IDENTIFIERS = tuple(sorted({n.lower(): n for n in [*(t[0] for t in TEMPLATES), *(t[0] for t in FULL_TEXTS)]}.items()))


def template_weights(templates=TEMPLATES) -> tuple[list[tuple[int, str, str, float, float]], float]:
    """(template, licence, term, idf, weight of the unit vector), a bounded table with as many rows as the templates have terms; and the idf of any other term."""
    terms = [Counter(re.findall(TERM, t[1].lower())) for t in templates]
    df = Counter(x for t in terms for x in t)
    idf = {x: round(math.log((1 + len(terms)) / (1 + n)) + 1, 9) for x, n in df.items()}
    out = []
    for i, (template, t) in enumerate(zip(templates, terms, strict=True)):
        norm = math.sqrt(sum((k * idf[x]) ** 2 for x, k in t.items()))
        out += [(i, template[0], x, idf[x], round(k * idf[x] / norm, 9)) for x, k in sorted(t.items())]
    return out, round(math.log(1 + len(terms)) + 1, 9)


def _values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    shown = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"select * from values {shown} as t({names})"))


def _best(units: DataFrame, templates, min_cosine: float) -> DataFrame:
    """(text_hash, license, cosine) by the best unit of each text. units: (text_hash, unit), any rows repeated count once, and what stands in many texts is compared once."""
    spark = units.sparkSession
    units = units.select("text_hash", F.xxhash64("unit").alias("line_hash"), F.regexp_extract_all("unit", F.lit(TERM), 0).alias("terms"))
    lines = units.groupBy("line_hash").agg(F.first("terms").alias("terms"))
    rows, other = template_weights(templates)
    own = _values(spark, sorted({(t, idf) for _, _, t, idf, _ in rows}), "term, idf")
    weights = _values(spark, [(i, name, t, w) for i, name, t, _, w in rows], "template, license, term, weight")
    terms = lines.select("line_hash", F.explode("terms").alias("term")).groupBy("line_hash", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = terms.join(own, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = weighed.groupBy("line_hash").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.where("idf is not null").join(weights, "term").groupBy("line_hash", "template", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "line_hash").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= min_cosine)
    if any(t[2] or t[3] for t in templates):
        names = _values(spark, [(i, t[2], t[3]) for i, t in enumerate(templates)], "template, needs, bars")
        has = lambda group: F.arrays_overlap(F.split(group, r"\|"), F.col("terms"))
        named = scored.join(names, "template").join(lines, "line_hash")
        scored = named.where(((F.col("needs") == "") | F.forall(F.split("needs", " "), has)) & ((F.col("bars") == "") | ~has(F.col("bars"))))
    best = scored.groupBy("line_hash").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("m"))
    best = units.select("text_hash", "line_hash").join(best, "line_hash").groupBy("text_hash").agg(F.min("m").alias("m"))
    return best.select("text_hash", F.col("m.license").alias("license"), (-F.col("m.c")).alias("cosine"))


def _identified(texts: DataFrame) -> DataFrame:
    """(text_hash, license, cosine) by the first SPDX identifier of each text that is known."""
    found = F.transform(F.regexp_extract_all("low", F.lit(SPDX), 1), lambda x: F.regexp_replace(x, _VARIANT, ""))
    known = F.create_map(*[F.lit(x) for pair in IDENTIFIERS for x in pair])
    first = F.get(F.filter(F.transform(found, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull()), F.lit(0))
    return texts.where(F.contains("low", F.lit("spdx-license-identifier:"))).select("text_hash", first.alias("license"), F.lit(1.0).alias("cosine")).where("license is not null").distinct()


def _runs(parts):
    """Runs of two to HEADER_LINES lines around each line that speaks of a licence."""
    n = F.size(parts)
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(parts, i).rlike(CUE))
    begins = lambda i, k: F.when(n >= k, F.sequence(F.greatest(i - k + 1, F.lit(0)), F.least(i, n - k))).otherwise(F.array().cast("array<int>"))
    lengths = F.sequence(F.lit(2), F.lit(HEADER_LINES))
    return F.flatten(F.transform(at, lambda i: F.flatten(F.transform(lengths, lambda k: F.transform(begins(i, k), lambda s: F.array_join(F.slice(parts, s + 1, k), " "))))))


def stated(df: DataFrame, text_col: str = "text", templates=TEMPLATES, min_cosine: float = MIN_COSINE, full=FULL_TEXTS, file_cosine: float = FILE_COSINE) -> DataFrame:
    """(text_hash, license, cosine, whole) of the texts that state one; whole: the text is that licence."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    # Few texts have a cue: they are written once, and what follows reads them alone.
    texts = written(df.select(low.alias("low"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")).where(F.col("low").rlike(CUE)))
    cued = lambda units: F.explode(F.filter(units, lambda x: x.rlike(CUE) & ~x.rlike(SPDX))).alias("unit")
    parts = F.split("low", "\n")
    found = [
        _best(texts.select("text_hash", F.col("low").alias("unit")), full, file_cosine),
        _best(texts.select("text_hash", cued(F.regexp_extract_all("low", F.lit(COMMENTS), 0))), full, file_cosine),
        _identified(texts),
        _best(texts.select("text_hash", cued(parts)), templates, min_cosine),
        # In an array of one, so that the text is split once and not for each line.
        _best(texts.select("text_hash", cued(F.flatten(F.transform(F.array(parts), _runs)))), templates, min_cosine),
    ]
    all_found = None
    for rank, x in enumerate(found):
        x = x.withColumn("rank", F.lit(rank))
        all_found = x if all_found is None else all_found.unionByName(x)
    first = all_found.groupBy("text_hash").agg(F.min(F.struct("rank", "license", "cosine")).alias("m"))
    return first.select("text_hash", "m.license", "m.cosine", (F.col("m.rank") == 0).alias("whole"))


def _dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", ""))


def license_scan(df: DataFrame, path: Column, is_file: Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id, path, license, origin 'own', 'directory' or null, cosine, from_dir) for each row. is_file: whether a row that states a licence does so for its directory; one that is a licence's full text, or has the name of a licence file, does in any case."""
    found = stated(df, text_col, templates, min_cosine)
    rows = df.select(F.col(id_col).alias("id"), path.alias("path"), is_file.alias("is_file"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    rows = rows.withColumn("dir", _dir(F.col("path"))).join(found, "text_hash", "left")
    rows = rows.withColumn("is_file", F.coalesce("is_file", F.lit(False)) | F.coalesce("whole", F.lit(False)) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)))
    given = rows.where("is_file and license is not null and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "id", "license")).alias("g")).select(F.col("dir").alias("above"), F.col("g.license").alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = rows.where("dir is not null and license is null").select("dir").distinct()
    nearest = dirs.select("dir", F.posexplode(above).alias("depth", "above")).join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("n"))
    out = rows.join(nearest.select("dir", F.col("n.above").alias("from_dir"), F.col("n.given").alias("given")), "dir", "left")
    own = F.col("license").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("license", "given").alias("license"),
        F.when(own, "own").when(F.col("given").isNotNull(), "directory").alias("origin"),
        "cosine",
        F.when(~own, F.col("from_dir")).alias("from_dir"),
    )


def op8_license_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths; a document stands at source/ten thousands/hundreds/id of its number."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.expr("cast(doc_id div 10000 as string)"), F.expr("cast(doc_id div 100 as string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(docs, path, F.size(word_array(F.col("text"))) <= FILE_WORDS)


def _op8_sql() -> str:
    short, other = template_weights()
    full, other_full = template_weights(FULL_TEXTS)
    rows = [(1, *r) for r in short] + [(0, *r) for r in full]
    weights = ", ".join(f"({c}, {i}, '{name}', '{t}', {idf!r}::double, {w!r}::double)" for c, i, name, t, idf, w in rows)
    named = ", ".join(f"({c}, {i}, '{t[2]}', '{t[3]}')" for c, of in ((1, TEMPLATES), (0, FULL_TEXTS)) for i, t in enumerate(of))
    known = ", ".join(f"('{a}', '{b}')" for a, b in IDENTIFIERS)
    return rf"""
with w(c, template, license, term, idf, weight) as (values {weights}),
names(c, template, needs, bars) as (values {named}),
known(id, license) as (values {known}),
own as (select distinct c, term, idf from w),
d as (select doc_id, coalesce(source, '') || '/' || (doc_id // 10000)::varchar || '/' || (doc_id // 100)::varchar as dir, coalesce(text, '') as t from documents),
cued as (select doc_id, lower(t) as low, string_split(lower(t), chr(10)) as parts from d where regexp_matches(lower(t), '{CUE}')),
places as (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from cued),
runs as (select doc_id, parts, k, unnest(range(greatest(i - k + 1, 1), least(i, len(parts) - k + 1) + 1)) as s from places, (select unnest(range(2, {HEADER_LINES + 1})) as k) where regexp_matches(parts[i], '{CUE}')),
pieces as (
  select doc_id, 1 as rank, unnest(regexp_extract_all(low, '{COMMENTS}')) as unit from cued
  union all select doc_id, 3, unnest(parts) from cued
  union all select doc_id, 4, array_to_string(parts[s : s + k - 1], ' ') from runs),
units as (
  select doc_id, 0 as rank, low as unit from cued
  union all select distinct doc_id, rank, unit from pieces where regexp_matches(unit, '{CUE}') and not regexp_matches(unit, '{SPDX}')),
listed as (select doc_id, rank, case when rank < 2 then 0 else 1 end as c, unit, regexp_extract_all(unit, '{TERM}') as terms from units),
terms as (select doc_id, rank, c, unit, term, count(*) as tf from (select doc_id, rank, c, unit, unnest(terms) as term from listed) group by all),
weighed as (select doc_id, rank, terms.c, unit, terms.term, idf, tf * coalesce(idf, case when terms.c = 1 then {other!r} else {other_full!r} end) as x from terms left join own on own.c = terms.c and own.term = terms.term),
norms as (select doc_id, rank, unit, sqrt(sum(x * x)) as norm from weighed group by all),
dots as (select doc_id, rank, weighed.c, unit, template, license, sum(x * weight) as dot from weighed join w on w.c = weighed.c and w.term = weighed.term group by all),
scored as (
  select doc_id, rank, license, round(dot / norm, 6) as cosine from dots join norms using (doc_id, rank, unit) join names using (c, template) join listed using (doc_id, rank, c, unit)
  where round(dot / norm, 6) >= case when c = 1 then {MIN_COSINE} else {FILE_COSINE} end
    and (needs = '' or len([g for g in string_split(needs, ' ') if not list_has_any(string_split(g, '|'), terms)]) = 0) and (bars = '' or not list_has_any(string_split(bars, '|'), terms))),
spdx as (
  select doc_id, 2 as rank, license, 1.0 as cosine
  from (select doc_id, unnest(found) as id, generate_subscripts(found, 1) as k from (select doc_id, [regexp_replace(x, '{_VARIANT}', '') for x in regexp_extract_all(low, '{SPDX}', 1)] as found from cued)) join known using (id)
  qualify row_number() over (partition by doc_id order by k) = 1),
best as (select doc_id, rank, license, cosine from (from scored union all from spdx) qualify row_number() over (partition by doc_id order by rank, cosine desc, license) = 1),
rows as (select d.doc_id, d.dir, b.license, b.cosine, b.rank = 0 or len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) <= {FILE_WORDS} as is_file from d left join best b using (doc_id)),
given as (select dir as above, license as given from rows where is_file and license is not null qualify row_number() over (partition by dir order by cosine desc, doc_id) = 1),
nearest as (select r.doc_id, g.above, g.given from rows r join given g on r.dir = g.above or starts_with(r.dir, g.above || '/') where r.license is null qualify row_number() over (partition by r.doc_id order by length(g.above) desc) = 1)
select r.doc_id, r.dir || '/' || r.doc_id::varchar || '.txt' as path, coalesce(r.license, n.given) as license,
  case when r.license is not null then 'own' when n.given is not null then 'directory' end as origin, r.cosine, n.above as from_dir
from rows r left join nearest n using (doc_id)
"""


OP8_SQL = _op8_sql()
