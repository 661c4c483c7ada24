import math
import re
from collections import Counter

import pytest
from millrace.llm.licenses import COMMENTS, CUE, FILE_COSINE, FULL_TEXTS, IDENTIFIERS, MIN_COSINE, OP8_SQL, SPDX, TEMPLATES, TERM, license_scan, op8_license_cosine, stated
from pyspark.sql import functions as F

from ..compare import connection, same
from .helpers import clashing, docs, hard_rows, prose, python_free


def terms(text):
    return Counter(re.findall(TERM, text.lower()))


def cosines(unit, templates):
    """(cosine, template) of one unit and each template whose naming terms it has."""
    known = [terms(t[1]) for t in templates]
    df = Counter(x for t in known for x in t)
    idf = lambda x: math.log((1 + len(known)) / (1 + df[x])) + 1
    norm = lambda t: math.sqrt(sum((k * idf(x)) ** 2 for x, k in t.items()))
    own = terms(unit)
    for template, t in zip(templates, known, strict=True):
        needs, bars = template[2].split(), set(template[3].split("|")) - {""}
        if own and all(set(g.split("|")) & own.keys() for g in needs) and not bars & own.keys():
            yield round(sum(k * own[x] * idf(x) ** 2 for x, k in t.items()) / (norm(own) * norm(t)), 6), template[0]


def brute(text):
    """(licence, cosine) of a text, else None."""
    low = (text or "").lower()
    if not re.search(CUE, low):
        return None
    best = lambda units, templates, least: min(((-c, n) for u in units if re.search(CUE, u) for c, n in cosines(u, templates) if c >= least), default=None)
    free = lambda units: [u for u in units if not re.search(SPDX, u)]
    lines = low.split("\n")
    known = dict(IDENTIFIERS)
    named = [known[x] for x in (re.sub("(-only|-or-later|\\+)$", "", y) for y in re.findall(SPDX, low)) if x in known]
    found = best([low], FULL_TEXTS, FILE_COSINE) or best(free(m[0] for m in re.finditer(COMMENTS, low)), FULL_TEXTS, FILE_COSINE) or (named and (-1.0, named[0]))
    found = found or best(free(lines), TEMPLATES, MIN_COSINE) or best(free(" ".join(lines[i : i + k]) for k in (2, 3, 4) for i in range(len(lines) - k + 1)), TEMPLATES, MIN_COSINE)
    return (found[1], -found[0]) if found else None


@pytest.mark.parametrize("name,text", [t[:2] for t in TEMPLATES])
def test_templates_find_themselves(name, text):
    assert brute(text)[0] == name and brute(text)[1] == pytest.approx(1, abs=1e-6)


#: What other licences say of themselves, and kin of those that have a template.
OTHERS = [
    ("SPDX-License-Identifier: ISC", None),
    ("SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("SPDX-License-Identifier: EPL-2.0", None),
    ("SPDX-License-Identifier: LicenseRef-Proprietary", None),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT"),
    ("This program is licensed under the Eclipse Public License, version 2.0.", None),
    ("Licensed under the Foo License, Version 2.0.", None),
    ("Licensed under CC BY-ND 4.0.", None),
    ("This work is licensed under the Creative Commons Attribution NoDerivatives 4.0 International License.", None),
    ("This work is licensed under the GNU General Public License, version 1.", None),
    ("This work is licensed under the GNU Library General Public License, version 2.", None),
    ("Released under the Zlib License.", None),
    ("This library is licensed under the GNU Lesser General Public License, version 2.1.", None),
]


def test_other_licences_are_not_taken_for_known_ones(spark):
    df = docs(spark, [(i, t, "en", "s", 0) for i, (t, _) in enumerate(OTHERS)])
    found = {r["text_hash"]: r["license"] for r in stated(df).collect()}
    got = {r["text"]: found.get(r["h"]) for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    assert got == dict(OTHERS) == {t: (brute(t) or [None])[0] for t, _ in OTHERS}


def rows():
    texts = [t[1] for t in TEMPLATES] + [f"{prose(1, 20)}\n// {TEMPLATES[1][1]}\n{prose(2, 20)}", "SPDX-License-Identifier: MIT and more words that are not of it at all here", "All copyright is theirs.", prose(3, 40), None, "", "Licensed under CC BY-SA 4.0.\nReleased under the MIT License.", "license " * 3000, "# Use of this source\n# code is governed by a BSD-style license\n# that can be found in the LICENSE file.\nint x;", FULL_TEXTS[-2][1], "\n".join(f"# {x}" for x in FULL_TEXTS[1][1].split("\n")), *(t for t, _ in OTHERS)]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)]


def test_cosines_by_brute_force(spark):
    df = docs(spark, rows()).withColumn("text_hash0", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = {r["text_hash"]: (r["license"], r["cosine"]) for r in stated(df).collect()}
    for r in df.collect():
        want = brute(r["text"])
        got = found.get(r["text_hash0"])
        assert (got is None) == (want is None), r["text"]
        assert got is None or got[0] == want[0] and got[1] == pytest.approx(want[1], abs=2e-6)


def test_nearest_ancestor(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    data = [(1, "a/LICENSE", mit), (2, "a/x.txt", "plain"), (3, "a/b/y.txt", "plain"), (4, "a/b/c/LICENSE", gpl), (5, "a/b/c/d/z.txt", "plain"), (6, "ab/z.txt", "plain"), (7, "a/b/own.txt", gpl), (8, "top.txt", "plain"), (9, None, "plain"), (10, None, mit), (3, "a/b/y.txt", "plain")]
    df = spark.createDataFrame([(i, p, t) for i, p, t in data], "doc_id long, path string, text string")
    got = license_scan(clashing(df, "dir license cosine given above depth n g from_dir origin is_file"), F.col("path"), F.col("path").endswith("LICENSE"))
    seen = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in got.collect()}
    assert got.count() == len(data)
    assert seen == {
        1: ("MIT", "own", None),
        2: ("MIT", "directory", "a"),
        3: ("MIT", "directory", "a"),
        4: ("GPL-3.0", "own", None),
        5: ("GPL-3.0", "directory", "a/b/c"),
        6: (None, None, None),
        7: ("GPL-3.0", "own", None),
        8: (None, None, None),
        9: (None, None, None),
        10: ("MIT", "own", None),
    }


def test_full_texts_wrapped_headers_and_names(spark):
    full = {t[0]: t[1] for t in FULL_TEXTS}
    held = lambda t: t.replace("<year> <copyright holders>", "2021 Ada Example and others")
    wrapped = "// Use of this source code is\n// governed by a BSD-style license\n// that can be found in the\n// LICENSE file.\nint main() {}"
    data = [(i, f"{n}/any.txt", t) for i, (n, t) in enumerate(t[:2] for t in FULL_TEXTS)] + [(100 + i, f"{n}/b/x.txt", "plain") for i, (n, _) in enumerate(t[:2] for t in FULL_TEXTS)]
    data += [(200, "one/a.txt", " ".join(held(full["MIT"]).split())), (201, "one/b/x.txt", "plain")]
    data += [(202, "two/x.c", wrapped), (203, "three/x.c", "".join(f"# {x}\n" for x in held(full["MIT"]).split("\n")) + prose(5, 400)), (204, "three/y.c", "plain")]
    data += [(205, "four/COPYING", f"Released under the MIT License.\n{prose(6, 300)}"), (206, "four/x", "plain"), (207, "five/x.txt", f"The license of the work and its copyright. {prose(7, 900)}")]
    got = license_scan(spark.createDataFrame(data, "doc_id long, path string, text string"), F.col("path"), F.lit(False)).collect()
    seen = {r["doc_id"]: (r["license"], r["origin"]) for r in got}
    for i, (n, *_) in enumerate(FULL_TEXTS):
        assert seen[i] == (n, "own") and seen[100 + i] == (n, "directory")
    assert [seen[i] for i in range(200, 208)] == [("MIT", "own"), ("MIT", "directory"), ("BSD-3-Clause", "own"), ("MIT", "own"), (None, None), ("MIT", "own"), ("MIT", "directory"), (None, None)]


def test_ties(spark):
    data = [(2, "a/L2", "Released under the MIT License."), (1, "a/L1", "SPDX-License-Identifier: BSD-3-Clause"), (3, "a/x", "plain")]
    got = license_scan(spark.createDataFrame(data, "doc_id long, path string, text string"), F.col("path"), F.lit(True)).collect()
    assert {r["doc_id"]: r["license"] for r in got}[3] == "BSD-3-Clause"


def test_hard_rows(spark):
    df = clashing(docs(spark))
    assert license_scan(df, F.col("source"), F.lit(True)).count() == len(hard_rows())
    assert license_scan(docs(spark, []), F.col("source"), F.lit(True)).collect() == []


def test_sql_on_a_fixture(spark, tmp_path):
    docs(spark, [(i * 40 % 300, *r[1:3], None if i % 5 == 0 else "s", 0) for i, r in enumerate(rows()) if i not in (7, 15)]).dropDuplicates(["doc_id"]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    same(op8_license_cosine(spark, str(tmp_path)), connection(str(tmp_path)), OP8_SQL)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    df = op8_license_cosine(spark, sf)
    same(df, connection(sf), OP8_SQL)
    assert python_free(df)
