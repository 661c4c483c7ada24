import re

import pytest
from millrace.llm.lines import OP2_SQL, kept_rows, line_quality, op2_line_frequency

from ..compare import bag, connection, same
from .helpers import clashing, docs, hard_rows, prose, python_free

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    places = {p for i, w in enumerate(windows) if count[w] > 1 for p in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places), n < 10 or 100 * len(places) > 20 * n


def verdicts(rows, limit, copies_once=False, spare_first=False):
    """kept by brute force."""
    norm = lambda t: [x for x in (re.sub(r"[\x20\x09-\x0D]+", " ", y).strip(" ") for y in (t or "").lower().split("\n")) if x]
    bearers = {}
    for i, t, _, host, _ in rows:
        for x in set(norm(t)):
            bearers.setdefault((host, x), []).append((i, t or ""))
    out = []
    for _, t, _, host, _ in rows:
        lines = norm(t)
        gone = 0
        for x in lines:
            have = bearers[host, x]
            if len({b[copies_once] for b in have}) > limit and not (spare_first and min(have)[1] == (t or "")):
                gone += len(x)
        total = sum(map(len, lines))
        out.append(not base(t)[-1] and total - gone >= 0.5 * total)
    return out


def boilerplate(n=40):
    shared = "read more of this on our pages and subscribe to the letter"
    rows = [(i, f"{shared}\n{prose(i, 6)}", "en", "hot", 0) for i in range(n)]
    rows += [(1000 + i, f"{shared}\n{prose(i, 60)}", "en", "hot", 0) for i in range(5)]
    rows += [(2000 + i, f"{shared}\n{prose(500 + i, 6)}", "en", "other", 0) for i in range(5)]
    return rows


def test_hard_rows(spark):
    df = clashing(docs(spark), "id host text_hash h chars line first sorted n_words text2 failed row removed")
    got = line_quality(df).collect()
    assert bag(got, ["doc_id", *BASE]) == bag([dict(zip(["doc_id", *BASE], (r[0], *base(r[1])), strict=True)) for r in hard_rows()], ["doc_id", *BASE])
    assert line_quality(docs(spark, [])).collect() == []
    kept = kept_rows(df)
    assert kept.columns == df.columns
    # One row for each row that is kept, repeats included; copies share their verdict.
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(r["doc_id"] for r in got if r["kept"] and r["doc_id"] is not None)


@pytest.mark.parametrize("copies_once,spare_first", [(False, False), (True, True)])
def test_depletion_by_brute_force(spark, copies_once, spare_first):
    rows = boilerplate() + [(3000 + i, f"{prose(900, 40)}\nEine Zeile über İSTANBUL und Größe", "de", "hot", 0) for i in range(25)]
    options = {"copies_once": copies_once, "spare_first": spare_first}
    got = {r["doc_id"]: r["kept"] for r in line_quality(docs(spark, rows), max_documents=20, **options).collect()}
    assert got == {r[0]: k for r, k in zip(rows, verdicts(rows, 20, **options), strict=True)}
    assert got[0] == spare_first and not got[1] and got[1000] and got[2000] and got[3000] == (copies_once or spare_first)
    assert {r["doc_id"] for r in kept_rows(docs(spark, rows), max_documents=20, **options).collect()} == {k for k, v in got.items() if v}


def test_repeated_ids_are_one_document(spark):
    rows = [(1 + i % 3, f"a line that stands in all of the rows here\n{prose(i, 4)}", "en", "h", 0) for i in range(60)]
    assert all(r["removed_chars"] == 0 for r in line_quality(docs(spark, rows)).collect())
    assert all(r["removed_chars"] > 0 for r in line_quality(docs(spark, rows), max_documents=2).collect())


@pytest.mark.parametrize("most", [0, 100_000])
def test_kept_texts_lose_the_lines_above_the_limit(spark, monkeypatch, most):
    monkeypatch.setattr("millrace.llm.lines.MOST_BROADCAST", most)
    line = "Read more of   this on OUR pages"
    rows = [(i, f"{line}\n{prose(i, 60)}\n\n  {line.lower()} \nİ end {i}", "en", "hot", 7) for i in range(30)]
    rows += [(100 + i, f"{line}\n{prose(200 + i, 60)}", "en", "other", 7) for i in range(5)]
    got = kept_rows(docs(spark, rows + rows[3:4]))
    seen = sorted(tuple(r) for r in got.collect())
    cleaned = lambda r: "\n".join(x for x in r[1].split("\n") if "our pages" not in x.lower())
    want = [r if r[3] == "other" else (r[0], cleaned(r), *r[2:4], len(cleaned(r))) for r in rows + rows[3:4]]
    assert seen == sorted(want)


def test_copies_count_once(spark):
    rows = [(i, f"a line that every copy of it has too\n{prose(3, 4)}", "en", "h", 0) for i in range(60)]
    assert all(r["removed_chars"] == 0 for r in line_quality(docs(spark, rows), copies_once=True).collect())
    assert not any(r["kept"] for r in line_quality(docs(spark, rows)).collect())


@pytest.mark.parametrize("rows", [[(9000 + k, *r[1:]) for k, r in enumerate(hard_rows()) if r[1] is None or "İ" not in r[1]] + boilerplate() + [(4000 + i, f"{prose(901, 40)}\nDie Größe der Straße ÜBER é und  日本", "de", "hot", 0) for i in range(25)], []])
def test_sql_on_a_fixture(spark, tmp_path, rows):
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    same(op2_line_frequency(spark, str(tmp_path)), connection(str(tmp_path)), OP2_SQL)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    df = op2_line_frequency(spark, sf)
    same(df, connection(sf), OP2_SQL)
    assert python_free(df)
