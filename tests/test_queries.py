"""Every query of the engine against its SQL, on the smallest tables."""

import re
from pathlib import Path

import pytest
from millrace import queries
from millrace.queries import LANGUAGE, ORACLE, QUERIES, TEXT

from .compare import connection, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLE[name])


def test_queries_without_sql(spark):
    rows = QUERIES["fn_rand"](spark, SF).collect()
    assert all(0 <= r["r"] < 1 << 32 and r["r"] == int(r["r"]) for r in rows) and len({r["r"] for r in rows}) > 20
    assert sorted(r["n"] for r in QUERIES["fn_inc"](spark, SF).collect()) == [float(i) for i in range(1, 26)]
    assert len({tuple(r)[1:] for r in QUERIES["fn_now"](spark, SF).collect()}) == 1
    assert len({r["h"] for r in QUERIES["fn_sip"](spark, SF).collect()}) == 25


def test_no_sampling_in_registered_queries():
    for name, (text, _) in LANGUAGE.items():
        if re.search(r"\b(limit|top) [1-9]", text):
            assert re.search(r"sort|top|limit|agg_order|distinct_ordered", name), name


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(TEXT))
def test_text_in_several_files(spark, con, name, monkeypatch):
    """Large tables are written and read by many tasks: no file, and so no task, holds a whole table."""
    monkeypatch.setattr(queries, "FILE_ROWS", 150)
    same(QUERIES[name](spark, SF), con, ORACLE[name])


def test_text_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(queries, "FILE_ROWS", 150)
    at = queries.as_text(spark, SF, "{orders}", {}).strip("'")
    sizes = [len(p.read_text().splitlines()) - 1 for p in Path(at).glob("*.csv")]
    assert sum(sizes) == 1500 and len(sizes) == 10 and max(sizes) < 300
