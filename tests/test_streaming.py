import pytest
from millrace import Engine
from millrace.streaming import add_stream, start
from pyspark.sql.utils import AnalysisException


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "in"
    f.mkdir()
    (f / "1.csv").write_text("1,a,1.5\n2,b,\n")
    return f


def test_new_rows_are_appended(spark, folder, tmp_path):
    engine = add_stream(Engine(spark), "seen", str(folder))
    rows = lambda: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    run = lambda: start(engine, "select c1 + 10 as k, upper(c2) as t from seen where c3 > 1", str(tmp_path / "out"), str(tmp_path / "at"), once=True).awaitTermination(60)
    assert run()
    assert rows() == [(11, "A"), (12, "B")]
    (folder / "2.csv").write_text("3,c,2\n4,d,0.5\n")
    assert run()
    assert rows() == [(11, "A"), (12, "B"), (13, "C")]


def test_groups_are_answered_anew(spark, folder, tmp_path):
    engine = add_stream(Engine(spark), "seen", str(folder), files_per_batch=1)
    run = lambda: start(engine, "with c2 as k select k, count(*) as n, sum(c1) as s from seen group by k having count(*) > 1", str(tmp_path / "out"), str(tmp_path / "at"), once=True).awaitTermination(60)
    (folder / "2.csv").write_text("3,a,2\n4,d,0.5\n")
    assert run()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 2.0, 4)]


def test_order_without_groups_is_refused(spark, folder, tmp_path):
    engine = add_stream(Engine(spark), "seen", str(folder))
    with pytest.raises(AnalysisException):
        start(engine, "select c1 from seen order by c1", str(tmp_path / "out"), str(tmp_path / "at"))
