import csv
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace import Engine, Options, QueryError
from millrace import sinks
from millrace.functions.cipher import siphash
from millrace.operators.ordinals import number_rows
from millrace.plans.types import Kind
from millrace.sources import delimited


@pytest.fixture
def files(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.write_text(text, encoding="utf-8")
        return str(p)

    return write


@pytest.fixture
def run(spark):
    engine = Engine(spark, Options(password="secret"))

    def rows(text):
        return [tuple(r) for r in engine.sql(text).collect()]

    rows.engine = engine
    return rows


@pytest.fixture
def nulls(files):
    return files("nulls.csv", "k,t,f\n1,a,1.5\n,NA,\n3,,2.5\n-2,null,-1.25\n")


@pytest.fixture
def cities(files):
    return files("cities.csv", '1,Kabul,AFG,100\n2,Herat,AFG,50\n3,Berlin,DEU,300\n4,"Foo, Bar",ZZZ,\n5,Nowhere,,7\n')


@pytest.fixture
def country(files):
    return files("country.csv", "AFG,Afghanistan,Asia,652090\nDEU,Germany,Europe,357022\nFRA,France,Europe,551500\n,None,Europe,1\n")


def test_nulls_in_comparisons(run, nulls):
    ks = lambda p: [r[0] for r in run(f"select c1 + 0 from '{nulls}' H where {p}")]
    assert ks("k > 1") == [None, 3]
    assert ks("k >= 3") == [None, 3]
    assert ks("k < 3") == [1, -2]
    assert ks("k <> 1") == [None, 3, -2]
    assert ks("k = null") == [None] == ks("k is null")
    assert ks("not k > 1") == [1, -2]
    assert ks("k between 3 and 1") == [1, 3]
    assert ks("k not between 0 and 2") == [3, -2]
    assert ks("k in (1, null)") == [1, None]
    assert ks("t like null") == [3]
    assert ks("t not like 'n%'") == [1, 3]
    assert ks("k > 0 xor f > 2") == [1]
    assert ks("k > 0 or f > 2") == [1, None, 3]


def test_na_is_neutral_for_kinds_but_text_when_read(run, nulls):
    assert run(f"select t, len(t) from '{nulls}'") == [("a", 1.0), ("NA", 2.0), (None, 0.0), ("null", 4.0)]
    assert run(f"select k + 1, f * 2 from '{nulls}'") == [(2, 3.0), (None, None), (4, 5.0), (-1, -2.5)]


def test_nulls_sort_as_zero(run, nulls):
    assert run(f"select k from '{nulls}' order by k") == [("-2",), (None,), ("1",), ("3",)]
    assert run(f"select t from '{nulls}' order by t desc") == [("null",), ("a",), ("NA",), (None,)]


def test_kinds_of_columns(run, files):
    p = files("types.csv", "i,z,mix,d,u,blank,code\n1,007,1,2020-01-02 03:04:05,3 weeks,,AB12\n-2,123,2.5,5/18/1955,10y,,12abc\n3,4,.5,May 18 1955,5ms,,7\n")
    assert list(run.engine.query(f"'{p}'").kinds) == [Kind.INT, Kind.TEXT, Kind.FLOAT, Kind.DATE, Kind.DURATION, Kind.TEXT, Kind.TEXT]
    assert run(f"select i, mix + 1, d + '1 day', u * 2, int(code), blank from '{p}'") == [
        ("1", 2.0, datetime(2020, 1, 3, 3, 4, 5), "42d", None, None),
        ("-2", 3.5, datetime(1955, 5, 19), "7304d", 12, None),
        ("3", 1.5, datetime(1955, 5, 19), "10ms", 7, None),
    ]


def test_leaves_are_read_as_the_kind_needed(run, cities):
    assert run(f"select c1 + c2 as a, c4 + c1 as b, c4 + 1.5 as c from '{cities}' NH limit 1") == [("1Kabul", 101, 101.5)]
    assert run(f"select c4 + null as a, c2 + null as b from '{cities}' NH limit 1") == [(None, "Kabul")]


def test_quotes_and_bytes(run, files):
    p = files("q.csv", 'n,t\n1,"a ""b"", c"\n2,"two\nlines"\n3,  José  \n4,""\n')
    assert run(f"select t, len(t), upper(t) from '{p}'") == [('a "b", c', 8.0, 'A "B", C'), ("two\nlines", 9.0, "TWO\nLINES"), ("José", 5.0, "JOSé"), (None, 0.0, None)]
    assert run(f"select substr(t, 3, 2), substr(t, 99, 1), substr(t, 'o.') from '{p}' where n = 3") == [("é", None, "os")]


def test_headers_and_delimiters(run, files):
    body = [("a", "b"), ("x", "1"), ("y", "2")]
    for name, sep, option in (("c.csv", ",", ""), ("t.tsv", "\t", ""), ("t.txt", "\t", "T"), ("p.txt", "|", "P"), ("s.txt", " ", "S")):
        p = files(name, "".join(sep.join(r) + "\n" for r in body))
        assert run(f"select a, b + 1 from '{p}' {option}") == [("x", 2), ("y", 3)], name
        assert len(run(f"select c1 from '{p}' {option} NH")) == 3
    p = files("n.csv", "x,1\ny,2\n")
    assert run(f"'{p}'") == [("x", "1"), ("y", "2")]
    assert run(f"select x from '{p}' H") == [("y",)]
    assert run(f"'{p[:-4]}'") == [("x", "1"), ("y", "2")]
    with pytest.raises(QueryError):
        run("select a from '/nowhere/x.csv'")


def test_ragged_rows(spark, files):
    p = files("r.csv", "a,b\n1,2\n3\n5,6\n")
    with pytest.raises(Exception):
        Engine(spark).sql(f"'{p}'").collect()
    assert [tuple(r) for r in Engine(spark, Options(ragged="pad")).sql(f"'{p}'").collect()] == [("1", "2"), ("3", None), ("5", "6")]
    assert [tuple(r) for r in Engine(spark, Options(ragged="drop")).sql(f"'{p}'").collect()] == [("1", "2"), ("5", "6")]


def test_joins(run, cities, country):
    inner = run(f"select j.c2, o.c2 from '{cities}' NH j join '{country}' NH o on j.c3 = o.c1")
    assert sorted(inner) == [("Berlin", "Germany"), ("Herat", "Afghanistan"), ("Kabul", "Afghanistan"), ("Nowhere", "None")]
    left = run(f"select j.c2, o.c2 from '{cities}' NH j left join '{country}' NH o on j.c3 = o.c1 and o.c3 like 'asia'")
    assert run(f"select j.c1, o.c2 from '{cities}' NH j join '{country}' NH o on j.c3 = o.c1 limit 3") == [("1", "Afghanistan"), ("2", "Afghanistan"), ("3", "Germany")]
    assert sorted(left, key=str) == sorted([("Kabul", "Afghanistan"), ("Herat", "Afghanistan"), ("Berlin", None), ("Foo, Bar", None), ("Nowhere", None)], key=str)
    either = run(f"select j.c1, o.c1 from '{cities}' NH j left join '{country}' NH o on j.c3 = o.c1 or j.c2 = o.c2")
    assert len(either) == 5
    for bad in ("j.c1 = j.c4", "o.c1 = o.c2", "j.c1 = 3", "j.c3 + o.c1 = o.c2"):
        with pytest.raises(QueryError):
            run(f"select j.c1 from '{cities}' NH j join '{country}' NH o on {bad}")


def test_or_of_equalities_is_a_union_of_hash_joins(run, spark):
    a = spark.range(50).selectExpr("id as x", "id % 7 as y")
    b = spark.range(20).selectExpr("id as u", "id % 3 as v")
    run.engine.register("ta", a).register("tb", b)
    for op, test in (("or", lambda p, q: p or q), ("xor", lambda p, q: p != q)):
        df = run.engine.sql(f"select x, u from ta a join tb b on a.x = b.u {op} a.y = b.v")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert sorted(map(tuple, df.collect())) == sorted((i, j) for i in range(50) for j in range(20) if test(i == j, i % 7 == j % 3))


@pytest.mark.parametrize("kind", ["join", "left join"])
@pytest.mark.parametrize("on", ["a.x >= b.lo and a.x < b.hi", "b.lo <= a.x and b.hi > a.x and a.y <> b.w", "b.lo < a.x and a.x <= b.hi", "a.d >= b.dlo and a.d < b.dhi"])
def test_two_bounds_are_a_band_join(spark, tmp_path, kind, on):
    values = [None if i % 17 == 0 else (i * 7919) % 1000 / 4 for i in range(400)]
    a = spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(values)], "k int, x double, y int").selectExpr("*", "timestamp_ntz '2020-01-01' + make_dt_interval(0, 0, 0, x) as d")
    spans = [(i, None if i % 11 == 0 else float(i * 13 % 250), None if i % 7 == 0 else float(i * 13 % 250 + i % 40 - 3)) for i in range(80)] + [(99, -1e9, 1e9)]
    b = spark.createDataFrame([(i, lo, hi, i % 3) for i, lo, hi in spans], "j int, lo double, hi double, w int")
    moved = lambda c: f"timestamp_ntz '2020-01-01' + make_dt_interval(0, 0, 0, greatest(least({c}, 1e6), -1e6))"
    b = b.selectExpr("*", f"if(lo is null, null, {moved('lo')}) as dlo", f"if(hi is null, null, {moved('hi')}) as dhi")
    for name, df in (("a", a), ("b", b)):
        df.write.parquet(f"{tmp_path}/{name}")  # Spark knows the size of files
    a, b = (spark.read.parquet(f"{tmp_path}/{name}") for name in "ab")
    plans = []
    for threshold in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        engine = Engine(spark).register("ta", a).register("tb", b)
        df = engine.sql(f"select k, j from ta a {kind} tb b on {on}")
        plans.append((df._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, df.collect()), key=str)))
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[0][1] == plans[1][1] and len(plans[0][1]) > 400
    assert "NestedLoop" in plans[0][0]
    assert "NestedLoop" not in plans[1][0] and "Cartesian" not in plans[1][0]


def test_empty_tables(run, spark):
    run.engine.register("none", spark.createDataFrame([], "k int, t string"))
    assert run("select * from none") == []
    assert run("select k, count(*) from none group by k") == []
    assert run("select count(*), sum(k), max(t) from none") == [(0.0, None, None)]
    assert run("select a.k from none a join none b on a.k = b.k") == []
    assert run("select inc() from none") == []


def test_groups(run, cities):
    assert run(f"select c3, count(*), sum(c4), c2 from '{cities}' NH group by c3") == [(None, 1.0, 7, "Nowhere"), ("AFG", 2.0, 150, "Kabul"), ("DEU", 1.0, 300, "Berlin"), ("ZZZ", 1.0, None, "Foo, Bar")]
    assert run(f"select c3, substr(c2, 0, 2) from '{cities}' NH group by c3 having count(*) > 1") == [("AFG", "He")]
    assert run(f"select c3, c2, substr(c2, 0, 2), c2 from '{cities}' NH group by c3 having count(*) > 1") == [("AFG", "Kabul", "He", "Kabul")]
    assert run(f"with c2 as name select c3, name + '!' from '{cities}' NH group by c3 having count(*) > 1") == [("AFG", "Kabul!")]
    assert run(f"select avg(c4), stdev(c4), stdevp(c1) from '{cities}' NH where c3 = DEU") == [(300.0, None, None)]
    assert run(f"select count(distinct c3), sum(c4) / 2 from '{cities}' NH") == [(3.0, 228)]
    # A single row comes whatever having says.
    assert run(f"select count(*) from '{cities}' NH having count(*) > 99") == [(5.0,)]


def test_errors_of_kinds(run, cities):
    for bad in ("-c2", "avg(c2)", "c2 - 1", "c2 * 2", "sum(c4) + c1", "max(sum(c4))", "abs(c2)", "round(c4, 12)", "format(c1, 999)", "substr(c2, x)", "inc(1)"):
        with pytest.raises(QueryError):
            run(f"select {bad} from '{cities}' NH")
    for bad in ("where sum(c4) > 1", "group by sum(c4)", "group by c3 having c3 = AFG"):
        with pytest.raises(QueryError):
            run(f"select count(*) from '{cities}' NH {bad}")
    with pytest.raises(QueryError):
        run(f"with c4 as dog select c2 dog, dog from '{cities}' NH")


def test_distinct_keeps_the_first(run, cities):
    assert run(f"select distinct c3 from '{cities}' NH") == [("AFG",), ("DEU",), ("ZZZ",), (None,)]
    assert run(f"select distinct top 2 c3 from '{cities}' NH order by c1 desc") == [(None,), ("ZZZ",)]


def test_row_numbers(run, spark, cities):
    assert run(f"select inc(), c1 from '{cities}' NH where c4 > 60") == [(1.0, "1"), (2.0, "3"), (3.0, "4")]
    assert run(f"select inc() as n, c2 from '{cities}' NH order by c1 desc limit 2") == [(1.0, "Nowhere"), (2.0, "Foo, Bar")]
    got = number_rows(spark.range(0, 1000, 1, 13), "n").collect()
    assert [r["n"] for r in sorted(got)] == [i + 1.0 for i in range(1000)]


def test_dates(run, files):
    p = files("d.csv", "d\n2020-02-29 23:59:58\n2024-12-31 00:00:00\n")
    assert run(f"select d + '1 year', d - '1y', d - '2020-02-28', week(d), day(d), dayofyear(d) from '{p}'") == [
        (datetime(2021, 2, 28, 23, 59, 58), datetime(2019, 2, 28, 23, 59, 58), "1d23h59m58s", 9, 7, 60),
        (datetime(2025, 12, 31), datetime(2023, 12, 31), "1768d", 53, 3, 366),
    ]
    assert run(f"select format(d, 109), format(d, 131), format(d, '100%% %b') from '{p}' limit 1") == [("Feb 29 2020 11:59:58:0000PM", "29/Feb/2020 11:59:58:000PM", "100% Feb")]
    for bad in ("d + d", "'1d' - d", "'1 day' * '2 days'", "5 / '1 day'", "d * 2"):
        with pytest.raises(QueryError):
            run(f"select {bad} from '{p}'")


def test_ciphers(run, spark):
    assert siphash(bytes(range(15))) == 0xA129CA6149BE45E5 - (1 << 64)
    assert siphash(b"") == 0x726FDB47DD0E0E31
    run.engine.register("w", spark.createDataFrame([("é",), ("",), (None,)], "t string"))
    assert run("select decrypt(encrypt(t)) from w") == [("é",), ("",), (None,)]
    sealed = run("select encrypt(t), encrypt(t, 'other') from w limit 1")[0]
    assert run(f"select decrypt('{sealed[0]}'), decrypt('{sealed[1]}'), decrypt('{sealed[0][:-8]}AAAAAAA=') from w limit 1") == [("é", None, None)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=40))
def test_floats_as_text(spark, values):
    from millrace.functions.convert import Expr, text_of
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r[0]: r[1] for r in df.select("i", text_of(Expr(Kind.FLOAT, F.col("v")))).collect()}
    assert got == {i: "%.10g" % v for i, v in enumerate(values)}


def test_saved_aliases(spark, files, tmp_path):
    p, kept = files("a.csv", "x,1\n"), str(tmp_path / "aliases.json")
    engine = Engine(spark, Options(catalog=kept))
    engine.sql(f"add mine {p} NH")
    again = Engine(spark, Options(catalog=kept))
    assert [r[0] for r in again.sql("show tables").collect()] == ["mine"]
    assert [tuple(r) for r in again.sql("select mine.c2 + 1 from mine").collect()] == [(2,)]
    again.sql("drop mine")
    with pytest.raises(QueryError):
        again.sql("drop mine")


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id as k", "id * 2 as v", "id * 3 as w", "id * 4 as x", "'x' as t").write.parquet(str(tmp_path / "p.parquet"))
    df = Engine(spark).sql(f"select k from '{tmp_path}/p.parquet' where k = 5 and v < 20 and w between 9 and 2 and x > 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for pushed in ("EqualNullSafe(k,5)", "LessThan(v,20)", "GreaterThanOrEqual(w,2)", "Or(GreaterThan(x,3),IsNull(x))", "ReadSchema: struct<k:bigint,v:bigint,w:bigint,x:bigint>"):
        assert pushed in plan, pushed
    # Aggregates need no order of the rows, so nothing stands between filter and scan.
    plan = Engine(spark).sql(f"with t as kind select kind, sum(v) + count(w) from '{tmp_path}/p.parquet' where v < 20 group by kind having max(k) > 3")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(v,20)" in plan and "monotonically" not in plan


def test_csv(run, cities, tmp_path):
    result = run.engine.query(f"select c2 as name, c4 / 3.0 as third from '{cities}' NH where c1 > 2")
    lines = ["name,third", "Berlin,100", '"Foo, Bar",', "Nowhere,2.333333333"]
    assert list(sinks.csv_text(result)) == lines
    sinks.append_csv(result, str(tmp_path / "o.csv"))
    sinks.append_csv(result, str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text().split("\n") == lines * 2 + [""]
    sinks.write_csv(result, str(tmp_path / "parts"))
    assert "\n".join(p.read_text() for p in (tmp_path / "parts").glob("part-*")).strip().split("\n") == lines
    assert not run.engine.query(f"select c2 from '{cities}' NH").header
    assert run.engine.query(f"OH select c2 from '{cities}' NH").header
    assert not run.engine.query(f"NOH select c2 as x from '{cities}' NH").header


def test_other_sinks(run, cities):
    import json

    result = run.engine.query(f"select c2 as name, c4 from '{cities}' NH")
    got = json.loads(sinks.to_json(result))
    assert (got["numrows"], got["colnames"], got["vals"][3]) == (5, ["name", "col2"], ["Foo, Bar", ""])
    assert "<td>Foo, Bar</td>" in sinks.to_html(result)
    assert list(sinks.boxes(result))[1] == "| name     | col2 |"
    assert sinks.sorted_by(result, "name", True).first()[0] == "Nowhere"
    assert sinks.having_value(result, "name", "Kabul").count() == 1
    assert sinks.without(result, "col2").columns == ["name"]


def test_command_line(capsys, cities, tmp_path, spark):
    from millrace import cli

    out = lambda *words: (cli.main(list(words)), capsys.readouterr().out)
    assert out("select c2 from {} NH", "where c1 = 1", cities) == (0, "Kabul\n")
    (tmp_path / "q.txt").write_text(f"select count(*) from '{cities}' NH; select c1 from '{cities}' NH where c4 = 50")
    assert out(str(tmp_path / "q.txt")) == (0, "5\n2\n")
    assert out("select count(*) from", cities, "NH", "-t")[1].split("\n")[3] == "| 5    |"
    assert "Kabul" in out("-f", cities)[1] and "\x1b[" in out("-y", f"from '{cities}' NH")[1]
    (tmp_path / "config").write_text("guess_file_header = false  # first rows are headers\nneed_comma_separator = false\ntable_or_csv = table\n")
    assert out("--config", str(tmp_path / "config"), f"select c1 c2 from '{cities}' limit 1")[1].split("\n")[1].split() == ["|", "1", "|", "Kabul", "|"]
    assert out("-m", f"select c1 c2 as x from '{cities}' NH limit 1")[1] == "col1,x\n1,Kabul\n"
    assert out("-j", f"select c1 from '{cities}' NH")[1].startswith('{"query"') and out("-w", f"select c1 from '{cities}' NH")[1].startswith("<table")
    assert out("selekt a from b c d")[0] == out("select {}")[0] == 1
    assert out("-v")[0] == 0


def test_several_files_keep_their_order(spark, tmp_path):
    """Spark reads the largest file first; rows count by the files' names."""
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    at = 0
    for i, n in enumerate((3, 40, 200, 7)):
        (folder / f"part-{i}.csv").write_text("n,k\n" + "".join(f"{j},{'abcd'[j % 4]}\n" for j in range(at, at + n)))
        at += n
    rows = lambda text: [tuple(r) for r in Engine(spark).sql(text.format(f"'{folder}'")).collect()]
    assert rows("select n + 0 as v from {} limit 5") == [(i,) for i in range(5)]
    assert sorted(rows("select inc() as i, n + 1 as v from {}")) == [(float(i), i) for i in range(1, at + 1)]
    assert sorted(rows("select inc() as i, n + 0 as v from {} where n > 1")) == [(float(i - 1), i) for i in range(2, at)]
    assert rows("select distinct top 3 k from {}") == [("a",), ("b",), ("c",)]
    assert rows("select k, n, n + 0 as last from {} group by k") == [(c, str(i), at - 1 - (at - 1 - i) % 4) for i, c in enumerate("abcd")]


@pytest.mark.parametrize("together", [1, 60, 1 << 18])
def test_kinds_come_from_the_first_rows_of_several_files(spark, tmp_path, monkeypatch, together):
    """By the files' names, as for the same rows in one file: not from the largest file, which Spark reads first."""
    monkeypatch.setattr(delimited.kinds_of, "__defaults__", (50,))
    monkeypatch.setattr(delimited, "TOGETHER", together, raising=False)
    cells = [str(i) for i in range(30)] + [f"{i}.5" for i in range(20)] + [f"x{i}" for i in range(400)]
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("")
    for name, a, b in (("1 a", 0, 5), ("2*", 5, 30), ("3%20", 30, 35), ("4", 35, 60), ("5", 60, 450)):
        (folder / f"part-{name}.csv").write_text("n\n" + "".join(f"{c}\n" for c in cells[a:b]))
    one = tmp_path / "one.csv"
    one.write_text("n\n" + "".join(f"{c}\n" for c in cells))
    for at in (folder, one):
        _, names, kinds, _ = delimited.read(spark, str(at), frozenset("H"))
        assert (names, kinds) == (["n"], [Kind.FLOAT]), at


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_files_are_read_by_many_tasks(spark, files, small_splits):
    for name, sep in (("l.csv", ","), ("l.tsv", "\t")):
        p = files(name, f"n{sep}t\n" + "".join(f'{i}{sep}"x {i}"\n' for i in range(300)))
        got = Engine(spark).sql(f"select n + 0 as v, t from '{p}'")
        quote = "" if sep == "," else '"'
        assert got.rdd.getNumPartitions() > 5
        assert [tuple(r) for r in got.collect()] == [(i, f"{quote}x {i}{quote}") for i in range(300)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("longest", [3, 60])
def test_quoted_line_breaks_over_splits(spark, tmp_path, small_splits, end, longest):
    """Records of up to several splits, some of whose lines look like records."""
    rnd, p, folder = random.Random(longest), tmp_path / "q.csv", tmp_path / "q"
    text = lambda: "t" + "\n".join(rnd.choice(["", "a", '"b", c', '7,"', '""', "8,x", "é"]) for _ in range(rnd.randint(1, longest)))
    rows = [(i, text() if i % 3 else "plain", i * 2) for i in range(200)]

    def write(path, rows):
        with open(path, "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator=end).writerows([("n", "t", "m"), *((a, b.replace("\n", end), c) for a, b, c in rows)])

    write(p, rows)
    read = lambda text: Engine(spark).sql(text)
    got = read(f"select n + 0 as v, t, m + 0 as w from '{p}'")
    assert got.rdd.getNumPartitions() > 5
    assert [tuple(r) for r in got.collect()] == rows
    folder.mkdir()
    for i, (a, b) in enumerate(((0, 20), (20, 120), (120, 200))):
        write(folder / f"{i}.csv", rows[a:b])
    assert sorted(tuple(r) for r in read(f"select inc() as i, n + 0 as v, t from '{folder}'").collect()) == [(float(i + 1), i, t) for i, t, _ in rows]


def test_ragged_rows_of_large_files(spark, files, small_splits):
    p = files("r.csv", "a,b\n" + '1,"x\ny"\n' * 60 + '3\n5,6,7\n5,"a" b"c\n' + "9,10\n" * 60)
    with pytest.raises(Exception):
        Engine(spark).sql(f"'{p}'").collect()
    rest = [("5", '"a" b"c')] + [("9", "10")] * 60
    assert [tuple(r) for r in Engine(spark, Options(ragged="pad")).sql(f"'{p}'").collect()][60:] == [("3", None), ("5", "6"), *rest]
    assert [tuple(r) for r in Engine(spark, Options(ragged="drop")).sql(f"'{p}'").collect()][60:] == rest


def test_kinds_come_from_the_first_rows_of_a_split_file(spark, files, small_splits, monkeypatch):
    """Not from rows that later tasks hold: the sample is the same however many tasks read the file."""
    monkeypatch.setattr(delimited.kinds_of, "__defaults__", (50,))
    p = files("k.csv", "n\n" + "".join(f"{i}\n" for i in range(100, 500)) + "".join(f"{i}.5\n" for i in range(400)))
    _, _, kinds, _ = delimited.read(spark, p, frozenset("H"))
    assert kinds == [Kind.INT]
