import pytest
from millrace.errors import QueryError
from millrace.language import syntax as S
from millrace.language.grammar import parse
from millrace.language.tokens import statements
from millrace.plans import types as T
from millrace.plans.types import Kind, Typed

W = S.Word


def expr(text, **kw):
    return parse(f"select {text} from t", **kw).items[0].expr


def where(text, **kw):
    return parse(f"select a from t where {text}", **kw).where


def test_arithmetic_nests_to_the_right():
    assert expr("a-b-c") == S.Binary("-", W("a"), S.Binary("-", W("b"), W("c")))
    assert expr("a/b*c") == S.Binary("/", W("a"), S.Binary("*", W("b"), W("c")))
    assert expr("a+b*c") == S.Binary("+", W("a"), S.Binary("*", W("b"), W("c")))
    assert expr("a*b^c") == S.Binary("*", W("a"), S.Binary("^", W("b"), W("c")))
    assert expr("a+-b") == S.Binary("+", W("a"), S.Negative(W("b")))


def test_standard_precedence():
    assert expr("a-b-c", standard_precedence=True) == S.Binary("-", S.Binary("-", W("a"), W("b")), W("c"))
    assert expr("a*b^c", standard_precedence=True) == S.Binary("*", W("a"), S.Binary("^", W("b"), W("c")))
    got = where("not a = 1 and b = 2 or c = 3", standard_precedence=True)
    assert got.op == "or" and got.left.op == "and" and isinstance(got.left.left, S.Not)


def test_logic_nests_to_the_right_and_not_takes_the_rest():
    a, b, c = (S.Compare("=", W(x), W("1")) for x in "abc")
    assert where("a = 1 and b = 1 or c = 1") == S.Logic("and", a, S.Logic("or", b, c))
    assert where("not a = 1 and b = 1") == S.Not(S.Logic("and", a, b))
    assert where("(not a = 1) and b = 1") == S.Logic("and", S.Not(a), b)
    assert where("a not = 1") == S.Not(a)
    assert where("a is not null") == S.Not(S.Compare("=", W("a"), W("null")))


def test_parentheses_hold_predicates_or_values():
    assert where("(a + b) * 2 > 3") == S.Compare(">", S.Binary("*", S.Binary("+", W("a"), W("b")), W("2")), W("3"))
    assert isinstance(where("(a = 1 or b = 2)"), S.Logic)


def test_clauses_come_in_any_order():
    a = parse("select a from t order by a desc where a > 1 limit 3 group by a having max(a) > 2")
    assert a.where and a.having and a.group == (W("a"),) and a.order == (S.OrderKey(W("a"), True),) and a.rows == 3
    assert parse("select top 4 a from t").rows == 4
    assert parse("select top 4 a from t limit 9").rows == 9
    assert parse("select a from t limit 0").rows == 0


def test_selections():
    q = parse("select a, b c, d as e, f = g + 1, * from 'x y.csv' NH as t")
    assert [i.alias for i in q.items] == [None, "c", "e", "f", None]
    assert q.tables == (S.Table("x y.csv", True, frozenset(["NH"]), "t"),)
    q = parse("M select a b+1 as c d from t")
    assert [i.alias for i in q.items] == [None, "c", None]
    assert parse("select from t").items == (S.Item(S.Star()),) == parse("/data/t.csv").items


def test_sets():
    assert where("a in (FRA, 'AND', 3)") == S.InList(W("a"), (W("FRA"), W("AND", True), W("3")))
    assert where("a in (NH)") == S.InList(W("a"), (W("NH"),))
    assert isinstance(where("a not in (select b from u where b > 1)").of, S.InQuery)


def test_comments_and_statements():
    assert parse("select a -- ; from\n from /* x */ t").items[0].expr == W("a")
    assert [s.strip() for s in statements("select ';' from t; -- none;\n select b from u;")] == ["select ';' from t", "-- none;\n select b from u"]


@pytest.mark.parametrize(
    "text",
    [
        "select",
        "select a",
        "select a from t where",
        "select a from t where a",
        "select a b c from t",
        "select 'a from t",
        "select a from (select b from u)",
        "select a from t limit x",
        "select pow(a) from t",
        "select case when a = 1 then 2 from t",
        "H NH select a from t",
        "with a as x, b as x select x from t",
        "select a from t where b in (select c from)",
        "select a from t join u",
        "select count(a from t",
    ],
)
def test_faulty_queries(text):
    with pytest.raises(QueryError):
        parse(text)


def test_kinds_of_literals():
    want = {"12": Kind.INT, "-3": Kind.INT, "007": Kind.TEXT, ".5": Kind.FLOAT, "1.25": Kind.FLOAT, "1e5": Kind.TEXT, "+1": Kind.TEXT, "3 weeks": Kind.DURATION, "10y": Kind.DURATION, "5ms": Kind.DURATION}
    want |= {"1/2/2020": Kind.DATE, "2020-01-02 03:04:05": Kind.DATE, "May 18 1955": Kind.DATE, "13/1/2020": Kind.TEXT, "dog": Kind.TEXT, "null": Kind.NULL, "NULL": Kind.NULL}
    assert {k: T.literal_kind(k) for k in want} == want


def test_blending():
    c, lit = Typed, lambda k: Typed(k, True)
    assert T.blend(c(Kind.INT), c(Kind.FLOAT)).kind == Kind.FLOAT
    assert T.blend(c(Kind.INT), c(Kind.TEXT)).kind == Kind.TEXT
    assert T.blend(c(Kind.INT), lit(Kind.TEXT)).kind == Kind.INT
    assert T.blend(c(Kind.INT), lit(Kind.DATE)).kind == Kind.INT
    assert T.blend(c(Kind.DATE), lit(Kind.INT)).kind == Kind.DATE
    assert T.blend(lit(Kind.INT), lit(Kind.TEXT)).kind == Kind.TEXT
    assert T.blend(c(Kind.FLOAT), lit(Kind.DURATION)).kind == Kind.FLOAT
    assert T.blend(c(Kind.NULL), c(Kind.DATE)).kind == Kind.DATE
    for a in Kind:
        for b in Kind:
            for x in (False, True):
                for y in (False, True):
                    assert T.blend(Typed(a, x), Typed(b, y)).kind == T.blend(Typed(b, y), Typed(a, x)).kind


def test_durations():
    assert T.parse_duration("10 years") == (10 * 31_536_000_000_000 + 2 * 86_400_000_000, 10)
    assert T.parse_duration("1.5h") == (5_400_000_000, 0)
    assert T.parse_duration("5ms") == (5_000, 0)
    assert T.parse_duration("-1h") is None and T.parse_duration("week") is None
