"""From expressions to Spark columns, in two steps: kinds go up from the leaves, then down to them.

A leaf is read as the kind its whole expression needs, so c7 + c1 with a text c1 joins the raw text of c7. Only date and
duration arithmetic lets each operand keep its own kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import cipher, dates, scalar
from ..functions.convert import Expr, convert, literal, null, text_of, years_of
from ..language import syntax as S
from . import types as T
from .scope import AGGREGATES, Scope
from .types import Kind, Typed

CASTS = {"string": Kind.TEXT, "text": Kind.TEXT, "int": Kind.INT, "float": Kind.FLOAT, "date": Kind.DATE, "duration": Kind.DURATION}
NOWS = {"now": False, "nowlocal": False, "nowgm": True}
STAR = S.Star()


class Compiler:
    """known: nodes whose values stand in columns already, such as aggregates after grouping."""

    def __init__(self, scope: Scope, nan: bool = False, password: str | None = None, joining: bool = False, known: dict[S.Node, Expr] | None = None):
        self.scope, self.nan, self.password, self.joining = scope, nan, password, joining
        self.known = known or {}
        self.scalars = scalar.scalars(nan)
        self._typed: dict[S.Node, Typed] = {}

    def with_known(self, known: dict[S.Node, Expr]) -> Compiler:
        return Compiler(self.scope, self.nan, self.password, self.joining, {**self.known, **known})

    # kinds, upwards

    def typed(self, node: S.Node) -> Typed:
        if node not in self._typed:
            self._typed[node] = self._type(node)
        return self._typed[node]

    def blended(self, *nodes: S.Node) -> Typed:
        out = Typed(Kind.NULL, True)
        for n in nodes:
            out = T.blend(out, self.typed(n))
        return out

    def _type(self, node: S.Node) -> Typed:
        if node in self.known:
            return Typed(self.known[node].kind)
        match node:
            case S.Word(text):
                if (inner := self.scope.variable(node)) is not None:
                    return self.typed(inner)
                if found := self.scope.column(node):
                    return Typed(found[1].kind)
                return Typed(T.literal_kind(text), True)
            case S.Negative(of):
                inner = self.typed(of)
                if inner.kind in (Kind.TEXT, Kind.DATE):
                    raise QueryError(f"Cannot negate {inner.kind.name.lower()}")
                return inner
            case S.Binary(op, left, right):
                a, b = self.typed(left), self.typed(right)
                if (kind := T.algebra(op, a.kind, b.kind)) is not None:
                    return Typed(kind, a.literal and b.literal)
                met = T.blend(a, b)
                bent = lambda t: met.kind if t.literal and t.kind == Kind.TEXT else t.kind
                T.check(op, bent(a), bent(b), met.kind)
                return met
            case S.Case(_, branches, default):
                results = [r for _, r in branches] + ([default] if default is not None else [])
                return Typed(self.blended(*results).kind)
            case S.Call():
                return Typed(self._call_kind(node))
        raise QueryError("A predicate cannot be used as a value")

    def _call_kind(self, node: S.Call) -> Kind:
        name, args = node.name, node.args
        if name in AGGREGATES:
            return self._aggregate_kind(node)
        if name in CASTS:
            return CASTS[name]
        if name in self.scalars:
            return self.scalars[name].gives
        if name in NOWS:
            return Kind.DATE
        if name in ("rand", "inc", "ceil", "floor", "round"):
            return Kind.FLOAT
        if name in ("substr", "format", "encrypt", "decrypt"):
            return Kind.TEXT
        if name == "coalesce":
            return self.blended(*args).kind
        if name == "abs":
            kind = self.typed(args[0]).kind
            if kind in (Kind.TEXT, Kind.DATE):
                raise QueryError(f"Cannot use abs with type {kind.name.lower()}")
            return kind
        if name == "pow":
            met = self.blended(*args)
            T.check("^", self.typed(args[0]).kind, self.typed(args[1]).kind, met.kind)
            return met.kind
        raise QueryError(f"Unknown function {name}")

    def _aggregate_kind(self, node: S.Call) -> Kind:
        if node.name == "count":
            return Kind.FLOAT
        kind = self.typed(node.args[0]).kind
        if any(self.scope.aggregated(a) for a in node.args):
            raise QueryError("Cannot have aggregate function inside another")
        if node.name in ("min", "max"):
            return kind
        if kind not in (Kind.INT, Kind.FLOAT, Kind.NULL):
            raise QueryError(f"Cannot use {node.name} function with type {kind.name.lower()}")
        return kind if node.name == "sum" else Kind.FLOAT

    # columns, downwards

    def value(self, node: S.Node, want: Kind | None = None) -> Expr:
        """The node as the kind wanted, else as its own."""
        want = self.typed(node).kind if want is None else want
        if want == Kind.NULL:
            want = Kind.TEXT
        return convert(self._value(node, want), want)

    def column(self, node: S.Node, want: Kind | None = None) -> Column:
        return self.value(node, want).col

    def bare(self, node: S.Node) -> Expr:
        """A selection: a column alone stands as it is."""
        if node in self.known:
            return self.known[node]
        found = self.scope.bare_column(node)
        return found.bare() if found else self.value(node)

    def _value(self, node: S.Node, want: Kind) -> Expr:
        if node in self.known:
            return self.known[node]
        match node:
            case S.Word(text):
                if (inner := self.scope.variable(node)) is not None:
                    return self.value(inner) if self.scope.bare_column(inner) is None else self._value(inner, want)
                if found := self.scope.column(node):
                    return found[1].read(want)
                return null(want) if not node.quoted and text.lower() == "null" else literal(text, want)
            case S.Negative(of):
                inner = self.value(of, want)
                return Expr(inner.kind, -inner.col, None if inner.years is None else -inner.years)
            case S.Binary():
                return self._binary(node, want)
            case S.Case():
                return self._case(node, want)
            case S.Call():
                return self._call(node, want)
        raise QueryError("A predicate cannot be used as a value")

    def _binary(self, node: S.Binary, want: Kind) -> Expr:
        op, ta, tb = node.op, self.typed(node.left).kind, self.typed(node.right).kind
        if T.algebra(op, ta, tb) is not None:
            return self._algebra(op, self.value(node.left), self.value(node.right))
        # A number wanted as text is computed first; text that meets text joins.
        own = self.typed(node).kind
        kind = want if own in T.NUMBERS and want in T.NUMBERS and not (own == Kind.FLOAT and want == Kind.INT) else own
        if kind == Kind.NULL:
            return null(want)
        a, b = self.value(node.left, kind), self.value(node.right, kind)
        if kind == Kind.TEXT:
            x, y = a.col, b.col
            return Expr(kind, F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.concat(x, y)))
        if kind == Kind.DURATION:
            make = F.try_add if op == "+" else F.try_subtract
            both = (years_of(a) != 0) & (years_of(b) != 0)
            years = None if a.years is None or b.years is None else F.when(both, make(a.years, b.years)).otherwise(0)
            return Expr(kind, make(a.col, b.col), years)
        return Expr(kind, self._arithmetic(op, kind, a.col, b.col))

    def _arithmetic(self, op: str, kind: Kind, x: Column, y: Column) -> Column:
        match op:
            case "+":
                return F.try_add(x, y)
            case "-":
                return F.try_subtract(x, y)
            case "*":
                return F.try_multiply(x, y)
            case "/":
                return F.call_function("div", x, F.nullif(y, F.lit(0).cast("bigint"))) if kind == Kind.INT else F.try_divide(x, y)
            case "%":
                return F.try_mod(x, y)
            case "^":
                power = F.pow(x.cast("double"), y.cast("double"))
                return power.try_cast("bigint") if kind == Kind.INT else power
        raise AssertionError(op)

    def _algebra(self, op: str, a: Expr, b: Expr) -> Expr:
        D, U = Kind.DATE, Kind.DURATION
        if a.kind == D and b.kind == D:
            return Expr(U, dates.between(a.col, b.col))
        if D in (a.kind, b.kind):
            date, by = (a, b) if a.kind == D else (b, a)
            return Expr(D, dates.shift(date.col, by.col, by.years, -1 if op == "-" else 1))
        if a.kind == b.kind:
            return Expr(Kind.FLOAT, F.try_divide(a.col.cast("double"), b.col.cast("double")))
        duration, number = (a, b) if a.kind == U else (b, a)
        n = number.col.cast("double")
        if op == "*":
            micros = F.try_multiply(duration.col, number.col) if number.kind == Kind.INT else (duration.col * n).try_cast("bigint")
        else:
            micros = F.call_function("div", duration.col, F.nullif(number.col, F.lit(0).cast("bigint"))) if number.kind == Kind.INT else F.try_divide(duration.col.cast("double"), n).try_cast("bigint")
        return Expr(U, micros)

    def _case(self, node: S.Case, want: Kind) -> Expr:
        kind = self.typed(node).kind
        kind = want if kind == Kind.NULL or kind in T.NUMBERS and want in T.NUMBERS and not (kind == Kind.FLOAT and want == Kind.INT) else kind
        subject = None if node.subject is None else self.blended(node.subject, *[t for t, _ in node.branches]).kind
        tests = [self.predicate(t) if subject is None else self.column(node.subject, subject).eqNullSafe(self.column(t, subject)) for t, _ in node.branches]
        results = [self.value(r, kind) for _, r in node.branches]
        default = null(kind) if node.default is None else self.value(node.default, kind)

        def chosen(of) -> Column:
            out = F.when(tests[0], of(results[0]))
            for t, r in zip(tests[1:], results[1:], strict=True):
                out = out.when(t, of(r))
            return out.otherwise(of(default))

        years = chosen(years_of) if any(e.years is not None for e in (*results, default)) else None
        return Expr(results[0].kind, chosen(lambda e: e.col), years)

    def _call(self, node: S.Call, want: Kind) -> Expr:
        name, args = node.name, node.args
        if name in AGGREGATES:
            raise QueryError(f"Cannot use the aggregate function {name} here")
        if name in CASTS:
            return self.value(args[0], CASTS[name]) if self._reads_text(args[0]) else convert(self.value(args[0]), CASTS[name])
        if name in self.scalars:
            f = self.scalars[name]
            return Expr(f.gives, f.make(self.column(args[0], f.takes)))
        if name in NOWS:
            return Expr(Kind.DATE, dates.now(NOWS[name]))
        if name == "rand":
            return Expr(Kind.FLOAT, scalar.random())
        if name == "inc":
            raise QueryError("inc() cannot be used here")
        if name in ("ceil", "floor", "round"):
            return Expr(Kind.FLOAT, scalar.rounded(name, self.column(args[0], Kind.FLOAT), self._digits(node)))
        if name == "substr":
            return Expr(Kind.TEXT, self._substr(node))
        if name == "format":
            if not isinstance(args[1], S.Word):
                raise QueryError("The format of a date must be a literal")
            return Expr(Kind.TEXT, F.date_format(self.column(args[0], Kind.DATE), dates.pattern(args[1].text)))
        if name in ("encrypt", "decrypt"):
            password = args[1].text if len(args) > 1 and isinstance(args[1], S.Word) else self.password
            if not password:
                raise QueryError(f"{name} needs a password")
            return Expr(Kind.TEXT, getattr(cipher, name)(self.column(args[0], Kind.TEXT), password))
        if name == "coalesce":
            kind = self.blended(*args).kind
            kind = want if kind == Kind.NULL else kind
            values = [self.value(a, kind) for a in args]
            years = None
            if any(v.years is not None for v in values):
                years = F.coalesce(*[F.when(v.col.isNotNull(), years_of(v)) for v in values])
            return Expr(values[0].kind, F.coalesce(*[v.col for v in values]), years)
        if name == "abs":
            inner = self.value(args[0])
            return Expr(inner.kind, F.abs(inner.col), None if inner.years is None else F.abs(inner.years))
        if name == "pow":
            kind = self.typed(node).kind
            return Expr(kind, self._arithmetic("^", kind, self.column(args[0], kind), self.column(args[1], kind)))
        raise QueryError(f"Unknown function {name}")

    def _reads_text(self, node: S.Node) -> bool:
        """Whether a cast goes down to the leaf: a column or literal is read as the kind that is cast to."""
        return isinstance(node, S.Word) and node not in self.known and self.scope.variable(node) is None

    def _digits(self, node: S.Call) -> int:
        if len(node.args) == 1:
            return 0
        given, sign = node.args[1], 1
        if isinstance(given, S.Negative):
            given, sign = given.of, -1
        if not (isinstance(given, S.Word) and given.text.isdigit() and int(given.text) <= 9):
            raise QueryError(f"{node.name} function 2nd value must be integer from -9 to 9")
        return sign * int(given.text)

    def _substr(self, node: S.Call) -> Column:
        text, rest = self.column(node.args[0], Kind.TEXT), node.args[1:]
        if len(rest) == 1 and isinstance(rest[0], S.Word) and rest[0].quoted:
            return F.regexp_substr(text, F.lit(rest[0].text))
        if len(rest) == 2 and all(isinstance(x, S.Word) and x.text.isdigit() for x in rest):
            return scalar.substring(text, int(rest[0].text), int(rest[1].text))
        raise QueryError("SUBSTR function requires 2 numbers or 1 pattern")

    # predicates

    def predicate(self, node: S.Node, loose: bool = False) -> Column:
        """True or false, never null. `loose`: null may stand for false, as a filter takes it; such comparisons reach the scan."""
        if node in self.known:
            return self.known[node].col
        sure = (lambda c: c) if loose else (lambda c: F.coalesce(c, F.lit(False)))
        match node:
            case S.Logic("xor", left, right):
                return self.predicate(left) != self.predicate(right)
            case S.Logic(op, left, right):
                a, b = self.predicate(left, loose), self.predicate(right, loose)
                return a & b if op == "and" else a | b
            case S.Not(of):
                return ~self.predicate(of)
            case S.Compare():
                return self._compare(node, loose)
            case S.Between(of, low, high, negated):
                kind = self.blended(of, low, high).kind
                x, a, b = (self.column(n, kind) for n in (of, low, high))
                known = a.isNotNull() & b.isNotNull()  # least and greatest skip nulls
                inside = (x >= F.least(a, b)) & (x <= F.greatest(a, b))
                return sure(known & (~inside if negated else inside))
            case S.Like(of, pattern, is_null):
                if is_null:
                    return self.column(of, Kind.TEXT).isNull()
                regex = pattern.replace("_", ".").replace("%", ".*")
                return sure(self.column(of, Kind.TEXT).rlike(rf"(?is)\A(?:{regex})\z"))
            case S.InList(of, items):
                kind = self.blended(of, *items).kind
                x = self.column(of, kind)
                values = [i for i in items if not (isinstance(i, S.Word) and not i.quoted and i.text.lower() == "null")]
                out = F.lit(False)
                if values and all(isinstance(i, S.Word) and self.typed(i).literal for i in values):
                    out = sure(x.isin(*[self.column(i, kind) for i in values]))
                else:
                    for i in values:
                        out = out | x.eqNullSafe(self.column(i, kind))
                return out | x.isNull() if len(values) < len(items) else out
        raise QueryError("Expected a predicate")

    def _compare(self, node: S.Compare, loose: bool) -> Column:
        op = node.op
        kind = self.blended(node.left, node.right).kind
        a, b = self.column(node.left, kind), self.column(node.right, kind)
        if op in ("=", "<>"):
            if self.joining and kind == Kind.TEXT:
                # Empty keys meet.
                a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
                return a == b if op == "=" else a != b
            return a.eqNullSafe(b) if op == "=" else ~a.eqNullSafe(b)
        test = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if op in ("<", "<=") or self.joining:
            return test if loose else F.coalesce(test, F.lit(False))
        # > and >= are the complements of <= and <, so a null on either side makes them true; a join matches no nulls.
        return test | a.isNull() | b.isNull() if loose else F.coalesce(test, F.lit(True))

    # aggregates

    def aggregate(self, node: S.Call) -> Column:
        """An aggregate function as Spark's, over the rows of a group."""
        name, kind = node.name, self.typed(node).kind
        if node.args == (STAR,):
            return F.count(F.lit(1)).cast("double")
        arg = node.args[0]
        if name == "count":
            found = self.scope.bare_column(arg)
            x = found.bare().col if found and arg not in self.known else self.column(arg)
            return (F.count_distinct(x) if node.distinct else F.count(x)).cast("double")
        if name in ("min", "max"):
            return getattr(F, name)(self.column(arg))
        x = self.column(arg, kind if name == "sum" else Kind.FLOAT)
        if node.distinct and name not in ("sum", "avg"):
            # Spark has no distinct deviation. It follows from distinct sums: squares of one sign differ where the values do.
            n, total = F.count_distinct(x), F.sum_distinct(x)
            squares = F.coalesce(F.sum_distinct(F.when(x >= 0, x * x)), F.lit(0.0)) + F.coalesce(F.sum_distinct(F.when(x < 0, x * x)), F.lit(0.0))
            spread = F.greatest(squares - total * total / n, F.lit(0.0))
            return F.when(n > 1, F.sqrt(spread / (n if name.endswith("p") else n - 1)))
        if name == "sum":
            return F.sum_distinct(x) if node.distinct else F.sum(x)
        if name == "avg":
            return F.try_divide(F.sum_distinct(x), F.count_distinct(x)) if node.distinct else F.avg(x)
        if name.endswith("p"):
            return F.when(F.count(x) > 1, F.stddev_pop(x))
        return F.stddev_samp(x)


def sort_key(e: Expr) -> Column:
    """Nulls sort as zero or the empty text."""
    zero = {Kind.TEXT: F.lit(""), Kind.NULL: F.lit(""), Kind.DATE: F.lit("1970-01-01").cast("timestamp_ntz")}.get(e.kind, F.lit(0))
    return F.coalesce(e.col, zero)


def shown(e: Expr) -> Column:
    """A value as it leaves the engine: durations as text, the rest as Spark's own types."""
    return text_of(e) if e.kind == Kind.DURATION else e.col
