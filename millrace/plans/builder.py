"""From a query's tree to a DataFrame, clause by clause. What runs where is left to Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.convert import Expr, convert
from ..language import syntax as S
from ..operators import joins
from ..operators.ordinals import number_rows
from ..sources.catalog import Catalog, merged
from ..sources.table import Field
from . import types as T
from .expressions import Compiler, shown, sort_key
from .scope import AGGREGATES, Scope
from .types import Kind, Typed

INC = "_inc"


@dataclass
class Plan:
    df: DataFrame
    names: list[str]
    kinds: list[Kind]
    #: Whether a CSV of the result has a header unless told otherwise.
    header: bool


@dataclass
class Output:
    """One column of the result: a node, or a field that * stands for."""

    node: S.Node | None
    field: Field | None
    typed: Typed
    name: str
    #: Whether the name comes from the query or a header, not from the place.
    named: bool
    #: In a subquery, the kind that the set takes.
    force: Kind | None = None

    def value(self, compiler: Compiler) -> Expr:
        if self.node is not None:
            return compiler.bare(self.node) if self.force is None else compiler.value(self.node, self.force)
        own = compiler.known.get(self.key) or self.field.bare()
        return own if self.force is None else convert(own, self.force)

    @property
    def key(self) -> S.Node:
        """Stands for the field among known nodes; no word of a query has a blank."""
        return S.Word(f"* {self.field.column}")


def scope_of(query: S.Query, catalog: Catalog) -> Scope:
    tables = [catalog.open(t.path, merged(query.options, t.options), t.alias, i, False) for i, t in enumerate(query.tables)]
    names = [n for t in query.tables if (n := t.alias)]
    if len(set(names)) < len(names):
        raise QueryError("Two files have the same alias")
    variables = dict(query.variables)
    used = _words(query)
    for item in query.items:
        if item.alias is None:
            continue
        if item.alias in dict(query.variables):
            raise QueryError(f"Alias '{item.alias}' defined more than once")
        # An alias of a selection that is used elsewhere is a variable.
        if item.alias in used and item.alias not in variables and item.expr != S.Word(item.alias):
            variables[item.alias] = item.expr
    return Scope(tables, variables, "C" in query.options)


def _words(query: S.Query) -> set[str]:
    """The words of all clauses."""
    roots = [i.expr for i in query.items] + [k.expr for k in query.order] + [n for n in (query.where, query.having) if n is not None] + list(query.group)
    return {x.text for r in roots for x in S.walk(r) if isinstance(x, S.Word)}


class Builder:
    def __init__(self, catalog: Catalog, password: str | None = None):
        self.catalog, self.password = catalog, password
        self.subqueries = 0

    def build(self, query: S.Query, meet: Callable[[list[Typed]], Kind] | None = None) -> Plan:
        """meet: for a subquery, the kind that all its columns take, from their own."""
        scope = scope_of(query, self.catalog)
        compiler = Compiler(scope, "NAN" in query.options, self.password)
        outputs = self._outputs(query, scope, compiler)
        kind = meet([o.typed for o in outputs]) if meet else None
        self._check(query, scope)
        for o in outputs:
            o.force = kind
        grouped = bool(query.group) or any(scope.aggregated(i.expr) for i in query.items) or any(scope.aggregated(k.expr) for k in query.order) or query.having is not None
        files = all(f.raw for t in scope.tables for f in t.fields)
        # Files have an order, which shows where the first rows are kept.
        cut = query.distinct or query.rows > 0 and (bool(query.joins) or any(t.place for t in scope.tables))
        if grouped and self._needs_order(query, scope) or not grouped and cut and not query.order and files and meet is None:
            for t in scope.tables:
                t.number()
        df = self._joined(query, scope)
        if query.where is not None:
            df, compiler = self._numbered(df, compiler, query.where, scanned=not query.joins)
            df = self._filtered(df, query.where, compiler)
        if grouped:
            df, columns = self._grouped(query, scope, compiler, df, outputs)
        else:
            df, columns = self._plain(query, compiler, df, outputs)
        header = any(o.named for o in outputs) or any(t.named for t in scope.tables)
        if query.options & {"OH", "NOH"}:
            header = "OH" in query.options
        out = df.select(*[c.alias(f"o{i}") for i, c in enumerate(columns)])
        return Plan(out.toDF(*[o.name for o in outputs]), [o.name for o in outputs], [kind or o.typed.kind for o in outputs], header)

    # what the result holds

    def _outputs(self, query: S.Query, scope: Scope, compiler: Compiler) -> list[Output]:
        out: list[Output] = []

        def add(node, field, typed, name):
            out.append(Output(node, field, typed, name or f"col{len(out) + 1}", name is not None))

        for item in query.items:
            node, name = item.expr, item.alias
            if isinstance(node, S.Star):
                for t in scope.tables:
                    for f in t.fields:
                        add(None, f, Typed(f.kind), f.name if t.named else None)
                continue
            if name is None and isinstance(node, S.Word):
                found = scope.column(node)
                if scope.variable(node) is not None:
                    name = node.text
                elif found and found[0].named:
                    name = found[1].name
            add(node, None, compiler.typed(node), name)
        return out

    def _check(self, query: S.Query, scope: Scope) -> None:
        for node, where in [(query.where, "where"), *[(j.on, "join") for j in query.joins], *[(g, "group by") for g in query.group]]:
            if node is not None and scope.aggregated(node):
                raise QueryError(f"Cannot use aggregate functions in {where}")

    def _needs_order(self, query: S.Query, scope: Scope) -> bool:
        """Whether some selection is the first or last of its group: a column outside aggregates and keys."""

        def loose(node: S.Node) -> bool:
            if node in query.group or isinstance(node, S.Call) and node.name in AGGREGATES:
                return False
            if isinstance(node, S.Word):
                inner = scope.variable(node)
                return loose(inner) if inner is not None else scope.column(node) is not None
            return isinstance(node, S.Star) or any(map(loose, S.children(node)))

        nodes = [i.expr for i in query.items] + [k.expr for k in query.order] + ([query.having] if query.having is not None else [])
        return any(map(loose, nodes))

    # rows

    def _joined(self, query: S.Query, scope: Scope) -> DataFrame:
        df = scope.tables[0].df
        for i, j in enumerate(query.joins, 1):
            part = Scope(scope.tables[: i + 1], scope.variables, scope.numbers_are_columns)
            compiler = Compiler(part, "NAN" in query.options, self.password, joining=True)
            self._check_join(j.on, part, i)

            def keyed(node, compiler=compiler, part=part, i=i):
                sides = [part.tables_of(x) for x in (node.left, node.right)] if isinstance(node, S.Compare) and node.op == "=" else []
                return len(sides) == 2 and {i} in sides and all(sides)

            band = lambda node, compiler=compiler, i=i: self._band(node, compiler, i)
            df = joins.join(df, scope.tables[i].df, j.on, j.kind, compiler.predicate, keyed, band)
        return df

    def _band(self, node: S.Node, compiler: Compiler, i: int) -> joins.Band | None:
        """What an AND chain bounds from both sides, if it does."""
        chain, bounds = [node], {}
        while chain:
            n = chain.pop()
            if isinstance(n, S.Logic):
                if n.op != "and":
                    return None
                chain += [n.left, n.right]
            elif isinstance(n, S.Compare) and n.op in ("<", "<=", ">", ">="):
                small, large = (n.left, n.right) if n.op[0] == "<" else (n.right, n.left)
                bounds.setdefault(large, {}).setdefault("low", small)
                bounds.setdefault(small, {}).setdefault("high", large)
            elif isinstance(n, S.Between) and not n.negated:
                # The bounds may come in either order.
                continue
        for point, b in bounds.items():
            if len(b) < 2:
                continue
            nodes = (point, b["low"], b["high"])
            kinds = {compiler.blended(point, x).kind for x in nodes[1:]}
            sides = [compiler.scope.tables_of(x) for x in nodes]
            of_left = i not in sides[0] and bool(sides[0])
            if len(kinds) == 1 and (kind := kinds.pop()) in (Kind.INT, Kind.FLOAT, Kind.DATE) and all((s == {i}) if of_left else (s and i not in s) for s in sides[1:]) and (of_left or sides[0] == {i}):
                return joins.Band(*[compiler.column(x, kind) for x in nodes], kind == Kind.DATE, of_left)
        return None

    def _check_join(self, node: S.Node, scope: Scope, i: int) -> None:
        """A comparison has the joined file on one side only, and earlier files or literals on the other."""
        if isinstance(node, (S.Logic, S.Not)):
            for x in S.children(node):
                self._check_join(x, scope, i)
            return
        if isinstance(node, S.InQuery):
            raise QueryError("A join condition cannot hold a subquery")
        sides = [scope.tables_of(x) for x in S.children(node)]
        if any(i in s and len(s) > 1 for s in sides):
            raise QueryError("One side of a join condition must be the joined file and only the joined file")
        if isinstance(node, S.Compare) and all(s == sides[0] for s in sides) and sides[0]:
            raise QueryError("Join condition cannot have the same file on both sides")
        if not any(i in s for s in sides):
            raise QueryError("A join condition must use the joined file")

    def _numbered(self, df: DataFrame, compiler: Compiler, *nodes: S.Node, scanned: bool = False) -> tuple[DataFrame, Compiler]:
        """Row numbers for the calls of inc() in the nodes. scanned: rows stand as the scan of the one table has read them."""
        calls = {x for n in nodes for x in compiler.scope.expanded(n) if isinstance(x, S.Call) and x.name == "inc" and x not in compiler.known}
        if not calls:
            return df, compiler
        column = f"{INC}{len(compiler.known)}"
        return number_rows(df, column, compiler.scope.tables[0].place if scanned else None), compiler.with_known({c: Expr(Kind.FLOAT, F.col(column)) for c in calls})

    def _filtered(self, df: DataFrame, node: S.Node, compiler: Compiler) -> DataFrame:
        """Rows that meet a predicate. An IN-subquery that all rows must pass is a semi or anti join; others mark their rows first."""
        plain: list[S.Node] = []
        pending = [node]
        while pending:
            n = pending.pop(0)
            if isinstance(n, S.Logic) and n.op == "and":
                pending = [n.left, n.right, *pending]
            elif isinstance(n, S.InQuery):
                df = self._in_query(df, n, compiler, "left_semi")
            elif isinstance(n, S.Not) and isinstance(n.of, S.InQuery):
                df = self._in_query(df, n.of, compiler, "left_anti")
            else:
                plain.append(n)
        for n in plain:
            marks: dict[S.Node, Expr] = {}
            for x in S.walk(n):
                if isinstance(x, S.InQuery) and x not in marks:
                    df = self._in_query(df, x, compiler, "left")
                    marks[x] = Expr(Kind.NULL, F.col(f"_in{self.subqueries}").isNotNull())
            df = df.where((compiler.with_known(marks) if marks else compiler).predicate(n, loose=True))
        return df

    def _in_query(self, df: DataFrame, node: S.InQuery, compiler: Compiler, how: str) -> DataFrame:
        """The set holds the values of all columns of the subquery. Empty text meets null text; a null number meets nothing."""
        own = compiler.typed(node.of)

        def meet(typed: list[Typed]) -> Kind:
            for t in typed:
                if t.kind == Kind.NULL:
                    raise QueryError("Subquery has null datatype")
            kind = own
            for t in typed:
                kind = T.blend(kind, t)
            return kind.kind

        query = node.query if node.query.limit is None and not node.query.top else S.Query(**{**node.query.__dict__, "top": 0, "limit": None})
        plan = self.build(query, meet)
        kind = plan.kinds[0]
        self.subqueries += 1
        key, mark = f"_key{self.subqueries}", f"_in{self.subqueries}"
        columns = plan.df.toDF(*[f"s{i}" for i in range(len(plan.names))])
        blank = (lambda c: F.coalesce(c, F.lit(""))) if kind == Kind.TEXT else (lambda c: c)
        values = columns.select(blank(F.col("s0")).alias(key))
        for i in range(1, len(plan.names)):
            values = values.unionByName(columns.select(blank(F.col(f"s{i}")).alias(key)))
        condition = blank(compiler.column(node.of, kind)) == F.col(key)
        if how == "left":
            return df.join(values.where(F.col(key).isNotNull()).distinct().withColumn(mark, F.lit(True)), condition, "left")
        return df.join(values, condition, how)

    # one row of the result for each row

    def _plain(self, query: S.Query, compiler: Compiler, df: DataFrame, outputs: list[Output]) -> tuple[DataFrame, list[Column]]:
        nodes = [o.node for o in outputs if o.node is not None]
        if not query.order:
            df, compiler = self._numbered(df, compiler, *nodes, scanned=_scanned(query))
            columns = [shown(o.value(compiler)) for o in outputs]
            if query.distinct:
                names = [f"d{i}" for i in range(len(columns))]
                ordinals = [F.col(t.ordinal) for t in compiler.scope.tables if t.ordinal in df.columns]
                df = df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], *ordinals)
                columns = [F.col(n) for n in names]
                # The first of equal rows stays, where rows have an order: those of files do, those of typed tables don't.
                df = df.groupBy(*names).agg(F.min(F.struct(*ordinals)).alias("_ord")).orderBy("_ord") if ordinals else df.distinct()
            elif query.rows and (ordinals := [F.col(t.ordinal) for t in compiler.scope.tables if t.ordinal in df.columns]):
                df = df.orderBy(*ordinals)
            return (df.limit(query.rows) if query.rows else df), columns
        keys = [k.expr for k in query.order]
        df, compiler = self._numbered(df, compiler, *keys, scanned=_scanned(query))
        counted = [n for n in nodes if compiler.scope.calls_inc(n)]
        if counted and not query.distinct:
            # Rows are counted in the order in which they leave.
            df = df.orderBy(*self._directed(query, [sort_key(compiler.value(k)) for k in keys]))
            df, compiler = self._numbered(df, compiler, *counted)
        columns = [shown(o.value(compiler)).alias(f"d{i}") for i, o in enumerate(outputs)]
        df = df.select(*columns, *[sort_key(compiler.value(k)).alias(f"k{i}") for i, k in enumerate(keys)])
        by = self._directed(query, [F.col(f"k{i}") for i in range(len(keys))])
        names = [f"d{i}" for i in range(len(outputs))]
        if query.distinct:
            # Of equal rows the first in order stays.
            rank = F.row_number().over(W.partitionBy(*names).orderBy(*by))
            df = df.withColumn("_rank", rank).where("_rank = 1")
        df = df.orderBy(*by)
        return (df.limit(query.rows) if query.rows else df), [F.col(n) for n in names]

    def _directed(self, query: S.Query, keys: list[Column]) -> list[Column]:
        return [k.desc() if o.descending else k.asc() for k, o in zip(keys, query.order, strict=True)]

    # one row of the result for each group

    def _grouped(self, query: S.Query, scope: Scope, compiler: Compiler, df: DataFrame, outputs: list[Output]) -> tuple[DataFrame, list[Column]]:
        asked = [o.node for o in outputs if o.node is not None] + [k.expr for k in query.order] + ([query.having] if query.having is not None else [])
        df, compiler = self._numbered(df, compiler, *query.group, *asked, scanned=_scanned(query))
        keys = [compiler.value(g) for g in query.group]
        known: dict[S.Node, Expr] = {}
        made: list[Column] = []
        for i, (g, e) in enumerate(zip(query.group, keys, strict=True)):
            years = F.col(f"g{i}y") if e.years is not None else None
            known[g] = Expr(e.kind, F.col(f"g{i}"), years)
            inner = scope.variable(g) if isinstance(g, S.Word) else None
            if inner is not None:
                known.setdefault(inner, known[g])
        grouping = dict(known)
        order = F.struct(*[F.col(t.ordinal) for t in scope.tables])

        def make(column: Column) -> Column:
            made.append(column.alias(f"a{len(made)}"))
            return F.col(f"a{len(made) - 1}")

        def kept(e: Expr, pick: Callable[[Column], Column]) -> Expr:
            return Expr(e.kind, make(pick(e.col)), None if e.years is None else make(pick(e.years)))

        def first(e: Expr) -> Expr:
            return kept(e, lambda c: F.min_by(c, F.when(e.col.isNotNull(), order)))

        def last(e: Expr) -> Expr:
            return kept(e, lambda c: F.max_by(c, order))

        def prepare(node: S.Node) -> None:
            """Puts into `known` what the node needs from the rows of the group."""
            if node in known:
                return
            if isinstance(node, S.Call) and node.name in AGGREGATES:
                known[node] = Expr(compiler.typed(node).kind, make(compiler.aggregate(node)))
                return
            if isinstance(node, S.Word):
                inner = scope.variable(node)
                if inner is not None and scope.aggregated(inner):
                    prepare(inner)
                elif inner is not None:
                    known[node] = known.get(inner) or first(compiler.bare(node))
                elif scope.column(node):
                    known[node] = first(compiler.bare(node))
                return
            if not isinstance(node, (S.Logic, S.Not, S.Compare, S.Between, S.Like, S.InList, S.InQuery)) and not scope.aggregated(node):
                # A column that is selected on its own as well, and so is known, still makes this the last row's.
                direct = {x for x in _outside(node, grouping) if isinstance(x, S.Word) and scope.variable(x) is None and scope.column(x)}
                if direct:
                    known[node] = last(compiler.value(node))
                    return
            elif any(isinstance(x, S.Word) and scope.variable(x) is None and scope.column(x) and x not in known for x in S.children(node)):
                raise QueryError("Cannot mix a column and an aggregate function in one expression")
            for x in S.children(node):
                prepare(x)

        if query.having is not None and not self._phase_two(query.having, scope):
            raise QueryError("Having clause must use aggregates or variables")
        for node in asked:
            prepare(node)
        for o in outputs:
            if o.node is None:
                known.setdefault(o.key, first(o.field.bare()))
        group = [e.col.alias(f"g{i}") for i, e in enumerate(keys)] + [e.years.alias(f"g{i}y") for i, e in enumerate(keys) if e.years is not None]
        made = made or [F.count(F.lit(1)).alias("a0")]
        out = df.groupBy(*group).agg(*made) if group else df.agg(*made)
        after = Compiler(scope, compiler.nan, self.password, known=known)
        columns = [shown(o.value(after)).alias(f"d{i}") for i, o in enumerate(outputs)]
        if not group:
            # One row, whatever having, distinct, order and limit say.
            return out, columns
        if query.having is not None:
            out = self._filtered(out, query.having, after)
        sort = [sort_key(after.value(k.expr)) for k in query.order]
        names = [f"d{i}" for i in range(len(columns))]
        out = out.select(*columns, *[c.alias(f"b{i}") for i, c in enumerate(sort)], *[F.col(f"g{i}") for i in range(len(keys))])
        # Groups that the order leaves equal, or all without one, come by their keys.
        by = [*self._directed(query, [F.col(f"b{i}") for i in range(len(sort))]), *[F.col(f"g{i}").asc_nulls_first() for i in range(len(keys))]]
        if query.distinct:
            rank = F.row_number().over(W.partitionBy(*names).orderBy(*by))
            out = out.withColumn("_rank", rank).where("_rank = 1")
        out = out.orderBy(*by)
        return (out.limit(query.rows) if query.rows else out), [F.col(n) for n in names]

    def _phase_two(self, node: S.Node, scope: Scope) -> bool:
        """Whether a predicate rests on aggregates or variables, not on columns of single rows."""
        if isinstance(node, S.Call) and node.name in AGGREGATES:
            return True
        if isinstance(node, S.Word):
            return scope.variable(node) is not None or scope.column(node) is None
        return all(self._phase_two(x, scope) for x in S.children(node))


def _scanned(query: S.Query) -> bool:
    """Whether no join has dealt the rows anew, an IN-subquery's either."""
    return not query.joins and not any(isinstance(x, S.InQuery) for x in (S.walk(query.where) if query.where is not None else ()))


def _outside(node: S.Node, known: dict):
    """Nodes of an expression, those below a known one left out."""
    if node in known:
        return
    yield node
    for x in S.children(node):
        yield from _outside(x, known)
