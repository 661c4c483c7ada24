"""Syntax trees. Nodes are frozen, so equal expressions compare equal: grouping keys are recognised by that."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    """Any expression or predicate."""


@dataclass(frozen=True)
class Word(Node):
    """A column, variable or literal; which of them is for the binder to say."""

    text: str
    quoted: bool = False


@dataclass(frozen=True)
class Star(Node):
    """All columns, in a selection or as the argument of count."""


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Negative(Node):
    of: Node


@dataclass(frozen=True)
class Case(Node):
    """`subject` is None where each branch begins with a predicate."""

    subject: Node | None
    branches: tuple[tuple[Node, Node], ...]
    default: Node | None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False
    #: Tells the calls of inc() apart: each has a counter of its own.
    site: int = 0


@dataclass(frozen=True)
class Compare(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Between(Node):
    of: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class Like(Node):
    of: Node
    pattern: str
    is_null: bool = False


@dataclass(frozen=True)
class InList(Node):
    of: Node
    items: tuple[Node, ...]


@dataclass(frozen=True)
class InQuery(Node):
    of: Node
    query: Query


@dataclass(frozen=True)
class Logic(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    of: Node


@dataclass(frozen=True)
class Item:
    """One selection."""

    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class OrderKey:
    expr: Node
    descending: bool = False


@dataclass(frozen=True)
class Table:
    path: str
    quoted: bool
    options: frozenset[str]
    alias: str | None


@dataclass(frozen=True)
class Join:
    kind: str
    table: Table
    on: Node


@dataclass(frozen=True)
class Query(Node):
    options: frozenset[str]
    variables: tuple[tuple[str, Node], ...]
    top: int
    distinct: bool
    items: tuple[Item, ...]
    tables: tuple[Table, ...]
    joins: tuple[Join, ...]
    where: Node | None = None
    group: tuple[Node, ...] = field(default=())
    having: Node | None = None
    order: tuple[OrderKey, ...] = field(default=())
    limit: int | None = None

    @property
    def rows(self) -> int:
        """Most rows to return; 0 for all. A limit overrides top."""
        return self.top if self.limit is None else self.limit


@dataclass(frozen=True)
class Catalogue:
    """`add NAME path [options]`, `drop NAME` or `show tables`."""

    action: str
    name: str = ""
    path: str = ""
    options: frozenset[str] = frozenset()


#: Functions whose arguments after the first are plain text or numbers, not expressions.
PARAMETERS = frozenset(("format", "substr", "round", "ceil", "floor", "encrypt", "decrypt"))


def children(node: Node) -> tuple[Node, ...]:
    """The expressions directly below a node; not those of a subquery."""
    match node:
        case Binary(_, a, b) | Compare(_, a, b) | Logic(_, a, b):
            return a, b
        case Negative(a) | Not(a) | InQuery(a, _) | Like(a, _, _):
            return (a,)
        case Case(subject, branches, default):
            return tuple(x for x in (subject, *[y for b in branches for y in b], default) if x is not None)
        case Call(name, args):
            return args[:1] if name in PARAMETERS else args
        case Between(a, b, c):
            return a, b, c
        case InList(a, items):
            return a, *items
    return ()


def walk(node: Node):
    yield node
    for x in children(node):
        yield from walk(x)
