"""Names of a query: which table and column each means, what its output is called, what is equal to what.

A bound query keeps its expressions; every name in them has become ``Name(None, "#i")``, the i-th column of the joined
row (tables laid end to end, in written order).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import AmbiguousColumn, SqlError, UnknownColumn
from .syntax import Const, Expr, Name, Op, Order, Select, conjuncts


@dataclass(frozen=True)
class Column:
    name: str
    kind: str


@dataclass
class Table:
    """A table as queries see it."""

    name: str
    columns: list[Column]
    key: str | None = None  # the whole-number column that rows are ordered by
    indexes: list[tuple[str, list[str], bool]] = field(default_factory=list)

    def find(self, name: str) -> int | None:
        return next((i for i, c in enumerate(self.columns) if c.name.lower() == name.lower()), None)


class Scope:
    """The tables of a FROM clause, in order."""

    def __init__(self):
        self.tables: list[tuple[str, Table, int]] = []  # qualifier, table, its first column's place

    @property
    def width(self) -> int:
        return sum(len(t.columns) for _, t, _ in self.tables)

    def add(self, qualifier: str, table: Table) -> None:
        if any(q == qualifier.lower() for q, _, _ in self.tables):
            raise AmbiguousColumn(f"two tables are called {qualifier}")
        self.tables.append((qualifier.lower(), table, self.width))

    def resolve(self, n: Name) -> int:
        hits = [first + i for q, t, first in self.tables if n.table is None or q == n.table.lower() if (i := t.find(n.name)) is not None]
        if len(hits) > 1:
            raise AmbiguousColumn(str(n))
        if not hits:
            raise UnknownColumn(str(n))
        return hits[0]

    def bind(self, e: Expr) -> Expr:
        if isinstance(e, Name):
            return Name(None, f"#{self.resolve(e)}")
        return Op(e.op, tuple(map(self.bind, e.args))) if isinstance(e, Op) else e


def places(e: Expr) -> set[int]:
    """Columns that a bound expression reads."""
    if isinstance(e, Name):
        return {int(e.name[1:])}
    return set().union(*map(places, e.args)) if isinstance(e, Op) else set()


@dataclass
class Query:
    scope: Scope
    ons: list[Expr]  # of the second table and those after it
    where: Expr | None
    outputs: list[tuple[str, Expr]]
    order: list[Order]
    limit: int | None
    offset: int | None
    distinct: bool

    @property
    def single(self) -> Table | None:
        return self.scope.tables[0][1] if len(self.scope.tables) == 1 else None


def bind_select(s: Select, table_of) -> Query:
    """``table_of`` gives the table of a name."""
    scope, ons = Scope(), []
    for ref, on in [(s.table, None), *((j.table, j.on) for j in s.joins)]:
        scope.add(ref.alias or ref.name, table_of(ref.name))
        if on is not None:
            ons.append(scope.bind(on))  # sees the tables up to here
    if s.items is None:
        outputs = [(c.name.lower(), Name(None, f"#{first + i}")) for _, t, first in scope.tables for i, c in enumerate(t.columns)]
    else:
        outputs = [(i.alias or (i.expr.name if isinstance(i.expr, Name) else str(i.expr)), scope.bind(i.expr)) for i in s.items]
    order = []
    for o in s.order:
        if isinstance(o.expr, Const) and isinstance(o.expr.value, int) and not isinstance(o.expr.value, bool):
            if not 1 <= o.expr.value <= len(outputs):
                raise SqlError(f"ORDER BY {o.expr.value}: there are {len(outputs)} output columns", 0)
            order.append(Order(outputs[o.expr.value - 1][1], o.desc))
            continue
        try:
            order.append(Order(scope.bind(o.expr), o.desc))
        except UnknownColumn:  # an extension: an output's alias
            alias = [e for n, e in outputs if isinstance(o.expr, Name) and not o.expr.table and n.lower() == o.expr.name.lower()]
            if len(alias) != 1:
                raise
            order.append(Order(alias[0], o.desc))
    return Query(scope, ons, scope.bind(s.where) if s.where is not None else None, outputs, order, s.limit, s.offset, s.distinct)


# --- what the printed plan shows --------------------------------------------------------------------------------------

_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}


def whole_number(e: Expr) -> int | None:
    if isinstance(e, Op) and e.op == "neg" and (v := whole_number(e.args[0])) is not None:
        return -v
    return e.value if isinstance(e, Const) and type(e.value) is int else None


@dataclass
class Range:
    """Bounds of a key: (value, inclusive) on each side."""

    low: tuple[int, bool] | None = None
    high: tuple[int, bool] | None = None

    def narrow(self, sign: str, v: int) -> None:
        if sign in (">", ">=", "="):
            new = (v, sign != ">")
            if self.low is None or (v, not new[1]) > (self.low[0], not self.low[1]):
                self.low = new
        if sign in ("<", "<=", "="):
            new = (v, sign != "<")
            if self.high is None or (v, new[1]) < self.high:
                self.high = new

    def __bool__(self) -> bool:
        return self.low is not None or self.high is not None

    def __str__(self) -> str:
        if self.low == self.high and self.low and self.low[1]:
            return f"= {self.low[0]}"
        left = "unbounded" if self.low is None else f">{'=' * self.low[1]} {self.low[0]}"
        right = "unbounded" if self.high is None else f"<{'=' * self.high[1]} {self.high[0]}"
        return f"{left}, {right}"


def key_range(where: Expr | None, key: int | None) -> tuple[Range, list[Expr]]:
    """Bounds of the key that the conjuncts of ``where`` set, and the conjuncts that set none."""
    found, rest = Range(), []
    for c in conjuncts(where):
        if key is not None and isinstance(c, Op) and places(c) == {key}:
            a = c.args
            mine = lambda e: isinstance(e, Name)
            if c.op in _FLIP and mine(a[0]) and (v := whole_number(a[1])) is not None:
                found.narrow(c.op, v)
                continue
            if c.op in _FLIP and mine(a[1]) and (v := whole_number(a[0])) is not None:
                found.narrow(_FLIP[c.op], v)
                continue
            if c.op == "BETWEEN" and mine(a[0]) and None not in (low := whole_number(a[1]), high := whole_number(a[2])):
                found.narrow(">=", low)
                found.narrow("<=", high)
                continue
        rest.append(c)
    return found, rest


def equal_sides(on: Expr, border: int) -> tuple[tuple[Expr, Expr] | None, list[Expr]]:
    """The first equality of ``on`` whose sides read only what lies left and right of ``border``; the other conjuncts."""
    parts = conjuncts(on)
    for i, c in enumerate(parts):
        if isinstance(c, Op) and c.op == "=":
            a, b = map(places, c.args)
            if a and b and (max(a) < border <= min(b) or max(b) < border <= min(a)):
                left, right = c.args if max(a) < border else c.args[::-1]
                return (left, right), parts[:i] + parts[i + 1 :]
    return None, parts


def joined(parts: list[Expr]) -> Expr | None:
    out = None
    for p in parts:
        out = p if out is None else Op("AND", (out, p))
    return out
