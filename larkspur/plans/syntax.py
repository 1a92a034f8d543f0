"""The dialect's text: tokens, statements, and their rendering.

``parse`` reads one statement, ``parse_many`` several (``;`` between them may be left out).  Rendering a statement and
parsing it again gives an equal statement.  Errors name the byte at which reading failed.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import NamedTuple

from ..errors import SqlError

#: The dialect's reserved words.
RESERVED = frozenset(
    "ALL AND AS ASC BEGIN BETWEEN BLOB BOOLEAN BY COMMIT CREATE DEFAULT DELETE DESC DISTINCT EXISTS EXPLAIN FALSE FROM IF INDEX INNER INSERT INTEGER INTO IS JOIN KEY LIKE "
    "LIMIT NOT NULL OFFSET ON OR ORDER PRIMARY REAL ROLLBACK SELECT SET TABLE TEXT TRUE UNIQUE UPDATE VACUUM VALUES WHERE".split()
)
KINDS = ("INTEGER", "REAL", "TEXT", "BLOB", "BOOLEAN")
#: Parts of type names and the kind that each implies, the first that occurs.
AFFINITY = (("INT", "INTEGER"), ("CHAR", "TEXT"), ("CLOB", "TEXT"), ("TEXT", "TEXT"), ("BLOB", "BLOB"), ("REAL", "REAL"), ("FLOA", "REAL"), ("DOUB", "REAL"))

_TOKEN = re.compile(
    r"""(?P<skip>[ \t\n\r\f]+|--[^\n]*|/\*.*?\*/)
      |(?P<text>'(?:[^']|'')*')
      |(?P<number>[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)
      |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
      |(?P<mark><=|>=|<>|!=|[-+*/%=<>(),.;])""",
    re.X | re.S,
)


class Token(NamedTuple):
    kind: str  # text, int, real, name, word (reserved), mark, end
    value: object
    at: int  # byte


def tokenize(sql: str) -> list[Token]:
    out, at, byte = [], 0, 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError("unterminated string" if sql[at] == "'" else f"unexpected character {sql[at]!r}", byte)
        kind, raw = m.lastgroup, m[0]
        if raw == "/" and sql.startswith("/*", at):
            raise SqlError("unterminated block comment", byte)
        if kind == "text":
            out.append(Token("text", raw[1:-1].replace("''", "'"), byte))
        elif kind == "number":
            out.append(_number(raw, byte))
        elif kind == "word":
            upper = raw.upper()
            out.append(Token("word", upper, byte) if upper in RESERVED else Token("name", raw, byte))
        elif kind == "mark":
            out.append(Token("mark", "<>" if raw == "!=" else raw, byte))
        at, byte = m.end(), byte + len(raw.encode())
    return [*out, Token("end", None, byte)]


def _number(raw: str, at: int) -> Token:
    if raw.isdigit():
        if int(raw) >= 2**63:
            raise SqlError(f"{raw} does not fit in 64 bits", at)
        return Token("int", int(raw), at)
    if not math.isfinite(float(raw)):
        raise SqlError(f"{raw} is out of range", at)
    return Token("real", float(raw), at)


# --- expressions ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object  # None, bool, int, float, str

    def __str__(self) -> str:
        v = self.value
        if v is None or isinstance(v, bool):
            return {None: "NULL", True: "TRUE", False: "FALSE"}[v]
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    def __eq__(self, other) -> bool:  # 1, 1.0 and TRUE are different constants
        return isinstance(other, Const) and type(self.value) is type(other.value) and self.value == other.value

    def __hash__(self) -> int:
        return hash((type(self.value), self.value))


@dataclass(frozen=True)
class Name:
    table: str | None
    name: str

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Op:
    """``op`` is neg, NOT, a binary sign, AND, OR, or [NOT] LIKE, [NOT] BETWEEN, IS [NOT] NULL."""

    op: str
    args: tuple

    def __str__(self) -> str:
        a = [str(x) for x in self.args]
        if self.op == "neg":
            return f"(-{a[0]})"
        if self.op == "NOT":
            return f"(NOT {a[0]})"
        if len(a) == 1:
            return f"({a[0]} {self.op})"
        return f"({a[0]} {self.op} {a[1]} AND {a[2]})" if len(a) == 3 else f"({a[0]} {self.op} {a[1]})"


Expr = Const | Name | Op


def conjuncts(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    return [c for a in e.args for c in conjuncts(a)] if isinstance(e, Op) and e.op == "AND" else [e]


# --- statements -----------------------------------------------------------------------------------------------------


def _list(items) -> str:
    return ", ".join(map(str, items))


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None

    def __str__(self) -> str:
        return f"{self.name} AS {self.alias}" if self.alias else self.name


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None

    def __str__(self) -> str:
        return f"{self.expr} AS {self.alias}" if self.alias else str(self.expr)


@dataclass(frozen=True)
class Join:
    table: TableRef
    on: Expr


@dataclass(frozen=True)
class Order:
    expr: Expr
    desc: bool = False

    def __str__(self) -> str:
        return f"{self.expr} {'DESC' if self.desc else 'ASC'}"


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] | None  # None: *
    table: TableRef
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False

    def __str__(self) -> str:
        out = f"SELECT {'DISTINCT ' * self.distinct}{'*' if self.items is None else _list(self.items)} FROM {self.table}"
        out += "".join(f" JOIN {j.table} ON {j.on}" for j in self.joins)
        out += f" WHERE {self.where}" if self.where is not None else ""
        out += f" ORDER BY {_list(self.order)}" if self.order else ""
        out += f" LIMIT {self.limit}" if self.limit is not None else ""
        return out + (f" OFFSET {self.offset}" if self.offset is not None else "")


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr, ...], ...]

    def __str__(self) -> str:
        return f"INSERT INTO {self.table}{f' ({_list(self.columns)})' if self.columns else ''} VALUES {_list(f'({_list(r)})' for r in self.rows)}"


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None = None

    def __str__(self) -> str:
        return f"UPDATE {self.table} SET {_list(f'{c} = {e}' for c, e in self.sets)}" + (f" WHERE {self.where}" if self.where is not None else "")


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None

    def __str__(self) -> str:
        return f"DELETE FROM {self.table}" + (f" WHERE {self.where}" if self.where is not None else "")


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: str
    constraints: tuple[tuple[str, object], ...] = field(default=())  # PRIMARY KEY, NOT NULL, UNIQUE, DEFAULT

    def __str__(self) -> str:
        return " ".join([self.name, self.kind, *(f"{c} {v}" if c == "DEFAULT" else c for c, v in self.constraints)])


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    if_not_exists: bool = False

    def __str__(self) -> str:
        return f"CREATE TABLE {'IF NOT EXISTS ' * self.if_not_exists}{self.name} ({_list(self.columns)})"


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False

    def __str__(self) -> str:
        return f"CREATE {'UNIQUE ' * self.unique}INDEX {self.name} ON {self.table} ({_list(self.columns)})"


@dataclass(frozen=True)
class Vacuum:
    table: str | None = None

    def __str__(self) -> str:
        return "VACUUM" + (f" {self.table}" if self.table else "")


@dataclass(frozen=True)
class Control:
    verb: str  # BEGIN, COMMIT, ROLLBACK

    def __str__(self) -> str:
        return self.verb


@dataclass(frozen=True)
class Explain:
    statement: object

    def __str__(self) -> str:
        return f"EXPLAIN {self.statement}"


# --- the parser -----------------------------------------------------------------------------------------------------

#: Binding powers of infix operators; comparisons and their like bind once, the others from left to right.
_POWER = {"OR": 1, "AND": 2, **dict.fromkeys(("=", "<>", "<", "<=", ">", ">=", "IS", "LIKE", "BETWEEN", "NOT"), 4), "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
_NOT, _COMPARE, _SIGN = 3, 4, 7
#: Nested parentheses and prefix operators beyond this are refused instead of exhausting the stack.
DEPTH = 200


class _Reader:
    def __init__(self, sql: str):
        self.tokens, self.i, self.depth = tokenize(sql), 0, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, wanted: str):
        t = self.now
        raise SqlError(f"expected {wanted}, found {'the end' if t.kind == 'end' else repr(t.value)}", t.at)

    def sees(self, *values: str) -> bool:
        return self.now.kind in ("word", "mark") and self.now.value in values

    def eat(self, *values: str) -> bool:
        """All of these in turn, or none."""
        for k, v in enumerate(values):
            t = self.tokens[min(self.i + k, len(self.tokens) - 1)]
            if t.kind not in ("word", "mark") or t.value != v:
                return False
        self.i += len(values)
        return True

    def need(self, *values: str) -> None:
        for v in values:
            if not self.eat(v):
                self.fail(v)

    def take(self, kind: str, wanted: str):
        if self.now.kind != kind:
            self.fail(wanted)
        self.i += 1
        return self.tokens[self.i - 1].value

    def name(self) -> str:
        return self.take("name", "a name")

    def listed(self, one) -> tuple:
        out = [one()]
        while self.eat(","):
            out.append(one())
        return tuple(out)

    def bracketed(self, one) -> tuple:
        self.need("(")
        out = self.listed(one)
        self.need(")")
        return out

    # expressions by binding power

    def expr(self, least: int = 0) -> Expr:
        self.depth += 1
        if self.depth > DEPTH:
            raise SqlError("the expression is nested too deeply", self.now.at)
        left = self.prefix()
        bound = False  # a comparison stands only once on its level
        while self.now.kind in ("word", "mark") and (power := _POWER.get(self.now.value, 0)) > least:
            if power == _COMPARE and bound:
                break
            word = self.now.value
            if word == "NOT" and not (self.tokens[self.i + 1].kind == "word" and self.tokens[self.i + 1].value in ("LIKE", "BETWEEN")):
                break
            self.i += 1
            if power != _COMPARE:
                left = Op(word, (left, self.expr(power)))
            else:
                left = self.compared(left, word)
                bound = True
        self.depth -= 1
        return left

    def compared(self, left: Expr, word: str) -> Expr:
        if word == "IS":
            no = "NOT " if self.eat("NOT") else ""
            self.need("NULL")
            return Op(f"IS {no}NULL", (left,))
        no = ""
        if word == "NOT":
            no, word = "NOT ", self.now.value
            self.i += 1
        if word == "BETWEEN":
            low = self.expr(_COMPARE)
            self.need("AND")
            return Op(f"{no}BETWEEN", (left, low, self.expr(_COMPARE)))
        return Op(no + word, (left, self.expr(_COMPARE)))

    def prefix(self) -> Expr:
        if self.eat("NOT"):
            return Op("NOT", (self.expr(_NOT - 1),))
        if self.eat("-"):
            return Op("neg", (self.expr(_SIGN),))
        if self.eat("+"):
            return self.expr(_SIGN)
        if self.eat("("):
            inner = self.expr()
            self.need(")")
            return inner
        if self.now.kind == "name":
            first = self.name()
            return Name(first, self.name()) if self.eat(".") else Name(None, first)
        return self.constant("an expression")

    def constant(self, wanted: str = "a value") -> Const:
        for word, value in (("NULL", None), ("TRUE", True), ("FALSE", False)):
            if self.eat(word):
                return Const(value)
        if self.now.kind in ("int", "real", "text"):
            self.i += 1
            return Const(self.tokens[self.i - 1].value)
        return self.fail(wanted)

    # statements

    def statement(self):
        t = self.now
        verbs = {"SELECT": self.select, "INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete, "CREATE": self.create}
        if t.kind != "word":
            self.fail("a statement")
        if t.value in ("BEGIN", "COMMIT", "ROLLBACK"):
            self.i += 1
            return Control(t.value)
        if t.value == "VACUUM":
            self.i += 1
            return Vacuum(self.name() if self.now.kind == "name" else None)
        if t.value == "EXPLAIN":
            self.i += 1
            if self.sees("EXPLAIN"):
                self.fail("a statement that can be explained")
            return Explain(self.statement())
        if t.value not in verbs:
            self.fail("a statement")
        self.i += 1
        return verbs[t.value]()

    def alias(self) -> str | None:
        return self.name() if self.eat("AS") or self.now.kind == "name" else None

    def table(self) -> TableRef:
        return TableRef(self.name(), self.alias())

    def count(self) -> int:
        return self.take("int", "a row count")

    def select(self) -> Select:
        distinct = self.eat("DISTINCT") or (self.eat("ALL") and False)
        items = None if self.eat("*") else self.listed(lambda: Item(self.expr(), self.alias()))
        self.need("FROM")
        table, joins = self.table(), []
        while self.sees("JOIN", "INNER"):
            self.eat("INNER")
            self.need("JOIN")
            other = self.table()
            self.need("ON")
            joins.append(Join(other, self.expr()))
        where = self.expr() if self.eat("WHERE") else None
        order: tuple = ()
        if self.eat("ORDER"):
            self.need("BY")
            order = self.listed(self.order)
        limit = self.count() if self.eat("LIMIT") else None
        offset = self.count() if self.eat("OFFSET") else None
        return Select(items, table, tuple(joins), where, order, limit, offset, distinct)

    def order(self) -> Order:
        e = self.expr()
        return Order(e, True) if self.eat("DESC") else Order(e, self.eat("ASC") and False)

    def insert(self) -> Insert:
        self.need("INTO")
        table = self.name()
        columns = self.bracketed(self.name) if self.sees("(") else ()
        self.need("VALUES")
        return Insert(table, columns, self.listed(lambda: self.bracketed(self.expr)))

    def update(self) -> Update:
        table = self.name()
        self.need("SET")

        def one():
            column = self.name()
            self.need("=")
            return column, self.expr()

        return Update(table, self.listed(one), self.expr() if self.eat("WHERE") else None)

    def delete(self) -> Delete:
        self.need("FROM")
        return Delete(self.name(), self.expr() if self.eat("WHERE") else None)

    def create(self):
        if self.eat("TABLE"):
            maybe = self.eat("IF", "NOT", "EXISTS")
            return CreateTable(self.name(), self.bracketed(self.column), maybe)
        unique = self.eat("UNIQUE")
        if not self.eat("INDEX"):
            self.fail("INDEX" if unique else "TABLE or INDEX")
        name = self.name()
        self.need("ON")
        return CreateIndex(name, self.name(), self.bracketed(self.name), unique)

    def column(self) -> ColumnDef:
        name, kind, found = self.name(), None, []
        for k in KINDS:
            if self.eat(k):
                kind = k
        if kind is None:
            kind = self.affinity()
        while True:
            if self.eat("PRIMARY"):
                self.need("KEY")
                found.append(("PRIMARY KEY", None))
            elif self.eat("NOT"):
                self.need("NULL")
                found.append(("NOT NULL", None))
            elif self.eat("UNIQUE"):
                found.append(("UNIQUE", None))
            elif self.eat("DEFAULT"):
                found.append(("DEFAULT", self.constant()))
            else:
                return ColumnDef(name, kind, tuple(found))

    def affinity(self) -> str:
        words = [self.take("name", "a column type")]
        while self.now.kind == "name":
            words.append(self.name())
        if self.eat("("):  # a size, which nothing keeps
            while self.now.kind == "int" or self.sees(",", "-"):
                self.i += 1
            self.need(")")
        spelled = " ".join(words).upper()
        return next((kind for part, kind in AFFINITY if part in spelled), "REAL")


def parse_many(sql: str) -> list:
    reader, out = _Reader(sql), []
    while True:
        while reader.eat(";"):
            pass
        if reader.now.kind == "end":
            return out
        reader.depth = 0
        out.append(reader.statement())


def parse(sql: str):
    """The one statement of a text; a ``;`` may follow it."""
    reader = _Reader(sql)
    out = reader.statement()
    while reader.eat(";"):
        pass
    if reader.now.kind != "end":
        reader.fail("the end")
    return out
