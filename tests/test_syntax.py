"""The dialect's text: statements made from a grammar, minimal parentheses, places of errors, and SqlError alone."""

from __future__ import annotations

import random

import pytest

from larkspur.errors import SqlError
from larkspur.plans.syntax import RESERVED, Const, Name, Op, parse, parse_many, tokenize


class Maker:
    """Random statements: lists of tokens, so that a test can cut or join them as it likes."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def one(self, *ways):
        return self.r.choice(ways)()

    def maybe(self, *tokens):
        return [t for x in tokens for t in (x if isinstance(x, list) else [x])] if self.r.random() < 0.5 else []

    def name(self):
        return [self.r.choice(["parcel", "Route", "km2", "_x", "zone_id", "Größe".replace("ö", "o").replace("ß", "s")])]

    def listed(self, make, most=3):
        out = make()
        for _ in range(self.r.randrange(most)):
            out = [*out, ",", *make()]
        return out

    def constant(self):
        return [self.r.choice(["NULL", "TRUE", "FALSE", "0", "907", "2.25", "5e-2", "'zürich'", "'o''clock'", "''"])]

    def expr(self, depth=3):
        if not depth:
            return self.one(self.constant, self.name, lambda: [*self.name(), ".", *self.name()])
        sub = lambda: ["(", *self.expr(depth - 1), ")"]
        return self.one(
            lambda: self.expr(0),
            lambda: [*sub(), self.r.choice("+ - * / % = <> != < <= > >= AND OR LIKE".split()), *sub()],
            lambda: [self.r.choice(["-", "+", "NOT"]), *sub()],
            lambda: [*sub(), *self.maybe("NOT"), "BETWEEN", *sub(), "AND", *sub()],
            lambda: [*sub(), "NOT", "LIKE", *sub()],
            lambda: [*sub(), "IS", *self.maybe("NOT"), "NULL"],
        )

    def where(self):
        return self.maybe("WHERE", self.expr())

    def table(self):
        return [*self.name(), *self.one(list, self.name, lambda: ["AS", *self.name()])]

    def select(self):
        items = self.one(lambda: ["*"], lambda: self.listed(lambda: [*self.expr(2), *self.one(list, self.name, lambda: ["AS", *self.name()])]))
        joins = [t for _ in range(self.r.randrange(3)) for t in [*self.maybe("INNER"), "JOIN", *self.table(), "ON", *self.expr(2)]]
        order = self.maybe("ORDER", "BY", self.listed(lambda: [*self.expr(1), *self.one(list, lambda: ["ASC"], lambda: ["DESC"])]))
        return ["SELECT", *self.one(list, lambda: ["ALL"], lambda: ["DISTINCT"]), *items, "FROM", *self.table(), *joins, *self.where(), *order, *self.maybe("LIMIT", "12"), *self.maybe("OFFSET", "7")]

    def column(self):
        kind = self.one(lambda: ["INTEGER"], lambda: ["REAL"], lambda: ["TEXT"], lambda: ["BLOB"], lambda: ["BOOLEAN"], lambda: ["VARCHAR", "(", "9", ")"])
        return [*self.name(), *kind, *self.maybe("PRIMARY", "KEY"), *self.maybe("NOT", "NULL"), *self.maybe("UNIQUE"), *self.maybe("DEFAULT", self.constant())]

    def statement(self):
        names = lambda: ["(", *self.listed(self.name), ")"]
        return self.one(
            self.select,
            lambda: ["EXPLAIN", *self.select()],
            lambda: ["INSERT", "INTO", *self.name(), *self.one(list, names), "VALUES", *self.listed(lambda: ["(", *self.listed(lambda: self.expr(1)), ")"])],
            lambda: ["UPDATE", *self.name(), "SET", *self.listed(lambda: [*self.name(), "=", *self.expr(2)]), *self.where()],
            lambda: ["DELETE", "FROM", *self.name(), *self.where()],
            lambda: ["CREATE", "TABLE", *self.maybe("IF", "NOT", "EXISTS"), *self.name(), "(", *self.listed(self.column), ")"],
            lambda: ["CREATE", *self.maybe("UNIQUE"), "INDEX", *self.name(), "ON", *self.name(), *names()],
            lambda: [self.r.choice(["BEGIN", "COMMIT", "ROLLBACK", "VACUUM"])],
            lambda: ["VACUUM", *self.name()],
        )


@pytest.mark.parametrize("seed", range(20))
def test_what_is_rendered_parses_to_the_same_statement(seed):
    m = Maker(seed)
    for _ in range(40):
        tokens = m.statement()
        first = parse(" ".join(tokens))
        assert parse(str(first)) == first
        # white space, comments and the case of reserved words mean nothing
        gap = lambda: m.r.choice([" ", "\n\t", " /* a ' b */ ", " -- to the end;\n"])
        assert parse("".join(gap() + (t.lower() if t in RESERVED else t) for t in tokens) + " ;") == first


def test_statements_in_a_row():
    m = Maker(77)
    for _ in range(60):
        some = [m.statement() for _ in range(m.r.randrange(5))]
        assert parse_many(" ; ".join(map(" ".join, some)) + ";;") == [parse(" ".join(s)) for s in some]


#: How tightly each operator holds its sides, loosest first; not, the sign and comparisons stand between as listed.
LEVELS = [("OR",), ("AND",), ("NOT",), ("=", "<>", "<", "<=", ">", ">=", "LIKE"), ("+", "-"), ("*", "/", "%"), ("neg",)]


def least_parentheses(e) -> tuple[str, int]:
    """Text with parentheses only where levels or the grouping from the left demand them."""
    if not isinstance(e, Op):
        return str(e), len(LEVELS)
    level = next(i for i, ops in enumerate(LEVELS) if e.op in ops)
    parts = [least_parentheses(a) for a in e.args]
    wrap = lambda part, least: part[0] if part[1] >= least else f"({part[0]})"
    if e.op in ("NOT", "neg"):
        return f"{'NOT' if e.op == 'NOT' else '-'} {wrap(parts[0], level)}", level
    compares = LEVELS[level][0] == "="
    return f"{wrap(parts[0], level + compares)} {e.op} {wrap(parts[1], level + 1)}", level


def test_parentheses_that_levels_make_needless():
    r = random.Random(5)

    def tree(depth):
        if not depth or r.random() < 0.2:
            return r.choice([Name(None, "kg"), Name("stop", "km"), Const(4), Const(0.5), Const("n")])
        op = r.choice([o for ops in LEVELS for o in ops])
        return Op(op, tuple(tree(depth - 1) for _ in range(1 if op in ("NOT", "neg") else 2)))

    for _ in range(3000):
        e = tree(4)
        text = least_parentheses(e)[0]
        assert parse(f"SELECT {text} FROM depot").items[0].expr == e, text


@pytest.mark.parametrize("seed", range(10))
def test_errors_name_the_byte_where_reading_stopped(seed):
    m = Maker(1000 + seed)
    for _ in range(40):
        tokens = m.statement()
        at = m.r.randrange(len(tokens) + 1)
        before = "".join(t + " " for t in tokens[:at])
        # no token starts with these, wherever they stand
        for odd in ("?", "§", "'open", "/* open"):
            with pytest.raises(SqlError) as e:
                parse(before + odd)
            assert e.value.at == len(before.encode())
        # a number that nothing holds
        with pytest.raises(SqlError) as e:
            parse(before + "98765432109876543210 " + " ".join(tokens[at:]))
        assert e.value.at == len(before.encode())


def test_a_statement_cut_short_fails_at_its_end():
    m, failed = Maker(31), 0
    for _ in range(300):
        tokens = m.statement()
        tokens = tokens[: m.r.randrange(1, len(tokens) + 1)]
        while tokens[-1] in ("NOT", "IF"):  # the first words of pairs are read together with the next
            tokens.pop()
        text = " ".join(tokens)
        try:
            parse(text)
        except SqlError as e:
            failed += 1
            assert e.at == len(text.encode())
    assert failed > 100


@pytest.mark.parametrize("text", ["", " -- nothing", "parcel", "7", "WHERE kg > 1", "SELECT kg < km < 3 FROM stop", "EXPLAIN EXPLAIN COMMIT", "SELECT 2e400 FROM stop", "COMMIT COMMIT", "SELECT NOT FROM stop", "DELETE FROM stop kg", "SELECT kg FROM stop LIMIT km", "INSERT INTO stop VALUES 4", "SELECT kg IS 4 FROM stop", "CREATE UNIQUE TABLE stop (kg REAL)", "SELECT " + "- " * 3000 + "kg FROM stop"])
def test_what_is_no_statement_is_refused(text):
    with pytest.raises(SqlError):
        parse(text)


def test_declared_types_become_kinds():
    """By the parts of a declared type that imply a kind, the first of them; REAL where none does."""
    parts = [("INT", "INTEGER"), ("CHAR", "TEXT"), ("CLOB", "TEXT"), ("TEXT", "TEXT"), ("BLOB", "BLOB"), ("REAL", "REAL"), ("FLOA", "REAL"), ("DOUB", "REAL")]
    r = random.Random(3)
    for _ in range(400):
        words = [r.choice(["wide", "xx", "my"]) + r.choice([p for p, _ in parts] + ["", ""]).lower() + "q" for _ in range(r.randrange(1, 3))]
        want = next((kind for part, kind in parts if part in " ".join(words).upper()), "REAL")
        size = r.choice(["", "(4)", "(6, 2)", " (-3)"])
        assert parse(f"CREATE TABLE depot (c {' '.join(words)}{size})").columns[0].kind == want


def test_tokens_and_constants():
    assert [(t.kind, t.value) for t in tokenize("12.km 3.5e2 'é''' <=!=")][:-1] == [("int", 12), ("mark", "."), ("name", "km"), ("real", 350.0), ("text", "é'"), ("mark", "<="), ("mark", "<>")]
    assert len({Const(1), Const(1.0), Const(True), Const("1"), Const(None)}) == 5


def test_any_text_gives_statements_or_an_error():
    m = Maker(6)
    for _ in range(3000):
        words = [t for _ in range(2) for t in m.statement()]
        m.r.shuffle(words)
        try:
            parse_many(" ".join(words[: m.r.randrange(14)]))
        except SqlError:
            pass
