"""The compact tree that EXPLAIN prints: what a statement does, in the dialect's own operators.

Columns are shown by place (#i), in a join's right side counted from that side's first.  Spark's own plan is
``Outcome.frame.explain("formatted")``.
"""

from __future__ import annotations

from . import syntax as S
from .binding import Query, Table, equal_sides, joined, key_range


def _tree(line: str, *below: list[str]) -> list[str]:
    return [line, *(f"  {x}" for part in below for x in part)]


def _shift(e: S.Expr, by: int) -> S.Expr:
    if isinstance(e, S.Name):
        return S.Name(None, f"#{int(e.name[1:]) - by}")
    return S.Op(e.op, tuple(_shift(a, by) for a in e.args)) if isinstance(e, S.Op) else e


def scan(table: Table, where: S.Expr | None, indexes: bool) -> list[str]:
    """A table's scan under what is left of its filter."""
    key = table.find(table.key) if table.key else None
    bounds, rest = key_range(where, key)
    if bounds:
        below, left = [f"RowIdScan {table.name} ({bounds})"], joined(rest)
    else:
        below, left = [f"SeqScan {table.name}"], where
        if indexes and (hit := _index(table, where)):
            below = [f"IndexScan {table.name} using {hit[0]} (= {hit[1]})"]
    return _tree(f"Filter {left}", below) if left is not None else below


def _index(table: Table, where: S.Expr | None) -> tuple[str, S.Const] | None:
    for c in S.conjuncts(where):
        if isinstance(c, S.Op) and c.op == "=":
            for a, b in (c.args, c.args[::-1]):
                if isinstance(a, S.Name) and isinstance(b, S.Const) and b.value is not None:
                    column = table.columns[int(a.name[1:])].name.lower()
                    for name, columns, _ in table.indexes:
                        if columns[0].lower() == column:
                            return name, b
    return None


def query(q: Query) -> list[str]:
    first = q.scope.tables[0][1]
    if q.single:
        out = scan(first, q.where, True)
    else:
        out = [f"SeqScan {first.name}"]
        for on, (_, table, border) in zip(q.ons, q.scope.tables[1:], strict=True):
            sides, rest = equal_sides(on, border)
            right = [f"SeqScan {table.name}"]
            if sides is None:
                out = _tree(f"NestedLoopJoin {on}", out, right)
            else:
                more = f" and {joined(rest)}" if rest else ""
                out = _tree(f"HashJoin {sides[0]} = {_shift(sides[1], border)}{more}", ["build:"], [f"  {x}" for x in out], ["probe:"], [f"  {x}" for x in right])
        if q.where is not None:
            out = _tree(f"Filter {q.where}", out)
    by_key = q.single and q.single.key and not any("IndexScan" in x for x in out) and [(str(o.expr), o.desc) for o in q.order] == [(f"#{q.single.find(q.single.key)}", False)]
    if q.order and not by_key:
        top = f" (top-{q.limit + (q.offset or 0)})" if q.limit is not None and not q.distinct else ""
        out = _tree(f"Sort {', '.join(map(str, q.order))}{top}", out)
    out = _tree("Project " + ", ".join(n if isinstance(e, S.Name) else f"{e} AS {n}" for n, e in q.outputs), out)
    if q.distinct:
        out = _tree("Distinct", out)
    if q.limit is not None or q.offset is not None:
        out = _tree("Limit" + (f" n={q.limit}" if q.limit is not None else "") + (f" offset={q.offset}" if q.offset else ""), out)
    return out
