"""The dialect's expressions on plain values: for the constants of VALUES, and as a yardstick in tests.

Unknown is None.  Kinds that cannot be compared or calculated with give unknown.
"""

from __future__ import annotations

import math
import re

from ..errors import Overflow
from ..plans.syntax import Const, Name, Op


def truth(v) -> bool | None:
    """Whether a value admits a row: numbers other than 0 do, text and bytes are unknown."""
    if isinstance(v, bool):
        return v
    return v != 0 if isinstance(v, int | float) else None


def number(v) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def compare(a, b) -> int | None:
    """-1, 0, 1, or unknown."""
    if a is None or b is None or not (number(a) and number(b) or type(a) is type(b)):
        return None
    if type(a) is not type(b):
        a, b = float(a), float(b)
    return None if a != a or b != b else (a > b) - (a < b)


def whole(v: int) -> int:
    if not -(2**63) <= v < 2**63:
        raise Overflow(f"{v} does not fit in 64 bits")
    return v


def calculate(op: str, a, b):
    if not (number(a) and number(b)):
        return None
    if isinstance(a, int) and isinstance(b, int):
        if op in "/%":
            if b == 0:
                return None
            q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return whole(q if op == "/" else a - q * b)
        return whole(a + b if op == "+" else a - b if op == "-" else a * b)
    a, b = float(a), float(b)
    if op in "/%":
        if b == 0:
            return None
        return a / b if op == "/" else math.fmod(a, b) if math.isfinite(a) else math.nan
    return a + b if op == "+" else a - b if op == "-" else a * b


def like(text: str, pattern: str) -> bool:
    """% is any run of characters, _ any one; nothing escapes them."""
    return bool(re.fullmatch("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text, re.S))


def negate(v: bool | None) -> bool | None:
    return None if v is None else not v


def both(a: bool | None, b: bool | None) -> bool | None:
    return False if a is False or b is False else None if a is None or b is None else True


def evaluate(e, row=None, strict_between: bool = False):
    """``row`` is a function from (table, name) to a value; ``strict_between`` as in ``typed.lower``."""
    if isinstance(e, Const):
        return e.value
    if isinstance(e, Name):
        return row(e.table, e.name)
    assert isinstance(e, Op)
    x = [evaluate(a, row, strict_between) for a in e.args]
    op, no = (e.op[4:], True) if e.op.startswith("NOT ") else (e.op, False)
    if op == "neg":
        return whole(-x[0]) if number(x[0]) and isinstance(x[0], int) else -x[0] if number(x[0]) else None
    if op == "NOT":
        return negate(truth(x[0]))
    if op == "AND":
        return both(truth(x[0]), truth(x[1]))
    if op == "OR":
        return negate(both(negate(truth(x[0])), negate(truth(x[1]))))
    if op in ("IS NULL", "IS NOT NULL"):
        return (x[0] is None) == (op == "IS NULL")
    if op == "LIKE":
        found = like(*x) if isinstance(x[0], str) and isinstance(x[1], str) else None
        return negate(found) if no else found
    if op == "BETWEEN":
        low, high = compare(x[0], x[1]), compare(x[0], x[2])
        found = None if strict_between and None in (low, high) else both(None if low is None else low >= 0, None if high is None else high <= 0)
        return negate(found) if no else found
    if op in "+-*/%":
        return calculate(op, *x)
    c = compare(*x)
    return None if c is None else {"=": c == 0, "<>": c != 0, "<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]
