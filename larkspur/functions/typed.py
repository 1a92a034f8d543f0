"""The dialect's expressions as Spark columns, with the kind of each known beforehand.

Spark would cast text to numbers, divide whole numbers to fractions and raise where the dialect has an unknown result;
the kinds decide which Spark expression has the dialect's meaning.  Whole-number overflow raises, as ANSI mode does.
No Python runs in the plan.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.syntax import Const, Name, Op

#: Kinds of values; OTHER is passed through: it can be projected, sorted and compared with itself.
SPARK = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType(), "BOOLEAN": T.BooleanType(), "NULL": T.NullType()}
NUMBERS = ("INTEGER", "REAL")


class Typed(NamedTuple):
    kind: str
    column: Column
    spark: T.DataType | None = None  # of OTHER


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "INTEGER"
    if isinstance(t, T.FloatType | T.DoubleType):
        return "REAL"
    return next((k for k, s in SPARK.items() if isinstance(t, type(s))), "OTHER")


def constant(v) -> Typed:
    if v is None:
        return Typed("NULL", F.lit(None))
    if isinstance(v, bool):
        return Typed("BOOLEAN", F.lit(v))
    if isinstance(v, int):
        return Typed("INTEGER", F.lit(v).cast("long"))
    return Typed("REAL", F.lit(v).cast("double")) if isinstance(v, float) else Typed("TEXT", F.lit(v))


def unknown(kind: str = "BOOLEAN") -> Column:
    return F.lit(None).cast(SPARK[kind])


def truth(x: Typed) -> Column:
    """Whether a row is admitted: numbers other than 0 admit it, text, bytes and unknown do not."""
    if x.kind == "BOOLEAN":
        return x.column
    return x.column != F.lit(0) if x.kind in NUMBERS else unknown()


def comparable(a: Typed, b: Typed) -> bool:
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return True
    return a.kind == b.kind != "NULL" and a.spark == b.spark


def pair(a: Typed, b: Typed) -> tuple[Column, Column]:
    """Columns that Spark compares as the dialect does: a whole number beside a fraction becomes one."""
    if a.kind != b.kind:
        return a.column.cast("double"), b.column.cast("double")
    return a.column, b.column


_SIGNS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compared(sign: str, a: Typed, b: Typed) -> Column:
    return _SIGNS[sign](*pair(a, b)) if comparable(a, b) else unknown()


def calculated(sign: str, a: Typed, b: Typed) -> Typed:
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        return Typed("NULL", F.lit(None))
    kind = "INTEGER" if a.kind == b.kind == "INTEGER" else "REAL"
    x, y = a.column.cast(SPARK[kind]), b.column.cast(SPARK[kind])
    if sign in "/%":
        y = F.nullif(y, F.lit(0).cast(SPARK[kind]))  # by zero is unknown
    if sign == "/" and kind == "INTEGER":
        return Typed(kind, F.call_function("div", x, y))
    made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y}[sign]()
    return Typed(kind, made)


def like(a: Typed, b: Typed) -> Column:
    """No character escapes another, so Spark's escape is doubled."""
    if a.kind != "TEXT" or b.kind != "TEXT":
        return unknown()
    return F.like(a.column, F.replace(b.column, F.lit("\\"), F.lit("\\\\")))


def lower(e, name: Callable[[Name], Typed], strict_between: bool = False) -> Typed:
    """``name`` resolves columns.  With ``strict_between`` a bound that cannot be compared makes BETWEEN unknown."""
    if isinstance(e, Const):
        return constant(e.value)
    if isinstance(e, Name):
        return name(e)
    assert isinstance(e, Op)
    x = [lower(a, name, strict_between) for a in e.args]
    op, no = (e.op[4:], True) if e.op.startswith("NOT ") else (e.op, False)
    if op == "neg":
        return Typed(x[0].kind, -x[0].column.cast(SPARK[x[0].kind])) if x[0].kind in NUMBERS else Typed("NULL", F.lit(None))
    if op in "+-*/%":
        return calculated(op, *x)
    if op == "NOT":
        out = ~truth(x[0])
    elif op == "AND":
        out = truth(x[0]) & truth(x[1])
    elif op == "OR":
        out = truth(x[0]) | truth(x[1])
    elif op == "IS NULL":
        out = x[0].column.isNull()
    elif op == "IS NOT NULL":
        out = x[0].column.isNotNull()
    elif op == "LIKE":
        out = like(*x)
    elif op == "BETWEEN":
        low, high = compared(">=", x[0], x[1]), compared("<=", x[0], x[2])
        out = low & high
        if strict_between:
            out = F.when(low.isNull() | high.isNull(), unknown()).otherwise(out)
    else:
        out = compared(op, *x)
    return Typed("BOOLEAN", ~out if no else out)
