"""SELECT as DataFrame operations.

The logical plan is declared and left to Catalyst: predicates sink to the scans, columns are pruned, equalities become
join keys, a sort under a limit becomes a top-n.  Nothing here collects rows or runs Python on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import Typed, kind_of, lower, truth
from ..plans.binding import Query, Table
from ..plans.syntax import Const, Name, Order

ROWID = "_rowid"


def resolver(frame: DataFrame, prefix: str = "c") -> Callable[[Name], Typed]:
    """Bound names (#i) as the columns c0, c1, ... of a frame."""
    kinds = {f.name: f.dataType for f in frame.schema}

    def name(n: Name) -> Typed:
        column = f"{prefix}{n.name[1:]}"
        kind = kind_of(kinds[column])
        return Typed(kind, F.col(column), kinds[column] if kind == "OTHER" else None)

    return name


def numbered(frame: DataFrame, table: Table, first: int) -> DataFrame:
    """A table's columns under their places, and its row order, if it has one, as r<first>."""
    columns = [F.col(f"`{c.name}`").alias(f"c{first + i}") for i, c in enumerate(table.columns)]
    order = ROWID if ROWID in frame.columns else table.key
    return frame.select(*columns, *([F.col(f"`{order}`").alias(f"r{first}")] if order else []))


def sort_key(o: Order, name: Callable[[Name], Typed]):
    """Nulls come first going up, last going down."""
    c = lower(o.expr, name).column
    return c.desc_nulls_last() if o.desc else c.asc_nulls_first()


def run(q: Query, frame_of: Callable[[Table], DataFrame], ordered: bool = False, strict_between: bool = False) -> DataFrame:
    """The query's rows.  ``ordered``: also in row order where the query itself names none (one table, or DISTINCT)."""
    frame: DataFrame | None = None
    for i, (_, table, first) in enumerate(q.scope.tables):
        one = numbered(frame_of(table), table, first)
        if frame is None:
            frame = one
            continue
        both = {**{f.name: f.dataType for f in frame.schema}, **{f.name: f.dataType for f in one.schema}}

        def name(n: Name, kinds=both) -> Typed:
            column = f"c{n.name[1:]}"
            kind = kind_of(kinds[column])
            return Typed(kind, F.col(column), kinds[column] if kind == "OTHER" else None)

        frame = frame.join(one, truth(lower(q.ons[i - 1], name, strict_between)), "inner")
    assert frame is not None
    name = resolver(frame)
    if q.where is not None:
        frame = frame.where(truth(lower(q.where, name, strict_between)))
    outs = [lower(e, name, strict_between).column.alias(f"o{i}") for i, (_, e) in enumerate(q.outputs)]
    rowids = [c for c in frame.columns if c[0] == "r"] if q.single else []
    order = [o for o in q.order if not isinstance(o.expr, Const)]  # a constant orders nothing
    keys = [sort_key(o, name) for o in order]
    cut = q.limit is not None or q.offset is not None
    if not q.distinct:
        if keys:
            frame = frame.orderBy(*keys, *rowids)  # rows that tie keep their order
        elif rowids and (cut or ordered):
            frame = frame.orderBy(*rowids)
        elif cut and not q.single:
            every = [c for c in frame.columns if c[0] == "r"]
            frame = frame.orderBy(*every) if len(every) == len(q.scope.tables) else frame
        frame = frame.select(*outs)
    else:
        every = [c for c in frame.columns if c[0] == "r"]
        placed = (order or cut or ordered) and len(every) == len(q.scope.tables)
        frame, marks = first_seen(frame, outs, order, name, every if placed else [])
        if marks:
            frame = frame.orderBy(*marks)
        elif cut:
            frame = frame.orderBy(*(F.col(f"o{i}") for i in range(len(outs))))  # some order, the same every time
        frame = frame.select(*(F.col(f"o{i}") for i in range(len(outs))))
    if q.offset:
        frame = frame.offset(q.offset)
    if q.limit is not None:
        frame = frame.limit(q.limit)
    return frame.toDF(*(n for n, _ in q.outputs))


def first_seen(frame: DataFrame, outs, order: list[Order], name, rowids: list[str]) -> tuple[DataFrame, list]:
    """DISTINCT rows, and what sorts them: each stands where the first of its copies would, by the keys of ORDER BY
    (shown or not) and then in row order."""
    keys = [lower(o.expr, name).column.alias(f"k{i}") for i, o in enumerate(order)]
    names, places = [f"o{i}" for i in range(len(outs))], [f"k{i}" for i in range(len(order))]
    if not keys and not rowids:
        return frame.select(*outs).distinct(), []
    frame = frame.select(*outs, *keys, *rowids)
    ways, whole = {o.desc for o in order}, all(isinstance(frame.schema[r].dataType, T.IntegralType) for r in rowids)
    by = [F.col(k).desc_nulls_last() if o.desc else F.col(k).asc_nulls_first() for k, o in zip(places, order, strict=True)]
    # where all keys go one way a map-side aggregate finds the first, else a window
    if True not in ways or ways == {True} and whole:
        down = ways == {True}
        turned = lambda c: F.bitwise_not(c) if down else c
        rank = [*places, *(turned(F.col(r)).alias(r) for r in rowids)]
        out = frame.groupBy(*names).agg((F.max if down else F.min)(F.struct(*rank)).alias("f"))
        out = out.select(*names, *(F.col(f"f.{k}").alias(k) for k in places), *(turned(F.col(f"f.{r}")).alias(r) for r in rowids))
    else:
        out = frame.withColumn("_n", F.row_number().over(Window.partitionBy(*names).orderBy(*by, *rowids))).where("_n = 1")
    return out, [*by, *(F.col(r) for r in rowids)]
