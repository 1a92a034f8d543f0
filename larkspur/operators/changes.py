"""Statements that write: each stages new files and names them in the transaction's state.

Matches are read from an immutable snapshot, so a statement never sees its own writes.  Checks look at what the table
would hold afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IndexExists, NotNull, NotUnique, SqlError, TableExists, TypeMismatch, Unsupported
from ..functions.typed import SPARK, Typed, kind_of, lower, truth
from ..functions.values import evaluate
from ..plans import syntax as S
from ..plans.binding import Scope
from ..sources.store import Store
from .query import numbered, resolver

#: Values of a column that a filter lists at most.
KNOWN = 200
#: Folders of fewer bytes than this are made one by VACUUM.
SMALL = 128 << 20
NAMES = {type(None): "NULL", bool: "BOOLEAN", int: "INTEGER", float: "REAL", str: "TEXT", bytes: "BLOB"}


def fits(kind: str, found: str) -> bool:
    """Whether a value may be written: same kind, a whole number as a fraction, text as bytes."""
    return found in ("NULL", kind) or (kind, found) in (("REAL", "INTEGER"), ("BLOB", "TEXT"))


def coerced(value, column: dict):
    found = NAMES[type(value)]
    if not fits(column["kind"], found):
        raise TypeMismatch(column["name"], column["kind"], found)
    return value.encode() if column["kind"] == "BLOB" and isinstance(value, str) else float(value) if column["kind"] == "REAL" and value is not None else value


def create_table(store: Store, s: S.CreateTable) -> None:
    tables = store.open["tables"]
    if s.name.lower() in tables:
        if s.if_not_exists:
            return
        raise TableExists(s.name)
    if s.name.startswith("_"):
        raise Unsupported("names of tables don't begin with _")
    names = [c.name.lower() for c in s.columns]
    if len(set(names)) < len(names):
        raise SqlError(f"a column of {s.name} is declared twice", 0)
    if any(n in ("_rowid", "_xmin", "_xmax") for n in names):
        raise Unsupported("_rowid, _xmin and _xmax are the store's own columns")
    columns, indexes = [], []
    for c in s.columns:
        given = dict(c.constraints)
        primary, default = "PRIMARY KEY" in given, given.get("DEFAULT")
        columns.append({"name": c.name, "kind": c.kind, "primary": primary, "not_null": primary or "NOT NULL" in given})
        columns[-1]["default"] = None if default is None else _stored(coerced(default.value, columns[-1]))
        if primary or "UNIQUE" in given:
            # a primary key is unique too, but its index isn't shown
            name = None if primary else f"{s.name}_{c.name}_unique"
            indexes.append({"name": name, "columns": [c.name], "unique": True})
    if sum(c["primary"] for c in columns) > 1:
        raise Unsupported("a table has one primary key at most")
    shown = [i for i in indexes if i["name"]]
    tables[s.name.lower()] = {"name": s.name, "columns": columns, "indexes": shown, "keys": [i["columns"] for i in indexes if not i["name"]], "data": [], "tombs": [], "high": 0}


def _stored(v):
    return {"hex": v.hex()} if isinstance(v, bytes) else v


def _default(c: dict):
    v = c["default"]
    return bytes.fromhex(v["hex"]) if isinstance(v, dict) else v


def create_index(store: Store, s: S.CreateIndex) -> int:
    e = store.entry(s.table)
    scope = scope_of(store, s.table)
    columns = [e["columns"][scope.resolve(S.Name(None, c))]["name"] for c in s.columns]
    if any(i["name"].lower() == s.name.lower() for i in e["indexes"]):
        raise IndexExists(s.name)
    if s.unique:
        _unique(store.rows(e), [columns])
    e["indexes"].append({"name": s.name, "columns": columns, "unique": s.unique})
    if e["data"]:  # all versions again, with the index's Bloom filters; file by file, so their order stays
        e["data"] = [store.write(e, store.versions(e))]
    return store.rows(e).count()


def scope_of(store: Store, table: str) -> Scope:
    scope = Scope()
    scope.add(table, store.table(table))
    return scope


def _unique_keys(e: dict) -> list[list[str]]:
    return [*e["keys"], *(i["columns"] for i in e["indexes"] if i["unique"])]


def _present(columns: list[str]):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"`{c}`").isNotNull()
    return out


def _unique(rows: DataFrame, keys: list[list[str]]) -> None:
    """A key that holds a null is exempt."""
    for columns in keys:
        if not rows.where(_present(columns)).groupBy(*(f"`{c}`" for c in columns)).count().where("count > 1").isEmpty():
            raise NotUnique(", ".join(columns))


def _check(before: DataFrame, new: DataFrame, e: dict) -> None:
    """Constraints of rows to be written beside those of ``before``; every null check in one job."""
    must = [c["name"] for c in e["columns"] if c["not_null"]]
    if must:
        missing = new.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(must))).first()
        for c, n in zip(must, missing, strict=True):
            if n:
                raise NotNull(c)
    for columns in _unique_keys(e):
        _unique(new, [columns])
        some = new.where(_present(columns)).select(*(F.col(f"`{c}`") for c in columns))
        if not before.join(some, columns, "left_semi").isEmpty():
            raise NotUnique(", ".join(columns))


def _check_values(store: Store, e: dict, rows: list[tuple]) -> None:
    """Unique keys of rows that a statement spells out.  Whole-number primary keys above the high-water mark are new;
    of other keys a short list is a filter, so files that hold none of it are skipped by their statistics."""
    names = [c["name"] for c in e["columns"]]
    for columns in _unique_keys(e):
        at = [names.index(c) for c in columns]
        keys = [k for r in rows if None not in (k := tuple(r[i] for i in at))]
        if len(set(keys)) < len(keys):
            raise NotUnique(", ".join(columns))
        first = e["columns"][at[0]]
        if not keys or len(at) == 1 and first["primary"] and first["kind"] == "INTEGER" and min(keys)[0] > e["high"]:
            continue
        there = store.rows(e)
        if len(keys) <= KNOWN:
            for i, c in enumerate(columns):
                there = there.where(F.col(f"`{c}`").isin([k[i] for k in keys]))
        if len(at) > 1 or len(keys) > KNOWN:
            kinds = T.StructType([f for f in store.schema(e).fields if f.name in columns])
            some = store.spark.createDataFrame([tuple(k[columns.index(f.name)] for f in kinds) for k in keys], kinds)
            there = there.join(some, columns, "left_semi")
        if not there.isEmpty():
            raise NotUnique(", ".join(columns))


def insert(store: Store, s: S.Insert, strict_between: bool = False) -> int:
    e, scope = store.entry(s.table), scope_of(store, s.table)
    columns = e["columns"]
    targets = [scope.resolve(S.Name(None, c)) for c in s.columns] or list(range(len(columns)))
    if len(set(targets)) < len(targets):
        raise SqlError("a column is named twice", 0)
    key = next((i for i, c in enumerate(columns) if c["primary"] and c["kind"] == "INTEGER"), None)
    rows, high = [], e["high"]
    for r in s.rows:
        if len(r) != len(targets):
            raise SqlError(f"{len(r)} values for {len(targets)} columns", 0)
        given = dict(zip(targets, (evaluate(scope_free(v), None, strict_between) for v in r), strict=True))
        row = [coerced(given[i], c) if i in given else _default(c) for i, c in enumerate(columns)]
        if key is not None and row[key] is None:
            row[key] = high + 1
        rowid = high + 1 if key is None else row[key]
        high = max(high, rowid)
        for c, v in zip(columns, row, strict=True):
            if c["not_null"] and v is None:
                raise NotNull(c["name"])
        rows.append((rowid, store.txid, *row))
    _check_values(store, e, [r[2:] for r in rows])
    new = store.spark.createDataFrame(rows, store.schema(e)).coalesce(1)
    e["data"] = [*e["data"], store.write(e, new)]
    e["high"] = high
    return len(rows)


def load(store: Store, table: str, frame: DataFrame) -> int:
    """Inserts the rows of a DataFrame.  Row ids are the whole-number primary key (which must be there), or else go on
    from the last one: numbered by many tasks, from the rows of each."""
    e, columns = store.entry(table), store.entry(table)["columns"]
    given = {c.lower(): c for c in frame.columns}
    out = []
    for c in columns:
        if c["name"].lower() not in given:
            out.append(F.lit(_default(c)).cast(SPARK[c["kind"]]).alias(c["name"]))
            continue
        field = frame.schema[given[c["name"].lower()]]
        if not fits(c["kind"], kind_of(field.dataType)):
            raise TypeMismatch(c["name"], c["kind"], kind_of(field.dataType))
        out.append(F.col(f"`{field.name}`").cast(SPARK[c["kind"]]).alias(c["name"]))
    key = next((c["name"] for c in columns if c["primary"] and c["kind"] == "INTEGER"), None)
    # without a key, ids have gaps between tasks; they only need to differ and to grow
    rowid = F.col(f"`{key}`") if key else F.lit(e["high"] + 1).cast("long") + F.monotonically_increasing_id()
    rows = frame.select(*out).select(rowid.alias("_rowid"), F.lit(store.txid).cast("long").alias("_xmin"), "*")
    if key:  # in key order, so that files and row groups hold ranges of keys and their statistics prune
        rows = rows.repartitionByRange("_rowid").sortWithinPartitions("_rowid")
    folder = store.write(e, rows)
    new = store.read(folder, store.schema(e))
    if _unique_keys(e) or any(c["not_null"] for c in columns):
        _check(store.rows(e), new, e)
    n, high = new.agg(F.count("*"), F.max("_rowid")).first()
    if n:
        e["data"] = [*e["data"], folder]
        e["high"] = max(e["high"], high)
    return n


def scope_free(e: S.Expr) -> S.Expr:
    """VALUES sees no table, so a name in it is unknown."""
    return Scope().bind(e)


def _matches(store: Store, e: dict, table: str, where: S.Expr | None, strict_between: bool):
    """The rows a WHERE admits, with c<i> for the columns, _rowid and _xmin."""
    scope = scope_of(store, table)
    rows = store.rows(e)
    frame = rows.select("_rowid", "_xmin", *(F.col(f"`{c.name}`").alias(f"c{i}") for i, c in enumerate(scope.tables[0][1].columns)))
    name = resolver(numbered(rows, scope.tables[0][1], 0))
    if where is not None:
        frame = frame.where(truth(lower(scope.bind(where), name, strict_between)))
    return scope, frame, name


def update(store: Store, s: S.Update, strict_between: bool = False) -> int:
    e = store.entry(s.table)
    columns = e["columns"]
    scope, found, name = _matches(store, e, s.table, s.where, strict_between)
    sets: dict[int, Typed] = {}
    for c, value in s.sets:
        i = scope.resolve(S.Name(None, c))
        if i in sets:
            raise SqlError(f"{c} is set twice", 0)
        sets[i] = lower(scope.bind(value), name, strict_between)
    out = []
    for i, c in enumerate(columns):
        if i not in sets:
            out.append(F.col(f"c{i}").alias(c["name"]))
            continue
        if not fits(c["kind"], sets[i].kind):
            if not found.where(sets[i].column.isNotNull()).isEmpty():
                raise TypeMismatch(c["name"], c["kind"], sets[i].kind)
            out.append(F.lit(None).cast(SPARK[c["kind"]]).alias(c["name"]))
            continue
        out.append(sets[i].column.cast(SPARK[c["kind"]]).alias(c["name"]))
    key = next((i for i, c in enumerate(columns) if c["primary"] and c["kind"] == "INTEGER"), None)
    rowid = sets[key].column.cast("long") if key in sets else F.col("_rowid")
    # one scan finds the matches; what replaces them is written with the versions that it replaces
    staged = found.select(rowid.alias("_rowid"), F.lit(store.txid).cast("long").alias("_xmin"), *out, F.col("_rowid").alias("_old"), F.col("_xmin").alias("_old_xmin"))
    schema = T.StructType([*store.schema(e).fields, T.StructField("_old", T.LongType()), T.StructField("_old_xmin", T.LongType())])
    folder = store.write(e, staged)
    new = store.read(folder, schema)
    n, high = new.agg(F.count("*"), F.max("_rowid")).first()
    if not n:
        return 0
    gone = new.select(F.col("_old").alias("_rowid"), F.col("_old_xmin").alias("_xmin"), F.lit(store.txid).cast("long").alias("_xmax"))
    touched = {columns[i]["name"] for i in sets}
    if any(c["not_null"] and c["name"] in touched for c in columns) or any(touched & set(k) for k in _unique_keys(e)):
        _check(store.rows(e).join(gone, ["_rowid", "_xmin"], "left_anti"), new, e)
    e["tombs"] = [*e["tombs"], store.write(e, gone)]
    e["data"] = [*e["data"], folder]
    e["high"] = max(e["high"], high)
    return n


def delete(store: Store, s: S.Delete, strict_between: bool = False) -> int:
    e = store.entry(s.table)
    _, found, _ = _matches(store, e, s.table, s.where, strict_between)
    folder = store.write(e, found.select("_rowid", "_xmin", F.lit(store.txid).cast("long").alias("_xmax")))
    n = store.read(folder, store.schema(e, "_xmax")).count()
    if n:
        e["tombs"] = [*e["tombs"], folder]
    return n


def vacuum(store: Store, names: list[str]) -> int:
    """Rewrites, in row order, the folders that hold dead versions, and makes one of the small ones; counts the versions
    and the index entries that nothing shows any more.  Dead is what transactions before this one removed: its own
    removals may yet be rolled back.  Files that are replaced stay for readers of older states, until a checkpoint."""
    total = 0
    for name in names:
        e = store.entry(name)
        small = [f for f in e["data"] if store.folder.size(f) < SMALL]
        rewritten = set(small) if len(small) > 1 else set()
        every, tombs = store.versions(e), store.tombs(e)
        mine = F.col("_xmax") >= store.txid
        dead = tombs.where(~mine)
        if e["tombs"]:
            folder = F.element_at(F.split("_metadata.file_path", "/"), -2).alias("_folder")
            held = every.select("_rowid", "_xmin", folder).join(dead, ["_rowid", "_xmin"], "left_semi").groupBy("_folder").count().collect()
            total += sum(r["count"] for r in held)
            rewritten |= {f for f in e["data"] if f.rpartition("/")[2] in {r["_folder"] for r in held}}
            if held:
                kept = every.join(dead, ["_rowid", "_xmin"], "left_anti")
                for columns in [i["columns"] for i in e["indexes"]]:
                    pick = [F.col(f"`{c}`") for c in ("_rowid", *columns)]
                    total += every.select(*pick).distinct().exceptAll(kept.select(*pick).distinct()).count()
            still = tombs.where(mine)
            e["tombs"] = [] if still.isEmpty() else [store.write(e, still)]
        if rewritten:
            some = store.versions({**e, "data": sorted(rewritten)}).join(dead, ["_rowid", "_xmin"], "left_anti")
            e["data"] = [f for f in e["data"] if f not in rewritten] + [store.write(e, some.repartitionByRange("_rowid").sortWithinPartitions("_rowid"))]
    return total
