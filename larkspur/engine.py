"""The engine: statements in, outcomes out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .errors import NoOpenTransaction, Overflow, TransactionAlreadyOpen, UnknownTable, Unsupported
from .functions.typed import kind_of
from .operators import changes, query
from .plans import explain
from .plans import syntax as S
from .plans.binding import Column, Query, Table, bind_select
from .sources.store import Store


@dataclass
class Outcome:
    """What a statement gave: ``kind`` is rows, affected, plan or ack."""

    kind: str
    frame: DataFrame | None = None  # lazy; in the query's own order, if it has one
    affected: int = 0
    plan: str = ""
    _ordered: Callable[[], DataFrame] | None = field(default=None, repr=False)

    @property
    def columns(self) -> list[str]:
        return self.frame.columns

    def rows(self) -> list[tuple]:
        """All rows, in row order where the query names none.  For results that fit the driver."""
        try:
            return [tuple(r) for r in (self._ordered() if self._ordered else self.frame).collect()]
        except PySparkException as e:
            if "ARITHMETIC_OVERFLOW" in str(e):
                raise Overflow("a whole number does not fit in 64 bits") from e
            raise


class Engine:
    """A folder of versioned tables, and read-only tables attached by name.

    Needs ANSI mode (Spark's default), for whole-number overflow to be an error."""

    def __init__(self, spark: SparkSession, path: str | None = None, strict_between: bool = False):
        if spark.conf.get("spark.sql.ansi.enabled", "true") != "true":
            raise Unsupported("spark.sql.ansi.enabled must be true")
        self.spark, self.strict_between = spark, strict_between
        self.store = Store(spark, path) if path else None
        self.attached: dict[str, tuple] = {}

    # --- tables -------------------------------------------------------------------------------------------------------

    def attach(self, name: str, source: DataFrame | str | Callable[[], DataFrame], primary_key: str | None = None) -> None:
        """Makes a DataFrame, the Parquet files at a path, or what a function makes, readable under a name.

        Nothing is opened before a statement names the table."""
        self.attached[name.lower()] = (name, source, primary_key)

    def _opened(self, name: str) -> tuple[Table, DataFrame]:
        found = self.attached[name.lower()]
        if len(found) == 3:
            name, source, key = found
            frame = self.spark.read.parquet(source) if isinstance(source, str) else source() if callable(source) else source
            found = Table(name, [Column(f.name, kind_of(f.dataType)) for f in frame.schema], key), frame
            self.attached[name.lower()] = found
        return found

    def _table(self, name: str) -> Table:
        if name.lower() in self.attached:
            return self._opened(name)[0]
        if self.store is None:
            raise UnknownTable(name)
        return self.store.table(name)

    def _frame(self, table: Table) -> DataFrame:
        if table.name.lower() in self.attached:
            return self._opened(table.name)[1]
        e = self.store.entry(table.name)
        return self.store.rows(e)

    # --- statements ---------------------------------------------------------------------------------------------------

    def execute(self, sql: str) -> list[Outcome]:
        """Outcomes of all statements of a text, in turn; an error keeps the effects of those before it."""
        return [self.run(s) for s in S.parse_many(sql)]

    def query(self, sql: str) -> Outcome:
        """The outcome of a text that holds one statement."""
        return self.run(S.parse(sql))

    def run(self, s) -> Outcome:
        if isinstance(s, S.Select):
            return self._rows(bind_select(s, self._table))
        if isinstance(s, S.Explain):
            return Outcome("plan", plan=self.explain(s.statement))
        if isinstance(s, S.Control):
            return self._control(s.verb)
        if self.store is None:
            raise Unsupported("this engine has no folder to write to")
        return self._write(s)

    def _rows(self, q: Query) -> Outcome:
        # the frames of this snapshot are fixed now, whatever is committed before they run
        frames = {id(t): self._frame(t) for _, t, _ in q.scope.tables}
        make = lambda ordered: query.run(q, lambda t: frames[id(t)], ordered, self.strict_between)
        return Outcome("rows", make(False), _ordered=lambda: make(True))

    def _control(self, verb: str) -> Outcome:
        if self.store is None:
            raise Unsupported("this engine has no folder to write to")
        if verb == "BEGIN":
            if self.store.open is not None:
                raise TransactionAlreadyOpen("a transaction is open")
            self.store.begin()
        elif self.store.open is None:
            raise NoOpenTransaction("no transaction is open")
        elif verb == "COMMIT":
            self.store.commit()
        else:
            self.store.rollback()
        return Outcome("ack")

    def _write(self, s) -> Outcome:
        return self._alone(lambda: self._change(s))

    def _alone(self, change: Callable):
        """Runs a change in the open transaction, or in one of its own; if it fails, nothing of it stays."""
        alone = self.store.open is None
        if alone:
            self.store.begin()
        mark = self.store.mark()
        try:
            out = change()
        except BaseException as e:
            if alone:
                self.store.rollback()
            else:
                self.store.undo(mark)
            if isinstance(e, PySparkException) and "ARITHMETIC_OVERFLOW" in str(e):
                raise Overflow("a whole number does not fit in 64 bits") from e
            raise
        if alone:
            self.store.commit()
        return out

    def _change(self, s) -> Outcome:
        name = getattr(s, "table", None) or getattr(s, "name", None)
        if name and name.lower() in self.attached:
            raise Unsupported(f"{name} is attached, so it is read-only")
        if isinstance(s, S.CreateTable):
            changes.create_table(self.store, s)
            return Outcome("ack")
        if isinstance(s, S.Vacuum):
            return Outcome("affected", affected=changes.vacuum(self.store, [s.table] if s.table else sorted(self.store.open["tables"])))
        does = {S.Insert: changes.insert, S.Update: changes.update, S.Delete: changes.delete, S.CreateIndex: changes.create_index}
        return Outcome("affected", affected=does[type(s)](self.store, s, *([self.strict_between] if isinstance(s, S.Update | S.Delete | S.Insert) else [])))

    def explain(self, s) -> str:
        """The compact tree of a statement."""
        if isinstance(s, S.Select):
            lines = explain.query(bind_select(s, self._table))
        elif isinstance(s, S.Insert):
            lines = [f"Insert {self._table(s.table).name} ({len(s.rows)} rows)"]
        elif isinstance(s, S.Update | S.Delete):
            table = self._table(s.table)
            scope = changes.scope_of(self.store, s.table)
            where = scope.bind(s.where) if s.where is not None else None
            head = f"Delete {table.name}"
            if isinstance(s, S.Update):
                sets = ", ".join(f"{table.columns[scope.resolve(S.Name(None, c))].name} = {scope.bind(v)}" for c, v in s.sets)
                head = f"Update {table.name} SET {sets}"
            lines = [head, *(f"  {x}" for x in explain.scan(table, where, False))]
        elif isinstance(s, S.CreateTable):
            lines = [f"CreateTable {s.name}"]
        elif isinstance(s, S.CreateIndex):
            lines = [f"CreateIndex {s.name} on {self._table(s.table).name}"]
        elif isinstance(s, S.Vacuum):
            lines = [f"Vacuum {', '.join([self._table(s.table).name] if s.table else sorted(e['name'] for e in self.store.state()['tables'].values()))}"]
        else:
            lines = [s.verb.capitalize()]
        return "\n".join(lines) + "\n"

    def load(self, table: str, frame: DataFrame) -> int:
        """Inserts a DataFrame's rows, matched by column name: the way in for data that no VALUES list could hold."""
        if self.store is None:
            raise Unsupported("this engine has no folder to write to")
        return self._alone(lambda: changes.load(self.store, table, frame))

    # --- housekeeping ---------------------------------------------------------------------------------------------------

    def tables(self) -> list[str]:
        """Names of the stored tables, in order."""
        return sorted(e["name"] for e in self.store.state()["tables"].values()) if self.store else []

    def checkpoint(self, older_than: float = 0.0) -> int:
        """Deletes files that no kept manifest names, if they are so many seconds old; how many folders went."""
        return self.store.checkpoint(older_than) if self.store else 0

    def recovery_report(self) -> dict:
        """The version opened, and what interrupted writers had left behind."""
        return dict(self.store.report) if self.store else {}

    def set_sort_budget(self, rows: int) -> None:
        """Accepted; Spark's sorts spill by themselves."""
