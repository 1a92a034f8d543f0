"""Versioned tables: immutable Parquet files, and numbered manifests that name them.

A manifest holds the whole catalog: columns, indexes, each table's data files (``_rowid``, ``_xmin`` and the columns) and
tombstones (``_rowid``, ``_xmin``, ``_xmax``), the next transaction id and each table's row-id high-water mark.  A commit
writes files, then publishes the next manifest, which fails if another writer took its number.  What no manifest names
was never committed.  A snapshot is a manifest, so readers see one state however long they run: files that it names
stay until a checkpoint, KEPT states later.
"""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import CommitConflict, CorruptStore, UnknownTable
from ..functions.typed import SPARK
from ..plans.binding import Column, Table
from .files import Folder

LOG = "_log"
#: Manifests that stay readable behind the newest after a checkpoint.
KEPT = 10


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self.version, self.manifest = 0, {"next": 1, "tables": {}}
        if names := self._manifests():
            self.manifest, self.version = self._read(names[-1]), int(names[-1].removesuffix(".json"))
        known = {f for t in self.manifest["tables"].values() for f in (*t["data"], *t["tombs"])}
        stray = sum(f"{top}/{d}" not in known for top in self.manifest["tables"] for d in self.folder.names(top))
        temps = sum(n.endswith(".tmp") for n in self.folder.names(LOG))
        self.report = {"version": self.version, "unfinished_manifests": temps, "uncommitted_folders": stray}
        self.open: dict | None = None  # the state that a transaction has made so far
        self.staged: list[str] = []

    # --- states -------------------------------------------------------------------------------------------------------

    def _manifests(self) -> list[str]:
        return [n for n in self.folder.names(LOG) if n.endswith(".json")]

    def _read(self, name: str) -> dict:
        """A manifest is published whole, so one that can't be read was damaged later.  An older one is no substitute:
        what was committed since would silently be gone."""
        try:
            return json.loads(self.folder.read(f"{LOG}/{name}"))
        except ValueError as e:
            raise CorruptStore(f"{LOG}/{name} can't be read: {e}") from e

    def refresh(self) -> None:
        """Sees what others have committed."""
        names = self._manifests()
        if names and (newest := int(names[-1].removesuffix(".json"))) > self.version:
            self.manifest, self.version = self._read(names[-1]), newest

    def begin(self) -> None:
        self.refresh()
        self.open = copy.deepcopy(self.manifest)
        self.open["next"] += 1
        self.staged = []

    @property
    def txid(self) -> int:
        return self.open["next"] - 1

    def commit(self) -> None:
        state, self.open = self.open, None
        named = {f for t in state["tables"].values() for f in (*t["data"], *t["tombs"])}
        idle = [f for f in self.staged if f not in named]  # of statements that matched nothing, or were swept since
        self.staged = [f for f in self.staged if f in named]
        self._drop(idle)
        if state["tables"] == self.manifest["tables"]:
            return  # nothing was written
        for f in self.staged:
            self.folder.force(f)
        if not self.folder.publish(f"{LOG}/{self.version + 1:020d}.json", json.dumps(state)):
            self._drop(self.staged)
            raise CommitConflict(f"another writer committed version {self.version + 1}")
        # files that this state no longer names stay for those who read an older one, until a checkpoint
        self.manifest, self.version = state, self.version + 1

    def rollback(self) -> None:
        self.open = None
        self._drop(self.staged)

    def _drop(self, names: list[str]) -> None:
        for f in names:
            self.folder.delete(f)
        names.clear()

    def mark(self) -> tuple:
        """To undo a statement that fails within a transaction."""
        return copy.deepcopy(self.open), len(self.staged)

    def undo(self, mark: tuple) -> None:
        self.open, n = mark
        gone = self.staged[n:]
        del self.staged[n:]
        self._drop(gone)

    def checkpoint(self, older_than: float = 0.0) -> int:
        """Deletes old manifests, and folders that neither a kept manifest nor the open transaction names, if nothing was
        written to them for ``older_than`` seconds: longer than any reader or writer elsewhere takes."""
        names = self._manifests()
        kept = [n for i, n in enumerate(names) if i >= len(names) - KEPT or self.folder.age(f"{LOG}/{n}") < older_than]
        states = [self._read(n) for n in kept] + [s for s in (self.open, self.manifest) if s]
        used = {f for s in states for t in s["tables"].values() for f in (*t["data"], *t["tombs"])} | set(self.staged)
        gone = [f"{t}/{d}" for t in {t for s in states for t in s["tables"]} for d in self.folder.names(t) if f"{t}/{d}" not in used]
        gone = [f for f in gone if self.folder.age(f) >= older_than]
        for n in set(names) - set(kept):
            self.folder.delete(f"{LOG}/{n}")
        n = len(gone)
        self._drop(gone)
        return n

    # --- tables -------------------------------------------------------------------------------------------------------

    def state(self) -> dict:
        if self.open is None:
            self.refresh()
        return self.open or self.manifest

    def entry(self, name: str) -> dict:
        found = self.state()["tables"].get(name.lower())
        if found is None:
            raise UnknownTable(name)
        return found

    def table(self, name: str) -> Table:
        e = self.entry(name)
        key = next((c["name"] for c in e["columns"] if c["primary"] and c["kind"] == "INTEGER"), None)
        return Table(e["name"], [Column(c["name"], c["kind"]) for c in e["columns"]], key, [(i["name"], i["columns"], i["unique"]) for i in e["indexes"]])

    def schema(self, e: dict, extra: str = "") -> T.StructType:
        fields = [T.StructField("_rowid", T.LongType()), T.StructField("_xmin", T.LongType())]
        if extra:
            return T.StructType([*fields, T.StructField(extra, T.LongType())])
        return T.StructType([*fields, *(T.StructField(c["name"], SPARK[c["kind"]]) for c in e["columns"])])

    def versions(self, e: dict) -> DataFrame:
        """Every stored version, dead ones too."""
        schema = self.schema(e)
        if not e["data"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self.folder.at(f) for f in e["data"]))

    def tombs(self, e: dict) -> DataFrame:
        schema = self.schema(e, "_xmax")
        if not e["tombs"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self.folder.at(f) for f in e["tombs"]))

    def rows(self, e: dict) -> DataFrame:
        """The versions that show.  Without tombstones the scan stays plain, so predicates reach the files."""
        return self.versions(e).join(self.tombs(e), ["_rowid", "_xmin"], "left_anti") if e["tombs"] else self.versions(e)

    def write(self, e: dict, frame: DataFrame) -> str:
        """Stages a folder of files; the caller names it in the state.  An indexed column gets a Bloom filter for each
        row group, so a scan for one of its values skips those that lack it."""
        name = f"{e['name'].lower()}/{uuid.uuid4().hex}"
        writer = frame.write
        for column in {c for i in e["indexes"] for c in i["columns"] if c in frame.columns}:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(self.folder.at(name))
        self.staged.append(name)
        return name

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.folder.at(name))
