"""Statements end to end: queries, changes, constraints, transactions, reopening, vacuum; expectations are computed
from generated rows by plain Python."""

from __future__ import annotations

import math
import random

import pytest

from larkspur import errors as E
from larkspur.engine import Engine
from larkspur.functions.values import evaluate, truth
from larkspur.operators import changes
from larkspur.plans.syntax import parse

PARCEL = ("no", "city", "grams", "price", "paid")
STOP = ("no", "parcel_no", "km")


def made(seed: int, n: int) -> tuple[list[tuple], list[tuple]]:
    """Parcels and the stops of some of them; a few of the stops belong to none."""
    r = random.Random(seed)
    numbers = sorted(r.sample(range(1, 9 * n), n))
    parcels = [(i, r.choice(["Ulm", "Oslo", "Umeå", "O'Hara", "a_b%"]), r.choice([None, r.randrange(-40, 900), 250]), r.choice([None, r.randrange(4000) / 8, 12.5]), r.choice([True, False, None])) for i in numbers]
    return parcels, [(k, r.choice([None, r.choice(numbers), 10**6 + k]), r.randrange(800) / 4) for k in range(1, n + 1)]


PARCELS, STOPS = made(20, 40)


def literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def listed(rows) -> str:
    return ", ".join(f"({', '.join(map(literal, r))})" for r in rows)


def create(db, parcels=PARCELS, stops=STOPS):
    db.execute(f"CREATE TABLE parcel (no INTEGER PRIMARY KEY, city TEXT NOT NULL, grams INTEGER, price REAL, paid BOOLEAN); INSERT INTO parcel VALUES {listed(parcels)}")
    db.execute(f"CREATE TABLE stop (no INTEGER PRIMARY KEY, parcel_no INTEGER, km REAL); INSERT INTO stop VALUES {listed(stops)}")


@pytest.fixture
def db(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


@pytest.fixture(scope="module")
def depot(spark, tmp_path_factory):
    db = Engine(spark, str(tmp_path_factory.mktemp("depot") / "db"))
    create(db)
    return db


def rows(db, sql):
    return db.query(sql).rows()


def holds(condition: str, *named: tuple[str, tuple, tuple]) -> bool:
    """Whether a condition admits rows given as (table, columns, values)."""
    where = parse(f"SELECT * FROM x WHERE {condition}").where
    find = lambda t, n: next(v for table, cols, row in named if t in (None, table) for c, v in zip(cols, row, strict=True) if c == n)
    return truth(evaluate(where, find)) is True


def admitted(condition, parcels=PARCELS):
    return [p for p in parcels if holds(condition, ("parcel", PARCEL, p))]


CONDITIONS = [
    "grams >= 250", "NOT grams < 250", "price IS NULL OR paid", "price IS NOT NULL AND NOT paid", "grams BETWEEN -10 AND 250", "price NOT BETWEEN 10 AND 400.5", "city LIKE 'O%' AND paid", "city NOT LIKE '_l%'", "city LIKE 'a_b%'",
    "no > 50 AND 200 >= no", "no = 12.0", "-no < -300", "grams / 0 IS NULL", "grams % 7 = 3", "price * 2 > grams + 100", "city", "city = 5", "grams", "NOT paid = TRUE", "NULL", "0.5", "no BETWEEN 100 AND NULL", "no NOT BETWEEN 100 AND NULL", "city < 'P' OR grams IS NULL",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_filters(depot, condition):
    assert rows(depot, f"SELECT * FROM parcel WHERE {condition}") == admitted(condition)


def test_outputs_and_their_names(depot):
    out = depot.query("SELECT NO, grams / 7 AS weeks, -price, p.city, grams % 7 short, price / 4 FROM parcel p WHERE grams IS NOT NULL")
    assert out.columns == ["NO", "weeks", "(-price)", "city", "short", "(price / 4)"]
    want = [(n, int(g / 7), None if x is None else -x, c, int(math.fmod(g, 7)), None if x is None else x / 4) for n, c, g, x, _ in PARCELS if g is not None]
    assert out.rows() == want
    assert depot.query("SELECT * FROM stop s JOIN parcel p ON s.parcel_no = p.no").columns == [*STOP, *PARCEL]


def first_up(v):
    """Sorts nulls first."""
    return (v is not None, v if v is not None else 0)


def by_keys(some, keys):
    """Stable sort by (place, descending); nulls first going up, last going down."""
    for place, down in reversed(keys):
        some = sorted(some, key=lambda r: first_up(r[place]), reverse=down)
    return some


@pytest.mark.parametrize(
    ("order", "keys"),
    [("price", [(3, False)]), ("price DESC", [(3, True)]), ("city DESC, grams", [(1, True), (2, False)]), ("paid, 3 DESC", [(4, False), (2, True)]), ("no DESC", [(0, True)]), ("2", [(1, False)]), ("-4", []), ("grams * -1 DESC", [])],
)
def test_sorting(depot, order, keys):
    stable = list(PARCELS)
    if order.startswith("grams *"):
        want = sorted(stable, key=lambda r: (r[2] is None, r[2] if r[2] is not None else 0))
    else:
        # sorted(reverse=True) keeps ties in order, as rows that tie keep theirs
        want = by_keys(stable, keys)
    assert rows(depot, f"SELECT * FROM parcel ORDER BY {order}") == want
    assert rows(depot, f"SELECT * FROM parcel ORDER BY {order} LIMIT 9 OFFSET 4") == want[4:13]


def test_cuts_without_an_order(depot):
    assert rows(depot, "SELECT no FROM parcel LIMIT 6 OFFSET 3") == [(p[0],) for p in PARCELS[3:9]]
    assert rows(depot, "SELECT no FROM parcel WHERE paid OFFSET 2") == [(p[0],) for p in admitted("paid")[2:]]
    assert rows(depot, "SELECT no FROM parcel LIMIT 0") == []
    with pytest.raises(E.SqlError):
        depot.query("SELECT no FROM parcel ORDER BY 3")


@pytest.mark.parametrize("on", ["s.parcel_no = p.no", "p.no = s.parcel_no AND s.km * 2 > p.price", "s.km > p.price AND p.paid", "s.no = p.grams / 50", "s.km = p.grams", "TRUE", "s.parcel_no <> p.no AND s.no < 3"])
def test_joins(depot, on):
    want = [(p[0], s[0]) for p in PARCELS for s in STOPS if holds(on, ("p", PARCEL, p), ("s", STOP, s))]
    assert sorted(rows(depot, f"SELECT p.no, s.no FROM parcel p JOIN stop s ON {on}")) == sorted(want)


def test_chains_of_joins_and_names(depot):
    want = sorted((p[0], s[0], t[0]) for p in PARCELS for s in STOPS for t in STOPS if s[1] == p[0] and t[1] == s[1] and t[0] > s[0] and p[4] is not False)
    assert sorted(rows(depot, "SELECT p.no, s.no, t.no FROM parcel p JOIN stop s ON s.parcel_no = p.no INNER JOIN stop t ON t.parcel_no = s.parcel_no AND t.no > s.no WHERE p.paid OR p.paid IS NULL")) == want
    for sql, kind in [("SELECT no FROM parcel JOIN stop ON TRUE", E.AmbiguousColumn), ("SELECT litres FROM parcel", E.UnknownColumn), ("SELECT no FROM depot", E.UnknownTable)]:
        with pytest.raises(kind):
            depot.query(sql)


def unique(some):
    return list(dict.fromkeys(some))


@pytest.mark.parametrize("seed", range(4))
def test_distinct_keeps_the_first(spark, tmp_path, seed):
    """By row order, by shown and by hidden keys, up, down and mixed, with ties and cuts."""
    parcels, _ = made(seed, 60)
    db = Engine(spark, str(tmp_path / "db"))
    create(db, parcels, [(1, 1, 1.0)])
    for shown in ((1,), (4,), (1, 4)):
        cols = ", ".join(PARCEL[i] for i in shown)
        pick = lambda some, shown=shown: unique(tuple(r[i] for i in shown) for r in some)
        assert rows(db, f"SELECT DISTINCT {cols} FROM parcel") == pick(parcels)
        assert rows(db, f"SELECT DISTINCT {cols} FROM parcel LIMIT 2") == pick(parcels)[:2]
        for keys in ([(2, False)], [(2, True)], [(4, True), (3, False)], [(shown[0], True)], [(3, True), (2, True)]):
            order = ", ".join(PARCEL[i] + " DESC" * d for i, d in keys)
            want = pick(by_keys(parcels, keys))
            assert rows(db, f"SELECT DISTINCT {cols} FROM parcel ORDER BY {order}") == want, order
            assert rows(db, f"SELECT DISTINCT {cols} FROM parcel ORDER BY {order} LIMIT 3 OFFSET 1") == want[1:4], order
    assert db.query("SELECT DISTINCT city, paid AS p FROM parcel").columns == ["city", "p"]


def test_distinct_over_joins(depot):
    want = {(p[1],) for p in PARCELS for s in STOPS if s[1] == p[0]}
    got = rows(depot, "SELECT DISTINCT p.city FROM parcel p JOIN stop s ON s.parcel_no = p.no")
    assert set(got) == want and len(got) == len(want)
    assert len(rows(depot, "SELECT DISTINCT p.city FROM parcel p JOIN stop s ON s.parcel_no = p.no LIMIT 2")) == 2


def test_rows_come_in_key_order(db):
    db.execute("CREATE TABLE lane (k INTEGER PRIMARY KEY, w TEXT); INSERT INTO lane VALUES (71, 'c'), (8, 'a'); INSERT INTO lane VALUES (35, 'b'); INSERT INTO lane (w) VALUES ('d'), ('e')")
    assert rows(db, "SELECT * FROM lane") == [(8, "a"), (35, "b"), (71, "c"), (72, "d"), (73, "e")]


def test_defaults_and_what_a_kind_takes(db):
    db.execute("CREATE TABLE box (k INTEGER PRIMARY KEY, open BOOLEAN DEFAULT FALSE, mark TEXT DEFAULT 'keep dry', litres NUMERIC(6, 1) DEFAULT 7, seal BLOB DEFAULT 'ß')")
    db.execute("INSERT INTO box (k) VALUES (4); INSERT INTO box (seal, mark, k) VALUES ('w', NULL, 9)")
    assert rows(db, "SELECT * FROM box") == [(4, False, "keep dry", 7.0, "ß".encode()), (9, False, None, 7.0, b"w")]


REFUSED = [
    ("INSERT INTO crate VALUES (8, NULL, 'n8', 2)", E.NotNull), ("UPDATE crate SET owner = NULL", E.NotNull), ("INSERT INTO crate (k) VALUES (8)", E.NotNull),
    ("INSERT INTO crate VALUES (8, 3.5, 'n8', 2)", E.TypeMismatch), ("UPDATE crate SET owner = depth", E.TypeMismatch), ("INSERT INTO crate VALUES (8, 'kim', 'n8', 'deep')", E.TypeMismatch),
    ("INSERT INTO crate VALUES (7, 'kim', 'n8', 2)", E.NotUnique), ("INSERT INTO crate VALUES (8, 'kim', 'n7', 2)", E.NotUnique), ("INSERT INTO crate VALUES (8, 'kim', 'n8', 2), (9, 'kim', 'n8', 2)", E.NotUnique),
    ("INSERT INTO crate VALUES (8, 'kim', 'n8', 2), (8, 'kim', 'n9', 2)", E.NotUnique), ("INSERT INTO crate VALUES (8, owner, 'n8', 2)", E.UnknownColumn), ("INSERT INTO crate (k, K) VALUES (8, 8)", E.SqlError), ("INSERT INTO crate VALUES (8, 'kim')", E.SqlError),
    ("UPDATE crate SET depth = depth * 4611686018427387904", E.Overflow), ("INSERT INTO crate VALUES (8, 'kim', 'n8', 9223372036854775807 + 2)", E.Overflow),
    ("CREATE TABLE Crate (a TEXT)", E.TableExists), ("CREATE TABLE bin (a TEXT, A REAL)", E.SqlError), ("DELETE FROM bin", E.UnknownTable), ("CREATE INDEX by_owner ON crate (owners)", E.UnknownColumn),
]


def test_refused_statements_change_nothing(db):
    db.execute("CREATE TABLE crate (k INTEGER PRIMARY KEY, owner TEXT NOT NULL, seal TEXT UNIQUE, depth INTEGER); INSERT INTO crate VALUES (7, 'ida', 'n7', 60)")
    for sql, kind in REFUSED:
        with pytest.raises(kind):
            db.query(sql)
        assert rows(db, "SELECT * FROM crate") == [(7, "ida", "n7", 60)], sql
    # what is null in a unique key meets nothing
    db.execute("CREATE TABLE IF NOT EXISTS crate (x REAL); INSERT INTO crate (owner) VALUES ('kim'), ('lou')")
    assert rows(db, "SELECT k, seal FROM crate") == [(7, "n7"), (8, None), (9, None)]


SETS = [("price = price + grams, grams = no", lambda p: (p[0], p[1], p[0], None if None in p[2:4] else p[3] + p[2], p[4])), ("no = no + 5000", lambda p: (p[0] + 5000, *p[1:])), ("paid = NULL, city = 'Rom'", lambda p: (p[0], "Rom", p[2], p[3], None)), ("price = grams", lambda p: (*p[:3], None if p[2] is None else float(p[2]), p[4]))]


@pytest.mark.parametrize("seed", range(3))
def test_changes_against_plain_rows(spark, tmp_path, seed):
    """Random updates, deletions, insertions, rollbacks and vacuums; a list of rows does the same."""
    r = random.Random(seed)
    now, _ = made(seed + 50, 30)
    db = Engine(spark, str(tmp_path / "db"))
    create(db, now, [(1, 1, 1.0)])
    for _ in range(9):
        before, condition = list(now), r.choice(CONDITIONS)
        rolled = r.random() < 0.3
        if rolled:
            db.query("BEGIN")
        kind = r.randrange(4)
        hit = admitted(condition, now)
        if kind == 0:
            text, new = SETS[r.randrange(len(SETS))]
            assert db.query(f"UPDATE parcel SET {text} WHERE {condition}").affected == len(hit)
            now = sorted([p for p in now if p not in hit] + [new(p) for p in hit])
        elif kind == 1:
            condition += f" AND no % 3 = {r.randrange(3)}"
            hit = admitted(condition, now)
            assert db.query(f"DELETE FROM parcel WHERE {condition}").affected == len(hit)
            now = [p for p in now if p not in hit]
        elif kind == 2:
            more = [(20_000 + r.randrange(10**6), "Bonn", k, None, True) for k in range(3)]
            assert db.query(f"INSERT INTO parcel VALUES {listed(more)}").affected == 3
            now = sorted([*now, *more])
        else:
            db.query("VACUUM parcel")
        assert rows(db, "SELECT * FROM parcel") == sorted(now, key=lambda p: p[0])
        if rolled:
            db.query("ROLLBACK")
            now = before
            assert rows(db, "SELECT * FROM parcel") == now
    assert rows(Engine(spark, str(tmp_path / "db")), "SELECT * FROM parcel") == now


def test_values_are_read_before_any_is_written(db):
    db.execute("CREATE TABLE pair (k INTEGER PRIMARY KEY, l TEXT, r TEXT, tag TEXT UNIQUE); INSERT INTO pair VALUES (11, 'left', 'right', 't')")
    db.execute("UPDATE pair SET l = r, r = l; UPDATE pair SET k = 40; UPDATE pair SET tag = 'u'; INSERT INTO pair VALUES (41, 'x', 'y', 't')")
    assert rows(db, "SELECT * FROM pair") == [(40, "right", "left", "u"), (41, "x", "y", "t")]
    db.query("DELETE FROM pair")
    db.query("INSERT INTO pair (l) VALUES ('z')")
    assert rows(db, "SELECT k FROM pair") == [(42,)]  # numbers are not given twice


def test_strict_between_holds_in_every_statement(spark, tmp_path):
    """A bound that is null makes the whole unknown, in what is changed as in what is shown."""
    for strict in (False, True):
        db = Engine(spark, str(tmp_path / f"db{strict}"), strict_between=strict)
        db.execute("CREATE TABLE b (k INTEGER PRIMARY KEY, n INTEGER, t BOOLEAN); INSERT INTO b VALUES (1, 3, 3 NOT BETWEEN 8 AND NULL), (2, 30, TRUE)")
        hit = [] if strict else [(1,)]
        assert rows(db, "SELECT k FROM b WHERE n NOT BETWEEN 8 AND NULL") == hit
        assert rows(db, "SELECT t FROM b WHERE k = 1") == [(None if strict else True,)]
        assert db.query("UPDATE b SET n = n + 0 WHERE n NOT BETWEEN 8 AND NULL").affected == len(hit)
        assert db.query("UPDATE b SET t = n NOT BETWEEN 8 AND NULL WHERE k = 1").affected == 1
        assert rows(db, "SELECT t FROM b WHERE k = 1") == [(None if strict else True,)]
        assert db.query("DELETE FROM b WHERE n NOT BETWEEN 8 AND NULL").affected == len(hit)


def test_indexes(db, spark):
    db.execute("CREATE TABLE crate (k INTEGER PRIMARY KEY, owner TEXT)")
    db.load("crate", spark.range(1, 4001).selectExpr("id AS k", "concat('own', id % 50) AS owner"))
    assert db.query("CREATE INDEX by_owner ON crate (owner)").affected == 4000
    assert "IndexScan crate using by_owner (= 'own9')" in db.query("EXPLAIN SELECT k FROM crate WHERE owner = 'own9'").plan
    assert rows(db, "SELECT k FROM crate WHERE owner = 'own9'") == [(k,) for k in range(9, 4001, 50)]
    for sql, kind in [("CREATE UNIQUE INDEX only_one ON crate (owner)", E.NotUnique), ("CREATE INDEX By_Owner ON crate (k)", E.IndexExists)]:
        with pytest.raises(kind):
            db.query(sql)
    # files hold a Bloom filter of each indexed column, and of no other, where no dictionary lists all values anyway
    db.load("crate", spark.range(5000, 15_000).selectExpr("id AS k", "concat(repeat('x', 200), id) AS owner").coalesce(1))
    assert rows(db, f"SELECT k FROM crate WHERE owner = '{'x' * 200}7777'") == [(7777,)]
    name = db.store.entry("crate")["data"][-1]
    jvm, filters = spark._jvm, []
    folder = jvm.org.apache.hadoop.fs.Path(db.store.folder.at(name))
    for status in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder):
        if status.getPath().getName().endswith(".parquet"):
            f = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(status.getPath(), spark._jsc.hadoopConfiguration())
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(f)
            filters += [(c.getPath().toDotString(), c.getBloomFilterOffset() > 0) for b in reader.getFooter().getBlocks() for c in b.getColumns()]
            reader.close()
    assert {c for c, there in filters if there} == {"owner"} and all(there == (c == "owner") for c, there in filters)


def test_bulk_loads_come_in_ranges_of_the_key(db, spark):
    """So that the statistics of files and row groups prune a search by key, before any VACUUM."""
    from pyspark.sql import functions as F

    db.execute("CREATE TABLE crate (k INTEGER PRIMARY KEY, n INTEGER)")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        db.load("crate", spark.range(1, 20_001).orderBy(F.rand(3)).selectExpr("id AS k", "id % 7 AS n"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (name,) = db.store.entry("crate")["data"]
    spans = sorted(tuple(r) for r in spark.read.parquet(db.store.folder.at(name)).groupBy(F.input_file_name()).agg(F.min("k"), F.max("k")).drop("input_file_name()").collect())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_transactions_of_two_engines(db, spark, tmp_path):
    db.execute("CREATE TABLE till (k INTEGER PRIMARY KEY, cents INTEGER); INSERT INTO till VALUES (3, 70), (6, 20)")
    other = Engine(spark, str(tmp_path / "db"))
    db.execute("BEGIN; UPDATE till SET cents = cents - 25 WHERE k = 3; UPDATE till SET cents = cents + 25 WHERE k = 6")
    assert rows(db, "SELECT * FROM till") == [(3, 45), (6, 45)] and rows(other, "SELECT * FROM till") == [(3, 70), (6, 20)]
    with pytest.raises(E.TransactionAlreadyOpen):
        db.query("BEGIN")
    with pytest.raises(E.NotUnique):
        db.query("INSERT INTO till VALUES (9, 1), (3, 1)")  # undone alone
    db.execute("CREATE TABLE log (line TEXT); COMMIT")
    assert rows(other, "SELECT * FROM till") == [(3, 45), (6, 45)] and other.tables() == ["log", "till"]
    for verb in ("ROLLBACK", "COMMIT"):
        with pytest.raises(E.NoOpenTransaction):
            db.query(verb)
    # a snapshot holds, and of two writers the second loses
    other.execute("BEGIN; DELETE FROM till WHERE k = 6")
    db.query("UPDATE till SET cents = 1 WHERE k = 3")
    assert rows(other, "SELECT * FROM till") == [(3, 45)]
    with pytest.raises(E.CommitConflict):
        other.query("COMMIT")
    assert rows(other, "SELECT * FROM till") == [(3, 1), (6, 45)]


def test_readers_keep_what_vacuum_replaces(db, spark, tmp_path):
    create(db)
    reader = Engine(spark, str(tmp_path / "db"))
    reader.query("BEGIN")
    held = reader.query("SELECT * FROM parcel ORDER BY no")
    db.execute("DELETE FROM parcel WHERE paid; UPDATE parcel SET grams = 0; VACUUM; VACUUM")
    db.checkpoint()
    assert rows(reader, "SELECT * FROM parcel") == PARCELS and held.rows() == PARCELS
    reader.query("ROLLBACK")
    left = [(*p[:2], 0, *p[3:]) for p in PARCELS if not p[4]]
    assert rows(reader, "SELECT * FROM parcel") == left
    for _ in range(12):  # states beyond those that are kept
        db.query("INSERT INTO stop (km) VALUES (1.5)")
    assert db.checkpoint(older_than=3600) == 0
    assert db.checkpoint() > 0 and rows(db, "SELECT * FROM parcel") == left


def test_vacuum_counts_and_its_horizon(db):
    create(db)
    paid = len(admitted("paid"))
    db.execute("UPDATE parcel SET grams = 1 WHERE paid; UPDATE parcel SET grams = 2 WHERE paid; DELETE FROM parcel WHERE paid")
    assert db.query("VACUUM stop").affected == 0 and db.query("VACUUM").affected == 3 * paid and db.query("VACUUM parcel").affected == 0
    db.execute("CREATE INDEX by_city ON parcel (city); UPDATE parcel SET city = 'Gent' WHERE city = 'Ulm'")
    moved = len(admitted("city = 'Ulm' AND NOT (paid AND paid IS NOT NULL) OR city = 'Ulm' AND paid IS NULL"))
    assert db.query("VACUUM parcel").affected == 2 * moved  # versions and their index entries
    # a transaction's own removals may yet be rolled back, so they stay
    before = rows(db, "SELECT * FROM parcel")
    db.execute("DELETE FROM parcel WHERE city = 'Gent'; BEGIN; DELETE FROM parcel WHERE city = 'Oslo'")
    assert db.query("VACUUM parcel").affected == 2 * moved
    assert db.query("VACUUM parcel").affected == 0
    assert rows(db, "SELECT * FROM parcel") == [p for p in before if p[1] not in ("Gent", "Oslo")]
    db.query("COMMIT")
    assert rows(db, "SELECT * FROM parcel") == [p for p in before if p[1] not in ("Gent", "Oslo")]
    db.execute("BEGIN; DELETE FROM parcel; VACUUM; ROLLBACK")
    assert rows(db, "SELECT * FROM parcel") == [p for p in before if p[1] not in ("Gent", "Oslo")]


def test_vacuum_rewrites_only_what_it_must(spark, tmp_path, monkeypatch):
    db = Engine(spark, str(tmp_path / "db"))
    db.execute("CREATE TABLE till (k INTEGER PRIMARY KEY, cents INTEGER); INSERT INTO till VALUES (1, 5); INSERT INTO till VALUES (2, 6); INSERT INTO till VALUES (3, 7)")
    folders = lambda: db.store.manifest["tables"]["till"]["data"]
    monkeypatch.setattr(changes, "SMALL", 0)
    before = folders()
    assert db.query("VACUUM").affected == 0 and folders() == before
    db.execute("DELETE FROM till WHERE k = 2")
    assert db.query("VACUUM").affected == 1 and set(before) - set(folders()) == {before[1]}
    monkeypatch.setattr(changes, "SMALL", 1 << 20)
    assert db.query("VACUUM").affected == 0 and len(folders()) == 1 and not db.store.manifest["tables"]["till"]["tombs"]
    assert rows(db, "SELECT * FROM till") == [(1, 5), (3, 7)]


def test_reopening_and_what_writers_left(spark, tmp_path):
    path = str(tmp_path / "db")
    db = Engine(spark, path)
    create(db)
    db.execute("BEGIN; DELETE FROM parcel")  # never committed
    (tmp_path / "db" / "_log" / "half.tmp").write_text("{")
    again = Engine(spark, path)
    assert rows(again, "SELECT * FROM parcel") == PARCELS
    report = again.recovery_report()
    assert report["unfinished_manifests"] == 1 and report["uncommitted_folders"] == 1
    assert again.checkpoint() == 1 and rows(again, "SELECT * FROM parcel") == PARCELS


def test_a_damaged_manifest_is_an_error_not_an_older_state(spark, tmp_path):
    path = tmp_path / "db"
    create(Engine(spark, str(path)))
    newest = sorted((path / "_log").glob("*.json"))[-1]
    newest.write_text(newest.read_text()[:-9])
    with pytest.raises(E.CorruptStore):
        Engine(spark, str(path))


def test_a_fault_at_any_step_leaves_a_whole_state(spark, tmp_path, monkeypatch):
    """Transactions with every kind of statement; the cut moves on until one commits whole."""
    cuts = 0
    for step in range(40):
        path = str(tmp_path / f"db{step}")
        db = Engine(spark, path)
        db.execute("CREATE TABLE till (k INTEGER PRIMARY KEY, cents INTEGER); INSERT INTO till VALUES (2, 5), (4, 9); DELETE FROM till WHERE k = 4")
        left = [step]

        def fragile(real, left=left):
            def call(*a, **b):
                if left[0] == 0:
                    raise OSError("the power went")
                left[0] -= 1
                return real(*a, **b)

            return call

        folder = db.store.folder
        for owner, name in ((folder, "publish"), (folder, "force"), (folder, "_sync"), (db.store, "write")):
            monkeypatch.setattr(owner, name, fragile(getattr(owner, name)))
        try:
            db.execute("BEGIN; UPDATE till SET cents = 6; INSERT INTO till VALUES (8, 1); VACUUM; CREATE TABLE memo (line TEXT); COMMIT")
            cut = False
        except OSError:
            cut = True
        cuts += cut
        again = Engine(spark, path)
        state = (rows(again, "SELECT * FROM till"), again.tables())
        after = ([(2, 6), (8, 1)], ["memo", "till"])
        assert state in (([(2, 5)], ["till"]), after) if cut else state == after
        if not cut:
            break
    assert not cut and cuts > 8


def test_explain(depot):
    plan = lambda sql: depot.query("EXPLAIN " + sql).plan
    assert "RowIdScan parcel (= 17)" in plan("SELECT city FROM parcel WHERE no = 17") and "SeqScan" not in plan("SELECT city FROM parcel WHERE no = 17")
    assert "RowIdScan parcel (>= 40, < 90)" in plan("SELECT city FROM parcel WHERE 90 > no AND no >= 40")
    assert "RowIdScan parcel (> 8, unbounded)" in plan("SELECT * FROM parcel WHERE no > 8")
    both = plan("SELECT * FROM parcel WHERE no > 8 AND price > 30")
    assert "RowIdScan parcel (> 8" in both and "Filter (#3 > 30)" in both
    assert "SeqScan" in plan("SELECT * FROM parcel WHERE no > 8 OR price > 30")
    assert "Sort" not in plan("SELECT * FROM parcel ORDER BY no") and "Sort" in plan("SELECT * FROM parcel ORDER BY no DESC")
    assert "(top-11)" in plan("SELECT * FROM parcel ORDER BY price LIMIT 7 OFFSET 4")
    join = plan("SELECT p.no FROM parcel p JOIN stop s ON s.parcel_no = p.no AND s.km > 2")
    assert "HashJoin #0 = #1 and (#7 > 2)" in join and "  build:" in join
    assert "NestedLoopJoin" in plan("SELECT p.no FROM parcel p JOIN stop s ON s.km > p.price")
    assert plan("DELETE FROM stop WHERE no = 5") == "Delete stop\n  RowIdScan stop (= 5)\n"
    assert plan(f"INSERT INTO stop VALUES {listed(STOPS[:4])}") == "Insert stop (4 rows)\n"
    assert plan("VACUUM") == "Vacuum parcel, stop\n" and plan("COMMIT") == "Commit\n"
    assert "Distinct" in plan("SELECT DISTINCT city FROM parcel LIMIT 4") and "Limit n=4" in plan("SELECT DISTINCT city FROM parcel LIMIT 4")


def test_spark_plans(depot, capsys):
    def physical(sql):
        depot.query(sql).frame.explain("formatted")
        return capsys.readouterr().out

    point = physical("SELECT city FROM parcel WHERE no = 17")
    assert "PushedFilters: [IsNotNull(no), EqualTo(no,17)]" in point and "ReadSchema: struct<no:bigint,city:string>" in point
    assert "TakeOrderedAndProject" in physical("SELECT city FROM parcel ORDER BY price LIMIT 3")
    assert "Python" not in physical("SELECT p.city LIKE 'U%', s.km / 2 FROM parcel p JOIN stop s ON s.parcel_no = p.no WHERE p.no % 3 = 1")
    assert "Window" not in physical("SELECT DISTINCT city FROM parcel ORDER BY price DESC LIMIT 3")


def test_versions_show_by_the_definition(spark, tmp_path):
    """Every pair of a writer and a remover, each before, in or after the transaction that reads."""
    db = Engine(spark, str(tmp_path / "db"))
    db.query("CREATE TABLE v (k INTEGER PRIMARY KEY)")
    k, want = 0, {}
    for written in ("before", "inside", "after"):
        for removed in ("before", "inside", "after", "never"):
            order = ("before", "inside", "after", "never")
            if order.index(removed) >= order.index(written):
                k += 1
                want[k] = (written, removed)
    act = lambda e, when: [e.query(f"INSERT INTO v VALUES ({i})") for i, (w, _) in want.items() if w == when] + [e.query(f"DELETE FROM v WHERE k = {i}") for i, (_, x) in want.items() if x == when]
    act(db, "before")
    reader = Engine(spark, str(tmp_path / "db"))
    reader.query("BEGIN")
    act(reader, "inside")
    late = [i for i, (w, x) in want.items() if (w, x) == ("before", "after")]
    db.query(f"INSERT INTO v VALUES {listed((i,) for i, (w, _) in want.items() if w == 'after')}")
    for i in late:
        db.query(f"DELETE FROM v WHERE k = {i}")
    seen = {i for i, (w, x) in want.items() if w in ("before", "inside") and x in ("after", "never")}
    assert {r[0] for r in rows(reader, "SELECT k FROM v")} == seen


def test_lowering_agrees_with_plain_values(spark):
    """Random expressions over every kind, lowered to Spark and evaluated on plain values."""
    r = random.Random(12)
    db = Engine(spark)
    data = [(i, r.choice([None, -7, -2, 0, 1, 2, 5]), r.choice([None, -7.5, -1.0, 0.0, 2.0, 2.5]), r.choice([None, "a", "ab", "a%", "a\\b", "_", ""]), r.choice([None, True, False])) for i in range(60)]
    db.attach("t", spark.createDataFrame(data, "k long, i long, r double, s string, b boolean"), "k")

    def expr(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice(["i", "r", "s", "b", "k", "NULL", "TRUE", "2", "-3", "2.5", "0", "'a'", "'a%'", "'%b'", "'_\\b'"])
        a, b, c = (expr(depth - 1) for _ in range(3))
        return r.choice([f"({a} + {b})", f"({a} - {b})", f"({a} * {b})", f"({a} / {b})", f"({a} % {b})", f"({a} = {b})", f"({a} <> {b})", f"({a} < {b})", f"({a} >= {b})", f"({a} AND {b})", f"({a} OR {b})", f"(NOT {a})", f"(- {a})", f"({a} IS NULL)", f"({a} IS NOT NULL)", f"({a} LIKE {b})", f"({a} NOT LIKE {b})", f"({a} BETWEEN {b} AND {c})", f"({a} NOT BETWEEN {b} AND {c})"])

    for strict in (False, True) * 6:
        db.strict_between = strict
        items = [expr(3) for _ in range(25)]
        s = parse(f"SELECT k, {', '.join(f'{e} AS e{i}' for i, e in enumerate(items))} FROM t")
        got = {row[0]: row[1:] for row in db.run(s).rows()}
        for row in data:
            at = dict(zip("kirsb", row, strict=True))
            want = tuple(evaluate(i.expr, lambda _, n, at=at: at[n], strict) for i in s.items[1:])
            for e, g, w in zip(items, got[row[0]], want, strict=True):
                same = g == w and isinstance(g, bool) == isinstance(w, bool) or isinstance(g, float) and isinstance(w, float) and (math.isclose(g, w) or g != g and w != w)
                assert same, (e, at, g, w)


def test_a_folder_that_is_no_local_disk(spark, tmp_path, monkeypatch):
    """Publishing by rename, as on a cluster's file system: whole files, and never over one that is there."""
    from larkspur.sources import files

    real = files.Folder.__init__

    def remote(self, *a):
        real(self, *a)
        self.local = None

    monkeypatch.setattr(files.Folder, "__init__", remote)
    folder = files.Folder(spark, f"file://{tmp_path}/f")
    assert folder.publish("_log/1.json", "é") and folder.read("_log/1.json") == "é"
    assert not folder.publish("_log/1.json", "other") and folder.names("_log") == ["1.json"]
    db = Engine(spark, f"file://{tmp_path}/db")
    create(db)
    assert rows(Engine(spark, f"file://{tmp_path}/db"), "SELECT * FROM parcel") == PARCELS


def test_bulk_loading(db, spark):
    db.execute("CREATE TABLE crate (k INTEGER PRIMARY KEY, owner TEXT NOT NULL, litres REAL DEFAULT 0.5); CREATE TABLE memo (line TEXT)")
    assert db.load("crate", spark.createDataFrame([(8, "kim", 1), (5, "lou", 1)], "K long, owner string, unused int")) == 2
    assert rows(db, "SELECT * FROM crate") == [(5, "lou", 0.5), (8, "kim", 0.5)]
    for frame, kind in [(spark.createDataFrame([(8, "ida")], "k long, owner string"), E.NotUnique), (spark.createDataFrame([(6, None)], "k long, owner string"), E.NotNull), (spark.createDataFrame([(6, 2.5)], "k long, owner double"), E.TypeMismatch)]:
        with pytest.raises(kind):
            db.load("crate", frame)
    assert db.load("memo", spark.createDataFrame([("one",), ("two",)], "line string")) == 2
    db.query("INSERT INTO memo VALUES ('last')")
    assert [r[0] for r in rows(db, "SELECT line FROM memo")][-1] == "last" and len(rows(db, "SELECT * FROM crate")) == 2
    assert db.load("crate", spark.createDataFrame([], "k long, owner string")) == 0


def test_command_line(spark, tmp_path, capsys):
    from larkspur.__main__ import main, printed

    assert main(["unheard of"]) == 1
    assert main(["sql", str(tmp_path / "db"), "CREATE TABLE box (k INTEGER PRIMARY KEY, shut BOOLEAN); INSERT INTO box VALUES (31, FALSE); SELECT * FROM box; EXPLAIN SELECT * FROM box"]) == 0
    assert capsys.readouterr().out.splitlines() == ["ok", "1 row(s)", "k   shut ", "--  -----", "31  false", "(1 rows)", "Project k, shut", "  SeqScan box"]
    assert main(["sql", str(tmp_path / "db"), "SELECT lid FROM box"]) == 1
    assert printed(["b"], [(None,), (b"xyz",)]).splitlines()[2:4] == ["NULL     ", "<3 bytes>"]
