"""Queries over the driver's tables, one or more for each operator, each with SQL that DuckDB can run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __main__ as command
from .engine import Engine
from .errors import CommitConflict, EngineError, NotNull, NotUnique, SqlError
from .plans import syntax

#: Table and the column that its rows are ordered by, where it has one.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id", "documents": "doc_id"}

#: Name -> (statement, SQL for DuckDB; None: the same text).
SELECTS: dict[str, tuple[str, str | None]] = {
    "flagship": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000.0 AND o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "scan_seq": ("SELECT * FROM nation", None),
    "scan_pk_point": ("SELECT * FROM orders WHERE o_orderkey = 1234", None),
    "scan_pk_range": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND 200 > o_orderkey AND o_orderstatus = 'P'", None),
    "scan_index": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", None),
    "project_alias": ("SELECT c_custkey AS k, c_acctbal balance FROM customer", None),
    "filter_3vl_null": ("SELECT o_orderkey FROM orders_null WHERE o_orderstatus <> 'F'", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') <> 'F'"),
    "filter_or_not": ("SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0 OR c_mktsegment = 'BUILDING')", None),
    "filter_is_null": ("SELECT o_orderkey FROM orders_null WHERE o_orderstatus IS NULL", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL"),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND p_type NOT LIKE 'E_ONOMY'", None),
    "filter_between": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02::DOUBLE AND 0.08::DOUBLE"),
    "filter_truthiness": ("SELECT n_nationkey, n_name AND TRUE AS a, n_name OR n_regionkey AS b, NOT n_regionkey AS c FROM nation WHERE n_regionkey OR NOT n_name OR n_nationkey = 5", "SELECT n_nationkey, NULL::BOOLEAN AS a, CASE WHEN n_regionkey <> 0 THEN true END AS b, n_regionkey = 0 AS c FROM nation WHERE n_regionkey <> 0 OR n_nationkey = 5"),
    "filter_truthy_number": ("SELECT n_nationkey FROM nation WHERE n_regionkey", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 0"),
    "filter_cross_kind": ("SELECT n_nationkey FROM nation WHERE NOT n_name = 1 OR n_regionkey = 1.0", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1"),
    "expr_int_div_mod": ("SELECT o_orderkey, o_orderkey / (o_custkey % 7) AS q, o_orderkey % (o_custkey % 7) AS r FROM orders", "SELECT o_orderkey, o_orderkey // nullif(o_custkey % 7, 0) AS q, o_orderkey % nullif(o_custkey % 7, 0) AS r FROM orders"),
    "expr_neg_div": ("SELECT o_orderkey, -o_orderkey / 7 AS q, -o_orderkey % 7 AS r FROM orders", "SELECT o_orderkey, (0 - o_orderkey) // 7 AS q, (0 - o_orderkey) % 7 AS r FROM orders"),
    "expr_real": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS rev FROM lineitem", None),
    "expr_real_div": ("SELECT s_suppkey, s_acctbal / (s_nationkey - 3) AS x, s_acctbal % 7 AS m FROM supplier", "SELECT s_suppkey, s_acctbal / nullif(s_nationkey - 3, 0) AS x, CASE WHEN s_acctbal < 0 THEN -fmod(-s_acctbal, 7) ELSE fmod(s_acctbal, 7) END AS m FROM supplier"),
    "expr_unary": ("SELECT n_nationkey, +n_regionkey * -n_nationkey AS x, NOT n_regionkey = 2 AS b FROM nation", "SELECT n_nationkey, n_regionkey::BIGINT * (0 - n_nationkey) AS x, NOT n_regionkey = 2 AS b FROM nation"),
    "distinct_one": ("SELECT DISTINCT o_orderstatus FROM orders", None),
    "distinct_nulls": ("SELECT DISTINCT o_orderstatus AS s FROM orders_null", "SELECT DISTINCT nullif(o_orderstatus, 'P') AS s FROM orders"),
    "distinct_topn": ("SELECT DISTINCT c_nationkey FROM customer ORDER BY c_nationkey LIMIT 5", None),
    "distinct_foreign_order": ("SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_custkey LIMIT 3", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY min(c_custkey) LIMIT 3"),
    "distinct_limit": ("SELECT DISTINCT o_orderstatus, o_custkey FROM orders LIMIT 40", "SELECT o_orderstatus, o_custkey FROM orders GROUP BY ALL ORDER BY min(o_orderkey) LIMIT 40"),
    "distinct_order_ties": ("SELECT DISTINCT o_custkey FROM orders ORDER BY o_orderstatus DESC LIMIT 30", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY max(o_orderstatus) DESC, arg_max(-o_orderkey, (o_orderstatus, -o_orderkey)) DESC LIMIT 30"),
    "select_all": ("SELECT ALL r_name FROM region", "SELECT r_name FROM region"),
    "topn_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None),
    "order_full": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey", None),
    "order_deep_offset": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 60 OFFSET 3000", None),
    "order_nulls": ("SELECT o_orderkey FROM orders_null ORDER BY o_orderstatus, o_orderkey LIMIT 50", "SELECT o_orderkey FROM orders ORDER BY nullif(o_orderstatus, 'P') NULLS FIRST, o_orderkey LIMIT 50"),
    "order_nulls_desc": ("SELECT o_orderkey FROM orders_null ORDER BY o_orderstatus DESC, o_orderkey DESC LIMIT 7000", "SELECT o_orderkey FROM orders ORDER BY nullif(o_orderstatus, 'P') DESC NULLS LAST, o_orderkey DESC LIMIT 7000"),
    "order_ordinal": ("SELECT o_custkey, o_orderkey FROM orders ORDER BY 1 DESC, 2 LIMIT 20", None),
    "order_expression": ("SELECT s_suppkey FROM supplier ORDER BY s_suppkey % 7 DESC, -s_suppkey LIMIT 12", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey % 7 DESC, 0 - s_suppkey LIMIT 12"),
    "limit_pk": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 3", None),
    "limit_row_order": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' LIMIT 25", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25"),
    "offset_alone": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20", None),
    "join_equi": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_residual": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20", None),
    "join_theta": ("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_regionkey > b.r_regionkey", None),
    "join_null_key": ("SELECT a.k AS a, b.k AS b FROM nation_null a INNER JOIN region_null b ON a.k = b.k", "SELECT nullif(a.n_regionkey, 1) AS a, nullif(b.r_regionkey, 1) AS b FROM nation a JOIN region b ON nullif(a.n_regionkey, 1) = nullif(b.r_regionkey, 1)"),
    "join_3way": ("SELECT n.n_name, r.r_name, s.s_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE s.s_acctbal > 0", None),
    "join_self": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_int_real": ("SELECT a.p_partkey, b.p_partkey AS bk FROM part a JOIN part b ON a.p_size = b.p_retailprice - 900", None),
    "join_expr_key": ("SELECT a.c_custkey, b.s_suppkey FROM customer a JOIN supplier b ON a.c_custkey % 100 = b.s_suppkey + 1", None),
    "join_cross": ("SELECT a.r_name, b.r_name AS other FROM region a JOIN region b ON TRUE", "SELECT a.r_name, b.r_name AS other FROM region a CROSS JOIN region b"),
    "join_filter_order": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000 AND o.o_orderstatus = 'F' ORDER BY o.o_totalprice DESC, 1 LIMIT 20", None),
}


def engine_over(spark: SparkSession, sf_dir: str, path: str | None = None) -> Engine:
    """An engine with the driver's tables attached, and three whose columns hold nulls."""
    e = Engine(spark, path)
    for name, key in KEYS.items():
        e.attach(name, f"{sf_dir}/{name}.parquet", key)
    at = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    e.attach("orders_null", lambda: at("orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))), "o_orderkey")
    e.attach("nation_null", lambda: at("nation").select(F.nullif("n_regionkey", F.lit(1)).alias("k")))
    e.attach("region_null", lambda: at("region").select(F.nullif("r_regionkey", F.lit(1)).alias("k")))
    return e


def _select(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine_over(spark, sf_dir).query(sql).frame


# --- statements that write: a copy of supplier in a store, changed, and read back ------------------------------------

SUPPLIER = "CREATE TABLE s (s_suppkey INTEGER PRIMARY KEY, s_name TEXT NOT NULL, s_nationkey INTEGER, s_acctbal REAL)"
READ = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM s"


def _folder(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(top or '/tmp/larkspur-shared').rstrip('/')}/store-{uuid.uuid4().hex}"


def _changed(*statements: str, read: str = READ, create: str = SUPPLIER, load: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, _folder(spark))
        e.execute(create)
        if load:
            e.load("s", spark.read.parquet(f"{sf_dir}/supplier.parquet"))
        for s in statements:
            e.execute(s)
        return e.query(read).frame

    return run


CHANGES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "dml_update": (_changed("UPDATE s SET s_acctbal = s_acctbal + 100 WHERE s_nationkey = 3"), "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal FROM supplier"),
    "dml_update_old_row": (_changed("UPDATE s SET s_acctbal = s_nationkey, s_nationkey = s_suppkey % 5"), "SELECT s_suppkey, s_name, s_suppkey % 5 AS s_nationkey, s_nationkey::DOUBLE AS s_acctbal FROM supplier"),
    "dml_delete": (_changed("DELETE FROM s WHERE s_acctbal < 0"), "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier WHERE NOT coalesce(s_acctbal < 0, false)"),
    "dml_pk_move": (_changed("UPDATE s SET s_suppkey = s_suppkey + 1000000 WHERE s_suppkey % 2 = 0"), "SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1000000 ELSE s_suppkey END AS s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier"),
    "dml_insert": (_changed("INSERT INTO s (s_name, s_acctbal) VALUES ('new', 1), ('newer', 2.5)"), "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + i, n, NULL, b FROM (VALUES (1, 'new', 1.0::DOUBLE), (2, 'newer', 2.5::DOUBLE)) t(i, n, b)"),
    "insert_defaults": (_changed("INSERT INTO d (id) VALUES (1), (2)", "INSERT INTO d VALUES (NULL, FALSE, NULL)", create="CREATE TABLE d (id INTEGER PRIMARY KEY, active BOOLEAN DEFAULT TRUE, note TEXT DEFAULT 'none')", load=False, read="SELECT * FROM d"), "SELECT * FROM (VALUES (1::BIGINT, true, 'none'), (2, true, 'none'), (3, false, NULL)) t(id, active, note)"),
    "constraint_unique": (_changed("CREATE UNIQUE INDEX by_name ON s (s_name)"), "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier"),
    "txn_rollback": (_changed("BEGIN; DELETE FROM s; ROLLBACK"), "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier"),
    "txn_commit": (_changed("BEGIN; UPDATE s SET s_acctbal = 0; DELETE FROM s WHERE s_suppkey >= 10; COMMIT"), "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM supplier WHERE s_suppkey < 10"),
    "txn_own_writes": (_changed("BEGIN; UPDATE s SET s_acctbal = -1 WHERE s_suppkey < 5"), "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, CASE WHEN s_suppkey < 5 THEN -1 ELSE s_acctbal END AS s_acctbal FROM supplier"),
    "vacuum_keeps_rows": (_changed("UPDATE s SET s_acctbal = s_acctbal * 2; DELETE FROM s WHERE s_nationkey = 0; VACUUM s"), "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_nationkey <> 0"),
}


SAME = "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier"


def _refused(*statements: str, first: str = "") -> Callable[[SparkSession, str], DataFrame]:
    """What is left after statements that constraints refuse; one that passes is an error.  ``first`` must pass."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, _folder(spark))
        e.execute(SUPPLIER)
        e.load("s", spark.read.parquet(f"{sf_dir}/supplier.parquet"))
        e.execute(first)
        for s in statements:
            try:
                e.execute(s)
            except (NotNull, NotUnique):
                continue
            raise AssertionError(f"not refused: {s}")
        return e.query(READ).frame

    return run


def _beside(first: str, other: str, last: str = "") -> Callable[[SparkSession, str], DataFrame]:
    """What an engine reads after ``first``, while another has run ``other`` and a checkpoint; ``last`` follows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        a, b = Engine(spark, path), Engine(spark, path)
        a.execute(SUPPLIER)
        a.load("s", spark.read.parquet(f"{sf_dir}/supplier.parquet"))
        a.execute(first)
        b.execute(other)
        b.checkpoint()
        if last:
            a.execute(last)
        return a.query(READ).frame

    return run


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What VACUUM counts in a transaction, and what is there after it is rolled back."""
    e = Engine(spark, _folder(spark))
    e.execute(SUPPLIER)
    e.load("s", spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    e.execute("DELETE FROM s WHERE s_nationkey = 1; BEGIN; DELETE FROM s WHERE s_nationkey = 2")
    counts = [e.query("VACUUM s").affected, e.query("VACUUM s").affected]
    e.execute("ROLLBACK")
    left = e.query(READ).frame.count()
    return spark.createDataFrame([(counts[0], counts[1], left)], "swept long, again long, rows_left long")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by an index of a stored table, whose files have a Bloom filter of it."""
    e = Engine(spark, _folder(spark))
    e.execute("CREATE TABLE c (c_custkey INTEGER PRIMARY KEY, c_name TEXT, c_mktsegment TEXT)")
    e.load("c", spark.read.parquet(f"{sf_dir}/customer.parquet"))
    e.execute("CREATE INDEX by_segment ON c (c_mktsegment)")
    assert "IndexScan c using by_segment" in e.query("EXPLAIN SELECT * FROM c WHERE c_mktsegment = 'BUILDING'").plan
    return e.query("SELECT c_custkey, c_name FROM c WHERE c_mktsegment = 'BUILDING'").frame


CHANGES |= {
    "constraint_violations": (_refused("INSERT INTO s VALUES (1, 'again', 0, 0)", "INSERT INTO s (s_name) VALUES (NULL)", "UPDATE s SET s_name = NULL WHERE s_suppkey = 2", "UPDATE s SET s_suppkey = 3"), SAME),
    "txn_snapshot_after_vacuum": (_beside("BEGIN", "DELETE FROM s WHERE s_nationkey < 9; UPDATE s SET s_acctbal = 0; VACUUM"), SAME),
    "txn_reopened": (_beside("DELETE FROM s WHERE s_nationkey < 9; BEGIN; DELETE FROM s", "VACUUM", "ROLLBACK"), f"{SAME} WHERE s_nationkey >= 9"),
    "txn_ddl_rollback": (_beside("BEGIN; CREATE TABLE other (x INTEGER); CREATE INDEX i ON s (s_name); ROLLBACK", "CREATE TABLE other (y TEXT)"), SAME),
    "vacuum_in_txn": (_swept, "SELECT count(*) FILTER (s_nationkey = 1) AS swept, 0::BIGINT AS again, count(*) FILTER (s_nationkey <> 1) AS rows_left FROM supplier"),
    "scan_index_stored": (_indexed, "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
}


def _indexed_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by an index whose rows were changed, removed and added since it was made."""
    e = Engine(spark, _folder(spark))
    e.execute(SUPPLIER)
    e.load("s", spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    e.execute("CREATE INDEX by_nation ON s (s_nationkey)")
    e.execute("UPDATE s SET s_nationkey = 3 WHERE s_nationkey = 4; DELETE FROM s WHERE s_nationkey = 3 AND s_suppkey % 2 = 0")
    e.execute("INSERT INTO s (s_name, s_nationkey) VALUES ('late', 3), ('later', 4)")
    return e.query(f"{READ} WHERE s_nationkey = 3").frame


def _conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of two transactions that were open at once: the first to commit wins, the other is refused."""
    path = _folder(spark)
    a, b = Engine(spark, path), Engine(spark, path)
    a.execute(SUPPLIER)
    a.load("s", spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    a.execute("BEGIN; DELETE FROM s WHERE s_nationkey < 9")
    b.execute("BEGIN; UPDATE s SET s_acctbal = 0; COMMIT")
    try:
        a.execute("COMMIT")
    except CommitConflict:
        return a.query(READ).frame
    raise AssertionError("two writers committed one version")


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine finds and reads where a writer stopped within a transaction, and what a checkpoint clears away."""
    path = _folder(spark)
    e = Engine(spark, path)
    e.execute(SUPPLIER)
    e.load("s", spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    e.execute("BEGIN; UPDATE s SET s_acctbal = 0")
    again = Engine(spark, path)
    found, cleared = again.recovery_report(), again.checkpoint()
    after = Engine(spark, path)
    left = after.query("SELECT s_suppkey FROM s WHERE s_acctbal <> 0").frame.count()
    row = (found["version"], found["uncommitted_folders"] > 0, cleared == found["uncommitted_folders"], after.recovery_report()["uncommitted_folders"], left)
    return spark.createDataFrame([row], "version long, found_some boolean, cleared_all boolean, still long, rows_left long")


def _checkpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine reads that opens a store after more commits than a checkpoint keeps."""
    path = _folder(spark)
    e = Engine(spark, path)
    e.execute("CREATE TABLE r (r_regionkey INTEGER PRIMARY KEY, r_name TEXT)")
    e.load("r", spark.read.parquet(f"{sf_dir}/region.parquet"))
    for k in range(11):
        e.execute(f"INSERT INTO r VALUES ({100 + k}, 'new')")
    e.execute("VACUUM r; DELETE FROM r WHERE r_regionkey = 1")
    assert e.checkpoint() == 0  # ten states back, all files are named still
    e.execute("; ".join(f"DELETE FROM r WHERE r_regionkey = {k}" for k in range(100, 110)))
    assert e.checkpoint() > 0
    return Engine(spark, path).query("SELECT r_regionkey, r_name FROM r").frame


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``strict_between`` any null makes BETWEEN unknown; by the standard, one bound may decide."""
    e = Engine(spark, strict_between=True)
    e.attach("nation", f"{sf_dir}/nation.parquet", "n_nationkey")
    return e.query("SELECT n_nationkey, n_nationkey BETWEEN n_regionkey AND NULL AS inside, n_nationkey NOT BETWEEN NULL AND n_regionkey AS outside, n_nationkey BETWEEN 0 AND n_regionkey * 3 AS within FROM nation").frame


def _created_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IF NOT EXISTS leaves a table as it is; without it the name is refused, as are two tables' keys in one."""
    e = Engine(spark, _folder(spark))
    e.execute("CREATE TABLE r (r_regionkey INTEGER PRIMARY KEY, r_name TEXT)")
    e.load("r", spark.read.parquet(f"{sf_dir}/region.parquet"))
    e.execute("CREATE TABLE IF NOT EXISTS r (other TEXT)")
    for bad in ("CREATE TABLE R (x INTEGER)", "CREATE TABLE two (x INTEGER PRIMARY KEY, y INTEGER PRIMARY KEY)"):
        try:
            e.execute(bad)
        except EngineError:
            continue
        raise AssertionError(f"not refused: {bad}")
    return e.query("SELECT * FROM r").frame


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that is read, spelled out and read again."""
    sql = "select o_orderkey k, -(o_custkey+1)*2 as x from orders where not (o_totalprice<=100000 or o_orderstatus like 'F%') and o_custkey between 10 and 400 order by 2 desc,k limit 40 offset 2"
    return engine_over(spark, sf_dir).query(str(syntax.parse(sql))).frame


#: Statement -> the piece of it that the error must point at.
BROKEN = [("SELECT FROM nation", "FROM"), ("SELECT n_name nation WHERE", "WHERE"), ("DELETE nation", "nation"), ("INSERT INTO nation VALUES 1", "1"), ("SELECT 'é', 1 FROM nation LIMIT x", "x"), ("UPDATE nation SET = 4", "="), ("SELECT 1 +* 2 FROM nation", "* 2")]


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for sql, _ in BROKEN:
        try:
            syntax.parse(sql)
        except SqlError as e:
            out.append((sql, e.at))
    return spark.createDataFrame(out, "statement string, at_byte long")


#: Statement -> the class of its error, over the attached tables and an empty store.
MISTAKES = [("SELECT x FROM nation", "UnknownColumn"), ("SELECT * FROM nowhere", "UnknownTable"), ("SELECT n_name FROM nation a JOIN nation b ON TRUE", "AmbiguousColumn"), ("COMMIT", "NoOpenTransaction"), ("DELETE FROM nation", "Unsupported"), ("CREATE TABLE t (x INTEGER); CREATE TABLE t (x INTEGER)", "TableExists"), ("INSERT INTO t VALUES ('a')", "TypeMismatch"), ("BEGIN; BEGIN", "TransactionAlreadyOpen")]


def _mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, out = engine_over(spark, sf_dir, _folder(spark)), []
    for sql, _ in MISTAKES:
        try:
            e.execute(sql)
        except EngineError as error:
            out.append((sql, type(error).__name__))
    return spark.createDataFrame(out, "statement string, error string")


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's table of a result."""
    out = engine_over(spark, sf_dir).query("SELECT r_name, r_regionkey > 2 AS late FROM region ORDER BY r_regionkey")
    lines = command.printed(out.columns, out.rows()).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


CHANGES |= {
    "index_violations": (_refused("CREATE UNIQUE INDEX by_nation ON s (s_nationkey)", "CREATE UNIQUE INDEX by_both ON s (s_nationkey, s_acctbal)", first="UPDATE s SET s_nationkey = 7, s_acctbal = s_suppkey / 2"), "SELECT s_suppkey, s_name, 7::BIGINT AS s_nationkey, (s_suppkey // 2)::DOUBLE AS s_acctbal FROM supplier"),
    "index_keeps_unique": (_refused("INSERT INTO s (s_name) VALUES ('new'), ('new')", "UPDATE s SET s_name = 'same'", first="CREATE UNIQUE INDEX by_name ON s (s_name)"), SAME),
    "index_after_changes": (_indexed_after_changes, "SELECT s_suppkey, s_name, 3::BIGINT AS s_nationkey, s_acctbal FROM supplier WHERE s_nationkey IN (3, 4) AND s_suppkey % 2 <> 0 UNION ALL SELECT max(s_suppkey) + 1, 'late', 3, NULL FROM supplier"),
    "txn_conflict": (_conflict, "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM supplier"),
    "recovery": (_recovered, "SELECT 2::BIGINT AS version, true AS found_some, true AS cleared_all, 0::BIGINT AS still, count(*) FILTER (s_acctbal <> 0) AS rows_left FROM supplier"),
    "checkpoint": (_checkpointed, "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 110, 'new'"),
    "create_if_not_exists": (_created_once, "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"),
    "between_strict": (_strict, "SELECT n_nationkey, NULL::BOOLEAN AS inside, NULL::BOOLEAN AS outside, n_nationkey <= n_regionkey * 3 AS within FROM nation"),
    "rendered": (_rendered, "SELECT o_orderkey AS k, -(o_custkey + 1) * 2 AS x FROM orders WHERE NOT (o_totalprice <= 100000 OR o_orderstatus LIKE 'F%') AND o_custkey BETWEEN 10 AND 400 ORDER BY 2 DESC, k LIMIT 40 OFFSET 2"),
    "error_places": (_broken, "SELECT statement, (strlen(split_part(statement, piece, 1)))::BIGINT AS at_byte FROM (VALUES " + ", ".join("('{}', '{}')".format(a.replace("'", "''"), b) for a, b in BROKEN) + ") t(statement, piece)"),
    "error_kinds": (_mistakes, "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(a.replace("'", "''"), b) for a, b in MISTAKES) + ") t(statement, error)"),
    "printed_table": (_printed, "WITH r AS (SELECT r_regionkey, r_name, CASE WHEN r_regionkey > 2 THEN 'true' ELSE 'false' END AS late FROM region), w AS (SELECT greatest(6, max(length(r_name))) AS a, greatest(4, max(length(late))) AS b, count(*) AS n FROM r) SELECT 0::BIGINT AS line_no, rpad('r_name', a::INTEGER, ' ') || '  ' || rpad('late', b::INTEGER, ' ') AS line FROM w UNION ALL SELECT 1, repeat('-', a) || '  ' || repeat('-', b) FROM w UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_regionkey), rpad(r_name, a::INTEGER, ' ') || '  ' || rpad(late, b::INTEGER, ' ') FROM r, w UNION ALL SELECT 2 + n, '(' || n || ' rows)' FROM w"),
}


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, _folder(spark))
    e.execute("CREATE TABLE b (x INTEGER); CREATE TABLE a (x INTEGER)")
    return spark.createDataFrame([(n,) for n in e.tables()], "name string")


def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir)
    plan = e.query("EXPLAIN SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 5 ORDER BY 1 LIMIT 3").plan
    return spark.createDataFrame([(i, line) for i, line in enumerate(plan.splitlines())], "line_no long, line string")


_PLAN = "Limit n=3|  Project o_orderkey|    Sort #0 ASC (top-3)|      Filter (#3 > 5)|        HashJoin #1 = #0|          build:|            SeqScan orders|          probe:|            SeqScan customer"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _select(sql) for name, (sql, _) in SELECTS.items()}
    return found | {name: run for name, (run, _) in CHANGES.items()} | {"catalog_listing": _listing, "explain": _explain}


def oracle_sql() -> dict[str, str]:
    found = {name: other or sql for name, (sql, other) in SELECTS.items()}
    found |= {name: sql for name, (_, sql) in CHANGES.items()}
    lines = ", ".join(f"({i}::BIGINT, '{line}')" for i, line in enumerate(_PLAN.split("|")))
    return found | {"catalog_listing": "SELECT * FROM (VALUES ('a'), ('b')) t(name)", "explain": f"SELECT * FROM (VALUES {lines}) t(line_no, line)"}
