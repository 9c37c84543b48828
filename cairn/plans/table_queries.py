"""Queries over tables that they make themselves: layouts, CSV files, services and logs, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import metrics
from cairn.engine import Engine, Result
from cairn.functions import spatial as G
from cairn.operators import conflicts as C
from cairn.operators import spatial
from cairn.plans.catalog import LAYOUTS
from cairn.service import Service
from cairn.sources import csvio, sortedfile
from cairn.txn import LockManager, Simulator, Transaction
from cairn.workspace import workspace

Query = Callable[[SparkSession, str], DataFrame]
#: Rows of a file of these tables: few, so that layouts deal rows to several files even on small data.
FILE_ROWS = 4000

_ORDERS = "CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_X, _Y = "CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE)", "CAST(CAST(c_nationkey AS FLOAT) AS DOUBLE)"
_DIST = f"sqrt(power({_X} - 1000.0, 2) + power({_Y} - 12.0, 2))"
_LOG = "(SELECT event_id % 50 AS tx, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'X' ELSE 'S' END AS op, user_id AS resource FROM events)"
_PAIRS = f"{_LOG} a JOIN {_LOG} b ON a.resource = b.resource AND a.seq > b.seq AND a.tx <> b.tx AND (a.op = 'X' OR b.op = 'X')"
_KIND = "CASE WHEN a.op = 'X' AND b.op = 'X' THEN 'W-W' WHEN a.op = 'X' THEN 'W-R' ELSE 'R-W' END"


def fresh(spark: SparkSession, **more: object) -> Engine:
    """An engine with an empty warehouse."""
    return Engine(spark, f"{workspace(spark)}/warehouse-{uuid.uuid4().hex}", file_rows=FILE_ROWS, **more)


def orders(spark: SparkSession, sf_dir: str, index: str) -> Engine:
    """An engine whose table t holds the orders in a layout."""
    e = fresh(spark)
    e.create_from("t", spark.read.parquet(f"{sf_dir}/orders.parquet").drop("o_orderdate"), index, "o_orderkey")
    return e


def customers(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose RTREE table t holds the customers at (balance, nation)."""
    e = fresh(spark)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    e.create_from("t", rows.select("c_custkey", F.col("c_acctbal").alias("lon"), F.col("c_nationkey").cast("double").alias("lat")), "RTREE", "lon")
    return e


def _of_orders(index: str, text: str) -> Query:
    return lambda spark, sf_dir: orders(spark, sf_dir, index).query(text)


def _deleted(index: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = orders(spark, sf_dir, index)
        e.run("DELETE FROM t WHERE o_orderkey = 101; DELETE FROM t WHERE o_custkey = 7")
        return e.scan("t")

    return run


def _of_customers(text: str) -> Query:
    return lambda spark, sf_dir: customers(spark, sf_dir).query(text)


def rtree_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The endpoint's root box and number of points of an RTREE table."""
    found = Service(customers(spark, sf_dir)).boxes("t")
    root = next(n for n in found["mbrs"] if n["level"] == 0)
    return spark.createDataFrame([(*[root[c] for c in ("min_x", "min_y", "max_x", "max_y")], found["n_points"])], "min_x double, min_y double, max_x double, max_y double, n_points long")


def search_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by a condition made from the DataFrame."""
    return orders(spark, sf_dir, "HEAP").search("t", lambda df: (df.o_totalprice > 100000.0) & (df.o_orderstatus == "F"))


def _placed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows with their places in the order that ``df`` has."""
    path = f"{workspace(spark)}/sorted-{uuid.uuid4().hex}"
    sortedfile.write(df, path)
    return sortedfile.read(spark, path)


def sorted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a sorted file, read back with their places."""
    path = f"{workspace(spark)}/sorted-{uuid.uuid4().hex}"
    sortedfile.write(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_totalprice", "o_orderkey"), path, "o_totalprice")
    return sortedfile.read(spark, path)


def order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of rows after ORDER BY ... DESC of the dialect."""
    return _placed(spark, orders(spark, sf_dir, "HEAP").query("SELECT o_orderpriority, o_orderkey FROM t ORDER BY o_orderpriority DESC")).select("o_orderkey", "place")


def _scan_places(index: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = orders(spark, sf_dir, index)
        e.run("INSERT INTO t VALUES (-5, 1, 'F', 0.5, 'x')")
        return _placed(spark, e.scan("t")).select("o_orderkey", "place")

    return run


def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after its warehouse was opened anew, with rows inserted before and after."""
    e = orders(spark, sf_dir, "BPLUSTREE")
    e.run("INSERT INTO t VALUES (-5, 1, 'F', 0.5, 'x')")
    again = Engine(spark, e.catalog.warehouse)
    again.run("INSERT INTO t VALUES (-6, 2)")
    return again.query("SELECT * FROM t WHERE o_orderkey BETWEEN -9 AND 20")


def _csv(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> str:
    path = f"{workspace(spark)}/csv-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).write.options(header=True, escape='"').csv(path)
    return path


def csv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through a CSV file, columns by name, text cut to its size."""
    path = _csv(spark, sf_dir, "customer", ["c_acctbal", "c_name", "c_custkey", "c_mktsegment"])
    e = fresh(spark)
    e.run(f"CREATE TABLE t (c_custkey INT INDEX HASH, c_mktsegment TEXT, c_acctbal FLOAT) FROM FILE '{path}'", {"c_mktsegment": 5})
    return e.query("SELECT * FROM t")


def csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions through a CSV file with commas, quotes and line breaks in quotes."""
    path = f"{workspace(spark)}/csv-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", F.concat(F.lit('a,"b"\n'), "r_name").alias("note"))
    rows.write.options(header=True, escape='"').csv(path)
    e = fresh(spark)
    e.run(f"CREATE TABLE t (r_regionkey INT, note TEXT) FROM FILE '{path}'")
    return e.query("SELECT * FROM t")


def csv_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text read as INT is 0, INT as FLOAT fits, and whole numbers beyond INT skip the line."""
    path = f"{workspace(spark)}/csv-{uuid.uuid4().hex}"
    big = F.when(F.col("n_nationkey") == 3, F.lit(9999999999)).otherwise(F.col("n_nationkey")).alias("k")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(big, F.col("n_name").alias("v"), F.col("n_regionkey").alias("f")).write.options(header=True).csv(path)
    e = fresh(spark)
    e.run(f"CREATE TABLE t (k INT, v INT, f FLOAT) FROM FILE '{path}'")
    return e.query("SELECT * FROM t")


def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types suggested for a CSV file of suppliers."""
    found = csvio.infer(spark, _csv(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_acctbal"]))
    return spark.createDataFrame([(c["name"], c["type"], c.get("size", 0)) for c in found["columns"]], "name string, type string, size int")


def service_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a script's last statement, as the endpoint answers."""
    found = Service(orders(spark, sf_dir, "HASH")).query("INSERT INTO t VALUES (-1, 5, 'F', 1.0, 'x'); DELETE FROM t WHERE o_orderstatus = 'O'; SELECT o_orderstatus, COUNT(*) AS n FROM t GROUP BY o_orderstatus")
    return spark.createDataFrame([(r["o_orderstatus"], r["n"], found["stats"]["writes"]) for r in found["rows"]], "o_orderstatus string, n long, writes long")


def service_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the endpoint counts: rows read, groups and matches."""
    e = fresh(spark)
    for name in ("nation", "region"):
        e.register(name, f"{sf_dir}/{name}.parquet")
    s = Service(e)
    grouped = s.query("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey")["stats"]
    joined = s.query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")["stats"]
    return spark.createDataFrame([(grouped["reads"], grouped["groups"], joined["reads"], joined["matches"])], "group_reads long, groups long, join_reads long, matches long")


def service_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, their index and key, of which one was dropped."""
    e = fresh(spark)
    for index in LAYOUTS[:4]:
        e.create_from(f"t_{index.lower()}", spark.read.parquet(f"{sf_dir}/region.parquet"), index, "r_regionkey")
    s = Service(e)
    s.drop("t_heap")
    return spark.createDataFrame([(n, s.table(n)["index"], s.table(n)["key_column"]) for n in s.tables()["tables"]], "name string, index string, key_column string")


def hooked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hook that answers a DELETE in the engine's stead."""
    e = fresh(spark, hooks={"Delete": lambda s: Result("DELETE", affected=-1)})
    e.create_from("t", spark.read.parquet(f"{sf_dir}/region.parquet"), "HEAP", "r_regionkey")
    done = e.run("DELETE FROM t WHERE r_regionkey = 1")[0].affected
    return e.query("SELECT COUNT(*) AS n FROM t").withColumn("affected", F.lit(done))


def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, enlargement and distance of the leaf boxes of customers."""
    leaves = spatial.leaf_boxes(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_acctbal", "c_nationkey", "c_custkey", 4, 4)
    box = F.struct("min_x", "min_y", "max_x", "max_y")
    other = F.struct(*[F.lit(v).alias(c) for c, v in (("min_x", 0.0), ("min_y", 1.0), ("max_x", 100.0), ("max_y", 2.0))])
    return leaves.select("sl", "tl", F.round(G.box_area(box), 3).alias("area"), F.round(G.box_enlargement(box, other), 3).alias("enlargement"), F.round(G.box_distance(box, 1000.0, 30.0), 6).alias("distance"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select((F.col("event_id") % 50).alias("tx"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "X").otherwise("S").alias("op"), F.col("user_id").alias("resource"))


def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of each kind by resource, counted without listing the pairs."""
    return C.conflict_counts(_log(spark, sf_dir))


def conflicts_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts where each transaction ends 40 requests after its first."""
    log = _log(spark, sf_dir).withColumn("tx", F.floor(F.col("seq") / 20))
    ends = log.groupBy("tx").agg((F.min("seq") + 40).alias("seq"))
    return C.conflicts(log, ends).select("req_tx", "req_seq", "held_tx", "held_seq", "resource", "conflict")


def wait_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users on, or between, cycles of a graph in which a region's nations wait for each other in a ring, but region 0's in a line."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", F.col("n_nationkey").alias("waiter"))
    other = nations.select(F.col("n_regionkey").alias("r"), F.col("waiter").alias("holder"))
    following = nations.join(other, (F.col("r") == F.col("n_regionkey")) & (F.col("holder") > F.col("waiter"))).groupBy("n_regionkey", "waiter").agg(F.min("holder").alias("holder"))
    back = nations.where("n_regionkey > 0").groupBy("n_regionkey").agg(F.max("waiter").alias("waiter"), F.min("waiter").alias("holder"))
    return C.deadlocked(following.unionByName(back).select("waiter", "holder"))


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of transactions that share a table and of one that another's lock keeps out."""
    calm = Simulator().run([Transaction("T1", [("S", "A", None)]), Transaction("T2", [("S", "A", None)])])
    late = Simulator(0.05)
    late.locks.acquire("T0", "A", "X")
    late_report = late.run([Transaction("T3", [("S", "A", None)])])
    found = calm.status | late_report.status
    return spark.createDataFrame([(t, s, len(late_report.conflicts)) for t, s in found.items()], "tx string, status string, conflicts int")


def locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a lock manager grants: sharing, refusal, upgrade."""
    m = LockManager()
    steps = [("share a", m.acquire("a", "t", "S")), ("share b", m.acquire("b", "t", "S")), ("refuse a", m.acquire("a", "t", "X", 0.01))]
    m.release_all("b")
    steps.append(("upgrade a", m.acquire("a", "t", "X", 0.01)))
    return spark.createDataFrame(steps, "step string, granted boolean")


def metrics_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries after saving and reading, averaged."""
    m = metrics.Metrics()
    for n in (10, 20):
        for reads in range(n):
            m.entries.append(metrics.Entry("HASH", "search", n, float(reads), 1.0, reads + 1.0, 0.5))
    path = f"{workspace(spark)}/metrics-{uuid.uuid4().hex}"
    m.save(spark, path)
    return metrics.means(metrics.read(spark, path), ["structure", "operation", "n"], {"reads": "reads", "disk_accesses": "disk_accesses"}, "entries")


def queries() -> dict[str, Query]:
    """Name to query(spark, sf_dir)."""
    point, span = "SELECT * FROM t WHERE o_orderkey = 101", "SELECT * FROM t WHERE o_orderkey BETWEEN 3900 AND 8100"
    found: dict[str, Query] = {}
    for index in LAYOUTS[:4]:
        name = index.lower()
        found |= {f"point_{name}": _of_orders(index, point), f"range_{name}": _of_orders(index, span), f"deleted_{name}": _deleted(index)}
    return found | {
        "join_text_number": lambda spark, sf_dir: orders(spark, sf_dir, "HEAP").query("SELECT COUNT(*) AS n FROM t JOIN t ON o_orderkey = o_orderstatus"),
        "join_self": lambda spark, sf_dir: orders(spark, sf_dir, "HEAP").query("SELECT COUNT(*) AS n FROM t JOIN t ON o_custkey = o_custkey"),
        "radius_rtree": _of_customers("SELECT c_custkey FROM t WHERE at IN (POINT(1000.0, 12.0), RADIUS 300.0)"),
        "knn_rtree": _of_customers("SELECT c_custkey FROM t WHERE at IN (POINT(1000.0, 12.0), K 10)"),
        "scan_rtree": _of_customers("SELECT * FROM t"),
        "rtree_boxes": rtree_boxes,
        "search_callable": search_callable,
        "sorted_file": sorted_file,
        "order_places": order_places,
        "scan_places_sequential": _scan_places("SEQUENTIAL"),
        "scan_places_bplustree": _scan_places("BPLUSTREE"),
        "reopened": reopened,
        "csv_by_name": csv_by_name,
        "csv_quoted": csv_quoted,
        "csv_coerced": csv_coerced,
        "csv_inferred": csv_inferred,
        "service_script": service_script,
        "service_stats": service_stats,
        "service_tables": service_tables,
        "hooked": hooked,
        "box_algebra": box_algebra,
        "conflict_counts": conflict_counts,
        "conflicts_until": conflicts_until,
        "wait_cycles": wait_cycles,
        "simulated": simulated,
        "locked": locked,
        "metrics_saved": metrics_saved,
    }


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    found = {}
    for index in LAYOUTS[:4]:
        name = index.lower()
        found |= {
            f"point_{name}": f"SELECT {_ORDERS} FROM orders WHERE o_orderkey = 101",
            f"range_{name}": f"SELECT {_ORDERS} FROM orders WHERE o_orderkey BETWEEN 3900 AND 8100",
            f"deleted_{name}": f"SELECT {_ORDERS} FROM orders WHERE o_orderkey <> 101 AND o_custkey <> 7",
        }
    place = "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, row_number() OVER (ORDER BY {}) - 1 AS place FROM {}"
    more = "(SELECT o_orderkey, o_orderpriority FROM orders UNION ALL SELECT -5, 'x') o"
    leaves = f"SELECT CAST(sl AS INT) AS sl, CAST(tl AS INT) AS tl, min({_X}) AS min_x, min({_Y}) AS min_y, max({_X}) AS max_x, max({_Y}) AS max_y FROM (SELECT *, ntile(4) OVER (PARTITION BY sl ORDER BY c_nationkey, c_custkey) AS tl FROM (SELECT *, ntile(4) OVER (ORDER BY c_acctbal, c_custkey) AS sl FROM customer) a) b GROUP BY sl, tl"
    area, union = "(max_x - min_x) * (max_y - min_y)", "(greatest(max_x, 100.0) - least(min_x, 0.0)) * (greatest(max_y, 2.0) - least(min_y, 1.0))"
    return found | {
        "join_text_number": "SELECT CAST(0 AS BIGINT) AS n",
        "join_self": "SELECT count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey",
        "radius_rtree": f"SELECT CAST(c_custkey AS INTEGER) AS c_custkey FROM customer WHERE {_DIST} <= 300.0",
        "knn_rtree": f"SELECT CAST(c_custkey AS INTEGER) AS c_custkey FROM customer ORDER BY {_DIST}, c_custkey LIMIT 10",
        "scan_rtree": "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_acctbal AS lon, CAST(c_nationkey AS DOUBLE) AS lat FROM customer",
        "rtree_boxes": f"SELECT min({_X}) AS min_x, min({_Y}) AS min_y, max({_X}) AS max_x, max({_Y}) AS max_y, count(*) AS n_points FROM customer",
        "search_callable": f"SELECT {_ORDERS} FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F'",
        "sorted_file": "SELECT o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders",
        "order_places": place.format("o_orderpriority DESC, o_orderkey DESC", "(SELECT * FROM orders) o"),
        "scan_places_sequential": place.format("o_orderkey", more),
        "scan_places_bplustree": place.format("o_orderkey", more),
        "reopened": f"SELECT {_ORDERS} FROM orders WHERE o_orderkey BETWEEN -9 AND 20 UNION ALL SELECT -5, 1, 'F', 0.5, 'x' UNION ALL SELECT -6, 2, '', 0.0, ''",
        "csv_by_name": "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, left(c_mktsegment, 5) AS c_mktsegment, c_acctbal FROM customer",
        "csv_quoted": "SELECT r_regionkey, 'a,\"b\"' || chr(10) || r_name AS note FROM region",
        "csv_coerced": "SELECT n_nationkey AS k, CAST(0 AS INTEGER) AS v, CAST(n_regionkey AS DOUBLE) AS f FROM nation WHERE n_nationkey <> 3",
        "csv_inferred": "SELECT * FROM (VALUES ('s_suppkey', 'INT', 0), ('s_name', 'TEXT', 24), ('s_acctbal', 'FLOAT', 0)) v(name, type, size)",
        "service_script": "SELECT o_orderstatus, n + CAST(o_orderstatus = 'F' AS BIGINT) AS n, (SELECT count(*) + 1 FROM orders WHERE o_orderstatus = 'O') AS writes FROM (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_orderstatus) g",
        "service_stats": "SELECT (SELECT count(*) FROM nation) AS group_reads, (SELECT count(DISTINCT n_regionkey) FROM nation) AS groups, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS join_reads, (SELECT count(*) FROM nation) AS matches",
        "service_tables": "SELECT * FROM (VALUES ('t_sequential', 'SEQUENTIAL', 'r_regionkey'), ('t_hash', 'HASH', 'r_regionkey'), ('t_bplustree', 'BPLUSTREE', 'r_regionkey')) v(name, index, key_column)",
        "hooked": "SELECT count(*) AS n, CAST(-1 AS INTEGER) AS affected FROM region",
        "box_algebra": f"SELECT sl, tl, round({area}, 3) AS area, round({union} - {area}, 3) AS enlargement, round(sqrt(power(greatest(min_x - 1000.0, 0.0, 1000.0 - max_x), 2) + power(greatest(min_y - 30.0, 0.0, 30.0 - max_y), 2)), 6) AS distance FROM ({leaves}) l",
        "conflict_counts": f"SELECT a.resource, {_KIND} AS conflict, count(*) AS n FROM {_PAIRS} GROUP BY 1, 2",
        "conflicts_until": f"WITH log AS (SELECT seq // 20 AS tx, seq, op, resource FROM {_LOG} l), ends AS (SELECT tx, min(seq) + 40 AS fin FROM log GROUP BY tx) SELECT a.tx AS req_tx, a.seq AS req_seq, b.tx AS held_tx, b.seq AS held_seq, a.resource, {_KIND} AS conflict FROM log a JOIN log b ON a.resource = b.resource AND a.seq > b.seq AND a.tx <> b.tx AND (a.op = 'X' OR b.op = 'X') JOIN ends e ON e.tx = b.tx AND e.fin > a.seq",
        "wait_cycles": "SELECT n_nationkey AS tx FROM nation WHERE n_regionkey > 0",
        "simulated": "SELECT * FROM (VALUES ('T1', 'COMMITTED', 1), ('T2', 'COMMITTED', 1), ('T3', 'ABORTED', 1)) v(tx, status, conflicts)",
        "locked": "SELECT * FROM (VALUES ('share a', true), ('share b', true), ('refuse a', false), ('upgrade a', true)) v(step, granted)",
        "metrics_saved": "SELECT 'HASH' AS structure, 'search' AS operation, CAST(n AS BIGINT) AS n, avg(i) AS reads, avg(i + 1.0) AS disk_accesses, count(*) AS entries FROM (SELECT n, unnest(range(n)) AS i FROM (VALUES (10), (20)) v(n)) r GROUP BY n",
    }
