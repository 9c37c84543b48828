"""The engine's own queries over the given tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import metrics
from cairn.engine import Engine
from cairn.operators import conflicts as C
from cairn.operators import spatial
from cairn.plans import table_queries
from cairn.workspace import workspace

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
Query = Callable[[SparkSession, str], DataFrame]
_X, _Y = "CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE)", "CAST(CAST(c_nationkey AS FLOAT) AS DOUBLE)"
_DIST = f"sqrt(power({_X} - 1000.0, 2) + power({_Y} - 12.0, 2))"

#: Queries in the engine's dialect with their SQL, where that differs.
SQL: dict[str, tuple[str, str]] = {
    "scan_region": ("SELECT * FROM region", ""),
    "point_key": ("SELECT * FROM orders WHERE o_orderkey = 101", ""),
    "eq_nonkey_text": ("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'", ""),
    "eq_cross_type": ("SELECT * FROM part WHERE p_size = 3.0", ""),
    "between_key": ("SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 200", ""),
    "between_nonkey": ("SELECT * FROM part WHERE p_retailprice BETWEEN 950.0 AND 1000.0", ""),
    "between_text": ("SELECT * FROM nation WHERE n_name BETWEEN 'A' AND 'NATION_15'", ""),
    "project_cols": ("SELECT c_custkey, c_name FROM customer", ""),
    "order_asc": ("SELECT * FROM supplier ORDER BY s_acctbal", "SELECT * FROM supplier ORDER BY s_acctbal, s_suppkey"),
    "order_desc": ("SELECT * FROM supplier ORDER BY s_acctbal DESC", "SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey DESC"),
    "group_count": ("SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag", ""),
    "group_sum_int": ("SELECT p_brand, SUM(p_size) AS v FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS v FROM part GROUP BY p_brand"),
    "group_min": ("SELECT l_returnflag, MIN(l_extendedprice) AS v FROM lineitem GROUP BY l_returnflag", ""),
    "group_max": ("SELECT l_returnflag, MAX(l_extendedprice) AS v FROM lineitem GROUP BY l_returnflag", ""),
    "group_min_text": ("SELECT n_regionkey, MIN(n_name) AS v FROM nation GROUP BY n_regionkey", ""),
    "global_count": ("SELECT COUNT(*) AS n FROM lineitem", ""),
    "global_sum_empty": ("SELECT SUM(s_acctbal) AS v FROM supplier WHERE s_suppkey = -1", ""),
    "join_inner": (
        "SELECT * FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey",
        'SELECT n.n_nationkey AS "nation.n_nationkey", n.n_name AS "nation.n_name", n.n_regionkey AS "nation.n_regionkey", r.r_regionkey AS "region.r_regionkey", r.r_name AS "region.r_name" FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey',
    ),
    "join_large": (
        "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
        'SELECT o.o_orderkey AS "orders.o_orderkey", c.c_name AS "customer.c_name" FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey',
    ),
    "join_dup_keys": ("SELECT COUNT(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey", "SELECT count(*) AS n FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey"),
    "where_then_group": ("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority", ""),
    "group_then_order": ("SELECT o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_orderpriority ORDER BY n DESC", "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderpriority"),
}
#: The same with a double result, rounded since sums depend on the order of addition.
ROUNDED: dict[str, tuple[str, int, str]] = {
    "group_sum_double": ("SELECT l_returnflag, SUM(l_extendedprice) AS v FROM lineitem GROUP BY l_returnflag", 2, "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY l_returnflag"),
    "group_avg": ("SELECT l_linestatus, AVG(l_quantity) AS v FROM lineitem GROUP BY l_linestatus", 6, "SELECT l_linestatus, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY l_linestatus"),
    "global_avg": ("SELECT AVG(o_totalprice) AS v FROM orders", 4, "SELECT round(avg(o_totalprice), 4) AS v FROM orders"),
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the given tables and an empty warehouse."""
    out = Engine(spark, f"{workspace(spark)}/warehouse-{uuid.uuid4().hex}")
    for name in TABLES:
        out.register(name, f"{sf_dir}/{name}.parquet")
    return out


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


def radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within a circle of (balance, nation)."""
    return spatial.in_radius(_customers(spark, sf_dir), "c_acctbal", "c_nationkey", 1000.0, 12.0, 300.0).select("c_custkey")


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest customers by (balance, nation)."""
    return spatial.nearest(_customers(spark, sf_dir), "c_acctbal", "c_nationkey", 1000.0, 12.0, 10, keep_distance=True).select("c_custkey", "dist")


def mbr_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf boxes of customers in four by four tiles."""
    return spatial.leaf_boxes(_customers(spark, sf_dir), "c_acctbal", "c_nationkey", "c_custkey", 4, 4)


def mbr_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of the whole box hierarchy of customers, with the points its leaves hold."""
    nodes = spatial.box_hierarchy(_customers(spark, sf_dir), "c_acctbal", "c_nationkey", 64)
    root = lambda c: F.max(F.when(F.col("level") == 0, F.col(c))).alias(c)
    return nodes.agg(*map(root, ("min_x", "min_y", "max_x", "max_y")), F.sum(F.when(F.col("is_leaf"), F.col("n_entries"))).alias("n_points"))


def _changed(name: str, script: str, index: str = "HEAP", key: str | None = None, compact: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.create_from(f"own_{name}", spark.read.parquet(f"{sf_dir}/{name}.parquet"), index, key)
        e.run(script)
        if compact:
            e.compact(f"own_{name}")
        return e.scan(f"own_{name}")

    return run


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts in a log of events: purchases write, all else reads, users are resources."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("tx"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "X").otherwise("S").alias("op"), F.col("user_id").alias("resource"))
    return C.conflicts(log).select(F.col("req_seq").alias("req_id"), F.col("held_seq").alias("held_id"), "conflict")


def metrics_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value by kind of event and user."""
    return metrics.means(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type", "user_id"], {"value": "mean_value"}).withColumn("mean_value", F.round("mean_value", 6))


def queries() -> dict[str, Query]:
    """Name to query(spark, sf_dir)."""
    found: dict[str, Query] = {name: (lambda spark, sf_dir, text=text: engine(spark, sf_dir).query(text)) for name, (text, _) in SQL.items()}
    found |= {name: (lambda spark, sf_dir, text=text, n=n: engine(spark, sf_dir).query(text).withColumn("v", F.round("v", n))) for name, (text, n, _) in ROUNDED.items()}
    return found | table_queries.queries() | {
        "radius": radius,
        "knn": knn,
        "mbr_leaves": mbr_leaves,
        "mbr_root": mbr_root,
        "insert_then_scan": _changed("region", "INSERT INTO own_region VALUES (5, 'ATLANTIS')"),
        "delete_key": _changed("nation", "DELETE FROM own_nation WHERE n_nationkey = 7", "HASH", "n_nationkey"),
        "delete_nonkey": _changed("nation", "DELETE FROM own_nation WHERE n_regionkey = 3", "BPLUSTREE", "n_nationkey"),
        "compact_scan": _changed("supplier", "INSERT INTO own_supplier VALUES (-1, 'NOBODY')", "SEQUENTIAL", "s_suppkey", compact=True),
        "conflicts": conflicts,
        "metrics_mean": metrics_mean,
    }


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    found = {name: other or text for name, (text, other) in SQL.items()} | {name: other for name, (_, _, other) in ROUNDED.items()}
    return found | table_queries.oracle_sql() | {
        "radius": f"SELECT c_custkey FROM customer WHERE {_DIST} <= 300.0",
        "knn": f"SELECT c_custkey, {_DIST} AS dist FROM customer ORDER BY dist, c_custkey LIMIT 10",
        "mbr_leaves": f"SELECT CAST(sl AS INT) AS sl, CAST(tl AS INT) AS tl, min({_X}) AS min_x, min({_Y}) AS min_y, max({_X}) AS max_x, max({_Y}) AS max_y, count(*) AS n_entries FROM (SELECT *, ntile(4) OVER (PARTITION BY sl ORDER BY c_nationkey, c_custkey) AS tl FROM (SELECT *, ntile(4) OVER (ORDER BY c_acctbal, c_custkey) AS sl FROM customer) a) b GROUP BY sl, tl",
        "mbr_root": f"SELECT min({_X}) AS min_x, min({_Y}) AS min_y, max({_X}) AS max_x, max({_Y}) AS max_y, count(*) AS n_points FROM customer",
        "insert_then_scan": "SELECT * FROM region UNION ALL SELECT 5, 'ATLANTIS'",
        "delete_key": "SELECT * FROM nation WHERE NOT (n_nationkey = 7)",
        "delete_nonkey": "SELECT * FROM nation WHERE NOT (n_regionkey = 3)",
        "compact_scan": "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT -1, 'NOBODY', 0, 0.0",
        "conflicts": "SELECT a.event_id AS req_id, b.event_id AS held_id, CASE WHEN a.event_type = 'purchase' AND b.event_type = 'purchase' THEN 'W-W' WHEN a.event_type = 'purchase' THEN 'W-R' ELSE 'R-W' END AS conflict FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id > b.event_id AND (a.event_type = 'purchase' OR b.event_type = 'purchase')",
        "metrics_mean": "SELECT event_type, user_id, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY event_type, user_id",
    }
