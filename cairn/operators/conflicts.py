"""Conflicts and deadlocks in operation logs under strict two-phase locking.

A log has a row per request: tx, seq (its global order), op (X writes, S reads),
resource.  Locks are held to the end of the log unless ``until`` says when a
transaction ended.  ``conflicts`` lists pairs, whose number is the square of a
resource's requests while nothing ends; ``conflict_counts`` counts them in one
sort, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.workspace import workspace


def conflicts(log: DataFrame, until: DataFrame | None = None) -> DataFrame:
    """Pairs of a request and an earlier one still held: req_tx, req_seq, held_tx, held_seq, resource, conflict.

    The first letter of ``conflict`` is what the requester does.  Two reads never
    conflict, so only pairs with a write are joined.
    """
    asked = log.select(F.col("tx").alias("req_tx"), F.col("seq").alias("req_seq"), F.col("op").alias("req_op"), "resource")
    held = log.select(F.col("tx").alias("held_tx"), F.col("seq").alias("held_seq"), F.col("op").alias("held_op"), "resource")
    if until is not None:
        held = held.join(until.select(F.col("tx").alias("held_tx"), F.col("seq").alias("end")), "held_tx", "left")
    pairs = asked.where("req_op = 'X'").join(held, "resource").unionByName(asked.where("req_op = 'S'").join(held.where("held_op = 'X'"), "resource"))
    pairs = pairs.where((F.col("held_seq") < F.col("req_seq")) & (F.col("held_tx") != F.col("req_tx")))
    if until is not None:
        pairs = pairs.where(F.col("end").isNull() | (F.col("end") > F.col("req_seq"))).drop("end")
    letter = lambda c: F.when(F.col(c) == "X", "W").otherwise("R")
    return pairs.withColumn("conflict", F.concat_ws("-", letter("req_op"), letter("held_op"))).drop("req_op", "held_op")


#: Numbers of one bucket of a resource's requests.
BUCKET = 1 << 16


def conflict_counts(log: DataFrame) -> DataFrame:
    """resource, conflict, n: how many pairs conflicts() lists without ``until``, counted and not listed.

    A request conflicts with all earlier ones of its resource but its own
    transaction's.  Running totals are taken in two steps, within buckets of
    ``seq`` and over the buckets' sums, so a hot resource is no single task's.
    """

    def earlier(keys: list[str], name: str) -> DataFrame:
        rows = counted.withColumn("_bucket", F.floor(F.col("seq") / BUCKET))
        within = Window.partitionBy(*keys, "_bucket").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
        over = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy(*keys, "_bucket").agg(F.sum("x").alias("_x"), F.sum("s").alias("_s"))
        sums = sums.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_{k}").over(over), F.lit(0)).alias(f"_{k}") for k in "xs"])
        return rows.join(sums, [*keys, "_bucket"]).select("tx", "seq", "resource", "x", "s", *[(F.col(f"_{k}") + F.coalesce(F.sum(k).over(within), F.lit(0))).alias(f"{name}_{k}") for k in "xs"])

    counted = log.where("resource IS NOT NULL").groupBy("tx", "seq", "resource").agg(F.sum((F.col("op") == "X").cast("long")).alias("x"), F.sum((F.col("op") == "S").cast("long")).alias("s"))
    key = ["tx", "seq", "resource"]
    both = earlier(["resource"], "all").join(earlier(["resource", "tx"], "own").drop("x", "s"), key)
    others = {k: F.col(f"all_{k}") - F.col(f"own_{k}") for k in "xs"}
    kinds = {"W-W": F.col("x") * others["x"], "W-R": F.col("x") * others["s"], "R-W": F.col("s") * others["x"]}
    sums = both.groupBy("resource").agg(*[F.sum(v).alias(k) for k, v in kinds.items()])
    return sums.unpivot("resource", list(kinds), "conflict", "n").where("n > 0")


def waits(pairs: DataFrame) -> DataFrame:
    """The wait-for graph of conflicts: waiter, holder."""
    return pairs.select(F.col("req_tx").alias("waiter"), F.col("held_tx").alias("holder")).distinct()


def deadlocked(edges: DataFrame) -> DataFrame:
    """Transactions on, or on a way between, cycles of a wait-for graph (column tx).

    Those that wait for nobody, or that nobody waits for, can't be on a cycle
    and are cut off until none is left to cut.
    """
    workspace(edges.sparkSession)
    edges = edges.where("waiter IS NOT NULL AND holder IS NOT NULL").distinct().checkpoint()
    count = edges.count()
    while count:
        waiters, holders = edges.select(F.col("waiter").alias("tx")).distinct(), edges.select(F.col("holder").alias("tx")).distinct()
        live = waiters.join(holders, "tx", "left_semi")
        edges = edges.join(live.withColumnRenamed("tx", "waiter"), "waiter", "left_semi").join(live.withColumnRenamed("tx", "holder"), "holder", "left_semi").select("waiter", "holder").checkpoint()
        now = edges.count()
        if now == count:
            break
        count = now
    return edges.select(F.col("waiter").alias("tx")).unionByName(edges.select(F.col("holder").alias("tx"))).distinct()
