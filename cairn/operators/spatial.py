"""Radius search, nearest neighbours and the bounding-box hierarchy."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.errors import EngineError
from cairn.functions.spatial import distance, single, within
from cairn.types import is_number
from cairn.workspace import workspace

# Recognised names of coordinate columns.
LATITUDE = ("lat", "latitude", "latitud")
LONGITUDE = ("lon", "lng", "longitude", "longitud")
#: Rows of a range in which global ranks are counted, about.
RANGE_ROWS = 1_000_000


def coordinates(schema: T.StructType) -> tuple[str, str]:
    """The (x, y) columns of a table: longitude and latitude by their names."""
    by_name = {f.name.lower(): f for f in schema.fields}
    found = [next((by_name[n] for n in names if n in by_name), None) for names in (LONGITUDE, LATITUDE)]
    if None in found:
        raise EngineError("a spatial query needs a latitude and a longitude column")
    if not all(is_number(f.dataType) for f in found):
        raise EngineError("coordinates have to be numbers")
    return found[0].name, found[1].name


def in_radius(df: DataFrame, x: str, y: str, cx: float, cy: float, radius: float) -> DataFrame:
    """Rows within a circle."""
    return df.where(within(F.col(x), F.col(y), cx, cy, radius))


def nearest(df: DataFrame, x: str, y: str, cx: float, cy: float, k: int, keep_distance: bool = False) -> DataFrame:
    """The k nearest rows in order of distance; ties go by the columns in schema order."""
    by = distance(F.col(x), F.col(y), cx, cy)
    ties = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = df.where(by.isNotNull()).withColumn("dist", by).orderBy("dist", *ties).limit(max(0, k))
    return rows if keep_distance else rows.drop("dist")


def tiles(df: DataFrame, by: str, tie: str, n: int, name: str, rows: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``name``: ntile(n) over all rows ordered by (by, tie), without taking all rows to one task.

    ``rows`` is how many there are, if known.  They are dealt to ranges of
    (by, tie), as many as their number asks for, and stored in the shared folder;
    equal coordinates are dealt by their ties.  A row's rank is its rank within
    its range plus the rows of the ranges before.
    """
    total = df.count() if rows is None else rows
    ranges = max(1, ceil(total / range_rows))
    order = [F.col(f"`{by}`"), F.col(f"`{tie}`")]
    if ranges == 1:
        rank = F.row_number().over(Window.orderBy(*order)) - 1
        ranked = df
    else:
        workspace(df.sparkSession)
        # Ranges are sampled, so what a row's range is has to be written down.
        ranked = df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
        counts = ranked.groupBy("_part").count()  # a row per range
        before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.join(counts.select("_part", before.alias("_before")), "_part")
        rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    size, more = divmod(total, n)
    tile = F.when(rank < more * (size + 1), F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - more * (size + 1)) / max(size, 1)))
    return ranked.withColumn(name, (tile + 1).cast("int")).drop("_part", "_before")


def leaf_tiles(df: DataFrame, x: str, y: str, tie: str, slices: int, per_slice: int, total: int | None = None) -> DataFrame:
    """Sort-tile-recursive leaves: slices by x, then tiles by y within each (Leutenegger et al. 1997)."""
    rows = tiles(df, x, tie, slices, "sl", total)
    return rows.withColumn("tl", F.ntile(per_slice).over(Window.partitionBy("sl").orderBy(y, tie)))


def leaf_boxes(df: DataFrame, x: str, y: str, tie: str, slices: int, per_slice: int) -> DataFrame:
    """One box per leaf: sl, tl, min_x, min_y, max_x, max_y, n_entries."""
    sx, sy = single(F.col(x)), single(F.col(y))
    return leaf_tiles(df, x, y, tie, slices, per_slice).groupBy("sl", "tl").agg(
        F.min(sx).alias("min_x"), F.min(sy).alias("min_y"), F.max(sx).alias("max_x"), F.max(sy).alias("max_y"), F.count("*").alias("n_entries"),
    )


def leaf_capacity(record_size: int) -> int:
    """Entries of a leaf in a page of 4096 bytes: 4 + 1 bytes of header, 8 of coordinates with each record."""
    return max(2, 4091 // (8 + record_size))


INNER_CAPACITY = 4091 // 20


def box_hierarchy(df: DataFrame, x: str, y: str, capacity: int, inner: int = INNER_CAPACITY) -> DataFrame:
    """All nodes of a packed hierarchy: level (0 is the root), is_leaf, the box, n_entries and node_id.

    Each round packs the boxes of the last; their number falls by the capacity,
    so few rounds are needed.  No points, no nodes.
    """
    workspace(df.sparkSession)
    nodes = df.where(F.col(f"`{x}`").isNotNull() & F.col(f"`{y}`").isNotNull()).select(single(F.col(f"`{x}`")).alias("x"), single(F.col(f"`{y}`")).alias("y"))
    nodes = nodes.select("x", "y", F.xxhash64("x", "y").alias("id"), F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y"))
    n, height, levels = nodes.count(), 0, []
    while n and (not levels or n > 1):
        c = capacity if height == 0 else inner
        wanted = ceil(n / c)
        slices = ceil(sqrt(wanted))
        boxes = leaf_tiles(nodes, "x", "y", "id", slices, ceil(wanted / slices), n).groupBy("sl", "tl").agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.count("*").alias("n_entries"))
        boxes = boxes.withColumn("id", F.xxhash64(F.lit(height), "sl", "tl")).checkpoint()
        levels.append(boxes)
        nodes = boxes.select(((F.col("min_x") + F.col("max_x")) / 2).alias("x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("y"), "id", "min_x", "min_y", "max_x", "max_y")
        n, height = boxes.count(), height + 1
    empty = df.sparkSession.createDataFrame([], "level int, is_leaf boolean, min_x double, min_y double, max_x double, max_y double, n_entries bigint, node_id bigint")
    for i, boxes in enumerate(levels):
        empty = empty.unionByName(boxes.select(F.lit(len(levels) - 1 - i).alias("level"), F.lit(i == 0).alias("is_leaf"), "min_x", "min_y", "max_x", "max_y", "n_entries", F.col("id").alias("node_id")))
    return empty
