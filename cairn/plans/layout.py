"""Physical layouts: how a version's files are written.  They change what scans can skip, never results."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.spatial import coordinates

#: Rows of a file, about.
FILE_ROWS = 1_000_000
#: Small appends after which a table is written anew.
MOST_DELTAS = 200


def arranged(df: DataFrame, index: str, key: str | None, rows: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """``df`` dealt and sorted for an index kind; ``rows`` is about how many there are.

    A heap keeps the partitions that it comes in, so as many tasks write it as
    made it; adaptive execution joins small ones.
    """
    files = max(1, ceil(rows / file_rows))
    if index in ("SEQUENTIAL", "BPLUSTREE") and key:
        return df.repartitionByRange(files, f"`{key}`").sortWithinPartitions(f"`{key}`")
    if index == "HASH" and key:
        return df.repartition(files, f"`{key}`").sortWithinPartitions(f"`{key}`")
    if index == "RTREE":
        x, y = (f"`{c}`" for c in coordinates(df.schema))
        # Sort-tile-recursive: slices of equal size by x, then files by y within each slice.
        slices = ceil(sqrt(files))
        marks = sorted(set(df.approxQuantile(x.strip("`"), [i / slices for i in range(1, slices)], 0.01))) if slices > 1 else []
        cut = F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m <= F.col(x))) if marks else F.lit(0)
        rows_ = df.withColumn("_slice", F.coalesce(cut, F.lit(-1)))
        return rows_.repartitionByRange(files, "_slice", y).sortWithinPartitions("_slice", y, x).drop("_slice")
    return df


def write(df: DataFrame, path: str, index: str, key: str | None, rows: int, file_rows: int = FILE_ROWS) -> None:
    """Write a version."""
    out = arranged(df, index, key, rows, file_rows).write
    if index == "HASH" and key:
        out = out.option(f"parquet.bloom.filter.enabled#{key}", "true")
    out.parquet(path)


def ordered(df: DataFrame, index: str, key: str | None) -> DataFrame:
    """Rows in the order that scans of sorted layouts give."""
    if index in ("SEQUENTIAL", "BPLUSTREE") and key:
        return df.orderBy(f"`{key}`", *[F.col(f"`{c}`") for c in df.columns if c != key])
    return df
