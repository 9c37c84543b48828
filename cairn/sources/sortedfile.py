"""Sorted files: a table written in global order, and read back in it.

The range partitions of a sort become the folder's files, whose names are in
order, so no task ever holds more than its range.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators import relational as R


def write(df: DataFrame, path: str, key: str | None = None, descending: bool = False) -> dict:
    """Write ``df`` ordered by ``key`` (ties by the other columns), or in the order that it has.

    Returns records_written, runs_generated (files) and total_sec.
    """
    began = time.perf_counter()
    (R.ordered(df, key, descending) if key else df).write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path).select(F.col("_metadata.file_name").alias("file"))
    counted = found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files")).first()
    return {"records_written": counted.n, "runs_generated": counted.files, "total_sec": time.perf_counter() - began}


def read(spark: SparkSession, path: str, place: str = "place") -> DataFrame:
    """The rows with their places from 0 in the files' order; the rows themselves stay where they are."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = F.sum("n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    starts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).select("_file", F.coalesce(before, F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").withColumn(place, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")
