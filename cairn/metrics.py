"""Measurements: entries of structure, operation, n, reads, writes and time, kept, saved and averaged."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "structure string, operation string, n long, reads double, writes double, disk_accesses double, time_ms double"


@dataclass
class Entry:
    """One measurement; the totals are per operation."""

    structure: str
    operation: str
    n: int
    reads: float = 0.0
    writes: float = 0.0
    disk_accesses: float = 0.0
    time_ms: float = 0.0


class Metrics:
    """A list of entries."""

    def __init__(self) -> None:
        self.entries: list[Entry] = []

    @contextmanager
    def measure(self, structure: str, operation: str, n: int) -> Iterator[Entry]:
        """Time what runs inside; it may set reads and writes of the entry."""
        entry, began = Entry(structure, operation, n), perf_counter()
        try:
            yield entry
        finally:
            entry.time_ms = (perf_counter() - began) * 1000 / max(1, n)
            entry.disk_accesses = entry.reads + entry.writes
            self.entries.append(entry)

    def frame(self, spark: SparkSession) -> DataFrame:
        """All entries as a table."""
        return spark.createDataFrame([(e.structure, e.operation, e.n, *map(float, (e.reads, e.writes, e.disk_accesses, e.time_ms))) for e in self.entries], SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the entries as JSON lines."""
        self.frame(spark).coalesce(1).write.mode("overwrite").json(path)

    def summary(self) -> str:
        """A table for people."""
        head = f"{'structure':<14}{'operation':<16}{'n':>9}{'pages':>10}{'ms':>10}"
        return "\n".join([head, *[f"{e.structure:<14}{e.operation:<16}{e.n:>9}{e.disk_accesses:>10.2f}{e.time_ms:>10.4f}" for e in self.entries]])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Saved entries."""
    return spark.read.schema(SCHEMA).json(path)


def means(df: DataFrame, keys: list[str], values: dict[str, str], count: str = "n") -> DataFrame:
    """Mean of each value column (column to alias) and row count by keys."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(a) for c, a in values.items()], F.count(F.lit(1)).alias(count))
