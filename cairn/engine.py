"""The engine: scripts in, DataFrames and changed tables out."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.errors import AlreadyExists, EngineError
from cairn.operators import relational as R
from cairn.operators import spatial
from cairn.plans import layout
from cairn.plans.catalog import KEEP_SECONDS, Catalog, Table
from cairn.plans.planner import Planner
from cairn.sources import csvio
from cairn.sqlfront import ast
from cairn.sqlfront.parser import parse
from cairn.txn import LockManager
from cairn.types import DEFAULTS, coerce, comparable

LOCK_TIMEOUT = 60.0


#: Types of DataFrames that the dialect has types for.
KINDS = {"int": "INT", "double": "FLOAT", "string": "TEXT", "bigint": "INT", "float": "FLOAT", "smallint": "INT", "tinyint": "INT"}


def fitted(table: Table, df: DataFrame) -> DataFrame:
    """``df`` with a table's columns and types; whole numbers have to fit INT, and text is never read as a number."""
    given = dict(df.dtypes)
    if set(given) != {c["name"] for c in table.columns} or len(given) < len(df.columns):
        raise EngineError(f"table {table.name} has columns {[c['name'] for c in table.columns]}, not {df.columns}")
    fits = {"INT": ("INT",), "FLOAT": ("INT", "FLOAT"), "TEXT": ("TEXT",)}
    bad = [c["name"] for c in table.columns if KINDS.get(given[c["name"]]) not in fits[c["type"]]]
    if bad:
        raise EngineError(f"columns {bad} don't fit their types in table {table.name}")
    return df.select(*[R.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in table.schema().fields])


@dataclass
class Result:
    """What a statement did: rows as a lazy DataFrame, or a count of rows changed."""

    kind: str
    frame: DataFrame | None = None
    affected: int = 0
    stats: dict = field(default_factory=dict)


class Engine:
    """Tables of one warehouse."""

    def __init__(self, spark: SparkSession, warehouse: str, csv_folders: tuple[str, ...] = (), hooks: dict[str, Callable[[ast.Statement], Result | None]] | None = None, file_rows: int = layout.FILE_ROWS, keep_seconds: float = KEEP_SECONDS) -> None:
        self.spark, self.catalog, self.locks = spark, Catalog(spark, warehouse), LockManager()
        self.csv_folders, self.hooks = csv_folders, hooks or {}
        self.file_rows, self.keep_seconds = file_rows, keep_seconds
        self.planner = Planner(self.catalog.read)

    def register(self, name: str, path: str) -> None:
        """Make a Parquet path readable as a table; its types pass through."""
        self.catalog.add(Table(name, [], external=path))

    # -- reading -------------------------------------------------------------

    def query(self, text: str) -> DataFrame:
        """The DataFrame of a single SELECT."""
        statements = parse(text).statements
        if len(statements) != 1 or not isinstance(statements[0], ast.Select):
            raise EngineError("expected one SELECT")
        return self.planner.plan(statements[0])

    def scan(self, name: str) -> DataFrame:
        """All rows in the order of the table's layout."""
        table = self.catalog.get(name)
        return layout.ordered(self.catalog.read(name), table.index, table.key)

    def search(self, name: str, condition: Callable[[DataFrame], object] | int | float | str) -> DataFrame:
        """Rows whose key equals a value, or that meet a condition made from the DataFrame."""
        df, table = self.catalog.read(name), self.catalog.get(name)
        return df.where(condition(df)) if callable(condition) else df.where(R.equals(df, str(table.key), condition))

    def search_many(self, name: str, keys: list[int | float | str]) -> DataFrame:
        """Rows whose key is one of some literals, in one scan; a key that occurs twice in the list counts once."""
        df, table = self.catalog.read(name), self.catalog.get(name)
        kind = df.schema[str(table.key)].dataType
        wanted = [(k,) for k in dict.fromkeys(keys) if comparable(kind, k)]
        if not wanted:
            return df.where("false")
        found = self.spark.createDataFrame(wanted, T.StructType([T.StructField(str(table.key), kind)]))
        return df.join(F.broadcast(found), str(table.key), "left_semi")

    def range_many(self, name: str, ranges: list[tuple]) -> DataFrame:
        """Rows with the first and last key of each range (low, high) that holds them; a row comes once for each."""
        df, table = self.catalog.read(name), self.catalog.get(name)
        key = R.col(str(table.key))
        wanted = [(low, high) for low, high in ranges if low <= high]
        if not wanted:
            return df.where("false").withColumns({"low": key, "high": key})
        kind = df.schema[str(table.key)].dataType
        found = self.spark.createDataFrame(wanted, T.StructType([T.StructField("low", kind), T.StructField("high", kind)]))
        span = key.between(min(r[0] for r in wanted), max(r[1] for r in wanted))  # what scans can skip by
        return df.where(span).join(F.broadcast(found), key.between(F.col("low"), F.col("high")))

    def boxes(self, name: str) -> DataFrame:
        """The bounding-box hierarchy of a spatial table."""
        table, df = self.catalog.get(name), self.catalog.read(name)
        if table.index != "RTREE":
            raise EngineError(f"table {name} is no RTREE")
        return spatial.box_hierarchy(df, *spatial.coordinates(df.schema), spatial.leaf_capacity(table.record_size()))

    # -- statements ----------------------------------------------------------

    def run(self, text: str, sizes: dict[str, int] | None = None) -> list[Result]:
        """All statements of a script in turn; those before a failing one stay done."""
        return [self.execute(s, sizes) for s in parse(text).statements]

    def execute(self, statement: ast.Statement, sizes: dict[str, int] | None = None) -> Result:
        """One statement under its locks."""
        hook = self.hooks.get(type(statement).__name__)
        if hook and (found := hook(statement)) is not None:
            return found
        modes = {statement.table: "S" if isinstance(statement, ast.Select) else "X"}
        if isinstance(statement, ast.Select) and statement.join:
            modes[statement.join.table] = "S"
        began = time.perf_counter()
        with self.locks.hold(modes, LOCK_TIMEOUT):
            if isinstance(statement, ast.Select):
                result = Result("SELECT", self.planner.plan(statement))
            elif isinstance(statement, ast.CreateTable):
                result = self._create(statement, sizes or {})
            elif isinstance(statement, ast.Insert):
                result = self._insert(statement)
            elif isinstance(statement, ast.Delete):
                result = self._delete(statement)
            else:
                result = self._drop(statement.table)
        result.stats["time_ms"] = (time.perf_counter() - began) * 1000
        return result

    def _own(self, name: str) -> Table:
        table = self.catalog.get(name)
        if table.external:
            raise EngineError(f"table {name} is read-only")
        return table

    def _create(self, s: ast.CreateTable, sizes: dict[str, int]) -> Result:
        if s.table in self.catalog.tables:
            raise AlreadyExists(f"table {s.table} exists")
        first = next((c for c in s.columns if c.index), None)
        table = Table(s.table, [{"name": c.name, "type": c.type, "index": c.index} for c in s.columns], first.index if first and first.index else "HEAP", (first or s.columns[0]).name, sizes={k: int(v) for k, v in sizes.items()})
        if table.index == "RTREE":
            spatial.coordinates(table.schema())
        if s.file:
            rows = csvio.load(self.spark, csvio.find(s.file, self.csv_folders), table.columns, table.sizes)
        else:
            rows = self.spark.createDataFrame([], table.schema())
        return Result("CREATE_TABLE", affected=self._replace(table, rows, new=True, about=None if s.file else 0))

    def create_from(self, name: str, df: DataFrame, index: str = "HEAP", key: str | None = None) -> int:
        """A table of INT, FLOAT and TEXT columns from a DataFrame; wider whole numbers have to fit INT."""
        bad = [c for c, t in df.dtypes if t not in KINDS]
        if bad:
            raise EngineError(f"columns {bad} have no type of the dialect")
        table = Table(name, [{"name": c, "type": KINDS[t], "index": index if c == key else None} for c, t in df.dtypes], index, key or df.columns[0])
        if name in self.catalog.tables:
            raise AlreadyExists(f"table {name} exists")
        return self._replace(table, fitted(table, df), new=True)

    def _replace(self, table: Table, rows: DataFrame, new: bool = False, about: int | None = None) -> int:
        """Write the next version, then name it in the catalog; returns its number of rows.

        ``about`` says how many rows there are; without it, a layout that deals
        rows to files counts them first.
        """
        version = table.version + (not new)
        path = self.catalog.path(table, version)
        self.catalog.remove(path)  # what a failed attempt may have left
        if about is None:
            about = rows.count() if table.index != "HEAP" else 0
        layout.write(rows, path, table.index, table.key, about, self.file_rows)
        old = [] if new else self.catalog.folders(table)
        table.version, table.deltas, table.parts = version, 0, []
        self.catalog.retire(table, old, self.keep_seconds)
        if new:
            self.catalog.add(table)
        self.catalog.save()
        return self.catalog.read(table.name).count()  # from the files' footers

    def _insert(self, s: ast.Insert) -> Result:
        table = self._own(s.table)
        rows = []
        for values in s.rows:
            if len(values) > len(table.columns):
                raise EngineError(f"table {s.table} has {len(table.columns)} columns")
            row = [coerce(c["type"], v, c["name"]) for c, v in zip(table.columns, values, strict=False)]
            row += [DEFAULTS[c["type"]] for c in table.columns[len(row) :]]
            rows.append(tuple(v[: table.sizes[c["name"]]] if isinstance(v, str) and c["name"] in table.sizes else v for c, v in zip(table.columns, row, strict=True)))
        self.append(s.table, self.spark.createDataFrame(rows, table.schema()).coalesce(1))  # what a statement spells out
        return Result("INSERT", affected=len(rows))

    def append(self, name: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Add rows in a folder of their own; after many of them the table is written anew.

        Columns go by name and are cast as create_from() does.  The catalog names
        the folder, and the (stream, number) of a ``batch``, in one step, so a
        batch is added once however often it is tried; returns whether it was.
        """
        table = self._own(name)
        if batch and batch[1] <= table.batches.get(batch[0], -1):
            return False
        part = f"v={table.version}-{uuid.uuid4().hex}"
        fitted(table, rows).write.parquet(f"{self.catalog.warehouse}/{name}/{part}")
        table.parts.append(part)
        table.deltas += 1
        if batch:
            table.batches[batch[0]] = batch[1]
        if table.deltas >= layout.MOST_DELTAS:
            self.compact(name)
        else:
            self.catalog.save()
        return True

    def compact(self, name: str) -> int:
        """Write the table anew in its layout."""
        table, rows = self._own(name), self.catalog.read(name)
        return self._replace(table, rows, about=rows.count())

    def _delete(self, s: ast.Delete) -> Result:
        table, df = self._own(s.table), self.catalog.read(s.table)
        name = s.where.column.column
        if s.where.column.table not in (None, s.table) or name not in df.columns:
            raise EngineError(f"no column {s.where.column} in {s.table}")
        if not comparable(df.schema[name].dataType, s.where.value):
            return Result("DELETE")
        before = df.count()
        hit = F.coalesce(R.col(name) == F.lit(s.where.value), F.lit(False))
        kept = self._replace(table, df.where(~hit), about=before)
        return Result("DELETE", affected=before - kept)

    def _drop(self, name: str) -> Result:
        table = self.catalog.get(name)
        self.catalog.tables.pop(name)
        if not table.external:
            self.catalog.save()
            self.catalog.remove(f"{self.catalog.warehouse}/{name}")
        return Result("DROP_TABLE")
