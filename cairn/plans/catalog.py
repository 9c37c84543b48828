"""The catalog: tables as versioned Parquet folders, and a record of them that is replaced as a whole.

``warehouse/_catalog/N.json`` is the record's Nth version; the highest counts.
``warehouse/<table>/v=N`` is a version of a table, and ``v=N-<id>`` rows appended
to it.  A write goes to a folder of its own before the record names it, so a
reader always has a whole table, and a write that breaks off leaves nothing that
is read.  A replaced version stays for ``KEEP_SECONDS``, so a result that was
planned before can still be read.  All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cairn.errors import AlreadyExists, EngineError, NotFound
from cairn.types import SPARK_TYPES

LAYOUTS = ("HEAP", "SEQUENTIAL", "HASH", "BPLUSTREE", "RTREE")
#: How long a replaced version can still be read.
KEEP_SECONDS = 3600.0


@dataclass
class Table:
    """What the catalog knows of a table."""

    name: str
    columns: list[dict]
    index: str = "HEAP"
    key: str | None = None
    version: int = 0
    deltas: int = 0
    parts: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)
    retired: list[list] = field(default_factory=list)
    sizes: dict[str, int] = field(default_factory=dict)
    external: str | None = None

    def schema(self) -> T.StructType:
        """The Spark schema of a table made by CREATE TABLE."""
        return T.StructType([T.StructField(c["name"], SPARK_TYPES[c["type"]], True, {"index": c.get("index") or "", "size": self.sizes.get(c["name"], 0)}) for c in self.columns])

    def record_size(self) -> int:
        """Bytes of a fixed-width record, as page capacities count them."""
        return sum({"INT": 4, "FLOAT": 8}.get(c["type"]) or self.sizes.get(c["name"], 32) for c in self.columns)


class Catalog:
    """Tables of a warehouse folder."""

    def __init__(self, spark: SparkSession, warehouse: str) -> None:
        self.spark, self.warehouse = spark, warehouse.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.warehouse).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.warehouse}/_catalog"))
        self.number, self.tables = 0, {}
        self.reload()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def reload(self) -> None:
        """Read the latest record."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.warehouse}/_catalog"))]
        numbers = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        if numbers:
            self.number = numbers[-1]
            stream = self._fs.open(self._path(f"{self.warehouse}/_catalog/{self.number}.json"))
            try:
                raw = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
            kept = {n: t for n, t in self.tables.items() if t.external}
            self.tables = kept | {name: Table(**t) for name, t in json.loads(raw).items()}

    def save(self) -> None:
        """Write the next record under another name, then give it its number."""
        raw = json.dumps({n: asdict(t) for n, t in self.tables.items() if not t.external}).encode()
        temp, last = self._path(f"{self.warehouse}/_catalog/.{uuid.uuid4().hex}"), self.number
        stream = self._fs.create(temp)
        stream.write(bytearray(raw))
        stream.close()
        if not self._fs.rename(temp, self._path(f"{self.warehouse}/_catalog/{last + 1}.json")):
            self._fs.delete(temp, False)
            raise EngineError("another writer changed the catalog")
        self.number = last + 1
        self._fs.delete(self._path(f"{self.warehouse}/_catalog/{last - 1}.json"), False)

    def get(self, name: str) -> Table:
        """A table by name."""
        if name not in self.tables:
            raise NotFound(f"no table {name}")
        return self.tables[name]

    def add(self, table: Table) -> None:
        """Enter a new table."""
        if table.name in self.tables:
            raise AlreadyExists(f"table {table.name} exists")
        self.tables[table.name] = table

    def path(self, table: Table, version: int | None = None) -> str:
        """The folder of a table's version."""
        return table.external or f"{self.warehouse}/{table.name}/v={table.version if version is None else version}"

    def read(self, name: str) -> DataFrame:
        """A table's current rows."""
        table = self.get(name)
        if table.external:
            return self.spark.read.parquet(table.external)
        return self.spark.read.schema(table.schema()).parquet(*self.folders(table))

    def folders(self, table: Table) -> list[str]:
        """The folders of a table's current rows: its version and what was appended."""
        return [self.path(table), *[f"{self.warehouse}/{table.name}/{part}" for part in table.parts]]

    def retire(self, table: Table, folders: list[str], keep: float = KEEP_SECONDS) -> None:
        """Note folders that are no longer read, and delete those noted long enough ago."""
        now = time.time()
        table.retired += [[folder, now] for folder in folders]
        for folder, since in [x for x in table.retired if now - x[1] >= keep]:
            self.remove(folder)
        table.retired = [x for x in table.retired if now - x[1] < keep]

    def remove(self, path: str) -> None:
        """Delete a folder of this warehouse."""
        self._fs.delete(self._path(path), True)
