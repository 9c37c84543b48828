"""Shared pieces of the corpus operators.

Words everywhere are maximal runs of characters that are not ASCII white space
(``WORD``).  Intermediate tables go to the folder that every executor shares, so
a lost executor never loses them (``store``).
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"

#: A table is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 500_000


#: The tables stored in the innermost ``passing`` block so far.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)

#: Bytes of a batch that goes to a Python worker; rows may be long.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep batches for Python workers small in bytes, whatever the length of rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a Python worker, which at the task's end gives back the memory it has freed; workers live on and wait for tasks with it."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim_heap = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim_heap:
            trim_heap(0)

    return inner


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a temporary one only where none is set (tests)."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, folder[len("file://") :], True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (paths := _PASSING.get()) is not None:
        paths.append(path)
    return path


def trim(spark: SparkSession) -> None:
    """Have the driver's JVM give back native memory that it has freed; what its many short-lived threads leave adds up over jobs.

    Runs the JVM's own command of that name; a JVM without it is left alone.
    """
    java, new_array = spark._jvm.java.lang, spark.sparkContext._gateway.new_array

    def array(kind: object, values: list) -> object:
        out = new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    invoke = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(java.Class, [java.Class.forName(k) for k in kinds]))
    command = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    try:
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), array(java.Object, [command, "systemTrimNativeHeap", array(java.Object, []), array(java.String, [])]))
    except Py4JJavaError:
        return


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    trim(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that no later plan reads."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, name)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block at whose end the tables stored in it are deleted, but for those given to the function that it yields.

    Those belong to the block around it, if there is one.  Shuffle files are
    deleted as soon as the job that wrote them ends, so whatever is made in the
    block has to be run there too.
    """
    outer, paths = _PASSING.get(), []

    def keep(df: DataFrame) -> DataFrame:
        names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        for path in [p for p in paths if p.rsplit("/", 1)[1] in names]:
            paths.remove(path)
            if outer is not None:
                outer.append(path)
        return df

    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, token = spark.conf.get(cleanup), _PASSING.set(paths)
    spark.conf.set(cleanup, "true")
    try:
        yield keep
    finally:
        _PASSING.reset(token)
        spark.conf.set(cleanup, before)
        for path in paths:
            _delete(spark, path)


def sized_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are at most ``most``."""
    return F.broadcast(df) if rows <= most else df


def addressed(df: DataFrame) -> DataFrame:
    """``df`` with each row's address, ``_file`` (a hash of the path) and ``_row`` in it; what is not read from files is stored first."""
    try:
        return df.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    except AnalysisException:
        return addressed(store(df, "addressed"))


def attached(texts: DataFrame, some: DataFrame, on: list[str], how: str = "inner", weight: str | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``texts`` joined with ``some`` without shuffling a text, however many rows ``some`` has.

    ``texts`` is read from files, and ``some`` names by ``_file`` (see
    ``addressed``) the file that each of its rows belongs to.  Files are taken in
    groups whose part of ``some`` weighs ``most`` at most (a row weighs one, or
    what the column ``weight`` says), and each part is broadcast to the scan of
    its files, so every file is scanned once and every broadcast is bounded.  A
    file with more rows than that is scanned once for each ``most`` of them, dealt
    by the keys.  ``how`` is inner, left, left_semi or left_anti; ``_file`` comes with
    the result only as a key.
    """
    narrow = some if "_file" in on else some.drop("_file")
    heavy = F.col(weight) if weight else F.lit(1)
    total = some.agg(F.coalesce(F.sum(heavy), F.lit(0))).first()[0]
    if total <= most:
        return texts.join(F.broadcast(narrow), on, how)
    # A row per file.
    weights = {r["_file"]: r.n for r in some.groupBy("_file").agg(F.sum(heavy).alias("n")).collect()}
    paths = [(r.path, weights.get(r["_file"], 0), r["_file"]) for r in texts.select(F.col("_metadata.file_path").alias("path")).distinct().withColumn("_file", F.xxhash64("path")).orderBy("path").collect()]
    groups: list[list[tuple[str, int, int]]] = [[]]
    for entry in paths:
        if groups[-1] and sum(x[1] for x in groups[-1]) + entry[1] > most:
            groups.append([])
        groups[-1].append(entry)
    path, schema = scratch_path(texts.sparkSession, "attached"), None
    for group in groups:
        parts = max(1, -(-sum(x[1] for x in group) // most))
        of = texts.where(F.col("_metadata.file_path").isin([x[0] for x in group]))
        own = some.where(F.col("_file").isin([x[2] for x in group])).select(narrow.columns)
        for part in range(parts):
            mine = lambda df: df.where(F.pmod(F.hash(*on), F.lit(parts)) == part) if parts > 1 else df  # noqa: B023, E731
            out = mine(of).join(F.broadcast(mine(own)), on, how)
            out.write.mode("append").parquet(path)
            schema = out.schema
    return texts.sparkSession.read.schema(schema).parquet(path)


def hex_long(text: Column, digits: int = 13) -> Column:
    """The first hex digits of md5(text) as a long; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, spread: Column, buckets: int, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``keys`` that come before this one.

    Rows of a key are ordered by (bucket, order), where ``spread`` deals a key's
    rows over ``buckets`` buckets.  Each bucket is summed by itself and starts
    at the total of the buckets before it, so no task sees a whole key.  The
    table of bucket totals has at most (number of keys x buckets) rows, and
    callers keep the keys to a fixed small number.
    """
    df = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int")).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total")).select(*keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, [*keys, "_bucket"])
        .withColumn(name, (F.col("_start") + F.coalesce(F.sum("_value").over(within), F.lit(0))).cast("long"))
        .drop("_bucket", "_value", "_start")
    )
