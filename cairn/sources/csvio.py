"""CSV files: header names, types by a sample, and loading with the dialect's coercion.

By name, if the header has all columns of the table; else by position, where
the header line is data like any other.  A malformed number is 0, an INT out of
range or a number missing from a short line skips the line, and a missing text
is empty.  Quoted fields may hold line breaks; only a file in which some line has
an odd number of quotes is read as a whole, others are split between tasks.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.errors import EngineError, NotFound
from cairn.types import DEFAULTS

log = logging.getLogger(__name__)
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
SAMPLE_ROWS = 50
_NONE, _BAD = "\u0001", "_unparsed"


def find(path: str, folders: tuple[str, ...] = ()) -> str:
    """A path as given, then under each folder, then its last part there; other stores' paths stay as they are."""
    if "://" in path:
        return path
    tries = [path, *[os.path.join(f, p) for f in folders for p in (path, os.path.basename(path))]]
    for name in tries:
        if os.path.exists(name):
            return os.path.abspath(name)
    raise NotFound(f"no file {path}")


def clean_name(raw: str) -> str:
    """A header as a column name."""
    name = "".join(c if c.isalnum() or c == "_" else "_" for c in (raw or "").strip()).strip("_") or "col"
    return f"c_{name}" if name[0].isdigit() else name


def clean_names(header: list[str]) -> list[str]:
    """Headers as distinct names: repeated ones get _2, _3 and so on."""
    out: list[str] = []
    for raw in header:
        base = name = clean_name(raw)
        n = 2
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field can go on in the next line: such a line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def header_of(spark: SparkSession, path: str, spans: bool = False) -> list[str]:
    """The first record's fields."""
    first = spark.read.options(header=False, escape='"', multiLine=spans).csv(path).head(1)
    if not first:
        raise EngineError("the file is empty")
    return [x or "" for x in first[0]]


def raw_rows(spark: SparkSession, path: str, width: int, header: bool, spans: bool = False) -> DataFrame:
    """All fields as text in c0, c1 ..., and the line itself where its number of fields differs."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)] + [T.StructField(_BAD, T.StringType())])
    return spark.read.schema(schema).options(header=header, enforceSchema=True, columnNameOfCorruptRecord=_BAD, mode="PERMISSIVE", nullValue=_NONE, escape='"', multiLine=spans).csv(path)


def is_integer(c: Column) -> Column:
    """Whether text reads as a whole number."""
    return F.trim(c).rlike(INTEGER)


def is_decimal(c: Column) -> Column:
    """Whether text reads as a number."""
    return F.trim(c).rlike(DECIMAL)


def infer(spark: SparkSession, path: str, rows: int = SAMPLE_ROWS) -> dict:
    """Columns suggested from the first rows: {columns: [{name, type, original?, size?}], sampled}."""
    spans = spans_lines(spark, path)
    header = header_of(spark, path, spans)
    width = len(header)
    sample = raw_rows(spark, path, width, True, spans).limit(max(1, rows))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = [F.count(F.lit(1)).alias("n")]
    for i in range(width):
        c = F.col(f"c{i}")
        checks += [
            F.coalesce(F.bool_and(F.when(~blank(c), is_integer(c))), F.lit(False)).alias(f"i{i}"),
            F.coalesce(F.bool_and(F.when(~blank(c), is_decimal(c))), F.lit(False)).alias(f"f{i}"),
            F.coalesce(F.max(F.length(c)), F.lit(0)).alias(f"w{i}"),
        ]
    found = sample.agg(*checks).first()
    columns = []
    for i, (raw, name) in enumerate(zip(header, clean_names(header), strict=True)):
        column = {"name": name, "type": "INT" if found[f"i{i}"] else "FLOAT" if found[f"f{i}"] else "TEXT"}
        if name != raw.strip():
            column["original"] = raw
        if column["type"] == "TEXT":
            column["size"] = max(16, -(-found[f"w{i}"] // 8) * 8)
        columns.append(column)
    return {"columns": columns, "sampled": found["n"]}


def load(spark: SparkSession, path: str, columns: list[dict], sizes: dict[str, int] | None = None) -> DataFrame:
    """The file's rows as a table of ``columns`` ({name, type}); text is cut to ``sizes`` characters where given."""
    spans = spans_lines(spark, path)
    header = header_of(spark, path, spans)
    names = clean_names(header)
    by_name = {c["name"] for c in columns} <= set(names)
    width = len(names) if by_name else max(len(names), len(columns))
    if not by_name:
        log.warning("%s: the header has not all columns; loading by position, header line included", path)
    raw = raw_rows(spark, path, width, by_name, spans)
    some = F.array_max(F.array(*[F.when(F.col(f"c{i}").isNotNull(), i).otherwise(-1) for i in range(width)]))
    short = F.col(_BAD).isNotNull() & F.col(f"c{width - 1}").isNull()
    rows = raw.withColumn("_last", F.when(short, some).otherwise(width))
    out, whole = [], some >= 0
    for i, column in enumerate(columns):
        place = names.index(column["name"]) if by_name else i
        c, kind, name = F.col(f"c{place}"), column["type"], column["name"]
        text = F.coalesce(c, F.lit(""))
        if kind != "TEXT" and by_name:
            whole &= F.col("_last") >= place
        if kind == "INT":
            whole &= ~(is_integer(text) & F.trim(text).try_cast("int").isNull())
            out.append(F.coalesce(F.when(is_integer(text), F.trim(text).try_cast("int")), F.lit(DEFAULTS["INT"])).cast("int").alias(name))
        elif kind == "FLOAT":
            out.append(F.coalesce(F.when(is_decimal(text), F.trim(text).try_cast("double")), F.lit(DEFAULTS["FLOAT"])).alias(name))
        else:
            most = (sizes or {}).get(name)
            out.append((F.left(text, F.lit(most)) if most else text).alias(name))
    return rows.where(whole).select(*out)
