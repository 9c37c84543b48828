"""Filters, joins, aggregates and orders as DataFrame operations with the dialect's typing rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.errors import EngineError
from cairn.types import comparable, is_number, is_text, literal

AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def col(name: str) -> Column:
    """A column whose name may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def equals(df: DataFrame, name: str, value: int | float | str) -> Column:
    """column = literal; numbers and text never equal each other."""
    kind = df.schema[name].dataType
    if (is_number(kind) or is_text(kind)) and not comparable(kind, value):
        return F.lit(False)
    return F.coalesce(col(name) == literal(kind, value), F.lit(False)) if not (is_number(kind) or is_text(kind)) else col(name) == F.lit(value)


def between(df: DataFrame, name: str, low: int | float | str, high: int | float | str) -> Column:
    """low <= column <= high; the types have to fit."""
    kind = df.schema[name].dataType
    if (is_number(kind) or is_text(kind)) and not (comparable(kind, low) and comparable(kind, high)):
        raise EngineError(f"BETWEEN on {name} compares text with numbers")
    return col(name).between(literal(kind, low), literal(kind, high))


def inner_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Equi-join; numbers equal across types, text equals text, NaN equals nothing, and other pairs never match."""
    a, b = left.schema[left_key].dataType, right.schema[right_key].dataType
    if is_number(a) != is_number(b) or is_text(a) != is_text(b):
        return left.join(right, F.lit(False))
    on = col(left_key) == col(right_key)
    for side, kind in ((left_key, a), (right_key, b)):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            on &= ~F.isnan(col(side))
    return left.join(right, on)


def aggregate(df: DataFrame, function: str, argument: str | None) -> Column:
    """An aggregate of the dialect; COUNT counts rows whatever its argument."""
    if function == "COUNT":
        return F.count(F.lit(1))
    kind = df.schema[str(argument)].dataType
    if function in ("SUM", "AVG") and not is_number(kind):
        raise EngineError(f"{function} of {argument} needs numbers")
    return AGGREGATES[function](col(str(argument)))


def ordered(df: DataFrame, name: str, descending: bool) -> DataFrame:
    """ORDER BY one column; ties go by the other columns in schema order, all of them turned round by DESC."""
    rest = [f.name for f in df.schema.fields if f.name != name and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = [col(c) for c in (name, *rest)]
    return df.orderBy(*[k.desc() if descending else k.asc() for k in keys])
