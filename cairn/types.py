"""The dialect's column types, and how literals compare with columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.errors import EngineError

SPARK_TYPES: dict[str, T.DataType] = {"INT": T.IntegerType(), "FLOAT": T.DoubleType(), "TEXT": T.StringType()}
DEFAULTS = {"INT": 0, "FLOAT": 0.0, "TEXT": ""}
INT_RANGE = (-(1 << 31), (1 << 31) - 1)


def is_number(kind: T.DataType) -> bool:
    """Whether values of the type compare with numbers."""
    return isinstance(kind, T.NumericType)


def is_text(kind: T.DataType) -> bool:
    """Whether values of the type compare with text."""
    return isinstance(kind, T.StringType)


def comparable(kind: T.DataType, value: int | float | str) -> bool:
    """Whether a literal can equal a value of the type."""
    return is_text(kind) if isinstance(value, str) else is_number(kind)


def literal(kind: T.DataType, value: int | float | str) -> Column:
    """The literal as a column to compare with; text for other types is cast, and what can't be cast is null."""
    if isinstance(value, str) and not is_text(kind):
        return F.lit(value).try_cast(kind)
    return F.lit(value)


def coerce(kind: str, value: int | float | str, name: str = "") -> int | float | str:
    """A literal as a stored value of an INT, FLOAT or TEXT column."""
    try:
        if kind == "INT":
            number = int(value)
            if not INT_RANGE[0] <= number <= INT_RANGE[1]:
                raise EngineError(f"{number} is out of range for INT column {name}")
            return number
        return float(value) if kind == "FLOAT" else str(value)
    except (ValueError, OverflowError) as e:
        if isinstance(e, EngineError):
            raise
        raise EngineError(f"{value!r} is no {kind} for column {name}") from e
