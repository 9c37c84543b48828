"""Statements of the dialect as frozen values."""

from __future__ import annotations

from dataclasses import dataclass, field

Literal = int | float | str


@dataclass(frozen=True)
class Name:
    """A column, with its table where one is written."""

    column: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Equal:
    """column = literal"""

    column: Name
    value: Literal


@dataclass(frozen=True)
class Between:
    """column BETWEEN low AND high, both included"""

    column: Name
    low: Literal
    high: Literal


@dataclass(frozen=True)
class InRadius:
    """name IN (POINT(x, y), RADIUS r)"""

    column: Name
    x: float
    y: float
    radius: float


@dataclass(frozen=True)
class Nearest:
    """name IN (POINT(x, y), K k)"""

    column: Name
    x: float
    y: float
    k: int


Predicate = Equal | Between | InRadius | Nearest


@dataclass(frozen=True)
class Aggregate:
    """COUNT, SUM, AVG, MIN or MAX of a column, or of * (None)."""

    function: str
    argument: Name | None
    alias: str


@dataclass(frozen=True)
class Join:
    """An inner join on one pair of columns."""

    table: str
    left: Name
    right: Name


@dataclass(frozen=True)
class Select:
    """A query; no items means all columns."""

    table: str
    items: tuple[Name | Aggregate, ...] = ()
    join: Join | None = None
    where: Predicate | None = None
    group_by: Name | None = None
    order_by: Name | None = None
    descending: bool = False


@dataclass(frozen=True)
class ColumnDef:
    """A column of CREATE TABLE."""

    name: str
    type: str
    index: str | None = None


@dataclass(frozen=True)
class CreateTable:
    """CREATE TABLE, with a CSV file to load where one is given."""

    table: str
    columns: tuple[ColumnDef, ...]
    file: str | None = None


@dataclass(frozen=True)
class Insert:
    """INSERT INTO ... VALUES, one tuple or more."""

    table: str
    rows: tuple[tuple[Literal, ...], ...]


@dataclass(frozen=True)
class Delete:
    """DELETE FROM ... WHERE column = literal"""

    table: str
    where: Equal


@dataclass(frozen=True)
class DropTable:
    """DROP TABLE"""

    table: str


Statement = Select | CreateTable | Insert | Delete | DropTable


@dataclass(frozen=True)
class Script:
    """Statements in order."""

    statements: tuple[Statement, ...] = field(default_factory=tuple)
