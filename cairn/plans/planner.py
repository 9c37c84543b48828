"""Queries to DataFrames.  Clauses compose in the order WHERE, GROUP BY, ORDER BY, projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cairn.errors import EngineError, NotFound
from cairn.operators import relational as R
from cairn.operators import spatial
from cairn.sqlfront import ast


class Planner:
    """Plans over tables that ``read`` gives by name."""

    def __init__(self, read: Callable[[str], DataFrame]) -> None:
        self.read = read

    def plan(self, q: ast.Select) -> DataFrame:
        """The DataFrame of a query."""
        df, resolve = self._source(q)
        if q.where:
            df = self.filtered(df, q.where, resolve)
        aggregates = [i for i in q.items if isinstance(i, ast.Aggregate)]
        if aggregates or q.group_by:
            df, resolve = self._grouped(df, q, aggregates, resolve)
        if q.order_by:
            df = R.ordered(df, resolve(q.order_by), q.descending)
        if q.items and not aggregates and not q.group_by:
            names = list(dict.fromkeys(resolve(i) for i in q.items))
            df = df.select(*[R.col(n) for n in names])
        return df

    def _source(self, q: ast.Select) -> tuple[DataFrame, Callable[[ast.Name], str]]:
        left = self.read(q.table)
        if q.join is None:
            columns = left.columns

            def of_table(name: ast.Name) -> str:
                if name.table not in (None, q.table):
                    raise NotFound(f"no table {name.table} in this query")
                if name.column not in columns:
                    raise EngineError(f"no column {name.column} in {q.table}")
                return name.column

            return left, of_table
        right, other = self.read(q.join.table), q.join.table
        label = f"{other}_right" if other == q.table else other
        sides = {q.table: set(left.columns)}
        on = self._join_keys(q, left, right)
        left = left.select(*[R.col(c).alias(f"{q.table}.{c}") for c in left.columns])
        right = right.select(*[R.col(c).alias(f"{label}.{c}") for c in right.columns])
        sides[label] = {c.split(".", 1)[1] for c in right.columns}

        def of_join(name: ast.Name) -> str:
            found = [t for t, columns in sides.items() if name.table in (None, t) and name.column in columns]
            if len(found) != 1:
                raise EngineError(f"column {name} is " + ("ambiguous" if found else "in neither table"))
            return f"{found[0]}.{name.column}"

        return R.inner_join(left, right, f"{q.table}.{on[0]}", f"{label}.{on[1]}"), of_join

    @staticmethod
    def _join_keys(q: ast.Select, left: DataFrame, right: DataFrame) -> tuple[str, str]:
        """Keys by their prefixes; without prefixes, left and right by position."""
        assert q.join
        a, b = q.join.left, q.join.right
        for name in (a, b):
            if name.table not in (None, q.table, q.join.table):
                raise NotFound(f"no table {name.table} in this query")
        if q.table != q.join.table and (a.table == q.join.table or b.table == q.table):
            a, b = b, a
        if q.table != q.join.table and (a.table == q.join.table or b.table == q.table):
            raise EngineError("ON compares a table with itself")
        if a.column not in left.columns or b.column not in right.columns:
            raise EngineError(f"no column {a.column if a.column not in left.columns else b.column} to join on")
        return a.column, b.column

    @staticmethod
    def filtered(df: DataFrame, where: ast.Predicate, resolve: Callable[[ast.Name], str]) -> DataFrame:
        """WHERE.  In spatial predicates the name only labels the point; coordinates are found by their names."""
        if isinstance(where, ast.Equal):
            return df.where(R.equals(df, resolve(where.column), where.value))
        if isinstance(where, ast.Between):
            return df.where(R.between(df, resolve(where.column), where.low, where.high))
        x, y = spatial.coordinates(df.schema)
        if isinstance(where, ast.InRadius):
            return spatial.in_radius(df, x, y, where.x, where.y, where.radius)
        return spatial.nearest(df, x, y, where.x, where.y, where.k)

    @staticmethod
    def _grouped(df: DataFrame, q: ast.Select, aggregates: list[ast.Aggregate], resolve: Callable[[ast.Name], str]) -> tuple[DataFrame, Callable[[ast.Name], str]]:
        if not aggregates:
            raise EngineError("GROUP BY needs an aggregate")
        if len({a.alias for a in aggregates}) < len(aggregates):
            raise EngineError("two aggregates have the same name")
        key = resolve(q.group_by) if q.group_by else None
        for item in q.items:
            if isinstance(item, ast.Name) and resolve(item) != key:
                raise EngineError(f"{item} is neither grouped nor aggregated")
        columns = [R.aggregate(df, a.function, resolve(a.argument) if a.argument else None).alias(a.alias) for a in aggregates]
        out = df.groupBy(R.col(key)).agg(*columns) if key else df.agg(*columns)
        names = out.columns

        def of_group(name: ast.Name) -> str:
            for found in (str(name), name.column):
                if found in names:
                    return found
            if key and resolve(name) == key:
                return key
            raise EngineError(f"no column {name} after grouping")

        return out, of_group
