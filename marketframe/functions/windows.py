"""Window helpers: per-symbol order, strict rolling aggregates, runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-9


def by_symbol(*order: str | Column) -> WindowSpec:
    """Rows of a symbol in time order (or in the given order)."""
    return Window.partitionBy("symbol").orderBy(*(order or ("ts",)))


def rows(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return (w or by_symbol()).rowsBetween(-(n - 1), 0)


def running(w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_symbol()).rowsBetween(Window.unboundedPreceding, 0)


def strict(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """agg over the last n rows, null unless all n hold a value."""
    return F.when(F.count(x).over(rows(n, w)) == n, agg(x).over(rows(n, w)))


def nonzero(x: Column) -> Column:
    """x, or EPS where it is zero: a safe divisor."""
    return F.when(x == 0, F.lit(EPS)).otherwise(x)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also where it is unknown)."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def run_length(condition: Column, w: WindowSpec | None = None) -> Column:
    """How many rows up to this one hold the condition without a break; 0 where it doesn't hold."""
    row = F.row_number().over(w or by_symbol())
    broken = F.last(F.when(~F.coalesce(condition, F.lit(False)), row), True).over(running(w))
    return (row - F.coalesce(broken, F.lit(0))).cast("bigint")
