"""Algebra of posting lists: of line keys in DataFrames, and of sorted arrays in columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersect(lists: list[DataFrame]) -> DataFrame | None:
    """Rows in every list; None for no lists, one list as it is."""
    return reduce(lambda a, b: a.intersect(b), lists) if lists else None


def union(lists: list[DataFrame]) -> DataFrame | None:
    """Distinct rows of two or more lists; a single list is left as it is."""
    return None if not lists else lists[0] if len(lists) == 1 else reduce(lambda a, b: a.union(b), lists).distinct()


def subtract(universe: DataFrame, excluded: DataFrame) -> DataFrame:
    return universe.join(excluded.distinct(), universe.columns, "left_anti")


def intersect_arrays(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def union_arrays(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def subtract_arrays(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))
