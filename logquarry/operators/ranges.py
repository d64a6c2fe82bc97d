"""Filters by numbers and times that stand in the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import number
from ..plans.lowering import predicate
from ..plans.query import Range
from .search import in_time


def filter_range(lines: DataFrame, field: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Lines whose status, size or timestamp (epoch milliseconds) is in [low, high]; lines without one go, and so does any other field."""
    return lines.where(predicate(Range(field, low, high)))


def filter_time(lines: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    return lines.where(in_time(F.col("content"), since, until))


def with_number(lines: DataFrame, field: str) -> DataFrame:
    return lines.withColumn(field, number(F.col("content"), field))
