"""Exact money and ratio columns, shared by every job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column | str) -> Column:
    """A binary float amount as exact cents."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(12,2)")


def rate(c: Column | str) -> Column:
    """A discount or tax rate as an exact decimal."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(4,2)")


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as a double, NULL over zero. Exact inputs give one rounding only."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def day(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("date")
