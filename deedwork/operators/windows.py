"""Group values beside rows, capped counts, ordered limits, and small helpers around them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedwork.session import materialized


def beside_group(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Aggregates of a row's group beside the row, as AGG OVER (PARTITION BY keys).

    Aggregated first and joined back: each task pre-aggregates, and a hot group is a skewed join
    side that can be split, where a window would hold the whole group in one task. NULL keys are
    one group, as in a window.
    """
    groups = df.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(
        *[c.alias(name) for name, c in values.items()]
    )
    test = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    )
    return df.join(groups, test).drop(*[f"_g{i}" for i in range(len(keys))])


def capped_counts(df: DataFrame, unit: Sequence[str], cell: Sequence[str], cap: int) -> DataFrame:
    """Per cell: ``capped``, where a unit counts at most ``cap`` rows, beside ``uncapped``."""
    held = df.groupBy(*unit, *cell).agg(F.count("*").alias("n"))
    return held.groupBy(*cell).agg(
        F.sum(F.least(F.col("n"), F.lit(cap))).alias("capped"), F.sum("n").alias("uncapped")
    )


def with_levels(df: DataFrame, name: str, levels: Sequence[str]) -> DataFrame:
    """Every row once per declared level."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))


def level_spine(spark, name: str, levels: Sequence[str]) -> DataFrame:
    """The declared levels as a table."""
    return with_levels(spark.range(1).drop("id"), name, levels)


def labelled(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Several results of one shape under a label column."""
    each = [df.withColumn(name, F.lit(label)) for label, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), each)


def repeated_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values the columns hold more than once: an order over them alone is not total."""
    return df.groupBy(*columns).agg(F.count("*").alias("rows")).where("rows > 1")


def top_rows(
    df: DataFrame, order: Sequence[Column], *, key: Sequence[str], limit: int, offset: int = 0, tie_column: str
) -> DataFrame:
    """LIMIT under a total order: ``key`` (unique) settles the ties of ``order``.

    ``tied_outside`` is how many rows equal the last returned one on ``tie_column`` and were
    left out only by the key.
    """
    total = [*order, *[F.asc(k) for k in key]]
    # The table is ordered once; all else is read off the few rows of its head.
    head = materialized(df.orderBy(*total).limit(offset + limit), "top-rows")
    ranked = head.withColumn("_nth", F.row_number().over(Window.orderBy(*total)))
    edge = ranked.where(F.col("_nth") == offset + limit).select(tie_column)
    tied = df.where(F.col(tie_column) == edge.scalar()).agg(F.count("*").alias("n"))
    inside = head.where(F.col(tie_column) == edge.scalar()).agg(F.count("*").alias("n"))
    top = ranked.where(F.col("_nth") > offset).drop("_nth")
    return top.withColumn("tied_outside", F.coalesce(tied.scalar() - inside.scalar(), F.lit(0)))
