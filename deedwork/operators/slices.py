"""Ordered work that no single task has to do alone.

A running total, a rank or a quantile over one long order would put every row in one window
partition. Here the order is cut into slices: each slice is summarised, the (few) summaries are
accumulated, and each slice finishes on its own with what came before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedwork.session import materialized

def slice_count(df: DataFrame) -> int:
    """Two slices for each task that reads ``df`` or, if that is more, for each shuffle partition."""
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 2 * max(shuffled, df.rdd.getNumPartitions())


def slice_bounds(df: DataFrame, column: str, slices: int | None = None) -> list[float]:
    """At most ``slices`` cut points with about equally many rows between them.

    They only balance the work: any cut points give the same result, so an approximate sketch
    will do. They come to the driver as at most
    ``slices`` plain numbers, so every branch of a plan uses the same.
    """
    slices = slices or slice_count(df)
    steps = [i / slices for i in range(1, slices)]
    found = df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", steps, 1 / (4 * slices))
    return sorted(set(found))


def slice_of(column: Column, bounds: Sequence[float]) -> Column:
    """How many cut points lie below the value: never decreasing in the value.

    A halving search written as nested conditions: as many comparisons as the number of cut points has bits.
    """
    value = column.cast("double")

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(float(bounds[middle])), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(bounds))


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], bounds: Sequence[float]
) -> DataFrame:
    """``df`` with each output column the sum of its value over all smaller ``order`` of the same keys.

    ``values`` is ``{output: column}``; ``df`` has one row per (keys, order). Only the slices'
    totals go through a window over the whole order of a key.
    """
    keys = list(keys)
    cut = df.withColumn("_slice", slice_of(F.col(order), bounds))
    totals = cut.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in values.items()])
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_t_{out}").over(ahead), F.lit(0)).alias(f"_e_{out}") for out in values]
    )
    here = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = cut.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"_h_{out}") for out, c in values.items()])
    return within.join(earlier, [*keys, "_slice"]).select(
        *df.columns, *[(F.col(f"_e_{out}") + F.col(f"_h_{out}")).alias(out) for out in values]
    )


def running_counts(counts: DataFrame, value: str, n: str, bounds: Sequence[float]) -> DataFrame:
    """Per distinct ``value`` with its count ``n``: ``before``, the count of all smaller values."""
    return running_sums(counts, [], value, {"before": n}, bounds).withColumn("before", F.col("before").cast("bigint"))


def value_counts(df: DataFrame, column: str, n: Column | None = None) -> DataFrame:
    """``column, n``: every known value once, with its rows; kept, as several passes follow."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg((F.count("*") if n is None else F.sum(n)).alias("n"))
    return materialized(counts, f"values-{column}")


def mid_ranks(counts: DataFrame, column: str) -> DataFrame:
    """Per distinct value of :func:`value_counts`: twice its mid-rank, a whole number."""
    run = running_counts(counts, column, "n", slice_bounds(counts, column))
    return run.withColumn("mid_rank_x2", F.col("before") * 2 + F.col("n") + 1)


def quantile_values(df: DataFrame, column: str, levels: Sequence[tuple[str, int, int]]) -> DataFrame:
    """The exact value at rank ceil(p·N) (the lowest for p = 0), for levels ``(name, top, bottom)``.

    The level ``top/bottom`` is a ratio of whole numbers, so the rank is exact.
    """
    counts = value_counts(df, column)
    run = running_counts(counts, column, "n", slice_bounds(counts, column))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    asked = F.array(
        *[F.struct(F.lit(name).alias("level"), F.lit(a).alias("a"), F.lit(b).alias("b")) for name, a, b in levels]
    )
    each = run.withColumn("total", total).withColumn("q", F.explode(asked))
    rank = F.greatest(F.lit(1), F.expr("(total * q.a + q.b - 1) div q.b"))
    return each.where((rank > F.col("before")) & (rank <= F.col("before") + F.col("n"))).select(
        F.col("q.level").alias("level"), F.col(column).alias("value")
    )


def next_in_order(df: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """``out``: the next larger ``order`` of the same key, where ``order`` may be a struct.

    ``df`` has one row per (keys, order). The whole order is cut into ranges of about equally many rows, so a key with very many rows, on however few days,
    spreads over ranges: the first value of a key in each range stands for it, and only those are ordered per key. The ranges are drawn by a
    sample, so what they are is written down once.
    """
    keys = list(keys)
    cut = df.repartitionByRange(*keys, order).withColumn("_slice", F.spark_partition_id())
    cut = materialized(cut, "ordered-ranges")
    firsts = cut.groupBy(*keys, "_slice").agg(F.min(order).alias("_first"))
    following = firsts.select(
        *keys,
        "_slice",
        F.lead("_first").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_following"),
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(order)
    return (
        cut.withColumn("_next", F.lead(order).over(within))
        .join(following, [*keys, "_slice"])
        .withColumn(out, F.coalesce("_next", "_following"))
        .drop("_slice", "_next", "_following")
    )
