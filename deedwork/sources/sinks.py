"""Writing tables, and the load modes on top."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


class SinkError(ValueError):
    """A write that cannot be done as asked."""


def _writer(df: DataFrame, format: str, mode: str, options: dict):
    writer = df.write.format(format).mode(mode).options(**options)
    return writer.option("header", True) if format == "csv" else writer


def write(df: DataFrame, path: str, *, format: str = "parquet", mode: str = "overwrite", dry_run: bool = False, **options) -> int:
    """Write and return the row count. The count is observed on the way, not by a second pass."""
    if format not in ("parquet", "csv", "orc", "json"):
        raise SinkError(f"no writer for {format}")
    if format == "csv" and mode == "append":
        raise SinkError("appending to CSV is refused")
    if dry_run:
        return df.count()
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    _writer(observed, format, mode, options).save(path)
    return seen.get["rows"]


def write_targets(df: DataFrame, targets: Sequence[tuple[str, str]]) -> dict[str, int]:
    """One result to several ``(path, format)`` targets, computed once."""
    kept = df.persist()
    try:
        return {path: write(kept, path, format=format) for path, format in targets}
    finally:
        kept.unpersist()


def land_partitioned(df: DataFrame, path: str, partition_by: Sequence[str], *, required: Sequence[str] = (), mode: str = "refresh") -> None:
    """Hive layout. A refresh replaces only the partitions it writes; an append adds files.

    A NULL in a required column fails the job before anything is committed.
    """
    checked = df
    for c in required:
        refuse = F.raise_error(F.lit(f"column {c} is required and holds a NULL")).cast(df.schema[c].dataType)
        checked = checked.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(refuse))
    writer = checked.write.partitionBy(*partition_by).format("parquet")
    if mode == "append":
        writer.mode("append").save(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or ``None`` before the first load."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def full_refresh(df: DataFrame, path: str) -> int:
    return write(df, path)


def past_cursor(df: DataFrame, cursor: str, last) -> DataFrame:
    """Rows later than the stored cursor; without one, all rows."""
    return df if last is None else df.where(F.col(cursor) > F.lit(last))


def incremental_append(df: DataFrame, path: str, cursor: str) -> int:
    """Append the rows past the target's own newest cursor value.

    The cursor is read from what is committed, so a load that failed half-way is simply run again.
    """
    held = existing(df.sparkSession, path)
    last = None if held is None else held.agg(F.max(cursor)).first()[0]
    return write(past_cursor(df, cursor, last), path, mode="append")


def newest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one of largest ``order``.

    The rank is bounded, so each task keeps one row of a key before the shuffle.
    """
    order_by = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_nth", F.row_number().over(order_by)).where("_nth = 1").drop("_nth")


def merge(target: DataFrame, changes: DataFrame, key: Sequence[str], deleted: str | None = None) -> DataFrame:
    """Upsert: a changed key takes the change, the others stay; a change marked deleted drops it.

    ``changes`` has one row per key and the target's columns (plus ``deleted``); a key that repeats fails the job, as it would
    multiply the target's row.
    """
    columns = target.columns
    # The bounded rank keeps two rows of a key at most; the second one is the failure.
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    checked = changes.withColumn("_nth", nth).where("_nth <= 2")
    once = F.when(F.col("_nth") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"a change repeats its key {list(key)}")).cast("boolean"))
    changes = checked.where(once).drop("_nth")
    old = target.select(F.struct(*columns).alias("_old"), *[F.col(k).alias(f"_a_{k}") for k in key])
    flag = F.col(deleted) if deleted else F.lit(False)
    new = changes.select(F.struct(*columns).alias("_new"), flag.alias("_gone"), *[F.col(k).alias(f"_b_{k}") for k in key])
    test = reduce(lambda a, b: a & b, [F.col(f"_a_{k}") == F.col(f"_b_{k}") for k in key])
    joined = old.join(new, test, "full").where(F.col("_new").isNull() | ~F.coalesce("_gone", F.lit(False)))
    row = F.when(F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    return joined.select(row.alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in columns])


def apply_changes(target: DataFrame, feed: DataFrame, key: Sequence[str], *, sequence: str, operation: str) -> DataFrame:
    """A change feed applied in order: only the last change of each key matters."""
    last = newest_per_key(feed, key, [sequence]).withColumn("_deleted", F.col(operation) == "delete")
    return merge(target, last, key, deleted="_deleted")


def smaller_cursor(old: Column, new: Column) -> Column:
    """Whether the cursor went back: compared as numbers when both are, else as ISO text."""
    a, b = old.try_cast("decimal(38,6)"), new.try_cast("decimal(38,6)")
    numeric = a.isNotNull() & b.isNotNull()
    return F.coalesce(F.when(numeric, b < a).otherwise(new < old), F.lit(False))


def rewound_consumers(cursors: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct consumers of products whose cursor went back.

    ``cursors``: product, old, new. ``edges``: product, consumer.
    """
    back = cursors.where(smaller_cursor(F.col("old").cast("string"), F.col("new").cast("string")))
    return (
        edges.join(back.select("product"), "product", "left_semi")
        .groupBy("consumer")
        .agg(F.countDistinct("product").alias("rewound_products"))
    )
