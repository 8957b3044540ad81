"""Mergeable sketches of columns: quantiles (KLL) and distinct values (HyperLogLog).

The approximate variants of the exact column profile and quantiles. All columns are sketched in one aggregation, whose shuffle is one row a task; the sketches of a
load are stored, and a profile merges the stored ones without reading the data again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedwork.functions.values import ratio

RANK_K = 1000
DISTINCT_LOG_K = 13
SCHEMA = "position int, column_name string, type string, rows bigint, nulls bigint, distinct_values binary, quantiles binary"


def rank_error(k: int = RANK_K) -> float:
    """How far the rank of a quantile may be off, as a share of the rows, at 99 % confidence."""
    return 2.296 / k**0.9021  # fixed values: the published error of the sketch


def distinct_error(log_k: int = DISTINCT_LOG_K) -> float:
    """How far a distinct count may be off, as a share of it, at four standard errors."""
    return 4 * 1.04 / 2 ** (log_k / 2)


def _hashable(field: T.StructField) -> Column:
    """The column as a type the distinct sketch reads; equal values stay equal, others stay apart."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("bigint")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return c
    if isinstance(field.dataType, (T.ArrayType, T.StructType)):
        return F.to_json(F.struct(c))
    return c.cast("string")


def _number(field: T.StructField) -> Column | None:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double") if isinstance(field.dataType, T.NumericType) else None


def sketch(df: DataFrame, columns: Sequence[str] | None = None, k: int = RANK_K, log_k: int = DISTINCT_LOG_K) -> DataFrame:
    """One row per column: rows, nulls, and the sketches of its distinct values and, for numbers, of its quantiles. One aggregation."""
    fields = [df.schema[c] for c in columns or df.columns]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        aggs += [F.count(F.col(f"`{f.name}`")).alias(f"n{i}"), F.hll_sketch_agg(_hashable(f), F.lit(log_k)).alias(f"d{i}")]
        if (number := _number(f)) is not None:
            aggs.append(F.kll_sketch_agg_double(number, F.lit(k)).alias(f"q{i}"))
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("rows"),
            (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
            F.col(f"d{i}").alias("distinct_values"),
            (F.col(f"q{i}") if _number(f) is not None else F.lit(None).cast("binary")).alias("quantiles"),
        )
        for i, f in enumerate(fields)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def store(df: DataFrame, path: str, load_id: int, **options) -> None:
    """The sketches of one load, beside those of the others; a load that is run again replaces its own."""
    sketch(df, **options).write.mode("overwrite").parquet(f"{path.rstrip('/')}/load={load_id}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of all loads, merged column by column."""
    return merged(spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path))


def merged(sketches: DataFrame) -> DataFrame:
    """One row per column from those of any number of loads; a column that a load lacks has none of its rows."""
    return sketches.groupBy("column_name", "type").agg(
        F.min("position").alias("position"),
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_union_agg("distinct_values").alias("distinct_values"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def profile(sketches: DataFrame) -> DataFrame:
    """``column_name, type, rows, null_rate, distinct_count``, the last within ``distinct_error``."""
    return sketches.select(
        "column_name", "type", "rows", ratio(F.col("nulls"), F.col("rows")).alias("null_rate"), F.hll_sketch_estimate("distinct_values").alias("distinct_count")
    )


def quantiles(sketches: DataFrame, column: str, levels: Sequence[tuple[str, int, int]]) -> DataFrame:
    """``level, share, value, n``: values whose ranks are within ``rank_error`` of the levels (name, numerator, denominator); no rows without a number."""
    held = sketches.where(F.col("column_name") == column).where("quantiles is not null")
    held = held.withColumn("n", F.kll_sketch_get_n_double("quantiles")).where("n > 0")
    each = (F.struct(F.lit(name).alias("level"), F.lit(a / b).alias("share"), F.kll_sketch_get_quantile_double("quantiles", F.lit(a / b)).alias("value")) for name, a, b in levels)
    return held.select("n", F.explode(F.array(*each)).alias("l")).select("l.level", "l.share", "l.value", "n")


def ranks(df: DataFrame, number: Column, found: DataFrame) -> DataFrame:
    """``found`` (``level, share, value``; a handful) with ``below`` and ``upto``, the shares of the numbers smaller, and not larger, than the value. One pass."""
    rows = found.select("level", "share", "value").collect()
    counts = [F.count(number).alias("n")]
    for i, r in enumerate(rows):
        counts += [F.count_if(number < r["value"]).alias(f"b{i}"), F.count_if(number <= r["value"]).alias(f"u{i}")]
    told = [
        F.struct(*(F.lit(r[c]).alias(c) for c in ("level", "share", "value")), ratio(F.col(f"b{i}"), F.col("n")).alias("below"), ratio(F.col(f"u{i}"), F.col("n")).alias("upto"))
        for i, r in enumerate(rows)
    ]
    if not told:
        return found.select("level", "share", "value", F.lit(0.0).alias("below"), F.lit(0.0).alias("upto"))
    return df.agg(*counts).select(F.explode(F.array(*told)).alias("t")).select("t.*")
