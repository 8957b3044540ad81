"""Running a stream into tables: each micro-batch lands once, broken records in a table of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedwork.operators.schema import required_violation
from deedwork.sources.readers import CORRUPT, decode_json

BATCH = "batch_id"
STATE_SUFFIX = "__state"
MOST_DEAD_LETTERS = 10_000


class TooManyDeadLetters(RuntimeError):
    """More records were broken than the stream tolerates."""


def land_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch under its own id. Written again, it replaces itself, so it lands once."""
    batch.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        BATCH
    ).parquet(path)


def batch_rows(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """The rows that one micro-batch landed; only its own partition is read."""
    held = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.IntegerType())]))
    return held.parquet(path).where(F.col(BATCH) == batch_id).drop(BATCH)


def noted(spark: SparkSession, path: str, batch_id: int, kind: T.DataType) -> Column:
    """What batch ``batch_id`` noted, NULL before the first one."""
    if batch_id < 0:
        return F.lit(None).cast(kind)
    return batch_rows(spark, path, batch_id, T.StructType([T.StructField("value", kind)])).scalar()


def note(batch: DataFrame, batch_id: int, path: str, own: Column, together, kind: T.DataType) -> None:
    """Carry a running value from batch to batch, in a table of one row a batch.

    ``own`` aggregates this batch; ``together(own, before)`` adds what the batch before noted. Run again, a batch notes the same.
    Each batch reads one row, so the work does not grow with the stream.
    """
    before = noted(batch.sparkSession, path, batch_id - 1, kind)
    value = together(F.col("own"), before).cast(kind).alias("value")
    land_batch(batch.agg(own.alias("own")).select(value), batch_id, path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run the stream over what is there now, one call per micro-batch, and wait for it."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def land_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    run_available(stream, checkpoint, lambda batch, batch_id: land_batch(batch, batch_id, path))


def landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What has landed, without the batch ids. An empty target is an empty table."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.IntegerType())])).parquet(path).drop(BATCH)


@dataclass(frozen=True)
class TopicSpec:
    """What a topic's records must be: typed fields, the required ones not nullable."""

    value: T.StructType
    key: T.StructType | None = None


def checked_records(records: DataFrame, spec: TopicSpec) -> DataFrame:
    """Decoded records with ``error``: the first reason a record cannot land, or NULL.

    Decoding comes first, then the required fields in declared order, at any depth.
    """
    decoded = decode_json(records, spec.value, spec.key)
    why = F.when(
        F.col("value").isNull() | F.col(f"value.{CORRUPT}").isNotNull(), "the value is not JSON of the declared fields and types"
    )
    if spec.key is not None:
        why = why.when(F.col(f"key.{CORRUPT}").isNotNull(), "the key is not JSON of the declared fields and types")
    fields = decoded.select("*", *[F.col(f"value.{f.name}").alias(f.name) for f in spec.value.fields])
    return fields.withColumn("error", F.coalesce(why, required_violation(spec.value)))


PLACE = ("topic", "partition", "offset")


def split_records(records: DataFrame, spec: TopicSpec) -> tuple[DataFrame, DataFrame]:
    """``(rows to land, dead letters)``. A dead letter keeps the raw bytes and where it was read."""
    checked = checked_records(records, spec)
    good = checked.where("error IS NULL").select(*[f.name for f in spec.value.fields], "key", *PLACE)
    dead = checked.where("error IS NOT NULL").select("error", F.col("raw_value").alias("value"), *PLACE)
    return good, dead


def land_checked(
    records: DataFrame, spec: TopicSpec, path: str, dead_path: str, checkpoint: str, *, most_dead: int = MOST_DEAD_LETTERS, transform=None
) -> None:
    """Land good records and dead letters from one stream, both keyed by the batch id.

    The run stops after the batch that takes the dead letters past ``most_dead``; that batch has
    landed on both sides, so nothing is lost. Their number is carried beside the dead letters, one row a batch,
    which also holds after a restart.
    """
    counts = dead_path.rstrip("/") + STATE_SUFFIX

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, kept = batch.sparkSession, batch.persist()
        try:
            good, dead = split_records(kept, spec)
            land_batch(good if transform is None else good.transform(transform), batch_id, path)
            land_batch(dead, batch_id, dead_path)
        finally:
            kept.unpersist()
        mine = batch_rows(spark, dead_path, batch_id, dead.schema)
        note(mine, batch_id, counts, F.count(F.lit(1)), lambda own, before: own + F.coalesce(before, F.lit(0)), T.LongType())
        total = spark.range(1).select(noted(spark, counts, batch_id, T.LongType())).first()[0]
        if total > most_dead:
            raise TooManyDeadLetters(f"{total} dead letters, {most_dead} allowed")

    run_available(records, checkpoint, each)


def flatten(df: DataFrame, *, items: str, fields: dict[str, str]) -> DataFrame:
    """One row per element of ``items``; ``fields`` are SQL expressions that may read ``item``."""
    each = df.withColumn("item", F.explode(items))
    return each.select(*[F.expr(e).alias(name) for name, e in fields.items()])
