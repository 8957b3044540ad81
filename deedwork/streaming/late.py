"""Late data: classifying, splitting, and finding the event-time column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedwork.functions.durations import seconds_of
from deedwork.streaming.landing import BATCH, STATE_SUFFIX, land_batch, land_stream, landed, note, noted, run_available

LATE_SUFFIX = "__late_events"
ADMITTED_SUFFIX = "__admitted"
# Names that mean event time.
EVENT_TIME_NAMES = ("event_time", "event_at", "occurred_at", "ts", "timestamp", "created_at", "recorded_at")


def event_time_column(schema: T.StructType, explicit: str | None = None) -> str | None:
    """The named column, else one with a name that means event time, else the first with a time."""
    if explicit:
        return explicit
    timed = [
        f.name for f in schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    ]
    named = [c for c in timed if c.lower() in EVENT_TIME_NAMES]
    return (named or timed or [None])[0]


def seconds_behind(event_time: Column, watermark: Column) -> Column:
    """Exact microseconds from the event to the watermark, as seconds."""
    micros = F.timestamp_diff("MICROSECOND", event_time, watermark)
    return micros.cast("decimal(18,0)") / F.lit(1000000).cast("decimal(7,0)")


def classify(df: DataFrame, column: str, watermark: Column, allowed_lateness: str | None) -> DataFrame:
    """``category`` (on_time, late, future) and ``lateness_seconds`` of each row.

    Without a budget everything up to the watermark is on time; a row ahead of it is kept apart.
    """
    behind = seconds_behind(F.col(column), watermark)
    late = F.lit(False) if allowed_lateness is None else behind > seconds_of(allowed_lateness)
    return df.withColumns(
        {
            "category": F.when(behind < 0, "future").when(late, "late").otherwise("on_time"),
            "lateness_seconds": F.when((behind < 0) | late, behind.cast("double")).otherwise(0.0),
        }
    )


def split_late(df: DataFrame, column: str, allowed_lateness: str, newest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(kept, late)``: late rows are older than the newest event time less the budget.

    Once split, the kept rows split into nothing more. A budget of zero or less splits nothing.
    """
    budget = seconds_of(allowed_lateness) if not allowed_lateness.startswith("-") else 0
    if budget <= 0:
        return df, df.where(F.lit(False))
    edge = newest if newest is not None else df.select(F.max(column).alias("m")).scalar()
    behind = seconds_behind(F.col(column), edge)
    is_late = F.coalesce(behind > budget, F.lit(False))
    return df.where(~is_late), df.where(is_late)


def _note_newest(batch: DataFrame, batch_id: int, path: str, column: str) -> None:
    """Note the newest event time up to this batch."""
    kind = batch.schema[column].dataType
    note(batch, batch_id, path, F.max(column), lambda own, before: F.greatest(own, before), kind)


def newest_time(spark: SparkSession, path: str, kind: T.DataType) -> Column:
    """The newest event time of all batches, from their notes: one row a batch."""
    notes = spark.read.schema(T.StructType([T.StructField("value", kind)])).parquet(path)
    return notes.agg(F.max("value").alias("m")).scalar()


def land_split(batch: DataFrame, batch_id: int, path: str, late_path: str, *, column: str, allowed_lateness: str) -> None:
    """One micro-batch split against the newest event time up to it, this batch included.

    That time is carried beside the target, one row a batch, so it survives a restart, and a
    batch that runs again splits the same way.
    """
    state = path.rstrip("/") + STATE_SUFFIX
    _note_newest(batch, batch_id, state, column)
    newest = noted(batch.sparkSession, state, batch_id, batch.schema[column].dataType)
    kept, late = split_late(batch, column, allowed_lateness, newest)
    land_batch(kept, batch_id, path)
    land_batch(late, batch_id, late_path)


def settled(spark: SparkSession, path: str, late_path: str, schema: T.StructType, *, column: str, allowed_lateness: str) -> tuple[DataFrame, DataFrame]:
    """``(kept, late)`` of all that has landed, as if it had come in one batch.

    What was on time when it landed and is late by now counts as late; nothing that landed is left out.
    """
    newest = newest_time(spark, path.rstrip("/") + STATE_SUFFIX, schema[column].dataType)
    kept, since = split_late(landed(spark, path, schema), column, allowed_lateness, newest)
    return kept, landed(spark, late_path, schema).unionByName(since)


def _land_admitted(batch: DataFrame, batch_id: int, path: str, late_path: str, *, column: str, delay: str) -> None:
    """One micro-batch split at the watermark: the newest event time of earlier batches less ``delay``."""
    state, kind = path.rstrip("/") + STATE_SUFFIX, batch.schema[column].dataType
    mark = noted(batch.sparkSession, state, batch_id - 1, kind) - F.make_dt_interval(secs=F.lit(seconds_of(delay)))
    behind = F.col(column).isNull() | F.coalesce(F.col(column) < mark, F.lit(False))
    land_batch(batch.where(~behind), batch_id, path)
    land_batch(batch.where(behind), batch_id, late_path)
    _note_newest(batch, batch_id, state, column)


def land_once(stream: DataFrame, path: str, late_path: str, checkpoint: str, *, column: str, key: str, delay: str) -> None:
    """Land the rows that a watermark ``delay`` behind the newest event time admits, once for each key, and all others as late rows.

    Two streams run one after the other. The first splits each micro-batch at the watermark of the batches before it; rows behind it, and rows without an event
    time, are kept beside the table and none is lost. The second drops repeats among the admitted rows with the engine's keyed state, which forgets
    a key when the watermark has passed it; no batch reads the target. Its own watermark stays behind the first one by a second, so it takes every admitted row.
    """
    admitted = path.rstrip("/") + ADMITTED_SUFFIX

    def split(batch: DataFrame, batch_id: int) -> None:
        _land_admitted(batch, batch_id, admitted, late_path, column=column, delay=delay)

    run_available(stream, f"{checkpoint.rstrip('/')}/split", split)
    fields = T.StructType([*stream.schema.fields, T.StructField(BATCH, T.IntegerType())])
    rows = stream.sparkSession.readStream.schema(fields).parquet(admitted).drop(BATCH)
    kind = rows.schema[column].dataType
    timed = rows.withColumn("_at", F.col(column).cast("timestamp")).withWatermark("_at", f"{int(seconds_of(delay)) + 1} seconds")
    land_stream(timed.dropDuplicatesWithinWatermark([key]).drop("_at").withColumn(column, F.col(column).cast(kind)), path, f"{checkpoint.rstrip('/')}/once")


def freshness(commits: DataFrame, reference: str, objective: str, *, table: str, at: str, operation: str) -> DataFrame:
    """Per table, the age of the newest commit that wrote data, against the objective.

    A compaction rewrites files but writes no data, so it does not count. A commit ahead of the
    reference has age zero.
    """
    limit = seconds_of(objective)
    wrote = F.col(operation).isin("append", "overwrite", "delete")
    newest = commits.groupBy(table).agg(
        F.max(F.when(wrote, F.col(at))).alias("last_write"), F.count_if(wrote).alias("writes")
    )
    age = F.greatest(F.timestamp_diff("SECOND", "last_write", F.lit(reference).cast("timestamp_ntz")), F.lit(0))
    return newest.select(
        table,
        "writes",
        age.alias("age_seconds"),
        F.when(F.col("last_write").isNull(), "fail").when(age <= limit, "pass").otherwise("fail").alias("verdict"),
    )
