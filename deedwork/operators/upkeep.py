"""Table upkeep: compaction, erasure, retention, version expiry, and pre-land hooks."""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from deedwork.functions.durations import seconds_of
from deedwork.session import materialized, ship_package
from deedwork.sources.files import place

NEAR_TARGET = 0.75
MOST_TASKS = 10_000

Hook = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes`` of a table's data files, listed without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def _bins(target_bytes: int):
    """Best fit decreasing: a file goes where it leaves the least room, the largest first."""

    def run(files: pd.DataFrame) -> pd.DataFrame:
        rooms: list[tuple[int, int]] = []  # (room left, bin)
        bins: list[list[int]] = []
        files = files.sort_values(["bytes", "file"], ascending=[False, True]).reset_index(drop=True)
        for k, size in enumerate(files["bytes"].tolist()):
            at = bisect_left(rooms, (size, -1))
            if at < len(rooms):
                room, n = rooms.pop(at)
            else:
                room, n = target_bytes, len(bins)
                bins.append([])
            bins[n].append(k)
            insort(rooms, (room - size, n))
        names = files["file"].tolist()
        rows = [(files["folder"][0], [names[k] for k in own]) for own in bins if len(own) > 1]
        return pd.DataFrame(rows, columns=["folder", "files"])

    return run


def small_file_bins(files: DataFrame, target_bytes: int) -> DataFrame:
    """``folder, files``: which files to merge. Those over ``NEAR_TARGET`` of the target stay as they are, and so does one that has no other beside it."""
    folder = F.regexp_replace("file", "/[^/]*$", "").alias("folder")
    small = files.where(F.col("bytes") <= NEAR_TARGET * target_bytes).select("file", "bytes", folder)
    return small.groupBy("folder").applyInPandas(_bins(target_bytes), "folder string, files array<string>")


def _merged(schema: pa.Schema, staging: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, sources in zip(batch.column("folder").to_pylist(), batch.column("files").to_pylist(), strict=True):
                new = f"{staging}/merged-{uuid.uuid4().hex}.parquet"
                system, inner = place(staging)
                system.create_dir(inner, recursive=True)
                system, inner = place(new)
                rows, writer = 0, None
                with system.open_output_stream(inner) as out:
                    for source in sources:
                        own, path = place(source)
                        with own.open_input_file(path) as data:
                            held = pq.ParquetFile(data)
                            if writer is None:
                                writer = pq.ParquetWriter(out, schema.with_metadata(held.schema_arrow.metadata), compression="snappy")
                            for part in held.iter_batches():
                                columns = [part.column(f.name).cast(f.type) if f.name in part.schema.names else pa.nulls(part.num_rows, f.type) for f in schema]
                                writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=writer.schema))
                                rows += part.num_rows
                    writer.close()
                yield pa.RecordBatch.from_pylist([{"folder": folder, "new": new, "sources": sources, "rows": rows}])

    return run


def _swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, new, sources in zip(*(batch.column(c).to_pylist() for c in ("folder", "new", "sources")), strict=True):
            system, inner = place(new)
            _, final = place(f"{folder}/{new.rpartition('/')[2]}")
            if system.get_file_info(inner).type == fs.FileType.File:
                system.move(inner, final)
            for source in sources:
                path = place(source)[1]
                if system.get_file_info(path).type == fs.FileType.File:
                    system.delete_file(path)
            yield pa.RecordBatch.from_pylist([{"replaced": len(sources)}])


def swap_files(merged: DataFrame) -> int:
    """Put merged files in the place of their sources. ``merged`` is stored, so this is run again if it was cut short, which finishes it."""
    return merged.mapInArrow(_swap, "replaced bigint").agg(F.coalesce(F.sum("replaced"), F.lit(0))).first()[0]


def compact_files(spark: SparkSession, path: str, staging: str, target_bytes: int) -> tuple[int, int]:
    """Merge the small files of a Parquet table, folder by folder, into files of up to ``target_bytes``; returns the file counts before and after.

    Files near the target are not read, and no row is shuffled: a task reads the files of one bin and writes them as one under ``staging``, a folder of the same store.
    Only when all are written, and listed by the tasks that succeeded, do they take the place of their sources, one bin after the other; a reader waits until
    then. Partition folders and the order of columns stay; a column that a file lacks is NULL.
    """
    ship_package(spark)
    root = spark._jvm.org.apache.hadoop.fs.Path(staging)
    staging = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    files = materialized(file_sizes(spark, path), "table-files")
    before, folders = files.count(), set(partition_columns(spark, path))
    table = spark.read.option("mergeSchema", True).parquet(path)
    schema = to_arrow_schema(T.StructType([f for f in table.schema.fields if f.name not in folders]))
    bins = materialized(small_file_bins(files, target_bytes), "file-bins")
    tasks = min(max(bins.count(), 1), MOST_TASKS)
    merged = bins.repartition(tasks).mapInArrow(_merged(schema, staging), "folder string, new string, sources array<string>, rows bigint")
    swap_files(materialized(merged, "merged-files"))
    return before, file_sizes(spark, path).count()


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns a table's folders are named after, from the path of any of its files."""
    one = file_sizes(spark, path).select("file").first()
    inner = one["file"].split(path.rstrip("/").rpartition("/")[2] + "/", 1)[1] if one else ""
    return [part.partition("=")[0] for part in inner.split("/")[:-1] if "=" in part]


def erase_rows(df: DataFrame, subjects: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table without the subjects' rows. A NULL key is nobody's."""
    return df.join(subjects.select(*key).distinct(), list(key), "left_anti")


def blank_rows(df: DataFrame, subjects: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The table with the named columns of the subjects' rows set to NULL."""
    marked = df.join(subjects.select(*key).distinct().withColumn("_hit", F.lit(True)), list(key), "left")
    return marked.select(
        *[F.when(F.col("_hit").isNull(), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def retention_sweep(df: DataFrame, column: str, keep: str, reference: str) -> DataFrame:
    """Rows no older than the duration before ``reference``. The bound is a literal, so it is pushed down."""
    edge = F.lit(reference).cast("timestamp_ntz") - F.expr(f"interval {seconds_of(keep)} seconds")
    return df.where(F.col(column) >= edge)


def expired_versions(log: DataFrame, table: str, order: Sequence[str], *, keep: int, older_than: str, at: str, reference: str) -> DataFrame:
    """Versions to drop: not among the newest ``keep`` of their table, and older than the age.

    Only the newest ``keep`` of a table are ever ranked together; the rest are compared with the
    oldest of those.
    """
    edge = F.lit(reference).cast("timestamp_ntz") - F.expr(f"interval {seconds_of(older_than)} seconds")
    ranked = log.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(table).orderBy(*[F.desc(c) for c in order]))
    ).where(F.col("_rank") <= keep)
    oldest = ranked.groupBy(F.col(table).alias("_t")).agg(F.min(F.struct(*order)).alias("_oldest"))
    joined = log.join(oldest, F.col(table) == F.col("_t"))
    return joined.where((F.struct(*order) < F.col("_oldest")) & (F.col(at) < edge)).select(*log.columns)


def hook_chain(df: DataFrame, hooks: Sequence[Hook]) -> tuple[DataFrame, list[DataFrame]]:
    """Each hook takes what the one before passed on; rejects of all of them are kept."""
    rejected: list[DataFrame] = []

    def apply(rows: DataFrame, hook: Hook) -> DataFrame:
        passed, dropped = hook(rows)
        if dropped is not None:
            rejected.append(dropped)
        return passed

    return reduce(apply, hooks, df), rejected
