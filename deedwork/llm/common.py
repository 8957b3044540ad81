"""Small helpers the corpus operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deedwork.session import materialized, ship_package

__all__ = ["ascii_lower", "fold", "join_groups", "materialized", "place", "python_ready", "split_words", "text_key", "whole_row"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH_BYTES = 16 << 20
FREQUENT = 2000


def python_ready(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Before work that runs in Python on the executors: they get this package, and a batch of rows is bounded by bytes too, not by its rows alone."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path)


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between ASCII white space of all texts in a row, and how many each text has; none for null."""
    trimmed = pc.ascii_trim_whitespace(text)
    listed = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), None, trimmed))
    return listed.flatten(), pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it was."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def fold(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the asked columns, under internal names that cannot clash with those of the caller."""
    return df.select(*(df[f"`{theirs}`"].alias(ours) for ours, theirs in columns.items()))


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """Stored ``rows`` left joined with ``groups`` (one row for each ``on``, stored) that holds ``size``, the number of rows of the group.

    Groups of more than one ``FREQUENT``-th of all ``total`` rows, fewer than ``FREQUENT`` of them by that, are broadcast, so that no task gets all rows
    of one; the others meet their rows by a shuffle.
    """
    known = [c for c in groups.columns if c != on]
    groups = groups.select(F.col(on).alias("__on"), *(F.col(c).alias(f"__{c}") for c in known))
    often = F.col(f"__{size}") * FREQUENT > total
    few, rest = F.broadcast(groups.where(often)), groups.where(~often)
    named = [*(F.col(c) for c in rows.columns), *(F.col(f"__{c}").alias(c) for c in known)]
    met = rows.join(few, F.col(on) == F.col("__on")).select(*named)
    left = rows.join(few.select("__on"), F.col(on) == F.col("__on"), "left_anti")
    return met.unionByName(left.join(rest, F.col(on) == F.col("__on"), "left").select(*named))


def text_key(text: Column) -> Column:
    """128 bits that tell texts under one id apart; empty for null."""
    return F.coalesce(F.unhex(F.md5(text)), F.unhex(F.lit("")))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one, ``row``, to carry them through a join under names that cannot clash."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
