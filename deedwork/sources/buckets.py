"""A stored table in buckets of its key, whose loads rewrite only the buckets that their changes touch.

``data/load=<id>/bucket=<b>`` holds what load <id> wrote of bucket b, and ``versions/<id>.json`` says for each bucket which load holds it, so untouched buckets are
referred to and keep their files. A version appears by one rename, after its data; a load that is run again starts from the version before it and writes the same.
One load runs at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedwork.sources.sinks import newest_per_key

BUCKETS = 64


class BucketedTable:
    """The table at ``path`` with a ``key``; ``buckets`` counts when it is made, and should leave each bucket some hundred MB."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        found = self._fs.globStatus(self._jpath(f"{self.path}/versions/*.json")) or []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)

    def manifest(self, before: int | None = None) -> dict | None:
        """The newest version (older than ``before``): ``buckets``, ``schema`` and ``loads``, the load of each bucket that has rows."""
        kept = [v for v in self.versions() if before is None or v < before]
        if not kept:
            return None
        stream = self._fs.open(self._jpath(f"{self.path}/versions/{kept[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, load_id: int, manifest: dict) -> None:
        hidden, final = (self._jpath(f"{self.path}/versions/{name}") for name in (f"_{load_id}.json", f"{load_id}.json"))
        stream = self._fs.create(hidden, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        self._fs.delete(final, False)
        if not self._fs.rename(hidden, final):
            raise OSError(f"version {load_id} of {self.path} was not written")

    def _read(self, manifest: dict, buckets: Sequence[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        loads = manifest["loads"]
        folders = [f"{self.path}/data/load={loads[b]}/bucket={b}" for b in (loads if buckets is None else buckets) if b in loads]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version (older than ``before``), or ``None``."""
        manifest = self.manifest(before)
        return None if manifest is None else self._read(manifest)

    def bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def load(self, load_id: int, changes: DataFrame, change: Callable[[DataFrame | None, DataFrame], DataFrame]) -> list[int]:
        """Write version ``load_id``: ``change(rows before, changes)`` for the buckets of ``changes``; returns these.

        ``change`` gets the stored rows of the touched buckets (``None`` before the first load), and its rows must have their keys there.
        """
        before = self.manifest(load_id)
        buckets = before["buckets"] if before else self.buckets
        touched = sorted(r[0] for r in changes.select(self.bucket_of(buckets).alias("b")).distinct().collect())
        old = self._read(before, [str(b) for b in touched]) if before else None
        rows = change(old, changes)
        place = f"{self.path}/data/load={load_id}"
        placed = rows.withColumn("bucket", self.bucket_of(buckets))
        # As many tasks as buckets that are written, each its own.
        placed.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(place)
        written = {f.getPath().getName().partition("=")[2] for f in self._fs.globStatus(self._jpath(f"{place}/bucket=*")) or []}
        stray = written - {str(b) for b in touched}
        if stray:
            raise ValueError(f"rows in buckets that no change touches: {sorted(stray)}")
        loads = {b: n for b, n in (before["loads"] if before else {}).items() if int(b) not in touched}
        schema = before["schema"] if before else rows.schema.jsonValue()
        self._publish(load_id, {"buckets": buckets, "schema": schema, "loads": loads | dict.fromkeys(sorted(written), load_id)})
        return touched

    def feed(self, load_id: int, changes: DataFrame, sequence: str) -> list[int]:
        """The last change of each key so far. Deletes stay as rows, so changes may come late, twice or out of order."""
        return self.load(load_id, changes, lambda old, new: newest_per_key(new if old is None else old.unionByName(new), self.key, [sequence]))

    def settle(self, load_id: int, upto, sequence: str, operation: str, deleted: str = "delete") -> list[int]:
        """Forget deletes up to a sequence that the feed has passed for good; only buckets that hold such are rewritten."""
        held = self.read(before=load_id)
        if held is None:
            return []
        passed = (F.col(operation) == deleted) & (F.col(sequence) <= F.lit(upto))
        return self.load(load_id, held.where(passed).select(*self.key), lambda old, _: old.where(~F.coalesce(passed, F.lit(False))))
