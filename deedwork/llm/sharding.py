"""Sharding by extendible hashing, in DataFrame operations only.

A row's hash is read from its first bit on. The directory is indexed by a prefix of these bits; a bucket over the byte limit is split on
one more bit, all others keep their shorter prefix. The shard of a row is therefore its shortest prefix whose rows fit.

The directory is built in rounds of ``STEP`` bits from byte sums per prefix, which combine before they are shuffled; only the rows of
oversized buckets go into the next round. Rows of one key share all bits of the key's hash, so a key over the limit goes on with bits
drawn from the row number. A single row over the limit is a shard of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedwork.llm.common import fold, materialized

STEP = 12
BITS = 60
SHARD_BYTES = 1 << 20


def _bits(value: Column) -> Column:
    """The first 60 bits of an MD5 sum."""
    return F.conv(F.substring(F.md5(value), 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(hashed: Column, length: Column) -> Column:
    return F.call_function("shiftright", hashed, (F.lit(BITS) - length).cast("int"))


def _entries(rows: DataFrame, within: list[str], hashed: str, start: int, limit: int) -> DataFrame:
    """One round of the directory: for each prefix of start+STEP bits its local depth, null where it is still too large."""
    width = start + STEP
    cell = _prefix(F.col(hashed), F.lit(width)).alias("cell")
    cells = rows.groupBy(*within, cell).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("r"))
    cells = materialized(cells, "directory-cells")
    depths = F.sequence(F.lit(start + (start > 0)), F.lit(width))
    shorter = F.call_function("shiftright", F.col("cell"), F.lit(width) - F.col("depth")).alias("prefix")
    spread = cells.select("*", F.explode(depths).alias("depth")).select("*", shorter)
    sums = spread.groupBy(*within, "depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    chosen = spread.join(fits, [*within, "depth", "prefix"]).groupBy(*within, "cell").agg(F.min("depth").alias("depth"))
    chosen = chosen.select("*", shorter).join(fits, [*within, "depth", "prefix"])
    return materialized(cells.select(*within, "cell").join(chosen, [*within, "cell"], "left"), "directory")


def shard_rows(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``shard`` (its prefix as 0s and 1s), ``depth``, ``n_bytes``, ``shard_bytes``, ``shard_rows``.

    A row counts the UTF-8 bytes of its text, none for a null text. A null id hashes as an empty one. Repeated rows share the bits of
    their key and are told apart only if they do not fit into one shard. An empty table has no shards.
    """
    rows = fold(docs, {"id": id_col, "text": text_col})
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    number = F.monotonically_increasing_id()
    rows = rows.select(
        "id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
        _bits(key).alias("h0"),
        _bits(F.concat_ws("/", key, number.cast("string"))).alias("h1"),
    )
    left = materialized(rows, "row-hashes")
    closed = []
    for word, within in enumerate(([], ["h0"])):
        hashed = f"h{word}"
        for start in range(0, BITS, STEP):
            entries = _entries(left, within, hashed, start, limit)
            placed = left.withColumn("cell", _prefix(F.col(hashed), F.lit(start + STEP))).join(entries, [*within, "cell"])
            own = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
            closed.append(
                placed.where("depth is not null").select(
                    F.col("id").alias(id_col),
                    (F.concat(F.lpad(F.bin("h0"), BITS, "0"), own) if word else own).alias("shard"),
                    (F.col("depth") + word * BITS).cast("bigint").alias("depth"),
                    "n_bytes",
                    "shard_bytes",
                    "shard_rows",
                )
            )
            if entries.where("depth is null").isEmpty():
                return reduce(DataFrame.unionByName, closed)
            left = materialized(placed.where("depth is null").select("id", "n_bytes", "h0", "h1"), "oversized-rows")
    raise ValueError("rows that cannot be told apart exceed the limit")
