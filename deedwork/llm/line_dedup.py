"""Line deduplication across documents.

Lines are normalised and hashed in place (128 bits). The distinct hashes of each document are exploded once and counted with map-side
combine; the hashes over the threshold are joined back, a document gets the positions it loses, and its lines are put together in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedwork.llm.common import ascii_lower, fold

LEAST_CHARS = 40
LEAST_DOCS = 5
SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(lines: Column, least_chars: int) -> Column:
    """For each line that is long enough (position, two hash words of its key)."""
    keys = F.transform(lines, lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(SPACE)).alias("k")))
    long = F.filter(keys, lambda x: F.length(x["k"]) >= least_chars)
    low = F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), ascii_lower(x["k"]).alias("k")))
    return F.transform(
        low,
        lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["k"]).alias("a"), F.xxhash64(F.lit(7), x["k"]).alias("b")),
    )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_lines``, ``n_dropped`` and ``kept``, the text that is left.

    A null or empty text is one empty line. Each row counts as one document; a line stays in the rows of the largest id that holds it,
    repeated rows and lines included, and a null id is smaller than any other. An empty table gives an empty result.
    """
    read = fold(docs, {"id": id_col, "text": text_col}).withColumn("key", F.xxhash64("text"))
    marked = read.select("id", "key", _keys(_lines(F.col("text")), least_chars).alias("k"))
    # Distinct by sorting: a set of pairs would be searched in turn, which a text of many lines cannot afford.
    hashes = F.array_sort(F.transform("k", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    ordered = marked.select("id", hashes.alias("s"))
    apart = F.filter("s", lambda x, i: (i == 0) | (x != F.get("s", i - 1)))
    counted = (
        ordered.select("id", F.explode(apart).alias("x"))
        .groupBy(F.col("x.a").alias("a"), F.col("x.b").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
    )
    often = counted.where(F.col("n") >= least_docs).select("a", "b", "keeper")
    lines = marked.select("id", "key", F.explode("k").alias("x")).select("id", "key", "x.pos", "x.a", "x.b")
    lost = lines.join(often, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy(F.col("id").alias("lost_id"), F.col("key").alias("lost_key")).agg(F.collect_set("pos").alias("lost"))
    both = read.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("key") == F.col("lost_key")), "left")
    both = both.select("id", _lines(F.col("text")).alias("lines"), F.coalesce("lost", F.array()).alias("lost"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    both = both.select("id", "lines", F.size("lost").cast("bigint").alias("n_dropped"), left.alias("left"))
    return both.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("bigint").alias("n_lines"),
        "n_dropped",
        F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n").alias("kept"),
    )
