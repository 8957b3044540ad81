"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text without white space is cut into blocks of a fixed size. The distinct blocks are sorted and numbered; then
adjacent numbers are paired, the distinct pairs sorted and numbered again, until each document is down to one number.
Two documents end with the same (level, number) exactly when their blocks are the same: the number of a block stands for its
content and not for a digest. A digest only sorts the blocks and brings small rows together; contents that share a digest are told apart.

Each level halves the rows. Names are written before they are used, so a lost executor cannot renumber them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedwork.llm.common import fold, materialized, whole_row

BLOCK_CHARS = 2048
SPACE_RUN = r"[\x20\x09-\x0D]+"


def block_digest(block: Column) -> Column:
    return F.xxhash64(block)


def squeezed(text: Column) -> Column:
    """``text`` without any ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, "")


def _blocks(text: Column, block_chars: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


def _numbered(distinct: DataFrame, keys: list[str], keep: list[str], name: str) -> DataFrame:
    """Sorted distinct rows with an integer name each, written once."""
    ordered = distinct.sortWithinPartitions(*keys).select(*keys, F.monotonically_increasing_id().alias("name"))
    return materialized(ordered.select(*keep, "name"), name)


def _named_blocks(texts: DataFrame, base: DataFrame, block_chars: int, digest: Callable[[Column], Column]) -> DataFrame:
    """(row, n, pos, name) of every block."""
    blocks = texts.select(F.explode(_blocks(F.col("norm"), block_chars)).alias("block"))
    contents = blocks.select(digest(F.col("block")).alias("digest"), "block").distinct()
    names = _numbered(contents, ["digest", "block"], ["digest"], "block-names")
    shared = materialized(names.groupBy("digest").count().where("count > 1").select("digest"), "shared-digests")
    places = base.select("row", F.size("digests").alias("n"), F.posexplode("digests").alias("pos", "digest"))
    if shared.isEmpty():
        return places.join(names, "digest").select("row", "n", "pos", "name")
    # Different contents under one digest: these, and only these, are named by content again, below zero.
    again = contents.join(shared, "digest", "left_semi")
    by_content = _numbered(again, ["digest", "block"], ["digest", "block"], "shared-names").withColumn("name", -1 - F.col("name"))
    unshared = names.join(shared, "digest", "left_anti")
    cut = texts.select("key", F.posexplode(_blocks(F.col("norm"), block_chars)).alias("pos", "block"))
    cut = cut.withColumn("digest", digest(F.col("block"))).join(shared, "digest", "left_semi")
    told = cut.join(by_content, ["digest", "block"]).select("key", "pos", "name").distinct()
    return (
        places.join(unshared, "digest")
        .select("row", "n", "pos", "name")
        .unionByName(
            base.select("key", "row", F.size("digests").alias("n")).join(told, "key").select("row", "n", "pos", "name")
        )
    )


def name_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    digest: Callable[[Column], Column] = block_digest,
) -> DataFrame:
    """One row per input row: ``id``, ``row``, ``n_chars``, ``text_sha256`` and its identity (``level``, ``name``).

    A null text counts as empty, an empty one is one empty block. Repeated rows get the same identity. Other columns of ``docs`` are not read.
    """
    texts = fold(docs, {"id": id_col, "text": text_col}).withColumn("norm", squeezed(F.col("text")))
    texts = texts.select("id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), "norm")
    texts = texts.withColumn("key", F.sha2("norm", 256))
    base = texts.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "n_chars",
        "key",
        F.transform(_blocks(F.col("norm"), block_chars), digest).alias("digests"),
    )
    base = materialized(base, "block-digests")
    longest = base.agg(F.max(F.size("digests"))).first()[0] or 0

    current = _named_blocks(texts, base, block_chars, digest)
    finished = []
    for level in range(max(1, longest - 1).bit_length() + 1):
        done = current.where("n = 1").select("row", F.lit(level).alias("level"), "name")
        if longest <= 1 << level:
            finished.append(done)
            break
        pairs = (
            current.where("n > 1")
            .groupBy("row", "n", F.expr("pos div 2").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
            )
            .withColumn("odd", F.col("right").isNull())
            .withColumn("right", F.coalesce("right", F.lit(0)))
        )
        finished.append(done)
        pairs = materialized(pairs, f"pairs-{level}")
        key = ["left", "right", "odd"]
        names = _numbered(pairs.select(*key).distinct(), key, key, f"pair-names-{level}")
        current = pairs.join(names, key).select("row", F.expr("(n + 1) div 2").alias("n"), F.col("pos").cast("int").alias("pos"), "name")
    identity = finished[0]
    for part in finished[1:]:
        identity = identity.unionByName(part)
    return base.select("row", "id", "n_chars", F.col("key").alias("text_sha256")).join(identity, "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and ``n_chars``.

    Texts are equal when they are so without ASCII white space. Of equal texts the longest original stays, then the smallest id; a null id
    comes last; of rows that repeat both, exactly one stays. An empty table gives an empty result.
    """
    named = materialized(name_documents(docs, id_col, text_col, **how), "identities")
    best = F.max(F.struct("n_chars", (-F.col("id")).alias("low"), (-F.col("row")).alias("first")))
    groups = named.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    out = named.join(groups, ["level", "name"])
    return out.select(
        F.col("id").alias(id_col),
        (-F.col("best.low")).alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.first")).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col, **how).where("kept")
    kept = kept.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), F.col("n_chars").alias("n"))
    text = F.col(f"`{text_col}`")
    keyed = docs.select(
        whole_row(docs),
        F.col(f"`{id_col}`").alias("row_id"),
        F.sha2(squeezed(text), 256).alias("row_sha"),
        F.length(F.coalesce(text, F.lit(""))).alias("row_n"),
    )
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_sha") == F.col("sha")) & (F.col("row_n") == F.col("n"))
    # Rows that repeat id and text match the same decision; one of them stays.
    return keyed.join(kept, same).dropDuplicates(["row_id", "row_sha", "row_n"]).select("row.*")
