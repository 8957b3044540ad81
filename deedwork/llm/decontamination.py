"""Benchmark decontamination, in DataFrame operations only.

Every test item is a set of word windows. Their hashes are broadcast, if there are no more than ``BROADCAST_WINDOWS`` of them, and joined
by a shuffle otherwise. Each document is split once, its words are hashed once, and the windows of all lengths are hashes of these; what hits is verified
word for word, and only documents with a hit are split again for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedwork.llm.common import ascii_lower, fold, materialized, whole_row

WINDOW_WORDS = 10
BROADCAST_WINDOWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


#: The same words in a text that still has its capitals.
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _hashes(words: Column, length: Column) -> Column:
    """A hash of every window of ``length`` consecutive words, of the hashes of its words."""
    starts = F.sequence(F.lit(1), F.size(words) - length + 1)
    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, length)))
    return F.when(F.size(words) >= length, hashed).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """The distinct windows: ``length``, ``hash``, ``words`` (joined by one space) and ``items``, the ids as strings."""
    items = fold(benchmark, {"item": id_col, "text": text_col}).select(F.col("item").cast("string"), words_of(F.col("text")).alias("w"))
    items = items.where("size(w) > 0").withColumn("length", F.least(F.size("w"), F.lit(window)))
    spans = items.select("item", "length", "w", F.explode(F.expr("sequence(1, size(w) - length + 1)")).alias("i"))
    spans = spans.select("item", "length", F.expr("slice(w, i, length)").alias("s"))
    spans = spans.select("item", "length", F.xxhash64(_word_hashes(F.col("s"))).alias("hash"), F.array_join("s", " ").alias("words"))
    return spans.groupBy("length", "hash", "words").agg(F.collect_set("item").alias("items"))


_HITS = "array<struct<pos:int,length:int,words:string,items:array<string>>>"


def _hits(read: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``hit_id``, ``hit_key`` and the windows whose hashes hit, for each document (``id``, ``key``, ``text``) with any."""
    grams = materialized(item_windows(benchmark, window=window), "benchmark-windows")
    sizes = {r["length"]: r["n"] for r in grams.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(sizes.values()) <= BROADCAST_WINDOWS:
        grams = F.broadcast(grams)
    lengths = F.array(*map(F.lit, sorted(sizes))).cast("array<int>")
    split = read.select("id", "key", _word_hashes(words_of(F.col("text"))).alias("w"))
    each = split.select("id", "key", "w", F.explode(lengths).alias("length"))
    each = each.select("id", "key", "length", F.posexplode(_hashes(F.col("w"), F.col("length"))).alias("pos", "hash"))
    found = each.join(grams, ["hash", "length"]).select("id", "key", F.struct("pos", "length", "words", "items").alias("hit"))
    hits = found.groupBy("id", "key").agg(F.collect_set("hit").alias("hits"))
    return hits.withColumnsRenamed({"id": "hit_id", "key": "hit_key"})


def _verified(words: Column, hits: Column) -> Column:
    """The hits whose words stand in the document."""
    every = F.coalesce(hits, F.array().cast(_HITS))

    def standing(w: Column) -> Column:
        return F.filter(every, lambda h: F.array_join(F.slice(w, h["pos"] + 1, h["length"]), " ") == h["words"])

    return F.get(F.transform(F.array(words), standing), F.lit(0))  # the text is split once, not for each hit


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and ``clean_words``.

    ``clean_words`` are the words outside every hit span, joined by one space. A null or empty text has no words and no hits; an item without
    words is in no document; a null item id has no name in the list, but its windows hit. Repeated rows give the same result. With no
    documents the result is empty, with no items nothing is contaminated.
    """
    read = fold(docs, {"id": id_col, "text": text_col}).withColumn("key", F.xxhash64("text"))
    hits = _hits(read, benchmark, window)
    text = read.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    # Only a document with a hit is split into words again.
    every = text.select("id", "text", F.when(F.col("hits").isNotNull(), words_of(F.col("text"))).alias("w"), "hits")
    counted = F.coalesce(F.regexp_count("text", F.lit(_ANY_CASE)), F.lit(0)).cast("bigint")
    real = F.when(F.col("hits").isNotNull(), _verified(F.col("w"), F.col("hits"))).otherwise(F.array().cast(_HITS))
    checked = every.select("id", "text", "w", counted.alias("n_words"), real.alias("real"))
    spans = F.array_sort(F.transform("real", lambda h: F.struct(h["pos"].alias("a"), (h["pos"] + h["length"]).alias("b"))))
    merged = F.aggregate(
        spans,
        F.expr("named_struct('reach', 0, 'words', 0L, 'free', cast(array() as array<struct<a:int,b:int>>))"),
        lambda m, s: F.struct(
            F.greatest(m["reach"], s["b"]).alias("reach"),
            (m["words"] + F.greatest(s["b"] - F.greatest(m["reach"], s["a"]), F.lit(0))).alias("words"),
            F.when(s["a"] > m["reach"], F.concat(m["free"], F.array(F.struct(m["reach"].alias("a"), s["a"].alias("b")))))
            .otherwise(m["free"])
            .alias("free"),
        ),
    )
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("real", lambda h: h["items"]))))
    out = checked.select("id", "text", "w", "n_words", merged.alias("m"), items.alias("items"))
    last = F.struct(F.col("m.reach").alias("a"), F.col("n_words").cast("int").alias("b"))
    kept = F.flatten(F.transform(F.concat(F.col("m.free"), F.array(last)), lambda s: F.slice(F.col("w"), s["a"] + 1, s["b"] - s["a"])))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.col("m.words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("m.words") > 0).alias("contaminated"),
        F.array_join(F.when(F.col("w").isNotNull(), kept).otherwise(words_of(F.col("text"))), " ").alias("clean_words"),
    )


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """The rows of ``docs`` in which no window of ``benchmark`` occurs, with all their columns."""
    read = fold(docs, {"id": id_col, "text": text_col}).withColumn("key", F.xxhash64("text"))
    hits = _hits(read, benchmark, window)
    keyed = docs.select(
        whole_row(docs), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").alias("text")
    )
    both = keyed.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    # Only a document with a hit is split into words again.
    words = F.when(F.col("hits").isNotNull(), words_of(F.col("text")))
    return both.where(~F.coalesce(F.size(_verified(words, F.col("hits"))) > 0, F.lit(False))).select("row.*")
