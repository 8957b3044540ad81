"""Substring deduplication by relative Lempel-Ziv parsing.

The reference of a document is all documents with smaller ids. It is indexed by blocks that the text itself cuts: the windows of ``window``
words are grouped by the least hash among the ``GRAM_WORDS``-word sequences in them, and the consecutive windows with one least hash are a block. The
same passage is cut alike wherever it stands, but for its two ends.

A document is parsed block by block, the longest phrase first: a block that a smaller document holds whole is taken whole, and such blocks
in a row make one long factor. Where that ends, at the factor's boundaries, the block is checked window by window against the windows of all
blocks with the same least hash. What both find, at least one window long, are the duplicate spans.

Blocks meet by hash, never in pairs of documents. A least hash that only one document has is dropped before anything else is shuffled, and of
equal blocks only the smallest document's windows are looked at: a copy of it is covered by the whole-block rule.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedwork.llm.common import fold, materialized, python_ready, split_words, text_key

WINDOW_WORDS = 50
GRAM_WORDS = 10
BATCH_BYTES = 8 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LAST_ID = (1 << 63) - 1


def _hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in a row, and how many each text has."""
    words, sizes = split_words(text)
    coded = words.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, count=len(coded.dictionary))
    return known[coded.indices.to_numpy()], sizes


@functools.lru_cache(maxsize=2)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, dtype=np.uint64)])) for b in (base, inverse))


class _Rolling:
    """Hashes of any run of words, from sums of word hashes times powers."""

    def __init__(self, hashes: np.ndarray, base: int = _BASES[0]):
        up, self.down = _powers(base, 1 << max(18, len(hashes).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    width, low = 1, x
    while width * 2 <= size:
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    rest = size - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def blocks_of(hashes: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, least hash, content hash, number of windows, first word) of each block of texts of so many words each."""
    ends = np.cumsum(sizes)
    if len(hashes) < window:
        return (np.zeros(0, np.int64),) * 5
    rolling = _Rolling(hashes)
    least = _least(_mixed(rolling.every(gram)), window - gram + 1)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    inside = np.flatnonzero(np.arange(len(least)) + window <= ends[text])  # windows within one text
    if not len(inside):
        return (np.zeros(0, np.int64),) * 5
    new = np.ones(len(inside), bool)
    new[1:] = (np.diff(inside) > 1) | (least[inside[1:]] != least[inside[:-1]])
    first = np.flatnonzero(new)
    starts, count = inside[first], np.diff(np.append(first, len(inside)))
    content = rolling.runs(starts, starts + count + window - 1)
    return text[starts], least[starts].view(np.int64), content.view(np.int64), count, starts - (ends - sizes)[text[starts]]


def _first_of(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows whose document and text this task has not seen yet."""
    keys = list(zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(), strict=True))
    new = []
    for key in keys:
        new.append(key not in seen)
        seen.add(key)
    return batch if all(new) else batch.filter(pa.array(new, pa.bool_()))


def _cut(window: int, gram: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            batch = _first_of(batch, seen)
            text, least, content, count, at = blocks_of(*_hashes(batch.column("text")), window, gram)
            out = {"least": pa.array(least), "doc": batch.column("doc").take(pa.array(text))}
            if whole:
                out |= {"key": batch.column("key").take(pa.array(text)), "content": pa.array(content)}
                out |= {"size": pa.array(count.astype(np.int32)), "at": pa.array(at.astype(np.int32))}
            out = pa.RecordBatch.from_arrays(list(out.values()), list(out))
            del text, least, content, count, at
            pa.default_memory_pool().release_unused()
            yield out

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            batch = _first_of(batch, seen)
            if not batch.num_rows:
                continue
            hashes, sizes = _hashes(batch.column("text"))
            begins = np.cumsum(sizes) - sizes
            blocks = np.diff(batch.column("blocks_at").offsets.to_numpy())
            text = np.repeat(np.arange(len(sizes)), blocks)
            at, count = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("blocks_at", "blocks_size"))
            first = np.cumsum(count) - count
            at = np.repeat(at - first, count) + np.arange(count.sum())
            text = np.repeat(text, count)
            place = begins[text] + at
            a, b = (_Rolling(hashes, base).runs(place, place + window).view(np.int64) for base in _BASES)
            row = pa.array(text)
            columns = [batch.column("doc").take(row), batch.column("key").take(row), pa.array(at.astype(np.int32)), pa.array(a), pa.array(b)]
            del hashes, text, at, count, first, place, a, b, row
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays(columns, ["doc", "key", "at", "a", "b"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that meet or overlap as one."""
    for batch in batches:
        firsts, lasts = [], []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            order = np.argsort(a, kind="stable")
            a, reach = a[order], np.maximum.accumulate(b[order])
            new = np.append(True, a[1:] > reach[:-1])
            firsts.append(a[new])
            lasts.append(reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)])
        columns = [batch.column("doc"), batch.column("key"), *(pa.array(x, pa.list_(pa.int32())) for x in (firsts, lasts))]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "key", "a", "b"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, sizes = split_words(batch.column("text"))
        ends = np.cumsum(sizes)
        steps = np.zeros(len(words) + 1, np.int64)
        for name, step in (("a", 1), ("b", -1)):
            counts = pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
            place = np.repeat(ends - sizes, counts) + batch.column(name).flatten().to_numpy()
            np.add.at(steps, place, step)
        kept = np.cumsum(steps[:-1]) == 0
        before = np.concatenate([[0], np.cumsum(kept)])
        offsets = before[np.concatenate([[0], ends])]
        left = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(kept))), " ")
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(sizes - np.diff(offsets)), left], ["id", "n_words", "n_removed", "kept"])


def duplicate_spans(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """Spans of words of ``docs`` (``doc``, ``key``, ``text``) whose windows also start in a smaller ``doc``.

    One row for each ``doc`` and ``key`` with any: ``a`` and ``b``, where its spans begin and end, in order and apart. Rows that repeat both are looked at once in a task.
    """
    python_ready(docs.sparkSession, BATCH_BYTES)
    least = docs.mapInArrow(_cut(window, gram, False), "least long, doc long")
    shared = least.groupBy("least").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("least")
    cut = "least long, doc long, key binary, content long, size int, at int"
    blocks = docs.mapInArrow(_cut(window, gram, True), cut).join(shared, "least", "left_semi")
    blocks = materialized(blocks, "shared-blocks")

    same = ["least", "content", "size"]
    first = blocks.groupBy(*same).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    first = materialized(first, "distinct-blocks")
    copied = first.where("first < last").select(*same, "first")
    whole = blocks.join(copied, same).where("doc > first")
    whole = whole.select("doc", "key", F.col("at").alias("a"), F.expr(f"at + size + {window - 1}").alias("b"))

    several = first.groupBy("least").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("low"), F.max("first").alias("high"))
    several = several.where("n > 1 and low < high").select("least")
    ends = blocks.join(first.join(several, "least", "left_semi").select(*same, F.col("first").alias("doc")), [*same, "doc"])
    ends = ends.groupBy(F.col("doc").alias("d"), F.col("key").alias("k")).agg(F.collect_set(F.struct("at", "size")).alias("blocks"))
    ends = ends.select("d", "k", F.col("blocks.at").alias("blocks_at"), F.col("blocks.size").alias("blocks_size"))
    texts = docs.join(ends, (F.col("doc") == F.col("d")) & (F.col("key") == F.col("k"))).select("doc", "key", "text", "blocks_at", "blocks_size")
    windows = materialized(texts.mapInArrow(_windows(window), "doc long, key binary, at int, a long, b long"), "boundary-windows")
    lowest = windows.groupBy("a", "b").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("a", "b", "low")
    checked = windows.join(lowest, ["a", "b"]).where("low < doc")
    checked = checked.select("doc", "key", F.col("at").alias("a"), F.expr(f"at + {window}").alias("b"))
    spans = whole.unionByName(checked).groupBy("doc", "key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = spans.select("doc", "key", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))
    return materialized(spans.mapInArrow(_merged, "doc long, key binary, a array<int>, b array<int>"), "duplicate-spans")


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_removed`` and ``kept``, the words left joined by one space.

    Words are separated by ASCII white space and otherwise unchanged. A text of fewer than ``window`` words, null and empty ones included,
    loses nothing. A row without an id comes after all others; rows that repeat an id are one document to each other, so neither loses what they share.
    """
    read = fold(docs, {"id": id_col, "text": text_col})
    doc, key = F.coalesce(F.col("id").cast("bigint"), F.lit(_LAST_ID)), text_key(F.col("text"))
    keyed = read.select("id", doc.alias("doc"), key.alias("key"), "text")
    spans = duplicate_spans(keyed.select("doc", "key", "text"), window, gram).withColumnsRenamed({"doc": "d", "key": "k"})
    both = keyed.join(spans, (F.col("doc") == F.col("d")) & (F.col("key") == F.col("k")), "left").select("id", "text", "a", "b")
    id_type = read.schema["id"].dataType.simpleString()
    out = both.mapInArrow(_remove, f"id {id_type}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
