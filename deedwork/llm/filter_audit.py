"""Filter interaction audit on a sparse document-term matrix.

Texts are read once, as blocks: the words of a block are numbered within it, and each document is a run of (word, count) pairs. The words of all blocks
meet in one shuffle, where equal words get one number, without a gap over all partitions: the dictionary. The numbers go back to the blocks, and each block
becomes a shard of the matrix in compressed sparse rows. The sum of a row is the number of words of a document, its stored entries are the distinct ones; both decide the
filters on words. The flags of the other filters lie beside the rows.

A document is then no more than the set of filters that it fails. Documents are counted by part and set, at most 2^filters numbers a part, and every
order of the filters is read off these.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedwork.llm.common import fold, join_groups, materialized, python_ready, split_words

LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
MARKS = b"#$%&*|"
BLOCK_BYTES = 16 << 20
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_META = "ids array<{id}>, parts array<string>, points array<long>, capitals array<long>, marked array<boolean>, digests array<binary>"


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4")


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    """One row; an Arrow array is the list of a list column."""
    arrays = []
    for field in schema:
        value = values[field.name]
        if isinstance(value, pa.Array):
            offsets = pa.array([0, len(value)], pa.int32())
            arrays.append(pa.ListArray.from_arrays(offsets, value.cast(field.type.value_type)))
        else:
            arrays.append(pa.array([value], field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _block_schema(id_type: pa.DataType, *more: tuple[str, pa.DataType]) -> pa.Schema:
    kinds = {"ids": id_type, "parts": pa.string(), "points": pa.int64(), "capitals": pa.int64(), "marked": pa.bool_(), "digests": pa.binary()}
    return pa.schema([*((name, pa.list_(kind)) for name, kind in kinds.items()), *more])


def _block(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of rows as one block; ``terms`` are steps between the numbers of a document's words."""
    text = batch.column("text")
    words, sizes = split_words(text)
    coded = words.dictionary_encode()
    keys = np.repeat(np.arange(len(sizes)) << 32, sizes)
    keys |= coded.indices.to_numpy()
    del words
    keys.sort()
    first = np.flatnonzero(np.append(np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])).astype(np.int32)
    times = _packed(np.diff(np.append(first, len(keys))))
    keys = keys[first]
    doc, at = (keys >> 32).astype(np.int32), keys.astype(np.uint32)
    stored = np.bincount(doc, minlength=len(sizes))
    steps = np.diff(at, prepend=at[:1])
    begins = np.flatnonzero(np.diff(doc, prepend=-1))
    steps[begins] = at[begins]
    del keys, doc, at, first
    capitals, marked, digests = [], [], []
    for raw in text.cast(pa.binary()):
        raw = raw.as_py() or b""
        capitals.append(len(raw) - len(raw.translate(None, _CAPITALS)))
        marked.append(len(raw) != len(raw.translate(None, MARKS)))
        digests.append(hashlib.sha256(raw).digest())
    more = [("sizes", pa.list_(pa.int32())), ("terms", pa.binary()), ("times", pa.binary()), ("words", pa.list_(pa.binary()))]
    return _row(
        _block_schema(batch.column("id").type, *more),
        ids=batch.column("id"),
        parts=batch.column("part"),
        points=pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64()),
        capitals=pa.array(capitals, pa.int64()),
        marked=pa.array(marked),
        digests=pa.array(digests, pa.binary()),
        sizes=pa.array(stored, pa.int32()),
        terms=_packed(steps),
        times=times,
        words=coded.dictionary,
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            block = _block(batch)
            pa.default_memory_pool().release_unused()
            yield block


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each block: their numbers in it and how often they occur."""
    for batch in batches:
        for k in range(batch.num_rows):
            block, sizes, terms, times = (batch.column(c)[k].as_py() for c in ("block", "sizes", "terms", "times"))
            words = batch.column("words")[k].values
            if not len(words):
                continue
            at = _cumulated(_unpacked(terms), np.array(sizes, np.int64))
            docs = np.bincount(at, minlength=len(words))
            total = np.bincount(at, weights=_unpacked(times), minlength=len(words)).astype(np.int64)
            columns = [np.full(len(words), block), np.arange(len(words), dtype=np.int32), docs.astype(np.int32), total]
            yield pa.RecordBatch.from_arrays([words, *map(pa.array, columns)], ["word", "block", "local", "n_docs", "n_words"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by word, with ``at``: how many other words come before theirs."""
    last, done = None, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column("word")
        new = np.ones(batch.num_rows, np.int64)
        new[1:] = pc.not_equal(words.slice(1), words.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[0] = words[0].as_py() != last
        at = done + np.cumsum(new)
        last, done = words[-1].as_py(), int(at[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "at"])


def _cumulated(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums that start anew in each run; sums over all runs may wrap around, those within one do not."""
    if not len(steps):
        return steps
    sums = np.cumsum(steps, dtype=np.uint32)
    ends = np.cumsum(sizes)
    before = np.where(ends - sizes > 0, sums[np.maximum(ends - sizes - 1, 0)], np.uint32(0))
    sums -= np.repeat(before, sizes)
    return sums


def _shards(index_type: str):
    """The sparse rows of one block; ``indices`` rise within a row."""

    def run(block: pa.Table, numbers: pa.Table) -> pa.Table:
        rows = []
        own = {name: block.column(name).combine_chunks() for name in block.column_names}
        to = np.empty(numbers.num_rows, np.int64)
        to[numbers.column("local").to_numpy()] = numbers.column("term").to_numpy()
        for k in range(block.num_rows):
            sizes = own["sizes"][k].values.to_numpy().astype(np.int64)
            at, times = to[_cumulated(_unpacked(own["terms"][k].as_py()), sizes)], _unpacked(own["times"][k].as_py())
            keys = np.repeat(np.arange(len(sizes)) << 40, sizes)
            keys |= at
            order = np.argsort(keys)
            del keys
            meta = {c: own[c][k].values for c in ("ids", "parts", "points", "capitals", "marked", "digests")}
            parts = {"shard": own["block"][k].as_py(), "indptr": np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes()}
            parts |= {"indices": at[order].astype(index_type).tobytes(), "data": times[order].astype("<u4").tobytes()}
            more = [("shard", pa.int64()), *((c, pa.binary()) for c in ("indptr", "indices", "data"))]
            rows.append(_row(_block_schema(meta["ids"].type, *more), **meta, **parts))
            del at, times, order, parts
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(rows)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the rows of the matrix say of their documents, beside the other columns."""
    for batch in batches:
        for k in range(batch.num_rows):
            indptr, data = np.frombuffer(batch.column("indptr")[k].as_py(), "<i8"), np.frombuffer(batch.column("data")[k].as_py(), "<u4")
            sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
            meta = {c: batch.column(many)[k].values for many, c in (("ids", "id"), ("parts", "part"), ("points", "points"), ("capitals", "capitals"), ("marked", "marked"), ("digests", "digest"))}
            out = meta | {"n_words": pa.array(sums[indptr[1:]] - sums[indptr[:-1]]), "n_distinct": pa.array(np.diff(indptr))}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def term_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The dictionary (``word``, ``term``, ``n_docs``, ``n_words``), read off a stored table, and the stored shards of the document-term matrix.

    A shard holds ``indptr`` (64 bits, little-endian), ``indices`` (32 bits, or 64 if the dictionary needs them) and ``data`` (32 bits), and lists beside its rows: ``ids``, ``parts``, ``points`` (code
    points), ``capitals`` (A-Z), ``marked`` (holds one of ``MARKS``) and ``digests`` (SHA-256). Words are the runs without ASCII white space, as they
    are; a null or empty text is an empty row. Repeated rows are rows of their own; an empty table has no shards and no words.
    """
    python_ready(docs.sparkSession, BLOCK_BYTES)
    read = fold(docs, {"id": id_col, "part": part_col, "text": text_col}).withColumn("part", F.col("part").cast("string"))
    meta = _META.format(id=read.schema["id"].dataType.simpleString())
    blocks = read.mapInArrow(_blocks, f"{meta}, sizes array<int>, terms binary, times binary, words array<binary>")
    blocks = materialized(blocks.withColumn("block", F.monotonically_increasing_id()), "matrix-blocks")
    words = blocks.select("block", "sizes", "terms", "times", "words").mapInArrow(_words, "word binary, block long, local int, n_docs int, n_words long")
    words = words.repartition("word").sortWithinPartitions("word")
    words = words.mapInArrow(_numbered, "word binary, block long, local int, n_docs int, n_words long, at int")
    words = materialized(words.withColumn("slice", F.spark_partition_id()), "numbered-words")
    # One number for each slice of the dictionary is ordered, no more.
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = words.groupBy("slice").agg((F.max("at") + 1).cast("bigint").alias("n"))
    slices = materialized(slices.select("slice", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "dictionary-slices")
    terms = words.join(F.broadcast(slices), "slice").withColumn("term", F.col("base") + F.col("at"))
    dictionary = terms.groupBy("word", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words"))

    size = slices.agg(F.sum("n")).first()[0] or 0
    if size >> 40:
        raise ValueError("more words than 40 bits can number")
    numbers = terms.select("block", "local", "term")
    shards = blocks.drop("words").groupBy("block").cogroup(numbers.groupBy("block"))
    shards = shards.applyInArrow(_shards("<u8" if size >> 32 else "<u4"), f"{meta}, shard long, indptr binary, indices binary, data binary")
    return dictionary, materialized(shards, "term-matrix")


def document_flags(shards: DataFrame) -> DataFrame:
    """One row for each row of the matrix: ``id``, ``part``, and for the filters A to E whether it fails (``a`` to ``e``), stored.

    A: under ``LEAST_WORDS`` words. B: distinct words under ``LEAST_DISTINCT_PERCENT`` % of them. C: over ``MOST_CAPITALS_PERCENT`` % of the code points are
    A-Z. D: holds one of ``MARKS``. E: equal to the text of a smaller id; a null id has none smaller and is none, and of rows that repeat an id none is smaller.
    """
    id_type = shards.schema["ids"].dataType.elementType.simpleString()
    counts = "points long, capitals long, marked boolean, digest binary, n_words long, n_distinct long"
    columns = ["ids", "parts", "points", "capitals", "marked", "digests", "indptr", "data"]
    rows = materialized(shards.select(*columns).mapInArrow(_sums, f"id {id_type}, part string, {counts}"), "matrix-sums")
    copies = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = join_groups(rows, materialized(copies, "equal-texts"), "digest", "copies", rows.count())
    return rows.select(
        "id",
        F.coalesce("part", F.lit("")).alias("part"),
        (F.col("n_words") < LEAST_WORDS).alias("a"),
        (100 * F.col("n_distinct") < LEAST_DISTINCT_PERCENT * F.col("n_words")).alias("b"),
        (100 * F.col("capitals") > MOST_CAPITALS_PERCENT * F.col("points")).alias("c"),
        F.col("marked").alias("d"),
        F.coalesce(F.col("first") < F.col("id"), F.lit(False)).alias("e"),
    )


def interactions(rows: DataFrame, failing: dict[str, Column], part: Column, good: Column, bad: Column) -> DataFrame:
    """For every part, order of the filters and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``.

    ``failing`` gives the letter of a filter and whether a row fails it; ``good`` and ``bad`` mark rows; null is false in all of them. Every filter stands once in
    an order, so a handful of filters is meant; a letter is a letter or digit. A part has all orders and steps, zeros included; without rows there is none.
    """
    def known(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    bits = {name: 1 << k for k, name in enumerate(failing)}
    fails = sum((F.when(known(c), F.lit(bits[name])).otherwise(F.lit(0)) for name, c in failing.items()), F.lit(0))
    marked = rows.select(part.alias("part"), fails.alias("fails"), known(good).alias("good"), known(bad).alias("bad"))
    counted = marked.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("bad"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "bad")).alias("sets"))

    steps = []
    for order in permutations(failing):
        before = 0
        for k, name in enumerate(order, 1):
            steps.append(f"('{''.join(order)}', {k}, {before}, {bits[name]})")
            before |= bits[name]
    steps = F.expr(f"cast(array({', '.join(steps)}) as array<struct<filter_order:string,step:int,before:int,bit:int>>)")
    return _read_off(parts.select("part", "sets", F.explode(steps).alias("s")), factorial(len(failing)))


def _read_off(rows: DataFrame, orders: int) -> DataFrame:
    fails, before, bit = (lambda m: m["fails"]), F.col("s.before"), F.col("s.bit")

    def total(count: str, where) -> Column:
        return F.aggregate("sets", F.lit(0).cast("bigint"), lambda sum_, m: sum_ + F.when(where(m), m[count]).otherwise(F.lit(0)))

    def removed(m: Column) -> Column:
        return (fails(m).bitwiseAND(before) == 0) & (fails(m).bitwiseAND(bit) != 0)

    # Each of the filters that a document fails is the first of them in as many orders.
    share = F.aggregate(
        "sets",
        F.lit(0).cast("bigint"),
        lambda sum_, m: sum_ + F.when(fails(m).bitwiseAND(bit) != 0, F.expr(f"{orders}L") * m["n"] / F.bit_count(fails(m))).otherwise(F.lit(0)).cast("bigint"),
    )
    return rows.select(
        "part",
        F.col("s.filter_order"),
        F.col("s.step"),
        total("n", lambda m: fails(m).bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (fails(m).bitwiseAND(before) != 0) & (fails(m).bitwiseAND(bit) != 0)).alias("redundant"),
        total("n", lambda m: fails(m) == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("bad", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``interactions`` of the filters A to E over ``docs``; ``labels`` (``id_col``, ``quality``, ``toxic``) mark good and toxic documents.

    A document is good or toxic if any of its label rows says 1; one without a row is neither. A null part is the empty string.
    """
    _, shards = term_matrix(docs, id_col, text_col, part_col)
    known = fold(labels, {"label_id": id_col, "quality": "quality", "toxic": "toxic"}).where("label_id is not null")
    known = known.groupBy("label_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("bad"))
    rows = document_flags(shards).join(known, F.col("id") == F.col("label_id"), "left")
    return interactions(rows, {f: F.col(f.lower()) for f in "ABCDE"}, F.col("part"), F.col("good"), F.col("bad"))
