"""Token ids in files of 64-bit words, Simple-8b.

A word holds a selector in its upper four bits and below them as many ids as the selector says, all of one width; runs of id 0 take no bits, and the last
selector is the escape of an id too wide for the others, alone in its word. Ids are packed greedily, block by block: each block of ``BLOCK_IDS`` ids begins a
new word and the file ends with the offsets of its blocks, so any place is found without what lies before, and all words of one selector are unpacked at once.
Ids of 61 bits and more are refused.

A file: ``MAGIC``; the words; the block offsets; the documents (id and number of ids, in Arrow's stream format); the four numbers ``_END`` and ``MAGIC``.

Writing: texts are dealt out by ranges of their document ids, and each task encodes its range in order and writes files of its own. The index that comes of it names
the files of successful attempts only. Rows that share an id are told apart by their text and their place in the table, so the ranges cut them too. Reading: a task takes whole files and unpacks a few blocks at a time.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deedwork.llm.common import fold, materialized, place, python_ready, split_words
from deedwork.session import scratch_path

BLOCK_IDS = 8192
FILE_IDS = 1 << 25
END_ID = 1
READ_BLOCKS = 64
MAX_READ_TASKS = 20_000
MAGIC = b"S8BWORDS"
_END = struct.Struct("<QQQQ")
BATCH_BYTES = 6 << 20
_MEMO_WORDS = 1_000_000
_ENCODED_WORDS = 10_000

#: Fixed values of the code: (ids in a word, bits of each) by selector; the last is the escape.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNTS = np.array([n for n, _ in SELECTORS], np.int64)


def _fitting(low: np.ndarray, count: int) -> np.ndarray:
    """Where ``count`` true values in a row begin; the last ``count - 1`` places are left out."""
    width = 1
    while width * 2 <= count:
        low, width = low[:-width] & low[width:], width * 2
    rest = count - width
    return low[: len(low) - rest] & low[rest:] if rest else low


def encode(ids: np.ndarray) -> np.ndarray:
    """One block of ids as words; what the last word has room for beyond them is zero."""
    n = len(ids)
    if n and int(ids.max()) >> 60:
        raise ValueError("an id has more than 60 bits")
    padded = np.zeros(n + SELECTORS[0][0], np.uint64)
    padded[:n] = ids
    best = np.full(n, len(SELECTORS) - 1, np.int64)
    # What fits a narrower selector fits all wider ones: the first that fits nowhere ends the search.
    for selector in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[selector]
        fits = _fitting(padded < np.uint64(1 << bits), count)[:n]
        if not fits.any():
            break
        best[fits] = selector
    steps, starts, at = _COUNTS[best].tolist(), [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        count, bits = SELECTORS[selector]
        if bits:
            own = np.flatnonzero(chosen == selector)
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            words[own] |= np.bitwise_or.reduce(padded[starts[own][:, None] + np.arange(count)] << shifts, axis=1)
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of one block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n + SELECTORS[0][0], np.uint64)
    for selector in np.unique(selectors):
        count, bits = SELECTORS[selector]
        if bits:
            own = np.flatnonzero(selectors == selector)
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[starts[own][:, None] + np.arange(count)] = (words[own][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out[:n]


class _Writer:
    """One file being written."""

    def __init__(self, folder: str, id_type: pa.DataType):
        self.path = f"{folder}/part-{uuid.uuid4().hex}.s8b"
        system, inner = place(folder)
        system.create_dir(inner, recursive=True)
        system, inner = place(self.path)
        self.out = system.open_output_stream(inner, compression=None)
        self.out.write(MAGIC)
        self.id_type, self.docs, self.sizes, self.offsets = id_type, [], [], [0]
        self.pending, self.held, self.n_ids = [], 0, 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.pending.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= READ_BLOCKS * BLOCK_IDS:
            self._flush(self.held // BLOCK_IDS * BLOCK_IDS)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate([*self.pending, np.zeros(0, np.uint32)])
        for start in range(0, upto, BLOCK_IDS):
            words = encode(ids[start : min(start + BLOCK_IDS, upto)])
            self.out.write(words.astype("<u8").tobytes())
            self.offsets.append(self.offsets[-1] + len(words))
        self.pending, self.held = [ids[upto:]], len(ids) - upto

    def close(self) -> dict:
        self._flush(self.held)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        table = pa.table({"doc": pa.array(self.docs, self.id_type), "n": pa.array(self.sizes, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        docs = sink.getvalue().to_pybytes()
        self.out.write(docs)
        self.out.write(_END.pack(self.n_ids, self.offsets[-1], len(self.offsets), len(docs)) + MAGIC)
        self.out.close()
        return {"path": self.path, "n_docs": len(self.docs), "n_ids": self.n_ids, "n_words": self.offsets[-1]}


class TokenFile:
    """A file to read from: its documents, and any span of its ids."""

    def __init__(self, path: str):
        system, inner = place(path)
        self.file = system.open_input_file(inner)
        size, tail = self.file.size(), _END.size + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        if end[_END.size :] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        self.n_ids, n_words, n_offsets, docs = _END.unpack(end[: _END.size])
        at = len(MAGIC) + 8 * n_words
        self.offsets = np.frombuffer(self.file.read_at(8 * n_offsets, at), "<u8").astype(np.int64)
        table = pa.ipc.open_stream(self.file.read_at(docs, at + 8 * n_offsets)).read_all()
        self.docs, self.sizes = table.column("doc").combine_chunks(), table.column("n").to_numpy()

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of the blocks ``first`` to ``last - 1``."""
        low = self.offsets[first]
        words = np.frombuffer(self.file.read_at(8 * int(self.offsets[last] - low), len(MAGIC) + 8 * int(low)), "<u8")
        out = []
        for k in range(first, last):
            n = min(BLOCK_IDS, self.n_ids - k * BLOCK_IDS)
            out.append(decode(words[self.offsets[k] - low : self.offsets[k + 1] - low], n))
        return np.concatenate([*out, np.zeros(0, np.uint64)])

    def span(self, start: int, length: int) -> np.ndarray:
        """``length`` ids from place ``start`` on; only the blocks that hold them are read."""
        if not length:
            return np.zeros(0, np.uint64)
        first = start // BLOCK_IDS
        ids = self.blocks(first, (start + length - 1) // BLOCK_IDS + 1)
        return ids[start - first * BLOCK_IDS :][:length]

    def documents(self) -> Iterator[tuple[int, int, Iterator[np.ndarray]]]:
        """(place in the list of documents, start, pieces of its ids) in order; the pieces of one are to be read before the next."""
        read, held = 0, np.zeros(0, np.uint64)

        def pieces(n: int) -> Iterator[np.ndarray]:
            nonlocal read, held
            while n:
                if not len(held):
                    upto = min(read + READ_BLOCKS, len(self.offsets) - 1)
                    read, held = upto, self.blocks(read, upto)
                part, held = held[:n], held[n:]
                n -= len(part)
                yield part

        start = 0
        for k, n in enumerate(self.sizes.tolist()):
            yield k, start, pieces(n)
            start += n


#: Part of the names of special tokens; a text that holds it is split as it is.
_SPECIAL = "<|"
#: A clause's marks after a letter, and what replaces them: a word of their own.
_TAIL, _APART = r"([a-z])([.,;:!?*$&#%]+)([ \t-\r]|$)", r"\1 \2\3"


class _ByWords:
    """Ids of texts from the ids of their words, each encoded once by the tokenizer; its normaliser folds case, so A-Z are lower-cased before.

    The known words are one Arrow array, and words are looked up in it a batch at a time. Beyond ``_MEMO_WORDS`` only those of the last batch stay known.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.known = pa.array([], pa.string())
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Of tokenizers that mark the ends of words: the ids of the tokens that end one.
        mark = getattr(tokenizer.model, "end_of_word_suffix", None)
        self.ending = np.array([i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if mark and t.endswith(mark)], np.uint32)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        told = [e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, told), np.int64, count=len(told))
        return np.fromiter(chain.from_iterable(told), np.uint32, count=int(sizes.sum())), sizes

    def _encoded_letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone: encoded as one text and cut at the ends of words, if these are as many as the words."""
        if len(words) and len(self.ending):
            told = self.tokenizer.encode_batch_fast([" ".join(words.to_pylist())], add_special_tokens=False)
            ids = np.array(told[0].ids, np.uint32)
            ends = np.flatnonzero(np.isin(ids, self.ending)) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        return self._encoded(words)

    def _learn(self, new: pa.Array) -> None:
        letters = pc.utf8_is_alpha(new)
        for words, encoded in ((new.filter(letters), self._encoded_letters), (new.filter(pc.invert(letters)), self._encoded)):
            for start in range(0, len(words), _ENCODED_WORDS):
                part = words.slice(start, _ENCODED_WORDS)
                ids, sizes = encoded(part)
                self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
                self.sizes = np.concatenate([self.sizes, sizes])
                self.flat = np.concatenate([self.flat, ids])
                self.known = pa.concat_arrays([self.known, part])

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words one after another, and where those of each end."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def _forget(self, at: np.ndarray) -> None:
        """Only the words ``at`` stay known."""
        self.flat, ends = self._ids(at)
        self.known, self.sizes = self.known.take(pa.array(at)), self.sizes[at]
        self.starts = ends - self.sizes

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), _TAIL, _APART)
        words, counts = split_words(pc.if_else(pc.match_substring(texts, _SPECIAL), texts, plain))
        words = words.cast(pa.string())
        found = pc.index_in(words, value_set=self.known)
        if found.null_count:
            missed = found.is_null()
            rest = words.filter(missed)
            known = len(self.known)
            self._learn(rest.unique())
            found = pc.replace_with_mask(found, missed, pc.add(pc.index_in(rest, value_set=self.known.slice(known)), pa.scalar(known, pa.int32())))
        at = found.to_numpy()
        ids, ends = self._ids(at)
        if len(self.known) > _MEMO_WORDS:
            self._forget(np.unique(at))
        return np.split(ids, np.concatenate([[0], ends])[np.cumsum(counts)[:-1]])


@functools.lru_cache(maxsize=2)
def _encoder(json_path: str, by_words: bool) -> Callable[[pa.Array], list[np.ndarray]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(json_path)
    if by_words:
        return _ByWords(tokenizer).batch
    return lambda texts: [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]


def _write(json_path: str, by_words: bool, end_id: int, folder: str, file_ids: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = _encoder(json_path, by_words)
        writer, part, seq = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            for doc, ids in zip(batch.column("id"), encoded(pc.fill_null(batch.column("text"), "")), strict=True):
                writer = writer or _Writer(folder, batch.column("id").type)
                writer.add(doc.as_py(), np.append(ids, np.uint32(end_id)))
                if writer.n_ids >= file_ids:
                    yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, **writer.close()}], schema)
                    writer, seq = None, seq + 1
        if writer:
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, **writer.close()}], schema)

    return run


def write_tokens(
    docs: DataFrame,
    json_path: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    by_words: bool = True,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the ids of all texts in ascending order of ``id_col``, null last; returns the index of the files, stored.

    One row a file: ``path``, ``first_id`` (ids in all files before), ``n_docs``, ``n_ids``, ``n_words``. Each text is followed by ``end_id``, a null or empty one is
    that alone. ``by_words`` encodes every distinct word once, in lower case; it is right for tokenizers that fold case and take white space and the change from letters to
    marks as borders, white space being no token, and others take False. Rows that repeat an id are documents of their own, side by side; an empty table has no files. ``docs`` is a stored table, as its rows keep their places. ``json_path`` names a
    file that all executors have, ``folder`` one that they share, by default in the scratch folder.
    """
    spark: SparkSession = docs.sparkSession
    python_ready(spark, BATCH_BYTES)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder or scratch_path(spark, "tokens"))
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    read = fold(docs, {"id": id_col, "text": text_col}).select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_last(), F.col("hash"), F.col("row")]
    dealt = read.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "text")
    index = dealt.mapInArrow(_write(json_path, by_words, end_id, folder, file_ids), "part int, seq int, path string, n_docs long, n_ids long, n_words long")
    index = materialized(index, "token-files")
    # A row a file: few enough to be summed in one place.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return materialized(index.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id"), "n_docs", "n_ids", "n_words"), "token-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, first in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist(), strict=True):
            file = TokenFile(path)
            starts, crcs = [], []
            for _, start, pieces in file.documents():
                crc = 0
                for ids in pieces:
                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                starts.append(first + start)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([file.docs, pa.array(starts, pa.int64()), pa.array(file.sizes), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def read_documents(index: DataFrame, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files in ``index``: ``id_col``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids_crc32`` of what was unpacked.

    The checksum is that of the ids as little-endian unsigned 32-bit integers; wider ids count by their lower 32 bits.
    """
    python_ready(index.sparkSession)
    tasks = min(max(index.count(), 1), MAX_READ_TASKS)
    out = index.select("path", "first_id").repartition(tasks).mapInArrow(_read, f"id {id_type}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)
