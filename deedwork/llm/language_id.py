"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts. The code length of a byte is that of its longest known context, an escape (method C:
as likely as the number of distinct followers) leading to the next shorter one and at last to the uniform byte. A context holds up to ``ORDER`` bytes and does not
reach beyond the white space before the current word. Statistics are frozen after training, so the code length of a text is the sum over its words, and
that of a word the sum over its bytes: each batch works a distinct word out once, and each task a distinct run of bytes. White space and the ends of words are
not coded. The language with the shortest code wins.

Trees are fitted on a bounded sample: ``SAMPLE_DOCS`` labelled documents a language, those with the smallest hashes among the ones of at most
``SAMPLE_BYTES`` bytes and, where a language has too few of these, among its longer ones.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedwork.llm.common import fold, materialized, python_ready, split_words

ORDER = 4
SAMPLE_DOCS = 400
SAMPLE_BYTES = 1 << 15
UNKNOWN = "und"
_MEMO_GRAMS = 200_000
BATCH_BYTES = 4 << 20
_BYTES = (1 << 8 * (ORDER + 1)) - 1
_WORD_CHARACTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _WORD_CHARACTER.finditer(text))


def _key(gram: bytes) -> int:
    """A gram of at most ``ORDER`` + 1 bytes as a number: its length above its bytes."""
    return len(gram) << 8 * (ORDER + 1) | int.from_bytes(gram, "big")


def _found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in the sorted ``known`` ones, and whether it does."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


class ContextTrees:
    """Frozen statistics of all languages, as sorted arrays; ``counts``: (language, gram, count), a gram being a context and the byte after it."""

    def __init__(self, counts: list[tuple[str, bytes, int]]):
        self.languages = sorted({lang for lang, _, _ in counts})
        self.trees = []
        for own in self.languages:
            grams = sorted((_key(gram), _key(gram[:-1]), n) for lang, gram, n in counts if lang == own)
            keys, contexts, n = (np.array(x, np.int64) for x in zip(*grams, strict=True))
            known, at, kinds = np.unique(contexts, return_inverse=True, return_counts=True)
            self.trees.append((keys, n, known, np.bincount(at, weights=n), kinds))
        self._start()

    def _start(self) -> None:
        self.numbers: dict[int, int] = {}
        self.table = np.zeros((0, len(self.languages)))

    def _bits(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of grams in language ``k``: from the longest context down, by an escape each time."""
        grams, n, contexts, totals, kinds = self.trees[k]
        bits, coded = np.zeros(len(keys)), np.zeros(len(keys), bool)
        length, content = keys >> 8 * (ORDER + 1), keys & _BYTES
        for size in range(ORDER + 1, 0, -1):
            open_ = np.flatnonzero(~coded & (length >= size))
            tail = content[open_] & ((1 << 8 * size) - 1)
            at, held = _found(contexts, (size - 1) << 8 * (ORDER + 1) | tail >> 8)
            open_, tail, at = open_[held], tail[held], at[held]
            place, seen = _found(grams, size << 8 * (ORDER + 1) | tail)
            all_ = totals[at] + kinds[at]
            bits[open_] += np.log2(all_ / np.where(seen, n[place], kinds[at]))
            coded[open_[seen]] = True
        return bits + np.where(coded, 0.0, 8.0)

    def _grams(self, keys: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of grams, one column for each language."""
        if len(self.numbers) > _MEMO_GRAMS:
            self._start()
        listed = keys.tolist()
        new = [key for key in listed if key not in self.numbers]
        if new:
            self.numbers.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            asked = np.array(new, np.int64)
            self.table = np.concatenate([self.table, np.stack([self._bits(k, asked) for k in range(len(self.languages))], axis=1)])
        return self.table[np.fromiter(map(self.numbers.__getitem__, listed), np.int64, count=len(listed))]

    def words(self, words: pa.Array) -> np.ndarray:
        """Code lengths in bits of words, one column for each language."""
        if not len(words):
            return np.zeros((0, len(self.languages)))
        listed = words.cast(pa.binary()).to_pylist()
        sizes = np.fromiter(map(len, listed), np.int64, count=len(listed)) + 1
        flat = np.frombuffer(b" " + b" ".join(listed), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        before = np.arange(len(flat)) - np.repeat(starts, sizes)
        keys, length = np.zeros(len(flat), np.int64), np.minimum(before, ORDER) + 1
        for back in range(ORDER + 1):
            within = before >= back
            keys[within] |= flat[np.flatnonzero(within) - back] << 8 * back
        keys |= length << 8 * (ORDER + 1)
        coded = pa.array(keys[before > 0]).dictionary_encode()
        bits, place = self._grams(coded.dictionary.to_numpy()), coded.indices.to_numpy()
        return np.stack([np.add.reduceat(bits[place, k], starts - np.arange(len(starts))) for k in range(len(self.languages))], axis=1)

    def texts(self, texts: pa.Array) -> np.ndarray:
        words, sizes = split_words(texts)
        coded = words.dictionary_encode()
        bits = self.words(coded.dictionary)
        doc, at = np.repeat(np.arange(len(sizes)), sizes), coded.indices.to_numpy()
        return np.stack([np.bincount(doc, weights=bits[at, k], minlength=len(sizes)) for k in range(len(self.languages))], axis=1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        told = np.array([bool(t) and has_letter(t) for t in texts.to_pylist()], bool)
        if not self.languages or not told.any():
            return [UNKNOWN] * len(told), np.zeros(len(told))
        bits = self.texts(texts)
        best = bits.argmin(axis=1)
        score = 1.0 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000.0)).sum(axis=1)
        return [self.languages[k] if known else UNKNOWN for k, known in zip(best.tolist(), told.tolist(), strict=True)], np.where(told, score, 0.0)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words: Counter = Counter()
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            words.update((lang, word) for word in (text or "").encode("utf-8", "surrogatepass").split())
        grams: Counter = Counter()
        for (lang, word), n in words.items():
            padded = b" " + word
            for end in range(2, len(padded) + 1):
                for start in range(max(0, end - ORDER - 1), end):
                    grams[lang, padded[start:end]] += n
        yield pd.DataFrame([(lang, gram, n) for (lang, gram), n in grams.items()], columns=["lang", "gram", "n"])


_MODELS: dict[str, ContextTrees] = {}


def _packed(counts: list[tuple[str, bytes, int]]) -> bytes:
    return zlib.compress(pickle.dumps(counts))


def _scorer(packed: bytes, name: str, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MODELS:  # one model for each Python worker
            _MODELS.clear()
            _MODELS[name] = ContextTrees(pickle.loads(zlib.decompress(packed)))
        for batch in batches:
            if batch.num_rows:
                lang, score = _MODELS[name].predict(batch.column(text_at))
                kept = [name for name in batch.schema.names if name != "text"]
                columns = [batch.column(c) for c in kept]
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return run


def train(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list:
    """Counts of the context trees from a bounded sample of the rows that are labelled and not held out."""
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    rows = fold(rows, {"id": id_col, "text": text_col, "lang": lang_col}).where(F.col("text").isNotNull())
    rows = rows.withColumn("long", F.octet_length("text") > SAMPLE_BYTES)
    order = [F.col("long"), F.xxhash64(F.col("id").cast("string")), F.col("id")]
    picked = rows.select("id", "lang", "long").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    picked = picked.where(F.col("k") <= SAMPLE_DOCS).select(F.col("id").alias("picked_id"), F.col("lang").alias("picked_lang"), F.col("long").alias("picked_long"))
    # SAMPLE_DOCS ids a language: small enough to go to the texts, which stay where they are.
    picked = F.broadcast(materialized(picked.distinct(), "language-sample"))
    same = F.col("id").eqNullSafe(F.col("picked_id")) & (F.col("lang") == F.col("picked_lang")) & (F.col("long") == F.col("picked_long"))
    sample = rows.join(picked, same, "left_semi").select("lang", "text")
    counts = sample.mapInPandas(_count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return [(r["lang"], bytes(r["gram"]), r["n"]) for r in counts.collect()]


def identify(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per input row: ``id_col``, ``lang_pred``, ``score`` and the columns named in ``keep``.

    The score is the posterior of the language under equal priors. A null text and one without a letter are ``und`` with score 0; so is every
    text if no row is labelled. Ties go to the first language by name. Repeated rows are predicted alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    python_ready(spark, BATCH_BYTES)
    # The counts of the bounded sample go with the function, packed; a task unpacks them into arrays once.
    packed = _packed(train(docs, held_out, id_col, text_col, lang_col))
    columns = {f"kept_{k}": c for k, c in enumerate(dict.fromkeys((id_col, *keep)))}
    own = [k for k, c in enumerate(columns.values()) if c == text_col]
    # A text that is kept anyway goes to Python once.
    read = fold(docs, columns | ({} if own else {"text": text_col}))
    out = ", ".join(f"{c} {read.schema[c].dataType.simpleString()}" for c in columns)
    scored = read.mapInArrow(_scorer(packed, uuid.uuid4().hex, own[0] if own else len(columns)), f"{out}, lang_pred string, score double")
    return scored.select(*(F.col(ours).alias(theirs) for ours, theirs in columns.items()), "lang_pred", "score")
