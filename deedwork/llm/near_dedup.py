"""Near-duplicate detection by Order MinHash.

A document is the sequence of its five-word shingles, each labelled with its occurrence number. One sketch takes the ``PICKS`` shingles with the
least hashes under one hash function and keeps them in text order, so that it agrees for documents that are close in edit distance and not for
those that only share a vocabulary. Documents that agree in any of ``SKETCHES`` sketches are candidates. Sampling from few shingles is less sure than
from many, so texts of up to ``EXACT_SHINGLES`` shingles also meet by exact keys: of ``n`` shingles in one order for all texts, two that match in
``m`` have three in common among their first ``n - m + 3``. Two texts of up to that size are always candidates if they match in 0.8 or more; of larger
pairs at 0.8 the sketches miss 1.2 in 100,000 at 30 shingles in either and 3 in a million in the limit.

Candidates are verified by an alignment of their shingles within the band that the threshold leaves: matched in order / all distinct >= 0.8.

Equal word sequences are one node from the start. The nodes of a bucket are compared with one of them, what links becomes one class, and
two more rounds compare the classes left in a bucket with other members. Then every pair of nodes in a bucket that are still in different classes
is considered, so no candidate link is lost.

What is considered is first held against a bound that never errs: in a bitmap of ``MARK_BITS`` parities, one shingle that only one of two documents
has flips one bit, so two bitmaps differ in no more bits than the documents differ in shingles. Pairs beyond the threshold by this count alone never
leave the join; a group of documents that are alike, but not alike enough, makes comparisons of a few machine words and no rows.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedwork.llm.common import fold, materialized, python_ready, text_key, whole_row
from deedwork.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
PICKS = 5
MARK_BITS = 1024
SKETCHES = 32
EXACT_SHINGLES = 25
EXACT_PICKS = 3
STAR_ROUNDS = 3
_LAST_ID = (1 << 63) - 1
_MEMO_WORDS = 100_000
BATCH_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, size=256, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _MEMO_WORDS:
            self[word] = value
        return value


_hash_of = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles in order, made distinct by their occurrence numbers; none for a shorter text."""
    n = len(hashes) - SHINGLE_WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        out = _mixed(out * _ODD + hashes[k : k + n])
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    again = ranked[1:] == ranked[:-1]
    if again.any():
        first = np.concatenate([[True], ~again])
        starts = np.flatnonzero(first)
        number = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        out[order] = _mixed(ranked + number.astype(np.uint64) * _ODD)
    return out


def sketches_of(shingles: np.ndarray, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """One hash for each sketch: its least shingles in text order."""
    picks, out = min(picks, len(shingles)), np.zeros(sketches, np.uint64)
    if not picks:
        return out[:0]
    step = max(1, (1 << 19) // len(shingles))
    for low in range(0, sketches, step):
        seeds = _SEEDS[low : min(sketches, low + step)]
        values = _mixed(shingles[None, :] ^ seeds[:, None])
        at = np.argpartition(values, picks - 1, axis=1)[:, :picks] if picks < len(shingles) else np.tile(np.arange(picks), (len(seeds), 1))
        chosen, told = shingles[np.sort(at, axis=1)], seeds.copy()
        for k in range(picks):
            told = _mixed(told * _ODD + chosen[:, k])
        out[low : low + len(seeds)] = told
    return out


@functools.lru_cache(maxsize=256)
def _choices(size: int, picks: int) -> np.ndarray:
    return np.array(list(combinations(range(size), picks)), dtype=np.int64)


def exact_keys_of(shingles: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Keys of which two texts of up to ``EXACT_SHINGLES`` shingles share one, whenever they match in ``least``; none for a longer text."""
    n = len(shingles)
    if not 0 < n <= EXACT_SHINGLES:
        return np.zeros(0, np.uint64)
    need = math.ceil(least * n - 1e-9)
    low, high = (min(EXACT_PICKS, x) for x in (math.ceil(least * need - 1e-9), need))
    ranked, out = np.sort(shingles), []
    for picks in range(low, high + 1):  # the sizes that the texts it may match take
        chosen = ranked[_choices(n - need + picks, picks)]
        told = np.full(len(chosen), picks, np.uint64)
        for k in range(picks):
            told = _mixed(told * _ODD + chosen[:, k])
        out.append(told)
    return np.concatenate(out)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shingles matched in order over all distinct ones; 0 as soon as it is sure to stay below ``least``."""
    need = least * (len(a) + len(b)) / (1 + least)
    if not len(a) or not len(b) or min(len(a), len(b)) < need - 1e-9:
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = len(a) + len(b) - 2 * need
    near = np.abs(at_a - at_b) <= band + 1e-9
    at_a, at_b = at_a[near], at_b[near]
    if len(at_a) < need - 1e-9:
        return 0.0
    path = at_b[np.argsort(at_a)]
    matched = len(path)
    if (np.diff(path) < 0).any():  # the longest increasing path through the band
        tails: list[int] = []
        for x in path.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        matched = len(tails)
    return matched / (len(a) + len(b) - matched)


def _sketch(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part, rows = batch.iloc[start : start + 512], []
                for text in part["text"]:
                    words = words_of(text)
                    same = xxhash.xxh3_128_intdigest(b" ".join(words))
                    hashes = np.fromiter(map(_hash_of.__getitem__, words), dtype=np.uint64, count=len(words))
                    shingles = shingles_of(hashes)
                    bands = np.concatenate([sketches_of(shingles), exact_keys_of(shingles, least)]).view(np.int64)
                    rows.append(((same >> 64) - (1 << 63), (same & ((1 << 64) - 1)) - (1 << 63), len(words), bands))
                out = pd.DataFrame(rows, columns=["high", "low", "n", "bands"])
                pa.default_memory_pool().release_unused()
                yield pd.DataFrame({"doc": part["doc"].to_numpy(), "key": part["key"].to_numpy()}).join(out)

    return run


MARKS = tuple(f"m{k}" for k in range(MARK_BITS // 64))


def marks_of(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles at each of ``MARK_BITS`` places, packed into words."""
    places = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % MARK_BITS, minlength=MARK_BITS)
    return np.packbits((places & 1).astype(np.uint8)).view(np.int64)


def _sequence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [np.array([_hash_of[w] >> 32 for w in words_of(text)], dtype="<u4") for text in batch["text"]]
        shingles = [shingles_of(w.astype(np.uint64)) for w in words]
        out = pd.DataFrame({"node": batch["node"].to_numpy(), "n": [len(s) for s in shingles], "words": [w.tobytes() for w in words]})
        pa.default_memory_pool().release_unused()
        marks = np.array([marks_of(s) for s in shingles], dtype=np.int64).reshape(-1, len(MARKS))
        yield out.join(pd.DataFrame(marks, columns=MARKS))


def _marked(sequences: DataFrame, as_: str) -> DataFrame:
    """The nodes with their sizes and bitmaps, all names ending in ``as_``."""
    return sequences.select(*(F.col(c).alias(f"{c}_{as_}") for c in ("node", "n", *MARKS)))


def _may_link(least: float) -> Column:
    """Whether two marked nodes, ``u`` and ``v``, can differ in few enough shingles."""
    flipped = [F.bit_count(F.col(f"{m}_u").bitwiseXOR(F.col(f"{m}_v"))) for m in MARKS]
    return sum(flipped[1:], flipped[0]) <= (F.col("n_u") + F.col("n_v")) * ((1 - least) / (1 + least)) + 1e-6


def _verify(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}

        def shingles(node: int, words: bytes) -> np.ndarray:
            if node not in seen:
                if len(seen) > 64:
                    seen.clear()
                seen[node] = shingles_of(np.frombuffer(words, "<u4").astype(np.uint64))
            return seen[node]

        for batch in batches:
            told = [
                aligned(shingles(u, a), shingles(v, b), least) >= least - 1e-9
                for u, v, a, b in zip(batch["u"], batch["v"], batch["a"], batch["b"], strict=True)
            ]
            pa.default_memory_pool().release_unused()
            yield batch.loc[told, ["u", "v"]]

    return run


def _links(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    marked = pairs.join(_marked(sequences, "u"), F.col("u") == F.col("node_u")).join(_marked(sequences, "v"), F.col("v") == F.col("node_v"))
    pairs = marked.where(_may_link(least)).select("u", "v")
    both = pairs.join(sequences.select(F.col("node").alias("u"), F.col("words").alias("a")), "u")
    both = both.join(sequences.select(F.col("node").alias("v"), F.col("words").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInPandas(_verify(least), "u long, v long")


def _classes(buckets: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """``node`` and ``label`` of the nodes that are linked with a smaller one."""
    links, labels = None, None
    for turn in range(STAR_ROUNDS + 1):
        left = buckets.withColumn("label", F.col("node"))
        if labels is not None:
            known = labels.withColumnRenamed("label", "known")
            left = buckets.join(known, "node", "left").select("bucket", "node", F.coalesce("known", "node").alias("label"))
            open_ = left.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket")
            left = materialized(left.join(open_, "bucket", "left_semi"), "open-buckets")
            if left.isEmpty():
                break
        if turn < STAR_ROUNDS:
            # The least node first, so that a pair is the same in all buckets; others later, so that its failures meet elsewhere.
            rank = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
            stars = left.withColumn("rank", rank).groupBy("bucket").agg(F.min_by("node", "rank").alias("u"), F.min_by("label", "rank").alias("l"))
            pairs = left.join(stars, "bucket").where("label <> l").select(F.col("node").alias("v"), "u")
        else:
            one, other = (
                left.select(F.col("bucket").alias(f"bucket_{x}"), F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
                .join(_marked(sequences, x), F.col(x) == F.col(f"node_{x}"))
                for x in "uv"
            )
            apart = (F.col("u") < F.col("v")) & (F.col("label_u") != F.col("label_v"))
            pairs = one.join(other, (F.col("bucket_u") == F.col("bucket_v")) & apart & _may_link(least)).select("u", "v")
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        found = materialized(_links(pairs, sequences, least), "near-links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    return labels


def _members(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """One row per input row: ``doc``, ``key`` and ``label``, the same for all rows of a class and null for texts without words."""
    python_ready(docs.sparkSession, BATCH_BYTES)
    read = fold(docs, {"id": id_col, "text": text_col})
    keyed = read.select("id", F.coalesce(F.col("id").cast("bigint"), F.lit(_LAST_ID)).alias("doc"), text_key(F.col("text")).alias("key"), "text")
    schema = "doc long, key binary, high long, low long, n int, bands array<long>"
    rows = materialized(keyed.select("doc", "key", "text").mapInPandas(_sketch(least), schema), "sketches")
    same = ["high", "low", "n"]
    first = rows.where("n > 0").groupBy(*same).agg(F.min(F.struct("doc", "key")).alias("f"))
    nodes = first.select(*same, "f.doc", "f.key", F.monotonically_increasing_id().alias("node"))
    nodes = materialized(nodes, "nodes")

    spread = rows.where("size(bands) > 0").join(nodes, [*same, "doc", "key"])
    spread = spread.select("node", F.explode(F.array_distinct("bands")).alias("bucket")).distinct()
    full = spread.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("bucket")
    buckets = materialized(spread.join(full, "bucket", "left_semi"), "buckets")
    asked = buckets.select("node").distinct().join(nodes, "node").select("node", F.col("doc").alias("d"), F.col("key").alias("k"))
    marks = ", ".join(f"{m} long" for m in MARKS)
    texts = keyed.join(asked, (F.col("doc") == F.col("d")) & (F.col("key") == F.col("k"))).select("node", "text")
    sequences = materialized(texts.mapInPandas(_sequence, f"node long, n int, words binary, {marks}").dropDuplicates(["node"]), "word-sequences")
    labels = _classes(buckets, sequences, least)

    named = nodes.join(labels, "node", "left").select(*same, "doc", F.coalesce("label", "node").alias("label"))
    members = rows.join(named.drop("doc"), same, "left")
    return materialized(members.select("doc", "key", "label"), "members")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per input row: ``id_col``, ``class_id``, ``class_size`` and ``key``, a 128-bit hash of the text.

    ``class_id`` is the smallest id among all documents that links connect. Equal word sequences, repeated rows among them, are linked; a text of
    fewer than five words has no other links, one without words (null, empty) no links at all: it is its own class. A null id comes after
    all others and names no class but its own. An empty table gives an empty result.
    """
    members = _members(docs, id_col, text_col, least)
    classes = members.where("label is not null").groupBy("label").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    out = members.join(classes, "label", "left")
    own = F.col("label").isNull()
    return out.select(
        F.when(F.col("doc") < _LAST_ID, F.col("doc")).alias(id_col),
        F.when(F.when(own, F.col("doc")).otherwise(F.col("class_id")) < _LAST_ID, F.when(own, F.col("doc")).otherwise(F.col("class_id"))).alias("class_id"),
        F.when(own, F.lit(1)).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
        "key",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class, one with its smallest id, with all columns. Texts without words stay, one for each id."""
    members = _members(docs, id_col, text_col, least)
    first = members.where("label is not null").groupBy("label").agg(F.min(F.struct("doc", "key")).alias("f")).select("f.doc", "f.key")
    told = first.unionByName(members.where("label is null").select("doc", "key").distinct())
    row_id = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_LAST_ID))
    keyed = docs.select(whole_row(docs), row_id.alias("row_id"), text_key(F.col(f"`{text_col}`")).alias("row_key"))
    stays = keyed.join(told, (F.col("row_id") == F.col("doc")) & (F.col("row_key") == F.col("key")))
    return stays.dropDuplicates(["row_id", "row_key"]).select("row.*")
