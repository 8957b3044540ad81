"""Mixture-controlled packing of token documents into sequences.

Each source is a queue of tokens. Deficit round-robin serves the queues window by window: a window of ``seq_tokens`` takes from each queue
its share of the window, whole tokens only, and what a queue was owed but did not get is carried to the next window. The shares are given, or else those of
the corpus, which every window can keep to the end. Where a queue runs dry inside a window, the others fill it by their shares, and go on with these: one
``Segment`` of the schedule ends and another begins.

Within a segment the carried deficits have a closed form: after x tokens the first j queues together have given floor(x * W_j / W) tokens, W_j being their
weight and W that of all. So a document finds its windows from its place in its queue alone, no window waits for the one before, and the whole schedule is as many
segments as queues run dry. A queue under one token a window has no such form: without given shares, such sources join a pooled queue, which leaves at most ``seq_tokens`` queues.

A document is tokenised once. Its place in the queue is the sum before it in its partition, which the tokenising task keeps, plus
the sums of earlier partitions; only these sums are ordered.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from fractions import Fraction
from itertools import accumulate
from math import lcm

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deedwork.llm.common import fold, materialized, python_ready

SEQ_TOKENS = 2048
END_ID = 1
BATCH_BYTES = 4 << 20


@functools.lru_cache(maxsize=2)
def _tokenizer(json_path: str, ranks_path: str):
    """The tokenizer and a function from a text to its ids.

    The ranks are the same vocabulary, encoded several times as fast; a text that holds the name of a special token goes to the tokenizer itself.
    """
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(json_path)
    if not ranks_path:
        return full, lambda text: np.array(full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in full.get_added_tokens_decoder().values()]

    def ids(text: str) -> np.ndarray:
        if any(name in text for name in special):
            return np.array(full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return full, ids


def _tokenise(json_path: str, ranks_path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, ids_of = _tokenizer(json_path, ranks_path)
        before: dict = {}
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                ids, sums = [], []
                for source, text in zip(part["source"], part["text"], strict=True):
                    tokens = np.append(ids_of(text or ""), end_id).astype("<u4")
                    ids.append((tokens if tokens.max() > 0xFFFF else tokens.astype("<u2")).tobytes())
                    sums.append((before.get(source, 0), len(tokens)))
                    before[source] = sums[-1][0] + len(tokens)
                pa.default_memory_pool().release_unused()
                yield pd.DataFrame(
                    {
                        "part": part["part"].to_numpy(),
                        "id": part["id"].array,
                        "source": part["source"].array,
                        "before": [a for a, _ in sums],
                        "n": [n for _, n in sums],
                        "ids": ids,
                    }
                )

    return run


@dataclass(frozen=True)
class Segment:
    """``windows`` windows from ``first`` on, each queue having given ``given`` tokens before.

    ``ends`` are running sums over the queues: of their weights or, if ``weight`` is 0, of the tokens that they give to the one window.
    """

    first: int
    windows: int
    given: tuple[int, ...]
    ends: tuple[int, ...]
    weight: int

    def upto(self, queue: int, window: int, seq_tokens: int) -> int:
        """Tokens that the first ``queue`` queues give to the first ``window`` windows of the segment."""
        return window * seq_tokens * self.ends[queue] // self.weight if self.weight else window * self.ends[queue]


def _sums(values: Iterable[int]) -> tuple[int, ...]:
    return (0, *accumulate(values))


def schedule(sizes: Sequence[int], weights: Sequence[int], seq_tokens: int) -> list[Segment]:
    """Deficit round-robin over queues of so many tokens: runs of windows in which no queue runs dry, and the single windows between them."""
    left, window, segments = list(sizes), 0, []
    while any(left):
        held = [w if n else 0 for w, n in zip(weights, left, strict=True)]
        if not any(held):  # queues without a share come last, by their sizes
            held = list(left)
        ends = _sums(held)
        given = tuple(a - b for a, b in zip(sizes, left, strict=True))
        steady = Segment(window, 0, given, ends, ends[-1])

        def taken(queue: int, windows: int, of: Segment = steady) -> int:
            return of.upto(queue + 1, windows, seq_tokens) - of.upto(queue, windows, seq_tokens)

        # The most windows that no queue runs dry in; a queue gives more with each of them.
        low, high = 0, sum(left) // seq_tokens
        while low < high:
            middle = (low + high + 1) // 2
            fits = all(taken(q, middle) <= n for q, n in enumerate(left))
            low, high = (middle, high) if fits else (low, middle - 1)
        if low:
            segments.append(replace(steady, windows=low))
        before = [taken(q, low) for q in range(len(left))]
        after = [taken(q, low + 1) for q in range(len(left))]
        left = [n - x for n, x in zip(left, before, strict=True)]
        window += low
        if not any(left):
            break
        # The window in which one does: each gives its due or all it has, then what lacks comes by weight, the heaviest queues first.
        own = [min(n, max(0, y - x)) for n, x, y in zip(left, before, after, strict=True)]
        lack = min(seq_tokens, sum(left)) - sum(own)
        while lack:
            able = [q for q in range(len(left)) if left[q] > own[q]]
            able = [q for q in able if held[q]] or able
            share = sum(held[q] or 1 for q in able)
            more = {q: min(left[q] - own[q], lack * (held[q] or 1) // share) for q in able}
            if not any(more.values()):
                more = dict.fromkeys(sorted(able, key=lambda q: (-held[q], q))[:lack], 1)
            for q, n in more.items():
                own[q] += n
            lack -= sum(more.values())
        given = tuple(a - b for a, b in zip(sizes, left, strict=True))
        segments.append(Segment(window, 1, given, _sums(own), 0))
        left = [n - x for n, x in zip(left, own, strict=True)]
        window += 1
    return segments


def _pieces(segments: list[Segment], seq_tokens: int, id_name: str):
    def windows_of(queue: int, at: int) -> Iterator[tuple[int, int, int, int]]:
        """(window, first token of the queue in it, the token after its last, offset of the first) from about the token ``at`` on."""
        k = max(0, bisect_right(segments, at, key=lambda s: s.given[queue]) - 1)
        while k and segments[k].given[queue] == at:  # segments that take nothing of this queue may lie between
            k -= 1
        for segment in segments[k:]:
            weight = segment.ends[queue + 1] - segment.ends[queue]
            if not weight:
                continue
            start = 0
            if segment.weight:
                start = max(0, (at - segment.given[queue]) * segment.weight // (weight * seq_tokens) - 2)
            for n in range(start, segment.windows):
                (low, upto_low), (high, upto_high) = ((segment.upto(q, n, seq_tokens), segment.upto(q, n + 1, seq_tokens)) for q in (queue, queue + 1))
                base = segment.given[queue]
                yield segment.first + n, base + high - low, base + upto_high - upto_low, upto_low - low

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, n, ids, queue, at in zip(*(batch[c] for c in ("id", "n", "ids", "queue", "at")), strict=True):
                tokens = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                done = 0
                for window, first, last, offset in windows_of(queue, at):
                    if last > at + done:
                        length = min(n, last - at) - done
                        crc = zlib.crc32(tokens[done : done + length].tobytes())
                        rows.append((doc, done, length, crc, n, window, offset + at + done - first))
                        done += length
                        if done == n:
                            break
            yield pd.DataFrame(rows, columns=[id_name, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str = "",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seq_tokens: int = SEQ_TOKENS,
    end_id: int = END_ID,
    targets: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``targets`` gives sources their shares of every window, in proportion, each at least a token a window; by default the shares are those of the corpus. Once a source
    is used up, the others share its part; sources without a target come when all others are used up. Every sequence but the last is full. A null or empty text is the end id alone; a null source is a queue of its own; repeated rows are
    packed once each; an empty table has no pieces. Both paths name files that all executors have.
    """
    python_ready(docs.sparkSession, BATCH_BYTES)
    read = fold(docs, {"id": id_col, "source": source_col, "text": text_col})
    read = read.select(F.spark_partition_id().alias("part"), "id", F.col("source").cast("string"), "text")
    id_type = read.schema["id"].dataType.simpleString()
    schema = f"part int, id {id_type}, source string, before long, n long, ids binary"
    staged = materialized(read.mapInPandas(_tokenise(json_path, ranks_path, end_id), schema), "token-ids")

    sums = materialized(staged.groupBy("part", "source").agg(F.sum("n").alias("n")), "queue-sums")
    sources = sums.groupBy("source").agg(F.sum("n").alias("n"))
    total = sources.agg(F.sum("n")).first()[0] or 0
    if targets is None:
        # At most seq_tokens sources can hold one token of each window; the others share the last queue.
        wide = sorted(sources.where(F.col("n") * seq_tokens >= total).collect(), key=lambda r: (-r["n"], r["source"] or ""))
    else:
        shares = {source: Fraction(share).limit_denominator(10**9) for source, share in targets.items()}
        if any(share * seq_tokens < sum(shares.values()) for share in shares.values()):
            raise ValueError("a target is under one token a window")
        wide = sources.where(F.col("source").isin(list(shares))).collect()
        wide = sorted(wide, key=lambda r: (-shares[r["source"]], r["source"]))
    pooled = total - sum(r["n"] for r in wide)
    sizes, pool = [r["n"] for r in wide] + [pooled], len(wide)
    if targets is None:
        if pooled * seq_tokens < total:  # not a token a window either: it lengthens the longest queue
            sizes, pool = [sizes[0] + pooled if wide else pooled, *sizes[1:-1]], 0
        weights = list(sizes)
    else:
        scale = lcm(*(share.denominator for share in shares.values()))
        weights = [int(shares[r["source"]] * scale) for r in wide] + [0]
    segments = schedule(sizes, weights, seq_tokens)
    own = docs.sparkSession.createDataFrame([(r["source"], k) for k, r in enumerate(wide)], "own string, own_queue int")
    cells = sums.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("own")), "left")
    cells = cells.select("part", "source", "n", F.coalesce("own_queue", F.lit(pool)).alias("queue"))
    parts = cells.groupBy("queue", "part").agg(F.sum("n").alias("part_n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("queue", "part", F.coalesce(F.sum("part_n").over(earlier), F.lit(0)).alias("parts_before"))
    beside = Window.partitionBy("queue", "part").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cells_before", F.coalesce(F.sum("n").over(beside), F.lit(0))).drop("n").join(parts, ["queue", "part"])
    cells = cells.select("queue", F.col("part").alias("p"), F.col("source").alias("s"), (F.col("parts_before") + F.col("cells_before")).alias("base"))
    places = materialized(cells, "queue-places")
    placed = staged.join(places, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    placed = placed.select("id", "n", "ids", "queue", (F.col("base") + F.col("before")).alias("at"))
    out = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInPandas(_pieces(segments, seq_tokens, id_col), out)
