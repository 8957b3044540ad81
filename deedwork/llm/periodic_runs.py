"""Runs of repeated words by an enhanced suffix array.

A run is a stretch of words with a smallest period, long enough for it, that cannot be extended. Where it ends, its last two periods are a branching tandem:
places i and i + p whose suffixes share exactly p words. So both lie in the LCP interval of depth p, in different children of it. For every such interval the
suffixes of all children but the largest are held against the inverse suffix array: does i + depth, or i - depth, lie in the interval too? Each square found is
rotated to the left as far as the period reaches; the squares of one stretch make one run, whose period is the smallest of theirs.

Documents are worked on in groups of some words, arrays and no tree: the suffix array by doubling, in which only tied suffixes are sorted again; the LCP from the ranks
of the doublings; the borders of the intervals by pointer jumping. A period is at most a share of its document, so suffixes are sorted no further than that. An
interval has as many suffixes as a run has periods at least; smaller ones are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedwork.llm.common import fold, python_ready, split_words

LEAST_WORDS = 6
LEAST_PERIODS = 4
GROUP_WORDS = 400_000
_EXPANDED = 2_000_000
_OPEN = np.iinfo(np.int32).max


def _suffix_array(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, document by document, and the LCP of neighbours; beyond ``need`` words suffixes stay tied, with an open LCP."""
    n = len(words)
    key = doc.astype(np.int64) << 32 | words
    sa = np.argsort(key, kind="stable").astype(np.int32)
    ordered = key[sa]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    slots = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, slots, 0))
    ranks, split, known = [rank.copy()], np.where(head, 0, -1).astype(np.int8), 1
    alone = head & np.append(head[1:], True)
    active = slots[~alone]
    while True:
        active = active[known < need[doc[sa[active]]]]
        if not len(active):
            break
        at = sa[active]
        after = at + known
        inside = after < ends[doc[at]]
        second = np.where(inside, rank[np.where(inside, after, 0)], -1)
        key = rank[at].astype(np.int64) * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[active] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        split[active[new & (split[active] < 0)]] = len(ranks)
        rank[at] = np.maximum.accumulate(np.where(new, active, 0))
        active = active[~(new & np.append(new[1:], True))]
        ranks.append(rank.copy())
        known *= 2
    lcp = np.where(split < 0, _OPEN, 0).astype(np.int32)
    begun = np.zeros(0, np.int32)
    left = right = begun
    for level in range(len(ranks) - 2, -1, -1):
        if len(begun):
            inside = (left < ends[doc[sa[begun]]]) & (right < ends[doc[sa[begun]]])
            same = inside & (ranks[level][np.where(inside, left, 0)] == ranks[level][np.where(inside, right, 0)])
            lcp[begun] += np.where(same, 1 << level, 0).astype(np.int32)
            left, right = left + (same << level), right + (same << level)
        more = np.flatnonzero(split == level + 1).astype(np.int32)
        lcp[more] = 1 << level
        begun = np.concatenate([begun, more])
        left, right = np.concatenate([left, sa[more - 1] + (1 << level)]), np.concatenate([right, sa[more] + (1 << level)])
    return sa, lcp


def _nearest(lcp: np.ndarray, at: np.ndarray, step: int, strictly: bool) -> np.ndarray:
    """For each slot of ``at`` the nearest one in direction ``step`` with a smaller LCP, or one not larger; ``lcp`` begins and ends with smaller ones."""
    near = np.arange(len(lcp), dtype=np.int32) + np.int32(step)
    open_ = at
    while len(open_):
        there = near[open_]
        beyond = lcp[there] >= lcp[open_] if strictly else lcp[there] > lcp[open_]
        open_ = open_[beyond]
        near[open_] = near[there[beyond]]
    return near[at]


def _squares(sa: np.ndarray, lcp: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Branching tandems (place, period)."""
    n = len(sa)
    isa = np.empty(n, np.int32)
    isa[sa] = np.arange(n, dtype=np.int32)
    lcp = np.append(lcp, 0).astype(np.int32)  # slot 0 and slot n begin and end everything
    lcp[0] = 0
    at = np.flatnonzero(lcp > 0).astype(np.int32)
    if not len(at):
        return
    low, high = _nearest(lcp, at, -1, True), _nearest(lcp, at, 1, True)
    # Borders of children: an interval is cut at each slot that has its depth.
    before, after = _nearest(lcp, at, -1, False), _nearest(lcp, at, 1, False)
    deep = lcp[at]
    wide = (high - low >= least) & (deep <= longest[doc[sa[low]]])
    at, low, high, deep, before, last = at[wide], low[wide], high[wide], deep[wide], before[wide], (after == high)[wide]
    if not len(at):
        return
    first_slot = np.concatenate([before, at[last]])
    end_slot = np.concatenate([at, high[last]])
    low, high, deep = (np.concatenate([x, x[last]]) for x in (low, high, deep))
    # Every interval has one of its own two borders to itself.
    own = np.where(lcp[low] >= lcp[high], low, high - 1)
    size = end_slot - first_slot
    most = np.zeros(n, np.int32)
    np.maximum.at(most, own, size)
    largest = np.flatnonzero(size == most[own])
    kept = np.full(n, len(size), np.int64)
    np.minimum.at(kept, own[largest], largest)
    small = np.flatnonzero(kept[own] != np.arange(len(size)))
    sums = np.cumsum(size[small], dtype=np.int64)
    done = 0
    while done < len(small):
        upto = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + _EXPANDED, "right")))
        part, done = small[done:upto], upto
        sizes = size[part].astype(np.int64)
        place = np.repeat(first_slot[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        x, d = sa[place], np.repeat(deep[part], sizes)
        child, interval = ((np.repeat(a[part], sizes), np.repeat(b[part], sizes)) for a, b in ((first_slot, end_slot), (low, high)))
        for sign in (1, -1):
            y = x + sign * d
            inside = (y < ends[doc[x]]) if sign > 0 else (y >= starts[doc[x]])
            slot = isa[np.where(inside, y, 0)]
            square = inside & (slot >= interval[0]) & (slot < interval[1]) & ((slot < child[0]) | (slot >= child[1]))
            yield (x if sign > 0 else y)[square], d[square]


def _rotated(words: np.ndarray, start: int, at: int, period: int) -> int:
    """How far to the left of ``at``, but not beyond ``start``, the period holds."""
    size = 16
    while at > start:
        low = max(start, at - size)
        other = np.flatnonzero(words[low:at] != words[low + period : at + period])
        if len(other):
            return low + int(other[-1]) + 1
        at, size = low, size * 2
    return at


def runs_of(documents: list[np.ndarray], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document of numbered words, by start and period."""
    sizes = np.array(list(map(len, documents)), np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not len(documents) or not ends[-1]:
        return found
    words = np.concatenate(documents)
    doc = np.repeat(np.arange(len(documents), dtype=np.int32), sizes)
    longest = np.where(sizes >= least_words, sizes // least_periods, 0)
    sa, lcp = _suffix_array(words, doc, ends, longest + 1)
    known: dict[tuple[int, int], int] = {}
    for at, period in _squares(sa, lcp, doc, starts, ends, longest, least_periods):
        at, period = at.astype(np.int64), period.astype(np.int64)
        back = np.maximum(period * least_periods, least_words) - 2 * period  # so far at least a run reaches beyond the square
        fits = at - back >= starts[doc[at]]
        at, period, back = at[fits], period[fits], back[fits]
        for probe in (lambda far: np.minimum(far, 1), lambda far: far, lambda far: (far + 1) // 2):
            p = at - probe(back)
            fits = words[p] == words[p + period]
            at, period, back = at[fits], period[fits], back[fits]
        for i, p, far in zip(at.tolist(), period.tolist(), back.tolist(), strict=True):
            first = _rotated(words, int(starts[doc[i]]), i, p)
            if first <= i - far:
                stretch = (first, i + 2 * p)
                known[stretch] = min(known.get(stretch, p), p)
    for (first, end), period in known.items():
        d = int(doc[first])
        found[d].append((first - int(starts[d]), end - first, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(least_words: int, least_periods: int):
    def group(ids: pa.Array, words: pa.Array, coded: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(sizes)
        runs = runs_of([coded[end - size : end] for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)], least_words, least_periods)
        covered = np.zeros(len(words) + 1, np.int64)
        for end, size, own in zip(ends.tolist(), sizes.tolist(), runs, strict=True):
            for start, length, period in own:
                covered[end - size + start + period] += 1
                covered[end - size + start + length] -= 1
        kept = np.cumsum(covered[:-1]) == 0
        offsets = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(kept))), " ")
        listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], _RUNS)
        top = [max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if own else (None,) * 3 for own in runs]
        best = [pa.array([r[k] for r in top], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes), *best, listed, collapsed], ["id", "n_words", "start", "length", "period", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, sizes = split_words(batch.column("text"))
            coded = words.dictionary_encode().indices.to_numpy()
            ends = np.cumsum(sizes)
            first = 0
            while first < len(sizes):
                before = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + GROUP_WORDS, "right")))
                upto = int(ends[last - 1])
                yield group(batch.column("id").slice(first, last - first), words.slice(before, upto - before), coded[before:upto], sizes[first:last])
                first = last

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``start``, ``length``, ``period``, ``runs`` (of these three, by start and period) and ``collapsed``.

    Words are separated by ASCII white space, numbered from 0 and otherwise unchanged. A run has at least ``least_words`` words and ``least_periods`` (2 or more)
    periods; ``start``, ``length`` and ``period`` are those of the run with the most periods (ties: smallest start, then period), null without runs.
    ``collapsed`` leaves out the words that any run contains after its first period. A null or empty text has no words and no runs; repeated rows give the
    same result; an empty table an empty one. Memory follows the longest document, some 150 bytes a word.
    """
    python_ready(docs.sparkSession)
    read = fold(docs, {"id": id_col, "text": text_col})
    id_type = read.schema["id"].dataType.simpleString()
    runs = "array<struct<start:bigint,length:bigint,period:bigint>>"
    out = read.mapInArrow(_find(least_words, least_periods), f"id {id_type}, n_words long, start long, length long, period long, runs {runs}, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text_col`` of ``docs``, every tenth document by the hash of its id repeating a passage of its own up to its end.

    With h = crc32 of the decimal id and g = h div 10, a document with h mod 10 = 0 and n > 0 words has, from word a = g mod n on, the
    p = 1 + (n - a) div (3 + g mod 8) words there over and over. Others are as they were.
    """
    read = fold(docs, {"id": id_col, "text": text_col}).withColumn("h", F.crc32(F.col("id").cast("string")))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    read = read.withColumn("w", F.when(chosen, words)).withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("w"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    read = read.withColumn("a", a).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))

    def place(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")

    again = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return read.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias(text_col))
