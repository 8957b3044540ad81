"""Exact integer noise on the cells of count tables.

Only finished cells reach Python, in Arrow batches, and their number is the public spine's. Each
cell draws from a stream of its own, keyed by the seed, the table's label and the cell, so a lost
task that runs again draws the same noise. The sampler is the discrete Gaussian of Canonne, Kamath
and Steinke (2020): whole numbers only, no floating point.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator, Sequence
from fractions import Fraction
from math import floor, isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATTICE_STEPS = 2**20
VALUE_PLACES = 12


class Stream:
    """Uniform whole numbers from HMAC-SHA256 over a counter."""

    def __init__(self, seed: bytes, label: str):
        self._mac = hmac.new(seed, label.encode() + b"\0", hashlib.sha256)
        self._count = 0
        self._pool = 0
        self._bits = 0

    def below(self, n: int) -> int:
        width = (n - 1).bit_length()
        while True:
            while self._bits < width:
                block = self._mac.copy()
                block.update(self._count.to_bytes(8, "big"))
                self._count += 1
                self._pool = (self._pool << 256) | int.from_bytes(block.digest(), "big")
                self._bits += 256
            self._bits -= width
            drawn = self._pool >> self._bits
            self._pool &= (1 << self._bits) - 1
            if drawn < n:
                return drawn


def _happens(top: int, bottom: int, draw: Stream) -> bool:
    """True with probability exp(-top/bottom)."""
    while top > bottom:
        if not _happens(1, 1, draw):
            return False
        top -= bottom
    tries = 1
    while draw.below(bottom * tries) < top:
        tries += 1
    return tries % 2 == 1


def _laplace(scale: int, draw: Stream) -> int:
    while True:
        rest = draw.below(scale)
        if not _happens(rest, scale, draw):
            continue
        size = rest
        while _happens(1, 1, draw):
            size += scale
        if draw.below(2) == 0:
            return size
        if size:
            return -size


def discrete_gaussian(variance: Fraction, draw: Stream) -> int:
    """A whole number with probability proportional to exp(-x² / (2·variance))."""
    a, b = variance.numerator, variance.denominator
    scale = isqrt(a // b) + 1
    while True:
        x = _laplace(scale, draw)
        if _happens((abs(x) * b * scale - a) ** 2, 2 * a * b * scale * scale, draw):
            return x


def cell_label(label: str, cell: Sequence) -> str:
    """The name of a cell's stream. As JSON it reads only one way, and NULL is not the text of it."""
    return json.dumps([label, *[None if pd.isna(v) else str(v) for v in cell]])


def noisy_counts(cells: DataFrame, keys: Sequence[str], count: str, *, variance: Fraction, seed: bytes, label: str) -> DataFrame:
    """``keys`` and ``noisy``: every cell's count plus noise. ``cells`` is complete on its spine.

    Nothing is dropped or cut at zero: whether a cell is shown never depends on the data.
    """
    keys = list(keys)
    schema = T.StructType([*[cells.schema[k] for k in keys], T.StructField("noisy", T.LongType())])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            noise = [
                discrete_gaussian(variance, Stream(seed, cell_label(label, row)))
                for row in batch[keys].itertuples(index=False)
            ]
            yield batch[keys].assign(noisy=batch[count].astype("int64") + pd.Series(noise, index=batch.index, dtype="int64"))

    return cells.select(*keys, F.col(count).cast("bigint").alias(count)).mapInPandas(add, schema)


def lattice_point(value: Fraction, delta: Fraction) -> int:
    """``value`` on the lattice of 2^20 steps per sensitivity, rounded half up."""
    return floor(value / (delta / LATTICE_STEPS) + Fraction(1, 2))


def noisy_value(value: Fraction, delta: Fraction, scale: Fraction, draw: Stream) -> str:
    """The released value as decimal text: lattice point plus whole-number noise, times the step."""
    step = delta / LATTICE_STEPS
    noisy = step * (lattice_point(value, delta) + discrete_gaussian((scale / step) ** 2, draw))
    units = floor(noisy * 10**VALUE_PLACES + Fraction(1, 2))
    sign, digits = ("-" if units < 0 else ""), str(abs(units)).rjust(VALUE_PLACES + 1, "0")
    return f"{sign}{digits[:-VALUE_PLACES]}.{digits[-VALUE_PLACES:]}"


KENDALL, SPEARMAN = "kendall", "spearman"


def rank_value(kind: str, top: int, records: int) -> Fraction:
    """Kendall's ``s`` over the number of pairs, or Spearman's ``a4`` over its largest value, a third of n³ - n."""
    return Fraction(top, records * (records - 1) // 2) if kind == KENDALL else Fraction(3 * top, records**3 - records)


def rank_sensitivity(kind: str, per_unit: int, floor_rows: int) -> Fraction:
    """How far a unit of at most m = ``per_unit`` rows moves the value, with no fewer than N = ``floor_rows`` rows beside or without it.

    Kendall: 4m / N. Spearman: ``a4`` is the sum of sgn(x_i - x_j) · sgn(y_i - y_k) over all triples of rows, as twice a centred mid-rank is a sum of signs; of n rows at
    most 3mn² triples hold one of the unit's. Three times that over n³ - n is 9mn / (n² - 1). The largest value itself shrinks by as many triples, for 3mn / (n² - 1)
    more of a value of at most 1. Both fall with n, so 12mN / (N² - 1).
    """
    if kind == KENDALL:
        return Fraction(4 * per_unit, floor_rows)
    return Fraction(12 * per_unit * floor_rows, floor_rows**2 - 1)


def lattice_points(stats: DataFrame, top: str, kind: str, *, per_unit: int, floor_rows: int) -> DataFrame:
    """``stats`` (one row with ``records`` and ``top``) with ``point``, the exact place of the value on the lattice, as text."""
    delta = rank_sensitivity(kind, per_unit, floor_rows)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = [lattice_point(rank_value(kind, int(s), int(n)), delta) for n, s in zip(batch["records"], batch[top])]
            yield batch.assign(point=[str(p) for p in points])

    return stats.mapInPandas(add, T.StructType([*stats.schema.fields, T.StructField("point", T.StringType())]))


def noisy_rank(
    stats: DataFrame, top: str, *, per_unit: int, floor_rows: int, scale: Fraction, seed: bytes, label: str, kind: str = KENDALL
) -> DataFrame:
    """A rank correlation released with noise. ``stats``: one row with ``records`` and ``top``.

    The noise covers what a unit of at most ``per_unit`` rows can move the value by (``rank_sensitivity``) over the public ``floor_rows``; with fewer rows
    the job fails, since it would not.
    """
    delta = rank_sensitivity(kind, per_unit, floor_rows)

    def release(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n, s in zip(batch["records"], batch[top]):
                if n < floor_rows:
                    raise ValueError(f"{label}: fewer rows than the public floor of {floor_rows}")
                out.append(noisy_value(rank_value(kind, int(s), int(n)), delta, scale, Stream(seed, label)))
            yield pd.DataFrame({"statistic": [label] * len(out), "noisy": out})

    return stats.select("records", top).mapInPandas(release, "statistic string, noisy string")
