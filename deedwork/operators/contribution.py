"""Bounding what one privacy unit contributes, and making noisy count tables agree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedwork.functions.crypto import hmac_sha256, text_bytes

NO_UNIT = "none"


def netstrings(*values: Column) -> Column:
    """The values as one text that reads only one way: ``5:hello`` for each, ``-`` for NULL."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def unit_key(columns: Sequence[str]) -> Column:
    """The unit as text. Rows with a NULL in their key share one unit, whose text no key has."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(known, netstrings(*map(F.col, columns))).otherwise(NO_UNIT)


def drawn(seed: bytes, label: str, unit: Column, content: Column) -> Column:
    """A keyed hash to choose by: without the seed nobody can tell which rows of a unit stay."""
    return hmac_sha256(text_bytes(netstrings(F.lit(label), unit, content)), seed)


def _checked(most: int) -> None:
    if most < 1:
        raise ValueError("a unit must be allowed at least one row")


def bound_rows(
    df: DataFrame, unit: Sequence[str], content: Sequence[str], *, seed: bytes, most: int, label: str = "bound"
) -> DataFrame:
    """At most ``most`` rows of each unit, those whose keyed hash is least.

    The hash reads only the unit and the row's content, never its position. The bounded rank
    keeps at most ``most`` rows of a unit per task before the shuffle, so a hot unit stays small.
    """
    _checked(most)
    named = df.withColumns({"_unit": unit_key(unit), "_content": netstrings(*map(F.col, content))})
    named = named.withColumn("_drawn", drawn(seed, label, F.col("_unit"), F.col("_content")))
    order = Window.partitionBy("_unit").orderBy("_drawn", "_content")
    kept = named.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    return kept.drop("_unit", "_content", "_drawn", "_rank")


def kept_entities(
    df: DataFrame, unit: str, entity: str, *, seed: bytes, most: int, label: str = "bound"
) -> DataFrame:
    """``unit, entity`` kept whole: in the order of their hashes, each that still fits in the unit's room.

    An entity too large for the room is passed over and a later, smaller one may still fit. Of
    equally large entities only the first ``most // size`` can ever be kept, as room
    only shrinks; the rest are dropped before anything is gathered. What is gathered per unit is
    then at most the sum of ``most / size`` over sizes, a bound that does not depend on the data.
    """
    _checked(most)
    sizes = df.groupBy(unit, entity).agg(F.count("*").alias("size")).where(F.col("size") <= most)
    placed = sizes.withColumn("drawn", drawn(seed, label, unit_key([unit]), netstrings(F.col(entity))))
    alike = Window.partitionBy(unit, "size").orderBy("drawn")
    possible = placed.withColumn("nth", F.row_number().over(alike)).where((F.col("nth") <= most) & (F.col("nth") * F.col("size") <= most))
    queue = F.array_sort(F.collect_list(F.struct("drawn", "size", F.col(entity).alias("key"))))
    key_type = df.schema[entity].dataType.simpleString()
    start = F.struct(F.lit(most).cast("bigint").alias("room"), F.array().cast(f"array<{key_type}>").alias("kept"))

    def take(state: Column, m: Column) -> Column:
        fits = m["size"] <= state["room"]
        return F.struct(
            F.when(fits, state["room"] - m["size"]).otherwise(state["room"]).alias("room"),
            F.when(fits, F.concat(state["kept"], F.array(m["key"]))).otherwise(state["kept"]).alias("kept"),
        )

    filled = possible.groupBy(unit).agg(F.aggregate(queue, start, take, lambda s: s["kept"]).alias("kept"))
    return filled.select(unit, F.explode("kept").alias(entity))


def bound_entities(
    df: DataFrame, unit: str, entity: str, *, seed: bytes, most: int, label: str = "bound"
) -> DataFrame:
    """The rows of :func:`kept_entities`. Rows without an entity are entities of their own.

    Those compete with the whole entities for the unit's room. Alike ones are numbered, at most
    ``most`` of them can fit, and each is named by its content and number where others have a key.
    """
    others = [c for c in df.columns if c not in (unit, entity)]
    content = F.sha2(text_bytes(netstrings(F.col(unit), *map(F.col, others))), 256)
    keyed = df.where(F.col(entity).isNotNull()).withColumn("_entity", netstrings(F.col(entity)))
    alike = Window.partitionBy(unit, "_content").orderBy("_content")
    single = df.where(F.col(entity).isNull()).withColumn("_content", content)
    single = single.withColumn("_copy", F.row_number().over(alike)).where(F.col("_copy") <= most)
    single = single.withColumn("_entity", netstrings(F.col(entity), F.col("_content"), F.col("_copy"))).drop("_content", "_copy")
    rows = keyed.unionByName(single)
    kept = kept_entities(rows.select(unit, "_entity"), unit, "_entity", seed=seed, most=most, label=label)
    kept = kept.select(F.col(unit).alias("_u"), F.col("_entity").alias("_e"))
    same = F.col(unit).eqNullSafe(F.col("_u")) & (F.col("_entity") == F.col("_e"))
    return rows.join(kept, same, "left_semi").drop("_entity")


def follow_rows(
    parents: DataFrame, parent_key: str, children: DataFrame, child_key: str, content: Sequence[str], *, seed: bytes, most: int, label: str
) -> DataFrame:
    """The children of kept parents, each parent keeping at most ``most`` of them."""
    reached = children.join(
        parents.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_semi"
    )
    return bound_rows(reached, [child_key], content, seed=seed, most=most, label=label)


def sensitivity_squared(c: Column, k: Column) -> Column:
    """Squared L2 sensitivity of a count table when a unit has ``c`` rows, ``k`` at most in a cell."""
    whole, rest = F.floor(c / k).cast("bigint"), c % k
    return F.greatest(whole * k * k + rest * rest, F.lit(2))


@dataclass(frozen=True)
class NoisyTable:
    """Cells complete on their public spine, with a ``value``; the levels of each column; the noise's variance."""

    cells: DataFrame
    levels: dict[str, int]
    variance: float

    def beneath(self, shared: frozenset[str]) -> int:
        """How many cells lie under one cell of the shared columns."""
        return prod(n for c, n in self.levels.items() if c not in shared)

    def weight(self, shared: frozenset[str]) -> float:
        return 1.0 / (self.beneath(shared) * self.variance)


def _level(tables: dict[str, NoisyTable], shared: frozenset[str]) -> dict[str, NoisyTable]:
    """The tables with equal sums over ``shared``: each moves to the mean weighted by precision."""
    whole = sum(t.weight(shared) for t in tables.values())
    keys = sorted(shared)
    own = {name: t.cells.groupBy(*keys).agg(F.sum("value").alias("own")) for name, t in tables.items()}
    voices = [own[name].select(*keys, (F.col("own") * t.weight(shared) / whole).alias("share")) for name, t in tables.items()]
    agreed = reduce(DataFrame.unionByName, voices).groupBy(*keys).agg(F.sum("share").alias("agreed"))
    out = {}
    for name, t in tables.items():
        if keys:
            step = (F.col("agreed") - F.col("own")) / t.beneath(shared)
            moved = t.cells.join(own[name].join(agreed, keys).select(*keys, step.alias("step")), keys)
        else:
            moved = t.cells.withColumn("step", (agreed.scalar() - own[name].scalar()) / t.beneath(shared))
        out[name] = replace(t, cells=moved.withColumn("value", F.col("value") + F.col("step")).select(*t.cells.columns))
    return out


def agreeing(tables: dict[str, NoisyTable]) -> dict[str, NoisyTable]:
    """Noisy count tables moved so that they agree on all columns they share.

    Column sets are levelled from the grand total up. What is moved is spread evenly over the
    cells beneath, so a level that agrees still does after the finer ones.
    """
    reached = {frozenset()}
    for t in tables.values():
        mine = frozenset(t.levels)
        reached |= {mine} | {mine & other for other in reached}
    for shared in sorted(reached, key=lambda columns: (len(columns), sorted(columns))):
        meeting = {name: t for name, t in tables.items() if shared <= t.levels.keys()}
        if len(meeting) > 1:
            tables = tables | _level(meeting, shared)
    return tables
