"""Disclosure control over statistic tables: what is published, rounded or withheld.

Status codes: F free, A small count, C withheld, O dominated by one, T by two, M another
concentration, D withheld because others are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb, prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deedwork.operators.profile import GRID_BITS, on_grid
from deedwork.operators.windows import beside_group
from deedwork.session import materialized

FREE, SMALL, WITHHELD, BY_ONE, BY_TWO, CONCENTRATED, SECONDARY = "F", "A", "C", "O", "T", "M", "D"


@dataclass(frozen=True)
class DisclosureRule:
    # The default thresholds.
    minimum_cell: int = 10
    zeros_disclosive: bool = True
    rounding_base: int = 5
    dominance_n: int = 2
    dominance_k: str = "0.90"
    p_ratio: str = "0.10"


DEFAULT = DisclosureRule()


def rounded(count: Column, rule: DisclosureRule = DEFAULT) -> Column:
    """The count at the nearest multiple of the base; a tie goes to the even multiple."""
    base = F.lit(rule.rounding_base).cast("bigint")
    low, rest = F.floor(count / base).cast("bigint"), count % base
    up = (rest * 2 > base) | ((rest * 2 == base) & (low % 2 == 1))
    return (low + up.cast("bigint")) * base


def count_status(count: Column, rule: DisclosureRule = DEFAULT) -> Column:
    """A below the threshold, for zero too when zeros are disclosive, or if it rounds to zero."""
    small = (count >= 1) & (count < rule.minimum_cell)
    zero = (count == 0) & F.lit(rule.zeros_disclosive)
    vanishes = (count > 0) & (rounded(count, rule) == 0)
    return F.when(small | zero | vanishes, SMALL).otherwise(FREE)


def published_count(count: Column, rule: DisclosureRule = DEFAULT) -> Column:
    return F.when(count_status(count, rule) == FREE, rounded(count, rule))


def band(count: Column, rule: DisclosureRule = DEFAULT) -> tuple[Column, Column]:
    """The smallest and largest count that would publish the same value, or the same status."""
    base = rule.rounding_base
    value = rounded(count, rule)
    half = base // 2
    even = (value / base).cast("bigint") % 2 == 0
    tie_down = F.lit(half) if base % 2 else F.when(even, half).otherwise(half - 1)
    free = count_status(count, rule) == FREE
    zero = count == 0
    low = F.greatest(value - tie_down, F.lit(rule.minimum_cell))
    withheld_low = 0 if rule.zeros_disclosive else 1
    return (
        F.when(free & zero, 0).when(free, low).otherwise(withheld_low).cast("bigint"),
        F.when(free & zero, 0).when(free, value + tie_down).otherwise(rule.minimum_cell - 1).cast("bigint"),
    )


def with_count_status(cells: DataFrame, count: str, rule: DisclosureRule = DEFAULT) -> DataFrame:
    c = F.col(count)
    low, high = band(c, rule)
    return cells.withColumns(
        {
            "status": count_status(c, rule),
            "published": published_count(c, rule),
            "band_low": low,
            "band_high": high,
        }
    )


def _beside(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``right``'s columns beside every group of ``left``; a NULL group is a group."""
    named = right.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)})
    test = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)])
    return left.join(named, test, "left").drop(*[f"_g{i}" for i in range(len(groups))])


def _contributions(df: DataFrame, groups: Sequence[str], value: str, top: int) -> DataFrame:
    """Per group: contributors, distinct values, total size, and the largest sizes ``t1..top``.

    Records are first counted per value, so neither a hot group nor a hot value is ever whole in
    one task, and the bounded rank lets every task keep only its own ``top`` largest. A group without a known
    value is there too, with nothing in it: that it were missing would tell as much.
    """
    wide = "decimal(38,4)"
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("decimal(28,4)").alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_size", F.abs("_v"))
    )
    n = F.col("_n").cast("decimal(19,0)")
    totals = counts.groupBy(*groups).agg(
        F.sum("_n").alias("records"),
        F.coalesce(F.sum(F.when(F.col("_v") != 0, F.col("_n"))), F.lit(0)).alias("contributors"),
        F.count("*").alias("values"),
        F.max("_size").alias("largest"),
        F.sum((F.col("_size") * n).cast(wide)).cast(wide).alias("total"),
        F.sum((F.col("_v") * n).cast(wide)).cast(wide).alias("sum"),
    )
    copies = counts.select(*groups, F.explode(F.array_repeat("_size", F.least(F.col("_n"), F.lit(top)).cast("int"))).alias("_size"))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("_size")))
    first = (
        copies.withColumn("_rank", rank)
        .where(F.col("_rank") <= top)
        .groupBy(*groups)
        .agg(*[F.sum(F.when(F.col("_rank") <= i, F.col("_size"))).cast(wide).alias(f"t{i}") for i in range(1, top + 1)])
    )
    every = _beside(df.select(*groups).distinct(), _beside(totals, first, groups), groups)
    return every.fillna(0, ["records", "contributors", "values", "largest", "total", *[f"t{i}" for i in range(1, top + 1)]])


def _dominance(rule: DisclosureRule) -> Column:
    """Status by concentration, from the columns of :func:`_contributions`."""
    k, p = F.lit(rule.dominance_k).cast("decimal(4,2)"), F.lit(rule.p_ratio).cast("decimal(4,2)")
    total = F.col("total").cast("decimal(30,4)")
    share = total * k

    def top(i: int) -> Column:
        return F.col(f"t{i}").cast("decimal(30,4)")

    status = F.when(total == 0, FREE).when(top(1) >= share, BY_ONE)
    if rule.dominance_n >= 2:
        status = status.when(top(2) >= share, BY_TWO)
    if rule.dominance_n >= 3:
        status = status.when(top(rule.dominance_n) >= share, CONCENTRATED)
    return status.when(total - top(2) < top(1) * p, CONCENTRATED).otherwise(FREE)


def dominance(df: DataFrame, groups: Sequence[str], value: str, rule: DisclosureRule = DEFAULT) -> DataFrame:
    """Per group, whether one or two contributions make up too much of its total size."""
    return _contributions(df, groups, value, max(2, rule.dominance_n)).select(*groups, "records", _dominance(rule).alias("status"))


def _sum_status(rule: DisclosureRule) -> Column:
    few = count_status(F.col("contributors"), rule)
    two_values = (F.col("values") <= 2) & (F.col("largest") != 0)
    return F.when(few != FREE, few).when(two_values, WITHHELD).otherwise(_dominance(rule))


def sum_and_mean(df: DataFrame, groups: Sequence[str], value: str, rule: DisclosureRule = DEFAULT, bits: int = GRID_BITS) -> DataFrame:
    """Per group: the sum's and the mean's status, and what is published of them.

    A mean on the binary grid needs a publishable count and sum, three grid values, and residues
    off the grid that would themselves publish.
    """
    top = max(2, rule.dominance_n)
    status = _contributions(df, groups, value, top).withColumn("sum_status", _sum_status(rule))
    gridded = df.where(F.col(value).isNotNull()).select(*groups, on_grid(F.col(value), bits).alias("_grid"), F.col(value).alias("_value"))
    residue = F.col("_value").cast("decimal(18,2)") * F.lit(2**bits).cast("decimal(10,0)") - F.col("_grid").cast("decimal(19,0)")
    rest = _contributions(gridded.withColumn("_r", residue), groups, "_r", top).withColumn(
        "residue_status", F.when(F.col("contributors") == 0, FREE).otherwise(_sum_status(rule))
    )
    per_point = gridded.groupBy(*groups, "_grid").agg(F.count("*").alias("_n"))
    grid = per_point.groupBy(*groups).agg(
        F.count("*").alias("points"), F.sum((F.col("_grid").cast("decimal(19,0)") * F.col("_n").cast("decimal(19,0)")).cast("decimal(38,0)")).alias("grid_total")
    )
    joined = _beside(_beside(status, rest.select(*groups, "residue_status"), groups), grid, groups)
    counted = count_status(F.col("records"), rule)
    mean = (
        F.when(counted != FREE, counted)
        .when(F.col("sum_status") != FREE, F.col("sum_status"))
        .when(F.col("points") <= 2, WITHHELD)
        .otherwise(F.col("residue_status"))
    )
    return joined.withColumn("mean_status", mean).select(
        *groups,
        published_count(F.col("records"), rule).alias("records"),
        "sum_status",
        F.when(F.col("sum_status") == FREE, F.col("sum")).alias("total"),
        "mean_status",
        F.when(F.col("mean_status") == FREE, F.col("grid_total").cast("string")).alias("grid_total"),
    )


def secondary(cells: DataFrame, statistic: Sequence[str], status: str = "status") -> DataFrame:
    """If some but not all cells of a statistic are withheld, the others are withheld as D."""
    here = beside_group(
        cells, statistic, {"_cells": F.count("*"), "_held": F.count_if(F.col(status) != FREE)}
    )
    some = (F.col("_held") > 0) & (F.col("_held") < F.col("_cells"))
    return here.withColumn(status, F.when(some & (F.col(status) == FREE), SECONDARY).otherwise(F.col(status))).drop(
        "_cells", "_held"
    )


def per_entity_guard(per_entity: DataFrame, row_level: DataFrame, cell: str) -> DataFrame:
    """A per-entity statistic is withheld whole when it hides other cells than the row-level one."""
    a = per_entity.select(cell, "n", F.col("status"))
    b = row_level.select(cell, F.col("status").alias("_row"))
    joined = a.join(b, cell, "full")
    differs = (F.coalesce("status", F.lit(SMALL)) != FREE) != (F.coalesce("_row", F.lit(SMALL)) != FREE)
    verdict = joined.agg(F.count_if(differs).alias("n"))
    return a.withColumn("status", F.when(verdict.scalar() > 0, WITHHELD).otherwise(F.col("status")))


def fact_states(df: DataFrame, facts: dict[str, tuple[Column | None, Column]]) -> DataFrame:
    """How many rows are in each combination of the facts' states: holds, fails or not_covered.

    At most 3^k rows for k facts, whatever the table holds.
    """
    states = []
    for name, (when, check) in facts.items():
        covered = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
        states.append(
            F.when(~covered, "not_covered").when(F.coalesce(check, F.lit(False)), "holds").otherwise("fails").alias(name)
        )
    return df.groupBy(*states).agg(F.count("*").alias("n"))


#: So many combinations of states at most are held against the state table.
MOST_COMBINATIONS = 1 << 22
LEVEL_KEYS = 256


def possible_states(spark: SparkSession, facts: dict[str, tuple[Column | None, Column]], domains: dict[str, tuple[str, Sequence]]) -> list[tuple[tuple[str, ...], DataFrame]]:
    """Which combinations of states the facts allow: they are looked at together on every combination of the values in ``domains``.

    ``domains`` gives for each column its type and values that stand for all it can hold, null among them where it may be. Too many combinations are refused;
    facts may then be given to ``differencing`` as groups of their own, looked at one by one.
    """
    if prod(len(values) for _, values in domains.values()) > MOST_COMBINATIONS:
        raise ValueError(f"more than {MOST_COMBINATIONS} combinations of values")
    grid = spark.range(1)
    for name, (kind, values) in domains.items():
        grid = grid.withColumn(name, F.explode(F.array(*(F.lit(v).cast(kind) for v in values))))
    return [(tuple(facts), fact_states(grid, facts).drop("n"))]


def free_states(spark: SparkSession, facts: dict[str, tuple[Column | None, Column]]) -> list[tuple[tuple[str, ...], DataFrame]]:
    """Facts that allow every combination: each can hold or fail, and not cover a row if it has a condition."""
    out = []
    for name, (when, _) in facts.items():
        states = ["holds", "fails"] + ["not_covered"] * (when is not None)
        out.append(((name,), spark.createDataFrame([(s,) for s in states], f"`{name}` string")))
    return out


def _combinations(possible: Sequence[tuple[tuple[str, ...], DataFrame]], shown: Sequence[str]) -> DataFrame | None:
    """Every combination of ``shown`` that the groups of facts allow: the lists of the groups, one exploded after the other."""
    out, size = None, 1
    for names, allowed in possible:
        keep = [n for n in names if n in shown]
        if not keep:
            continue
        states = [tuple(r) for r in allowed.select(*keep).distinct().limit(MOST_COMBINATIONS // size + 1).collect()]
        size *= len(states)
        if size > MOST_COMBINATIONS:
            raise ValueError(f"more than {MOST_COMBINATIONS} combinations of states")
        if out is None:
            out = allowed.select(*keep).distinct()
        else:
            rows = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(keep, row, strict=True))) for row in states))
            out = out.select("*", F.explode(rows).alias("_s")).select("*", *(F.col(f"_s.{n}").alias(n) for n in keep)).drop("_s")
    return out.select(*shown) if out is not None else None


def _differences(targets: DataFrame, cells: DataFrame, shown: Sequence[str], held: int) -> set[str]:
    """The facts in which the combinations of ``targets`` differ from the nearest ones that rows are in.

    The lattice is climbed by the number of facts that are left out, ``LEVEL_KEYS`` ways to leave some out at a time. Two combinations agree there if they have one
    key, so they are counted by key and no pair is formed; only those that no fewer facts tell apart are looked at further up. ``held``: how often a target is among
    ``cells`` itself.
    """
    found: set[str] = set()

    def keys(rows: DataFrame, ways: Sequence[tuple[str, ...]]) -> DataFrame:
        each = (f"struct({k} as way, array({', '.join(repr('') if n in out else f'`{n}`' for n in shown)}) as key)" for k, out in enumerate(ways))
        return rows.selectExpr(*(f"`{n}`" for n in shown), f"explode(array({', '.join(each)})) as _e").select(*shown, "_e.way", "_e.key")

    size = 0
    while size < len(shown):
        ways: list[tuple[str, ...]] = []
        while size < len(shown) and (not ways or len(ways) + comb(len(shown), size + 1) <= LEVEL_KEYS):
            size += 1
            ways += combinations(shown, size)
        sizes = F.expr(f"array({', '.join(str(len(w)) for w in ways)})")
        beside = keys(cells, ways).groupBy("way", "key").agg(F.count("*").alias("cells")).where(F.col("cells") > held)
        near = keys(targets, ways).join(beside.select("way", "key"), ["way", "key"]).withColumn("size", F.get(sizes, F.col("way")))
        near = near.groupBy(*shown).agg(F.min("size").alias("least"), F.collect_list(F.struct("size", "way")).alias("near"))
        nearest = near.select(*shown, F.expr("transform(filter(near, x -> x.size = least), x -> x.way)").alias("ways"))
        for row in nearest.select(F.explode("ways").alias("way")).distinct().collect():
            found.update(ways[row["way"]])
        if size < len(shown):
            targets = materialized(targets.join(nearest.select(*shown), list(shown), "left_anti"), "far-cells")
            if targets.isEmpty():
                break
    return found


def differencing(
    states: DataFrame,
    facts: Sequence[str],
    rule: DisclosureRule = DEFAULT,
    possible: Sequence[tuple[tuple[str, ...], DataFrame]] = (),
) -> DataFrame:
    """``fact, round, status``: which of the published facts must be withheld so that no combination of their states shows few records.

    ``states`` (``fact_states``) has the records of each combination. The counts of facts, their unions and their crossings are sums over combinations, so
    sums and differences of them may show any single one. A combination with fewer records than the threshold is hidden by withholding the facts in which it
    differs from the nearest ones with records: it then merges with these. With fewer facts there are other combinations, so this is repeated until none is
    small. Only then, where zeros are disclosive, combinations in ``possible`` (groups of facts with the states they allow together) that no record is in are
    treated alike. A fact that is not in ``facts`` is not published and merged from the start. What is withheld does not depend on the order of the facts.
    """
    shown, withheld, turn = list(facts), {}, 0
    states = materialized(states.select(*facts, "n"), "fact-states")
    while shown:
        cells = states.groupBy(*shown).agg(F.sum("n").alias("n"))
        small = cells.where((F.col("n") > 0) & (F.col("n") < rule.minimum_cell)).select(*shown)
        filled = cells.where("n > 0").select(*shown)
        gone = _differences(small, filled, shown, 1)
        if not gone and rule.zeros_disclosive and (every := _combinations(possible, shown)) is not None:
            gone = _differences(every.join(filled, shown, "left_anti"), filled, shown, 0)
        if not gone:
            break
        turn += 1
        withheld |= dict.fromkeys(gone, turn)
        shown = [n for n in shown if n not in gone]
    rows = [(n, withheld.get(n), WITHHELD if n in withheld else FREE) for n in facts]
    return states.sparkSession.createDataFrame(rows, "fact string, round int, status string")
