"""Joins along declared links: plain, as of a date, by entity, and by interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedwork.session import materialized
from deedwork.specs import Link
from deedwork.specs import Window as Validity


def link_join(child: DataFrame, parent: DataFrame, link: Link, columns: dict[str, str]) -> DataFrame:
    """``child`` with the linked parent's columns (``{parent column: new name}``), NULL if none."""
    wanted = parent.select(
        *[F.col(c).alias(f"_to{i}") for i, c in enumerate(link.to_columns)],
        *[F.col(c).alias(name) for c, name in columns.items()],
    )
    on = [F.col(c) == F.col(f"_to{i}") for i, c in enumerate(link.from_columns)]
    test = on[0]
    for each in on[1:]:
        test = test & each
    return child.join(wanted, test, link.how).drop(*[f"_to{i}" for i in range(len(link.to_columns))])


def repeated_link_keys(parent: DataFrame, link: Link) -> DataFrame:
    """The link keys more than one parent row holds: a join through them would fan out."""
    known = parent.dropna(subset=list(link.to_columns))
    return known.groupBy(*link.to_columns).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique(parent: DataFrame, link: Link) -> None:
    """Refuse a many-to-one link whose target key repeats."""
    if not repeated_link_keys(parent, link).isEmpty():
        raise ValueError(f"link {link.name}: {list(link.to_columns)} repeats in the parent table")


def one_row_per_entity(versions: DataFrame, key: Sequence[str], stable: Sequence[str]) -> DataFrame:
    """The stable columns of a versioned table, one row per entity.

    A stable column has one value per entity, so any value will do; ``min`` pre-aggregates.
    """
    return versions.groupBy(*key).agg(*[F.min(c).alias(c) for c in stable])


def live_versions(versions: DataFrame, window: Validity) -> DataFrame:
    """Versions that can be valid on some date: open ones, and those whose interval holds a date."""
    if window.end is None:
        return versions.where(F.col(window.start).isNotNull())
    start, end = F.col(window.start), F.col(window.end)
    nonempty = start <= end if window.closed else start < end
    return versions.where(start.isNotNull() & (_is_open(window) | nonempty))


def _is_open(window: Validity) -> Column:
    end = F.col(window.end)
    return end.isNull() if window.open_end is None else F.coalesce(end == F.lit(window.open_end), F.lit(False))


def as_of_join(
    facts: DataFrame,
    versions: DataFrame,
    *,
    fact_key: Sequence[str],
    version_key: Sequence[str],
    fact_date: str,
    window: Validity,
    attributes: Sequence[str],
    slice_unit: str = "month",
) -> DataFrame:
    """``facts`` with the attributes of the one version of their entity valid on ``fact_date``.

    That is the version that starts last on or before the date, if it is the only one with that
    start and its end is not yet reached. Every fact comes back once, with NULLs when none is.

    Neither facts nor attributes are ordered. Only the distinct (entity, date) of the facts and the distinct (entity, start) of the versions
    are: each date takes the latest start up to it, and the one version with that start is then looked up by equality. However many
    facts an entity has, it has no more rows in the order than dates, and these are cut by calendar slice: each
    (entity, slice) opens with the latest start before it.
    """
    keys = [f"_k{i}" for i in range(len(fact_key))]
    held = live_versions(versions, window)
    end = F.col(window.end) if window.end else F.lit(None).cast(held.schema[window.start].dataType)
    open_ = _is_open(window) if window.end else F.lit(True)
    held = held.select(
        *[F.col(c).alias(k) for c, k in zip(version_key, keys)],
        F.col(window.start).alias("_start"),
        end.alias("_end"),
        open_.alias("_open"),
        *[F.col(a).alias(f"_a{i}") for i, a in enumerate(attributes)],
    )
    by_start = held.groupBy(*keys, "_start").agg(F.count(F.lit(1)).alias("_n"))
    only = held.join(by_start.where("_n = 1").drop("_n"), [*keys, "_start"], "left_semi")

    asked = facts.select(*[F.col(c).alias(k) for c, k in zip(fact_key, keys)], F.col(fact_date).alias("_t"))
    asked = asked.dropna(subset=[*keys, "_t"]).distinct()
    nothing = F.lit(None).cast(held.schema["_start"].dataType).alias("_start")
    both = asked.select(*keys, "_t", nothing).unionByName(by_start.select(*keys, F.col("_start").alias("_t"), "_start"))
    both = both.withColumn("_slice", F.date_trunc(slice_unit, F.col("_t")))
    # What each (entity, slice) opens with: the latest start of an earlier slice.
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = both.groupBy(*keys, "_slice").agg(F.max("_start").alias("_latest")).select(*keys, "_slice", F.max("_latest").over(before).alias("_opening"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = both.select(*keys, "_t", "_slice", "_start", F.max("_start").over(inside).alias("_inside")).where("_start IS NULL")
    reached = reached.join(opening, [*keys, "_slice"]).select(*keys, "_t", F.coalesce("_inside", "_opening").alias("_start"))

    alive = F.col("_open") | (F.col("_t") <= F.col("_end") if window.closed else F.col("_t") < F.col("_end"))
    valid = reached.join(only, [*keys, "_start"]).where(alive)
    valid = valid.select(*keys, "_t", *[F.col(f"_a{i}") for i in range(len(attributes))])
    on = F.col(fact_date) == F.col("_t")
    for c, k in zip(fact_key, keys):
        on = on & (F.col(c) == F.col(k))
    rows = facts.select("*").join(valid, on, "left")
    return rows.select(*facts.columns, *[F.col(f"_a{i}").alias(a) for i, a in enumerate(attributes)])


def _tick(c: Column, unit: str) -> Column:
    """The number of the calendar unit that a date or time lies in."""
    if unit in ("month", "quarter", "year"):
        months = F.year(c).cast("bigint") * 12 + F.month(c) - 1
        return F.floor(months / {"month": 1, "quarter": 3, "year": 12}[unit])
    seconds = {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit]
    return F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz")) / seconds)


def _cover(first: Column, last: Column, levels: int) -> Column:
    """The aligned blocks (level, number) of 2^level units that make up [first, last], at most two a level; none if it is empty.

    From the smallest blocks up: an odd first and an even last one have no larger block that stays inside.
    """
    start = F.struct(first.alias("a"), last.alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def step(s: Column, level: Column) -> Column:
        def block(at: Column, taken: Column) -> Column:
            one = F.array(F.struct(level.cast("int").alias("level"), at.alias("block")))
            return F.when(taken, one).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))

        left = (s["a"] <= s["b"]) & (s["a"] % 2 == 1)
        right = (s["a"] <= s["b"]) & (s["b"] % 2 == 0) & ~(left & (s["a"] == s["b"]))
        a = F.floor((s["a"] + left.cast("bigint")) / 2)
        b = F.floor((s["b"] - right.cast("bigint")) / 2)
        return F.struct(
            F.when(s["a"] <= s["b"], a).otherwise(s["a"]).alias("a"),
            F.when(s["a"] <= s["b"], b).otherwise(s["b"]).alias("b"),
            F.concat(s["out"], block(s["a"], left), block(s["b"], right)).alias("out"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda s: s["out"])


def interval_cover(intervals: DataFrame, low: str, high: str, unit: str, span: tuple) -> DataFrame:
    """``intervals`` listed under the aligned blocks of units that cover them, ``_level`` and ``_block``, as far as ``span`` (its first and last date) goes.

    At most two blocks a level, so a long interval at a fine unit is a few dozen rows. A NULL end is open.
    """
    ends = intervals.sparkSession.range(1).select(*(_tick(F.lit(x), unit).alias(n) for x, n in zip(span, "ab"))).first()
    units = ends["b"] - ends["a"]
    first = F.greatest(F.coalesce(_tick(F.col(low), unit) - ends["a"], F.lit(0)), F.lit(0)).cast("bigint")
    last = F.least(F.coalesce(_tick(F.col(high), unit) - ends["a"], F.lit(units)), F.lit(units)).cast("bigint")
    cover = _cover(first, last, max(1, units.bit_length()))
    return intervals.withColumn("_c", F.explode(cover)).select(*intervals.columns, F.col("_c.level").alias("_level"), F.col("_c.block").alias("_block"))


def interval_join(
    points: DataFrame, intervals: DataFrame, *, point: str, low: str, high: str, unit: str, extra: Column | None = None
) -> DataFrame:
    """Points with the half-open date intervals that hold them (plus any ``extra`` predicate).

    A range condition alone would compare every point with every interval. Calendar units are paired up into blocks of 2, 4, 8, ... units; an interval is listed
    under the few blocks that make it up, and a point asks for the one block of each level in use that it lies in: equality on (level, block), each pair met once.
    A NULL end is open; an interval that ends before it starts holds nothing, and neither does a NULL point lie in any.
    """
    span = points.agg(F.min(point).alias("a"), F.max(point).alias("b")).first()
    if span["a"] is None:
        return points.join(intervals, F.lit(False))
    listed = materialized(interval_cover(intervals, low, high, unit, (span["a"], span["b"])), "interval-cover")
    levels = sorted(r[0] for r in listed.select("_level").distinct().collect())  # at most 63
    place = _tick(F.col(point), unit) - _tick(F.lit(span["a"]), unit)
    asked = F.array(*(F.struct(F.lit(j).alias("l"), F.shiftright(place.cast("bigint"), j).alias("b")) for j in levels)) if levels else F.array().cast("array<struct<l:int,b:bigint>>")
    each = points.select("*", F.explode(asked).alias("_ask"))
    test = (F.col("_ask.l") == F.col("_level")) & (F.col("_ask.b") == F.col("_block"))
    test = test & F.coalesce(F.col(point) >= F.col(low), F.lit(True)) & F.coalesce(F.col(point) < F.col(high), F.lit(True))
    if extra is not None:
        test = test & extra
    return each.join(listed, test).drop("_ask", "_level", "_block")


def orphans(child: DataFrame, parent: DataFrame, column: str, to: str) -> DataFrame:
    """``values`` and ``rows`` of the child whose non-null value no parent row holds.

    The child is counted per value first, so a frequent value is one row in the join.
    """
    held = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    targets = parent.select(F.col(to).alias("_v"))
    return held.join(targets, "_v", "left_anti").agg(
        F.count("*").alias("values"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")
    )
