"""Exact statistics of tables, columns, pairs, links and histories, as long result tables.

Levels and bins come from the specification, never from the data, so a statistic has the same cells
whatever the table holds. Every statistic is an aggregation with map-side combine; orders over whole
columns go through ``slices``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedwork.functions.values import ratio
from deedwork.operators import slices
from deedwork.operators.windows import level_spine
from deedwork.session import materialized

GRID_BITS = 16
MINIMUM_CELL = 10
# Lower edges of the children-per-parent bins; the last one is open.
CHILDREN_EDGES = (0, 1, 2, 3, 5, 10, 20)


def on_grid(c: Column, bits: int = GRID_BITS, scale: int = 2) -> Column:
    """``floor(x · 2^bits)`` of a decimal with ``scale`` places, as a whole number.

    The whole part and the fraction go onto the grid on their own, so long arithmetic is enough;
    a value too large for it raises.
    """
    whole = F.floor(c)
    places = ((c - whole) * F.lit(10**scale)).cast("bigint")
    fraction = F.call_function("div", places * F.lit(2**bits), F.lit(10**scale))
    return whole.cast("bigint") * F.lit(2**bits) + fraction


# -- columns ----------------------------------------------------------------------------


def column_profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """Per column: type, rows, null rate, distinct values and the first few in text order.

    One pass turns the row into (column, value) pairs, counted per pair: a frequent value is one
    row before the shuffle.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f.name).cast("string").alias("value"))
            for f in df.schema.fields
        ]
    )
    values = (
        df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("column_name", "type", "value").agg(F.count("*").alias("n"))
    )
    totals = values.groupBy("column_name", "type").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct_count"),
    )
    order = Window.partitionBy("column_name").orderBy("value")
    first = (
        values.where("value IS NOT NULL")
        .withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= samples)
        .groupBy("column_name")
        .agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("samples"))
    )
    return totals.join(first, "column_name", "left").select(
        "column_name", "type", "rows", ratio(F.col("nulls"), F.col("rows")).alias("null_rate"), "distinct_count", "samples"
    )


def declared_level(c: str, levels: Sequence[str]) -> Column:
    """The value if it is a declared level, NULL if NULL; anything else refuses the profile."""
    refuse = F.raise_error(F.concat(F.lit(f"column {c}: not a level the contract declares: "), F.col(c)))
    return F.when(F.col(c).isNull() | F.col(c).isin(*levels), F.col(c)).otherwise(refuse.cast("string"))


def bin_of(value: Column, edges: Sequence) -> Column:
    """The lower edge of the bin that holds the value: ``[lower, upper)``, the last bin closed.

    A value outside the declared range refuses the profile.
    """
    out = F.raise_error(F.concat(F.lit("value outside the declared range: "), value.cast("string"))).cast("bigint")
    for low, high in zip(edges[:-1], edges[1:]):
        inside = (value >= low) & ((value < high) if high != edges[-1] else (value <= high))
        out = F.when(inside, F.lit(low).cast("bigint")).otherwise(out)
    return F.when(value.isNotNull(), out)


def open_bin_of(value: Column, lower_edges: Sequence[int]) -> Column:
    """The largest lower edge not above the value. Values below the first edge are in its bin."""
    out = F.lit(lower_edges[0])
    for low in lower_edges[1:]:
        out = F.when(value >= low, F.lit(low)).otherwise(out)
    return F.when(value.isNotNull(), out).cast("bigint")


def level_histogram(df: DataFrame, column: str, levels: Sequence[str], group_by: str | None = None) -> DataFrame:
    """``level, n`` for every declared level, zero counts included."""
    counts = df.groupBy(declared_level(column, levels).alias("level")).agg(F.count("*").alias("n"))
    spine = level_spine(df.sparkSession, "level", levels)
    return spine.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def bin_histogram(df: DataFrame, value: Column, edges: Sequence[int]) -> DataFrame:
    """``low, n`` for every declared bin."""
    counts = df.groupBy(bin_of(value, edges).alias("low")).agg(F.count("*").alias("n"))
    return on_edges(counts, edges[:-1])


def on_edges(counts: DataFrame, lower_edges: Sequence[int]) -> DataFrame:
    """Counts per ``low`` on the full list of lower edges."""
    spine = counts.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(e).cast("bigint") for e in lower_edges])).alias("low")
    )
    return spine.join(counts, "low", "left").select("low", F.coalesce("n", F.lit(0)).alias("n"))


def magnitudes(df: DataFrame, columns: Sequence[str], bits: int = GRID_BITS) -> DataFrame:
    """Per decimal column: count, min, max, sum, and the sum and mean on the binary grid. One pass."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.min(c).alias(f"lo{i}"),
            F.max(c).alias(f"hi{i}"),
            F.sum(c).alias(f"s{i}"),
            F.sum(on_grid(F.col(c), bits).cast("decimal(19,0)")).alias(f"g{i}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"n{i}").alias("n"),
            F.col(f"lo{i}").cast("double").alias("low"),
            F.col(f"hi{i}").cast("double").alias("high"),
            F.col(f"s{i}").cast("double").alias("total"),
            F.col(f"g{i}").cast("string").alias("grid_total"),
            ratio(F.col(f"g{i}"), F.col(f"n{i}") * 2**bits).alias("mean"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# -- dates ------------------------------------------------------------------------------


def date_span(df: DataFrame, column: str, minimum: int = MINIMUM_CELL, unit: str | None = None) -> DataFrame:
    """``unit, start, n``: month bins when the end months hold enough rows, else year bins, else none.

    ``unit`` asks for months or years only, as many as the data spans.
    """
    months = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.trunc(column, "month").alias("month"))
        .agg(F.count("*").alias("n"))
    )
    years = months.groupBy(F.trunc("month", "year").alias("year")).agg(F.sum("n").alias("n"))

    def ends(counts: DataFrame, unit: str) -> DataFrame:
        return counts.agg(
            F.min(unit).alias("first"), F.max(unit).alias("last"), F.min_by("n", unit).alias("a"), F.max_by("n", unit).alias("b")
        )

    y = ends(years, "year").select(
        F.struct(
            F.col("first").alias("first"),
            F.col("last").alias("last"),
            (F.least("a", "b") >= minimum).alias("full"),
        ).alias("y")
    )
    both = ends(months, "month").select(
        "first",
        "last",
        (F.least("a", "b") >= minimum).alias("full"),
        y.scalar().alias("y"),
    )
    allowed = {u: F.lit(unit in (None, u)) for u in ("month", "year")}
    taken = F.when(F.col("full") & allowed["month"], "month").when(F.col("y.full") & allowed["year"], "year")
    chosen = both.withColumn("unit", taken).where("unit IS NOT NULL")
    spine = chosen.select(
        "unit",
        F.explode(
            F.when(F.col("unit") == "month", F.sequence("first", "last", F.expr("interval 1 month"))).otherwise(
                F.sequence("y.first", "y.last", F.expr("interval 1 year"))
            )
        ).alias("start"),
    )
    counted = months.select(F.lit("month").alias("unit"), F.col("month").alias("start"), "n").unionByName(
        years.select(F.lit("year").alias("unit"), F.col("year").alias("start"), "n")
    )
    return spine.join(counted, ["unit", "start"], "left").select("unit", "start", F.coalesce("n", F.lit(0)).alias("n"))


def rounded_extremes(df: DataFrame, column: str, *, low: str, high: str, minimum: int = MINIMUM_CELL, days: bool = True) -> DataFrame:
    """``which, at, level``: the ends, each rounded out to the finest period that holds enough rows.

    A timestamp tries its day, month and year; a date (``days=False``) its month and year. The
    rounded end stays inside the declared range.
    """
    daily = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("date").alias("day")).agg(F.count("*").alias("n"))
    units = (["day"] if days else []) + ["month", "year"]
    ends = daily.agg(F.min("day").alias("min"), F.max("day").alias("max"))
    held = daily.select("day", "n", *[F.date_trunc(u, "day").cast("date").alias(u) for u in units if u != "day"])
    out = []
    for which in ("min", "max"):
        end = ends.select(which).scalar()
        sums = [
            F.sum(F.when(F.col(u) == F.date_trunc(u, end).cast("date"), F.col("n"))).alias(f"h_{u}") for u in units
        ]
        row = held.agg(*sums).withColumn("end", end)
        at, level = F.lit(None).cast("date"), F.lit(None).cast("string")
        for u in reversed(units):
            start = F.date_trunc(u, "end").cast("date")
            edge = start if which == "min" else F.date_sub((start + F.expr(f"interval 1 {u}")).cast("date"), 1)
            at = F.when(F.col(f"h_{u}") >= minimum, edge).otherwise(at)
            level = F.when(F.col(f"h_{u}") >= minimum, u).otherwise(level)
        bounded = F.greatest(at, F.lit(low).cast("date")) if which == "min" else F.least(at, F.lit(high).cast("date"))
        out.append(row.select(F.lit(which).alias("which"), F.when(at.isNotNull(), bounded).alias("at"), level.alias("level")))
    return out[0].unionByName(out[1])


def calendar_histograms(df: DataFrame, column: str) -> DataFrame:
    """``part, cell, n``: months, days of the week and hours of the week, all cells present."""
    ts = F.col(column)
    cells = F.array(
        F.struct(F.lit("month").alias("part"), F.month(ts).alias("cell")),
        F.struct(F.lit("day_of_week").alias("part"), (F.dayofweek(ts) - 1).alias("cell")),
        F.struct(F.lit("hour_of_week").alias("part"), ((F.dayofweek(ts) - 1) * 24 + F.hour(ts)).alias("cell")),
    )
    # Hours first: at most one row per calendar hour reaches the three-way count.
    hours = df.where(ts.isNotNull()).groupBy(F.date_trunc("hour", ts).alias(column)).agg(F.count("*").alias("n"))
    counts = hours.select(F.explode(cells).alias("c"), "n").groupBy("c.part", "c.cell").agg(F.sum("n").alias("n"))
    spine = reduce(
        lambda a, b: a.unionByName(b),
        [
            df.sparkSession.range(first, last).select(F.lit(part).alias("part"), F.col("id").cast("int").alias("cell"))
            for part, first, last in (("month", 1, 13), ("day_of_week", 0, 7), ("hour_of_week", 0, 168))
        ],
    )
    return spine.join(counts, ["part", "cell"], "left").select("part", "cell", F.coalesce("n", F.lit(0)).alias("n"))


# -- keys, pairs and links ----------------------------------------------------------------


def key_check(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that repeat, the rows that hold them, and rows with a NULL key part."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    per_key = df.groupBy(*key).agg(F.count("*").alias("n")).withColumn("null_part", null)
    known = ~F.col("null_part")
    return per_key.agg(
        F.count_if(known & (F.col("n") > 1)).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(known & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("repeated_rows"),
        F.coalesce(F.sum(F.when(F.col("null_part"), F.col("n"))), F.lit(0)).alias("null_rows"),
    )


def pair_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``first, second, a, b, n`` of every pair of the listed columns.

    The row is first counted per combination of all columns; only the combinations are spread
    over the pairs.
    """
    columns = list(columns)
    whole = df.groupBy(*[F.col(c).cast("string").alias(c) for c in columns]).agg(F.count("*").alias("n"))
    pairs = F.array(
        *[
            F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), F.col(x).alias("a"), F.col(y).alias("b"))
            for x, y in combinations(columns, 2)
        ]
    )
    return (
        whole.select(F.explode(pairs).alias("p"), "n")
        .where("p.a IS NOT NULL AND p.b IS NOT NULL")
        .groupBy("p.first", "p.second", "p.a", "p.b")
        .agg(F.sum("n").alias("n"))
    )


def pair_strength(pairs: DataFrame) -> DataFrame:
    """``first, second, strength``: the L1 distance of a pair's table to independence, 0 to 2.

    Cells no row is in count too. Their share is what the other cells leave of N², so no product
    of all levels is formed.
    """
    by = ["first", "second"]
    wide = "decimal(38,0)"
    a = pairs.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    b = pairs.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    total = pairs.groupBy(*by).agg(F.sum("n").alias("nn"))
    product = F.col("na").cast("decimal(19,0)") * F.col("nb").cast("decimal(19,0)")
    joint = F.col("n").cast("decimal(19,0)") * F.col("nn").cast("decimal(19,0)")
    cells = pairs.join(a, [*by, "a"]).join(b, [*by, "b"]).join(total, by)
    sums = cells.groupBy(*by, "nn").agg(
        F.sum(F.abs(joint - product).cast(wide)).alias("apart"), F.sum(product.cast(wide)).alias("seen")
    )
    square = F.col("nn").cast("decimal(19,0)") * F.col("nn").cast("decimal(19,0)")
    return sums.select(*by, ratio(F.col("apart") + (square - F.col("seen")), square).alias("strength"))


def children_per_parent(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str, groups: Sequence[str] = ()) -> DataFrame:
    """Parents by their number of children, on the fixed bins, zero included, by parent group.

    A child with a NULL or unknown key is no parent's; a parent with a NULL key has none.
    """
    held = children.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("_n"))
    per_parent = parents.join(held, F.col(parent_key) == F.col("_k"), "left")
    return per_parent.groupBy(
        *groups, open_bin_of(F.coalesce("_n", F.lit(0)), CHILDREN_EDGES).alias("low")
    ).agg(F.count("*").alias("n"))


def relationship_counts(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Child rows without a key, without a parent and matched, and parent keys that repeat."""
    held = children.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("_n"))
    targets = parents.where(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias("_p")).agg(F.count("*").alias("_m"))
    joined = held.join(targets, F.col("_k") == F.col("_p"), "left")
    null, found = F.col("_k").isNull(), F.col("_p").isNotNull()
    counts = joined.agg(
        F.coalesce(F.sum(F.when(null, F.col("_n"))), F.lit(0)).alias("null_key"),
        F.coalesce(F.sum(F.when(~null & ~found, F.col("_n"))), F.lit(0)).alias("orphan"),
        F.coalesce(F.sum(F.when(found, F.col("_n"))), F.lit(0)).alias("matched"),
    )
    repeated = targets.agg(F.count_if(F.col("_m") > 1).alias("n"))
    return counts.withColumn("repeated_parent_keys", repeated.scalar())


def childless(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str, class_: str) -> DataFrame:
    """Per structural class of the parent: parents, and those without a child."""
    keys = children.select(F.col(child_key).alias("_k")).where("_k IS NOT NULL").distinct()
    flagged = parents.join(keys, F.col(parent_key) == F.col("_k"), "left")
    return flagged.groupBy(class_).agg(F.count("*").alias("parents"), F.count_if(F.col("_k").isNull()).alias("childless"))


def exposure(
    parents: DataFrame, children: DataFrame, *, parent_key: str, child_key: str, start: str, end: str | None, at: str, months: Sequence[str]
) -> DataFrame:
    """Per month of the stated window: days the parents were at risk, and their children in it.

    The days of all months are sums of one pass over the parents. A child counts when its date lies
    in its parent's time at risk.
    """
    stop = F.col(end) if end else F.lit(None).cast("date")
    sums, rows = [], []
    for i, month in enumerate(months):
        first = F.lit(month).cast("date")
        after = F.add_months(first, 1)
        days = F.datediff(F.least(F.coalesce(stop, after), after), F.greatest(F.col(start), first))
        sums.append(F.sum(F.greatest(days, F.lit(0))).alias(f"d{i}"))
        rows.append(F.struct(first.alias("month"), F.coalesce(F.col(f"d{i}"), F.lit(0)).alias("parent_days")))
    at_risk = parents.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    windowed = children.where(
        (F.col(at) >= F.lit(months[0]).cast("date")) & (F.col(at) < F.add_months(F.lit(months[-1]).cast("date"), 1))
    )
    seen = windowed.join(parents, F.col(child_key) == F.col(parent_key)).where(
        (F.col(at) >= F.col(start)) & (stop.isNull() | (F.col(at) < stop))
    )
    counts = seen.groupBy(F.trunc(at, "month").alias("month")).agg(F.count("*").alias("children"))
    return at_risk.join(counts, "month", "left").select("month", "parent_days", F.coalesce("children", F.lit(0)).alias("children"))


def per_entity(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Entities by the known value each holds most often; ties go to the first in text order."""
    counts = df.dropna(subset=list(key)).where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).cast("string").alias("text")))
    modes = counts.groupBy(*key).agg(best.alias("best"))
    return modes.groupBy(F.col("best.text").alias("value")).agg(F.count("*").alias("n"))


# -- rank correlation -----------------------------------------------------------------------


def _counted_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """``x, y, n``: the records collapsed once, for all the passes that follow."""
    known = df.dropna(subset=[x, y]).groupBy(F.col(x).alias("x"), F.col(y).alias("y"))
    return materialized(known.agg(F.count("*").alias("n")), f"pairs-{x}-{y}")


def kendall_s(df: DataFrame, x: str, y: str) -> DataFrame:
    """``records`` and ``s``: the sum of sign·sign over all pairs of records, without forming pairs.

    Records collapse to counted (x, y) cells. The distinct x get an index, and a pair of different
    x splits at exactly one bit of it: in the node of the higher bits, one record lies left and the
    other right. Per node a running count over y gives each right record the left ones below and
    above it. The work is cells times bits of the index; swap the columns so x has fewer values.
    """
    cells = _counted_pairs(df, x, y)
    distinct = cells.groupBy("x").agg(F.lit(1).alias("one"))
    levels = max((distinct.count() - 1).bit_length(), 1)
    index = slices.running_counts(distinct, "x", "one", slices.slice_bounds(distinct, "x")).select("x", F.col("before").alias("i"))
    bit = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    spread = cells.join(index, "x").select("y", "n", "i", bit.alias("level"))
    side = F.expr("(i >> level) & 1")
    nodes = spread.groupBy("level", F.expr("i >> (level + 1)").alias("node"), "y").agg(
        F.sum(F.when(side == 0, F.col("n")).otherwise(0)).alias("left_n"),
        F.sum(F.when(side == 1, F.col("n")).otherwise(0)).alias("right_n"),
    )
    bounds = slices.slice_bounds(cells, "y")
    run = slices.running_sums(nodes, ["level", "node"], "y", {"below": "left_n"}, bounds)
    lefts = nodes.groupBy("level", "node").agg(F.sum("left_n").alias("lefts"))
    wide = "decimal(19,0)"
    balance = 2 * F.col("below") + F.col("left_n") - F.col("lefts")
    s = F.sum((F.col("right_n").cast(wide) * balance.cast(wide)).cast("decimal(38,0)"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"))
    return (
        run.join(lefts, ["level", "node"])
        .agg(F.coalesce(s, F.lit(0)).cast("string").alias("s"))
        .withColumn("records", total.scalar())
    )


def spearman_a4(df: DataFrame, x: str, y: str) -> DataFrame:
    """``records`` and ``a4``: four times the sum of products of the centred mid-ranks."""
    cells = _counted_pairs(df, x, y)
    rx = slices.mid_ranks(slices.value_counts(cells, "x", F.col("n")), "x").select("x", F.col("mid_rank_x2").alias("rx"))
    ry = slices.mid_ranks(slices.value_counts(cells, "y", F.col("n")), "y").select("y", F.col("mid_rank_x2").alias("ry"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records")).scalar()
    wide = "decimal(19,0)"
    ranked = cells.join(rx, "x").join(ry, "y").withColumn("records", total)
    left, right = F.col("rx") - F.col("records") - 1, F.col("ry") - F.col("records") - 1
    product = (left.cast(wide) * right.cast(wide)).cast("decimal(38,0)") * F.col("n")
    return ranked.agg(F.coalesce(F.sum(product.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("a4")).withColumn(
        "records", total
    )


# -- histories ------------------------------------------------------------------------------

VERSION_EDGES = (1, 2, 3, 5, 10, 20)
LENGTH_EDGES = (0, 1, 7, 30, 90, 365, 1095)


def history(
    df: DataFrame, *, entity: str, start: str, end: str, tie: str, tracked: dict[str, Sequence[str]]
) -> DataFrame:
    """``member, cell, n`` of a versioned table: counts of versions, starts, lengths, chains and moves.

    Versions of an entity are ordered by start, then end (an open end last), then ``tie``. Each
    version meets its follower in ranges of the whole order, so a long history spreads over tasks.
    """
    names = list(tracked)
    order = F.struct(
        F.col(start).alias("start"),
        F.col(end).isNull().alias("open"),
        F.coalesce(F.col(end), F.col(start)).alias("end"),
        F.col(tie).alias("tie"),
        *names,
    )
    versions = df.where(F.col(entity).isNotNull() & F.col(start).isNotNull()).select(
        F.col(entity).alias("e"), order.alias("v")
    )
    linked = slices.next_in_order(versions, ["e"], "v", "w")
    entities = versions.groupBy("e").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    gap = F.datediff("w.start", "v.end")
    chain = (
        F.when(F.col("v.open") | (gap < 0), "overlap").when(gap == 0, "nextStart").when(gap == 1, "dayBefore").otherwise("gap")
    )
    moved = F.filter(
        F.array(*[F.when(~F.col(f"v.{c}").eqNullSafe(F.col(f"w.{c}")), F.lit(c)) for c in names]), lambda x: x.isNotNull()
    )

    def cell(member: str, value: Column) -> Column:
        return F.struct(F.lit(member).alias("member"), value.cast("string").alias("cell"))

    of_entity = F.array(
        cell("versionsPerEntity", open_bin_of(F.col("n"), VERSION_EDGES)),
        cell("firstStart", F.year("first.start")),
        *[cell(f"initial {c}", F.col(f"first.{c}")) for c in names],
    )
    of_pair = F.array(
        cell("versionLength", open_bin_of(F.datediff("w.start", "v.start"), LENGTH_EDGES)),
        cell("chain", chain),
        cell("reasons", F.when(F.size(moved) == 1, moved[0]).when(F.size(moved) > 1, "several")),
        *[
            cell(
                f"transitions {c}",
                F.when(~F.col(f"v.{c}").eqNullSafe(F.col(f"w.{c}")), F.concat(F.col(f"v.{c}"), F.lit(" > "), F.col(f"w.{c}"))),
            )
            for c in names
        ],
    )
    last = F.array(cell("lastVersion", F.when(F.col("v.open"), "open").otherwise("closed")))
    cells = (
        entities.select(F.explode(of_entity).alias("c"))
        .unionByName(linked.select(F.explode(F.when(F.col("w").isNull(), last).otherwise(of_pair)).alias("c")))
        .where("c.cell IS NOT NULL")
    )
    return cells.groupBy("c.member", "c.cell").agg(F.count("*").alias("n"))


def query_rate(rows: DataFrame, returned: DataFrame, key: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Per group: rows a consumer query does not return, and rows it does."""
    hits = returned.select(*key).distinct().withColumn("_hit", F.lit(True))
    flagged = rows.join(hits, list(key), "left")
    return flagged.groupBy(*groups).agg(
        F.count_if(F.col("_hit").isNull()).alias("not_returned"), F.count_if(F.col("_hit")).alias("returned")
    )


# -- the document ------------------------------------------------------------------------------

MOST_COUNT = 2**53 - 1


def json_number(c: Column) -> Column:
    """A count as a JSON integer; it must not pass 2^53 - 1."""
    too_large = F.raise_error(F.lit("a count above 2^53 - 1 has no exact JSON integer")).cast("string")
    return F.when(c <= MOST_COUNT, c.cast("string")).otherwise(too_large)


def json_decimal(c: Column) -> Column:
    """Any other number as decimal text without trailing zeros."""
    text = F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1")
    return F.concat(F.lit('"'), F.regexp_replace(text, r"\.$", ""), F.lit('"'))


def entry(df: DataFrame, table: str, column: str, statistic: str, fields: dict[str, Column]) -> DataFrame:
    """``place, json``: each row of a statistic as one canonical JSON object, its keys sorted."""
    parts = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "") + f'"{key}":'), F.coalesce(fields[key], F.lit("null"))]
    return df.select(
        F.lit(f"{table}.{column}.{statistic}").alias("place"), F.concat(F.lit("{"), *parts, F.lit("}")).alias("json")
    )


def digest(entries: DataFrame) -> DataFrame:
    """The sha256 of the sorted entries: their number is bounded by the declared statistics."""
    lines = F.array_sort(F.collect_list(F.concat("place", F.lit(" "), "json")))
    return entries.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("json")).select(
        F.lit("digest").alias("place"), F.concat(F.lit("sha256:"), "json").alias("json")
    )
