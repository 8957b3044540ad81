"""Contribution bounding and noisy releases.

Noisy results are random by design and have no SQL; the exact bounded counts behind them do.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedwork.functions.crypto import hmac_pads
from deedwork.functions.values import money
from deedwork.operators import contribution, noise, profile, windows
from deedwork.plans.profiling import HISTORY_SQL, PAIR_SQL, graded_lines, line_pairs, order_history
from deedwork.plans.registry import query
from deedwork.plans.relational import ORDER_PRIORITIES
from deedwork.session import Tables

# A demonstration seed. A release takes its own and keeps it secret.
SEED = b"a-seed-for-the-example-tables-only"
INNER, OUTER = hmac_pads(SEED)


def netstrings_sql(*columns: str) -> str:
    texts = [f"CAST({c} AS VARCHAR)" for c in columns]
    return " || ".join(f"CASE WHEN {t} IS NULL THEN '-' ELSE octet_length(encode({t})) || ':' || {t} END" for t in texts)


def unit_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '{contribution.NO_UNIT}' ELSE {netstrings_sql(c)} END"


def drawn_sql(label: str, unit: str, content: str) -> str:
    message = netstrings_sql(f"'{label}'", unit, content)
    return f"sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode({message}))))"


ORDER_CONTENT = ("o_orderkey", "o_orderstatus", "o_orderpriority")


def bounded_sql(name: str, source: str, unit: str, content: tuple, label: str, most: int) -> str:
    return f"""{name}_u AS (SELECT *, {unit_sql(unit)} AS _u, {netstrings_sql(*content)} AS _c FROM {source}),
  {name}_p AS (SELECT *, {drawn_sql(label, "_u", "_c")} AS _p FROM {name}_u),
  {name} AS (SELECT * EXCLUDE (_u, _c, _p) FROM {name}_p QUALIFY row_number() OVER (PARTITION BY _u ORDER BY _p, _c) <= {most})"""


KEYED_ORDERS = "k AS (SELECT CASE WHEN o_orderkey % 20 <> 0 THEN o_custkey END AS custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders)"


@query(
    "dp_bound_rows",
    f"""WITH {KEYED_ORDERS}, {bounded_sql("kept", "k", "custkey", ORDER_CONTENT, "bound", 3)} SELECT custkey, o_orderkey FROM kept""",
)
def dp_bound_rows(t: Tables) -> DataFrame:
    """Three orders a customer; orders without a customer share one unit."""
    keyed = t.orders.withColumn("custkey", F.when(F.col("o_orderkey") % 20 != 0, F.col("o_custkey")))
    kept = contribution.bound_rows(keyed, ["custkey"], ORDER_CONTENT, seed=SEED, most=3)
    return kept.select("custkey", "o_orderkey")


def nation_orders(t: Tables) -> DataFrame:
    """Versions (orders) of entities (customers) under a unit (nation)."""
    return order_history(t).join(
        t.customer.select("c_custkey", F.col("c_nationkey").alias("nation")), F.col("o_custkey") == F.col("c_custkey")
    ).drop("c_custkey")


NATION_ROOM = 40


def entities_sql(label: str, most: int) -> str:
    """CTEs whose last one, ``f``, says of every customer whether it is ``kept`` within ``most`` orders of its nation."""
    return f"""s AS (SELECT c_nationkey AS nation, o_custkey, count(*) AS size FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING count(*) <= {most}),
    e AS (SELECT *, {netstrings_sql("o_custkey")} AS ent FROM s),
    p AS (SELECT *, {drawn_sql(label, "_u", "_e")} AS _p FROM (SELECT *, {unit_sql("nation")} AS _u, {netstrings_sql("ent")} AS _e FROM e)),
    d AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY _p) AS rn FROM p),
    f AS (SELECT nation, rn, o_custkey, size <= {most} AS kept, {most} - CASE WHEN size <= {most} THEN size ELSE 0 END AS room FROM d WHERE rn = 1
      UNION ALL SELECT d.nation, d.rn, d.o_custkey, d.size <= f.room, f.room - CASE WHEN d.size <= f.room THEN d.size ELSE 0 END FROM f JOIN d ON d.nation = f.nation AND d.rn = f.rn + 1)"""


@query(
    "dp_bound_entities",
    f"""WITH RECURSIVE {entities_sql("bound", NATION_ROOM)}
    SELECT f.nation::BIGINT AS nation, f.o_custkey, o_orderkey FROM f JOIN orders ON f.o_custkey = orders.o_custkey WHERE kept""",
)
def dp_bound_entities(t: Tables) -> DataFrame:
    """Customers kept whole within forty orders a nation."""
    kept = contribution.bound_entities(
        nation_orders(t).select("nation", "o_custkey", "o_orderkey"), "nation", "o_custkey", seed=SEED, most=NATION_ROOM
    )
    return kept.select("nation", "o_custkey", "o_orderkey")


LINE_CONTENT = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def followed(t: Tables) -> tuple[DataFrame, DataFrame]:
    orders = contribution.follow_rows(
        t.customer, "c_custkey", t.orders, "o_custkey", ORDER_CONTENT, seed=SEED, most=4, label="orders"
    )
    lines = t.lineitem.withColumn("l_quantity", F.col("l_quantity").cast("int"))
    return orders, contribution.follow_rows(
        orders, "o_orderkey", lines, "l_orderkey", LINE_CONTENT, seed=SEED, most=2, label="lines"
    )


@query(
    "dp_follow_rows",
    f"""WITH k AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)), {bounded_sql("kept", "k", "o_custkey", ORDER_CONTENT, "orders", 4)},
    l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INTEGER AS l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM kept)), {bounded_sql("lines", "l", "l_orderkey", LINE_CONTENT, "lines", 2)}
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey FROM lines""",
)
def dp_follow_rows(t: Tables) -> DataFrame:
    """Customer, four of its orders, two lines of each: truncated from the top down."""
    return followed(t)[1].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "dp_sensitivity",
    """WITH c AS (SELECT o_custkey, count(*) AS c, max(n) AS k FROM (SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders) GROUP BY 1)
    SELECT o_custkey, c, k, greatest((c // k) * k * k + (c % k) * (c % k), 2) AS squared FROM c""",
)
def dp_sensitivity(t: Tables) -> DataFrame:
    """What each customer's own rows would cost: the release's bound is the largest it allows."""
    cells = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return (
        cells.groupBy("o_custkey")
        .agg(F.sum("n").alias("c"), F.max("n").alias("k"))
        .withColumn("squared", contribution.sensitivity_squared(F.col("c"), F.col("k")))
    )


VARIANCE = Fraction(25, 4)


KEPT_ORDERS = bounded_sql("kept", "orders", "o_custkey", ORDER_CONTENT, "bound", 3)
LEVELS_SQL = "(VALUES " + ", ".join(f"('{level}')" for level in ORDER_PRIORITIES) + ")"


def kept_orders(t: Tables) -> DataFrame:
    return contribution.bound_rows(t.orders, ["o_custkey"], ORDER_CONTENT, seed=SEED, most=3)


@query(
    "dp_exact_counts",
    f"""WITH {KEPT_ORDERS} SELECT level, count(o_orderkey) AS n FROM {LEVELS_SQL} l(level) LEFT JOIN kept ON o_orderpriority = level GROUP BY level""",
)
def dp_exact_counts(t: Tables) -> DataFrame:
    """The cells under the noisy counts: bounded orders by priority, on the declared levels."""
    return profile.level_histogram(kept_orders(t), "o_orderpriority", ORDER_PRIORITIES).select("level", "n")


@query("dp_noisy_counts")
def dp_noisy_counts(t: Tables) -> DataFrame:
    """Bounded orders by priority on the declared levels, with noise."""
    return noise.noisy_counts(dp_exact_counts(t), ["level"], "n", variance=VARIANCE, seed=SEED, label="orders.o_orderpriority")


@query(
    "dp_exact_null_count",
    f"""WITH {KEPT_ORDERS}, s AS (SELECT CASE WHEN o_orderkey % 7 = 0 OR o_orderpriority IS NULL THEN 'null' ELSE 'known' END AS state FROM kept)
    SELECT level, count(state) AS n FROM (VALUES ('known'), ('null')) l(level) LEFT JOIN s ON state = level GROUP BY level""",
)
def dp_exact_null_count(t: Tables) -> DataFrame:
    known = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    state = kept_orders(t).select(F.when(known.isNull(), "null").otherwise("known").alias("state"))
    return profile.level_histogram(state, "state", ("known", "null")).select("level", "n")


@query("dp_noisy_null_count")
def dp_noisy_null_count(t: Tables) -> DataFrame:
    return noise.noisy_counts(dp_exact_null_count(t), ["level"], "n", variance=VARIANCE, seed=SEED, label="orders.priority.null")


TRACKED = {"tier": ORDER_PRIORITIES, "status": ("F", "O", "P")}
YEAR_LADDER = tuple(range(1990, 2011))


def history_spine() -> list[tuple[str, str]]:
    """Every public cell of a noisy history, the diagonal of the transitions included."""
    cells = [("versionsPerEntity", str(e)) for e in profile.VERSION_EDGES]
    cells += [("firstStart", str(y)) for y in YEAR_LADDER]
    cells += [("versionLength", str(e)) for e in profile.LENGTH_EDGES]
    cells += [("chain", c) for c in ("dayBefore", "gap", "nextStart", "overlap")]
    cells += [("lastVersion", c) for c in ("closed", "open")]
    cells += [("reasons", c) for c in sorted([*TRACKED, "several"])]
    for name, levels in TRACKED.items():
        cells += [(f"initial {name}", level) for level in levels]
        cells += [(f"transitions {name}", f"{a} > {b}") for a in levels for b in levels]
    return cells + sorted({(member, "other") for member, _ in cells})


HISTORY_ROOM = 200


@query(
    "dp_exact_history",
    f"""WITH RECURSIVE {entities_sql("history", HISTORY_ROOM)}, {HISTORY_SQL.replace("FROM orders)", "FROM orders WHERE o_custkey IN (SELECT o_custkey FROM f WHERE kept))", 1)},
    spine AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{c}')" for m, c in history_spine())}) v(member, cell)),
    named AS (SELECT c.member, coalesce(s.cell, 'other') AS cell FROM cells c LEFT JOIN spine s ON c.member = s.member AND c.cell = s.cell)
    SELECT s.member, s.cell, count(n.cell) AS n FROM spine s LEFT JOIN named n ON s.member = n.member AND s.cell = n.cell GROUP BY ALL""",
)
def dp_exact_history(t: Tables) -> DataFrame:
    """The history of the kept entities on its whole public spine."""
    kept = contribution.bound_entities(nation_orders(t), "nation", "o_custkey", seed=SEED, most=HISTORY_ROOM, label="history")
    counts = profile.history(kept, entity="o_custkey", start="start", end="stop", tie="o_orderkey", tracked=TRACKED)
    # What the public spine does not name goes to its member's cell "other", so each count lands once.
    spine = t.spark.createDataFrame(history_spine(), "member string, cell string")
    named = spine.withColumn("on_spine", F.lit(True))
    cell = F.when(F.col("on_spine"), F.col("cell")).otherwise("other").alias("cell")
    counts = counts.join(F.broadcast(named), ["member", "cell"], "left").groupBy("member", cell).agg(F.sum("n").alias("n"))
    return spine.join(counts, ["member", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("dp_noisy_history")
def dp_noisy_history(t: Tables) -> DataFrame:
    return noise.noisy_counts(dp_exact_history(t), ["member", "cell"], "n", variance=VARIANCE, seed=SEED, label="orders.history")


@query(
    "dp_exact_query_rate",
    f"""WITH {KEPT_ORDERS}, r AS (SELECT o_orderpriority, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'returned' ELSE 'not_returned' END AS cell FROM kept)
    SELECT grp, c.cell, count(r.cell) AS n FROM {LEVELS_SQL} l(grp) CROSS JOIN (VALUES ('returned'), ('not_returned')) c(cell) LEFT JOIN r ON o_orderpriority = grp AND r.cell = c.cell GROUP BY ALL""",
)
def dp_exact_query_rate(t: Tables) -> DataFrame:
    """Two cells a group; each kept order lands in one of them."""
    answer = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    rates = profile.query_rate(kept_orders(t), answer, ["o_orderkey"], ["o_orderpriority"])
    spine = windows.level_spine(t.spark, "o_orderpriority", ORDER_PRIORITIES)
    cells = [F.struct(F.lit(c).alias("cell"), F.coalesce(c, F.lit(0)).alias("n")) for c in ("not_returned", "returned")]
    joined = spine.join(rates, "o_orderpriority", "left")
    return joined.select(F.col("o_orderpriority").alias("grp"), F.explode(F.array(*cells)).alias("c")).select("grp", "c.cell", "c.n")


@query("dp_noisy_query_rate")
def dp_noisy_query_rate(t: Tables) -> DataFrame:
    return noise.noisy_counts(dp_exact_query_rate(t), ["grp", "cell"], "n", variance=VARIANCE, seed=SEED, label="orders.rate")


ROW_FLOOR = 1000
LINES_PER_ORDER = 2


@query(
    "dp_exact_rank",
    f"""WITH {bounded_sql("kept", "lineitem", "l_orderkey", ("l_linenumber", "l_partkey", "l_suppkey"), "rank", LINES_PER_ORDER)},
    c AS (SELECT l_discount AS x, l_quantity AS y, count(*)::HUGEINT AS n FROM kept GROUP BY ALL)
    SELECT ((sum(a.n * b.n * sign(a.x - b.x)::INTEGER * sign(a.y - b.y)::INTEGER)) // 2)::BIGINT::VARCHAR AS s, (SELECT sum(n)::BIGINT FROM c) AS records FROM c a, c b""",
)
def dp_exact_rank(t: Tables) -> DataFrame:
    """Kendall's statistic over at most two lines of each order."""
    content = ("l_linenumber", "l_partkey", "l_suppkey")
    kept = contribution.bound_rows(t.lineitem, ["l_orderkey"], content, seed=SEED, most=LINES_PER_ORDER, label="rank")
    return profile.kendall_s(graded_lines(kept), "discount", "quantity")


@query("dp_noisy_rank")
def dp_noisy_rank(t: Tables) -> DataFrame:
    """Kendall's tau of two columns; an order, two lines at most, moves it by at most 8 over the public row floor."""
    return noise.noisy_rank(
        dp_exact_rank(t),
        "s",
        per_unit=LINES_PER_ORDER,
        floor_rows=ROW_FLOOR,
        scale=Fraction(1, 100),
        seed=SEED,
        label="lineitem.discount.quantity",
    )


SPEARMAN_STEP = (12 * LINES_PER_ORDER * ROW_FLOOR, ROW_FLOOR**2 - 1)


@query(
    "dp_exact_spearman",
    f"""WITH {bounded_sql("kept", "lineitem", "l_orderkey", ("l_linenumber", "l_partkey", "l_suppkey"), "rank", LINES_PER_ORDER)},
    r AS (SELECT 2 * rank() OVER (ORDER BY l_discount) + count(*) OVER (PARTITION BY l_discount) - 1 AS rx, 2 * rank() OVER (ORDER BY l_quantity) + count(*) OVER (PARTITION BY l_quantity) - 1 AS ry, count(*) OVER () AS n FROM kept),
    a AS (SELECT sum((rx - n - 1)::HUGEINT * (ry - n - 1)) AS a4, count(*)::HUGEINT AS n FROM r),
    q AS (SELECT a4, n, 3 * a4 * {2**20}::HUGEINT * {SPEARMAN_STEP[1]} AS top, (n * n * n - n) * {SPEARMAN_STEP[0]} AS bottom FROM a)
    SELECT a4::VARCHAR AS a4, n::BIGINT AS records, ((2 * top + bottom + 2 * bottom * 1000000000::HUGEINT) // (2 * bottom) - 1000000000)::BIGINT::VARCHAR AS point FROM q""",
)
def dp_exact_spearman(t: Tables) -> DataFrame:
    """Spearman's statistic over at most two lines of each order, and its place on the lattice that its noise is drawn on."""
    content = ("l_linenumber", "l_partkey", "l_suppkey")
    kept = contribution.bound_rows(t.lineitem, ["l_orderkey"], content, seed=SEED, most=LINES_PER_ORDER, label="rank")
    stats = profile.spearman_a4(graded_lines(kept), "discount", "quantity")
    return noise.lattice_points(stats, "a4", noise.SPEARMAN, per_unit=LINES_PER_ORDER, floor_rows=ROW_FLOOR)


@query("dp_noisy_spearman")
def dp_noisy_spearman(t: Tables) -> DataFrame:
    """Spearman's rho of two columns over bounded rows, with noise."""
    return noise.noisy_rank(
        dp_exact_spearman(t),
        "a4",
        kind=noise.SPEARMAN,
        per_unit=LINES_PER_ORDER,
        floor_rows=ROW_FLOOR,
        scale=Fraction(1, 100),
        seed=SEED,
        label="lineitem.discount.quantity.rho",
    )


def rough_cells(t: Tables, second: str) -> DataFrame:
    """Complete two-way cells whose counts were roughened, as noise would, but repeatably."""
    counts = t.orders.groupBy("o_orderpriority", "o_orderstatus" if second == "status" else F.year("o_orderdate").alias("year"))
    named = counts.agg(F.count("*").alias("n")).withColumnRenamed("o_orderstatus", "status")
    return named.select("o_orderpriority", second, (F.col("n") + F.col("n") % 7 - 3).cast("double").alias("value"))


@query(
    "dp_consistent",
    """WITH a AS (SELECT o_orderpriority AS p, o_orderstatus AS s, (count(*) + count(*) % 7 - 3)::DOUBLE AS v FROM orders GROUP BY ALL), b AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, (count(*) + count(*) % 7 - 3)::DOUBLE AS v FROM orders GROUP BY ALL),
    w0 AS (SELECT 1.0::DOUBLE / (15 * 4) AS wa, 1.0::DOUBLE / (35 * 9) AS wb, (SELECT sum(v) FROM a) AS sa, (SELECT sum(v) FROM b) AS sb),
    t0 AS (SELECT sa, sb, (wa * sa + wb * sb) / (wa + wb) AS t FROM w0),
    a1 AS (SELECT p, s, v + (t - sa) / 15 AS v FROM a, t0), b1 AS (SELECT p, y, v + (t - sb) / 35 AS v FROM b, t0),
    pa AS (SELECT p, sum(v) AS h FROM a1 GROUP BY 1), pb AS (SELECT p, sum(v) AS h FROM b1 GROUP BY 1),
    t1 AS (SELECT pa.p, pa.h AS ha, pb.h AS hb, (pa.h / (3 * 4) + pb.h / (7 * 9)) / (1.0::DOUBLE / (3 * 4) + 1.0::DOUBLE / (7 * 9)) AS t FROM pa JOIN pb ON pa.p = pb.p)
    SELECT 'status' AS tbl, a1.p AS priority, s AS cell, round(v + (t - ha) / 3, 6) AS value FROM a1 JOIN t1 ON a1.p = t1.p UNION ALL SELECT 'year', b1.p, y::VARCHAR, round(v + (t - hb) / 7, 6) FROM b1 JOIN t1 ON b1.p = t1.p""",
)
def dp_consistent(t: Tables) -> DataFrame:
    tables = {
        "status": contribution.NoisyTable(rough_cells(t, "status"), {"o_orderpriority": 5, "status": 3}, 4.0),
        "year": contribution.NoisyTable(rough_cells(t, "year"), {"o_orderpriority": 5, "year": 7}, 9.0),
    }
    parts = {
        name: table.cells.select(
            F.col("o_orderpriority").alias("priority"), F.col(name).cast("string").alias("cell"), F.round("value", 6).alias("value")
        )
        for name, table in contribution.agreeing(tables).items()
    }
    return windows.labelled(parts, "tbl")


@query(
    "dp_pair_strength",
    f"""WITH {PAIR_SQL}, m AS (SELECT first, second, a, b, n::HUGEINT AS n, sum(n) OVER (PARTITION BY first, second, a)::HUGEINT AS na, sum(n) OVER (PARTITION BY first, second, b)::HUGEINT AS nb, sum(n) OVER (PARTITION BY first, second)::HUGEINT AS nn FROM p)
    SELECT first, second, (sum(abs(n * nn - na * nb)) + any_value(nn * nn) - sum(na * nb))::DOUBLE / any_value(nn * nn)::DOUBLE AS strength FROM m GROUP BY ALL""",
)
def dp_pair_strength(t: Tables) -> DataFrame:
    """How far each pair of columns is from independence, strongest first."""
    return profile.pair_strength(line_pairs(t)).orderBy(F.desc("strength"), "first", "second")
