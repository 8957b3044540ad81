"""Exact profiling statistics over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedwork.functions.values import day, money
from deedwork.operators import profile, quality, sketches, slices
from deedwork.plans.quality import BANDS, SALES, order_rules, sales
from deedwork.plans.registry import query
from deedwork.plans.relational import ORDER_PRIORITIES
from deedwork.session import Tables, materialized

PRICE_EDGES = (0, 1000, 50000, 100000, 200000, 300000, 400000, 500000, 1000000)
DAY_EDGES = (-3000, -1000, -365, -30, 0, 30, 365, 1000, 3000)


def bins_sql(value: str, edges, lower_only: bool = False) -> str:
    whens = [f"WHEN {value} < {hi} THEN {lo}" for lo, hi in zip(edges[:-1], edges[1:])]
    return f"CASE {' '.join(whens)} ELSE {edges[-1] if lower_only else edges[-2]} END"


def values_sql(edges) -> str:
    return ", ".join(f"({e})" for e in edges)


@query(
    "profile_columns",
    SALES
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{t}' AS type, count(*) AS rows, (count(*) - count({c}))::DOUBLE / count(*)::DOUBLE AS null_rate, count(DISTINCT {c}) AS distinct_count,
        (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM sales WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS samples FROM sales"""
        for c, t in (
            ("o_orderkey", "bigint"),
            ("custkey", "bigint"),
            ("placed", "date"),
            ("amount", "decimal(12,2)"),
            ("status", "string"),
            ("priority", "string"),
            ('"at"', "timestamp_ntz"),
        )
    ).replace("""'"at"' AS column_name""", "'at' AS column_name"),
)
def profile_columns(t: Tables) -> DataFrame:
    return profile.column_profile(sales(t))


def sketched(t: Tables, rows: DataFrame, by: str, name: str) -> DataFrame:
    """The merged sketches of two loads of the table; the second load is run again, which changes nothing."""
    path = t.scratch(name)
    for load in (0, 1, 1):
        sketches.store(rows.where(F.pmod(F.col(by), F.lit(2)) == load), path, load)
    return sketches.stored(t.spark, path)


SALE_COLUMNS = ("o_orderkey", "custkey", "placed", "amount", "status", "priority", '"at"')


@query(
    "profile_columns_approx",
    SALES
    + " UNION ALL ".join(
        f"""SELECT '{c.strip('"')}' AS column_name, count(*) AS rows, (count(*) - count({c}))::DOUBLE / count(*)::DOUBLE AS null_rate, count(DISTINCT {c}) AS distinct_count, true AS within FROM sales"""
        for c in SALE_COLUMNS
    ),
)
def profile_columns_approx(t: Tables) -> DataFrame:
    """Whether the distinct counts of merged sketches are within their bound of the exact ones beside them."""
    rows = sales(t)
    told = sketches.profile(sketched(t, rows, "o_orderkey", "column-sketches")).withColumnRenamed("distinct_count", "approx")
    exact = profile.column_profile(rows, samples=0).select("column_name", "distinct_count")
    close = F.abs(F.col("approx") - F.col("distinct_count")) <= F.ceil(F.col("distinct_count") * sketches.distinct_error())
    return told.join(exact, "column_name").select("column_name", "rows", "null_rate", "distinct_count", close.alias("within"))


@query(
    "profile_level_hist",
    "SELECT v AS level, count(o_orderkey) AS n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NEVER')) AS l(v) LEFT JOIN orders ON o_orderpriority = v GROUP BY v",
)
def profile_level_hist(t: Tables) -> DataFrame:
    return profile.level_histogram(t.orders, "o_orderpriority", [*ORDER_PRIORITIES, "6-NEVER"])


@query(
    "profile_bin_hist",
    f"""WITH b AS (SELECT {bins_sql("o_totalprice::DECIMAL(12,2)", PRICE_EDGES)} AS low, count(*) AS n FROM orders GROUP BY 1)
    SELECT v::BIGINT AS low, coalesce(n, 0) AS n FROM (VALUES {values_sql(PRICE_EDGES[:-1])}) AS e(v) LEFT JOIN b ON low = v""",
)
def profile_bin_hist(t: Tables) -> DataFrame:
    return profile.bin_histogram(t.orders, money("o_totalprice"), PRICE_EDGES)


@query(
    "profile_magnitudes",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(v) AS n, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high, sum(v)::DOUBLE AS total, sum(g)::BIGINT::VARCHAR AS grid_total,
        sum(g)::BIGINT::DOUBLE / (count(v) * 65536)::DOUBLE AS mean FROM (SELECT {c}::DECIMAL(12,2) AS v, ((round({c} * 100)::HUGEINT * 65536) // 100)::HUGEINT AS g FROM lineitem)"""
        for c in ("l_extendedprice", "l_quantity", "l_discount")
    ),
)
def profile_magnitudes(t: Tables) -> DataFrame:
    columns = ["l_extendedprice", "l_quantity", "l_discount"]
    return profile.magnitudes(t.lineitem.select(*[money(c).alias(c) for c in columns]), columns)


QUANTILES = (("min", 0, 1), ("p05", 1, 20), ("p25", 1, 4), ("p50", 1, 2), ("p75", 3, 4), ("max", 1, 1))


@query(
    "profile_quantiles",
    """WITH r AS (SELECT l_extendedprice::DECIMAL(12,2) AS v, row_number() OVER (ORDER BY l_extendedprice) AS rn, count(*) OVER () AS n FROM lineitem)
    SELECT level, v::DOUBLE AS value FROM r JOIN (VALUES ('min', 0, 1), ('p05', 1, 20), ('p25', 1, 4), ('p50', 1, 2), ('p75', 3, 4), ('max', 1, 1)) AS q(level, a, b) ON rn = greatest(1, (n * a + b - 1) // b)""",
)
def profile_quantiles(t: Tables) -> DataFrame:
    prices = t.lineitem.select(money("l_extendedprice").alias("price"))
    return slices.quantile_values(prices, "price", QUANTILES)


@query(
    "profile_quantiles_approx",
    "SELECT level, (SELECT count(l_extendedprice) FROM lineitem) AS n, true AS within FROM (VALUES ('min'), ('p05'), ('p25'), ('p50'), ('p75'), ('max')) AS q(level)",
)
def profile_quantiles_approx(t: Tables) -> DataFrame:
    """Whether the ranks of quantiles from merged sketches, counted in the table itself, are within twice the bound."""
    rows = t.lineitem.select("l_orderkey", F.col("l_extendedprice").alias("price"))
    merged = sketched(t, rows, "l_orderkey", "price-sketches").where("column_name = 'price'")
    found = materialized(sketches.quantiles(merged, "price", QUANTILES), "sketch-quantiles")
    bound = 2 * sketches.rank_error()
    close = (F.col("below") - bound <= F.col("share")) & (F.col("share") <= F.col("upto") + bound)
    told = sketches.ranks(rows, F.col("price"), found).select("level", close.alias("within"))
    return found.select("level", "n").join(told, "level")


@query(
    "profile_date_span",
    """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS start, count(*) AS n FROM orders GROUP BY 1), y AS (SELECT date_trunc('year', start)::DATE AS start, sum(n)::BIGINT AS n FROM m GROUP BY 1),
    f AS (SELECT (SELECT arg_min(n, start) FROM m) >= 10 AND (SELECT arg_max(n, start) FROM m) >= 10 AS by_month, (SELECT arg_min(n, start) FROM y) >= 10 AND (SELECT arg_max(n, start) FROM y) >= 10 AS by_year)
    SELECT 'month' AS unit, s::DATE::VARCHAR AS start, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(start) FROM m), (SELECT max(start) FROM m), INTERVAL 1 MONTH)) AS s) LEFT JOIN m ON m.start = s::DATE WHERE (SELECT by_month FROM f)
    UNION ALL SELECT 'year', s::DATE::VARCHAR, coalesce(n, 0) FROM (SELECT unnest(generate_series((SELECT min(start) FROM y), (SELECT max(start) FROM y), INTERVAL 1 YEAR)) AS s) LEFT JOIN y ON y.start = s::DATE
    WHERE (SELECT by_year AND NOT by_month FROM f)""",
)
def profile_date_span(t: Tables) -> DataFrame:
    return profile.date_span(t.orders.select(day("o_orderdate").alias("placed")), "placed")


@query(
    "profile_extremes",
    """WITH d AS (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1), e AS (SELECT min(d) AS a, max(d) AS b FROM d),
    h AS (SELECT sum(n) FILTER (d = a) AS a_day, sum(n) FILTER (date_trunc('month', d) = date_trunc('month', a)) AS a_month, sum(n) FILTER (year(d) = year(a)) AS a_year, any_value(a) AS a,
      sum(n) FILTER (d = b) AS b_day, sum(n) FILTER (date_trunc('month', d) = date_trunc('month', b)) AS b_month, sum(n) FILTER (year(d) = year(b)) AS b_year, any_value(b) AS b FROM d, e)
    SELECT 'min' AS which, greatest(CASE WHEN a_day >= 400 THEN a WHEN a_month >= 400 THEN date_trunc('month', a)::DATE WHEN a_year >= 400 THEN date_trunc('year', a)::DATE END, DATE '2024-01-01')::VARCHAR AS at,
      CASE WHEN a_day >= 400 THEN 'day' WHEN a_month >= 400 THEN 'month' WHEN a_year >= 400 THEN 'year' END AS level FROM h
    UNION ALL SELECT 'max', least(CASE WHEN b_day >= 400 THEN b WHEN b_month >= 400 THEN last_day(b) WHEN b_year >= 400 THEN (date_trunc('year', b) + INTERVAL 1 YEAR)::DATE - 1 END, DATE '2024-01-30')::VARCHAR,
      CASE WHEN b_day >= 400 THEN 'day' WHEN b_month >= 400 THEN 'month' WHEN b_year >= 400 THEN 'year' END FROM h""",
)
def profile_extremes(t: Tables) -> DataFrame:
    return profile.rounded_extremes(t.events, "ts", low="2024-01-01", high="2024-01-30", minimum=400)


@query(
    "profile_calendar",
    """WITH c AS (SELECT 'month' AS part, month(ts) AS cell, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'day_of_week', dayofweek(ts), count(*) FROM events GROUP BY ALL
      UNION ALL SELECT 'hour_of_week', dayofweek(ts) * 24 + hour(ts), count(*) FROM events GROUP BY ALL),
    s AS (SELECT 'month' AS part, unnest(range(1, 13)) AS cell UNION ALL SELECT 'day_of_week', unnest(range(0, 7)) UNION ALL SELECT 'hour_of_week', unnest(range(0, 168)))
    SELECT s.part, s.cell, coalesce(n, 0) AS n FROM s LEFT JOIN c ON s.part = c.part AND s.cell = c.cell""",
)
def profile_calendar(t: Tables) -> DataFrame:
    return profile.calendar_histograms(t.events, "ts")


@query(
    "profile_date_pairs",
    f"""WITH b AS (SELECT {bins_sql("(l_shipdate::DATE - o_orderdate::DATE)", DAY_EDGES)} AS low, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT v::BIGINT AS low, coalesce(n, 0) AS n FROM (VALUES {values_sql(DAY_EDGES[:-1])}) AS e(v) LEFT JOIN b ON low = v""",
)
def profile_date_pairs(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        day("o_orderdate").alias("placed"), day("l_shipdate").alias("shipped")
    )
    return profile.bin_histogram(rows, F.datediff("shipped", "placed"), DAY_EDGES)


@query(
    "profile_key_check",
    """WITH k AS (SELECT l_orderkey, CASE WHEN l_partkey % 10 <> 0 THEN l_linenumber END AS line, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT count(CASE WHEN line IS NOT NULL AND n > 1 THEN 1 END) AS repeated_keys, coalesce(sum(CASE WHEN line IS NOT NULL AND n > 1 THEN n END), 0)::BIGINT AS repeated_rows, coalesce(sum(CASE WHEN line IS NULL THEN n END), 0)::BIGINT AS null_rows FROM k""",
)
def profile_key_check(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", F.when(F.col("l_partkey") % 10 != 0, F.col("l_linenumber")).alias("line"))
    return profile.key_check(lines, ["l_orderkey", "line"])


PAIR_COLUMNS = ("l_returnflag", "l_linestatus", "l_linenumber", "discount")
PAIR_SQL = """x AS (SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber, l_discount::DECIMAL(4,2)::VARCHAR AS discount FROM lineitem),
  p AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS first, '{b}' AS second, {a} AS a, {b} AS b, count(*) AS n FROM x GROUP BY ALL"
    for i, a in enumerate(PAIR_COLUMNS)
    for b in PAIR_COLUMNS[i + 1 :]
) + ")"


def line_pairs(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("discount", F.col("l_discount").cast("decimal(4,2)"))
    return profile.pair_counts(lines, PAIR_COLUMNS)


@query("profile_pairs", f"WITH {PAIR_SQL} SELECT * FROM p")
def profile_pairs(t: Tables) -> DataFrame:
    return line_pairs(t)


@query(
    "profile_linked",
    "SELECT o_orderpriority AS grp, l_returnflag AS level, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
)
def profile_linked(t: Tables) -> DataFrame:
    """Lines are counted per order and flag before they meet their order."""
    held = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return (
        held.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_orderpriority").alias("grp"), F.col("l_returnflag").alias("level"))
        .agg(F.sum("n").alias("n"))
    )


@query(
    "profile_children_per_parent",
    f"""WITH h AS (SELECT c_mktsegment AS segment, count(o_orderkey) AS n FROM (SELECT CASE WHEN c_custkey % 100 <> 3 THEN c_custkey END AS k, c_mktsegment, c_custkey FROM customer) LEFT JOIN orders ON k = o_custkey GROUP BY c_custkey, c_mktsegment)
    SELECT segment, {bins_sql("n", profile.CHILDREN_EDGES, True)}::BIGINT AS low, count(*) AS n FROM h GROUP BY ALL""",
)
def profile_children_per_parent(t: Tables) -> DataFrame:
    parents = t.customer.select(
        F.when(F.col("c_custkey") % 100 != 3, F.col("c_custkey")).alias("k"), F.col("c_mktsegment").alias("segment")
    )
    return profile.children_per_parent(t.orders, "o_custkey", parents, "k", ["segment"])


@query(
    "profile_relationship_counts",
    """WITH c AS (SELECT CASE WHEN l_orderkey % 9 <> 0 THEN l_orderkey END AS k FROM lineitem), p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    SELECT count(*) FILTER (k IS NULL) AS null_key, count(*) FILTER (k IS NOT NULL AND o_orderkey IS NULL) AS orphan, count(*) FILTER (o_orderkey IS NOT NULL) AS matched,
      (SELECT count(*) FROM (SELECT o_orderkey FROM p GROUP BY 1 HAVING count(*) > 1)) AS repeated_parent_keys FROM c LEFT JOIN p ON k = o_orderkey""",
)
def profile_relationship_counts(t: Tables) -> DataFrame:
    children = t.lineitem.select(F.when(F.col("l_orderkey") % 9 != 0, F.col("l_orderkey")).alias("k"))
    return profile.relationship_counts(children, "k", t.orders.where("o_orderstatus <> 'P'"), "o_orderkey")


@query(
    "profile_relationship_dates",
    f"""SELECT {bins_sql("(e.ts::DATE - o.last::DATE)", (0, 500, 1000, 2000, 20000), True)}::BIGINT AS low, count(*) AS n FROM events e JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) o ON e.user_id = o.o_custkey GROUP BY 1""",
)
def profile_relationship_dates(t: Tables) -> DataFrame:
    """Days from the parent's date to the child's, across the link."""
    parents = t.orders.groupBy("o_custkey").agg(F.max(day("o_orderdate")).alias("since"))
    linked = t.events.select("user_id", day("ts").alias("at")).join(parents, F.col("user_id") == F.col("o_custkey"))
    low = profile.open_bin_of(F.datediff("at", "since"), (0, 500, 1000, 2000, 20000))
    return linked.groupBy(low.alias("low")).agg(F.count("*").alias("n"))


RISK_MONTHS = tuple(f"1998-{m:02d}-01" for m in range(1, 13))


@query(
    "profile_exposure",
    """WITH p AS (SELECT o_orderkey, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE + 400 END AS b FROM orders),
    m AS (SELECT unnest(generate_series(DATE '1998-01-01', DATE '1998-12-01', INTERVAL 1 MONTH))::DATE AS month),
    r AS (SELECT month, sum(greatest(least(coalesce(b, (month + INTERVAL 1 MONTH)::DATE), (month + INTERVAL 1 MONTH)::DATE) - greatest(a, month), 0)) AS days FROM m, p GROUP BY month),
    c AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, count(*) AS n FROM lineitem JOIN p ON l_orderkey = o_orderkey WHERE l_shipdate::DATE >= a AND (b IS NULL OR l_shipdate::DATE < b) GROUP BY 1)
    SELECT r.month::VARCHAR AS month, days::BIGINT AS parent_days, coalesce(n, 0) AS children FROM r LEFT JOIN c ON r.month = c.month""",
)
def profile_exposure(t: Tables) -> DataFrame:
    placed = day("o_orderdate")
    parents = t.orders.select(
        "o_orderkey", placed.alias("a"), F.when(F.col("o_orderkey") % 5 != 0, F.date_add(placed, 400)).alias("b")
    )
    children = t.lineitem.select("l_orderkey", day("l_shipdate").alias("at"))
    return profile.exposure(
        parents, children, parent_key="o_orderkey", child_key="l_orderkey", start="a", end="b", at="at", months=RISK_MONTHS
    )


@query(
    "profile_childless",
    """SELECT o_orderpriority, count(*) AS parents, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)) AS childless FROM orders GROUP BY 1""",
)
def profile_childless(t: Tables) -> DataFrame:
    return profile.childless(t.lineitem.where("l_quantity > 40"), "l_orderkey", t.orders, "o_orderkey", "o_orderpriority")


@query(
    "profile_per_entity",
    """WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY ALL),
    m AS (SELECT v, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) AS rn FROM c) SELECT v AS value, count(*) AS n FROM m WHERE rn = 1 GROUP BY 1""",
)
def profile_per_entity(t: Tables) -> DataFrame:
    known = t.orders.select("o_custkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("v"))
    return profile.per_entity(known, ["o_custkey"], "v")


def graded_lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        profile.on_grid(money("l_quantity")).alias("quantity"),
        profile.on_grid(F.col("l_discount").cast("decimal(4,2)")).alias("discount"),
        profile.on_grid(money("l_extendedprice")).alias("price"),
    )


@query(
    "profile_kendall",
    """WITH c AS (SELECT l_discount AS x, l_quantity AS y, count(*)::HUGEINT AS n FROM lineitem GROUP BY ALL)
    SELECT ((sum(a.n * b.n * sign(a.x - b.x)::INTEGER * sign(a.y - b.y)::INTEGER)) // 2)::BIGINT::VARCHAR AS s, (SELECT sum(n)::BIGINT FROM c) AS records FROM c a, c b""",
)
def profile_kendall(t: Tables) -> DataFrame:
    return profile.kendall_s(graded_lines(t.lineitem), "discount", "quantity")


@query(
    "profile_spearman",
    """WITH r AS (SELECT 2 * rank() OVER (ORDER BY l_quantity) + count(*) OVER (PARTITION BY l_quantity) - 1 AS rx, 2 * rank() OVER (ORDER BY l_extendedprice) + count(*) OVER (PARTITION BY l_extendedprice) - 1 AS ry, count(*) OVER () AS n FROM lineitem)
    SELECT sum((rx - n - 1)::HUGEINT * (ry - n - 1))::VARCHAR AS a4, count(*) AS records FROM r""",
)
def profile_spearman(t: Tables) -> DataFrame:
    return profile.spearman_a4(graded_lines(t.lineitem), "quantity", "price")


def order_history(t: Tables) -> DataFrame:
    key, placed = F.col("o_orderkey"), day("o_orderdate")
    return t.orders.select(
        "o_custkey",
        "o_orderkey",
        placed.alias("start"),
        F.when(key % 8 != 0, F.date_add(placed, (key % 400).cast("int"))).alias("stop"),
        F.col("o_orderpriority").alias("tier"),
        F.col("o_orderstatus").alias("status"),
    )


HISTORY_SQL = f"""v AS (SELECT o_custkey AS e, o_orderkey, o_orderdate::DATE AS start, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderdate::DATE + (o_orderkey % 400)::INTEGER END AS stop, o_orderpriority AS tier, o_orderstatus AS status FROM orders),
  o AS (SELECT *, row_number() OVER w AS rn, lead(start) OVER w AS nstart, lead(tier) OVER w AS ntier, lead(status) OVER w AS nstatus, lead(o_orderkey) OVER w AS nkey FROM v WINDOW w AS (PARTITION BY e ORDER BY start, stop NULLS LAST, o_orderkey)),
  n AS (SELECT e, count(*) AS n, min(start) AS first FROM v GROUP BY 1),
  cells AS (SELECT 'versionsPerEntity' AS member, ({bins_sql("n", profile.VERSION_EDGES, True)})::VARCHAR AS cell FROM n UNION ALL SELECT 'firstStart', year(first)::VARCHAR FROM n
    UNION ALL SELECT 'initial tier', tier FROM o WHERE rn = 1 UNION ALL SELECT 'initial status', status FROM o WHERE rn = 1
    UNION ALL SELECT 'versionLength', ({bins_sql("(nstart - start)", profile.LENGTH_EDGES, True)})::VARCHAR FROM o WHERE nkey IS NOT NULL
    UNION ALL SELECT 'chain', CASE WHEN stop IS NULL OR stop > nstart THEN 'overlap' WHEN stop = nstart THEN 'nextStart' WHEN stop = nstart - 1 THEN 'dayBefore' ELSE 'gap' END FROM o WHERE nkey IS NOT NULL
    UNION ALL SELECT 'reasons', CASE WHEN tier <> ntier AND status <> nstatus THEN 'several' WHEN tier <> ntier THEN 'tier' ELSE 'status' END FROM o WHERE nkey IS NOT NULL AND (tier <> ntier OR status <> nstatus)
    UNION ALL SELECT 'transitions tier', tier || ' > ' || ntier FROM o WHERE tier <> ntier UNION ALL SELECT 'transitions status', status || ' > ' || nstatus FROM o WHERE status <> nstatus
    UNION ALL SELECT 'lastVersion', CASE WHEN stop IS NULL THEN 'open' ELSE 'closed' END FROM o WHERE nkey IS NULL)"""


def history_counts(t: Tables) -> DataFrame:
    return profile.history(
        order_history(t),
        entity="o_custkey",
        start="start",
        end="stop",
        tie="o_orderkey",
        tracked={"tier": ORDER_PRIORITIES, "status": ("F", "O", "P")},
    )


@query("profile_history", f"WITH {HISTORY_SQL} SELECT member, cell, count(*) AS n FROM cells GROUP BY ALL")
def profile_history(t: Tables) -> DataFrame:
    return history_counts(t)


@query(
    "profile_facts",
    SALES
    + BANDS
    + """SELECT 'positive' AS fact, n AS covered, n - v1 AS satisfied, v1 AS violating FROM c UNION ALL SELECT 'filled_is_dated', n2, n2 - v2, v2 FROM c
    UNION ALL SELECT 'open_is_small', n3, n3 - v3, v3 FROM c UNION ALL SELECT 'few_marks', n, n - v4, v4 FROM c UNION ALL SELECT 'never', 0, 0, 0 FROM c""",
)
def profile_facts(t: Tables) -> DataFrame:
    checked = quality.run_checks(sales(t), [quality.invariant(r) for r in order_rules()])
    return checked.select(
        F.col("rule_id").alias("fact"), "covered", (F.col("covered") - F.col("violating")).alias("satisfied"), "violating"
    )


@query(
    "profile_query_rate",
    """WITH q AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R')
    SELECT o_orderpriority, count(*) FILTER (l_orderkey IS NULL) AS not_returned, count(*) FILTER (l_orderkey IS NOT NULL) AS returned FROM orders LEFT JOIN q ON o_orderkey = l_orderkey GROUP BY 1""",
)
def profile_query_rate(t: Tables) -> DataFrame:
    answer = t.lineitem.where("l_quantity > 45 AND l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return profile.query_rate(t.orders, answer, ["o_orderkey"], ["o_orderpriority"])


@query(
    "profile_document",
    f"""WITH h AS (SELECT o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT {bins_sql("o_totalprice::DECIMAL(12,2)", PRICE_EDGES)} AS low, count(*) AS n FROM orders GROUP BY 1),
    m AS (SELECT min(o_totalprice::DECIMAL(12,2)) AS lo, max(o_totalprice::DECIMAL(12,2)) AS hi, count(*) AS n FROM orders),
    e AS (SELECT 'orders.o_orderpriority.levelHistogram' AS place, '{{"count":' || n || ',"level":"' || level || '"}}' AS json FROM h
      UNION ALL SELECT 'orders.o_totalprice.marginalHistogram', '{{"count":' || coalesce(n, 0) || ',"low":' || v || '}}' FROM (VALUES {values_sql(PRICE_EDGES[:-1])}) AS x(v) LEFT JOIN b ON low = v
      UNION ALL SELECT 'orders.o_totalprice.magnitude', '{{"count":' || n || ',"max":"' || regexp_replace(regexp_replace(hi::VARCHAR, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || '","min":"' || regexp_replace(regexp_replace(lo::VARCHAR, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || '"}}' FROM m)
    SELECT place, json FROM e UNION ALL SELECT 'digest', 'sha256:' || sha256(string_agg(place || ' ' || json, chr(10) ORDER BY place || ' ' || json)) FROM e""",
)
def profile_document(t: Tables) -> DataFrame:
    n = profile.json_number(F.col("n"))
    levels = profile.level_histogram(t.orders, "o_orderpriority", ORDER_PRIORITIES)
    bins = profile.bin_histogram(t.orders, money("o_totalprice"), PRICE_EDGES)
    price = t.orders.agg(
        F.count("*").alias("n"), F.min(money("o_totalprice")).alias("lo"), F.max(money("o_totalprice")).alias("hi")
    )
    quoted = F.concat(F.lit('"'), F.col("level"), F.lit('"'))
    parts = [
        profile.entry(levels, "orders", "o_orderpriority", "levelHistogram", {"level": quoted, "count": n}),
        profile.entry(bins, "orders", "o_totalprice", "marginalHistogram", {"low": F.col("low").cast("string"), "count": n}),
        profile.entry(
            price,
            "orders",
            "o_totalprice",
            "magnitude",
            {"count": n, "min": profile.json_decimal(F.col("lo")), "max": profile.json_decimal(F.col("hi"))},
        ),
    ]
    entries = reduce(lambda a, b: a.unionByName(b), parts)
    return entries.unionByName(profile.digest(entries))
