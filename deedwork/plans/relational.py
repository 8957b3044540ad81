"""Joins, aggregates, windows, order and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deedwork.functions.values import day, money, ratio
from deedwork.operators import joins, slices, windows
from deedwork.plans.registry import query
from deedwork.session import Tables
from deedwork.specs import Link
from deedwork.specs import Window as Validity

# Every customer's orders, in date order, are the versions of that customer.
VERSIONS_SQL = """versions AS (SELECT o_custkey, o_orderdate::DATE AS start, o_orderpriority AS tier, o_orderstatus AS status
  FROM orders)"""
LIVE_SQL = """ordered AS (SELECT *, lead(start) OVER (PARTITION BY o_custkey ORDER BY start) AS following,
    count(*) OVER (PARTITION BY o_custkey, start) AS matches FROM versions)"""
SHIPPED_SQL = """shipped AS (SELECT l_orderkey, l_linenumber, o_custkey AS custkey, l_shipdate::DATE AS shipped
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def customer_versions(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_custkey", day("o_orderdate").alias("start"), F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("status")
    )


def shipped_lines(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", F.col("o_custkey").alias("custkey"), day("l_shipdate").alias("shipped")
    )


@query(
    "join_inner",
    """SELECT o_orderkey, c_mktsegment AS segment, CASE WHEN c_mktsegment = 'MACHINERY' OR o_totalprice > 400000 THEN 0.8
      ELSE 0.2 END::DOUBLE AS churn_risk FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def join_inner(t: Tables) -> DataFrame:
    risky = (F.col("c_mktsegment") == "MACHINERY") | (F.col("o_totalprice") > 400000)
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_mktsegment").alias("segment"), F.when(risky, 0.8).otherwise(0.2).alias("churn_risk")
    )


@query(
    "join_left_agg",
    """SELECT c_custkey, count(o_orderkey) AS orders, count(CASE WHEN o_totalprice > 300000 THEN 1 END) AS large_orders,
      coalesce(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice::DECIMAL(12,2) END), 0)::DOUBLE AS urgent_value
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY c_custkey""",
)
def join_left_agg(t: Tables) -> DataFrame:
    per_customer = (
        t.orders.where("o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00'")
        .groupBy("o_custkey")
        .agg(
            F.count("*").alias("orders"),
            F.count_if(F.col("o_totalprice") > 300000).alias("large_orders"),
            F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", money("o_totalprice"))).alias("urgent_value"),
        )
    )
    return (
        t.customer.select("c_custkey")
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .drop("o_custkey")
        .na.fill(0)
        .withColumn("urgent_value", F.coalesce(F.col("urgent_value").cast("double"), F.lit(0.0)))
    )


@query(
    "join_right_full_cross",
    """WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1),
    s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1),
    o AS (SELECT n_regionkey, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT 'right' AS form, s.k::VARCHAR AS a, NULL::VARCHAR AS b, customers AS left_n, suppliers AS right_n FROM c RIGHT JOIN s ON c.k = s.k
    UNION ALL SELECT 'full', coalesce(c.k, s.k)::VARCHAR, NULL, customers, suppliers FROM c FULL JOIN s ON c.k = s.k
    UNION ALL SELECT 'cross', r_name, p, NULL, coalesce(n, 0) FROM region
      CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) AS v(p)
      LEFT JOIN o ON o.n_regionkey = r_regionkey AND o.o_orderpriority = p""",
)
def join_right_full_cross(t: Tables) -> DataFrame:
    """The cross product is a table against a declared list of levels, so it is an explode."""
    left = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("left_n"))
    right = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("right_n"))
    none = F.lit(None).cast("string")

    def shaped(df: DataFrame, form: str) -> DataFrame:
        return df.select(F.lit(form).alias("form"), F.col("k").cast("string").alias("a"), none.alias("b"), "left_n", "right_n")

    counted = (
        t.orders.groupBy("o_custkey", "o_orderpriority")
        .agg(F.count("*").alias("n"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_regionkey").alias("r_regionkey"), F.col("o_orderpriority").alias("b"))
        .agg(F.sum("n").alias("n"))
    )
    cross = (
        windows.with_levels(t.region, "b", ORDER_PRIORITIES)
        .join(counted, ["r_regionkey", "b"], "left")
        .select(
            F.lit("cross").alias("form"),
            F.col("r_name").alias("a"),
            "b",
            F.lit(None).cast("bigint").alias("left_n"),
            F.coalesce("n", F.lit(0)).alias("right_n"),
        )
    )
    return (
        shaped(left.join(right, "k", "right"), "right")
        .unionByName(shaped(left.join(right, "k", "full"), "full"))
        .unionByName(cross)
    )


ORDER_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "join_theta",
    """WITH q AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS first, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH)::DATE AS next,
      sum(o_totalprice::DECIMAL(12,2)) AS total, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_orderkey, first::VARCHAR AS quarter FROM orders JOIN q ON o_orderdate::DATE >= first AND o_orderdate::DATE < next
      AND o_totalprice::DECIMAL(12,2) * n > total""",
)
def join_theta(t: Tables) -> DataFrame:
    """Orders above the mean of the quarter they fall in: two range tests and a comparison."""
    quarters = (
        t.orders.groupBy(F.trunc(day("o_orderdate"), "quarter").alias("first"))
        .agg(F.sum(money("o_totalprice")).alias("total"), F.count("*").alias("n"))
        .withColumn("next", F.add_months("first", 3))
    )
    points = t.orders.select("o_orderkey", day("o_orderdate").alias("placed"), money("o_totalprice").alias("price"))
    return joins.interval_join(
        points,
        quarters,
        point="placed",
        low="first",
        high="next",
        unit="month",
        extra=F.col("price") * F.col("n") > F.col("total"),
    ).select("o_orderkey", F.col("first").alias("quarter"))


@query(
    "join_semi_exists",
    """SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
      AND c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))""",
)
def join_semi_exists(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 400000")
    regions = t.region.where(F.col("r_name").isin("ASIA", "EUROPE"))
    nations = t.nation.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return (
        t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
        .select("c_custkey", "c_mktsegment")
    )


@query(
    "join_anti_reference",
    """SELECT count(DISTINCT l_partkey) AS values, count(*) AS rows FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 40)""",
)
def join_anti_reference(t: Tables) -> DataFrame:
    return joins.orphans(t.lineitem, t.part.where("p_size < 40"), "l_partkey", "p_partkey")


@query(
    "join_as_of_version",
    f"""WITH {VERSIONS_SQL}, {LIVE_SQL}, {SHIPPED_SQL}
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, shipped::VARCHAR AS shipped, tier, status
    FROM shipped LEFT JOIN ordered ON custkey = o_custkey AND matches = 1 AND start <= shipped AND (following IS NULL OR shipped < following)""",
)
def join_as_of_version(t: Tables) -> DataFrame:
    return joins.as_of_join(
        shipped_lines(t),
        customer_versions(t),
        fact_key=["custkey"],
        version_key=["o_custkey"],
        fact_date="shipped",
        window=Validity("start"),
        attributes=["tier", "status"],
    ).drop("custkey")


@query(
    "as_of_governed",
    f"""WITH versions AS (SELECT o_custkey, o_orderdate::DATE AS start, o_orderpriority AS tier,
        CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE + (o_orderkey % 200)::INTEGER END AS stop FROM orders WHERE o_orderstatus <> 'P'),
    live AS (SELECT * FROM versions WHERE stop IS NULL OR start <= stop),
    ordered AS (SELECT *, lead(start) OVER (PARTITION BY o_custkey ORDER BY start) AS following,
        count(*) OVER (PARTITION BY o_custkey, start) AS matches FROM live), {SHIPPED_SQL}
    SELECT tier, count(*) AS lines, count(DISTINCT custkey) AS customers FROM shipped LEFT JOIN ordered ON custkey = o_custkey
      AND matches = 1 AND start <= shipped AND (following IS NULL OR shipped < following) AND (stop IS NULL OR shipped <= stop)
    GROUP BY tier""",
)
def as_of_governed(t: Tables) -> DataFrame:
    """Versions the reader may not see are dropped first: they neither match nor end another one."""
    key = F.col("o_orderkey")
    start = day("o_orderdate")
    versions = t.orders.where("o_orderstatus <> 'P'").select(
        "o_custkey",
        start.alias("start"),
        F.col("o_orderpriority").alias("tier"),
        F.when(key % 4 != 0, F.date_add(start, (key % 200).cast("int"))).alias("stop"),
    )
    return (
        joins.as_of_join(
            shipped_lines(t),
            versions,
            fact_key=["custkey"],
            version_key=["o_custkey"],
            fact_date="shipped",
            window=Validity("start", "stop", closed=True),
            attributes=["tier"],
        )
        .groupBy("tier")
        .agg(F.count("*").alias("lines"), F.countDistinct("custkey").alias("customers"))
    )


@query(
    "join_by_entity",
    """WITH v AS (SELECT DISTINCT o_custkey, c_mktsegment AS segment, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT event_id, segment, nation::BIGINT AS nation FROM events LEFT JOIN v ON user_id = o_custkey""",
)
def join_by_entity(t: Tables) -> DataFrame:
    versions = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_custkey", "o_orderdate", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")
    )
    entities = joins.one_row_per_entity(versions, ["o_custkey"], ["segment", "nation"])
    return t.events.join(entities, F.col("user_id") == F.col("o_custkey"), "left").select("event_id", "segment", "nation")


@query(
    "link_assignment",
    """WITH child AS (SELECT l_orderkey, CASE WHEN l_linenumber <> 3 THEN l_linestatus END AS l_linestatus FROM lineitem)
    SELECT o_orderpriority AS grp, count(*) AS children FROM child LEFT JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus
    GROUP BY 1""",
)
def link_assignment(t: Tables) -> DataFrame:
    child = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") != 3, F.col("l_linestatus")).alias("l_linestatus"))
    link = Link("line_of", ("l_orderkey", "l_linestatus"), ("o_orderkey", "o_orderstatus"))
    return joins.link_join(child, t.orders, link, {"o_orderpriority": "grp"}).groupBy("grp").agg(F.count("*").alias("children"))


# -- aggregates ---------------------------------------------------------------------


@query(
    "agg_basic",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS quantity,
      sum(l_extendedprice::DECIMAL(12,2))::DOUBLE / count(*)::DOUBLE AS avg_price, min(l_extendedprice) AS low, max(l_extendedprice) AS high
    FROM lineitem GROUP BY ALL""",
)
def agg_basic(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.sum(money("l_quantity")).alias("quantity"),
        ratio(F.sum(money("l_extendedprice")), F.count("*")).alias("avg_price"),
        F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"),
    )


@query(
    "agg_spread",
    """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sd_pop,
      round(var_samp(l_quantity), 6) AS var, round(var_pop(l_quantity), 6) AS var_of_all FROM lineitem GROUP BY 1""",
)
def agg_spread(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"),
        F.round(F.stddev_pop("l_quantity"), 6).alias("sd_pop"),
        F.round(F.var_samp("l_quantity"), 6).alias("var"),
        F.round(F.var_pop("l_quantity"), 6).alias("var_of_all"),
    )


@query(
    "agg_distinct",
    """SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts,
      (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)) AS flag_pairs FROM lineitem GROUP BY 1""",
)
def agg_distinct(t: Tables) -> DataFrame:
    pairs = t.lineitem.select("l_returnflag", "l_linestatus").distinct().agg(F.count("*").alias("n"))
    return (
        t.lineitem.groupBy("l_returnflag")
        .agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))
        .withColumn("flag_pairs", pairs.scalar())
    )


@query(
    "agg_conditional",
    """SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS filled, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::DECIMAL(12,2) ELSE 0 END)::DOUBLE AS open_value,
      sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(12,2) END)::DOUBLE / nullif(count(CASE WHEN o_orderstatus = 'F' THEN 1 END), 0)::DOUBLE AS avg_filled
    FROM orders GROUP BY 1""",
)
def agg_conditional(t: Tables) -> DataFrame:
    price, status = money("o_totalprice"), F.col("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg(
        F.count_if(status == "F").alias("filled"),
        F.sum(F.when(status == "O", price).otherwise(0)).alias("open_value"),
        ratio(F.sum(F.when(status == "F", price)), F.count_if(status == "F")).alias("avg_filled"),
    )


@query(
    "agg_having",
    """SELECT o_custkey, count(*) AS orders, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total FROM orders GROUP BY 1
    HAVING count(*) > 10 AND sum(o_totalprice::DECIMAL(12,2)) > 2500000""",
)
def agg_having(t: Tables) -> DataFrame:
    return (
        t.orders.groupBy("o_custkey")
        .agg(F.count("*").alias("orders"), F.sum(money("o_totalprice")).alias("total"))
        .where("orders > 10 AND total > 2500000")
    )


@query(
    "agg_two_level",
    """WITH m AS (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS m, sum(l_extendedprice::DECIMAL(12,2)) AS v FROM lineitem GROUP BY ALL)
    SELECT s_suppkey, s_name, coalesce(count(m), 0) AS months, coalesce(sum(v), 0)::DOUBLE AS total, max(v)::DOUBLE AS best_month,
      CASE WHEN sum(v) >= 25000000 THEN 'large' WHEN sum(v) > 0 THEN 'small' ELSE 'none' END AS segment
    FROM supplier LEFT JOIN m ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name""",
)
def agg_two_level(t: Tables) -> DataFrame:
    monthly = t.lineitem.groupBy("l_suppkey", F.trunc(day("l_shipdate"), "month").alias("m")).agg(
        F.sum(money("l_extendedprice")).alias("v")
    )
    lifetime = monthly.groupBy("l_suppkey").agg(
        F.count("*").alias("months"), F.sum("v").alias("total"), F.max("v").alias("best_month")
    )
    total = F.col("total")
    return t.supplier.join(lifetime, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        "s_suppkey",
        "s_name",
        F.coalesce("months", F.lit(0)).alias("months"),
        F.coalesce(total.cast("double"), F.lit(0.0)).alias("total"),
        "best_month",
        F.when(total >= 25000000, "large").when(total > 0, "small").otherwise("none").alias("segment"),
    )


@query(
    "agg_capped",
    """WITH u AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_orderpriority AS cell, sum(least(n, 2))::BIGINT AS capped, sum(n)::BIGINT AS uncapped FROM u GROUP BY 1""",
)
def agg_capped(t: Tables) -> DataFrame:
    return windows.capped_counts(t.orders, ["o_custkey"], ["o_orderpriority"], 2).withColumnRenamed("o_orderpriority", "cell")


# -- windows ------------------------------------------------------------------------


@query(
    "win_ranking",
    """SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)) WHERE rn <= 5""",
)
def win_ranking(t: Tables) -> DataFrame:
    """The best five of each customer. The bound lets every task drop the rest before the shuffle."""
    by = Window.partitionBy("o_custkey")
    best = t.orders.select(
        "o_custkey",
        "o_orderkey",
        "o_orderpriority",
        F.row_number().over(by.orderBy("o_orderpriority", "o_orderkey")).alias("rn"),
    ).where("rn <= 5")
    ties = by.orderBy("o_orderpriority")
    return best.select("o_custkey", "o_orderkey", "rn", F.rank().over(ties).alias("rk"), F.dense_rank().over(ties).alias("dr"))


@query(
    "win_aggregate",
    """SELECT o_orderkey, o_custkey, count(*) OVER w AS orders, sum(o_totalprice::DECIMAL(12,2)) OVER w::DOUBLE AS total,
      o_totalprice::DECIMAL(12,2)::DOUBLE / (sum(o_totalprice::DECIMAL(12,2)) OVER w)::DOUBLE AS share, max(o_totalprice) OVER w AS largest
    FROM orders WINDOW w AS (PARTITION BY o_custkey)""",
)
def win_aggregate(t: Tables) -> DataFrame:
    price = money("o_totalprice")
    return windows.beside_group(
        t.orders.select("o_orderkey", "o_custkey", price.alias("price"), "o_totalprice"),
        ["o_custkey"],
        {"orders": F.count("*"), "total": F.sum("price"), "largest": F.max("o_totalprice")},
    ).select("o_orderkey", "o_custkey", "orders", "total", ratio(F.col("price"), F.col("total")).alias("share"), "largest")


@query(
    "win_rolling",
    """WITH d AS (SELECT l_returnflag AS flag, l_shipdate::DATE AS d, sum(l_extendedprice::DECIMAL(12,2)) AS v FROM lineitem GROUP BY ALL)
    SELECT flag, d::VARCHAR AS d, sum(v) OVER (w ROWS 2 PRECEDING)::DOUBLE / count(*) OVER (w ROWS 2 PRECEDING)::DOUBLE AS avg3,
      sum(v) OVER (w ROWS 6 PRECEDING)::DOUBLE / count(*) OVER (w ROWS 6 PRECEDING)::DOUBLE AS avg7,
      sum(v) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE AS running FROM d WINDOW w AS (PARTITION BY flag ORDER BY d)""",
)
def win_rolling(t: Tables) -> DataFrame:
    """Rolling windows run over daily totals: a partition has at most one row per calendar day."""
    daily = t.lineitem.groupBy(F.col("l_returnflag").alias("flag"), day("l_shipdate").alias("d")).agg(
        F.sum(money("l_extendedprice")).alias("v")
    )
    w = Window.partitionBy("flag").orderBy("d")
    w3, w7 = w.rowsBetween(-2, 0), w.rowsBetween(-6, 0)
    return daily.select(
        "flag",
        "d",
        ratio(F.sum("v").over(w3), F.count("*").over(w3)).alias("avg3"),
        ratio(F.sum("v").over(w7), F.count("*").over(w7)).alias("avg7"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"),
    )


@query(
    "win_lag",
    """WITH d AS (SELECT o_orderdate::DATE AS d, sum(o_totalprice::DECIMAL(12,2)) AS v FROM orders GROUP BY 1),
    l AS (SELECT *, lag(v, 1) OVER (ORDER BY d) AS p1, lag(v, 7) OVER (ORDER BY d) AS p7 FROM d)
    SELECT d::VARCHAR AS d, v::DOUBLE AS v, p1::DOUBLE AS p1, p7::DOUBLE AS p7, (100 * (v - p1))::DOUBLE / p1::DOUBLE AS pct,
      CASE WHEN v > p1 THEN 'up' WHEN v < p1 THEN 'down' WHEN p1 IS NULL THEN 'first' ELSE 'flat' END AS trend FROM l""",
)
def win_lag(t: Tables) -> DataFrame:
    daily = t.orders.groupBy(day("o_orderdate").alias("d")).agg(F.sum(money("o_totalprice")).alias("v"))
    w = Window.orderBy("d")
    v, p1 = F.col("v"), F.col("p1")
    return daily.select("d", "v", F.lag("v", 1).over(w).alias("p1"), F.lag("v", 7).over(w).alias("p7")).select(
        "d",
        "v",
        "p1",
        "p7",
        ratio(F.lit(100) * (v - p1), p1).alias("pct"),
        F.when(v > p1, "up").when(v < p1, "down").when(p1.isNull(), "first").otherwise("flat").alias("trend"),
    )


@query(
    "win_next_version",
    f"""WITH {VERSIONS_SQL}, s AS (SELECT o_custkey, start, count(*) AS matches FROM versions GROUP BY ALL)
    SELECT o_custkey, start::VARCHAR AS start, matches, lead(start) OVER (PARTITION BY o_custkey ORDER BY start)::VARCHAR AS following FROM s""",
)
def win_next_version(t: Tables) -> DataFrame:
    starts = customer_versions(t).groupBy("o_custkey", "start").agg(F.count("*").alias("matches"))
    return slices.next_in_order(starts, ["o_custkey"], "start", "following")


@query(
    "win_mid_rank",
    """WITH o AS (SELECT o_orderkey, floor(o_totalprice / 1000)::BIGINT AS price_band FROM orders)
    SELECT o_orderkey, price_band, 2 * rank() OVER (ORDER BY price_band) + count(*) OVER (PARTITION BY price_band) - 1 AS mid_rank_x2 FROM o""",
)
def win_mid_rank(t: Tables) -> DataFrame:
    bands = t.orders.select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("price_band"))
    ranks = slices.mid_ranks(slices.value_counts(bands, "price_band"), "price_band").select("price_band", "mid_rank_x2")
    return bands.join(ranks, "price_band")


# -- order, limits and set operations -------------------------------------------------


@query(
    "sort_nulls",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority,
      CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders ORDER BY priority DESC NULLS LAST, price ASC NULLS FIRST, o_orderkey""",
)
def sort_nulls(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        F.when(key % 7 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(key % 5 != 0, F.col("o_totalprice")).alias("price"),
    ).orderBy(F.desc_nulls_last("priority"), F.asc_nulls_first("price"), "o_orderkey")


@query(
    "topk_total_order",
    """WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_custkey FROM orders),
    top AS (SELECT * FROM d ORDER BY d DESC, o_orderkey LIMIT 20 OFFSET 5),
    edge AS (SELECT min(d) AS d FROM top)
    SELECT o_orderkey, d::VARCHAR AS d, o_custkey,
      (SELECT count(*) FROM d WHERE d = (SELECT d FROM edge)) - (SELECT count(*) FROM (SELECT * FROM d ORDER BY d DESC, o_orderkey LIMIT 25) WHERE d = (SELECT d FROM edge)) AS tied_outside
    FROM top""",
)
def topk_total_order(t: Tables) -> DataFrame:
    placed = t.orders.select("o_orderkey", day("o_orderdate").alias("d"), "o_custkey")
    return windows.top_rows(placed, [F.desc("d")], key=["o_orderkey"], limit=20, offset=5, tie_column="d")


def nation_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    customers = t.customer.select(F.col("c_nationkey").cast("bigint").alias("k"))
    suppliers = t.supplier.select(F.col("s_nationkey").cast("bigint").alias("k"))
    return customers, suppliers


NATION_SIDES = """WITH a AS (SELECT c_nationkey::BIGINT AS k FROM customer),
  b AS (SELECT s_nationkey::BIGINT AS k FROM supplier) """


@query(
    "set_union",
    NATION_SIDES
    + """SELECT 'distinct' AS form, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'all', k FROM (SELECT k FROM a UNION ALL SELECT k FROM b)""",
)
def set_union(t: Tables) -> DataFrame:
    a, b = nation_sides(t)
    return windows.labelled({"distinct": a.union(b).distinct(), "all": a.union(b)}, "form")


@query(
    "set_intersect",
    NATION_SIDES
    + """SELECT 'distinct' AS form, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'all', k FROM (SELECT k FROM a INTERSECT ALL SELECT k FROM b)""",
)
def set_intersect(t: Tables) -> DataFrame:
    a, b = nation_sides(t)
    return windows.labelled({"distinct": a.intersect(b), "all": a.intersectAll(b)}, "form")


@query(
    "set_except",
    NATION_SIDES
    + """SELECT 'distinct' AS form, k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'all', k FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)""",
)
def set_except(t: Tables) -> DataFrame:
    a, b = nation_sides(t)
    return windows.labelled({"distinct": a.subtract(b), "all": a.exceptAll(b)}, "form")


@query(
    "cte_subquery",
    """WITH per AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(12,2)) AS total, max(o_orderdate)::DATE AS newest FROM orders GROUP BY 1)
    SELECT o_custkey, total::DOUBLE AS total, date_diff('day', newest, (SELECT max(o_orderdate)::DATE FROM orders)) AS days_quiet
    FROM per WHERE total * (SELECT count(*) FROM per) > (SELECT sum(total) FROM per)
      AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def cte_subquery(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(
        F.sum(money("o_totalprice")).alias("total"), F.max(day("o_orderdate")).alias("newest")
    )
    count, total = per.agg(F.count("*").alias("n")), per.agg(F.sum("total").alias("s"))
    reference = t.orders.agg(F.max(day("o_orderdate")).alias("d"))
    solvent = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return (
        per.where(F.col("total") * count.scalar() > total.scalar())
        .join(solvent, "o_custkey", "left_semi")
        .select("o_custkey", "total", F.datediff(reference.scalar(), F.col("newest")).alias("days_quiet"))
    )
