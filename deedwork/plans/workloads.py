"""End-to-end data products: cleaning, analytics, revenue, time series, RFM, VIP, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deedwork.functions.values import day, money, rate, ratio
from deedwork.plans.registry import query
from deedwork.session import Tables


@query(
    "wl_clean_customers",
    """
    SELECT c_custkey AS customer_id, upper(trim(c_name)) AS customer_name,
           lower(c_mktsegment) AS segment, c_acctbal::DECIMAL(12,2)::DOUBLE AS balance
    FROM customer WHERE c_acctbal > 0 AND c_name IS NOT NULL
    """,
)
def clean_customers(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 0 AND c_name IS NOT NULL").select(
        F.col("c_custkey").alias("customer_id"),
        F.upper(F.trim("c_name")).alias("customer_name"),
        F.lower("c_mktsegment").alias("segment"),
        money("c_acctbal").alias("balance"),
    )


def order_facts(orders: DataFrame) -> DataFrame:
    """Per customer: the order counts and revenue, pre-aggregated before any join.

    Joining after the aggregation keeps the shuffle at one row per customer and task, however
    many orders one customer has.
    """
    done = F.col("o_orderstatus") == "F"
    amount = money("o_totalprice")
    return orders.groupBy("o_custkey").agg(
        F.count("*").alias("total_orders"),
        F.count_if(done).alias("completed_orders"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"),
        F.sum(F.when(done, amount)).alias("revenue"),
        F.min(day("o_orderdate")).alias("first_order_date"),
        F.max(day("o_orderdate")).alias("last_order_date"),
    )


@query(
    "wl_customer_analytics",
    """
    SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, c.c_mktsegment AS segment,
           count(o.o_orderkey) AS total_orders,
           count(CASE WHEN o.o_orderstatus = 'F' THEN 1 END) AS completed_orders,
           count(CASE WHEN o.o_orderstatus = 'O' THEN 1 END) AS open_orders,
           coalesce(sum(CASE WHEN o.o_orderstatus = 'F' THEN o.o_totalprice::DECIMAL(12,2) END), 0)::DOUBLE
             AS total_revenue,
           coalesce(sum(CASE WHEN o.o_orderstatus = 'F' THEN o.o_totalprice::DECIMAL(12,2) END)::DOUBLE
             / nullif(count(CASE WHEN o.o_orderstatus = 'F' THEN 1 END), 0)::DOUBLE, 0) AS avg_order_value,
           min(o.o_orderdate)::DATE::VARCHAR AS first_order_date,
           max(o.o_orderdate)::DATE::VARCHAR AS last_order_date
    FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
    GROUP BY c.c_custkey, c.c_name, c.c_mktsegment
    ORDER BY total_revenue DESC, customer_id
    """,
)
def customer_analytics(t: Tables) -> DataFrame:
    facts = order_facts(t.orders)
    zero = F.lit(0).cast("bigint")
    return (
        t.customer.join(facts, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("segment"),
            F.coalesce("total_orders", zero).alias("total_orders"),
            F.coalesce("completed_orders", zero).alias("completed_orders"),
            F.coalesce("open_orders", zero).alias("open_orders"),
            F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("total_revenue"),
            F.coalesce(ratio(F.col("revenue"), F.col("completed_orders")), F.lit(0.0)).alias("avg_order_value"),
            "first_order_date",
            "last_order_date",
        )
        .orderBy(F.desc("total_revenue"), "customer_id")
    )


def monthly_revenue(orders: DataFrame) -> DataFrame:
    return (
        orders.where("o_orderstatus = 'F'")
        .groupBy("o_custkey", F.trunc(day("o_orderdate"), "month").alias("revenue_month"))
        .agg(F.sum(money("o_totalprice")).alias("monthly_amount"), F.count("*").alias("monthly_orders"))
    )


def value_segment(total) -> F.Column:
    return (
        F.when(total >= 500000, "High Value")
        .when(total >= 200000, "Medium Value")
        .when(total > 0, "Low Value")
        .otherwise("No Revenue")
    )


def engagement_level(months) -> F.Column:
    return (
        F.when(months >= 4, "Highly Engaged")
        .when(months >= 2, "Engaged")
        .when(months >= 1, "New")
        .otherwise("No Activity")
    )


@query(
    "wl_customer_revenue",
    """
    WITH m AS (
      SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS revenue_month,
             sum(o_totalprice::DECIMAL(12,2)) AS monthly_amount
      FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
    l AS (
      SELECT o_custkey, count(*) AS active_months, sum(monthly_amount) AS total_revenue,
             min(revenue_month) AS first_month, max(revenue_month) AS last_month
      FROM m GROUP BY o_custkey)
    SELECT c_custkey AS customer_id, n_name AS country,
           coalesce(total_revenue, 0)::DOUBLE AS lifetime_value,
           coalesce(total_revenue::DOUBLE / active_months::DOUBLE, 0) AS avg_monthly_revenue,
           coalesce(active_months, 0) AS active_months,
           CASE WHEN active_months >= 4 THEN 'Highly Engaged' WHEN active_months >= 2 THEN 'Engaged'
                WHEN active_months >= 1 THEN 'New' ELSE 'No Activity' END AS engagement_level,
           CASE WHEN total_revenue >= 500000 THEN 'High Value' WHEN total_revenue >= 200000 THEN 'Medium Value'
                WHEN total_revenue > 0 THEN 'Low Value' ELSE 'No Revenue' END AS value_segment,
           first_month::VARCHAR AS first_revenue_month, last_month::VARCHAR AS last_revenue_month
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l ON c_custkey = o_custkey
    """,
)
def customer_revenue(t: Tables) -> DataFrame:
    lifetime = (
        monthly_revenue(t.orders)
        .groupBy("o_custkey")
        .agg(
            F.count("*").alias("active_months"),
            F.sum("monthly_amount").alias("total_revenue"),
            F.min("revenue_month").alias("first_revenue_month"),
            F.max("revenue_month").alias("last_revenue_month"),
        )
    )
    return (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(lifetime, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("n_name").alias("country"),
            F.coalesce(F.col("total_revenue").cast("double"), F.lit(0.0)).alias("lifetime_value"),
            F.coalesce(ratio(F.col("total_revenue"), F.col("active_months")), F.lit(0.0)).alias("avg_monthly_revenue"),
            F.coalesce("active_months", F.lit(0).cast("bigint")).alias("active_months"),
            engagement_level(F.col("active_months")).alias("engagement_level"),
            value_segment(F.col("total_revenue")).alias("value_segment"),
            "first_revenue_month",
            "last_revenue_month",
        )
    )


def daily_sales(lineitem: DataFrame) -> DataFrame:
    """One row per ship date: the only input the whole-table windows below ever see."""
    qty = money("l_quantity")
    price = money("l_extendedprice")
    return lineitem.groupBy(day("l_shipdate").alias("sale_date")).agg(
        F.sum(price).alias("revenue"),
        F.sum(qty).alias("units"),
        F.countDistinct("l_partkey").alias("products"),
        F.count("*").alias("sales"),
    )


@query(
    "wl_time_series",
    """
    WITH d AS (
      SELECT l_shipdate::DATE AS sale_date, sum(l_extendedprice::DECIMAL(12,2)) AS revenue,
             sum(l_quantity::DECIMAL(12,2)) AS units, count(DISTINCT l_partkey) AS products
      FROM lineitem GROUP BY 1),
    r AS (
      SELECT *, sum(revenue) OVER w3 AS s3, count(*) OVER w3 AS n3, sum(revenue) OVER w7 AS s7,
             count(*) OVER w7 AS n7, sum(revenue) OVER w0 AS running,
             lag(revenue, 1) OVER (ORDER BY sale_date) AS prev_day, lag(revenue, 7) OVER (ORDER BY sale_date) AS prev_week
      FROM d WINDOW w3 AS (ORDER BY sale_date ROWS 2 PRECEDING), w7 AS (ORDER BY sale_date ROWS 6 PRECEDING),
                    w0 AS (ORDER BY sale_date ROWS UNBOUNDED PRECEDING))
    SELECT sale_date::VARCHAR AS sale_date, year(sale_date) AS y, month(sale_date) AS m, day(sale_date) AS d,
           dayofweek(sale_date) AS day_of_week, dayname(sale_date) AS day_name, revenue::DOUBLE AS revenue,
           units::DOUBLE AS units, products, s3::DOUBLE / n3::DOUBLE AS avg_3day, s7::DOUBLE / n7::DOUBLE AS avg_7day,
           running::DOUBLE AS running_total,
           (revenue - prev_day)::DOUBLE / nullif(prev_day, 0)::DOUBLE AS day_change,
           (revenue - prev_week)::DOUBLE / nullif(prev_week, 0)::DOUBLE AS week_change,
           CASE WHEN revenue * n7 > s7 THEN 'Above Average' WHEN revenue * n7 < s7 THEN 'Below Average'
                ELSE 'At Average' END AS trend
    FROM r ORDER BY sale_date
    """,
)
def time_series(t: Tables) -> DataFrame:
    by_day = Window.orderBy("sale_date")
    last3, last7 = by_day.rowsBetween(-2, 0), by_day.rowsBetween(-6, 0)
    revenue = F.col("revenue")
    rolled = daily_sales(t.lineitem).select(
        "*",
        F.sum("revenue").over(last3).alias("s3"),
        F.count("*").over(last3).alias("n3"),
        F.sum("revenue").over(last7).alias("s7"),
        F.count("*").over(last7).alias("n7"),
        F.sum("revenue").over(by_day.rowsBetween(Window.unboundedPreceding, 0)).alias("running_total"),
        F.lag("revenue", 1).over(by_day).alias("prev_day"),
        F.lag("revenue", 7).over(by_day).alias("prev_week"),
    )
    names = F.array(*[F.lit(d) for d in "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()])
    week = revenue * F.col("n7")
    return rolled.select(
        "sale_date",
        F.year("sale_date").alias("y"),
        F.month("sale_date").alias("m"),
        F.dayofmonth("sale_date").alias("d"),
        (F.dayofweek("sale_date") - 1).alias("day_of_week"),
        F.element_at(names, F.dayofweek("sale_date")).alias("day_name"),
        "revenue",
        "units",
        "products",
        ratio(F.col("s3"), F.col("n3")).alias("avg_3day"),
        ratio(F.col("s7"), F.col("n7")).alias("avg_7day"),
        "running_total",
        ratio(revenue - F.col("prev_day"), F.col("prev_day")).alias("day_change"),
        ratio(revenue - F.col("prev_week"), F.col("prev_week")).alias("week_change"),
        F.when(week > F.col("s7"), "Above Average")
        .when(week < F.col("s7"), "Below Average")
        .otherwise("At Average")
        .alias("trend"),
    ).orderBy("sale_date")


def sale_money(lineitem: DataFrame) -> DataFrame:
    gross, off = money("l_extendedprice"), rate("l_discount")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        day("l_shipdate").alias("sale_date"),
        money("l_quantity").alias("quantity"),
        gross.alias("gross"),
        F.round(gross * off, 2).alias("discount"),
        F.round(gross * (F.lit(1).cast("decimal(1,0)") - off), 2).alias("net"),
    )


@query(
    "wl_sales_revenue",
    """
    SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line, l_partkey AS product_id, l_suppkey AS supplier_id,
           l_shipdate::DATE::VARCHAR AS sale_date, l_quantity AS quantity,
           l_extendedprice::DECIMAL(12,2)::DOUBLE AS gross,
           round(l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(4,2), 2)::DOUBLE AS discount,
           round(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)), 2)::DOUBLE AS net
    FROM lineitem
    """,
)
def sales_revenue(t: Tables) -> DataFrame:
    return sale_money(t.lineitem)


@query(
    "wl_daily_summary",
    """
    WITH s AS (SELECT l_shipdate::DATE AS sale_date, l_orderkey, l_suppkey, l_quantity::DECIMAL(12,2) AS q,
        l_extendedprice::DECIMAL(12,2) AS gross,
        round(l_extendedprice::DECIMAL(12,2) * l_discount::DECIMAL(4,2), 2) AS discount,
        round(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)), 2) AS net FROM lineitem)
    SELECT sale_date::VARCHAR AS sale_date, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers,
           sum(q)::DOUBLE AS units, sum(gross)::DOUBLE AS gross, sum(discount)::DOUBLE AS discounts,
           sum(net)::DOUBLE AS net, sum(net)::DOUBLE / count(*)::DOUBLE AS avg_sale
    FROM s GROUP BY 1
    """,
)
def daily_summary(t: Tables) -> DataFrame:
    """Sums and the two distinct counts apart: counted together, every row would be copied per count."""
    lines = sale_money(t.lineitem)
    sums = lines.groupBy("sale_date").agg(
        F.sum("quantity").alias("units"),
        F.sum("gross").alias("gross"),
        F.sum("discount").alias("discounts"),
        F.sum("net").alias("net"),
        ratio(F.sum("net"), F.count("*")).alias("avg_sale"),
    )

    def distinct_per_day(column: str, name: str) -> DataFrame:
        return lines.groupBy("sale_date").agg(F.countDistinct(column).alias(name))

    return sums.join(distinct_per_day("order_id", "orders"), "sale_date").join(
        distinct_per_day("supplier_id", "suppliers"), "sale_date"
    )


def rfm_master(t: Tables) -> DataFrame:
    """Stages one to four: base, purchases, engagement, scores."""
    newest = t.orders.agg(F.max(day("o_orderdate")).alias("ref"))
    base = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"),
        F.lower(F.trim("c_name")).alias("name"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("industry"),
    )
    purchases = t.orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.count("*").alias("frequency"),
        F.sum(money("o_totalprice")).alias("monetary"),
        F.max(day("o_orderdate")).alias("last_purchase"),
    )
    engagement = t.events.groupBy(F.col("user_id").alias("customer_id")).agg(
        F.count("*").alias("interactions"),
        F.count_if(F.col("event_type") == "error").alias("support_interactions"),
    )
    zero = F.lit(0).cast("bigint")
    calc = (
        base.join(purchases, "customer_id", "left")
        .join(engagement, "customer_id", "left")
        .select(
            "customer_id",
            "name",
            "country",
            "industry",
            F.coalesce(F.datediff(newest.scalar(), F.col("last_purchase")), F.lit(9999)).alias("recency_days"),
            F.coalesce("frequency", zero).alias("frequency"),
            F.coalesce("monetary", F.lit(0).cast("decimal(22,2)")).alias("monetary"),
            F.coalesce("interactions", zero).alias("interactions"),
            F.coalesce("support_interactions", zero).alias("support_interactions"),
        )
    )

    def score(c: str, steps: list[int], up: bool) -> F.Column:
        out = F.lit(1)
        for points, step in zip((2, 3, 4, 5), reversed(steps)):
            out = F.when(F.col(c) >= step if up else F.col(c) <= step, points).otherwise(out)
        return out

    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    scored = calc.select(
        "*",
        score("recency_days", [30, 60, 90, 180], up=False).alias("r_score"),
        score("frequency", [10, 5, 3, 1], up=True).alias("f_score"),
        score("monetary", [5000000, 2000000, 1000000, 500000], up=True).alias("m_score"),
    )
    return scored.select(
        "customer_id",
        "name",
        "country",
        "industry",
        "recency_days",
        "frequency",
        "monetary",
        F.concat(r.cast("string"), f.cast("string"), m.cast("string")).alias("rfm_score"),
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal Customers")
        .when((r >= 4) & (f <= 2), "Promising")
        .when((r <= 2) & (f >= 3), "At Risk")
        .when((r <= 2) & (f <= 2), "Lost")
        .otherwise("Potential Loyalists")
        .alias("customer_segment"),
        (F.col("monetary") * (F.lit(10).cast("bigint") + F.col("frequency"))).alias("lifetime_value_x10"),
        F.when(F.col("interactions") >= 5, "High")
        .when(F.col("interactions") >= 2, "Medium")
        .otherwise("Low")
        .alias("engagement_level"),
        F.when((F.col("recency_days") > 180) & (F.col("frequency") <= 2), "High")
        .when((F.col("recency_days") > 90) & (F.col("frequency") <= 3), "Medium")
        .otherwise("Low")
        .alias("churn_risk"),
    )


@query(
    "wl_rfm",
    """
    WITH p AS (SELECT o_custkey, count(*) AS frequency, sum(o_totalprice::DECIMAL(12,2)) AS monetary,
                      max(o_orderdate)::DATE AS last_purchase FROM orders GROUP BY 1),
    e AS (SELECT user_id, count(*) AS interactions FROM events GROUP BY 1),
    c AS (SELECT c_custkey AS customer_id, lower(trim(c_name)) AS name, n_name AS country, c_mktsegment AS industry,
                 coalesce(date_diff('day', last_purchase, (SELECT max(o_orderdate)::DATE FROM orders)), 9999) AS recency_days,
                 coalesce(frequency, 0) AS frequency, coalesce(monetary, 0) AS monetary,
                 coalesce(interactions, 0) AS interactions
          FROM customer JOIN nation ON c_nationkey = n_nationkey
          LEFT JOIN p ON c_custkey = o_custkey LEFT JOIN e ON c_custkey = user_id),
    s AS (SELECT *, CASE WHEN recency_days <= 30 THEN 5 WHEN recency_days <= 60 THEN 4 WHEN recency_days <= 90 THEN 3
                         WHEN recency_days <= 180 THEN 2 ELSE 1 END AS r,
                 CASE WHEN frequency >= 10 THEN 5 WHEN frequency >= 5 THEN 4 WHEN frequency >= 3 THEN 3
                      WHEN frequency >= 1 THEN 2 ELSE 1 END AS f,
                 CASE WHEN monetary >= 5000000 THEN 5 WHEN monetary >= 2000000 THEN 4 WHEN monetary >= 1000000 THEN 3
                      WHEN monetary >= 500000 THEN 2 ELSE 1 END AS m FROM c),
    master AS (SELECT *, r::VARCHAR || f::VARCHAR || m::VARCHAR AS rfm_score,
        CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champions' WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'Loyal Customers'
             WHEN r >= 4 AND f <= 2 THEN 'Promising' WHEN r <= 2 AND f >= 3 THEN 'At Risk'
             WHEN r <= 2 AND f <= 2 THEN 'Lost' ELSE 'Potential Loyalists' END AS customer_segment,
        CASE WHEN interactions >= 5 THEN 'High' WHEN interactions >= 2 THEN 'Medium' ELSE 'Low' END AS engagement_level,
        CASE WHEN recency_days > 180 AND frequency <= 2 THEN 'High' WHEN recency_days > 90 AND frequency <= 3 THEN 'Medium'
             ELSE 'Low' END AS churn_risk FROM s)
    SELECT customer_id, name, country, industry, rfm_score, customer_segment,
           (monetary * (10 + frequency))::DOUBLE AS lifetime_value_x10, engagement_level, churn_risk
    FROM master WHERE customer_segment IN ('Champions', 'Loyal Customers', 'At Risk') AND churn_risk = 'Low'
    """,
)
def rfm(t: Tables) -> DataFrame:
    """Stage five: the customers worth keeping."""
    return (
        rfm_master(t)
        .where(F.col("customer_segment").isin("Champions", "Loyal Customers", "At Risk") & (F.col("churn_risk") == "Low"))
        .drop("recency_days", "frequency", "monetary")
    )


@query(
    "wl_vip",
    """
    WITH r AS (SELECT c_custkey AS customer_id, c_name AS customer_name, count(o_orderkey) AS total_orders,
                      coalesce(sum(o_totalprice::DECIMAL(12,2)), 0) AS total_revenue
               FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
    s AS (SELECT *, CASE WHEN total_revenue >= 3000000 THEN 'Platinum' WHEN total_revenue >= 2000000 THEN 'Gold'
                WHEN total_revenue >= 1000000 THEN 'Silver' WHEN total_revenue > 0 THEN 'Bronze'
                ELSE 'No Purchases' END AS customer_tier FROM r)
    SELECT customer_id, customer_name, total_orders, total_revenue::DOUBLE AS total_revenue,
           coalesce(total_revenue::DOUBLE / nullif(total_orders, 0)::DOUBLE, 0) AS avg_order_value, customer_tier
    FROM s WHERE customer_tier IN ('Platinum', 'Gold')
    """,
)
def vip(t: Tables) -> DataFrame:
    spent = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("total_orders"), F.sum(money("o_totalprice")).alias("total_revenue")
    )
    total = F.col("total_revenue")
    revenue = t.customer.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.coalesce("total_orders", F.lit(0).cast("bigint")).alias("total_orders"),
        F.coalesce(total, F.lit(0).cast("decimal(22,2)")).alias("total_revenue"),
        F.coalesce(ratio(total, F.col("total_orders")), F.lit(0.0)).alias("avg_order_value"),
        F.when(total >= 3000000, "Platinum")
        .when(total >= 2000000, "Gold")
        .when(total >= 1000000, "Silver")
        .when(total > 0, "Bronze")
        .otherwise("No Purchases")
        .alias("customer_tier"),
    )
    return revenue.where(F.col("customer_tier").isin("Platinum", "Gold"))


@query(
    "wl_region_summary",
    """
    SELECT upper(r_name) AS region, count(*) AS total_sales, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total_revenue,
           sum(o_totalprice::DECIMAL(12,2))::DOUBLE / count(*)::DOUBLE AS avg_sale
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 0
    GROUP BY 1 ORDER BY total_revenue DESC
    """,
)
def region_summary(t: Tables) -> DataFrame:
    """Sales are summed per customer first, so the joins see one row per customer."""
    cleaned = t.orders.where("o_totalprice > 0")
    per_customer = cleaned.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("revenue")
    )
    places = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.upper("r_name").alias("region"))
    )
    return (
        per_customer.join(places, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("region")
        .agg(
            F.sum("n").alias("total_sales"),
            F.sum("revenue").alias("total_revenue"),
            ratio(F.sum("revenue"), F.sum("n")).alias("avg_sale"),
        )
        .orderBy(F.desc("total_revenue"))
    )
