"""Rule expressions and scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedwork.functions import grains
from deedwork.functions import rules as R
from deedwork.functions.values import day, money, rate
from deedwork.operators.joins import link_join
from deedwork.plans.registry import query
from deedwork.session import Tables
from deedwork.specs import Link


def orders_with_gaps(t: Tables) -> DataFrame:
    """Orders with a nullable amount and status: every third order is a return without an amount."""
    return t.orders.select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderkey") % 3 != 0, money("o_totalprice")).alias("amount"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"),
        day("o_orderdate").alias("placed"),
    )


GAPS = """WITH o AS (SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice::DECIMAL(12,2) END AS amount,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, o_orderdate::DATE AS placed FROM orders) """


@query(
    "rule_compare",
    GAPS
    + """SELECT o_orderkey, coalesce(amount = 100000, false) AS eq, coalesce(amount <> 100000, false) AS ne,
    coalesce(amount < 100000, false) AS lt, coalesce(amount <= 100000, false) AS le,
    coalesce(amount > 100000, false) AS gt, coalesce(amount >= 100000, false) AS ge,
    coalesce(status = 'F', false) AS filled FROM o""",
)
def rule_compare(t: Tables) -> DataFrame:
    ops = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
    return orders_with_gaps(t).select(
        "o_orderkey",
        *[R.compare(F.col("amount"), op, 100000).alias(name) for name, op in ops.items()],
        R.compare(F.col("status"), "=", "F").alias("filled"),
    )


@query(
    "rule_in_between",
    GAPS
    + """SELECT o_orderkey, coalesce(status IN ('F', 'P'), false) AS is_in,
    coalesce(status NOT IN ('F', 'P'), false) AS not_in,
    coalesce(amount BETWEEN 50000 AND 200000, false) AS is_between,
    coalesce(amount NOT BETWEEN 50000 AND 200000, false) AS not_between FROM o""",
)
def rule_in_between(t: Tables) -> DataFrame:
    status, amount = F.col("status"), F.col("amount")
    return orders_with_gaps(t).select(
        "o_orderkey",
        R.one_of(status, ["F", "P"]).alias("is_in"),
        R.one_of(status, ["F", "P", None], negated=True).alias("not_in"),
        R.between(amount, 50000, 200000).alias("is_between"),
        R.between(amount, 50000, 200000, negated=True).alias("not_between"),
    )


@query(
    "rule_null_distinct",
    GAPS
    + """SELECT o_orderkey, amount IS NULL AS no_amount, status IS NOT NULL AS has_status,
    status IS DISTINCT FROM 'F' AS not_filled, status IS NOT DISTINCT FROM 'F' AS filled FROM o""",
)
def rule_null_distinct(t: Tables) -> DataFrame:
    return orders_with_gaps(t).select(
        "o_orderkey",
        F.col("amount").isNull().alias("no_amount"),
        F.col("status").isNotNull().alias("has_status"),
        R.distinct_from(F.col("status"), "F").alias("not_filled"),
        R.distinct_from(F.col("status"), "F", negated=True).alias("filled"),
    )


@query(
    "rule_logic",
    GAPS
    + """, b AS (SELECT o_orderkey, coalesce(amount > 150000, false) AS big, coalesce(status = 'O', false) AS open FROM o)
    SELECT o_orderkey, big AND open AS big_and_open, big OR open AS big_or_open, NOT big AS not_big,
    NOT (big AND open) AS not_both FROM b""",
)
def rule_logic(t: Tables) -> DataFrame:
    big, open_ = F.col("amount") > 150000, F.col("status") == "O"
    return orders_with_gaps(t).select(
        "o_orderkey",
        R.both(big, open_).alias("big_and_open"),
        R.either(big, open_).alias("big_or_open"),
        R.negate(big).alias("not_big"),
        R.negate(R.both(big, open_)).alias("not_both"),
    )


@query(
    "rule_arith",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(12,2) AS price,
      l_discount::DECIMAL(4,2) AS disc, l_tax::DECIMAL(4,2) AS tax, (l_linenumber - 1)::BIGINT AS n,
      round(l_extendedprice * 100)::HUGEINT AS cents FROM lineitem)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (price * (1 - disc) + price * tax)::DOUBLE AS charged,
      (-price - n)::DOUBLE AS negated,
      CASE WHEN n <> 0 THEN ((2 * cents * 100 + n) // (2 * n))::DOUBLE / 10000 END AS shared FROM l""",
)
def rule_arith(t: Tables) -> DataFrame:
    price, disc, tax = money("l_extendedprice"), rate("l_discount"), rate("l_tax")
    n = (F.col("l_linenumber") - 1).cast("decimal(10,0)")
    one = F.lit(1).cast("decimal(1,0)")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        (price * (one - disc) + price * tax).alias("charged"),
        (-price - n).alias("negated"),
        R.round_away(R.divide(price, n), 4).alias("shared"),
    )


@query(
    "rule_common_decimal",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
      (l_discount::DECIMAL(4,2)::DECIMAL(38,4) = l_tax::DECIMAL(6,4)::DECIMAL(38,4)) AS same_rate,
      coalesce(CASE WHEN l_linenumber > 2 THEN l_discount::DECIMAL(38,4) END, l_extendedprice::DECIMAL(12,2)::DECIMAL(38,4))::DOUBLE AS first_known
    FROM lineitem""",
)
def rule_common_decimal(t: Tables) -> DataFrame:
    disc, tax = R.common(4, rate("l_discount"), F.col("l_tax").cast("decimal(6,4)"))
    late, price = R.common(4, F.when(F.col("l_linenumber") > 2, rate("l_discount")), money("l_extendedprice"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        R.compare(disc, "=", tax).alias("same_rate"),
        F.coalesce(late, price).alias("first_known"),
    )


@query(
    "rule_case_coalesce",
    GAPS
    + """SELECT o_orderkey, CASE WHEN amount > 200000 THEN 'large' WHEN status = 'F' THEN 'filled'
      WHEN NOT coalesce(amount > 0, false) THEN 'unpriced' ELSE 'other' END AS label,
      coalesce(amount, 0)::DOUBLE AS amount_or_zero, coalesce(status, '?') AS status_or_mark FROM o""",
)
def rule_case_coalesce(t: Tables) -> DataFrame:
    amount, status = F.col("amount"), F.col("status")
    return orders_with_gaps(t).select(
        "o_orderkey",
        R.choose(
            [(amount > 200000, "large"), (status == "F", "filled"), (R.negate(amount > 0), "unpriced")], "other"
        ).alias("label"),
        F.coalesce(amount, F.lit(0).cast("decimal(12,2)")).alias("amount_or_zero"),
        F.coalesce(status, F.lit("?")).alias("status_or_mark"),
    )


@query(
    "rule_round",
    """WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS s,
        round(l_extendedprice * 100)::BIGINT * round(l_discount * 100)::BIGINT AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (s * ((v + 50) // 100))::DOUBLE / 100 AS away,
      (s * (v // 100 + CASE WHEN v % 100 > 50 OR (v % 100 = 50 AND (v // 100) % 2 = 1) THEN 1 ELSE 0 END))::DOUBLE / 100 AS even,
      (s * ((v + 5000000) // 10000000))::DOUBLE * 1000 AS thousands
    FROM x""",
)
def rule_round(t: Tables) -> DataFrame:
    signed = F.when(F.col("l_returnflag") == "R", -money("l_extendedprice")).otherwise(money("l_extendedprice"))
    off = signed * rate("l_discount")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        R.round_away(off, 2).alias("away"),
        R.round_even(off, 2).alias("even"),
        R.round_away(off, -3).alias("thousands"),
    )


@query(
    "rule_date_diff",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_shipdate::DATE - o_orderdate::DATE)::BIGINT AS days,
      date_sub('month', o_orderdate::DATE, l_shipdate::DATE)::BIGINT AS months,
      date_sub('year', o_orderdate::DATE, l_shipdate::DATE)::BIGINT AS years,
      date_sub('month', date_trunc('month', o_orderdate)::DATE - 1, l_shipdate::DATE)::BIGINT AS from_month_end
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def rule_date_diff(t: Tables) -> DataFrame:
    placed, shipped = day("o_orderdate"), day("l_shipdate")
    month_end = F.date_sub(F.trunc(placed, "month"), 1)
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        "l_linenumber",
        R.days_between(placed, shipped).alias("days"),
        R.months_between(placed, shipped).alias("months"),
        R.years_between(placed, shipped).alias("years"),
        R.months_between(month_end, shipped).alias("from_month_end"),
    )


@query(
    "rule_date_add",
    """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 4001 - 2000 AS k, o_orderkey % 97 - 48 AS m,
        o_orderkey * 1000000000 AS far FROM orders)
    SELECT o_orderkey, (d + k::INTEGER)::VARCHAR AS days, CAST(d + to_months(m::INTEGER) AS DATE)::VARCHAR AS months,
      CAST(d + to_years((m // 12)::INTEGER) AS DATE)::VARCHAR AS years,
      CASE WHEN far BETWEEN DATE '0001-01-01' - d AND DATE '9999-12-31' - d THEN (d + far::INTEGER)::VARCHAR END AS far_days,
      CASE WHEN year(d) + o_orderkey BETWEEN 1 AND 9999 THEN CAST(d + to_years(o_orderkey::INTEGER) AS DATE)::VARCHAR END AS far_years
    FROM o""",
)
def rule_date_add(t: Tables) -> DataFrame:
    d, key = day("o_orderdate"), F.col("o_orderkey")
    m = key % 97 - 48
    return t.orders.select(
        "o_orderkey",
        R.add_days(d, key % 4001 - 2000).alias("days"),
        R.add_months(d, m).alias("months"),
        R.add_years(d, F.expr("(o_orderkey % 97 - 48) div 12")).alias("years"),
        R.add_days(d, key * 1000000000).alias("far_days"),
        R.add_years(d, key).alias("far_years"),
    )


PLACED_BY = Link("placed_by", ("o_custkey",), ("c_custkey",))


@query(
    "rule_path",
    """SELECT o_orderkey, c_mktsegment AS customer_segment, coalesce(c_acctbal::DECIMAL(12,2) > 5000, false) AS rich,
      c_custkey IS NULL AS unreached
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey""",
)
def rule_path(t: Tables) -> DataFrame:
    parents = t.customer.where("c_acctbal >= 0").withColumn("balance", money("c_acctbal"))
    reached = link_join(
        t.orders,
        parents,
        PLACED_BY,
        {"c_mktsegment": "customer_segment", "balance": "balance", "c_custkey": "reached"},
    )
    return reached.select(
        "o_orderkey",
        "customer_segment",
        R.compare(F.col("balance"), ">", 5000).alias("rich"),
        F.col("reached").isNull().alias("unreached"),
    )


@query(
    "filter_clean",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate::DATE::VARCHAR AS order_date,
      o_totalprice::DECIMAL(12,2)::DOUBLE AS amount, o_orderstatus AS status, year(o_orderdate) AS order_year
    FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_totalprice > 0
      AND o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
)
def filter_clean(t: Tables) -> DataFrame:
    return (
        t.orders.where("o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_totalprice > 0")
        .where(F.col("o_orderstatus").isin("O", "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            day("o_orderdate").alias("order_date"),
            money("o_totalprice").alias("amount"),
            F.col("o_orderstatus").alias("status"),
            F.year("o_orderdate").alias("order_year"),
        )
    )


@query(
    "fn_string",
    """SELECT p_partkey, lower(p_brand) AS low, upper(p_name) AS up, trim('  ' || p_name || ' ') AS trimmed,
      ltrim(p_brand, 'B') AS no_lead, rtrim(p_type, 'YL') AS no_tail, trim(p_type, 'SL') AS no_ends,
      length(p_name) AS len, substring(p_name, 2, 5) AS mid, concat(p_brand, '/', p_type) AS joined,
      p_brand || '-' || p_size::VARCHAR AS piped, replace(p_name, ' ', '_') AS snake,
      p_name LIKE '%ring%' AS has_ring, p_type ILIKE 'econ%' AS economy FROM part""",
)
def fn_string(t: Tables) -> DataFrame:
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t.part.select(
        "p_partkey",
        F.lower(brand).alias("low"),
        F.upper(name).alias("up"),
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.ltrim(brand, F.lit("B")).alias("no_lead"),
        F.rtrim(kind, F.lit("YL")).alias("no_tail"),
        F.trim(kind, F.lit("SL")).alias("no_ends"),
        F.length(name).alias("len"),
        F.substring(name, 2, 5).alias("mid"),
        F.concat(brand, F.lit("/"), kind).alias("joined"),
        F.expr("p_brand || '-' || CAST(p_size AS STRING)").alias("piped"),
        F.replace(name, F.lit(" "), F.lit("_")).alias("snake"),
        name.like("%ring%").alias("has_ring"),
        kind.ilike("econ%").alias("economy"),
    )


@query(
    "fn_math",
    """WITH c AS (SELECT c_custkey, c_acctbal::DECIMAL(12,2) AS b FROM customer)
    SELECT c_custkey, abs(b)::DOUBLE AS absolute, round(b, 1)::DOUBLE AS rounded, floor(b)::BIGINT AS low,
      ceil(b)::BIGINT AS high, trunc(b)::BIGINT AS cut, c_custkey % 7 AS rest, c_custkey // 7 AS whole,
      (-c_custkey) % 7 AS negative_rest FROM c""",
)
def fn_math(t: Tables) -> DataFrame:
    b, key = money("c_acctbal"), F.col("c_custkey")
    return t.customer.select(
        "c_custkey",
        F.abs(b).alias("absolute"),
        F.round(b, 1).alias("rounded"),
        F.floor(b).cast("bigint").alias("low"),
        F.ceil(b).cast("bigint").alias("high"),
        F.when(b < 0, F.ceil(b)).otherwise(F.floor(b)).cast("bigint").alias("cut"),
        (key % 7).alias("rest"),
        F.expr("c_custkey div 7").alias("whole"),
        ((-key) % 7).alias("negative_rest"),
    )


@query(
    "fn_date",
    """SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, week(ts) AS w, day(ts) AS d,
      dayofweek(ts) AS dow, dayofyear(ts) AS doy, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s,
      date_trunc('week', ts)::DATE::VARCHAR AS week_start, date_trunc('hour', ts)::TIMESTAMP::VARCHAR AS hour_start,
      (ts + INTERVAL 90 MINUTE)::VARCHAR AS later, (ts::DATE - INTERVAL 1 MONTH)::DATE::VARCHAR AS month_before,
      date_sub('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS whole_hours,
      date_diff('day', DATE '2024-01-01', ts::DATE) AS day_number FROM events""",
)
def fn_date(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        F.year(ts).alias("y"),
        F.quarter(ts).alias("q"),
        F.month(ts).alias("m"),
        F.weekofyear(ts).alias("w"),
        F.dayofmonth(ts).alias("d"),
        (F.dayofweek(ts) - 1).alias("dow"),
        F.dayofyear(ts).alias("doy"),
        F.hour(ts).alias("h"),
        F.minute(ts).alias("mi"),
        F.second(ts).alias("s"),
        F.date_trunc("week", ts).cast("date").alias("week_start"),
        F.date_trunc("hour", ts).alias("hour_start"),
        (ts + F.expr("INTERVAL 90 MINUTES")).alias("later"),
        F.add_months(ts.cast("date"), -1).alias("month_before"),
        F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").alias("whole_hours"),
        F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")).alias("day_number"),
    )


@query(
    "fn_conditional_cast",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END::BIGINT AS filled,
      if(o_totalprice > 200000, 'big', 'small') AS size, nullif(o_orderstatus, 'P') AS no_partial,
      coalesce(nullif(o_orderstatus, 'P'), 'none') AS filled_in, o_totalprice::DECIMAL(12,2)::VARCHAR AS as_text,
      try_cast(left(o_orderpriority, 1) AS BIGINT) AS priority, try_cast(o_orderpriority AS BIGINT) AS not_a_number,
      trunc(o_totalprice)::BIGINT AS whole, o_orderdate::DATE::VARCHAR AS as_date, (o_orderkey % 2 = 0) AS is_even
    FROM orders""",
)
def fn_conditional_cast(t: Tables) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.when(status == "F", 1).otherwise(0).alias("filled"),
        F.expr("if(o_totalprice > 200000, 'big', 'small')").alias("size"),
        F.nullif(status, F.lit("P")).alias("no_partial"),
        F.coalesce(F.nullif(status, F.lit("P")), F.lit("none")).alias("filled_in"),
        money(price).cast("string").alias("as_text"),
        F.left("o_orderpriority", F.lit(1)).try_cast("bigint").alias("priority"),
        F.col("o_orderpriority").try_cast("bigint").alias("not_a_number"),
        price.cast("bigint").alias("whole"),
        day("o_orderdate").alias("as_date"),
        (F.col("o_orderkey") % 2 == 0).alias("is_even"),
    )


@query(
    "fn_nested",
    """WITH e AS (SELECT vec_id, embedding, label, list_filter(embedding, lambda x: x::DOUBLE > 0.2::DOUBLE) AS high FROM embeddings)
    SELECT vec_id, len(high) > 0 AS has_high, len(high)::BIGINT AS n_high, len(embedding)::BIGINT AS dims,
      (embedding[1])::DOUBLE AS first_value, label::BIGINT AS tag,
      (CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END)::BIGINT AS positive_ends
    FROM e""",
)
def fn_nested(t: Tables) -> DataFrame:
    nested = t.embeddings.select(
        "vec_id",
        F.struct(F.col("label").alias("tag"), F.struct(F.col("embedding").alias("values")).alias("body")).alias("rec"),
        F.create_map(
            F.lit("first"), F.element_at("embedding", 1), F.lit("second"), F.element_at("embedding", 2)
        ).alias("ends"),
    )
    values = F.col("rec.body.values")
    limit = F.lit(0.2).cast("double")
    return nested.select(
        "vec_id",
        F.exists(values, lambda x: x.cast("double") > limit).alias("has_high"),
        F.size(F.filter(values, lambda x: x.cast("double") > limit)).alias("n_high"),
        F.size(values).alias("dims"),
        F.element_at("ends", "first").alias("first_value"),
        F.col("rec.tag").alias("tag"),
        F.size(F.filter(F.map_values("ends"), lambda x: x > 0)).alias("positive_ends"),
    )


@query(
    "fn_json",
    """SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
      json_extract_string(props, '$.missing') AS missing, len(json_keys(props))::BIGINT AS n_keys FROM events""",
)
def fn_json(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k_text"),
        F.from_json("props", "k BIGINT")["k"].alias("k"),
        F.get_json_object("props", "$.missing").alias("missing"),
        F.size(F.json_object_keys("props")).alias("n_keys"),
    )


SPELLED = ("per Month", "daily_grain", "HRS", "ms", "weekly", "quarterly", "per year")


@query(
    "time_grain",
    " UNION ALL ".join(
        f"SELECT '{text}' AS spelling, date_trunc('{grain}', ts)::TIMESTAMP::VARCHAR AS bucket, count(*) AS n FROM events GROUP BY ALL"
        for text, grain in zip(SPELLED, ("month", "day", "hour", "minute", "week", "quarter", "year"))
    ),
)
def time_grain(t: Tables) -> DataFrame:
    """Every spelling's buckets in one pass over the table."""
    each = F.array(
        *[F.struct(F.lit(s).alias("spelling"), grains.bucket(F.col("ts"), s).alias("bucket")) for s in SPELLED]
    )
    return (
        t.events.select(F.explode(each).alias("g"))
        .groupBy(F.col("g.spelling").alias("spelling"), F.col("g.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
