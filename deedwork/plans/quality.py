"""Data-quality rules, gates, conformance, anomalies and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedwork.functions import rules as R
from deedwork.functions.masks import identifier_regex
from deedwork.functions.values import day, money
from deedwork.operators import anomaly, conformance, joins, quality, slices
from deedwork.plans.registry import query
from deedwork.plans.relational import ORDER_PRIORITIES, customer_versions
from deedwork.session import Tables
from deedwork.specs import Band, ColumnSpec, Link, Rule, TableSpec


def sales(t: Tables) -> DataFrame:
    """Orders with faults: some amounts, dates and customers are missing or out of range."""
    key = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        F.when(key % 11 != 0, F.col("o_custkey")).alias("custkey"),
        F.when(key % 13 != 0, day("o_orderdate")).alias("placed"),
        F.when(key % 17 == 0, -money("o_totalprice")).otherwise(money("o_totalprice")).alias("amount"),
        F.when(key % 19 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("at"),
    )


SALES = """WITH sales AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS custkey,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate::DATE END AS placed,
  CASE WHEN o_orderkey % 17 = 0 THEN -o_totalprice::DECIMAL(12,2) ELSE o_totalprice::DECIMAL(12,2) END AS amount,
  CASE WHEN o_orderkey % 19 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority AS priority, o_orderdate AS at FROM orders) """


def _rows(select: str) -> str:
    return SALES + select


@query(
    "dq_completeness",
    _rows(
        """SELECT 'all_known' AS rule_id, 'completeness' AS type, count(*) AS covered, count(*) - least(count(custkey), count(placed), count(amount)) AS violating,
      least(count(custkey), count(placed), count(amount))::DOUBLE / count(*)::DOUBLE AS actual, '>= 0.95' AS expected,
      least(count(custkey), count(placed), count(amount))::DOUBLE / count(*)::DOUBLE >= 0.95 AS passed, 'error' AS severity FROM sales
    UNION ALL SELECT 'amount_known', 'completeness', count(*), count(*) - count(amount), count(amount)::DOUBLE / count(*)::DOUBLE, '>= 1.0', count(amount) = count(*), 'warning' FROM sales
    UNION ALL SELECT 'none_empty', 'completeness', count(*), 0, 0, '>= 1.0', false, 'error' FROM sales WHERE amount IS NULL"""
    ),
)
def dq_completeness(t: Tables) -> DataFrame:
    table = sales(t)
    checks = [
        quality.completeness("all_known", ["custkey", "placed", "amount"], 0.95),
        quality.completeness("amount_known", ["amount"], severity="warning"),
    ]
    empty = quality.run_checks(table.where("amount IS NULL"), [quality.completeness("none_empty", ["amount"])])
    return quality.run_checks(table, checks).unionByName(empty)


@query(
    "dq_uniqueness",
    """SELECT 'key' AS rule_id, 'uniqueness' AS type, count(o_orderkey) AS covered, count(o_orderkey) - count(DISTINCT o_orderkey) AS violating,
      (count(o_orderkey) - count(DISTINCT o_orderkey))::DOUBLE AS actual, '0 repeated' AS expected, count(o_orderkey) = count(DISTINCT o_orderkey) AS passed, 'error' AS severity FROM orders
    UNION ALL SELECT 'customer', 'uniqueness', count(o_custkey), count(o_custkey) - count(DISTINCT o_custkey), (count(o_custkey) - count(DISTINCT o_custkey))::DOUBLE, '0 repeated',
      count(o_custkey) = count(DISTINCT o_custkey), 'error' FROM orders""",
)
def dq_uniqueness(t: Tables) -> DataFrame:
    return quality.uniqueness(t.orders, "key", "o_orderkey").unionByName(
        quality.uniqueness(t.orders, "customer", "o_custkey")
    )


@query(
    "dq_valid_values",
    _rows(
        """SELECT 'status' AS rule_id, 'valid_values' AS type, count(status) AS covered, count(CASE WHEN status NOT IN ('O', 'F', 'P') THEN 1 END) AS violating,
      count(CASE WHEN status NOT IN ('O', 'F', 'P') THEN 1 END)::DOUBLE AS actual, '0 values outside the list' AS expected,
      count(CASE WHEN status NOT IN ('O', 'F', 'P') THEN 1 END) = 0 AS passed, 'error' AS severity FROM sales
    UNION ALL SELECT 'both', 'valid_values', count(status) + count(priority), v, v::DOUBLE, '0 values outside the list', v = 0, 'error'
      FROM (SELECT count(CASE WHEN status NOT IN ('O', 'F', 'P', 'X') THEN 1 END) + count(CASE WHEN priority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') THEN 1 END) AS v, count(status) AS a FROM sales), sales GROUP BY v"""
    ),
)
def dq_valid_values(t: Tables) -> DataFrame:
    checks = [
        quality.valid_values("status", {"status": ["O", "F", "P"]}),
        quality.valid_values("both", {"status": ["O", "F", "P", "X"], "priority": ORDER_PRIORITIES}),
    ]
    return quality.run_checks(sales(t), checks)


@query(
    "dq_pattern",
    """SELECT 'brand' AS rule_id, 'pattern' AS type, count(p_brand) AS covered, count(CASE WHEN NOT regexp_matches(p_brand, '^Brand#[0-9]$') THEN 1 END) AS violating,
      count(CASE WHEN NOT regexp_matches(p_brand, '^Brand#[0-9]$') THEN 1 END)::DOUBLE AS actual, '0 values not matching ^Brand#[0-9]$' AS expected, false AS passed, 'error' AS severity FROM part
    UNION ALL SELECT 'name', 'pattern', count(p_name), count(CASE WHEN NOT regexp_matches(p_name, '[a-z]+ [a-z]+') THEN 1 END), count(CASE WHEN NOT regexp_matches(p_name, '[a-z]+ [a-z]+') THEN 1 END)::DOUBLE,
      '0 values not matching [a-z]+ [a-z]+', count(CASE WHEN NOT regexp_matches(p_name, '[a-z]+ [a-z]+') THEN 1 END) = 0, 'error' FROM part""",
)
def dq_pattern(t: Tables) -> DataFrame:
    checks = [
        quality.pattern("brand", "p_brand", "^Brand#[0-9]$"),
        quality.pattern("name", "p_name", "[a-z]+ [a-z]+"),
    ]
    return quality.run_checks(t.part, checks)


@query(
    "dq_range",
    _rows(
        """SELECT 'amount' AS rule_id, 'range' AS type, count(amount) AS covered, count(CASE WHEN NOT (amount BETWEEN 0 AND 400000) THEN 1 END) AS violating,
      count(CASE WHEN NOT (amount BETWEEN 0 AND 400000) THEN 1 END)::DOUBLE AS actual, 'between 0 and 400000' AS expected, count(CASE WHEN NOT (amount BETWEEN 0 AND 400000) THEN 1 END) = 0 AS passed, 'error' AS severity FROM sales
    UNION ALL SELECT 'floor', 'range', count(amount), count(CASE WHEN amount < -600000 THEN 1 END), count(CASE WHEN amount < -600000 THEN 1 END)::DOUBLE, 'between -600000 and None', count(CASE WHEN amount < -600000 THEN 1 END) = 0, 'error' FROM sales"""
    ),
)
def dq_range(t: Tables) -> DataFrame:
    checks = [quality.value_range("amount", "amount", 0, 400000), quality.value_range("floor", "amount", -600000)]
    return quality.run_checks(sales(t), checks)


@query(
    "dq_accuracy_bound",
    _rows(
        """, a AS (SELECT count(amount) AS n, min(amount)::DOUBLE AS lo, max(amount)::DOUBLE AS hi, count(CASE WHEN NOT amount >= 0 THEN 1 END) AS low_bad,
        count(CASE WHEN NOT amount <= 600000 THEN 1 END) AS high_bad, count(custkey) AS nc, count(CASE WHEN custkey = 7 THEN 1 END) AS seven FROM sales)
      SELECT 'floor' AS rule_id, 'accuracy' AS type, n AS covered, low_bad AS violating, lo AS actual, '>= 0' AS expected, lo >= 0 AS passed, 'error' AS severity FROM a
      UNION ALL SELECT 'cap', 'accuracy', n, high_bad, hi, '<= 600000', hi <= 600000, 'error' FROM a
      UNION ALL SELECT 'not_seven', 'accuracy', nc, seven, seven::DOUBLE, '!= 7', seven = 0, 'error' FROM a
      UNION ALL SELECT 'nothing', 'accuracy', 0, 0, NULL, '>= 0', false, 'error' FROM a"""
    ),
)
def dq_accuracy_bound(t: Tables) -> DataFrame:
    checks = [
        quality.bound("floor", ["amount"], ">=", 0),
        quality.bound("cap", ["amount"], "<=", 600000),
        quality.bound("not_seven", ["custkey"], "!=", 7),
        quality.bound("nothing", ["absent"], ">=", 0),
    ]
    return quality.run_checks(sales(t).withColumn("absent", F.lit(None).cast("double")), checks)


@query(
    "dq_reference",
    """WITH b AS (SELECT count(*) AS n, count(CASE WHEN NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 40) THEN 1 END) AS bad FROM lineitem),
    s AS (SELECT count(*) AS n, count(CASE WHEN NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey) THEN 1 END) AS bad FROM lineitem)
    SELECT 'part' AS rule_id, 'reference' AS type, n AS covered, bad AS violating, bad::DOUBLE AS actual, '0 without a match' AS expected, bad = 0 AS passed, 'error' AS severity FROM b
    UNION ALL SELECT 'supplier', 'reference', n, bad, bad::DOUBLE, '0 without a match', bad = 0, 'error' FROM s""",
)
def dq_reference(t: Tables) -> DataFrame:
    def check(id: str, parent: DataFrame, column: str, to: str) -> DataFrame:
        held = t.lineitem.agg(F.count(column).alias("covered"))
        lost = joins.orphans(t.lineitem, parent, column, to).select(F.col("rows").alias("violating"))
        counts = lost.withColumn("covered", held.scalar())
        return quality.result_row(counts, id, "reference", "0 without a match")

    return check("part", t.part.where("p_size < 40"), "l_partkey", "p_partkey").unionByName(
        check("supplier", t.supplier, "l_suppkey", "s_suppkey")
    )


@query(
    "dq_freshness",
    """WITH a AS (SELECT count(ts) AS n, date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01 00:00:00') // 1000000 AS age FROM events)
    SELECT 'day' AS rule_id, 'freshness' AS type, n AS covered, CASE WHEN age <= 86400 THEN 0 ELSE 1 END::BIGINT AS violating, age::DOUBLE AS actual, '<= 86400 s' AS expected, age <= 86400 AS passed, 'error' AS severity FROM a
    UNION ALL SELECT 'minute', 'freshness', n, CASE WHEN age <= 60 THEN 0 ELSE 1 END, age::DOUBLE, '<= 60 s', age <= 60, 'warning' FROM a""",
)
def dq_freshness(t: Tables) -> DataFrame:
    at = "2024-02-01 00:00:00"
    checks = [
        quality.freshness("day", "ts", at, "24h"),
        quality.freshness("minute", "ts", at, "PT1M", severity="warning"),
    ]
    return quality.run_checks(t.events, checks)


DECLARED_ORDERS = TableSpec(
    "orders",
    (
        ColumnSpec("o_orderkey", "bigint", required=True),
        ColumnSpec("custkey", "integer", required=True),
        ColumnSpec("placed", "date", required=True),
        ColumnSpec("amount", "double"),
        ColumnSpec("status", "boolean"),
        ColumnSpec("priority", "text"),
        ColumnSpec("comment", "string"),
    ),
)


@query(
    "dq_schema_conformance",
    _rows(
        """SELECT 'custkey' AS column_name, 'null_in_required' AS issue, 'required' AS declared, 'nullable' AS actual, 'types' AS verdict, count(*) - count(custkey) AS affected FROM sales
      UNION ALL SELECT 'placed', 'null_in_required', 'required', 'nullable', 'types', count(*) - count(placed) FROM sales
      UNION ALL SELECT 'amount', 'type', 'double', 'decimal(12,2)', 'types', count(*) * 0 FROM sales
      UNION ALL SELECT 'status', 'type', 'boolean', 'string', 'types', count(CASE WHEN status <> 'F' THEN 1 END) FROM sales
      UNION ALL SELECT 'comment', 'missing', 'string', 'none', 'structure', count(*) FROM sales
      UNION ALL SELECT 'at', 'extra', 'none', 'timestamp_ntz', 'structure', count("at") FROM sales"""
    ),
)
def dq_schema_conformance(t: Tables) -> DataFrame:
    return conformance.conformance_issues(sales(t), DECLARED_ORDERS)


@query(
    "dq_volume",
    """WITH v AS (SELECT 'orders' AS table_name, count(*) AS rows, 100::BIGINT AS minimum FROM orders UNION ALL SELECT 'customer', count(*), 1000000000 FROM customer
      UNION ALL SELECT 'returns', count(*), 1 FROM orders WHERE o_totalprice < 0)
    SELECT *, CASE WHEN rows = 0 THEN 'empty_table' WHEN rows < minimum THEN 'row_count_below_threshold' ELSE 'ok' END AS verdict FROM v""",
)
def dq_volume(t: Tables) -> DataFrame:
    return (
        conformance.volume(t.orders, "orders", 100)
        .unionByName(conformance.volume(t.customer, "customer", 1000000000))
        .unionByName(conformance.volume(t.orders.where("o_totalprice < 0"), "returns", 1))
    )


def order_rules() -> list[Rule]:
    amount, status = F.col("amount"), F.col("status")
    return [
        Rule("positive", amount > 0),
        Rule("filled_is_dated", F.col("placed").isNotNull(), when=status == "F", band=Band("mustBeLessOrEqualTo", 10, "percent")),
        Rule("open_is_small", amount < 400000, when=status == "O", band=Band("mustBeBetween", [1, 25], "percent"), severity="warning"),
        Rule("few_marks", status != "X", band=Band("mustBeLessThan", 100)),
        Rule("never", amount > 0, when=amount < -10000000, band=Band("mustBe", 0, "percent")),
    ]


BANDS = """, c AS (SELECT count(*) AS n, count(CASE WHEN NOT amount > 0 THEN 1 END) AS v1,
    count(CASE WHEN status = 'F' THEN 1 END) AS n2, count(CASE WHEN status = 'F' AND placed IS NULL THEN 1 END) AS v2,
    count(CASE WHEN status = 'O' THEN 1 END) AS n3, count(CASE WHEN status = 'O' AND NOT amount < 400000 THEN 1 END) AS v3,
    count(CASE WHEN status = 'X' THEN 1 END) AS v4 FROM sales)"""


@query(
    "rule_check_band",
    _rows(
        BANDS
        + """SELECT 'positive' AS rule_id, 'invariant' AS type, n AS covered, v1 AS violating, v1::DOUBLE AS actual, 'mustBe 0 rows' AS expected, v1 = 0 AS passed, 'error' AS severity FROM c
    UNION ALL SELECT 'filled_is_dated', 'invariant', n2, v2, (100 * v2)::DOUBLE / n2::DOUBLE, 'mustBeLessOrEqualTo 10 %', 100 * v2 <= 10 * n2, 'error' FROM c
    UNION ALL SELECT 'open_is_small', 'invariant', n3, v3, (100 * v3)::DOUBLE / n3::DOUBLE, 'mustBeBetween [1, 25] %', 100 * v3 BETWEEN n3 AND 25 * n3, 'warning' FROM c
    UNION ALL SELECT 'few_marks', 'invariant', n, v4, v4::DOUBLE, 'mustBeLessThan 100 rows', v4 < 100, 'error' FROM c
    UNION ALL SELECT 'never', 'invariant', 0, 0, 0, 'mustBe 0 %', true, 'error' FROM c"""
    ),
)
def rule_check_band(t: Tables) -> DataFrame:
    return quality.run_checks(sales(t), [quality.invariant(r) for r in order_rules()])


@query(
    "rule_derive",
    """SELECT 'name_from_key' AS rule_id, 'derive' AS type, count(*) AS covered, count(CASE WHEN c_name IS DISTINCT FROM 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0') THEN 1 END) AS violating,
      count(CASE WHEN c_name IS DISTINCT FROM 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0') THEN 1 END)::DOUBLE AS actual, 'mustBe 0 rows' AS expected, true AS passed, 'error' AS severity FROM customer
    UNION ALL SELECT 'segment_from_nation', 'derive', count(*), count(CASE WHEN length(c_mktsegment) IS DISTINCT FROM c_nationkey THEN 1 END), count(CASE WHEN length(c_mktsegment) IS DISTINCT FROM c_nationkey THEN 1 END)::DOUBLE, 'mustBe 0 rows', false, 'error' FROM customer""",
)
def rule_derive(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    rules = [
        Rule("name_from_key", R.distinct_from(F.col("c_name"), name, negated=True)),
        Rule("segment_from_nation", R.distinct_from(F.length("c_mktsegment"), F.col("c_nationkey"), negated=True)),
    ]
    return quality.run_checks(t.customer, [quality.invariant(r, "derive") for r in rules])


@query(
    "rule_summary",
    """WITH s AS (SELECT l_partkey, count(*) AS n, max(l_linenumber) AS top FROM lineitem GROUP BY 1),
    j AS (SELECT p_size, coalesce(n, 0) AS n, top FROM part LEFT JOIN s ON p_partkey = l_partkey)
    SELECT 'size_counts_lines' AS rule_id, 'summary' AS type, count(*) AS covered, count(CASE WHEN p_size <> n THEN 1 END) AS violating, count(CASE WHEN p_size <> n THEN 1 END)::DOUBLE AS actual, 'mustBe 0 rows' AS expected, count(CASE WHEN p_size <> n THEN 1 END) = 0 AS passed, 'error' AS severity FROM j
    UNION ALL SELECT 'top_is_seven', 'summary', count(*), count(CASE WHEN top IS DISTINCT FROM 7 THEN 1 END), count(CASE WHEN top IS DISTINCT FROM 7 THEN 1 END)::DOUBLE, 'mustBe 0 rows', count(CASE WHEN top IS DISTINCT FROM 7 THEN 1 END) = 0, 'error' FROM j""",
)
def rule_summary(t: Tables) -> DataFrame:
    children = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("top"))
    beside = t.part.join(children, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        "p_size", F.coalesce("n", F.lit(0)).alias("n"), "top"
    )
    rules = [
        Rule("size_counts_lines", R.distinct_from(F.col("p_size"), F.col("n"), negated=True)),
        Rule("top_is_seven", R.distinct_from(F.col("top"), 7, negated=True)),
    ]
    return quality.run_checks(beside, [quality.invariant(r, "summary") for r in rules])


@query(
    "rule_dependency",
    """WITH a AS (SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS d FROM customer GROUP BY 1),
    b AS (SELECT c_custkey, count(*) AS n, count(DISTINCT c_name) AS d FROM customer GROUP BY 1), c AS (SELECT c_name, count(*) AS n, count(DISTINCT c_custkey) AS d FROM customer GROUP BY 1),
    r AS (SELECT 'nation_segment' AS rule_id, sum(n) AS n, sum(CASE WHEN d > 1 THEN n ELSE 0 END) AS v FROM a UNION ALL SELECT 'key_name', sum(n), sum(CASE WHEN d > 1 THEN n ELSE 0 END) FROM b
      UNION ALL SELECT 'name_key', sum(n), sum(CASE WHEN d > 1 THEN n ELSE 0 END) FROM c)
    SELECT rule_id, 'dependency' AS type, n::BIGINT AS covered, v::BIGINT AS violating, v::DOUBLE AS actual, 'one target per source' AS expected, v = 0 AS passed, 'error' AS severity FROM r""",
)
def rule_dependency(t: Tables) -> DataFrame:
    c = t.customer
    return (
        quality.dependency(c, "nation_segment", ["c_nationkey"], "c_mktsegment")
        .unionByName(quality.dependency(c, "key_name", ["c_custkey"], "c_name"))
        .unionByName(quality.dependency(c, "name_key", ["c_name"], "c_custkey"))
    )


@query(
    "rule_identifier_format",
    """SELECT 'part' AS table_name, p_partkey AS key, p_brand AS value FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#(1[0-9]|2[0-9])') AND NOT regexp_full_match(p_brand, 'Brand#[0-9]')
      OR regexp_full_match(p_brand, 'Brand#2[0-9]')
    UNION ALL SELECT 'customer', c_custkey, c_name FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#0000[0-9]{5}')""",
)
def rule_identifier_format(t: Tables) -> DataFrame:
    """Values that match none of their column's formats. The mask is turned into a regex once."""
    brand = identifier_regex(((), "Brand#9"), (("Brand#1",), "9"))
    name = identifier_regex((("Customer#0000", "Customer#9999"), "99999"))
    return (
        t.part.where(~F.col("p_brand").rlike(brand))
        .select(F.lit("part").alias("table_name"), F.col("p_partkey").alias("key"), F.col("p_brand").alias("value"))
        .unionByName(
            t.customer.where(~F.col("c_name").rlike(name)).select(
                F.lit("customer").alias("table_name"), F.col("c_custkey").alias("key"), F.col("c_name").alias("value")
            )
        )
    )


@query(
    "rule_placeholder_exempt",
    """SELECT 'type_known' AS rule_id, 'placeholder' AS type, count(CASE WHEN p_type <> 'STANDARD' AND NOT p_type LIKE 'PRO%' THEN 1 END) AS covered,
      count(CASE WHEN p_type <> 'STANDARD' AND NOT p_type LIKE 'PRO%' AND p_type NOT IN ('ECONOMY', 'SMALL') THEN 1 END) AS violating,
      count(CASE WHEN p_type <> 'STANDARD' AND NOT p_type LIKE 'PRO%' AND p_type NOT IN ('ECONOMY', 'SMALL') THEN 1 END)::DOUBLE AS actual, 'mustBe 0 rows' AS expected,
      count(CASE WHEN p_type <> 'STANDARD' AND NOT p_type LIKE 'PRO%' AND p_type NOT IN ('ECONOMY', 'SMALL') THEN 1 END) = 0 AS passed, 'error' AS severity FROM part""",
)
def rule_placeholder_exempt(t: Tables) -> DataFrame:
    spec = ColumnSpec("p_type", "string", levels=("ECONOMY", "SMALL"), placeholders=("STANDARD",), placeholder_prefixes=("PRO",))
    value = F.col(spec.name)
    exempt = value.isin(*spec.placeholders)
    for prefix in spec.placeholder_prefixes:
        exempt = exempt | value.startswith(prefix)
    rule = Rule("type_known", value.isin(*spec.levels), when=~exempt)
    return quality.run_checks(t.part, [quality.invariant(rule, "placeholder")])


@query(
    "rule_shared_columns",
    """WITH j AS (SELECT l_linestatus, o_orderstatus, o_orderkey FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
    SELECT 'status_follows_order' AS rule_id, 'shared' AS type, count(o_orderkey) AS covered, count(CASE WHEN o_orderkey IS NOT NULL AND l_linestatus IS DISTINCT FROM o_orderstatus THEN 1 END) AS violating,
      count(CASE WHEN o_orderkey IS NOT NULL AND l_linestatus IS DISTINCT FROM o_orderstatus THEN 1 END)::DOUBLE AS actual, 'mustBe 0 rows' AS expected, false AS passed, 'error' AS severity FROM j""",
)
def rule_shared_columns(t: Tables) -> DataFrame:
    link = Link("line_of", ("l_orderkey",), ("o_orderkey",))
    reached = joins.link_join(t.lineitem, t.orders, link, {"o_orderkey": "reached", "o_orderstatus": "parent_status"})
    rule = Rule(
        "status_follows_order",
        R.distinct_from(F.col("l_linestatus"), F.col("parent_status"), negated=True),
        when=F.col("reached").isNotNull(),
    )
    return quality.run_checks(reached, [quality.invariant(rule, "shared")])


@query(
    "rule_shared_attribute",
    """WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_suppkey % 40 AS k FROM supplier)
    SELECT 'only_left' AS side, k::BIGINT AS value FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'only_right', k FROM (SELECT k FROM s EXCEPT SELECT k FROM c)""",
)
def rule_shared_attribute(t: Tables) -> DataFrame:
    """One attribute on two tables has one domain: values only one of them holds. The suppliers' stands for a wider one."""
    c = t.customer.select(F.col("c_nationkey").cast("bigint").alias("value")).distinct()
    s = t.supplier.select((F.col("s_suppkey") % 40).cast("bigint").alias("value")).distinct()
    return (
        c.join(s, "value", "left_anti")
        .withColumn("side", F.lit("only_left"))
        .unionByName(s.join(c, "value", "left_anti").withColumn("side", F.lit("only_right")))
    )


@query(
    "rule_versioned_window",
    """WITH v AS (SELECT o_custkey, o_orderdate::DATE AS start, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::DATE + (o_orderkey % 150)::INTEGER END AS stop FROM orders),
    s AS (SELECT o_custkey, start, count(*) AS n, count(CASE WHEN stop IS NULL THEN 1 END) AS open, max(stop) AS last_stop, count(CASE WHEN stop <= start THEN 1 END) AS empty FROM v GROUP BY ALL),
    f AS (SELECT *, lead(start) OVER (PARTITION BY o_custkey ORDER BY start) AS following FROM s)
    SELECT sum(n)::BIGINT AS versions, sum(empty)::BIGINT AS empty, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS same_start,
      count(CASE WHEN following IS NOT NULL AND (open > 0 OR last_stop > following) THEN 1 END) AS overlapping FROM f""",
)
def rule_versioned_window(t: Tables) -> DataFrame:
    key, start = F.col("o_orderkey"), day("o_orderdate")
    versions = t.orders.select(
        "o_custkey",
        start.alias("start"),
        F.when(key % 9 != 0, F.date_add(start, (key % 150).cast("int"))).alias("stop"),
    )
    starts = versions.groupBy("o_custkey", "start").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("stop").isNull()).alias("open"),
        F.max("stop").alias("last_stop"),
        F.count_if(F.col("stop") <= F.col("start")).alias("empty"),
    )
    ordered = slices.next_in_order(starts, ["o_custkey"], "start", "following")
    over = F.col("following").isNotNull() & ((F.col("open") > 0) | (F.col("last_stop") > F.col("following")))
    return ordered.agg(
        F.sum("n").alias("versions"),
        F.sum("empty").alias("empty"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("same_start"),
        F.count_if(over).alias("overlapping"),
    )


GATES = (
    quality.Gate("known", "not_null", ("custkey", "placed")),
    quality.Gate("low_priority", "regex", ("priority",), pattern="[1-3]-", severity="warn"),
    quality.Gate("amount", "range", ("amount",), low=0, high=480000),
    quality.Gate("status", "regex", ("status",), pattern="[A-W]"),
    quality.Gate("large", "range", ("amount",), high=300000, severity="warn"),
    quality.Gate("numeric", "range", ("status",), low=0, severity="warn"),
)


@query(
    "dq_gate_rows",
    _rows(
        """, g AS (SELECT *, CASE WHEN custkey IS NULL OR placed IS NULL THEN 'known' WHEN NOT amount BETWEEN 0 AND 480000 THEN 'amount'
        WHEN NOT regexp_matches(status, '^[A-W]') THEN 'status' END AS reason,
        CASE WHEN regexp_matches(priority, '^[1-3]-') THEN 0 ELSE 1 END AS w1, CASE WHEN amount <= 300000 THEN 0 ELSE 1 END AS w2 FROM sales)
      SELECT o_orderkey, reason, CASE WHEN reason = 'known' THEN 0 WHEN reason IS NOT NULL THEN w1 ELSE w1 + w2 + 1 END::BIGINT AS warnings,
        CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN w1 + w2 + 1 > 0 THEN 'warned' ELSE 'passed' END AS outcome FROM g"""
    ),
)
def dq_gate_rows(t: Tables) -> DataFrame:
    return quality.gate_rows(sales(t), GATES).select("o_orderkey", "reason", "warnings", "outcome")


@query(
    "dq_row_count_anomaly",
    """WITH d AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1),
    q AS (SELECT quantile_disc(n, 0.25) AS q1, quantile_disc(n, 0.75) AS q3 FROM d),
    l AS (SELECT d, n, lag(n, 1) OVER w AS b1, """
    + " + ".join(f"coalesce(lag(n, {i}) OVER w, 0) * {2 ** (8 - i)}" for i in range(1, 9))
    + " AS s, "
    + " + ".join(f"CASE WHEN lag(n, {i}) OVER w IS NULL THEN 0 ELSE {2 ** (8 - i)} END" for i in range(1, 9))
    + """ AS w8 FROM d WINDOW w AS (ORDER BY d))
    SELECT d::VARCHAR AS d, n, s::DOUBLE / nullif(w8, 0)::DOUBLE AS expected, 100 * abs(n * w8 - s) > 50 * s AS ewma_anomaly,
      2 * n < 2 * q1 - 3 * (q3 - q1) OR 2 * n > 2 * q3 + 3 * (q3 - q1) AS iqr_anomaly, coalesce(n <> b1, false) AS exact_anomaly FROM l, q""",
)
def dq_row_count_anomaly(t: Tables) -> DataFrame:
    daily = t.orders.groupBy(day("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return anomaly.row_count_anomalies(daily, day="d", n="n")


def order_check_results(t: Tables) -> DataFrame:
    """Check results of a product per priority and a run per month."""
    runs = t.orders.groupBy(
        F.col("o_orderpriority").alias("product_id"), F.trunc(day("o_orderdate"), "month").alias("run_date")
    ).agg(F.max(money("o_totalprice")).alias("top"), F.count("*").alias("n"), F.min(money("o_totalprice")).alias("low"))
    result = lambda rule, kind, passed: F.struct(
        F.lit(rule).alias("rule_id"), F.lit(kind).alias("rule_type"), passed.alias("passed")
    )
    rules = F.array(
        result("amount_cap", "range", F.col("top") <= 480000),
        result("volume", "volume", F.col("n") >= 30),
        result("floor", "range", F.col("low") >= 1500),
        result("columns", "structure", F.lit(True)),
    )
    layer = F.when(F.left("product_id", F.lit(1)).isin("1", "2"), "gold").otherwise("silver")
    each = runs.select("product_id", layer.alias("layer"), "run_date", F.explode(rules).alias("r"))
    last_months = (F.col("run_date") >= F.lit("2001-07-01").cast("date")) & (F.col("product_id") == "5-LOW")
    return each.select("product_id", "layer", "run_date", "r.*").where(~last_months | (F.col("rule_type") == "structure"))


@query(
    "dq_results_rollup",
    """WITH runs AS (SELECT o_orderpriority AS product_id, date_trunc('month', o_orderdate)::DATE AS run_date, max(o_totalprice::DECIMAL(12,2)) AS top, count(*) AS n,
        min(o_totalprice::DECIMAL(12,2)) AS low FROM orders GROUP BY ALL),
    results AS (SELECT product_id, CASE WHEN left(product_id, 1) IN ('1', '2') THEN 'gold' ELSE 'silver' END AS layer, run_date, rule_id, rule_type, passed FROM (
        SELECT product_id, run_date, 'amount_cap' AS rule_id, 'range' AS rule_type, top <= 480000 AS passed FROM runs UNION ALL SELECT product_id, run_date, 'volume', 'volume', n >= 30 FROM runs
        UNION ALL SELECT product_id, run_date, 'floor', 'range', low >= 1500 FROM runs UNION ALL SELECT product_id, run_date, 'columns', 'structure', true FROM runs)
        WHERE NOT (run_date >= DATE '2001-07-01' AND product_id = '5-LOW') OR rule_type = 'structure'),
    last AS (SELECT product_id AS p, coalesce(max(CASE WHEN rule_type <> 'structure' THEN run_date END), max(run_date)) AS last FROM results GROUP BY 1),
    latest AS (SELECT results.* FROM results JOIN last ON product_id = p AND run_date = last)
    SELECT 'overall' AS report, NULL AS product_id, NULL AS layer, NULL AS run_date, NULL AS rule_id, count(*) AS rules, count(*) FILTER (NOT passed) AS failing,
      count(*) FILTER (passed)::DOUBLE / count(*)::DOUBLE AS pass_rate FROM latest WHERE rule_type <> 'structure'
    UNION ALL SELECT 'product', product_id, layer, run_date::VARCHAR, NULL, count(*), count(*) FILTER (NOT passed), count(*) FILTER (passed)::DOUBLE / count(*)::DOUBLE
      FROM latest WHERE rule_type <> 'structure' GROUP BY ALL
    UNION ALL SELECT 'trend', product_id, NULL, run_date::VARCHAR, NULL, count(*), count(*) FILTER (NOT passed), count(*) FILTER (passed)::DOUBLE / count(*)::DOUBLE
      FROM results WHERE rule_type <> 'structure' GROUP BY ALL
    UNION ALL SELECT 'failing', product_id, layer, run_date::VARCHAR, rule_id, 1, 1, 0 FROM latest WHERE NOT passed""",
)
def dq_results_rollup(t: Tables) -> DataFrame:
    return anomaly.results_rollup(order_check_results(t))


@query(
    "dq_signals",
    """WITH h AS (SELECT o_orderdate::DATE AS run, count(*) AS records, sum(length(o_orderpriority) + length(o_orderstatus) + 20)::BIGINT AS bytes, count(*) FILTER (o_totalprice > 450000) AS rejects,
        max(o_orderkey) AS cursor, max(o_orderstatus) || min(o_orderstatus) AS fingerprint FROM orders GROUP BY 1),
    s AS (SELECT *, lag(records) OVER w AS p_records, lag(bytes) OVER w AS p_bytes, lag(rejects) OVER w AS p_rejects, lag(cursor) OVER w AS p_cursor, lag(fingerprint) OVER w AS p_fingerprint FROM h WINDOW w AS (ORDER BY run))
    SELECT run::VARCHAR AS run, 'record_count_drop' AS signal FROM s WHERE records * 2 < p_records UNION ALL SELECT run::VARCHAR, 'record_count_surge' FROM s WHERE records > p_records * 2
    UNION ALL SELECT run::VARCHAR, 'bytes_per_record_outlier' FROM s WHERE 50 * abs(bytes * p_records - p_bytes * records) > p_bytes * records
    UNION ALL SELECT run::VARCHAR, 'reject_rate_spike' FROM s WHERE rejects > 0 AND rejects * p_records > 2 * p_rejects * records
    UNION ALL SELECT run::VARCHAR, 'cursor_stalled' FROM s WHERE cursor <= p_cursor UNION ALL SELECT run::VARCHAR, 'schema_fingerprint_changed' FROM s WHERE fingerprint <> p_fingerprint""",
)
def dq_signals(t: Tables) -> DataFrame:
    history = t.orders.groupBy(day("o_orderdate").alias("run")).agg(
        F.count("*").alias("records"),
        F.sum(F.length("o_orderpriority") + F.length("o_orderstatus") + 20).alias("bytes"),
        F.count_if(F.col("o_totalprice") > 450000).alias("rejects"),
        F.max("o_orderkey").alias("cursor"),
        F.concat(F.max("o_orderstatus"), F.min("o_orderstatus")).alias("fingerprint"),
    )
    return anomaly.run_signals(history, run="run")
