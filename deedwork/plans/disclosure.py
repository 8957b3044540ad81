"""Disclosure control over statistics of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedwork.functions.values import day, money
from deedwork.operators import disclosure, profile
from deedwork.plans.quality import SALES, sales
from deedwork.plans.registry import query
from deedwork.session import Tables, materialized

# Daily orders per priority: small cells, zero cells excluded.
CELLS = """cells AS (SELECT o_orderpriority AS grp, date_trunc('week', o_orderdate)::DATE AS week, count(*) AS n FROM orders GROUP BY ALL),
  s AS (SELECT *, CASE WHEN n < 10 THEN 'A' ELSE 'F' END AS status, ((2 * n + 5) // 10) * 5 AS r FROM cells)"""


def weekly_cells(t: Tables) -> DataFrame:
    return t.orders.groupBy(
        F.col("o_orderpriority").alias("grp"), F.date_trunc("week", "o_orderdate").cast("date").alias("week")
    ).agg(F.count("*").alias("n"))


@query(
    "sdc_min_cell",
    f"WITH {CELLS} SELECT grp, week::VARCHAR AS week, status, CASE WHEN status = 'F' THEN r END AS published FROM s",
)
def sdc_min_cell(t: Tables) -> DataFrame:
    return disclosure.with_count_status(weekly_cells(t), "n").select("grp", "week", "status", "published")


@query(
    "sdc_round",
    f"""WITH {CELLS}, t AS (SELECT *, (n // 10 + CASE WHEN n % 10 > 5 OR (n % 10 = 5 AND (n // 10) % 2 = 1) THEN 1 ELSE 0 END) * 10 AS r10 FROM cells)
    SELECT s.grp, s.week::VARCHAR AS week, r AS base5, CASE WHEN s.n < 10 THEN 0 ELSE greatest(r - 2, 10) END AS low5, CASE WHEN s.n < 10 THEN 9 ELSE r + 2 END AS high5,
      r10 AS base10, CASE WHEN s.n < 10 THEN 0 WHEN (r10 // 10) % 2 = 0 THEN greatest(r10 - 5, 10) ELSE greatest(r10 - 4, 10) END AS low10, CASE WHEN s.n < 10 THEN 9 WHEN (r10 // 10) % 2 = 0 THEN r10 + 5 ELSE r10 + 4 END AS high10
    FROM s JOIN t ON s.grp = t.grp AND s.week = t.week""",
)
def sdc_round(t: Tables) -> DataFrame:
    ten = disclosure.DisclosureRule(rounding_base=10)
    n = F.col("n")
    low5, high5 = disclosure.band(n)
    low10, high10 = disclosure.band(n, ten)
    return weekly_cells(t).select(
        "grp",
        "week",
        disclosure.rounded(n).alias("base5"),
        low5.alias("low5"),
        high5.alias("high5"),
        disclosure.rounded(n, ten).alias("base10"),
        low10.alias("low10"),
        high10.alias("high10"),
    )


def skewed_sales(t: Tables) -> DataFrame:
    """Line values per supplier and month, some of them blown up, zero or all alike."""
    value = money("l_extendedprice")
    key = F.col("l_suppkey")
    shaped = (
        F.when((key % 7 == 0) & (F.col("l_linenumber") == 1), value * 1000)
        .when(key % 11 == 0, F.lit(7))
        .when((key % 13 == 0) & (F.col("l_quantity") < 40), F.lit(0))
        .when(key % 17 == 0, F.floor(value))
        .otherwise(value)
    )
    return t.lineitem.select(
        F.when(key % 19 != 0, key).alias("supplier"),
        F.trunc(day("l_shipdate"), "year").alias("year"),
        F.when(key % 23 != 0, shaped.cast("decimal(18,2)")).alias("v"),
    )


SKEWED = """x AS (SELECT CASE WHEN l_suppkey % 19 <> 0 THEN l_suppkey END AS supplier, date_trunc('year', l_shipdate)::DATE AS year,
    (CASE WHEN l_suppkey % 23 = 0 THEN NULL WHEN l_suppkey % 7 = 0 AND l_linenumber = 1 THEN l_extendedprice::DECIMAL(12,2) * 1000 WHEN l_suppkey % 11 = 0 THEN 7 WHEN l_suppkey % 13 = 0 AND l_quantity < 40 THEN 0
      WHEN l_suppkey % 17 = 0 THEN floor(l_extendedprice::DECIMAL(12,2)) ELSE l_extendedprice::DECIMAL(12,2) END)::DECIMAL(18,2) AS v FROM lineitem)"""


def judged(source: str, value: str, name: str) -> str:
    """Per group: counts, ends and the largest contributions, and the statuses that follow."""
    return f"""{name}_r AS (SELECT supplier, year, {value}::DECIMAL(30,4) AS v, abs({value})::DECIMAL(30,4) AS a, row_number() OVER (PARTITION BY supplier, year ORDER BY abs({value}) DESC NULLS LAST) AS rn FROM {source}),
  {name}_g AS (SELECT supplier, year, count(v) AS n, count(*) FILTER (v <> 0) AS c, count(DISTINCT v) AS d, coalesce(max(abs(v)), 0) AS m, coalesce(sum(a), 0) AS total, sum(v) AS s, coalesce(sum(a) FILTER (rn <= 1), 0) AS t1, coalesce(sum(a) FILTER (rn <= 2), 0) AS t2 FROM {name}_r GROUP BY ALL),
  {name}_d AS (SELECT *, CASE WHEN total = 0 THEN 'F' WHEN t1 * 10 >= total * 9 THEN 'O' WHEN t2 * 10 >= total * 9 THEN 'T' WHEN (total - t2) * 10 < t1 THEN 'M' ELSE 'F' END AS dom FROM {name}_g),
  {name} AS (SELECT *, CASE WHEN c < 10 THEN 'A' WHEN d <= 2 AND m <> 0 THEN 'C' ELSE dom END AS status FROM {name}_d)"""


@query(
    "sdc_dominance",
    f"WITH {SKEWED}, {judged('x', 'v', 'j')} SELECT supplier, year::VARCHAR AS year, n AS records, dom AS status FROM j",
)
def sdc_dominance(t: Tables) -> DataFrame:
    return disclosure.dominance(skewed_sales(t), ["supplier", "year"], "v")


@query(
    "sdc_sum_mean",
    f"""WITH {SKEWED}, g AS (SELECT supplier, year, ((v * 100)::HUGEINT * 65536) // 100 AS g, (((v * 100)::HUGEINT * 65536) % 100) AS r FROM x), {judged('x', 'v', 'j')}, {judged('g', 'r', 'k')},
    b AS (SELECT supplier, year, count(DISTINCT g) AS dg, sum(g) AS sg FROM g GROUP BY ALL),
    z AS (SELECT j.supplier, j.year, j.n, j.s, j.status AS sum_status, sg, CASE WHEN j.n < 10 THEN 'A' WHEN j.status <> 'F' THEN j.status WHEN dg <= 2 THEN 'C' WHEN k.c = 0 THEN 'F' ELSE k.status END AS mean_status
      FROM j JOIN k ON j.supplier IS NOT DISTINCT FROM k.supplier AND j.year = k.year JOIN b ON b.supplier IS NOT DISTINCT FROM j.supplier AND b.year = j.year)
    SELECT supplier, year::VARCHAR AS year, CASE WHEN n >= 10 THEN ((2 * n + 5) // 10) * 5 END AS records, sum_status, CASE WHEN sum_status = 'F' THEN s END::DOUBLE AS total, mean_status,
      CASE WHEN mean_status = 'F' THEN sg::HUGEINT::VARCHAR END AS grid_total FROM z""",
)
def sdc_sum_mean(t: Tables) -> DataFrame:
    return disclosure.sum_and_mean(skewed_sales(t), ["supplier", "year"], "v")


@query(
    "sdc_secondary",
    f"""WITH {CELLS}, w AS (SELECT *, count(*) OVER (PARTITION BY week) AS cells, count(*) FILTER (status <> 'F') OVER (PARTITION BY week) AS held FROM s)
    SELECT grp, week::VARCHAR AS week, CASE WHEN status = 'F' AND held > 0 AND held < cells THEN 'D' ELSE status END AS status FROM w""",
)
def sdc_secondary(t: Tables) -> DataFrame:
    cells = disclosure.with_count_status(weekly_cells(t), "n").select("grp", "week", "status")
    return disclosure.secondary(cells, ["week"])


@query(
    "sdc_per_entity_guard",
    """WITH v AS (SELECT o_custkey, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT value, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, value) AS rn FROM v),
    p AS (SELECT value, count(*) AS n FROM m WHERE rn = 1 GROUP BY 1), r AS (SELECT value, sum(n) AS n FROM v GROUP BY 1),
    j AS (SELECT p.value, p.n, r.n AS rn FROM p FULL JOIN r ON p.value = r.value), bad AS (SELECT count(*) AS k FROM j WHERE (coalesce(n, 0) < 10) <> (coalesce(rn, 0) < 10))
    SELECT value, n, CASE WHEN (SELECT k FROM bad) > 0 THEN 'C' WHEN n < 10 THEN 'A' ELSE 'F' END AS status FROM p""",
)
def sdc_per_entity_guard(t: Tables) -> DataFrame:
    rare = t.orders.select("o_custkey", F.col("o_orderpriority").alias("value"))
    per = disclosure.with_count_status(profile.per_entity(rare, ["o_custkey"], "value"), "n")
    rows = disclosure.with_count_status(rare.groupBy("value").agg(F.count("*").alias("n")), "n")
    return disclosure.per_entity_guard(per, rows, "value")


#: What stands for every value that the facts tell apart.
SALE_DOMAINS = {
    "amount": ("decimal(12,2)", ("0.00", "1.00", "450000.00", "499000.00")),
    "status": ("string", ("O", "F", "P")),
    "custkey": ("bigint", (1, None)),
}


FACT_NAMES = ("positive", "large", "open", "large_or_open", "open_known", "very_large")


def sale_facts() -> dict:
    amount, status = F.col("amount"), F.col("status")
    return {
        "positive": (None, amount > 0),
        "large": (None, amount >= 450000),
        "open": (None, status == "O"),
        "large_or_open": (None, (amount >= 450000) | (status == "O")),
        "open_known": (status == "O", F.col("custkey").isNotNull()),
        "very_large": (status == "F", amount >= 499000),
    }


_STATES = """CASE WHEN amount > 0 THEN 1 ELSE 0 END AS s0, CASE WHEN amount >= 450000 THEN 1 ELSE 0 END AS s1, CASE WHEN status = 'O' THEN 1 ELSE 0 END AS s2,
    CASE WHEN amount >= 450000 OR status = 'O' THEN 1 ELSE 0 END AS s3, CASE WHEN status <> 'O' THEN 2 WHEN custkey IS NOT NULL THEN 1 ELSE 0 END AS s4,
    CASE WHEN status <> 'F' THEN 2 WHEN amount >= 499000 THEN 1 ELSE 0 END AS s5"""
_FACTS = range(len(FACT_NAMES))
_SHOWN = ", ".join(f"CASE WHEN mask & {1 << k} > 0 THEN s{k} ELSE 9 END AS s{k}" for k in _FACTS)
_KEYS = ", ".join(f"s{k}" for k in _FACTS)


# For every set of facts, the facts that its small or empty combinations differ in from the nearest ones; then the way from all facts down.
@query(
    "sdc_differencing",
    f"""{SALES.replace("WITH ", "WITH RECURSIVE ", 1)}, st AS (SELECT {_STATES} FROM sales),
    base AS (SELECT {_KEYS}, count(*) AS n FROM st GROUP BY ALL),
    grid AS (SELECT amount, status, custkey FROM (VALUES (0), (1), (450000), (499000)) a(amount), (VALUES ('O'), ('F'), ('P')) b(status), (VALUES (1), (NULL)) c(custkey)),
    allowed AS (SELECT DISTINCT {_KEYS} FROM (SELECT {_STATES} FROM grid)),
    masks AS (SELECT unnest(range(1, {1 << len(_FACTS)})) AS mask),
    cells AS (SELECT mask, {_SHOWN}, sum(n) AS n FROM base, masks GROUP BY ALL),
    empty AS (SELECT DISTINCT mask, {_SHOWN} FROM allowed, masks EXCEPT SELECT mask, {_KEYS} FROM cells),
    target AS (SELECT mask, false AS zero, {_KEYS} FROM cells WHERE n < 10 UNION ALL SELECT mask, true, {_KEYS} FROM empty),
    apart AS (SELECT t.*, {" + ".join(f"CASE WHEN t.s{k} <> c.s{k} THEN {1 << k} ELSE 0 END" for k in _FACTS)} AS bits FROM target t JOIN cells c USING (mask)),
    nearest AS (SELECT *, rank() OVER (PARTITION BY mask, zero, {_KEYS} ORDER BY bit_count(bits)) AS k FROM apart WHERE bits > 0),
    gone AS (SELECT mask, zero, bit_or(bits) AS bits FROM nearest WHERE k = 1 GROUP BY mask, zero),
    rules AS (SELECT unnest([true, false]) AS zeros),
    step AS (SELECT zeros, m.mask, coalesce(a.bits, CASE WHEN zeros THEN b.bits END) AS bits
        FROM rules, masks m LEFT JOIN gone a ON a.mask = m.mask AND NOT a.zero LEFT JOIN gone b ON b.mask = m.mask AND b.zero),
    walk AS (SELECT zeros, {(1 << len(_FACTS)) - 1} AS mask, 1 AS round FROM rules
        UNION ALL SELECT w.zeros, w.mask & ~s.bits, w.round + 1 FROM walk w JOIN step s USING (zeros, mask) WHERE s.bits IS NOT NULL),
    names AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {1 << k})" for k, n in enumerate(FACT_NAMES))}) v(fact, bit))
    SELECT zeros AS zeros_disclosive, fact, min(round) FILTER (WHERE mask & bit = 0) - 1 AS round, CASE WHEN bool_and(mask & bit > 0) THEN 'F' ELSE 'C' END AS status
    FROM walk, names GROUP BY zeros, fact""",
)
def sdc_differencing(t: Tables) -> DataFrame:
    facts = sale_facts()
    states = materialized(disclosure.fact_states(sales(t), facts), "sale-states")
    possible = disclosure.possible_states(t.spark, facts, SALE_DOMAINS)
    told = [
        disclosure.differencing(states, FACT_NAMES, disclosure.DisclosureRule(zeros_disclosive=zeros), possible).withColumn("zeros_disclosive", F.lit(zeros))
        for zeros in (True, False)
    ]
    return told[0].unionByName(told[1])
