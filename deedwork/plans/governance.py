"""Schema operators, personal data, masks, governed reads and the metric layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedwork.functions import crypto, pii
from deedwork.functions.values import day, money
from deedwork.operators import access, joins, schema, semantic, windows
from deedwork.plans.quality import SALES, sales
from deedwork.plans.registry import query
from deedwork.plans.relational import customer_versions, shipped_lines
from deedwork.session import Tables
from deedwork.specs import Link, Measure, Metric, Restriction, RowFilter, SemanticModel, Where
from deedwork.specs import Window as Validity

# -- schemas --------------------------------------------------------------------------


@query(
    "schema_fingerprint",
    SALES
    + """, n AS (SELECT count(*) AS n, count(amount) AS amount, count("at") AS at_, count(custkey) AS custkey, count(o_orderkey) AS k, count(placed) AS placed, count(priority) AS priority, count(status) AS status FROM sales)
    SELECT 'sha256:' || sha256('[' || '{"name": "amount", "nullable": ' || (amount < n)::VARCHAR || ', "type": "decimal(12,2)"}' || ', {"name": "at", "nullable": ' || (at_ < n)::VARCHAR || ', "type": "timestamp_ntz"}'
      || ', {"name": "custkey", "nullable": ' || (custkey < n)::VARCHAR || ', "type": "bigint"}' || ', {"name": "o_orderkey", "nullable": ' || (k < n)::VARCHAR || ', "type": "bigint"}'
      || ', {"name": "placed", "nullable": ' || (placed < n)::VARCHAR || ', "type": "date"}' || ', {"name": "priority", "nullable": ' || (priority < n)::VARCHAR || ', "type": "string"}'
      || ', {"name": "status", "nullable": ' || (status < n)::VARCHAR || ', "type": "string"}]') AS digest, 7::BIGINT AS columns FROM n""",
)
def schema_fingerprint(t: Tables) -> DataFrame:
    return schema.fingerprint(schema.field_table(sales(t)))


def next_sales(t: Tables) -> DataFrame:
    """The same feed after its producer changed it."""
    key = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey",
        F.col("o_custkey").cast("int").alias("custkey"),
        F.when(key % 23 == 0, F.lit("n/a")).otherwise(money("o_totalprice").cast("string")).alias("amount"),
        F.when(key % 19 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("price"),
        F.when(key % 2 == 0, F.lit("web")).alias("channel"),
    )


@query(
    "schema_diff",
    SALES
    + """, cur AS (SELECT count(*) AS n, count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS channel FROM orders),
    old AS (SELECT count(placed) AS placed, count(priority) AS priority, count("at") AS at_ FROM sales)
    SELECT 'added' AS event, 'price' AS name, NULL AS before, 'decimal(14,2)' AS after, n AS affected FROM cur UNION ALL SELECT 'added', 'channel', NULL, 'string', channel FROM cur
    UNION ALL SELECT 'removed', 'placed', 'date', NULL, placed FROM old UNION ALL SELECT 'removed', 'priority', 'string', NULL, priority FROM old UNION ALL SELECT 'removed', 'at', 'timestamp_ntz', NULL, at_ FROM old
    UNION ALL SELECT 'type_narrowed', 'custkey', 'bigint', 'int', n FROM cur UNION ALL SELECT 'type_changed', 'amount', 'decimal(12,2)', 'string', n FROM cur""",
)
def schema_diff(t: Tables) -> DataFrame:
    return schema.schema_diff(schema.field_table(sales(t)), schema.field_table(next_sales(t)))


@query(
    "schema_evolve",
    """SELECT o_orderkey, o_custkey AS custkey, CASE WHEN o_orderkey % 23 <> 0 THEN o_totalprice::DECIMAL(12,2) END::DOUBLE AS amount,
      CASE WHEN o_orderkey % 19 = 0 THEN 'X' ELSE o_orderstatus END AS status, NULL::VARCHAR AS placed, NULL::VARCHAR AS priority, NULL::VARCHAR AS "at",
      o_totalprice::DECIMAL(14,2)::DOUBLE AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'web' END AS channel, CASE WHEN o_orderkey % 23 = 0 THEN 'amount' END AS rejected FROM orders""",
)
def schema_evolve(t: Tables) -> DataFrame:
    """Everything evolves, but a removed column only warns, so it stays as NULLs."""
    return schema.evolve(next_sales(t), sales(t).schema, "evolve_all", {"onRemovedColumn": "warn"})


READER_TYPES = {
    "o_orderkey": "double",
    "o_custkey": "int",
    "o_orderstatus": "binary",
    "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "int",
    "amount": "decimal(18,2)",
    "off": "decimal(12,4)",
}


@query(
    "schema_readable",
    """WITH n AS (SELECT count(*) AS n FROM orders) SELECT name, data_format, writer, reader, readable, n AS known FROM n, (VALUES
      ('o_orderkey', 'AVRO', 'long', 'double', true), ('o_custkey', 'AVRO', 'long', 'int', false), ('o_orderstatus', 'AVRO', 'string', 'binary', true), ('o_totalprice', 'AVRO', 'double', 'double', true),
      ('o_orderdate', 'AVRO', 'timestamp_ntz', 'timestamp_ntz', true), ('o_orderpriority', 'AVRO', 'string', 'int', false), ('amount', 'AVRO', 'decimal(12,2)', 'decimal(18,2)', true), ('off', 'AVRO', 'decimal(12,2)', 'decimal(12,4)', false),
      ('o_orderkey', 'JSON', 'long', 'double', true), ('o_custkey', 'JSON', 'long', 'int', true), ('o_orderstatus', 'JSON', 'string', 'binary', false), ('o_totalprice', 'JSON', 'double', 'double', true),
      ('o_orderdate', 'JSON', 'timestamp_ntz', 'timestamp_ntz', true), ('o_orderpriority', 'JSON', 'string', 'int', false), ('amount', 'JSON', 'decimal(12,2)', 'decimal(18,2)', true), ('off', 'JSON', 'decimal(12,2)', 'decimal(12,4)', true))
      AS v(name, data_format, writer, reader, readable)""",
)
def schema_readable(t: Tables) -> DataFrame:
    written = t.orders.withColumn("amount", money("o_totalprice")).withColumn("off", money("o_totalprice"))
    reader = F.create_map(*[F.lit(x) for kv in READER_TYPES.items() for x in kv])
    fields = schema.field_table(written).select(
        "name",
        F.when(F.col("type") == "bigint", "long").otherwise(F.col("type")).alias("writer"),
        reader[F.col("name")].alias("reader"),
        "known",
    )
    each = {f: schema.readable(fields, "writer", "reader", f) for f in ("AVRO", "JSON")}
    return windows.labelled(each, "data_format")


def nested_orders(t: Tables) -> DataFrame:
    return nested_lines(t.lineitem)


def nested_lines(lineitem: DataFrame) -> DataFrame:
    """Stream-shaped records: customer, address, items and attributes, some parts missing."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    price = money("l_extendedprice")
    geo = F.struct(F.when(key % 31 != 0, rate_of("l_discount")).alias("latitude"), rate_of("l_tax").alias("longitude"))
    customer = F.struct(
        F.when(key % 7 != 0, F.col("l_suppkey")).alias("id"),
        F.when(key % 11 != 0, F.struct(F.col("l_returnflag").alias("country"), geo.alias("geo"))).alias("address"),
    )
    items = F.array(
        F.struct(F.col("l_partkey").cast("string").alias("sku"), price.alias("price")),
        F.struct(F.when(key % 13 != 0, F.lit("gift")).alias("sku"), F.lit(0).cast("decimal(12,2)").alias("price")),
    )
    attributes = F.create_map(
        F.lit("channel"), F.col("l_linestatus"), F.lit("note"), F.when(key % 17 != 0, F.col("l_returnflag"))
    )
    return lineitem.select(
        F.concat_ws("-", key.cast("string"), line.cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("event_id"),
        F.when(key % 29 != 0, customer).alias("customer"),
        items.alias("items"),
        attributes.alias("attributes"),
        F.col("l_shipdate").alias("event_time"),
    )


def rate_of(c: str):
    return F.col(c).cast("double")


REQUIRED = ["customer.id", "customer.address.geo.latitude", "items[].sku", "attributes[]", "event_time"]

NESTED_ERROR = """CASE WHEN l_orderkey % 29 <> 0 AND l_orderkey % 7 = 0 THEN 'required field customer.id is null'
    WHEN l_orderkey % 29 <> 0 AND l_orderkey % 11 <> 0 AND l_orderkey % 31 = 0 THEN 'required field customer.address.geo.latitude is null'
    WHEN l_orderkey % 13 = 0 THEN 'required field items[].sku is null' WHEN l_orderkey % 17 = 0 THEN 'required field attributes[] is null' END"""
EVENT_ID = "l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR"


@query(
    "required_violations",
    f"SELECT {EVENT_ID} AS event_id, {NESTED_ERROR} AS error FROM lineitem",
)
def required_violations(t: Tables) -> DataFrame:
    records = nested_orders(t)
    spec = schema.with_required(records.schema, REQUIRED)
    return records.select("event_id", schema.required_violation(spec).alias("error"))


# -- personal data and masks -------------------------------------------------------------

LUHN_SQL = """CASE WHEN length(regexp_replace(v, '[^0-9]', '', 'g')) >= 12 AND list_sum(list_transform(string_split(reverse(regexp_replace(v, '[^0-9]', '', 'g')), ''),
    lambda d, i: CASE WHEN i % 2 = 1 THEN d::INTEGER WHEN d::INTEGER > 4 THEN d::INTEGER * 2 - 9 ELSE d::INTEGER * 2 END)) % 10 = 0 THEN 'credit_card' END"""


# Every text column of the tables with texts, and the words of those that hold prose.
PII_CELLS = (("documents", "text"), ("documents", "lang"), ("documents", "source"), ("pages", "url"), ("pages", "html"), ("conversations", "role"), ("conversations", "text"))
PII_PROSE = (("documents", "text"), ("pages", "html"), ("conversations", "text"))


@query(
    "pii_value_scan",
    "WITH v AS ("
    + " UNION ALL ".join(
        [f"SELECT '{t}.{c}' AS place, {c} AS v FROM {t}" for t, c in PII_CELLS]
        + [rf"SELECT '{t}.{c} word', unnest(regexp_split_to_array({c}, '\s+')) FROM {t}" for t, c in PII_PROSE]
    )
    + r"""),
    l AS (SELECT place, unnest([CASE WHEN regexp_matches(v, '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN 'email' END, CASE WHEN regexp_matches(v, '^[+]?[\d\s\-().]{7,}$') THEN 'phone' END,
      CASE WHEN regexp_matches(v, '^\d{3}-\d{2}-\d{4}$') THEN 'ssn' END, CASE WHEN regexp_matches(v, '^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$') THEN 'ip' END,
      CASE WHEN regexp_matches(v, '^(?i)https?://') THEN 'url' END, """
    + LUHN_SQL
    + """]) AS label FROM v) SELECT place, label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY ALL""",
)
def pii_value_scan(t: Tables) -> DataFrame:
    """Labels of every cell of the text columns of documents, pages and conversations, and of every word of their prose. Each table is read once."""
    parts = []
    for name in dict.fromkeys(table for table, _ in PII_CELLS):
        cells = [F.struct(F.lit(f"{name}.{c}").alias("place"), F.col(c).alias("v")) for table, c in PII_CELLS if table == name]
        each = [F.array(*cells)]
        for c in (c for table, c in PII_PROSE if table == name):
            words = F.coalesce(F.filter(F.split(c, r"\s+"), pii.could_be_labelled), F.array().cast("array<string>"))
            place = F.lit(f"{name}.{c} word").alias("place")
            each.append(F.transform(words, lambda w: F.struct(place, w.alias("v"))))
        parts.append(getattr(t, name).select(F.explode(F.concat(*each)).alias("c")).select("c.*"))
    values = reduce(DataFrame.unionByName, parts)
    return (
        values.select("place", F.explode(pii.value_labels(F.col("v"))).alias("label"))
        .groupBy("place", "label")
        .agg(F.count("*").alias("n"))
    )


def people(t: Tables) -> DataFrame:
    """Customers under the column names a source system might use."""
    key = F.col("c_custkey")
    return t.customer.select(
        key.alias("customer_id"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email_address"),
        F.concat(F.lit("+1-555-"), F.lpad(key.cast("string"), 7, "0")).alias("phone_number"),
        F.concat(F.lit("10.0."), (key % 200).cast("string"), F.lit("."), (key % 250).cast("string")).alias("ip_address"),
        F.when(key % 3 != 0, F.concat(F.lit("user"), key.cast("string"))).alias("user_name"),
        F.col("c_mktsegment").alias("segment"),
        money("c_acctbal").alias("balance"),
    )


PEOPLE = """WITH people AS (SELECT c_custkey AS customer_id, c_name AS full_name, lower(replace(c_name, '#', '.')) || '@example.com' AS email_address,
  '+1-555-' || lpad(c_custkey::VARCHAR, 7, '0') AS phone_number, '10.0.' || (c_custkey % 200)::VARCHAR || '.' || (c_custkey % 250)::VARCHAR AS ip_address,
  CASE WHEN c_custkey % 3 <> 0 THEN 'user' || c_custkey::VARCHAR END AS user_name, c_mktsegment AS segment, c_acctbal::DECIMAL(12,2) AS balance FROM customer) """


@query(
    "pii_column_scan",
    PEOPLE
    + """SELECT 'full_name' AS column_name, 'name' AS classes, count(full_name) AS known, 0::BIGINT AS by_value FROM people UNION ALL SELECT 'email_address', 'email', count(email_address), count(*) FROM people
    UNION ALL SELECT 'phone_number', 'phone', count(phone_number), count(CASE WHEN length('1555' || lpad(customer_id::VARCHAR, 7, '0')) >= 7 THEN 1 END) FROM people
    UNION ALL SELECT 'ip_address', 'ip_address', count(ip_address), count(*) FROM people UNION ALL SELECT 'user_name', 'username', count(user_name), 0 FROM people""",
)
def pii_column_scan(t: Tables) -> DataFrame:
    """Columns whose name names a class, beside how many values look personal by themselves."""
    table = people(t)
    classes = {c: pii.name_classes(c) for c in table.columns}
    named = {c: found for c, found in classes.items() if found}
    totals = table.agg(
        *[F.count(c).alias(f"n_{c}") for c in named],
        *[F.count_if(F.size(pii.value_labels(F.col(c).cast("string"))) > 0).alias(f"v_{c}") for c in named],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(",".join(found)).alias("classes"),
            F.col(f"n_{c}").alias("known"),
            F.col(f"v_{c}").alias("by_value"),
        )
        for c, found in named.items()
    ]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Demonstration secrets. A job passes its own, from wherever it keeps them.
SALT = "a-salt-for-the-example-tables"
TOKEN_KEY = b"a-token-key-for-the-example-tables"
CIPHER_KEY = bytes(range(32))
INNER_PAD, OUTER_PAD = crypto.hmac_pads(TOKEN_KEY)


def token_sql(value: str) -> str:
    return f"left(sha256(unhex('{OUTER_PAD}') || unhex(sha256(unhex('{INNER_PAD}') || encode({value})))), 32)"


@query("mask_hash", PEOPLE + f"SELECT customer_id, sha256('{SALT}' || email_address) AS email_address, sha256('{SALT}' || user_name) AS user_name FROM people")
def mask_hash(t: Tables) -> DataFrame:
    treated = {c: crypto.salted_hash(F.col(c), SALT) for c in ("email_address", "user_name")}
    return access.treat(people(t).select("customer_id", "email_address", "user_name"), treated)


@query(
    "mask_partial",
    PEOPLE
    + """SELECT customer_id, repeat('*', length(phone_number) - 4) || right(phone_number, 4) AS phone_number,
      CASE WHEN length(user_name) > 5 THEN left(user_name, 3) || repeat('*', length(user_name) - 5) || right(user_name, 2) ELSE repeat('*', length(user_name)) END AS user_name,
      repeat('*', length(segment)) AS segment FROM people""",
)
def mask_partial(t: Tables) -> DataFrame:
    treated = {
        "phone_number": crypto.partial_mask(F.col("phone_number")),
        "user_name": crypto.partial_mask(F.col("user_name"), keep_first=3, keep_last=2),
        "segment": crypto.partial_mask(F.col("segment"), keep_last=0),
    }
    return access.treat(people(t).select("customer_id", *treated), treated)


@query(
    "mask_tokenize",
    PEOPLE + f"SELECT customer_id, {token_sql('email_address')} AS email_address, {token_sql('user_name')} AS user_name FROM people",
)
def mask_tokenize(t: Tables) -> DataFrame:
    treated = {c: crypto.tokenize(F.col(c), TOKEN_KEY) for c in ("email_address", "user_name")}
    return access.treat(people(t).select("customer_id", *treated), treated)


@query(
    "mask_encrypt",
    PEOPLE + "SELECT customer_id, email_address AS opened, true AS sealed, true AS has_shape FROM people",
)
def mask_encrypt(t: Tables) -> DataFrame:
    """The ciphertext differs on every run, so what is shown is that it opens and hides the value."""
    sealed = people(t).select(
        "customer_id", "email_address", crypto.encrypt(F.col("email_address"), CIPHER_KEY, "email_address").alias("token")
    )
    return sealed.select(
        "customer_id",
        crypto.decrypt(F.col("token"), CIPHER_KEY, "email_address").alias("opened"),
        (F.col("token") != F.col("email_address")).alias("sealed"),
        crypto.has_shape(F.col("token"), crypto.shape_of("encrypt")).alias("has_shape"),
    )


@query(
    "mask_verify",
    PEOPLE
    + """SELECT 'email_address' AS column_name, count(email_address) AS known, count(CASE WHEN customer_id % 50 = 0 THEN email_address END) AS untreated FROM people
    UNION ALL SELECT 'user_name', count(user_name), count(CASE WHEN customer_id % 70 = 0 THEN user_name END) FROM people
    UNION ALL SELECT 'phone_number', count(phone_number), count(CASE WHEN customer_id % 90 = 0 THEN phone_number END) FROM people""",
)
def mask_verify(t: Tables) -> DataFrame:
    """A landing that missed some rows."""

    def missed(c: str, treated, every: int):
        return F.when(F.col("customer_id") % every == 0, F.col(c)).otherwise(treated)

    landed = access.treat(
        people(t),
        {
            "email_address": missed("email_address", crypto.salted_hash(F.col("email_address"), SALT), 50),
            "user_name": missed("user_name", crypto.tokenize(F.col("user_name"), TOKEN_KEY), 70),
            "phone_number": missed("phone_number", crypto.partial_mask(F.col("phone_number")), 90),
        },
    )
    shapes = {"email_address": "hash", "user_name": "tokenize", "phone_number": "mask"}
    return access.untreated(landed, {c: crypto.shape_of(s) for c, s in shapes.items()})


@query(
    "column_mask_rules",
    PEOPLE
    + """SELECT customer_id, CASE WHEN length(user_name) <= 4 THEN sha256(user_name) ELSE 'XXXXX' || right(user_name, 4) END AS user_name,
      CASE WHEN length(customer_id::VARCHAR) <= 4 THEN sha256(customer_id::VARCHAR) ELSE left(customer_id::VARCHAR, 4) || 'XXXXX' END AS short, NULL::VARCHAR AS email_address FROM people""",
)
def column_mask_rules(t: Tables) -> DataFrame:
    return people(t).select(
        "customer_id",
        crypto.masked_for_reader(F.col("user_name"), "last_four").alias("user_name"),
        crypto.masked_for_reader(F.col("customer_id"), "first_four").alias("short"),
        crypto.masked_for_reader(F.col("email_address"), "nullify").alias("email_address"),
    )


RESTRICTIONS = (
    Restriction("*", ("ip_address",), "deny"),
    Restriction("support", ("email_address", "phone_number"), "mask", "last_four"),
    Restriction("analyst", ("email_address",), "mask", "nullify"),
    Restriction("finance", ("balance",), "allow"),
    Restriction("support", ("balance",), "allow"),
    Restriction("support", ("full_name",), "deny"),
    Restriction("support", ("full_name",), "mask", "first_four"),
)


@query(
    "column_access",
    PEOPLE
    + """SELECT 'finance' AS principal, 'customer_id,full_name,email_address,phone_number,user_name,segment,balance' AS columns, customer_id, full_name, email_address, phone_number, balance::DOUBLE AS balance FROM people
    UNION ALL SELECT 'support', 'customer_id,email_address,phone_number,user_name,segment,balance', customer_id, NULL, 'XXXXX' || right(email_address, 4), 'XXXXX' || right(phone_number, 4), balance FROM people
    UNION ALL SELECT 'analyst', 'customer_id,full_name,email_address,phone_number,user_name,segment', customer_id, full_name, NULL, phone_number, NULL FROM people""",
)
def column_access(t: Tables) -> DataFrame:
    shown = ["customer_id", "full_name", "email_address", "phone_number", "balance"]
    parts = []
    for principal in ("finance", "support", "analyst"):
        view = access.readable_columns(people(t), RESTRICTIONS, principal)
        none = {"balance": F.lit(None).cast("decimal(12,2)")}
        parts.append(
            view.select(
                F.lit(principal).alias("principal"),
                F.lit(",".join(view.columns)).alias("columns"),
                *[F.col(c) if c in view.columns else none.get(c, F.lit(None).cast("string")).alias(c) for c in shown],
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


ROW_FILTERS = (
    RowFilter("machinery_team", "segment = 'MACHINERY'"),
    RowFilter("premium_team", "balance > 5000 AND user_name IS NOT NULL"),
)


@query(
    "row_filter",
    PEOPLE
    + """SELECT 'machinery_team' AS principal, customer_id, balance::DOUBLE AS balance FROM people WHERE segment = 'MACHINERY'
    UNION ALL SELECT 'premium_team', customer_id, balance FROM people WHERE balance > 5000 AND user_name IS NOT NULL""",
)
def row_filter(t: Tables) -> DataFrame:
    each = {f.principal: access.filtered_rows(people(t), ROW_FILTERS, f.principal) for f in ROW_FILTERS}
    return windows.labelled(each, "principal").select("principal", "customer_id", "balance")


PEOPLE_MODEL = SemanticModel(
    dimensions={"segment": "segment", "contact": "email_address"},
    measures=(
        Measure("total_balance", "sum", "balance"),
        Measure("customers", "count", "customer_id"),
        Measure("top_email", "max", "email_address"),
        Measure("emails", "count_distinct", "email_address"),
    ),
    metrics=(Metric("wealth", measure="total_balance"),),
)


@query(
    "governed_query",
    PEOPLE
    + """SELECT segment, sum(balance)::DOUBLE AS wealth, count(customer_id) AS customers, '[REDACTED:pii]' AS top_email, count(DISTINCT 'XXXXX' || right(email_address, 4)) AS emails
    FROM people WHERE balance > 5000 AND user_name IS NOT NULL GROUP BY segment""",
)
def governed_query(t: Tables) -> DataFrame:
    """Rows, then columns, then the metric; a value-revealing aggregate over personal data is replaced."""
    view = access.governed(
        people(t),
        principal="premium_team",
        filters=ROW_FILTERS,
        restrictions=[Restriction("premium_team", ("email_address",), "mask", "last_four")],
    )
    metrics = ["wealth", "customers", "top_email", "emails"]
    found = semantic.query_metrics(view, PEOPLE_MODEL, metrics, ["segment"])
    return semantic.redact(found, PEOPLE_MODEL, ["segment"], metrics, {"email_address", "phone_number"})


# -- metrics ------------------------------------------------------------------------------

ORDERS_MODEL = SemanticModel(
    dimensions={"status": "o_orderstatus", "priority": "o_orderpriority", "order_date": "o_orderdate"},
    measures=(
        Measure("revenue", "sum", "CAST(o_totalprice AS DECIMAL(12,2))"),
        Measure("orders", "count", "o_orderkey"),
        Measure("customers", "count_distinct", "o_custkey"),
        Measure("largest", "max", "o_totalprice"),
    ),
    metrics=(
        Metric("total_revenue", measure="revenue"),
        Metric("filled_revenue", measure="revenue", where=(Where("status", "eq", "F"),)),
        Metric("order_value", kind="ratio", numerator="revenue", denominator="orders"),
        Metric("other_revenue", kind="derived", expr="total_revenue - filled_revenue"),
        Metric("revenue_28d", kind="cumulative", measure="revenue", window_days=28),
        Metric("revenue_month_to_date", kind="cumulative", measure="revenue", grain_to_date="month"),
        Metric("rare_orders", measure="orders", where=(Where("priority", "eq", "1-URGENT"), Where("status", "eq", "P")), fill_nulls_with=0),
        Metric("status", measure="revenue"),
    ),
    time_dimension="order_date",
)
PRICE = "o_totalprice::DECIMAL(12,2)"


@query(
    "metric_simple",
    f"""SELECT o_orderstatus AS status, o_orderpriority AS priority, sum({PRICE})::DOUBLE AS total_revenue, count(DISTINCT o_custkey) AS customers,
    count(*) OVER () > 5 AS truncated FROM orders WHERE o_orderpriority = '2-HIGH' OR o_orderpriority = '5-LOW' GROUP BY ALL ORDER BY total_revenue DESC, status, priority LIMIT 5""",
)
def metric_simple(t: Tables) -> DataFrame:
    return semantic.query_metrics(
        t.orders,
        ORDERS_MODEL,
        ["total_revenue", "customers"],
        ["status", "priority"],
        filters=[Where("priority", "in", ["2-HIGH", "5-LOW"])],
        limit=5,
    )


@query(
    "metric_where",
    f"""SELECT o_orderpriority AS priority, sum(CASE WHEN o_orderstatus = 'F' THEN {PRICE} END)::DOUBLE AS filled_revenue, sum({PRICE})::DOUBLE AS total_revenue FROM orders
    WHERE o_orderstatus <> 'P' AND o_orderpriority NOT IN ('5-LOW') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_totalprice <= 400000 AND o_custkey IS NOT NULL GROUP BY 1""",
)
def metric_where(t: Tables) -> DataFrame:
    filters = [
        Where("status", "neq", "P"),
        Where("priority", "notIn", ["5-LOW"]),
        Where("order_date", "gte", "1996-01-01"),
        Where("o_totalprice", "lte", 400000),
        Where("o_custkey", "isNotNull"),
    ]
    return semantic.query_metrics(t.orders, ORDERS_MODEL, ["filled_revenue", "total_revenue"], ["priority"], filters)


@query(
    "metric_derived_ratio",
    f"""SELECT o_orderpriority AS priority, sum({PRICE})::DOUBLE / count(o_orderkey)::DOUBLE AS order_value,
      (sum({PRICE}) - sum(CASE WHEN o_orderstatus = 'F' THEN {PRICE} END))::DOUBLE AS other_revenue FROM orders GROUP BY 1""",
)
def metric_derived_ratio(t: Tables) -> DataFrame:
    return semantic.query_metrics(t.orders, ORDERS_MODEL, ["order_value", "other_revenue"], ["priority"])


@query(
    "metric_cumulative",
    f"""WITH d AS (SELECT o_orderstatus AS status, o_orderdate::DATE AS day, sum({PRICE}) AS v FROM orders GROUP BY ALL),
    w AS (SELECT status, day, sum(v) OVER (PARTITION BY status ORDER BY day RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW) AS rolled,
        sum(v) OVER (PARTITION BY status, date_trunc('month', day) ORDER BY day ROWS UNBOUNDED PRECEDING) AS to_date FROM d)
    SELECT 'day' AS grain, status, day::VARCHAR AS day, rolled::DOUBLE AS revenue_28d, to_date::DOUBLE AS month_to_date FROM w
    UNION ALL SELECT 'month_last', status, date_trunc('month', day)::DATE::VARCHAR, arg_max(rolled, day)::DOUBLE, arg_max(to_date, day)::DOUBLE FROM w GROUP BY ALL
    UNION ALL SELECT 'month_first', status, date_trunc('month', day)::DATE::VARCHAR, arg_min(rolled, day)::DOUBLE, arg_min(to_date, day)::DOUBLE FROM w GROUP BY ALL
    UNION ALL SELECT 'month_average', status, date_trunc('month', day)::DATE::VARCHAR, sum(rolled)::DOUBLE / count(*)::DOUBLE, sum(to_date)::DOUBLE / count(*)::DOUBLE FROM w GROUP BY ALL""",
)
def metric_cumulative(t: Tables) -> DataFrame:
    trailing = semantic.cumulative(t.orders, ORDERS_MODEL, "revenue_28d", ["status"])
    to_date = semantic.cumulative(t.orders, ORDERS_MODEL, "revenue_month_to_date", ["status"])
    daily = trailing.join(to_date, ["status", "day"]).select(
        F.lit("day").alias("grain"),
        "status",
        "day",
        F.col("revenue_28d").cast("double").alias("revenue_28d"),
        F.col("revenue_month_to_date").cast("double").alias("month_to_date"),
    )
    for period in ("last", "first", "average"):
        a = semantic.to_coarser_grain(trailing, "revenue_28d", "month", period, ["status"])
        b = semantic.to_coarser_grain(to_date, "revenue_month_to_date", "month", period, ["status"])
        both = a.join(b, ["status", "period"]).select(
            F.lit(f"month_{period}").alias("grain"),
            "status",
            F.col("period").alias("day"),
            F.col("revenue_28d").cast("double").alias("revenue_28d"),
            F.col("revenue_month_to_date").cast("double").alias("month_to_date"),
        )
        daily = daily.unionByName(both)
    return daily


@query(
    "metric_time_spine",
    """WITH d AS (SELECT o_orderdate::DATE AS day, count(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN o_orderkey END) AS n FROM orders GROUP BY 1)
    SELECT s.day::DATE::VARCHAR AS day, coalesce(n, 0) AS rare_orders FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day) s LEFT JOIN d ON d.day = s.day::DATE""",
)
def metric_time_spine(t: Tables) -> DataFrame:
    daily = semantic.daily_metric(t.orders, ORDERS_MODEL, "rare_orders", [])
    return semantic.on_time_spine(daily, "rare_orders", 0)


@query(
    "metric_relationship",
    f"""SELECT c_mktsegment AS segment, n_name AS nation, sum({PRICE})::DOUBLE AS total_revenue, count(o_orderkey) AS orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def metric_relationship(t: Tables) -> DataFrame:
    placed_by = Link("placed_by", ("o_custkey",), ("c_custkey",))
    lives_in = Link("lives_in", ("nationkey",), ("n_nationkey",))
    joins.require_unique(t.customer, placed_by)
    joins.require_unique(t.nation, lives_in)
    beside = joins.link_join(t.orders, t.customer, placed_by, {"c_mktsegment": "segment", "c_nationkey": "nationkey"})
    beside = joins.link_join(beside, t.nation, lives_in, {"n_name": "nation"})
    model = SemanticModel(
        {**ORDERS_MODEL.dimensions, "segment": "segment", "nation": "nation"}, ORDERS_MODEL.measures, ORDERS_MODEL.metrics
    )
    return semantic.query_metrics(beside, model, ["total_revenue", "orders"], ["segment", "nation"])


@query(
    "metric_scd",
    """WITH versions AS (SELECT o_custkey, o_orderdate::DATE AS start, o_orderpriority AS tier FROM orders), ordered AS (SELECT *, lead(start) OVER (PARTITION BY o_custkey ORDER BY start) AS following,
      count(*) OVER (PARTITION BY o_custkey, start) AS matches FROM versions), lines AS (SELECT o_custkey AS custkey, l_shipdate::DATE AS shipped, l_quantity::DECIMAL(12,2) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT tier, sum(q)::DOUBLE AS quantity, count(*) AS lines FROM lines LEFT JOIN ordered ON custkey = o_custkey AND matches = 1 AND start <= shipped AND (following IS NULL OR shipped < following) GROUP BY tier""",
)
def metric_scd(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("custkey"), day("l_shipdate").alias("shipped"), money("l_quantity").alias("q")
    )
    versions = customer_versions(t).select("o_custkey", "start", "tier")
    placed = joins.as_of_join(
        lines,
        versions,
        fact_key=["custkey"],
        version_key=["o_custkey"],
        fact_date="shipped",
        window=Validity("start"),
        attributes=["tier"],
    )
    model = SemanticModel({"tier": "tier"}, (Measure("quantity", "sum", "q"), Measure("lines", "count", "q")), ())
    return semantic.query_metrics(placed, model, ["quantity", "lines"], ["tier"])


@query(
    "metric_alias",
    f"""SELECT o_orderstatus AS status, sum({PRICE})::DOUBLE AS revenue, sum({PRICE})::DOUBLE AS total_revenue, sum(CASE WHEN o_orderstatus = 'F' THEN {PRICE} END)::DOUBLE AS filled_revenue FROM orders GROUP BY 1""",
)
def metric_alias(t: Tables) -> DataFrame:
    """Two metrics on one measure stay apart; one named like a dimension takes its measure's name."""
    return semantic.query_metrics(
        t.orders, ORDERS_MODEL, ["status", "total_revenue", "filled_revenue"], ["status", "status"]
    )
