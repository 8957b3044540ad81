"""Sources, sinks and load modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedwork.functions.values import day, money
from deedwork.operators import windows
from deedwork.plans.registry import query
from deedwork.session import Tables
from deedwork.sources.buckets import BucketedTable
from deedwork.sources import readers, sinks
from deedwork.streaming import landing

LINES = "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_returnflag FROM lineitem"
ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::VARCHAR AS o_orderdate, o_orderpriority FROM orders"


@query(
    "read_parquet",
    "SELECT l_returnflag, count(*) AS rows, count(DISTINCT l_orderkey) AS orders FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem) GROUP BY 1",
)
def read_parquet(t: Tables) -> DataFrame:
    """Several files as one table, two columns of them."""
    both = readers.read_parquet(t.spark, t.path("lineitem"), t.path("lineitem"), columns=["l_returnflag", "l_orderkey"])
    return both.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.countDistinct("l_orderkey").alias("orders"))


@query(
    "read_csv",
    """SELECT 'declared' AS form, c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer
    UNION ALL SELECT 'inferred tabs', c_custkey, c_name, c_nationkey::BIGINT, c_acctbal, c_mktsegment FROM customer""",
)
def read_csv(t: Tables) -> DataFrame:
    comma, tab = t.scratch("customer-csv"), t.scratch("customer-tsv")
    sinks.write(t.customer, comma, format="csv")
    sinks.write(t.customer, tab, format="csv", sep="\t")
    declared = readers.read_csv(t.spark, comma, schema=t.customer.schema)
    inferred = readers.read_csv(t.spark, tab, sep="\t").withColumn("c_custkey", F.col("c_custkey").cast("bigint"))
    return windows.labelled({"declared": declared, "inferred tabs": inferred}, "form")


EVENT_LINE = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DecimalType(12, 2)),
    ]
)


@query(
    "read_json_lines",
    """SELECT event_id, event_type, value::DECIMAL(12,2)::DOUBLE AS value, (event_id % 10 = 0) AS broken FROM (SELECT CASE WHEN event_id % 10 <> 0 THEN event_id END AS id, * FROM events) WHERE id IS NOT NULL
    UNION ALL SELECT NULL, NULL, NULL, true FROM events WHERE event_id % 10 = 0""",
)
def read_json_lines(t: Tables) -> DataFrame:
    """Every tenth line is cut short; those come back as broken, blank lines not at all."""
    line = F.to_json(F.struct("event_id", "event_type", money("value").alias("value")))
    cut = F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 12)).otherwise(line)
    spaced = F.when(F.col("event_id") % 4 == 0, F.concat(cut, F.lit("\n"))).otherwise(cut)
    path = t.scratch("events-json")
    t.events.select(spaced.alias("value")).write.text(path)
    read = readers.read_json_lines(t.spark, path, schema=EVENT_LINE, exact=True)
    return read.select("event_id", "event_type", "value", F.col(readers.CORRUPT).isNotNull().alias("broken"))


@query("read_orc_avro", ORDERS)
def read_orc_avro(t: Tables) -> DataFrame:
    """ORC; Avro files need a package that is not part of Spark itself."""
    path = t.scratch("orders-orc")
    sinks.write(t.orders, path, format="orc")
    return readers.read_orc(t.spark, path)


@query(
    "read_jdbc",
    """WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), s AS (SELECT lo, greatest((hi - lo + 8) // 8, 1) AS step FROM b)
    SELECT least((o_orderkey - lo) // step, 7) AS part, count(*) AS rows FROM orders, s GROUP BY 1""",
)
def read_jdbc(t: Tables) -> DataFrame:
    """How a database read would be split over connections: each row under exactly one predicate."""
    ends = t.orders.agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).first()
    predicates = readers.jdbc_predicates("o_orderkey", ends["lo"], ends["hi"], 8)
    hits = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(i)) for i, p in enumerate(predicates)]))
    return t.orders.select(F.explode(hits).alias("part")).groupBy("part").agg(F.count("*").alias("rows"))


@query("select_columns_read", "SELECT o_orderkey, o_totalprice FROM orders")
def select_columns_read(t: Tables) -> DataFrame:
    return readers.read_parquet(t.spark, t.path("orders"), columns=["o_orderkey", "o_totalprice"])


@query(
    "introspect_table",
    """SELECT 'orders' AS table_name, position, column_name, type, (SELECT count(*) FROM orders) AS rows FROM (VALUES (1, 'o_orderkey', 'bigint'), (2, 'o_custkey', 'bigint'), (3, 'o_orderstatus', 'string'),
      (4, 'o_totalprice', 'double'), (5, 'o_orderdate', 'timestamp_ntz'), (6, 'o_orderpriority', 'string')) AS v(position, column_name, type)""",
)
def introspect_table(t: Tables) -> DataFrame:
    return readers.rows_and_schema(t.orders, "orders")


@query(
    "canonical_wire",
    """SELECT event_id, strftime(ts::DATE, '%Y-%m-%dT00:00:00.000Z') AS day, CASE WHEN microsecond(ts) % 1000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS at,
      strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS second, value::DECIMAL(12,2)::VARCHAR AS value FROM events""",
)
def canonical_wire(t: Tables) -> DataFrame:
    return readers.wire_form(
        t.events.select(
            "event_id",
            day("ts").alias("day"),
            F.col("ts").alias("at"),
            F.date_trunc("second", "ts").cast("timestamp_ntz").alias("second"),
            money("value").alias("value"),
        )
    )


@query("sample_rows", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_name DESC, c_custkey LIMIT 25")
def sample_rows(t: Tables) -> DataFrame:
    return readers.sample_rows(t.customer, ["c_custkey", "c_name", "c_mktsegment"], [F.desc("c_name"), "c_custkey"], 25)


def some_lines(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("write_overwrite", f"SELECT *, (SELECT count(*) FROM lineitem) AS written FROM ({LINES})")
def write_overwrite(t: Tables) -> DataFrame:
    path = t.scratch("overwrite")
    sinks.write(t.orders.select("o_orderkey"), path)
    written = sinks.write(some_lines(t), path)
    return t.spark.read.parquet(path).withColumn("written", F.lit(written).cast("bigint"))


@query("write_append", f"{LINES} UNION ALL {LINES} WHERE l_returnflag = 'R'")
def write_append(t: Tables) -> DataFrame:
    path = t.scratch("append")
    sinks.write(some_lines(t), path)
    sinks.write(some_lines(t).where("l_returnflag = 'R'"), path, mode="append")
    return t.spark.read.parquet(path)


@query("write_dry_run", "SELECT count(*) AS would_write, 0::BIGINT AS written FROM lineitem")
def write_dry_run(t: Tables) -> DataFrame:
    path = t.scratch("never")
    rows = sinks.write(some_lines(t), path, dry_run=True)
    held = sinks.existing(t.spark, path)
    written = 0 if held is None else held.count()
    return t.spark.range(1).select(F.lit(rows).cast("bigint").alias("would_write"), F.lit(written).cast("bigint").alias("written"))


@query(
    "write_targets",
    "WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT 'parquet' AS target, * FROM s UNION ALL SELECT 'csv', * FROM s",
)
def write_targets(t: Tables) -> DataFrame:
    result = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    a, b = t.scratch("target"), t.scratch("target-csv")
    sinks.write_targets(result, [(a, "parquet"), (b, "csv")])
    return windows.labelled(
        {"parquet": t.spark.read.parquet(a), "csv": readers.read_csv(t.spark, b, schema=result.schema)}, "target"
    )


def dated_orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("year"))


@query(
    "land_partitioned",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN 0 ELSE o_totalprice END AS o_totalprice, o_orderstatus, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) < 2000 OR o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, year(o_orderdate) FROM orders WHERE year(o_orderdate) = 1995""",
)
def land_partitioned(t: Tables) -> DataFrame:
    """All years land, a refresh replaces the last two, an append doubles the first."""
    path = t.scratch("landed")
    sinks.land_partitioned(dated_orders(t), path, ["year"], required=["year"])
    recent = dated_orders(t).where("year >= 2000 AND o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0))
    sinks.land_partitioned(recent, path, ["year"], required=["year"])
    sinks.land_partitioned(dated_orders(t).where("year = 1995"), path, ["year"], mode="append")
    return t.spark.read.parquet(path)


@query(
    "batch_replace_partitions",
    """SELECT month, total FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total FROM orders WHERE year(o_orderdate) <> 1998 GROUP BY 1)
    UNION ALL SELECT strftime(o_orderdate, '%Y-%m'), sum(o_totalprice::DECIMAL(12,2))::DOUBLE FROM orders WHERE year(o_orderdate) = 1998 AND o_orderstatus <> 'P' GROUP BY 1""",
)
def batch_replace_partitions(t: Tables) -> DataFrame:
    """A rerun of 1998 replaces its months and no others."""

    def totals(orders: DataFrame) -> DataFrame:
        return orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
            F.sum(money("o_totalprice")).alias("total")
        )

    path = t.scratch("monthly")
    sinks.land_partitioned(totals(t.orders), path, ["month"])
    sinks.land_partitioned(totals(t.orders.where("year(o_orderdate) = 1998 AND o_orderstatus <> 'P'")), path, ["month"])
    return t.spark.read.schema("total decimal(22,2), month string").parquet(path).select("month", "total")


@query("load_full_refresh", ORDERS)
def load_full_refresh(t: Tables) -> DataFrame:
    path = t.scratch("refresh")
    sinks.full_refresh(t.orders.where("o_orderstatus = 'F'"), path)
    sinks.full_refresh(t.orders, path)
    return t.spark.read.parquet(path)


@query("load_incremental_append", "SELECT event_id, ts::VARCHAR AS ts, event_type FROM events")
def load_incremental_append(t: Tables) -> DataFrame:
    """Two loads over a cursor, and a third that finds nothing new."""
    path = t.scratch("incremental")
    events = t.events.select("event_id", "ts", "event_type")
    sinks.incremental_append(events.where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'"), path, "ts")
    sinks.incremental_append(events, path, "ts")
    sinks.incremental_append(events, path, "ts")
    return t.spark.read.parquet(path)


@query(
    "load_incremental_dedup",
    "SELECT user_id, event_id, ts::VARCHAR AS ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def load_incremental_dedup(t: Tables) -> DataFrame:
    """Two loads into a stored table of one row a user; the second one, run again, changes nothing."""
    table, events = BucketedTable(t.spark, t.scratch("newest"), ["user_id"], 8), t.events.select("user_id", "event_id", "ts", "event_type")

    def newest(old: DataFrame | None, rows: DataFrame) -> DataFrame:
        return sinks.newest_per_key(rows if old is None else old.unionByName(rows), ["user_id"], ["ts", "event_id"])

    table.load(1, events.where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'"), newest)
    for _ in range(2):
        table.load(2, events.where("ts >= TIMESTAMP_NTZ '2024-01-14 00:00:00'"), newest)
    return table.read()


ORDER_ROW = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(
    "load_incremental_merge",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0""",
)
def load_incremental_merge(t: Tables) -> DataFrame:
    rows = t.orders.select(*ORDER_ROW)
    changes = rows.where("o_orderkey % 5 = 0").withColumns(
        {"o_orderstatus": F.lit("M"), "o_totalprice": F.col("o_totalprice") + 100}
    )
    table = BucketedTable(t.spark, t.scratch("merged"), ["o_orderkey"], 8)
    table.load(1, rows.where("o_orderkey % 3 <> 0"), lambda _, new: new)
    for _ in range(2):
        table.load(2, changes, lambda old, new: sinks.merge(old, new, ["o_orderkey"]))
    return table.read()


def change_feed(t: Tables) -> DataFrame:
    """Inserts, updates and deletes of orders, in a sequence."""
    rows = t.orders.select(*ORDER_ROW)

    def changes(where: str, operation: str, step: int) -> DataFrame:
        return rows.where(where).select(
            *ORDER_ROW, F.lit(operation).alias("op"), (F.col("o_orderkey") * 10 + step).alias("seq")
        )

    updated = changes("o_orderkey % 4 = 0", "update", 2).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    again = changes("o_orderkey % 28 = 0", "insert", 4)
    return (
        changes("o_orderkey % 3 = 0", "insert", 1)
        .unionByName(updated)
        .unionByName(changes("o_orderkey % 7 = 0", "delete", 3))
        .unionByName(again)
    )


@query(
    "load_cdc_apply",
    """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 28 <> 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
    WHERE o_orderkey % 28 = 0 OR o_orderkey % 7 <> 0""",
)
def load_cdc_apply(t: Tables) -> DataFrame:
    """A change feed as a stream: each micro-batch is a load of the buckets it touches; at its end the deletes are forgotten."""
    table, files, feed = BucketedTable(t.spark, t.scratch("fed"), ["o_orderkey"], 8), t.scratch("feed"), change_feed(t)
    held = t.orders.select(*ORDER_ROW).where("o_orderkey % 3 <> 0").withColumns({"op": F.lit("insert"), "seq": F.lit(0).cast("bigint")})
    table.load(0, held, lambda _, rows: rows)
    feed.repartition(3).write.parquet(files)
    stream = t.spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(files)
    landing.run_available(stream, t.scratch("checkpoint"), lambda batch, batch_id: table.feed(batch_id + 1, batch, "seq"))
    last = table.versions()[-1]
    table.settle(last + 1, table.read().agg(F.max("seq")).first()[0], "seq", "op")
    return table.read().drop("op", "seq")


@query(
    "cursor_rewind",
    """WITH c AS (SELECT n_name AS product, n_regionkey, max(o_orderkey) AS old, max(o_orderkey) FILTER (n_nationkey % 2 = 0 OR o_orderkey % 3 = 0) AS new FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT r_name AS consumer, count(*) AS rewound_products FROM c JOIN region ON n_regionkey = r_regionkey WHERE new < old GROUP BY 1""",
)
def cursor_rewind(t: Tables) -> DataFrame:
    """Regions consume their nations' products; some of those re-read from an earlier order."""
    placed = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("product"))
        .agg(
            F.max("o_orderkey").alias("old"),
            F.max(F.when((F.col("n_nationkey") % 2 == 0) | (F.col("o_orderkey") % 3 == 0), F.col("o_orderkey"))).alias("new"),
        )
    )
    edges = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("product"), F.col("r_name").alias("consumer")
    )
    return sinks.rewound_consumers(placed, edges)
