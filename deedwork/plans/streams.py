"""Streams over the tables, run to the end of what is there, and compared as the tables they land."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedwork.functions import crypto
from deedwork.functions.values import money
from deedwork.operators import schema, windows
from deedwork.plans.governance import EVENT_ID, NESTED_ERROR, REQUIRED, TOKEN_KEY, nested_lines, nested_orders, token_sql
from deedwork.plans.registry import query
from deedwork.session import Tables
from deedwork.streaming import landing, late


def topic_records(events: DataFrame) -> DataFrame:
    """Events as a topic's records. Some values are cut short, some lack a required field."""
    key = F.col("event_id")
    value = F.to_json(
        F.struct(
            key.alias("event_id"),
            F.when(key % 7 != 0, F.col("user_id")).alias("user_id"),
            "event_type",
            money("value").alias("amount"),
            F.struct(F.when(key % 11 != 0, F.get_json_object("props", "$.k").cast("int")).alias("k")).alias("detail"),
        )
    )
    cut = F.when(key % 10 == 0, F.substring(value, 1, 15)).otherwise(value)
    return events.select(
        F.lit("events").alias("topic"),
        (key % 4).cast("int").alias("partition"),
        key.alias("offset"),
        F.col("ts").alias("timestamp"),
        F.to_json(F.struct(key.alias("id"))).cast("binary").alias("key"),
        cut.cast("binary").alias("value"),
    )


EVENT_SPEC = landing.TopicSpec(
    T.StructType(
        [
            T.StructField("event_id", T.LongType(), False),
            T.StructField("user_id", T.LongType(), False),
            T.StructField("event_type", T.StringType()),
            T.StructField("amount", T.DecimalType(12, 2)),
            T.StructField("detail", T.StructType([T.StructField("k", T.IntegerType(), False)])),
        ]
    )
)
ERROR_SQL = """CASE WHEN event_id % 10 = 0 THEN 'the value is not JSON of the declared fields and types' WHEN event_id % 7 = 0 THEN 'required field user_id is null'
    WHEN event_id % 11 = 0 THEN 'required field detail.k is null' END"""


def run_checked(t: Tables, transform=None, spec: landing.TopicSpec = EVENT_SPEC) -> tuple[str, str]:
    good, dead, checkpoint = t.scratch("good"), t.scratch("dead"), t.scratch("checkpoint")
    landing.land_checked(
        topic_records(t.stream("events")), spec, good, dead, checkpoint, most_dead=2**62, transform=transform
    )
    return good, dead


@query(
    "read_kafka_json",
    f"""SELECT event_id, user_id, event_type, value::DECIMAL(12,2)::DOUBLE AS amount, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id AS id, 'events' AS topic FROM events WHERE ({ERROR_SQL}) IS NULL""",
)
def read_kafka_json(t: Tables) -> DataFrame:
    """Typed value and key of a topic's records. The records come from a file stream here."""
    spec = landing.TopicSpec(EVENT_SPEC.value, T.StructType([T.StructField("id", T.LongType())]))
    good, _ = run_checked(t, spec=spec)
    return t.spark.read.parquet(good).select(
        "event_id", "user_id", "event_type", "amount", F.col("detail.k").alias("k"), F.col("key.id").alias("id"), "topic"
    )


@query("stream_event_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_time FROM events")
def stream_event_time(t: Tables) -> DataFrame:
    """Events under a five-second watermark, a repeated one within it once, with those that came behind it beside them."""
    path, side = t.scratch("timed"), t.scratch("timed" + late.LATE_SUFFIX)
    stream = t.stream("events").select("event_id", F.col("ts").alias("event_time"))

    late.land_once(stream, path, side, t.scratch("checkpoint"), column="event_time", key="event_id", delay="PT5S")
    both = landing.landed(t.spark, path, stream.schema).unionByName(landing.landed(t.spark, side, stream.schema))
    return both.select("event_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"))


@query(
    "late_classify",
    """WITH b AS (SELECT event_id, date_diff('microsecond', ts, (SELECT max(ts) FROM events) - INTERVAL 5 DAY) AS us FROM events)
    SELECT event_id, CASE WHEN us < 0 THEN 'future' WHEN us > 172800000000 THEN 'late' ELSE 'on_time' END AS category, CASE WHEN us < 0 OR us > 172800000000 THEN us::DOUBLE / 1000000 ELSE 0 END AS lateness_seconds FROM b""",
)
def late_classify(t: Tables) -> DataFrame:
    """What a stream has landed against the watermark it stored, five days behind the newest event."""
    path, side = t.scratch("classified"), t.scratch("classified" + late.LATE_SUFFIX)
    stream = t.stream("events").select("event_id", "ts")

    def each(batch: DataFrame, batch_id: int) -> None:
        late.land_split(batch, batch_id, path, side, column="ts", allowed_lateness="PT0S")

    landing.run_available(stream, t.scratch("checkpoint"), each)
    newest = late.newest_time(t.spark, path + landing.STATE_SUFFIX, stream.schema["ts"].dataType)
    mark = newest - F.expr("INTERVAL 5 DAYS")
    held = landing.landed(t.spark, path, stream.schema)
    return late.classify(held, "ts", mark, "P2D").select("event_id", "category", "lateness_seconds")


@query(
    "late_split",
    """WITH m AS (SELECT max(ts) AS newest FROM events) SELECT CASE WHEN date_diff('microsecond', ts, newest) > 604800000000 THEN 'events__late_events' ELSE 'events' END AS target, event_id FROM events, m""",
)
def late_split(t: Tables) -> DataFrame:
    """Two targets of one stream: split per micro-batch against the newest time up to it, then settled."""
    main, side = t.scratch("events"), t.scratch("events" + late.LATE_SUFFIX)
    stream = t.stream("events").select("event_id", "ts")

    def each(batch: DataFrame, batch_id: int) -> None:
        late.land_split(batch, batch_id, main, side, column="ts", allowed_lateness="P7D")

    landing.run_available(stream, t.scratch("checkpoint"), each)
    kept, late_rows = late.settled(t.spark, main, side, stream.schema, column="ts", allowed_lateness="P7D")
    return windows.labelled({"events": kept.select("event_id"), "events__late_events": late_rows.select("event_id")}, "target")


@query(
    "event_time_detect",
    """SELECT 'events' AS table_name, 'ts' AS event_time, count(ts) AS known, min(ts)::VARCHAR AS first, max(ts)::VARCHAR AS last FROM events UNION ALL SELECT 'orders', 'o_orderdate', count(o_orderdate), min(o_orderdate)::VARCHAR, max(o_orderdate)::VARCHAR FROM orders
    UNION ALL SELECT 'lines', 'promised', count(*), min(o_orderdate + INTERVAL 30 DAY)::VARCHAR, max(o_orderdate + INTERVAL 30 DAY)::VARCHAR FROM orders""",
)
def event_time_detect(t: Tables) -> DataFrame:
    later = (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("promised")
    tables = {
        "events": (t.events, None),
        "orders": (t.orders, None),
        "lines": (t.orders.select("o_orderdate", later), "promised"),
    }
    parts = {}
    for name, (df, explicit) in tables.items():
        found = late.event_time_column(df.schema, explicit)
        parts[name] = df.agg(F.count(found).alias("known"), F.min(found).alias("first"), F.max(found).alias("last")).withColumn(
            "event_time", F.lit(found)
        )
    return windows.labelled(parts, "table_name")


@query(
    "stream_dead_letter",
    f"""WITH e AS (SELECT *, {ERROR_SQL} AS error FROM events) SELECT 'landed' AS target, event_id AS "offset", NULL AS error, NULL::BIGINT AS value_bytes FROM e WHERE error IS NULL
    UNION ALL SELECT 'dead', event_id, error, CASE WHEN event_id % 10 = 0 THEN 15 ELSE octet_length(encode('{{"event_id":' || event_id || CASE WHEN event_id % 7 <> 0 THEN ',"user_id":' || user_id ELSE '' END || ',"event_type":"' || event_type || '","amount":' || value::DECIMAL(12,2)
      || ',"detail":{{' || CASE WHEN event_id % 11 <> 0 THEN '"k":' || json_extract_string(props, '$.k') ELSE '' END || '}}}}')) END FROM e WHERE error IS NOT NULL""",
)
def stream_dead_letter(t: Tables) -> DataFrame:
    good, dead = run_checked(t)
    none = F.lit(None).cast("string")
    parts = {
        "landed": t.spark.read.parquet(good).select("offset", none.alias("error"), F.lit(None).cast("int").alias("value_bytes")),
        "dead": t.spark.read.parquet(dead).select("offset", "error", F.octet_length("value").alias("value_bytes")),
    }
    return windows.labelled(parts, "target")


@query(
    "stream_dead_letter_abort",
    f"SELECT true AS stopped, count(*) AS dead_letters, count(*) > 5 AS over_limit FROM events WHERE ({ERROR_SQL}) IS NOT NULL",
)
def stream_dead_letter_abort(t: Tables) -> DataFrame:
    """The batch that passes the limit lands on both sides, then the stream stops."""
    good, dead, checkpoint = t.scratch("good"), t.scratch("dead"), t.scratch("checkpoint")
    stopped = False
    try:
        landing.land_checked(topic_records(t.stream("events")), EVENT_SPEC, good, dead, checkpoint, most_dead=5)
    except Exception as e:  # noqa: BLE001 - the stream wraps the error
        if landing.TooManyDeadLetters.__name__ not in str(e):
            raise
        stopped = True
    return t.spark.read.parquet(dead).agg(F.count("*").alias("dead_letters")).select(
        F.lit(stopped).alias("stopped"), "dead_letters", (F.col("dead_letters") > 5).alias("over_limit")
    )


@query(
    "batch_dead_letter",
    f"""WITH x AS (SELECT {EVENT_ID} AS event_id, {NESTED_ERROR} AS error, l_shipdate FROM lineitem) SELECT 'passed' AS target, event_id, NULL AS error, NULL AS run_id, NULL AS shipped FROM x WHERE error IS NULL
    UNION ALL SELECT 'dead', event_id, error, 'run-1', strftime(l_shipdate, '%Y-%m-%d') FROM x WHERE error IS NOT NULL""",
)
def batch_dead_letter(t: Tables) -> DataFrame:
    records = nested_orders(t)
    passed, dead = schema.output_errors(records, schema.with_required(records.schema, REQUIRED), "run-1")
    none = F.lit(None).cast("string")
    parts = {
        "passed": passed.select("event_id", none.alias("error"), none.alias("run_id"), none.alias("shipped")),
        "dead": dead.select(
            F.get_json_object("row_json", "$.event_id").alias("event_id"),
            "error",
            "run_id",
            F.left(F.get_json_object("row_json", "$.event_time"), F.lit(10)).alias("shipped"),
        ),
    }
    return windows.labelled(parts, "target")


@query(
    "stream_mask_ingest",
    f"SELECT event_id, {token_sql('user_id::VARCHAR')} AS user_id, event_type FROM events WHERE ({ERROR_SQL}) IS NULL",
)
def stream_mask_ingest(t: Tables) -> DataFrame:
    """The user is a token before anything is written, and the raw bytes are not kept."""

    def masked(rows: DataFrame) -> DataFrame:
        return rows.select("event_id", crypto.tokenize(F.col("user_id"), TOKEN_KEY).alias("user_id"), "event_type")

    good, _ = run_checked(t, masked)
    return t.spark.read.parquet(good).drop(landing.BATCH)


ORDER_ITEM = {
    "event_id": "event_id",
    "customer_id": "customer.id",
    "country": "customer.address.country",
    "latitude": "customer.address.geo.latitude",
    "channel": "attributes['channel']",
    "sku": "item.sku",
    "price": "item.price",
}


@query(
    "stream_flatten",
    f"""WITH x AS (SELECT {EVENT_ID} AS event_id, CASE WHEN l_orderkey % 29 <> 0 AND l_orderkey % 7 <> 0 THEN l_suppkey END AS customer_id, CASE WHEN l_orderkey % 29 <> 0 AND l_orderkey % 11 <> 0 THEN l_returnflag END AS country,
      CASE WHEN l_orderkey % 29 <> 0 AND l_orderkey % 11 <> 0 AND l_orderkey % 31 <> 0 THEN l_discount END AS latitude, l_linestatus AS channel, l_partkey, l_extendedprice, l_orderkey FROM lineitem)
    SELECT event_id, customer_id, country, latitude, channel, l_partkey::VARCHAR AS sku, l_extendedprice::DECIMAL(12,2)::DOUBLE AS price FROM x
    UNION ALL SELECT event_id, customer_id, country, latitude, channel, CASE WHEN l_orderkey % 13 <> 0 THEN 'gift' END, 0 FROM x""",
)
def stream_flatten(t: Tables) -> DataFrame:
    flat = landing.flatten(nested_lines(t.stream("lineitem")), items="items", fields=ORDER_ITEM)
    path = t.scratch("flat")
    landing.land_stream(flat, path, t.scratch("checkpoint"))
    return t.spark.read.parquet(path).drop(landing.BATCH)


@query("stream_exactly_once", "SELECT event_id, event_type FROM events")
def stream_exactly_once(t: Tables) -> DataFrame:
    """Every batch is delivered twice, as after a crash between write and commit; it lands once."""
    path = t.scratch("once")

    def each(batch: DataFrame, batch_id: int) -> None:
        landing.land_batch(batch, batch_id, path)
        landing.land_batch(batch, batch_id, path)

    landing.run_available(t.stream("events").select("event_id", "event_type"), t.scratch("checkpoint"), each)
    return t.spark.read.parquet(path).drop(landing.BATCH)


@query(
    "stream_freshness",
    """WITH c AS (SELECT event_type, ts, CASE WHEN event_type = 'view' THEN 'replace' WHEN event_id % 3 = 0 THEN 'replace' ELSE 'append' END AS op FROM events),
    n AS (SELECT event_type, max(ts) FILTER (op = 'append') AS last, count(*) FILTER (op = 'append') AS writes FROM c GROUP BY 1),
    a AS (SELECT event_type, writes, greatest(CASE WHEN last <= TIMESTAMP '2024-01-30 22:00:00' THEN date_diff('microsecond', last, TIMESTAMP '2024-01-30 22:00:00') // 1000000 ELSE 0 END, 0) AS age, last FROM n)
    SELECT event_type, writes, CASE WHEN last IS NULL THEN 0 ELSE age END AS age_seconds, CASE WHEN last IS NULL THEN 'fail' WHEN age <= 600 THEN 'pass' ELSE 'fail' END AS verdict FROM a""",
)
def stream_freshness(t: Tables) -> DataFrame:
    """Commits of five tables; one has only compactions, which write no data."""
    operation = F.when((F.col("event_type") == "view") | (F.col("event_id") % 3 == 0), "replace").otherwise("append")
    commits = t.events.select("event_type", "ts", operation.alias("op"))
    return late.freshness(commits, "2024-01-30 22:00:00", "PT10M", table="event_type", at="ts", operation="op")
