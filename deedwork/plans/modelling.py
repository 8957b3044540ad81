"""Hash-keyed modelling, dimensions and facts, embeddings, upkeep and hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedwork.functions import crypto
from deedwork.functions.values import day, money
from deedwork.operators import modelling, quality, upkeep, vectors, windows
from deedwork.plans.governance import TOKEN_KEY, token_sql
from deedwork.plans.quality import SALES, sales
from deedwork.plans.registry import query
from deedwork.session import Tables
from deedwork.sources import sinks


def canonical_sql(c: str) -> str:
    return f"CASE WHEN coalesce(trim({c}::VARCHAR), '') = '' THEN '^^' ELSE upper(trim({c}::VARCHAR)) END"


def key_sql(*columns: str) -> str:
    return "sha256(" + " || '||' || ".join(canonical_sql(c) for c in columns) + ")"


def diff_sql(**columns: str) -> str:
    return "sha256(" + " || '||' || ".join(f"'{n.upper()}=' || {canonical_sql(c)}" for n, c in sorted(columns.items())) + ")"


@query(
    "dv_hash_key",
    f"""WITH p AS (SELECT p_partkey, '  ' || p_name || ' ' AS name, CASE WHEN p_partkey % 5 = 0 THEN '   ' WHEN p_partkey % 7 <> 0 THEN p_brand END AS brand FROM part)
    SELECT p_partkey, {key_sql('p_partkey', 'name', 'brand')} AS sha, md5(CASE WHEN coalesce(trim(brand), '') = '' THEN 'n/a' ELSE trim(brand) END || '-' || trim(name)) AS md5 FROM p""",
)
def dv_hash_key(t: Tables) -> DataFrame:
    brand = F.when(F.col("p_partkey") % 5 == 0, "   ").when(F.col("p_partkey") % 7 != 0, F.col("p_brand"))
    parts = t.part.select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("name"), brand.alias("brand"))
    plain = modelling.HashStrategy("md5", "-", "n/a", upper_case=False)
    return parts.select(
        "p_partkey",
        modelling.hash_key(["p_partkey", "name", "brand"]).alias("sha"),
        modelling.hash_key(["brand", "name"], plain).alias("md5"),
    )


@query(
    "dv_hash_diff",
    f"SELECT p_partkey, {diff_sql(p_name='p_name', p_brand='p_brand', p_size='p_size')} AS diff, true AS same_order FROM part",
)
def dv_hash_diff(t: Tables) -> DataFrame:
    a = modelling.hash_diff(["p_name", "p_brand", "p_size"])
    b = modelling.hash_diff(["p_size", "p_name", "p_brand"])
    return t.part.select("p_partkey", a.alias("diff"), (a == b).alias("same_order"))


def order_feed(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", day("o_orderdate").alias("loaded")
    )


@query(
    "dv_load",
    f"""WITH f AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_orderdate::DATE AS loaded, {key_sql('o_custkey')} AS hk, {diff_sql(o_orderpriority='o_orderpriority', o_orderstatus='o_orderstatus')} AS hd FROM orders),
    hub AS (SELECT hk, min(loaded) AS load_date FROM f GROUP BY 1), held AS (SELECT DISTINCT hk FROM f WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'),
    s AS (SELECT *, lag(hd) OVER (PARTITION BY hk ORDER BY loaded, o_orderkey) AS was, row_number() OVER (PARTITION BY hk ORDER BY loaded DESC, o_orderkey DESC) AS back FROM f)
    SELECT 'hub' AS kind, hk AS key, load_date::VARCHAR AS load_date, count(*) AS n FROM hub WHERE hk NOT IN (SELECT hk FROM held) GROUP BY ALL
    UNION ALL SELECT 'link', {key_sql('o_custkey', 'o_orderkey')}, min(loaded)::VARCHAR, 1 FROM f GROUP BY o_custkey, o_orderkey
    UNION ALL SELECT 'satellite type2', hk, loaded::VARCHAR, count(*) FROM s WHERE was IS DISTINCT FROM hd GROUP BY ALL
    UNION ALL SELECT 'satellite type1', hk, loaded::VARCHAR, count(*) FROM s WHERE back = 1 GROUP BY ALL UNION ALL SELECT 'satellite append_only', hk, loaded::VARCHAR, count(*) FROM s GROUP BY ALL""",
)
def dv_load(t: Tables) -> DataFrame:
    feed = order_feed(t)
    held = modelling.load_hub(feed.where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'"), ["o_custkey"], "loaded")
    parts = {
        "hub": modelling.load_hub(feed, ["o_custkey"], "loaded", held).select(F.col("hub_key").alias("key"), "load_date"),
        "link": modelling.load_link(feed, [["o_custkey"], ["o_orderkey"]], "loaded").select(
            F.col("link_key").alias("key"), "load_date"
        ),
    }
    for tracking in ("type2", "type1", "append_only"):
        satellite = modelling.load_satellite(
            feed, ["o_custkey"], ["o_orderpriority", "o_orderstatus"], "loaded", tie=["o_orderkey"], tracking=tracking
        )
        parts[f"satellite {tracking}"] = satellite.select(F.col("hub_key").alias("key"), "load_date")
    # Keys that come once have nothing to count before the shuffle; there, the wide keys of a task's many narrow rows would all be held.
    once = ("hub", "link", "satellite type1")
    counted = {
        kind: (rows.repartition("key") if kind in once else rows).groupBy("key", "load_date").agg(F.count("*").alias("n"))
        for kind, rows in parts.items()
    }
    return windows.labelled(counted, "kind").select("kind", "key", "load_date", "n")


SNAPSHOTS = ("1996-01-01", "1998-07-01", "2001-01-01")


@query(
    "dv_pit",
    f"""WITH f AS (SELECT {key_sql('o_custkey')} AS hk, o_orderdate::DATE AS d, o_totalprice > 250000 AS big FROM orders), s AS (SELECT unnest([{', '.join(f"DATE '{s}'" for s in SNAPSHOTS)}]) AS snapshot)
    SELECT hk AS hub_key, snapshot::VARCHAR AS snapshot, max(d) FILTER (d <= snapshot)::VARCHAR AS status_date, max(d) FILTER (big AND d <= snapshot)::VARCHAR AS large_date FROM f, s GROUP BY ALL""",
)
def dv_pit(t: Tables) -> DataFrame:
    feed = order_feed(t)
    large = feed.join(t.orders.where("o_totalprice > 250000").select("o_orderkey"), "o_orderkey", "left_semi")
    key = modelling.hash_key(["o_custkey"]).alias("hub_key")
    satellites = {
        "status_date": feed.select(key, F.col("loaded").alias("load_date")),
        "large_date": large.select(key, F.col("loaded").alias("load_date")),
    }
    return modelling.point_in_time(modelling.load_hub(feed, ["o_custkey"], "loaded"), satellites, SNAPSHOTS)


@query(
    "dv_bridge",
    f"""SELECT DISTINCT {key_sql('o_custkey')} AS start_key, {key_sql('o_orderkey')} AS via_key, {key_sql('l_partkey')} AS end_key, {key_sql('o_custkey', 'o_orderkey')} AS first_link, {key_sql('l_orderkey', 'l_partkey')} AS second_link
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def dv_bridge(t: Tables) -> DataFrame:
    """Customer to order to part."""
    ordered, held = [["o_custkey"], ["o_orderkey"]], [["l_orderkey"], ["l_partkey"]]
    placed = modelling.load_link(order_feed(t), ordered, "loaded")
    holds = modelling.load_link(t.lineitem.select("l_orderkey", "l_partkey", day("l_shipdate").alias("shipped")), held, "shipped")
    return modelling.bridge(placed, holds, on="hub_key_1", hubs=(ordered, held))


SCD_SQL = """d AS (SELECT c_custkey, c_mktsegment AS segment, c_nationkey::BIGINT AS nation FROM customer WHERE c_custkey % 10 <> 9),
  ch AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 6 = 0 THEN 99 ELSE c_nationkey END::BIGINT AS nation FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 10 = 9),
  j AS (SELECT coalesce(d.c_custkey, ch.c_custkey) AS k, d.c_custkey IS NULL AS fresh, ch.c_custkey IS NOT NULL AS hit, d.segment AS s, d.nation AS n, ch.segment AS cs, ch.nation AS cn, d.segment IS DISTINCT FROM ch.segment OR d.nation IS DISTINCT FROM ch.nation AS diff FROM d FULL JOIN ch ON d.c_custkey = ch.c_custkey)"""


@query(
    "scd_apply",
    f"""WITH {SCD_SQL}
    SELECT 1 AS type, k AS c_custkey, CASE WHEN hit THEN cs ELSE s END AS segment, CASE WHEN hit THEN cn ELSE n END AS nation, NULL AS valid_from, NULL AS valid_to, NULL::BOOLEAN AS is_current, NULL AS previous_segment, NULL AS current_segment FROM j
    UNION ALL SELECT 3, k, CASE WHEN hit THEN cs ELSE s END, CASE WHEN hit THEN cn ELSE n END, NULL, NULL, NULL, CASE WHEN hit AND NOT fresh AND s <> cs THEN s END, NULL FROM j
    UNION ALL SELECT 2, k, s, n, '1990-01-01', CASE WHEN hit AND diff THEN '2002-01-01' ELSE '9999-12-31' END, NOT (hit AND diff), NULL, NULL FROM j WHERE NOT fresh
    UNION ALL SELECT 2, k, cs, cn, '2002-01-01', '9999-12-31', true, NULL, NULL FROM j WHERE hit AND diff
    UNION ALL SELECT 6, k, s, n, '1990-01-01', CASE WHEN hit AND diff THEN '2002-01-01' ELSE '9999-12-31' END, NOT (hit AND diff), NULL, CASE WHEN hit THEN cs ELSE s END FROM j WHERE NOT fresh
    UNION ALL SELECT 6, k, cs, cn, '2002-01-01', '9999-12-31', true, NULL, cs FROM j WHERE hit AND diff""",
)
def scd_apply(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    rows = t.customer.select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("bigint").alias("nation")
    )
    old = rows.where(key % 10 != 9)
    changes = rows.where((key % 2 == 0) | (key % 10 == 9)).select(
        "c_custkey",
        F.when(key % 4 == 0, "MOVED").otherwise(F.col("segment")).alias("segment"),
        F.when(key % 6 == 0, 99).otherwise(F.col("nation")).alias("nation"),
    )
    none, no_date = F.lit(None).cast("string"), F.lit(None).cast("date")
    spans = {
        "valid_from": F.lit("1990-01-01").cast("date"),
        "valid_to": F.lit(modelling.OPEN_END).cast("date"),
        "is_current": F.lit(True),
    }
    now = {"current_segment": F.col("segment"), "current_nation": F.col("nation")}
    before = {"previous_segment": none, "previous_nation": F.lit(None).cast("bigint")}
    dimensions = {
        1: old,
        2: old.withColumns(spans),
        3: old.withColumns(before),
        6: old.withColumns({**spans, **now}),
    }
    blank = {
        "valid_from": no_date,
        "valid_to": no_date,
        "is_current": F.lit(None).cast("boolean"),
        "previous_segment": none,
        "current_segment": none,
    }
    parts = []
    for type_, dimension in dimensions.items():
        applied = modelling.scd_apply(dimension, changes, ["c_custkey"], ["segment", "nation"], type_=type_, valid_on="2002-01-01")
        parts.append(
            applied.select(
                F.lit(type_).alias("type"),
                "c_custkey",
                "segment",
                "nation",
                *[F.col(c) if c in applied.columns else empty.alias(c) for c, empty in blank.items()],
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "fact_load",
    f"""SELECT l_shipdate::DATE::VARCHAR AS sale_date, l_partkey, l_suppkey, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS quantity, count(*) AS lines,
      CASE WHEN p_partkey IS NULL THEN 'unknown' ELSE {key_sql('l_partkey')} END AS part_key, {key_sql('l_suppkey')} AS supplier_key
    FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 48) ON l_partkey = p_partkey GROUP BY ALL""",
)
def fact_load(t: Tables) -> DataFrame:
    parts = t.part.where("p_size < 48").select("p_partkey", modelling.hash_key(["p_partkey"]).alias("part_sk"))
    suppliers = t.supplier.select("s_suppkey", modelling.hash_key(["s_suppkey"]).alias("supplier_sk"))
    sales_ = t.lineitem.withColumn("sale_date", day("l_shipdate"))
    return modelling.fact_load(
        sales_,
        ["sale_date", "l_partkey", "l_suppkey"],
        {"quantity": F.sum(money("l_quantity")), "lines": F.count("*")},
        {
            "part_key": (parts, "l_partkey", "p_partkey", "part_sk"),
            "supplier_key": (suppliers, "l_suppkey", "s_suppkey", "supplier_sk"),
        },
    )


@query(
    "embed_chunks",
    """WITH c AS (SELECT doc_id::VARCHAR AS source_key, 'text' AS source_column, text AS v FROM documents UNION ALL SELECT doc_id::VARCHAR, 'source', source FROM documents)
    SELECT source_key, source_column, i AS chunk_index, substring(v, (i * 500 + 1)::BIGINT, 500) AS content, 'any-model' AS embedding_model FROM (SELECT *, unnest(range(0, (length(v) + 499) // 500)) AS i FROM c)""",
)
def embed_chunks(t: Tables) -> DataFrame:
    return vectors.chunk_rows(t.documents, "doc_id", ["text", "source"], 500, "any-model")


@query(
    "vector_topk",
    """WITH q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT query_id, e.vec_id, e.embedding::DOUBLE[] AS v, f.embedding::DOUBLE[] AS w FROM q JOIN embeddings f ON f.vec_id = query_id, embeddings e),
    s AS (SELECT query_id, vec_id, unnest(['cosine', 'l2', 'inner_product', 'l1']) AS metric, unnest([1 - list_cosine_similarity(v, w), list_distance(v, w), -list_inner_product(v, w), list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - w[i])))]) AS d FROM p)
    SELECT query_id, metric, row_number() OVER (PARTITION BY query_id, metric ORDER BY round(d, 9), vec_id) AS rank, vec_id, round(d, 6) + 0 AS distance FROM s QUALIFY rank <= 5""",
)
def vector_topk(t: Tables) -> DataFrame:
    """The five nearest to every vector whose id is divisible by 50, by four distances, among all vectors."""
    queries = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found, _ = vectors.nearest(t.embeddings.select("vec_id", "embedding"), queries, 5)
    return found.select("query_id", "metric", "rank", "vec_id", (F.round("distance", 6) + 0).alias("distance"))


@query(
    "compact_files",
    """SELECT 'flat' AS layout, o_orderpriority, count(*) AS rows, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total, true AS fewer_files, 0::BIGINT AS folders FROM orders GROUP BY ALL
    UNION ALL SELECT 'folders', o_orderpriority, count(*), sum(o_totalprice::DECIMAL(12,2))::DOUBLE, true, (SELECT count(DISTINCT o_orderpriority) FROM orders) FROM orders GROUP BY ALL""",
)
def compact_files(t: Tables) -> DataFrame:
    """A flat and a partitioned table of many small files, merged in their places."""
    parts = {}
    for layout, folders in (("flat", []), ("folders", ["o_orderpriority"])):
        path = t.scratch("small-files")
        t.orders.repartition(24).write.partitionBy(*folders).parquet(path)
        before, after = upkeep.compact_files(t.spark, path, t.scratch("merging"), 64 * 1024 * 1024)
        kept = F.regexp_extract("file", "/(o_orderpriority=[^/]*)/", 1)
        n = upkeep.file_sizes(t.spark, path).where(kept != "").agg(F.count_distinct(kept)).scalar()
        parts[layout] = (
            t.spark.read.parquet(path)
            .groupBy("o_orderpriority")
            .agg(F.count("*").alias("rows"), F.sum(money("o_totalprice")).alias("total"))
            .select("o_orderpriority", "rows", "total", F.lit(after < before).alias("fewer_files"), n.alias("folders"))
        )
    return windows.labelled(parts, "layout")


@query(
    "erase_rows",
    """WITH s AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT 'erased' AS form, o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM s)
    UNION ALL SELECT 'blanked', o_orderkey, o_custkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM s) THEN o_orderpriority END FROM orders""",
)
def erase_rows(t: Tables) -> DataFrame:
    subjects = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = {
        "erased": upkeep.erase_rows(rows, subjects, ["o_custkey"]),
        "blanked": upkeep.blank_rows(rows, subjects, ["o_custkey"], ["o_orderpriority"]),
    }
    return windows.labelled(parts, "form").select("form", "o_orderkey", "o_custkey", "o_orderpriority")


@query("retention_sweep", "SELECT event_id, ts::VARCHAR AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY")
def retention_sweep(t: Tables) -> DataFrame:
    return upkeep.retention_sweep(t.events.select("event_id", "ts"), "ts", "P2W", "2024-01-31 00:00:00")


@query(
    "expire_versions",
    """SELECT user_id, event_id, ts::VARCHAR AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 10 AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""",
)
def expire_versions(t: Tables) -> DataFrame:
    log = t.events.select("user_id", "event_id", "ts")
    return upkeep.expired_versions(
        log, "user_id", ["ts", "event_id"], keep=10, older_than="P7D", at="ts", reference="2024-01-31 00:00:00"
    )


@query(
    "hook_chain",
    SALES
    + f"""SELECT 'passed' AS target, o_orderkey, {token_sql('custkey::VARCHAR')} AS custkey, NULL AS reason FROM sales WHERE custkey IS NOT NULL AND amount BETWEEN 0 AND 480000
    UNION ALL SELECT 'rejected', o_orderkey, NULL, CASE WHEN custkey IS NULL THEN 'known' ELSE 'amount' END FROM sales WHERE custkey IS NULL OR NOT amount BETWEEN 0 AND 480000""",
)
def hook_chain(t: Tables) -> DataFrame:
    """A gate, then tokens for what passed it."""
    gates = (
        quality.Gate("known", "not_null", ("custkey",)),
        quality.Gate("amount", "range", ("amount",), low=0, high=480000),
    )

    def gate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        judged = quality.gate_rows(rows, gates)
        return judged.where("outcome <> 'rejected'").select(*rows.columns), judged.where("outcome = 'rejected'")

    def tokens(rows: DataFrame) -> tuple[DataFrame, None]:
        return rows.withColumn("custkey", crypto.tokenize(F.col("custkey"), TOKEN_KEY)), None

    passed, rejected = upkeep.hook_chain(sales(t), [gate, tokens])
    none = F.lit(None).cast("string")
    parts = {
        "passed": passed.select("o_orderkey", "custkey", none.alias("reason")),
        "rejected": rejected[0].select("o_orderkey", none.alias("custkey"), "reason"),
    }
    return windows.labelled(parts, "target")
