import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedwork.plans import streams
from deedwork.plans.ingest import change_feed
from deedwork.plans.streams import EVENT_SPEC, topic_records
from deedwork.session import Tables, scratch_path
from deedwork.sources import readers, sinks
from deedwork.streaming import landing, late


def parts_of(spark, df, n):
    """The table as ``n`` files, and a stream over them that takes one file a batch."""
    path = scratch_path(spark, "parts")
    df.repartitionByRange(n, "ts").write.parquet(path)
    return path, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_of_several_batches(spark, tables):
    main, side = scratch_path(spark, "main"), scratch_path(spark, "late")
    _, stream = parts_of(spark, tables.events.select("event_id", "ts"), 5)
    landing.run_available(
        stream,
        scratch_path(spark, "checkpoint"),
        lambda b, i: late.land_split(b, i, main, side, column="ts", allowed_lateness="P7D"),
    )
    landed = [spark.read.schema("event_id bigint, ts timestamp_ntz, batch_id int").parquet(p) for p in (main, side)]
    assert landed[0].count() + landed[1].count() == tables.events.count()
    newest = landed[0].agg(F.max("ts")).first()[0]
    seen = None
    for batch in range(5):
        here = [df.where(F.col("batch_id") == batch) for df in landed]
        top = max(r for df in here for (r,) in df.agg(F.max("ts")).collect() if r is not None)
        seen = top if seen is None else max(seen, top)
        edge = seen - dt.timedelta(days=7)
        assert here[0].where(F.col("ts") < F.lit(edge)).count() == 0
        assert here[1].where(F.col("ts") >= F.lit(edge)).count() == 0
    assert seen == newest


@pytest.mark.parametrize(("files", "newest_first"), [(1, False), (4, False), (20, True)])
def test_streams_keep_every_row(spark, tables, tmp_path, files, newest_first):
    """The registered queries give the rows of one batch, whatever files the events come in."""
    events = tables.events.orderBy(F.desc("ts") if newest_first else "ts").toPandas()
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    size = -(-len(events) // files)
    for k in range(files):
        path = folder / f"part-{k:03}.parquet"
        spark.createDataFrame(events[k * size : (k + 1) * size], tables.events.schema).toPandas().to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1e9 + k, 1e9 + k))
    split = Tables(spark, str(tmp_path), files_per_batch=1)
    for plan in (streams.late_split, streams.stream_event_time, streams.late_classify):
        got, want = plan(split), plan(tables)
        assert got.count() == tables.events.count()
        assert got.exceptAll(want).isEmpty()


def test_repeats_above_the_watermark_land_once(spark, tmp_path):
    """Batch by batch, each run a restart; a repeat lands once while the watermark has not passed it, what is behind it is kept beside."""
    source, path, side, checkpoint = str(tmp_path / "in"), scratch_path(spark, "timed"), scratch_path(spark, "timed-late"), scratch_path(spark, "checkpoint")
    start = dt.datetime(2024, 1, 1)
    batches = [[(1, 0), (1, 1), (2, 10)], [(2, 9), (3, 2), (4, 30)], [(4, 29), (5, 31)], [], [(6, None), (7, 25), (5, 33), (8, 26)]]
    sent = 0
    for number, rows in enumerate(batches):
        batch = spark.createDataFrame([(k, None if s is None else start + dt.timedelta(seconds=s)) for k, s in rows], "k int, at timestamp_ntz")
        batch.coalesce(1).write.mode("append").parquet(source)
        sent += len(rows)
        for _ in range(2):  # a run without new rows changes nothing
            stream = spark.readStream.schema("k int, at timestamp_ntz").parquet(source)
            late.land_once(stream, path, side, checkpoint, column="at", key="k", delay="PT5S")
    landed_rows = sorted(r["k"] for r in landing.landed(spark, path, stream.schema).collect())
    late_rows = sorted(r["k"] for r in landing.landed(spark, side, stream.schema).collect())
    assert landed_rows == [1, 2, 4, 5, 8] and late_rows == [3, 6, 7]
    assert len(landed_rows) + len(late_rows) + len([1, 2, 4, 5]) == sent  # and as many repeats


def test_shuffled_files_lose_no_row(spark, tables, tmp_path):
    parts, stream = parts_of(spark, tables.events.select("event_id", "ts").unionByName(tables.events.select("event_id", "ts").limit(300)).orderBy(F.rand(3)), 5)
    path, side = scratch_path(spark, "timed"), scratch_path(spark, "timed-late")
    late.land_once(stream, path, side, scratch_path(spark, "checkpoint"), column="ts", key="event_id", delay="P2D")
    kept, behind = (landing.landed(spark, p, stream.schema) for p in (path, side))
    assert kept.count() == kept.select("event_id").distinct().count()
    assert kept.select("event_id").union(behind.select("event_id")).distinct().count() == tables.events.count()


def test_a_restarted_stream_lands_nothing_twice(spark, tables):
    path, checkpoint = scratch_path(spark, "once"), scratch_path(spark, "checkpoint")
    _, stream = parts_of(spark, tables.events, 3)
    landing.land_stream(stream, path, checkpoint)
    landing.land_stream(stream, path, checkpoint)
    assert spark.read.parquet(path).count() == tables.events.count()


def test_the_stream_stops_after_the_batch_past_the_limit(spark, tables):
    good, dead = scratch_path(spark, "good"), scratch_path(spark, "dead")
    _, stream = parts_of(spark, tables.events, 4)
    with pytest.raises(Exception, match="TooManyDeadLetters"):
        landing.land_checked(topic_records(stream), EVENT_SPEC, good, dead, scratch_path(spark, "checkpoint"), most_dead=10)
    both = spark.read.parquet(dead).count() + spark.read.parquet(good).count()
    assert 0 < both < tables.events.count()


def test_batch_and_stream_decode_alike(spark, tables):
    batch_good, batch_dead = landing.split_records(topic_records(tables.events), EVENT_SPEC)
    good, dead = scratch_path(spark, "good"), scratch_path(spark, "dead")
    _, stream = parts_of(spark, tables.events, 3)
    landing.land_checked(topic_records(stream), EVENT_SPEC, good, dead, scratch_path(spark, "checkpoint"))
    for streamed, batch in ((good, batch_good), (dead, batch_dead)):
        got = spark.read.parquet(streamed).drop(landing.BATCH).select(*batch.columns)
        assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()


def test_a_budget_of_zero_splits_nothing_and_a_split_is_final(tables):
    kept, dropped = late.split_late(tables.events, "ts", "PT0S")
    assert dropped.isEmpty() and kept.count() == tables.events.count()
    kept, _ = late.split_late(tables.events, "ts", "P3D")
    assert late.split_late(kept, "ts", "P3D")[1].isEmpty()


def test_event_time_column():
    def fields(**kinds):
        return T.StructType([T.StructField(n, t) for n, t in kinds.items()])

    plain = fields(id=T.LongType(), day=T.DateType(), created_at=T.TimestampNTZType())
    assert late.event_time_column(plain) == "created_at"
    assert late.event_time_column(plain, "day") == "day"
    assert late.event_time_column(fields(a=T.DateType(), b=T.TimestampType())) == "a"
    assert late.event_time_column(fields(id=T.LongType())) is None


def test_change_feed_in_micro_batches_is_the_feed_at_once(spark, tables):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    target = tables.orders.select(*columns).where("o_orderkey % 3 <> 0")
    feed = change_feed(tables)
    want = sinks.apply_changes(target, feed, ["o_orderkey"], sequence="seq", operation="op")
    path = scratch_path(spark, "feed")
    # A key's changes may meet several batches as long as they come in sequence.
    feed.repartitionByRange(3, "seq").write.parquet(path)
    state = {"table": target}

    def each(batch, batch_id):
        out = scratch_path(spark, "state")
        sinks.write(sinks.apply_changes(state["table"], batch, ["o_orderkey"], sequence="seq", operation="op"), out)
        state["table"] = batch.sparkSession.read.parquet(out)

    landing.run_available(spark.readStream.schema(feed.schema).parquet(path), scratch_path(spark, "checkpoint"), each)
    assert state["table"].exceptAll(want).isEmpty() and want.exceptAll(state["table"]).isEmpty()


def test_a_change_that_repeats_its_key_is_refused(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="repeats its key"):
        sinks.merge(target, twice, ["k"]).collect()
    once = sinks.merge(target, twice.where("v = 'y'"), ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "y"), (2, "b")]


def test_writes_that_are_refused(spark):
    df = spark.range(3).withColumn("p", F.when(F.col("id") > 0, F.col("id")))
    with pytest.raises(sinks.SinkError):
        sinks.write(df, scratch_path(spark, "x"), format="csv", mode="append")
    with pytest.raises(Exception, match="required"):
        sinks.land_partitioned(df, scratch_path(spark, "x"), ["p"], required=["p"])


def test_cursors_compare_as_numbers_then_as_text(spark):
    rows = [("a", "9", "10"), ("b", "10", "9"), ("c", "2024-01-02", "2024-01-01"), ("d", None, "1")]
    df = spark.createDataFrame(rows, "product string, old string, new string")
    got = {r["product"]: r["back"] for r in df.withColumn("back", sinks.smaller_cursor(F.col("old"), F.col("new"))).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": False}


def test_reader_options():
    options = readers.jdbc_options("postgres://u:p@db:5432/shop", "orders", ["id", 'a"b'])
    assert options["url"] == "jdbc:postgresql://db:5432/shop" and options["user"] == "u"
    assert options["dbtable"] == '(SELECT "id", "a""b" FROM orders) AS source'
    with pytest.raises(readers.SourceError):
        readers.jdbc_options("ftp://x/y", "t", ["a"])
    assert readers.jdbc_predicates("k", 0, 9, 3) == ["k < 4 OR k IS NULL", "k >= 4 AND k < 8", "k >= 8"]
    assert readers.kafka_options("h:1", "t", per_trigger=5)["maxOffsetsPerTrigger"] == "5"


def test_the_exact_json_reader_refuses_floats(spark):
    with pytest.raises(readers.SourceError, match="not exact"):
        readers.read_json_lines(spark, "/nowhere", schema=T.StructType([T.StructField("x", T.DoubleType())]), exact=True)
