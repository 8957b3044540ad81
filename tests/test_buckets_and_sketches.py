"""Bucketed stored tables and column sketches against brute force."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from deedwork.functions.values import day, money
from deedwork.operators import sketches
from deedwork.sources import sinks
from deedwork.sources.buckets import BucketedTable

ROW = "k long, v string, op string, seq long"


def files(path, load):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/data/load={load}/bucket=*/*.parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketedTable(spark, path, ["k"], 16)
    rows = spark.range(400).selectExpr("id as k", "'a' as v")
    assert table.read() is None and table.load(1, rows, lambda old, new: new) == list(range(16))
    before = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in files(path, 1)}
    changes = spark.createDataFrame([(3, "b"), (900, "c")], "k long, v string")
    buckets = sorted({r[0] for r in changes.select(table.bucket_of(16)).collect()})
    for _ in range(2):  # the second time is a rerun
        assert table.load(2, changes, lambda old, new: sinks.merge(old, new, ["k"])) == buckets
        loads = table.manifest()["loads"]
        assert {int(b) for b, n in loads.items() if n == 2} == set(buckets) and set(loads.values()) == {1, 2}
        assert {f: os.stat(f"{path}/{f}").st_mtime_ns for f in files(path, 1)} == before
        assert len({f.split("/")[2] for f in files(path, 2)}) == len(buckets)
        got = {r.k: r.v for r in table.read().collect()}
        assert got == {k: "a" for k in range(400)} | {3: "b", 900: "c"}
    assert {r.v for r in table.read(before=2).collect()} == {"a"} and table.versions() == [1, 2]
    with pytest.raises(ValueError, match="no change touches"):
        table.load(3, changes.limit(1), lambda old, new: rows.where("k < 100"))
    assert table.versions() == [1, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_feed_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    changes = [(rng.randrange(12), rng.choice("xyz"), rng.choice(["insert", "update", "delete"]), n) for n in range(60)]
    sent = changes + rng.sample(changes, 10)
    rng.shuffle(sent)
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 5)
    for n, start in enumerate(range(0, len(sent), 14), 1):
        table.feed(n, spark.createDataFrame(sent[start : start + 14], ROW), "seq")
    last = {}
    for k, v, op, n in changes:
        last[k] = (v, op, n)
    assert {r.k: (r.v, r.op, r.seq) for r in table.read().collect()} == last
    gone = {k for k, (_, op, n) in last.items() if op == "delete" and n <= 50}
    touched = table.settle(99, 50, "seq", "op")
    assert {r.k for r in table.read().collect()} == set(last) - gone
    held = {r[0] for r in spark.createDataFrame([(k,) for k in gone] or [(-1,)], "k long").select(table.bucket_of(5)).collect()} if gone else set()
    assert set(touched) == held


def test_empty_changes_and_tables(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], 4)
    none = spark.createDataFrame([], ROW)
    assert table.settle(0, 5, "seq", "op") == [] and table.feed(1, none, "seq") == []
    assert table.read().count() == 0 and table.read().columns == ["k", "v", "op", "seq"]
    table.feed(2, spark.createDataFrame([(None, "n", "insert", 1), (1, "a", "insert", 1)], ROW), "seq")
    assert table.feed(3, none, "seq") == [] and table.read().count() == 2


def made(spark):
    return spark.range(30_000).select(
        (F.col("id") % 977).alias("few"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("many"),
        (F.exp(F.col("id") % 101 / 10)).alias("skewed"),
        F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.lit(float("nan"))).alias("ties"),
        F.lit(None).cast("decimal(10,2)").alias("none"),
        F.array(F.col("id") % 3).alias("nested"),
    )


def test_sketches_of_loads_merge_to_those_of_the_table(spark, tmp_path):
    rows, path = made(spark), str(tmp_path / "s")
    for load in (0, 1, 2, 1):
        sketches.store(rows.where(F.pmod("few", F.lit(3)) == load), path, load)
    merged = sketches.stored(spark, path)
    got = {r.column_name: r for r in sketches.profile(merged).collect()}
    exact = rows.agg(*(F.countDistinct(c).alias(c) for c in rows.columns)).first()
    for c in rows.columns:
        assert got[c].rows == 30_000 and got[c].null_rate == pytest.approx({"many": 0.2, "none": 1.0}.get(c, 0.0))
        assert abs(got[c].distinct_count - exact[c]) <= max(1, exact[c] * sketches.distinct_error())
    levels = [("min", 0, 1), ("p10", 1, 10), ("p50", 1, 2), ("p99", 99, 100), ("max", 1, 1)]
    for column in ("few", "skewed"):
        found = sketches.quantiles(merged, column, levels)
        for r in sketches.ranks(rows, F.col(column).cast("double"), found).collect():
            assert r.below - 2 * sketches.rank_error() <= r.share <= r.upto + 2 * sketches.rank_error()
    assert {r.value for r in sketches.quantiles(merged, "ties", levels).collect()} == {7.0}
    assert sketches.quantiles(merged, "none", levels).count() == sketches.quantiles(merged, "many", levels).count() == 0
    plan = sketches.sketch(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan


def test_sketches_of_no_rows(spark):
    empty = sketches.sketch(made(spark).where("few < 0"))
    assert {(r.rows, r.null_rate, r.distinct_count) for r in sketches.profile(sketches.merged(empty)).collect()} == {(0, None, 0)}
    assert sketches.quantiles(empty, "few", [("p50", 1, 2)]).count() == 0


def test_sketches_of_dates_and_decimals(spark, tables):
    rows = tables.orders.select(day("o_orderdate").alias("d"), money("o_totalprice").alias("m"))
    got = {r.column_name: r.distinct_count for r in sketches.profile(sketches.sketch(rows)).collect()}
    exact = rows.agg(F.countDistinct("d").alias("d"), F.countDistinct("m").alias("m")).first()
    assert all(abs(got[c] - exact[c]) <= 1 + exact[c] * sketches.distinct_error() for c in ("d", "m"))
