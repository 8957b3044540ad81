"""Compaction by file size, and exact vector search with pruning, against brute force."""

import glob
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from deedwork.operators import upkeep, vectors


def sizes(path):
    return {os.path.relpath(f, path): (os.path.getsize(f), os.stat(f).st_mtime_ns) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def made(spark, n, start=0):
    return spark.range(start, start + n).select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("noise"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("at"), F.expr("cast(id as decimal(12,2)) / 4").alias("d")
    )


def test_only_small_files_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    made(spark, 40_000).coalesce(1).write.parquet(path)
    made(spark, 2_000, 40_000).repartition(100).write.mode("append").parquet(path)
    before = sizes(path)
    large = max(before, key=lambda f: before[f][0])
    rows = sorted(map(tuple, spark.read.parquet(path).collect()))
    schema = spark.read.parquet(path).schema
    target = before[large][0]
    counts = upkeep.compact_files(spark, path, str(tmp_path / "staging"), target)
    after = sizes(path)
    assert counts == (len(before), len(after)) and after[large] == before[large]
    assert len(after) == 1 + math.ceil(sum(n for f, (n, _) in before.items() if f != large) / target)
    assert spark.read.parquet(path).schema == schema and sorted(map(tuple, spark.read.parquet(path).collect())) == rows
    assert upkeep.compact_files(spark, path, str(tmp_path / "again"), target) == (len(after), len(after))


def test_folders_and_files_of_other_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(6):
        rows = made(spark, 50, 100 * k).withColumn("part", F.col("id") % 3)
        (rows.drop("d") if k == 5 else rows).coalesce(1).write.mode("append").partitionBy("part").parquet(path)
    want = sorted(map(str, spark.read.option("mergeSchema", True).parquet(path).select("id", "noise", "at", "d", "part").collect()))
    assert upkeep.compact_files(spark, path, str(tmp_path / "staging"), 1 << 20) == (18, 3)
    assert sorted(os.listdir(path))[-3:] == ["part=0", "part=1", "part=2"]
    assert sorted(map(str, spark.read.parquet(path).select("id", "noise", "at", "d", "part").collect())) == want


def test_a_swap_cut_short_is_finished(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "m.parquet").write_bytes(b"y")
    row = (str(tmp_path), str(tmp_path / "s" / "m.parquet"), [str(tmp_path / "a"), str(tmp_path / "b")], 1)
    os.remove(tmp_path / "a")
    merged = spark.createDataFrame([row], "folder string, new string, sources array<string>, rows long")
    for _ in range(2):
        assert upkeep.swap_files(merged) == 2
        assert (tmp_path / "m.parquet").read_bytes() == b"y" and not (tmp_path / "b").exists()


def test_bins_hold_no_more_than_the_target(spark):
    rng = random.Random(3)
    files = [(f"/t/{f}/{k}", rng.randrange(1, 100)) for f in "pq" for k in range(200)]
    size = dict(files)
    bins = upkeep.small_file_bins(spark.createDataFrame(files, "file string, bytes long"), 100).collect()
    used = [f for b in bins for f in b["files"]]
    assert len(used) == len(set(used)) and all(size[f] <= 75 for f in used)
    assert all(sum(size[f] for f in b["files"]) <= 100 and {f.rpartition("/")[0] for f in b["files"]} == {b["folder"]} for b in bins)
    for folder in "pq":
        small = [n for f, n in files if f.startswith(f"/t/{folder}/") and n <= 75]
        assert sum(b["folder"] == f"/t/{folder}" for b in bins) <= 1.25 * sum(small) / 100 + 1


def by_hand(rows, asked, k, metric):
    def told(x, y):
        dot = sum(a * b for a, b in zip(x, y, strict=True))
        if metric == "cosine":
            length = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
            return 1 - dot / length if length else None
        if metric == "inner_product":
            return -dot
        return sum(abs(a - b) for a, b in zip(x, y, strict=True)) if metric == "l1" else math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)))

    out = {}
    for q, y in asked:
        every = [(round(told(x, y), 9), i) for i, x in rows if x is not None and y is not None and told(x, y) is not None]
        for rank, (d, i) in enumerate(sorted(every)[:k], 1):
            out[q, rank] = (i, d)
    return out


@pytest.mark.parametrize("shape", ["clusters", "ties", "few"])
def test_nearest_is_the_full_scan(spark, monkeypatch, shape):
    monkeypatch.setattr(vectors, "CELL_VECTORS", 20)
    monkeypatch.setattr(vectors, "CELL_QUERIES", 7)
    rng = random.Random(shape)
    if shape == "clusters":
        middles = [[rng.uniform(-9, 9) for _ in range(6)] for _ in range(12)]
        rows = [(i, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)]) for i in range(600)]
    elif shape == "ties":
        rows = [(i, [float(rng.randrange(2)) for _ in range(4)]) for i in range(300)]
    else:
        rows = [(i, [rng.random(), rng.random()]) for i in range(3)]
    rows += [(1000, [0.0] * len(rows[0][1])), (1001, None)]
    asked = [(f"q{i}", x) for i, x in rows if i % 25 == 0]
    got, told = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(asked, "query_id string, embedding array<double>"), 5)
    got = got.collect()
    for metric in vectors.METRICS:
        mine = {(r["query_id"], r["rank"]): (r["vec_id"], pytest.approx(r["distance"], abs=2e-9)) for r in got if r["metric"] == metric}
        assert {key: (i, d) for key, (i, d) in by_hand(rows, asked, 5, metric).items()} == mine
    shares = {r["metric"]: r["compared"] / r["pairs"] for r in told.collect()}
    assert all(0 < s <= 1 for s in shares.values())
    if shape == "clusters":
        assert shares["l2"] < 0.5 and shares["l1"] < 0.5


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    for rows, asked in ((none, some), (some, none), (none, none)):
        got, told = vectors.nearest(rows, asked.withColumnRenamed("vec_id", "query_id"), 3, ["l2"])
        assert got.count() == told.count() == 0
    with pytest.raises(ValueError):
        vectors.nearest(some, some, 1, ["other"])
