"""Text pieces for embedding, and exact nearest-vector search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deedwork.session import materialized, ship_package

METRICS = ("cosine", "l2", "inner_product", "l1")
PIVOTS = 32
SHELLS = 8
CELL_VECTORS = 4096
CELL_QUERIES = 1024
PLACES = 9


def chunk_rows(df: DataFrame, key: str, columns: Sequence[str], size: int, model: str | None = None) -> DataFrame:
    """One row per piece of each text column: pieces of ``size`` characters that together are the text."""
    parts = []
    for c in columns:
        text = F.col(c)
        count = F.ceil(F.length(text) / size).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1))
        pieces = F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))
        parts.append(
            df.select(
                F.col(key).cast("string").alias("source_key"),
                F.lit(c).alias("source_column"),
                F.posexplode(pieces).alias("chunk_index", "content"),
                F.lit(model).cast("string").alias("embedding_model"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


@dataclass(frozen=True)
class _Space:
    """Where the distances of one metric obey the triangle inequality, in the order of the metric.

    l2 and l1 are distances themselves. Cosine is l2 between vectors of length 1. The inner product is l2 after one more coordinate, which gives all vectors the
    length of the longest and is 0 for queries.
    """

    metric: str
    longest: float = 0.0

    def placed(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        if self.metric == "cosine":
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            return np.divide(x, length, out=np.full_like(x, np.nan), where=length > 0)
        if self.metric == "inner_product":
            rest = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1, keepdims=True), 0.0))
            return np.hstack([x, rest])
        return x

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of all ``x`` from one ``y``, or of rows from rows."""
        d = x - y
        return np.abs(d).sum(axis=-1) if self.metric == "l1" else np.sqrt((d * d).sum(axis=-1))

    def told(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What the metric itself says of ``x`` and one ``y``."""
        if self.metric == "cosine":
            return 1.0 - (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum()))
        return -(x * y).sum(axis=1) if self.metric == "inner_product" else self.apart(x, y)

    def roomy(self, most: np.ndarray | float) -> np.ndarray | float:
        """A distance with room for rounding and for ties in the last place that counts."""
        return np.sqrt(np.square(most) + 4 * 10.0**-PLACES) + 10.0**-PLACES * (1 + most)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def _cells(spaces: Sequence[_Space], pivots: np.ndarray):
    """Each vector under its nearest pivot of every metric, with its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            for space in spaces if len(x) else ():
                away = np.stack([space.apart(space.placed(x), p) for p in space.placed(pivots)], axis=1)
                known = ~np.isnan(away).all(axis=1)
                away = np.where(np.isnan(away[known]), np.inf, away[known])
                kept, near = batch.filter(pa.array(known)), away.argmin(axis=1)
                columns = [pa.array([space.metric] * len(near), pa.string()), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])]
                yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "metric", "pivot", "away"])

    return run


def _asked(spaces: Sequence[_Space], pivots: np.ndarray, blocks: dict[str, np.ndarray], k: int):
    """For each query and metric the blocks that can hold one of its ``k`` nearest; ``blocks``: pivot, shell, rows, least and largest distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            for space in spaces if len(x) else ():
                pivot, shell, rows, low, high = blocks[space.metric].T if len(blocks[space.metric]) else np.zeros((5, 0))
                place = space.placed(pivots)
                for n, q in enumerate(space.placed(x, query=True)):
                    if np.isnan(q).any() or not len(pivot):
                        continue
                    away = space.apart(place, q)[pivot.astype(int)]
                    reach = away + high
                    order = np.argsort(reach, kind="stable")
                    enough = min(int(np.searchsorted(np.cumsum(rows[order]), k)), len(order) - 1)
                    most = float(space.roomy(reach[order[enough]]))
                    open_ = np.flatnonzero(np.maximum(np.maximum(away - high, low - away), 0.0) <= most)
                    size = len(open_)
                    row = batch.slice(n, 1).take(pa.array(np.zeros(size, np.int64)))
                    columns = [pa.array([space.metric] * size, pa.string()), pa.array(pivot[open_].astype(np.int32)), pa.array(shell[open_].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*row.columns, *columns, pa.array(away[open_]), pa.array(np.full(size, most))], [*row.schema.names, "metric", "pivot", "shell", "from_pivot", "most"])

    return run


def _compared(spaces: Sequence[_Space], k: int):
    """The nearest vectors of a cell for each of its queries; only those that the pivot's distances leave open are compared."""
    of = {space.metric: space for space in spaces}

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in ("query_id", "metric", "vec_id", "distance", "compared")}
        if held.num_rows and asked.num_rows:
            space = of[asked.column("metric")[0].as_py()]
            x, away, ids = _matrix(held.column("embedding")), held.column("away").to_numpy(), held.column("vec_id").to_numpy()
            queries = zip(_matrix(asked.column("embedding")), asked.column("query_id").to_pylist(), asked.column("from_pivot").to_pylist(), asked.column("most").to_pylist(), strict=True)
            for q, query_id, from_pivot, most in queries:
                open_ = np.flatnonzero(np.abs(away - from_pivot) <= most)
                distance = space.told(x[open_], q)
                top = np.lexsort((ids[open_], np.round(distance, PLACES)))[:k]
                out["query_id"] += [query_id] * len(top)
                out["metric"] += [space.metric] * len(top)
                out["vec_id"] += ids[open_][top].tolist()
                out["distance"] += distance[top].tolist()
                out["compared"] += [len(open_) * (n == 0) for n in range(len(top))]
        return pa.table(out)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metrics: Sequence[str] = METRICS) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest vectors of every query, exactly: ``query_id, metric, rank, vec_id, distance``; and ``metric, pairs, compared``.

    ``vectors``: vec_id (a whole number), embedding. ``queries``: query_id, embedding, any number of them. ``PIVOTS`` vectors, those with the least hashes of their ids,
    divide the space; the vectors nearest to one, cut into shells by their distance from it, are a block. A query skips the blocks, and within a block the vectors,
    that the triangle inequality puts farther away than ``k`` vectors must be; ``compared`` says how many of all ``pairs`` are left. What is left meets in cells
    of at most about ``CELL_VECTORS`` vectors and ``CELL_QUERIES`` queries. Distances are ranked to ``PLACES`` decimals, ties by id. A null vector, and under cosine one of length 0,
    is near nothing.
    """
    for metric in metrics:
        if metric not in METRICS:
            raise ValueError(f"no distance {metric!r}")
    spark = vectors.sparkSession
    ship_package(spark)
    double = F.col("embedding").cast("array<double>").alias("embedding")
    rows = vectors.where("embedding IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), double)
    wanted = queries.where("embedding IS NOT NULL").select("query_id", double)
    id_type = wanted.schema["query_id"].dataType.simpleString()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    pivots = np.array([r["embedding"] for r in sample], np.float64)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    longest = rows.agg(F.sqrt(F.max(length))).first()[0] if "inner_product" in metrics else 0.0
    spaces = [_Space(m, longest or 0.0) for m in metrics]

    place = "vec_id bigint, embedding array<double>, metric string, pivot int, away double"
    held = materialized(rows.mapInArrow(_cells(spaces, pivots), place), "vector-cells")
    cuts = [F.lit((n + 1) / SHELLS) for n in range(SHELLS - 1)]
    edges = held.groupBy("metric", "pivot").agg(F.percentile_approx("away", F.array(*cuts)).alias("edges"))
    shell = F.size(F.filter("edges", lambda e: e < F.col("away"))).alias("shell")
    held = held.join(F.broadcast(edges), ["metric", "pivot"]).select("vec_id", "embedding", "metric", "pivot", "away", shell)
    held = materialized(held, "vector-blocks")
    stats = held.groupBy("metric", "pivot", "shell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()
    blocks = {m: np.array([(r["pivot"], r["shell"], r["n"], r["low"], r["high"]) for r in stats if r["metric"] == m], np.float64) for m in metrics}

    block = ["metric", "pivot", "shell"]
    asked = wanted.mapInArrow(
        _asked(spaces, pivots, blocks, k), f"query_id {id_type}, embedding array<double>, metric string, pivot int, shell int, from_pivot double, most double"
    )
    asked = materialized(asked, "vector-queries")
    # A grid of cells for each block: its vectors in slots, its queries in slots, both by hash.
    slots = held.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / CELL_VECTORS).cast("int").alias("slots"))
    turns = asked.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("turns"))
    grid = materialized(slots.join(turns, block), "vector-grid")
    slot = F.pmod(F.xxhash64("vec_id"), F.col("slots")).cast("int").alias("slot")
    turn = F.pmod(F.xxhash64("query_id"), F.col("turns")).cast("int").alias("turn")
    left = held.join(F.broadcast(grid), block).select("*", slot, F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn")).drop("slots", "turns")
    right = asked.join(F.broadcast(grid), block).select("*", turn, F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")).drop("slots", "turns")
    cell = [*block, "slot", "turn"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell))
    found = found.applyInArrow(_compared(spaces, k), f"query_id {id_type}, metric string, vec_id bigint, distance double, compared bigint")
    found = materialized(found, "vector-found")
    order = Window.partitionBy("query_id", "metric").orderBy(F.round("distance", PLACES), "vec_id")
    top = found.select("query_id", "metric", F.row_number().over(order).alias("rank"), "vec_id", "distance").where(F.col("rank") <= k)
    every = rows.agg(F.count(F.lit(1)).alias("n")).scalar() * wanted.agg(F.count(F.lit(1)).alias("n")).scalar()
    return top, found.groupBy("metric").agg(F.sum("compared").alias("compared")).select("metric", every.alias("pairs"), "compared")
