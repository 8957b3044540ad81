"""Connected components by alternating large-star and small-star steps, each a grouping and a join of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedwork.llm.common import materialized


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Edges run from the larger node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    around = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return around.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that it is linked with, for every node that is not its own label.

    ``links`` has two integer columns, ``u`` and ``v``; order, repetition and links to oneself do not matter.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialized(edges, "links")
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"))
    state = edges.agg(mark).first()[0]
    while True:
        edges = materialized(_small_star(_large_star(edges)), "stars")
        after = edges.agg(mark).first()[0]
        if after == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = after
