"""Connected components by alternating large and small stars, and joins of texts with lists of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.store import stored

#: Up to so many ids (8 bytes each) a list is broadcast, beyond that it is joined by shuffle.
BROADCAST_IDS = 1_000_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether each node points to one other node at most, and none to a node that points on."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node reachable.  Edges stay distributed; a
    round is written to the shared folder, and the number of rounds grows with the logarithm of the diameter.  Once
    all edges are stars, whose centres are smaller than their other nodes, they are the components."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        # each edge points from the larger to the smaller node
        every = _both(edges)
        # read back, so that the joins can split the edges of a frequent node
        low = stored(every.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "edges")
        large = every.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "edges")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "edges")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = stored(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi", key: str = "doc_id") -> DataFrame:
    """Documents whose id is (left_anti: isn't) in the one column of ids.  ids is counted first."""
    small = ids.count() <= BROADCAST_IDS
    right = ids.toDF("_id")
    return docs.join(F.broadcast(right) if small else right, docs[key] == right["_id"], how)
