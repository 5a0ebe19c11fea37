"""Connected components of a large edge table, by alternating large and small stars.

Each round links every node to the least node that it can see; the number of rounds grows with the logarithm
of the longest chain. All state is a table; each round is written to the shared folder, and the round before goes.
The least neighbours are written before they are joined, so both sides of the join have an exchange of their own
and Spark can split a node with very many neighbours.
"""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.functions.lineage import pinned, remove, scratch

MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the least node of its component. Null ends are ignored."""
    spark = edges.sparkSession
    root = f"{scratch(spark)}/components-{uuid.uuid4().hex}"
    pairs = edges.select("a", "b").where("a <> b")
    now = pinned(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{root}/0")
    before = None
    for k in range(1, MOST_ROUNDS + 1):
        stars = _large_star(now, f"{root}/{k}-least-large")
        moved = pinned(stars, f"{root}/{k}-large")
        now = pinned(_small_star(moved, f"{root}/{k}-least-small"), f"{root}/{k}")
        for old in (k - 1, f"{k}-large", f"{k}-least-large", f"{k}-least-small"):
            remove(spark, f"{root}/{old}")
        after = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _large_star(edges: DataFrame, path: str) -> DataFrame:
    """Each neighbour that is larger than u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pinned(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), path)
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, path: str) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them; edges have a > b."""
    least = pinned(edges.groupBy("a").agg(F.min("b").alias("m")), path)
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
