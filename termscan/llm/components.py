"""Connected components of a table of links, by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def components(links: DataFrame, store: Scratch, name: str) -> DataFrame:
    """node, root (the smallest node of its component) of every node that has a link. links: long columns a, b.

    A large star ties each node's larger neighbours to its smallest one, a small star its smaller ones; the number of
    rounds grows with the logarithm of the nodes. Each round is a table of its own, so a lost executor costs one round.
    """
    edges = store.put(links.selectExpr("greatest(a, b) a", "least(a, b) b").where("a > b").distinct(), f"{name}-0")
    if edges.isEmpty():
        return edges.toDF("node", "root")
    last = None
    for turn in count(1):
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        least = store.put(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-m{turn}")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = store.put(large.where("a > b").distinct(), f"{name}-l{turn}")
        low = store.put(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-s{turn}")
        small = large.join(low, "a").select(F.col("b").alias("v"), F.col("m")).unionByName(low.select(F.col("a").alias("v"), "m"))
        new = store.put(small.where("v > m").selectExpr("v a", "m b").distinct(), f"{name}-{turn}")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        store.drop(f"{name}-{turn - 1}", f"{name}-m{turn}", f"{name}-l{turn}", f"{name}-s{turn}")
        edges = new
        if state == last:
            break
        last = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return store.put(roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), f"{name}-roots")
