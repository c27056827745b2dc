"""Connected components of large graphs as DataFrame rounds that contract the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicer.llm.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is its least node.

    Each round orders the nodes by a hash of the round's own. Every node joins the first of itself
    and its neighbours, and the graph shrinks to the nodes that were joined. Only nodes that
    come before some neighbour are left, an expected constant share of them whatever the shape, so
    the rounds are logarithmic and their sizes add up to a multiple of the first. No round can leave the graph as
    it was (the last node of an edge always goes), so it ends without a bound on rounds. Afterwards the
    rounds are read backwards to give every node its root.

    The only groupings are minima, which combine before the shuffle, and distinct edges. A hub's rows
    are on the many side of joins whose other side has one row a node, so adaptive execution
    can split them. Hashes are of the node and the round, so a lost task comes out the same.
    Self-loops and nulls are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    left = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    joined: list[DataFrame] = []
    while not left.isEmpty():
        place = lambda c, k=len(joined): F.struct(F.xxhash64(c, F.lit(k)).alias("place"), F.col(c).alias("id"))
        first = left.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("near"))
        to = written(first.select("node", F.least(place("node"), F.col("near"))["id"].alias("root")))
        joined.append(to)
        half = left.join(to, left.a == to.node).select(F.col("root").alias("x"), "b")
        left = written(half.join(to, half.b == to.node).select(F.col("x").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    if not joined:
        return edges.sparkSession.createDataFrame([], "node bigint, component bigint")
    found = joined.pop()
    while joined:
        above = found.select(F.col("node").alias("root"), F.col("root").alias("above"))
        found = written(joined.pop().join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")
