"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.operators.joins import lookup_join
from pairmatch.session import written


#: Rows of a table of nodes up to which it is broadcast.
MOST_BROADCAST = 1_000_000


def _star(rows: DataFrame, keep_own: bool) -> DataFrame:
    """Point the neighbours ``v`` of every ``u`` at the least node of u and its neighbours.

    The least neighbour comes from a partial aggregate. It is sent to the edges if there are
    few nodes; else a hub's edges are salted.
    """
    least = written(
        rows.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")),
        "least",
    )
    joined = lookup_join(
        rows, least.select("u", "m"), ["u"], least, F.col("v"), most=MOST_BROADCAST
    )
    if keep_own:  # small star: smaller neighbours and the node itself
        ends = F.explode(F.array("v", "u")).alias("v")
        out = joined.select(ends, "m").where("v != m")
    else:  # large star: larger neighbours
        out = joined.where("v > u").select("v", "m")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether all edges end in a node that points nowhere, and no node points twice."""
    inner = edges.select(F.col("u").alias("v")).distinct()
    chained = lookup_join(
        edges, inner, ["v"], edges.groupBy("v").agg(F.count("*").alias("n")), F.col("u"),
        how="left_semi", most=MOST_BROADCAST,
    )
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    return chained.isEmpty() and twice.isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, comp)`` of every node of the links ``(a, b)``; comp is the least node reached.

    Large and small stars alternate until all edges point at a least node, which takes a number
    of rounds that grows with the logarithm of the graph. Each round's edges are written, so a
    lost executor costs one round, and nothing but two flags reaches the driver. No links, no
    rows.
    """
    a, b = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = written(links.select(a, b).where("u > v").distinct(), "graph")
    while not _is_done(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_star(both, keep_own=False), "graph")
        edges = written(_star(large, keep_own=True), "graph")
    own = edges.select(F.col("v").alias("node")).distinct()
    return written(
        edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
            own.select("node", F.col("node").alias("comp"))
        ),
        "components",
    )
