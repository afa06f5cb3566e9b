"""Connected components by repeated contraction; every round is a few joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions.checkpoints import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Rows (node, root) for every node of ``edges``; nodes of one component share the root, a node of it.

    Each round every node points to the neighbour (itself included) that a hash of the round puts first, edges are
    relabelled by two such steps, and loops and repeats go; the number of nodes falls by a constant factor in
    expectation whatever the shape of the graph. Edges with a null end are ignored, loops make single components.
    """
    ends = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null")
    links = cut(ends.distinct())
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().withColumn("root", F.col("node"))
    links = links.filter("src <> dst")
    for turn in range(max_rounds):
        if links.isEmpty():
            return nodes
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: B023,E731
        both = links.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
        best = both.select("e.*").groupBy("src").agg(F.min(rank("dst")).alias("best"))
        point = best.select(F.col("src").alias("at"), F.least("best", rank("src"))["id"].alias("to"))
        hop = point.select(F.col("at").alias("_at"), F.col("to").alias("_to"))
        point = point.join(hop, point["to"] == hop["_at"]).select("at", F.col("_to").alias("to"))
        left = links.join(point, links.src == point["at"]).select(F.col("to").alias("src"), "dst")
        right = left.join(point, left.dst == point["at"]).select("src", F.col("to").alias("dst"))
        right = right.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        links = cut(right.distinct())
        nodes = nodes.join(point, nodes.root == point["at"], "left").select("node", F.coalesce("to", "root").alias("root"))
    raise RuntimeError(f"components not found in {max_rounds} rounds")


def chain_ends(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, end) for every ``src``: the last node of the chain that its links lead along, null where they lead into a cycle.

    A node has one link at most. Pointers are doubled, so passes grow with the logarithm of the longest chain; when a pass
    ends no chain any more, what is left runs in circles.
    """
    state = cut(links.select(F.col(src).alias("node"), F.col(dst).alias("end")).filter("node is not null and end is not null"))
    open_ = None
    while True:
        follow = state.select(F.col("node").alias("_at"), F.col("end").alias("_next"))
        moved = state.join(follow, F.col("end") == F.col("_at"), "left")
        left = moved.filter("_at is not null").count()
        if left == 0:
            return state
        if left == open_:
            return moved.select("node", F.when(F.col("_at").isNull(), F.col("end")).alias("end"))
        open_ = left
        state = cut(moved.select("node", F.coalesce("_next", "end").alias("end")))
