"""Connected components of a link table, by contraction.

First each node's links to smaller nodes become one link to the smallest of them, which links to the others: near copies
that meet in many tiles keep about one link each. A round then points every node to its smallest neighbour, follows the
pointers to their ends by pointer jumping, and replaces each link by the link of the ends, without loops and copies; only
local minima stay, so links fall round by round. Nodes carry their latest end. Tables stay distributed and are written
once a step; the driver only learns whether links or unfinished pointers are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomrate.llm.storage import written


def ordered(links: DataFrame) -> DataFrame:
    """Distinct links (a, b) with a < b."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def starred(edges: DataFrame) -> DataFrame:
    """Links with the same components: for each b, one link to its smallest a, and from that to its other a."""
    own = edges.groupBy("b").agg(F.min("a").alias("low"), F.collect_set("a").alias("others"))
    ends = F.explode(F.concat(F.array("b"), F.col("others")))
    return ordered(own.select(F.col("low").alias("a"), ends.alias("b")))


def pointed(edges: DataFrame) -> DataFrame:
    """(node, end): the node that each node of edges reaches by going from smallest neighbour to smallest neighbour."""
    both = edges.select(F.col("b").alias("node"), F.col("a").alias("end")).union(edges.select("a", "a")).union(edges.select("b", "b"))
    at = written(both.groupBy("node").agg(F.min("end").alias("end")), "pointers")
    while True:
        # only ends that point further can move a pointer
        further = at.where("node <> end").select(F.col("node").alias("end"), F.col("end").alias("next"))
        after = written(at.join(further, "end", "left").select("node", F.coalesce("next", "end").alias("end"), F.col("next").isNotNull().alias("moved")), "pointers")
        at = after.select("node", "end")
        if after.where("moved").isEmpty():
            return at


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node it reaches."""
    edges = written(starred(ordered(links)), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        ends = pointed(edges)
        if labels is None:
            labels = ends.toDF("node", "component")
        else:
            moved = ends.where("node <> end").toDF("component", "end")
            labels = written(labels.join(moved, "component", "left").select("node", F.coalesce("end", "component").alias("component")), "labels")
        first, second = ends.toDF("a", "low"), ends.toDF("b", "high")
        edges = written(ordered(edges.join(first, "a").join(second, "b").select(F.col("low").alias("a"), F.col("high").alias("b"))), "edges")
    return labels
