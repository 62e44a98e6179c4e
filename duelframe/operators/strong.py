"""Strong components by trimming and colouring, for graphs that are too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch


def _without(links: DataFrame, gone: DataFrame) -> DataFrame:
    """links with no end among the nodes of `gone`."""
    return links.join(gone.select(F.col("node").alias("winner")), "winner", "left_anti").join(gone.select(F.col("node").alias("loser")), "loser", "left_anti").select("winner", "loser")


def _trim(left: DataFrame, times: int = 4) -> DataFrame:
    """links between nodes that have links in and out, after some rounds of leaving out the others."""
    n = left.count()
    for _ in range(times):
        both = left.select(F.col("winner").alias("node")).distinct().join(left.select(F.col("loser").alias("node")), "node", "left_semi")
        ends = left.join(both.select(F.col("node").alias("winner")), "winner", "left_semi").join(both.select(F.col("node").alias("loser")), "loser", "left_semi")
        left = scratch(ends.select("winner", "loser"), "trimmed")
        if (m := left.count()) == n:
            break
        n = m
    return left


def _colours(left: DataFrame) -> DataFrame:
    """(node, colour): the smallest node from which a node can be reached, itself included; only news are sent on."""
    nodes = left.select(F.col("winner").alias("node")).union(left.select("loser")).distinct()
    known = scratch(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("fresh")), "colours")
    while True:
        sent = left.join(known.where("fresh").select(F.col("node").alias("winner"), "colour"), "winner").groupBy(F.col("loser").alias("node")).agg(F.min("colour").alias("best"))
        better = F.coalesce(F.col("best") < F.col("colour"), F.lit(False))
        known = scratch(known.join(sent, "node", "left").select("node", F.least("colour", "best").alias("colour"), better.alias("fresh")), "colours")
        if known.where("fresh").isEmpty():
            return known.select("node", "colour")


def _back_to_roots(left: DataFrame, colours: DataFrame) -> DataFrame:
    """(node, scc): of each colour the nodes that reach the node which gave it."""
    w, lo = colours.select(F.col("node").alias("winner"), "colour"), colours.select(F.col("node").alias("loser"), F.col("colour").alias("other"))
    own = scratch(left.join(w, "winner").join(lo, "loser").where("colour = other").select("winner", "loser"), "one-colour")
    front = scratch(colours.where("node = colour").select("node", F.col("colour").alias("scc")), "roots")
    hit = front
    while True:
        step = own.join(front.withColumnRenamed("node", "loser"), "loser").select(F.col("winner").alias("node"), "scc").distinct()
        front = scratch(step.join(hit.select("node"), "node", "left_anti"), "front")
        if front.isEmpty():
            return hit
        hit = scratch(hit.union(front), "hit")


def coloured_parts(links: DataFrame) -> DataFrame:
    """(node, scc) of nodes on cycles, and of some that are not: scc is the smallest node of the strong component. Nodes not given are alone in theirs.

    Nodes without links in or out are trimmed. What is left is coloured forwards with the smallest node that reaches a node, which is
    the smallest of its own strong component; that component is what reaches it again within its colour. Then it is taken out, and so on until no
    link is left. Each round is a join over all links still there, written to the shared folder; its number of rounds grows with the graph's
    diameter and with how often components lie behind each other, not with its size.
    """
    left, found = scratch(links.where("winner <> loser").select("winner", "loser").distinct(), "links"), None
    while True:
        left = _trim(left)
        if left.isEmpty():
            break
        hit = scratch(_back_to_roots(left, _colours(left)), "parts")
        found = hit if found is None else found.union(hit)
        left = scratch(_without(left, hit), "links")
    return links.select(F.col("winner").alias("node"), F.col("winner").alias("scc")).limit(0) if found is None else found
