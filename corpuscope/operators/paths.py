"""Shortest paths of many pairs at once, searched from both ends level by level.

A row of a front is a pair, a node and the smallest path between the node and the front's end of the pair. The two
fronts of a pair grow in turn until they share a node: the first time they do, the levels add up to the distance, and
the smallest joined path over the shared nodes is the smallest shortest path. In a graph without directions a level's neighbours are
in the level before, in itself or in the next, so two levels are all that is kept. Pairs leave when they are found or when a
front dies out; rounds end when no pair is left, however long paths are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.cut import cut


def shortest_paths(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, source, target and path (node names, compared one after another on ties; empty if there is none) of each pair.

    links: source, target, walked in both directions; links with a null end are ignored. A node that has no link isn't in
    the graph, so there is no path from or to it, nor to itself. pairs: pair (no two alike), source, target.
    """
    both = links.where("source is not null and target is not null").select("source", "target")
    both = cut(both.union(both.select("target", "source")).distinct(), "links")
    nodes = both.select(F.col("source").alias("node")).distinct()
    start = lambda end: cut(pairs.select("pair", F.col(end).alias("node")).join(nodes, "node", "left_semi").select("pair", "node", F.array("node").alias("path")), "front")
    front, before, found = {"source": start("source"), "target": start("target")}, {"source": None, "target": None}, None
    side = "target"
    while True:
        met = front["source"].alias("a").join(front["target"].alias("b"), ["pair", "node"])
        met = met.groupBy("pair").agg(F.min(F.concat("a.path", F.slice("b.path", F.lit(2), F.size("b.path")))).alias("path"))
        met = cut(met, "met")
        found = met if found is None else found.unionByName(met)
        alive = front["source"].select("pair").distinct().join(front["target"].select("pair").distinct(), "pair").join(met, "pair", "left_anti")
        alive = cut(alive, "alive")
        if alive.isEmpty():
            break
        side = "source" if side == "target" else "target"
        now = front[side].join(alive, "pair", "left_semi")
        step = now.join(both.select(F.col("source").alias("node"), F.col("target").alias("next")), "node")
        path = F.concat("path", F.array("next")) if side == "source" else F.concat(F.array("next"), "path")
        grown = step.select("pair", F.col("next").alias("node"), path.alias("path")).groupBy("pair", "node").agg(F.min("path").alias("path"))
        known = now.select("pair", "node") if before[side] is None else now.select("pair", "node").unionByName(before[side])
        before[side], front[side] = now.select("pair", "node"), cut(grown.join(known, ["pair", "node"], "left_anti"), "front")
    out = pairs.select("pair", "source", "target").join(found, "pair", "left")
    return out.withColumn("path", F.coalesce("path", F.array().cast("array<string>")))
