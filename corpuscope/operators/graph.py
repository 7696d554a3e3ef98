"""Graph operators as loops of joins; every round is a table in the shared folder."""

from __future__ import annotations

from functools import reduce
from itertools import batched, count

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpuscope.operators.cut import cut


def reachable(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """node and the fewest steps (at most depth, or as many as there are) from a seed along source -> target."""
    found = seeds.select("node", F.lit(0).alias("steps")).distinct()
    front = found
    for k in count(1) if depth is None else range(1, depth + 1):
        front = cut(front.join(edges, front["node"] == edges["source"]).select(F.col("target").alias("node")).distinct().join(found, "node", "left_anti").select("node", F.lit(k).alias("steps")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def pagerank(edges: DataFrame, rounds: int = 200, damping: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """node and rank after so many rounds, or once the ranks change by less than tolerance for each node, added up.

    Parallel edges count once, dangling mass is spread evenly.
    """
    edges = edges.select("source", "target").distinct()
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    out = edges.groupBy("source").agg(F.count("*").alias("degree"))
    links, nodes = edges.join(out, "source").repartition("source").persist(StorageLevel.MEMORY_AND_DISK), cut(nodes.join(out, nodes["node"] == out["source"], "left").select("node", "degree"))
    n = max(1, nodes.count())
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        sent = links.join(ranks.select(F.col("node").alias("source"), "rank"), "source").groupBy("target").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        dangling = ranks.where("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        new = ranks.join(sent.withColumnRenamed("target", "node"), "node", "left").crossJoin(F.broadcast(dangling))  # one row
        new = new.select("node", "degree", F.col("rank").alias("old"), ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        change = Observation()  # comes with the write, without a job of its own
        ranks = cut(new.observe(change, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("sum"))).drop("old")
        if tolerance is not None and (change.get["sum"] or 0.0) < n * tolerance:
            break
    links.unpersist()
    return ranks.select("node", "rank")


def distances(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """node and its fewest steps from a seed along links of both directions, whatever their number; unreachable nodes are left out."""
    both = cut(links.select("source", "target").union(links.select("target", "source")).distinct())
    found = cut(seeds.select("node", F.lit(0).alias("steps")).distinct())
    front = found
    for k in count(1):
        front = front.join(both, front["node"] == both["source"]).select(F.col("target").alias("node")).distinct()
        front = cut(front.join(found, "node", "left_anti").select("node", F.lit(k).alias("steps")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def shortest_path(links: DataFrame, source: str, target: str) -> list:
    """Nodes of one shortest path along links of both directions, the smallest on ties; empty if there is none."""
    spark = links.sparkSession
    start = spark.createDataFrame([(source,)], "node string")
    steps = cut(distances(links, start))
    at = steps.where(F.col("node") == target).first()
    if at is None:
        return []
    both, path = links.select("source", "target").union(links.select("target", "source")), [target]
    for k in range(at["steps"] - 1, -1, -1):  # one small step back for each node of the path
        near = both.where(F.col("target") == path[-1]).select(F.col("source").alias("node"))
        path.append(steps.where(F.col("steps") == k).join(near, "node", "left_semi").agg(F.min("node")).first()[0])
    return path[::-1]


def expanded(edges: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes within so many steps of the seeds over edges of some types, and the edges walked, once for each end in the front."""
    edges = edges if types is None else edges.where(F.col("type").isin(*types))
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "source", "target", "type").union(edges.select("target", "source", "source", "target", "type"))
    front = seen = seeds.select("node").distinct()
    walked = None
    for _ in range(depth):
        step = cut(front.join(both, "node"))
        walked = step.select("source", "target", "type") if walked is None else walked.unionByName(step.select("source", "target", "type"))
        front = cut(step.select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(front)
    return seen, walked


def dependents(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes that reach a seed by at most so many imports; seeds only if they import each other."""
    imports = edges.where("type = 'IMPORTS'").select("source", "target")
    front, found = seeds.select("node").distinct(), None
    for _ in range(depth):
        front = imports.join(front, imports["target"] == front["node"]).select(F.col("source").alias("node")).distinct()
        front = cut(front if found is None else front.join(found, "node", "left_anti"))
        found = front if found is None else found.unionByName(front)
    return found


def effect_cone(edges: DataFrame, files: DataFrame, seeds: DataFrame, depth: int = 2, bare: DataFrame | None = None) -> DataFrame:
    """What a change of the seeds may touch: what points at them, and what they test, call or import; the next round starts
    from the files of what was found (files: node and its file). The seeds are part of it.

    Edges may repeat, as nodes are told apart after each round. bare: nodes (column node) that are known to have no file; if a
    round finds no others, files aren't asked for, and else only for those others.
    """
    steps = edges.select(F.col("target").alias("node"), F.col("source").alias("other")).union(edges.where(F.col("type").isin("TESTS", "CALLS", "IMPORTS")).select("source", "target"))
    found = front = seeds.select("node").distinct()
    for left in range(depth - 1, -1, -1):
        new = cut(front.join(steps, "node").select(F.col("other").alias("node")).distinct().join(found, "node", "left_anti"))
        found = found.unionByName(new)
        if left:
            held = new if bare is None else cut(new.join(bare, "node", "left_anti"))
            front = new
            if not held.isEmpty():
                own = files.join(held, "node", "left_semi")
                front = new.join(own, "node", "left").select(F.coalesce("file", "node").alias("node")).distinct()
    return found


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """Edges with an end within so many steps of the seeds."""
    near, _ = expanded(edges, seeds, depth)
    near = cut(near)
    ends = lambda end: edges.join(near.withColumnRenamed("node", end), end, "left_semi").select("source", "target", "type")
    return ends("source").union(ends("target")).distinct()


#: Sources whose paths and credits are columns of one row for each node.
ABREAST = 16


def betweenness(links: DataFrame, sources: DataFrame) -> DataFrame:
    """node and its betweenness over shortest paths from the given sources, along links of both directions.

    Forward rounds count shortest paths, backward rounds add up dependencies. A node is one row, with columns for up to
    ABREAST sources that go side by side; links stay where they are dealt by their source, and only nodes go to them. Links
    without an end and sources without a node are left out.
    """
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = F.explode(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target"))))
    both = links.where("source is not null and target is not null").select(ends.alias("e")).select("e.source", "e.target")
    both = both.repartition(n, "source").distinct().persist(StorageLevel.MEMORY_AND_DISK)  # the distinct rows are found where they are dealt
    nodes, total = sources.select("node").where("node is not null").distinct(), None
    for some in batched((r["node"] for r in nodes.toLocalIterator()), ABREAST):
        part = cut(_credits(both, nodes, some))
        total = part if total is None else total.unionByName(part)
    both.unpersist()
    if total is None:
        return nodes.withColumn("betweenness", F.lit(0.0))
    return total.groupBy("node").agg((F.sum("credit") / 2).alias("betweenness"))


def _credits(both: DataFrame, nodes: DataFrame, sources: tuple) -> DataFrame:
    """node and its dependencies, added up over some sources; nodes that no other node of these reaches are left out."""
    each, any_of = range(len(sources)), lambda found: reduce(lambda a, b: a | b, found)

    def received(level: int, sent: list[Column]) -> DataFrame:
        """node and what it gets from its neighbours for each source, if they are on this level of it."""
        front = state.where(any_of(F.col(f"steps{i}") == level for i in each))
        front = front.select(F.col("node").alias("source"), *(F.when(F.col(f"steps{i}") == level, sent[i]).alias(f"got{i}") for i in each))
        return both.join(front.hint("shuffle_hash"), "source").groupBy(F.col("target").alias("node")).agg(*(F.sum(f"got{i}").alias(f"got{i}") for i in each))

    own = [F.col("node") == F.lit(x) for x in sources]
    begun = [c for i in each for c in (F.when(own[i], 0).alias(f"steps{i}"), F.when(own[i], 1.0).alias(f"paths{i}"))]
    state = cut(nodes.where(any_of(own)).select("node", *begun))
    for last in count(0):
        found = [F.col(f"steps{i}").isNull() & F.col(f"got{i}").isNotNull() for i in each]
        more = state.join(received(last, [F.col(f"paths{i}") for i in each]), "node", "full_outer")
        columns = [c for i in each for c in (F.when(found[i], last + 1).otherwise(F.col(f"steps{i}")).alias(f"steps{i}"), F.coalesce(f"paths{i}", f"got{i}").alias(f"paths{i}"))]
        new = Observation()  # comes with the write
        state = cut(more.observe(new, F.count_if(any_of(found)).alias("n")).select("node", *columns))
        if not new.get["n"]:
            break
    state = state.select("*", *(F.lit(0.0).alias(f"credit{i}") for i in each))
    for level in range(last, 1, -1):  # what the sources themselves would get isn't asked for
        given = received(level, [(1 + F.col(f"credit{i}")) / F.col(f"paths{i}") for i in each])
        credit = [F.when((F.col(f"steps{i}") == level - 1) & F.col(f"got{i}").isNotNull(), F.col(f"paths{i}") * F.col(f"got{i}")).otherwise(F.col(f"credit{i}")).alias(f"credit{i}") for i in each]
        state = cut(state.join(given, "node", "left").select("node", *(f"{c}{i}" for i in each for c in ("steps", "paths")), *credit))
    credits = (F.when(F.col(f"steps{i}") > 0, F.col(f"credit{i}")).otherwise(0.0) for i in each)
    return state.where(any_of(F.col(f"steps{i}") > 0 for i in each)).select("node", reduce(lambda a, b: a + b, credits).alias("credit"))
