"""PageRank over the whole of lineitem, against loops over a small fixture."""

from __future__ import annotations

import pytest

from corpuscope.plans import retrieval


def test_page_rank_takes_all_lines(spark, tmp_path):
    lines = [(1, 1, 1.0), (1, 2, 50.0), (2, 1, 30.0), (3, 3, 5.0), (3, 3, 49.0)]
    custkey = {1: 7, 2: 8, 3: 8}
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(list(custkey.items()), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    edges = {(f"c{custkey[o]}", f"s{s}") for o, s, _ in lines}
    edges |= {(b, a) for a, b in edges}
    rank = {a: 1 / len({x for x, _ in edges}) for a, _ in edges}
    change = 1.0
    while change >= len(rank) * 1e-6:
        before, rank = rank, {n: 0.15 / len(rank) + 0.85 * sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == n) for n in rank}
        change = sum(abs(rank[n] - before[n]) for n in rank)
    assert {r.node: r["rank"] for r in retrieval.page_rank(spark, str(tmp_path)).collect()} == pytest.approx(rank)


def test_betweenness_against_a_loop(spark):
    from corpuscope.operators import graph

    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d"), ("d", "f"), ("x", "y")]
    near = {}
    for p, q in pairs:
        near.setdefault(p, set()).add(q)
        near.setdefault(q, set()).add(p)

    def paths(s, t):
        front = [[s]]
        while front:
            done = [p for p in front if p[-1] == t]
            if done:
                return done
            seen = {p[-1] for p in front}
            front = [[*p, n] for p in front for n in near[p[-1]] if n not in p and n not in seen]
        return []

    want = {}
    for s in ("a", "d", "x"):
        for t in near:
            found = [p for p in paths(s, t) if s != t]
            for p in found:
                for n in p[1:-1]:
                    want[n] = want.get(n, 0) + 0.5 / len(found)
    links = spark.createDataFrame(pairs, "source string, target string")
    got = graph.betweenness(links, spark.createDataFrame([("a",), ("d",), ("x",)], "node string")).collect()
    assert {r.node: r.betweenness for r in got if r.betweenness} == pytest.approx(want)
    assert graph.shortest_path(links, "b", "f") == ["b", "c", "d", "f"] and graph.shortest_path(links, "b", "x") == [] and graph.shortest_path(links, "a", "a") == ["a"]


def test_pagerank_stops_when_settled(spark):
    from corpuscope.operators import graph

    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    assert {r.node: r["rank"] for r in graph.pagerank(ring).collect()} == pytest.approx(dict.fromkeys("abc", 1 / 3))


def test_betweenness_keeps_a_row_for_each_node(spark, monkeypatch):
    from corpuscope.operators import graph

    ring = 6
    monkeypatch.setattr(graph, "ABREAST", 4, raising=False)  # fewer than there are sources
    links = [(k, (k + 1) % ring) for k in range(ring)] + [(3, 4), (5, 5), (2, None), (None, 1)]
    rows, cut = [], graph.cut

    def counted(df, *name):
        made = cut(df, *name)
        rows.append(made.count())
        return made

    monkeypatch.setattr(graph, "cut", counted)
    got = graph.betweenness(spark.createDataFrame(links, "source long, target long"), spark.createDataFrame([(k,) for k in range(ring)] + [(None,), (0,)], "node long")).collect()
    # Each source has two targets at 1 and 2 steps and one at 3, each with an inner node less than steps; by symmetry all nodes get the same.
    assert {r.node: r.betweenness for r in got} == pytest.approx(dict.fromkeys(range(ring), (2 * (0 + 1) + 2) / 2))
    assert max(rows) <= ring


def test_betweenness_without_sources(spark):
    from corpuscope.operators import graph

    assert graph.betweenness(spark.createDataFrame([(1, 2)], "source long, target long"), spark.createDataFrame([], "node long")).collect() == []


def test_effect_cone_asks_for_files_of_what_may_have_one(spark):
    from pyspark.sql import functions as F

    from corpuscope.operators import graph

    edges = [("f", "t", "READS_TABLE"), ("f", "t", "READS_TABLE"), ("g-s", "t", "TESTS"), ("shop", "f", "CONTAINS"), ("shop", "g", "CONTAINS"), ("g", "g-s", "CONTAINS"), ("f", "lib", "IMPORTS"), ("g", "h", "IMPORTS"), ("x", "y", "CONTAINS")]
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "node string")
    links = spark.createDataFrame(edges, "source string, target string, type string")
    files = spark.createDataFrame([("g-s", "g"), ("x", "y")], "node string, file string")
    for bare in (None, one("f", "f", "g", "shop")):
        got = sorted(r.node for r in graph.effect_cone(links, files, one("t"), 2, bare).collect())
        assert got == ["f", "g-s", "h", "lib", "shop", "t"]
    # Files aren't looked at if nothing that was found may have one.
    fails = files.select("node", F.raise_error(F.lit("asked for")).cast("string").alias("file"))
    assert sorted(r.node for r in graph.effect_cone(links.where("source <> 'g-s'"), fails, one("t"), 2, one("f")).collect()) == ["f", "lib", "shop", "t"]
