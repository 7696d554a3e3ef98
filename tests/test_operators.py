"""Operators on small frames with hand-computed results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.operators import graph, ranking
from corpuscope.sources.readers import select_only
from corpuscope.streaming import telemetry


def test_clean(spark):
    row = spark.createDataFrame([("﻿a \r\nb\t\n",)], "t string").select(text.cleaned(F.col("t")).alias("c"), text.clean_flags(F.col("t"), text.cleaned(F.col("t"))).alias("f")).first()
    assert row.c == "a\nb" and row.f == ["bom-removed", "crlf-normalized", "no-identifiers"]


def test_approx_tokens(spark):
    rows = spark.createDataFrame([("x" * n,) for n in (1, 2, 6, 10, 14)], "t string").select(text.approx_tokens(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [1, 1, 2, 2, 4]


def test_pack_skips_and_goes_on(spark):
    row = spark.createDataFrame([([3, 9, 2, 6],)], "s array<bigint>").select(ranking.packed(F.col("s"), 10).alias("p")).first()
    assert row.p.taken == [True, False, True, False] and row.p.used == 5


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "alpha beta"), (1, "alpha alpha gamma")], "id long, text string")
    post = ranking.postings(docs, "id", "text")
    totals = spark.createDataFrame([(2, 2.5)], "n long, mean_length double")
    got = {r.doc: round(r.score, 6) for r in ranking.bm25(post, totals, spark.createDataFrame([(0, "alpha")], "query long, term string"), 5).collect()}
    assert got == {1: 0.244727, 0: 0.200353}


def test_rrf(spark):
    one = spark.createDataFrame([(0, 7, 1)], "query long, doc long, rank int")
    assert ranking.fused([one, one]).first().score == pytest.approx(2 / 61)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "a")], "source string, target string")
    assert {r.node: r.steps for r in graph.reachable(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert sum(r.rank for r in graph.pagerank(edges, 5, tolerance=None).collect()) == pytest.approx(1)


def test_pagerank_by_hand(spark):
    pairs = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]  # one edge twice, d leads nowhere
    rank, out = dict.fromkeys("abcd", 0.25), {"a": ["b"], "b": ["c"], "c": ["a", "d"]}
    for _ in range(4):
        lost = rank["d"] / 4
        rank = {n: 0.15 / 4 + 0.85 * (lost + sum(rank[s] / len(t) for s, t in out.items() if n in t)) for n in rank}
    got = {r.node: r.rank for r in graph.pagerank(spark.createDataFrame(pairs, "source string, target string"), 4, tolerance=None).collect()}
    assert got == pytest.approx(rank)


def test_select_only(spark):
    assert select_only(spark, "select 1 as x").first().x == 1
    with pytest.raises(ValueError):
        select_only(spark, "WITH a AS (SELECT 1) SELECT * FROM a")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    stream = telemetry.running(telemetry.read_stream(spark, source, schema))
    query = stream.writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda rows: sorted((r.event_type, r.n, round(r.total, 6), r.least, r.largest) for r in rows)
    assert key(spark.table("running").collect()) == key(telemetry.running(events).collect())


def test_cuts_are_dropped(spark, tmp_path):
    import os

    from corpuscope.operators.cut import cut, cuts_dropped, shared_folder

    kept = cut(spark.range(3).toDF("id"), "kept")
    with cuts_dropped(spark):
        inner = cut(kept, "inner")
        with cuts_dropped(spark):
            cut(inner, "innermost").write.parquet(f"{tmp_path}/out")
        assert inner.count() == 3
        names = [n.split("-")[0] for n in os.listdir(shared_folder(spark))]
        assert "inner" in names and "innermost" not in names
    names = [n.split("-")[0] for n in os.listdir(shared_folder(spark))]
    assert "inner" not in names and kept.count() == spark.read.parquet(f"{tmp_path}/out").count() == 3
