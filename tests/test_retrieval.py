"""Retrieval whose scores are summed up beside the texts: what leaves a task, and odd tables against SQL."""

from __future__ import annotations

import pytest
from test_same_as_sql import same

from corpuscope.operators import ranking


def tables(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


DOCS = [(1, "ab cd"), (1, "ab Ab ef gh"), (1, None), (None, "ab ef ef"), (None, "zz"), (2, None), (3, ""), (4, "cd cd ab x"), (5, "qq"), (6, "ab cd"), (7, "ab cd")]
ITEMS = [(1, "ab cd"), (2, "nowhere"), (3, "ef ef ab"), (4, None), (5, ""), (1, "ab"), (None, "cd gh")]


@pytest.mark.parametrize("name", ["bm25_top30", "overlap_top30", "fused_ranking"])
def test_repeated_and_missing_ids(spark, tmp_path, name):
    """A document of several rows is one, with the terms and the length of all; one without an id isn't found by BM25."""
    tables(spark, tmp_path, DOCS, ITEMS)
    same(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["bm25_top30", "overlap_top30"])
def test_nothing_is_found(spark, tmp_path, name):
    tables(spark, tmp_path, [(1, "ab"), (2, None)], [(1, "cd"), (2, None)])
    same(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["bm25_top30", "overlap_top30", "fused_ranking"])
def test_turns(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(ranking, "QUERIES", 2, raising=False)
    monkeypatch.setattr(ranking, "TERMS", 2, raising=False)
    tables(spark, tmp_path, DOCS, ITEMS)
    same(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["bm25_top30", "overlap_top30"])
def test_a_task_keeps_the_best_of_each_question(spark, tmp_path, monkeypatch, name):
    """Each document has a word of each question; before, a row for each of both was shuffled."""
    left, top = [], ranking.top

    def counted(scores, *rest):
        left.append((scores.count(), scores.rdd.getNumPartitions()))
        return top(scores, *rest)

    monkeypatch.setattr(ranking, "top", counted)
    tables(spark, tmp_path, [(k, f"ab cd w{k}") for k in range(600)], [(k, f"ab v{k}") for k in range(4)])
    same(spark, tmp_path, name)
    (rows, parts), = left
    assert rows <= parts * 4 * 30 and parts * 30 < 600


def test_best_of_several_batches():
    """Of equal scores the larger document stays; a null document and a null question keep their place."""
    import numpy as np
    import pyarrow as pa

    best = ranking.Best(2, 2, larger=True)
    for docs, scores in (([1, 2, None], [[1.0, 1.0, 3.0], [0.0, 0.0, 0.0]]), ([3], [[1.0], [2.0]])):
        best.add(pa.array(docs, pa.int64()), np.array(scores), np.array(scores) > 0)
    (batch,) = best.batches(pa.array([7, None]))
    assert batch.to_pylist() == [{"query": 7, "doc": None, "score": 3.0}, {"query": 7, "doc": 3, "score": 1.0}, {"query": None, "doc": 3, "score": 2.0}]


def test_vectors_are_made_where_their_texts_are(spark):
    from corpuscope.operators import dense

    df = spark.createDataFrame([(k, f"ab cd w{k}") for k in range(20)], "id long, t string")
    assert "Exchange" not in dense.hashed_vectors(df, "id", "t")._jdf.queryExecution().executedPlan().toString()


def test_vectors_of_repeated_and_missing_keys(spark):
    """Texts of a key count as one; a null key and a text without tokens have no places."""
    from corpuscope.operators import dense

    df = spark.createDataFrame([(1, "ab ab"), (1, "cd"), (2, "ab cd ab"), (None, "ab"), (None, "cd"), (3, None), (3, "x")], "id long, t string")
    got = {r.id: dict(zip(r.idx, r.value, strict=True)) for r in dense.hashed_vectors(df, "id", "t").collect()}
    assert got[1] == pytest.approx(got[2]) and len(got[1]) == 2 and sum(v * v for v in got[1].values()) == pytest.approx(1)
    assert got[None] == got[3] == {} and len(got) == 4


def test_dense_search_with_missing_ids(spark):
    from corpuscope.operators import dense

    vectors = spark.createDataFrame([(None, [], []), (4, [1], [1.0])], "doc long, idx array<int>, value array<double>")
    queries = spark.createDataFrame([(9, [1], [2.0])], "query long, idx array<int>, value array<double>")
    assert [(r.doc, r.score) for r in dense.dense_top(vectors, queries, 5).orderBy("rank").collect()] == [(4, 2.0), (None, 0.0)]
