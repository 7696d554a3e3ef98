"""Dense search against all inner products, with ties, over batches and partitions of any size."""

from __future__ import annotations

import numpy as np
import pytest

from corpuscope.operators import dense


def vectors(n, rng, name):
    """Vectors of few places, so that many scores are equal; some have none."""
    rows = []
    for i in rng.permutation(n).tolist():
        at = sorted(rng.choice(6, int(rng.integers(0, 4)), replace=False).tolist())
        rows.append((i, at, [float(rng.integers(-2, 3)) for _ in at]))
    return rows, f"{name} long, idx array<int>, value array<double>"


def dot(a, b):
    other = dict(zip(b[1], b[2], strict=True))
    return sum(v * other.get(i, 0.0) for i, v in zip(a[1], a[2], strict=True))


@pytest.mark.parametrize(("n", "k", "step", "batch", "parts"), [(200, 7, 16, 10_000, 1), (200, 7, 16, 5, 4), (40, 60, 1024, 10_000, 3), (30, 1, 1, 3, 2)])
def test_dense_top(spark, monkeypatch, n, k, step, batch, parts):
    rng = np.random.default_rng(n + k)
    (docs, shape), (queries, asked) = vectors(n, rng, "doc"), vectors(9, rng, "query")
    monkeypatch.setattr(dense, "STEP", step)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        found = dense.dense_top(spark.createDataFrame(docs, shape).repartition(parts), spark.createDataFrame(queries, asked), k)
        got = sorted((r["query"], r["rank"], r["doc"], r["score"]) for r in found.collect())
    finally:
        spark.conf.set(key, before)
    want = []
    for q in queries:
        best = sorted((-dot(q, d), d[0]) for d in docs)[:k]
        want += [(q[0], i + 1, doc, -score) for i, (score, doc) in enumerate(best)]
    assert got == sorted(want)


def test_more_queries_than_a_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    (docs, shape), (queries, asked) = vectors(50, rng, "doc"), vectors(23, rng, "query")
    monkeypatch.setattr(dense, "QUERIES", 5)
    found = dense.dense_top(spark.createDataFrame(docs, shape), spark.createDataFrame(queries, asked), 4)
    got = {(r["query"], r["rank"]): r["doc"] for r in found.collect()}
    assert got == {(q[0], i + 1): d[0] for q in queries for i, d in enumerate(sorted(docs, key=lambda d: (-dot(q, d), d[0]))[:4])}


def test_nothing_to_search(spark):
    shape = "idx array<int>, value array<double>"
    one, none = spark.createDataFrame([(1, [0], [1.0])], f"query long, {shape}"), spark.createDataFrame([], f"doc long, {shape}")
    assert dense.dense_top(none, one, 3).count() == 0
    assert dense.dense_top(one.withColumnRenamed("query", "doc"), none.withColumnRenamed("doc", "query"), 3).count() == 0
