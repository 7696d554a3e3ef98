"""Near duplicates in a crowded region: many texts share a long passage, a few pairs are similar enough."""

from __future__ import annotations

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from corpuscope.llm import exact_join, neardup


def crowded(spark, docs, pairs):
    """Texts of 100 words, 88 of them shared by all (similarity 88 / 112); each pair shares one more (89 / 111)."""
    shared = " ".join(f"s{k}" for k in range(88))
    own = {d: [f"w{d}x{k}" for k in range(12)] for d in range(docs)}
    for d in range(pairs):  # ids far apart, as rows with equal keys are ordered by id
        own[docs - 1 - d][0] = own[d][0]
    return spark.createDataFrame([(d, f"{shared} {' '.join(w)}") for d, w in own.items()], "doc_id long, text string")


def missed(df, docs, pairs):
    rows = neardup.classes(df, shingle=1).collect()
    assert len(rows) == docs
    return [r.doc_id for r in rows if r.component_id != min(r.doc_id, docs - 1 - r.doc_id if r.doc_id >= docs - pairs else r.doc_id)]


def test_no_pair_is_missed(spark):
    assert not missed(crowded(spark, 1500, 150).repartition(3), 1500, 150)


@pytest.mark.parametrize("partitions", [1, 4, 300, 2000])
def test_links_do_not_depend_on_partitions(spark, partitions):
    """With many partitions most hold less than a window of the forest's rows."""
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        assert not missed(crowded(spark, 40, 15), 40, 15)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def packed(spark, docs, seed=4):
    """Texts that share 80 words and have 20 of 2,000 others: similarity about two thirds."""
    rng, pack = np.random.default_rng(seed), zstandard.ZstdCompressor().compress
    shared = [f"s{k}" for k in range(80)]
    rows = [(d, d, " ".join([*shared, *(f"o{x}" for x in rng.choice(2000, 20, replace=False))])) for d in range(docs)]
    return [(d, c, bytearray(pack(t.encode()))) for d, c, t in rows], [set(t.split()) for _, _, t in rows]


@pytest.mark.parametrize("block", [8192, 5])
def test_joined_rows_follow_the_links(spark, block, monkeypatch):
    """The exact join finds all similar pairs, dealt in blocks or not, and lets few others out of it."""
    monkeypatch.setattr(exact_join, "BLOCK", block)
    found = []
    for docs in (300, 600, 1200) if block > 5 else (300,):
        rows, sets = packed(spark, docs)
        df = spark.createDataFrame(rows, "rep long, component long, packed binary").repartition(4)
        pairs = {tuple(r) for r in exact_join.similar_candidates(df, 1, 80).collect()}
        near = {(i, j) for j in range(docs) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        assert near <= pairs
        found.append(len(pairs))
    assert max(found) <= 20


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(exact_join, "BLOCK", 7)
    rng, pack = np.random.default_rng(8), zstandard.ZstdCompressor().compress
    texts = [" ".join([*(f"s{k}" for k in range(30)), *(f"o{x}" for x in rng.choice(9, 5, replace=False))]) for _ in range(80)]
    sets = [set(t.split()) for t in texts]
    df = spark.createDataFrame([(d, d, bytearray(pack(t.encode()))) for d, t in enumerate(texts)], "rep long, component long, packed binary")
    pairs = exact_join.similar_candidates(df, 1, 80)
    near = {(i, j) for j in range(80) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    got = [tuple(r) for r in pairs.select(F.col("a"), F.col("b")).collect()]
    assert near <= set(got) and len(got) == len(set(got))
