"""Chunk spans against a plain loop."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpuscope.functions.text import chunk_spans


def plain(t: str, size: int, overlap: int) -> list[tuple[int, int]]:
    if len(t) <= size:
        return [(0, len(t))]
    out, start = [], 0
    while start < len(t):
        end = min(start + size, len(t))
        cut = t.rfind("\n", start, end)
        cut = cut if cut > start + size // 2 else end
        out.append((start, cut))
        start = max(start + 1, cut - overlap)
    return out


def test_chunks_of_odd_texts(spark):
    rng = random.Random(3)
    texts = ["", "ab", "x" * 2000, *("".join(rng.choice("ab \n😀é") for _ in range(n)) for n in (30, 61, 500, 3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunk_spans(F.col("t"), 30, 4, block=64).alias("s")).collect()
    for r in rows:
        assert [tuple(s) for s in r.s] == plain(texts[r.i], 30, 4), r.i
