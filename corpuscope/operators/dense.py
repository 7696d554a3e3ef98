"""Dense retrieval over hashed vectors: exact inner products in blocks, the best of each partition ranked at last."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import retrieval_tokens
from corpuscope.operators.ranking import Best, flat, lists_of, merged, repeated, top

DIM = 256
#: Queries whose vectors (8 MB at DIM) go to the executors at once; more are searched for in turns.
QUERIES = 4096
#: Documents that are compared with them at once: 32 MB of scores.
STEP = 1024


def hashed_vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, idx (lists) and value: the vector's places by the first byte of each token's md5, odd ones positive, normalised.

    A text without tokens has an empty list, and so has a null key. Tokens are counted where their text is; only rows of a
    repeated key, whose texts count as one, travel.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                owner, said = flat(part.column(1))
                said = said.dictionary_encode()
                place = np.array([hashlib.md5(t.encode(), usedforsecurity=False).digest()[0] for t in said.dictionary.to_pylist()], np.int64)
                cells = np.bincount(owner * DIM + place[said.indices.to_numpy(zero_copy_only=False)], minlength=part.num_rows * DIM)
                found = np.flatnonzero(cells)
                yield pa.RecordBatch.from_arrays([part.column(0), lists_of(found // DIM, (found % DIM).astype(np.int32), part.num_rows), lists_of(found // DIM, cells[found].astype(np.int64), part.num_rows)], ["key", "idx", "n"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.when(F.col(key).isNotNull(), retrieval_tokens(F.col(text))).alias("tokens")).mapInArrow(count, f"key {kind}, idx array<int>, n array<bigint>")
    again = repeated(df.select(F.col(key).alias("key")), "key")
    if not again.isEmpty():
        rows = merged(rows, "key", again, "idx", "n")
    # An array of one, so that the norm is found once and not for each cell.
    norm = F.sqrt(F.aggregate("n", F.lit(0.0), lambda a, n: a + (n * n).cast("double")))
    signed = lambda norm: F.zip_with("idx", "n", lambda i, n: F.when(i % 2 == 1, n).otherwise(-n).cast("double") / norm)
    return rows.select(F.col("key").alias(key), "idx", F.element_at(F.transform(F.array(norm), signed), 1).alias("value"))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query, doc, score and rank of the k documents with the largest inner product; zero and negative ones count too.

    vectors has doc, queries has query, both idx and value. Scores equal to so many digits tie, ties go to the smaller doc.
    A task keeps k documents for each of the block's queries, and only these leave it.
    """
    spark, out = vectors.sparkSession, None
    blocks = max(1, -(-queries.count() // QUERIES))
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow()  # about QUERIES rows
        ids, matrix = rows.column("query").combine_chunks(), _matrix(rows.column("idx").combine_chunks(), rows.column("value").combine_chunks())
        shared = spark.sparkContext.broadcast((ids, matrix))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best = Best(len(ids), k)
            for batch in batches:
                for start in range(0, batch.num_rows, STEP):
                    part = batch.slice(start, STEP)
                    best.add(part.column(0), np.round(matrix @ _matrix(part.column(1), part.column(2)).T, digits))
            yield from best.batches(ids)

        found = vectors.select("doc", "idx", "value").mapInArrow(search, "query bigint, doc bigint, score double")
        out = found if out is None else out.unionByName(found)
    return top(out, "query", [F.desc("score"), F.asc_nulls_last("doc")], k)


def _matrix(idx: pa.ListArray, value: pa.ListArray) -> np.ndarray:
    x = np.zeros((len(idx), DIM))
    owner, at = flat(idx)
    x[owner, at.to_numpy()] = value.flatten().to_numpy()
    return x
