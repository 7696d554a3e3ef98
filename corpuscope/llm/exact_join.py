"""Exact similarity join of shingle sets by prefix filtering: the candidates it leaves out are none.

The shingles of each set are ordered by how many sets hold them, rare ones first (counted in buckets; any common order
is right, a better one is only faster). Of two similar sets, the first common shingle stands so early in both that
enough shingles are left for the overlap they need. Each shingle that stands early enough for some partner is a row
with the size its partners may have at most; rows of the same shingle meet if each size suits the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.shared import shingle_hashes, stored, word_hashes

#: Bits of a bucket number, 64-bit words of a set's parity bits, and sizes in a band are within this factor.
BUCKET_BITS, PARITY, BAND = 18, 8, 1.05
#: Rows of a shingle and band that meet in one task at most, unless more than MOST_HOT keys would have more.
BLOCK, MOST_HOT = 8192, 50_000


def set_of(packed: bytes, shingle: int) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return shingle_hashes(word_hashes(data, np.array([0, len(data)]))[0], shingle)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def order(texts: DataFrame, shingle: int) -> np.ndarray:
    """For each bucket of shingles, four times the binary logarithm of its sets; as many bytes at any size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                counts += np.bincount(_bucket(set_of(packed, shingle)), minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    rows = texts.select("packed").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.round(4 * F.log2(F.sum("n"))).cast("int").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def _parity(s: np.ndarray) -> bytes:
    """For each of 64 * PARITY bits, whether an odd number of shingles falls on it."""
    bits = np.bincount((s % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _rows(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """token, rep, component, size, least and most size of partners, and parity bits."""
    ranks = order(texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, component, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = set_of(packed, shingle)
                n = len(s)
                least = -(-percent * n // 100)
                s = s[np.lexsort((s, ranks[_bucket(s)]))]
                parity = np.frombuffer(_parity(s), np.int64)
                early = s[: n - least + 1]
                most = (100 + percent) * (n - np.arange(len(early))) // percent - n
                early, most = early[most >= least], most[most >= least]
                m = len(early)
                same = lambda v, m=m: pa.array(np.full(m, v, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(early.view(np.int64)), same(rep), same(component), same(n), same(least), pa.array(most), *map(same, parity)], names)

    names = ["token", "rep", "component", "size", "least", "most", *(f"p{k}" for k in range(PARITY))]
    return texts.select("rep", "component", "packed").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def similar_candidates(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs a < b of different components, all similar ones among them; texts: rep, component and compressed text.

    Rows of a shingle are parted by bands of sizes, and rows that no other row of their shingle suits, or that see
    their own component only, go before. Sizes, positions and parity bits are compared inside the join, so that only pairs
    which may be similar leave it. A shingle and band of very many rows is dealt in blocks: each block of one side meets
    each of the other in a task of its own.
    """
    parity = [f"p{k}" for k in range(PARITY)]
    rows = stored(_rows(texts, shingle, percent), "prefixes")
    of = rows.groupBy("token").agg(F.min("size").alias("smallest"), F.max("most").alias("widest"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    live = stored(rows.join(of.where("c0 < c1"), "token").where("most >= smallest and size <= widest").select(*rows.columns), "prefixes-live")
    band = lambda x: F.floor(F.log(x) / float(np.log(BAND))).cast("long")
    one = live.withColumn("band", band(F.col("size")))
    # Partners at most as large as b: the pair is found from its larger side, or from the larger id if sizes are equal.
    two = live.where("least <= most").withColumn("band", F.explode(F.sequence(band(F.col("least")), band(F.least("most", "size")))))

    # At most MOST_HOT keys have more than `block` rows, so their table has a bound.
    block = max(BLOCK, live.count() // MOST_HOT)
    hot = one.select("token", "band").union(two.select("token", "band")).groupBy("token", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    hot = F.broadcast(stored(hot, "hot-prefixes"))

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        """Each row goes to the block of its id on its own side, and to all blocks of the other side."""
        df = df.join(hot, ["token", "band"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        return df.withColumn(mine, F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    ends = lambda df, end: df.select("i", "j", "token", "band", *(F.col(c).alias(f"{c}_{end}") for c in rows.columns if c != "token"))
    left, right = ends(dealt(one, "i", "j"), "a"), ends(dealt(two, "j", "i"), "b")
    fit = "component_a <> component_b and (size_a < size_b or (size_a = size_b and rep_a < rep_b)) and size_a <= most_b and size_b <= most_a and size_a >= least_b"
    # Sets that differ in d shingles differ in at most d parity bits.
    apart = " + ".join(f"bit_count({p}_a ^ {p}_b)" for p in parity)
    same = " and ".join(f"l.{c} = r.{c}" for c in ("token", "band", "i", "j"))
    pairs = left.alias("l").join(right.alias("r").hint("merge"), F.expr(f"{same} and {fit} and ({apart}) * {100 + percent} <= (size_a + size_b) * {100 - percent}"))
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
