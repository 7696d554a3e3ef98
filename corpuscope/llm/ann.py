"""Approximate nearest neighbours by inner product, with collision-counting hashing.

Vectors are scaled by the largest norm and get one more component that makes them unit length, so that the largest
inner product is the smallest distance. Each of PROJECTIONS single projections gives a sorted array of its block's
vectors, cut into buckets. A query's window around its own projection is widened in steps by whole buckets (virtual
rehashing: no other hash table is needed for a larger radius); each vector counts in how many arrays the window holds it
(sets of vectors are bits and counters bit planes, so that one operation counts 64 vectors), and once enough vectors
exceed the collision threshold these are verified by their exact inner product, in double precision, on the original
vectors.

Work is dealt in tiles: a block of rows with a group of query blocks, all of bounded size; the best of each block of rows
are ranked at last. Nothing is capped: windows widen until VERIFIED * k vectors of a block collide often enough, and of
vectors that tie all are verified. As a block is a smaller and smaller part of a growing table, it holds fewer and fewer of
the true neighbours, so what is verified per block stays a multiple of k. Counting collisions takes a fixed part of an
operation for each query and row; on vectors without any structure single projections leave no rows out before that, so
work grows with queries times rows.

Vectors that are null, zero or hold null or non-finite components take no part, nor do vectors of another than the most
frequent length. Rows that repeat an id count once (with the smallest vector). Only the id and the vector are read, so other
columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.shared import batches_of, stored

PROJECTIONS = 128
#: Buckets of equal size in a sorted array; windows are widened by whole buckets.
BUCKETS = 64
#: Share of the arrays in which a vector must collide, and how many vectors of a block must do so, as a multiple of k.
THRESHOLD, VERIFIED = 0.75, 16
#: First half width of the first windows in a block, and their growth, in standard deviations of a random unit vector's projection.
WIDTH, GROWTH = 0.5, 1.1
#: Vectors in a block of rows and of queries, and query blocks in a tile.
ROWS, QUERIES, GROUP = 8192, 512, 64


def projections(dim: int) -> np.ndarray:
    """PROJECTIONS directions in blocks of orthogonal ones, of length sqrt(dim)."""
    rng = np.random.default_rng(7)
    blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.concatenate(blocks)[:PROJECTIONS] * np.sqrt(dim)


class Index:
    """The sorted arrays of a block, each cut into buckets of equal size, with the set of vectors before each bucket as bits."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, largest: float) -> None:
        n, dim = x.shape
        self.ids, self.x = ids, x.astype(np.float64)
        self.directions = projections(dim + 1)
        scaled = self.x / largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(1)))
        h = (scaled @ self.directions[:, :dim].T + rest[:, None] * self.directions[:, dim]).astype(np.float32).T
        order = np.argsort(h, axis=1, kind="stable")
        step = -(-n // BUCKETS)
        self.starts = np.take_along_axis(h, order[:, ::step], axis=1)
        cuts = np.arange(self.starts.shape[1] + 1)[:, None]
        bucket = np.empty(n, np.int16)
        self.before = np.zeros((PROJECTIONS, len(cuts), -(-n // 64)), np.uint64)
        for p in range(PROJECTIONS):
            bucket[order[p]] = np.arange(n) // step
            bits = np.packbits(bucket < cuts, axis=1, bitorder="little")
            self.before[p].view(np.uint8)[:, : bits.shape[1]] = bits

    def colliding(self, hq: np.ndarray, width: float) -> np.ndarray:
        """Of each query, the vectors that its windows hold in enough arrays; whole buckets that a window touches count."""
        waiting: list[list[np.ndarray]] = [[] for _ in range(PROJECTIONS.bit_length() + 1)]
        for p in range(PROJECTIONS):
            low = np.maximum(np.searchsorted(self.starts[p], hq[:, p] - np.float32(width)) - 1, 0)
            high = np.searchsorted(self.starts[p], hq[:, p] + np.float32(width), side="right")
            waiting[0].append(self.before[p][np.maximum(high, low)] ^ self.before[p][low])
            # Counters are bit planes: three sets of the same weight become one of it and one of the next.
            for level in range(len(waiting) - 1):
                if len(waiting[level]) < 3:
                    break
                u, v, w = waiting[level]
                either = u ^ v
                waiting[level] = [either ^ w]
                waiting[level + 1].append((u & v) | (either & w))
        planes = []
        for level, sets in enumerate(waiting):
            while len(sets) > 1:
                u, v = sets.pop(), sets.pop()
                sets.append(u ^ v)
                waiting[level + 1].append(u & v)
            planes.append(sets[0] if sets else np.zeros_like(waiting[0][0]))
        # Planes are compared with the threshold from the highest down.
        least = int(np.ceil(THRESHOLD * PROJECTIONS))
        more, same = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
        for level in reversed(range(len(planes))):
            if least >> level & 1:
                same &= planes[level]
            else:
                more |= same & planes[level]
                same &= ~planes[level]
        return np.unpackbits((more | same).view(np.uint8), axis=1, count=len(self.ids), bitorder="little").view(bool)

    def found(self, q: np.ndarray, qids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of the best k of this block for each query."""
        n, dim = self.x.shape
        qd = q.astype(np.float64)
        hq = (qd / np.sqrt((qd**2).sum(1))[:, None] @ self.directions[:, :dim].T).astype(np.float32)
        need = min(n, VERIFIED * k)
        first = WIDTH
        for c in range(0, len(q), 64):
            width, enough, open_ = first, None, np.arange(c, min(c + 64, len(q)))
            while len(open_):
                hits = self.colliding(hq[open_], width)
                done = hits.sum(1) >= need
                if enough is None and done.any():
                    enough = width
                for i, hit in zip(open_[done].tolist(), hits[done], strict=True):
                    good = np.flatnonzero(hit)
                    good = good[self.ids[good] != qids[i]]
                    scores = (self.x[good] * qd[i]).sum(1)
                    if len(good) > k:
                        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                        top = scores >= edge
                        good, scores = good[top], scores[top]
                    best = np.lexsort((self.ids[good], -scores))[:k]
                    yield int(qids[i]), self.ids[good[best]], scores[best]
                open_ = open_[~done]
                width *= GROWTH
            # The next queries' windows begin a step below what was enough for the first of these, or narrower if all were at once.
            first = enough / GROWTH if enough > first else first / GROWTH**2


def blocks(vectors: DataFrame, count: int, size: int, name: str) -> DataFrame:
    """Rows of about `size` vectors each: block number, ids and components as binary."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        ids = t.column("vec_id").to_numpy().astype("<i8")
        values = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8")
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "values": pa.array([values.tobytes()], pa.binary())})

    single = "float" in vectors.schema["embedding"].dataType.simpleString()
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-count // size)))))
    return stored(dealt.groupBy("block").applyInArrow(pack, "block bigint, ids binary, values binary"), name)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and embedding of what takes part, once for each id."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(F.coalesce(good, F.lit(False))).select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"))
    rows = rows.withColumn("__dim", F.size("embedding"))
    common = rows.groupBy("__dim").count().orderBy(F.desc("count"), "__dim").first()
    rows = rows.where(F.col("__dim") == (common["__dim"] if common else 0)).drop("__dim")
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(df: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of each row whose id is divisible by `every`."""
    batches_of(df.sparkSession)
    rows = stored(usable(df, key, vector), "vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    count, largest, dim = rows.agg(F.count("*"), F.sqrt(F.max(square)), F.max(F.size("embedding"))).first()
    asked = rows.where(F.col("vec_id") % every == 0)
    row_blocks = blocks(rows, count, ROWS, "row-blocks")
    query_blocks = blocks(asked, -(-count // every), QUERIES, "query-blocks")
    kind = "<f4" if "float" in rows.schema["embedding"].dataType.simpleString() else "<f8"
    last = max(1, -(-count // ROWS)) - 1
    # A tile is a block of rows and a group of query blocks; tiles are many enough that none holds more than GROUP blocks.
    last = max(1, -(-count // ROWS)) - 1
    groups = max(1, -(-(-(-count // every)) // (QUERIES * GROUP)))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("block")
    dealt = query_blocks.select((F.col("block") % groups).alias("group"), F.col("ids").alias("query_ids"), F.col("values").alias("query_values"), every_block)
    rows_of = row_blocks.select("block", "ids", "values", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    # Tiles are few bytes and much work: a fixed number of partitions, more than tiles, keeps them from sharing a task.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * (last + 1) * groups)
    spread = lambda side: side.repartition(tasks, "block", "group")
    pairs = spread(dealt).join(spread(rows_of).hint("merge"), ["block", "group"]).select("query_ids", "query_values", "ids", "values")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = None, None
        for batch in batches:
            for j in range(len(batch)):
                qi, qv, xi, xv = (c[j].as_py() for c in batch.columns)
                if xi != held:  # the join brings the pairs of a block of rows one after another
                    index, held = Index(np.frombuffer(xv, kind).reshape(-1, dim), np.frombuffer(xi, "<i8"), largest), xi
                got = list(index.found(np.frombuffer(qv, kind).reshape(-1, dim), np.frombuffer(qi, "<i8"), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]).astype(np.int64)),
                        pa.array(np.concatenate([np.zeros(0, np.int64), *(g[1] for g in got)])),
                        pa.array(np.concatenate([np.zeros(0), *(g[2] for g in got)])),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    hits = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
