"""The token stream of a corpus, cut at places of the whole stream: training windows and shards.

Documents follow each other in the order of their keys, null keys first, rows that repeat a key by where they are stored. Where
a document begins is the sum of the tokens before it, found without a single task; each document is then cut at the borders
of windows or shards that fall into it, and pieces of the same window meet by its number. No task holds more than a
document or a window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.operators import order
from corpuscope.operators.cut import cut

#: The token behind each document; words have 1 to 65,535.
END = 0


def token_ids(words: Column) -> Column:
    """16-bit tokens of words by their digests, and the end mark."""
    of = lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % 65535 + 1).cast("int")
    return F.concat(F.transform(words, of), F.array(F.lit(END)))


def streamed(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """tokens, n (how many) and before (the tokens of all documents before) of each document."""
    rows = cut(docs.select(F.col(key).alias("key"), tokens.alias("tokens")).withColumn("n", F.size("tokens").cast("long")).withColumn("row", F.monotonically_increasing_id()), "tokens")
    placed = order.running_total(rows.select("row", "key", "n"), [F.asc_nulls_first("key"), F.asc("row")], F.col("n"))
    return rows.select("row", "tokens").join(placed.select("row", "n", "before"), "row").select("tokens", "n", "before")


def length(stream: DataFrame) -> int:
    """Tokens of the whole stream."""
    return stream.agg(F.sum("n")).first()[0] or 0


def pieces(stream: DataFrame, ranges: Sequence[tuple[str, int, int]], size: int, overlap: int = 0, whole: bool = True) -> DataFrame:
    """part, piece and tokens: each named range [from, to) of the stream in pieces of `size` tokens and the `overlap` that follow.

    `whole` leaves out a last piece of fewer than `size`. Ranges may overlap; the overlap ends with its range.
    """
    parts = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi")) for p, a, b in ranges)))
    rows = stream.select("tokens", "n", "before", parts.alias("r")).select("*", "r.*")
    rows = rows.select("*", (F.greatest("before", "lo") - F.col("lo")).alias("a"), (F.least(F.col("before") + F.col("n"), "hi") - F.col("lo")).alias("b")).where("a < b")
    last = F.expr(f"(b - 1) div {size}")
    last = F.least(last, F.expr(f"(hi - lo) div {size} - 1")) if whole else last
    first = F.greatest(F.lit(0), F.expr(f"(a - {overlap}) div {size}"))
    rows = rows.withColumns({"first": first, "last": last}).where("first <= last")

    def share(piece: Column) -> Column:
        at, to = F.greatest("a", piece * size), F.least("b", piece * size + size + overlap)
        return F.struct(piece.alias("piece"), at.alias("at"), F.slice("tokens", (at + F.col("lo") - F.col("before") + 1).cast("int"), F.greatest(to - at, F.lit(0)).cast("int")).alias("tokens"))

    # Shares are cut before rows are made of them, so that no row but the document's own carries all of its tokens.
    shares = rows.select("part", F.explode(F.transform(F.sequence("first", "last"), share)).alias("s")).select("part", "s.*").where(F.size("tokens") > 0)
    met = shares.groupBy("part", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "tokens"))).alias("shares"))
    return met.select("part", "piece", F.flatten(F.transform("shares", lambda s: s["tokens"])).alias("tokens"))


def training_windows(stream: DataFrame, n: int, size: int, share: float = 0.95) -> DataFrame:
    """part (train, eval), win, inputs and labels (the inputs' successors) of windows of the stream.

    The first `share` of the stream trains, the rest evaluates; where it holds no window, evaluation takes what trains. The
    last window of a part lacks its last label's token if the part ends with it.
    """
    end = int(n * share)
    held = (end, n) if (n - end) // size else (0, end)
    rows = pieces(stream, [("train", 0, end), ("eval", *held)], size, overlap=1)
    less = F.size("tokens") - 1
    return rows.select("part", F.col("piece").alias("win"), F.slice("tokens", F.lit(1), less).alias("inputs"), F.slice("tokens", F.lit(2), less).alias("labels"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens as bytes, a shard at a time and from Arrow's numbers: as Python's they take ten times the room."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            data = row.column(2).flatten().to_numpy(zero_copy_only=False).astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([data], pa.binary())], ["part", "shard", "data"])


def shards(stream: DataFrame, n: int, size: int, share: float = 0.9) -> DataFrame:
    """part (train, val, test), shard and data: little-endian unsigned 16-bit tokens, `size` a shard, fewer in a part's last one."""
    c1, c2 = int(n * share), int(n * (share + (1 - share) / 2))
    rows = pieces(stream, [("train", 0, c1), ("val", c1, c2), ("test", c2, n)], size, whole=False)
    return rows.mapInArrow(_packed, "part string, shard bigint, data binary")
