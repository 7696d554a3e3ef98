"""Next-fit packing of a whole corpus in order, without a task that sees all of it.

A document joins the open window if it fits behind one separator; otherwise it opens a window, in which it may be larger than
the window. What a block of documents does to the open window is a function of how much of it is used: the more is used,
the earlier the block's first new window begins, and from there on nothing depends on what came before. So a block is told
by the few places at which a first window may begin (those that fit into one window) and, for each, what is used in the
end and how many windows were opened. Blocks are summed up side by side, their functions are applied in order, a row for
each block, and then every block lays out its own documents.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.operators import order
from corpuscope.operators.cut import cut

#: Documents of a block.
BLOCK = 65_536


def _reach(sizes: np.ndarray) -> np.ndarray:
    """What documents take, each with one separator, up to each of them."""
    return np.concatenate([[0], np.cumsum(sizes + 1)])


def _next_starts(reach: np.ndarray, most: int) -> list[int]:
    """For a window that starts at each document, where the next one starts."""
    n = len(reach) - 1
    return np.maximum(np.arange(1, n + 1), np.searchsorted(reach, reach[:-1] + most + 1, side="right") - 1).tolist()


def summed_up(sizes: np.ndarray, most: int) -> tuple[list[int], list[int], list[int]]:
    """reach, and for windows that start at each place that some entry may lead to: used in the end, windows opened after it."""
    reach, n = _reach(sizes), len(sizes)
    used, opened = [0] * n, [0] * n
    following, taken = _next_starts(reach, most), reach.tolist()
    for j in range(n - 1, -1, -1):
        k = following[j]
        if k >= n:
            used[j] = taken[n] - taken[j] - 1
        else:  # a window that holds empty documents alone isn't left
            used[j], opened[j] = used[k], opened[k] + (taken[k] - taken[j] - 1 > 0)
    some = min(n, bisect_right(taken, most))
    return taken[: some + 1], used[:some], opened[:some]


def entered(reach: list[int], most: int, used: int, fresh: bool) -> int:
    """The first document of a block that starts a window, if `used` is taken on entry; fresh: there is no window yet."""
    return 0 if fresh else max(0, bisect_right(reach, most - used) - 1)


def laid_out(sizes: np.ndarray, most: int, used: int, window: int, fresh: bool) -> tuple[np.ndarray, np.ndarray]:
    """Window and boundary of each document of a block."""
    reach, n = _reach(sizes), len(sizes)
    following = _next_starts(reach, most)
    windows, boundaries = np.full(n, window, np.int64), used + reach[:-1] + 1
    j = entered(reach.tolist(), most, used, fresh)
    starts = [j]
    while starts[-1] < n:
        starts.append(following[starts[-1]])
    before = used + int(reach[min(j, n)])
    for a, b in pairwise(starts):
        window += before > 0 and not (fresh and a == 0)
        windows[a:b], boundaries[a:b] = window, reach[a:b] - reach[a]
        before = int(reach[b] - reach[a] - 1)
    return windows, boundaries


def packed(docs: DataFrame, key: str, size: str, most: int, block: int = BLOCK) -> DataFrame:
    """docs, place (in the order of keys, null keys first, then as stored), win and boundary (characters before it in its window)."""
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "unpacked")
    placed = order.numbered(rows.select("__row", F.col(key).alias("__key"), F.col(size).cast("long").alias("__n")), [F.asc_nulls_first("__key"), F.asc("__row")])
    placed = cut(placed.select("__row", "__n", "place", F.expr(f"place div {block}").alias("block")), "placed")

    def sizes_of(t: pa.Table) -> np.ndarray:
        return t.column("__n").to_numpy()[np.argsort(t.column("place").to_numpy())]

    def sum_up(key: tuple, t: pa.Table) -> pa.Table:
        sizes = sizes_of(t)
        reach, used, opened = summed_up(sizes, most)
        return pa.table({"block": pa.array([key[0].as_py()]), "total": pa.array([int(_reach(sizes)[-1])]), "reach": pa.array([reach], pa.list_(pa.int64())), "used": pa.array([used], pa.list_(pa.int64())), "opened": pa.array([opened], pa.list_(pa.int64())), "n": pa.array([len(sizes)])})

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, window, fresh = 0, 0, True
        for batch in batches:
            out = []
            for number, total, reach, ends, opened, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append((number, used, window, fresh))
                j = entered(reach, most, used, fresh)
                if j >= n:
                    used += total
                else:
                    window += opened[j] + (not fresh and used + reach[j] > 0)
                    used = ends[j]
                fresh = False
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_())], ["block", "entry", "window", "fresh"])

    sums = placed.groupBy("block").applyInArrow(sum_up, "block bigint, total bigint, reach array<bigint>, used array<bigint>, opened array<bigint>, n bigint")
    at = cut(sums.repartition(1).sortWithinPartitions("block").mapInArrow(entries, "block bigint, entry bigint, window bigint, fresh boolean"), "entries")  # a row for each block

    def lay_out(left: pa.Table, right: pa.Table) -> pa.Table:
        back = np.argsort(left.column("place").to_numpy())
        e = right.to_pylist()[0]
        windows, boundaries = laid_out(sizes_of(left), most, e["entry"], e["window"], e["fresh"])
        return pa.table({"__row": left.column("__row").take(pa.array(back)), "place": left.column("place").take(pa.array(back)), "win": pa.array(windows), "boundary": pa.array(boundaries)})

    out = placed.groupBy("block").cogroup(at.groupBy("block")).applyInArrow(lay_out, "__row bigint, place bigint, win bigint, boundary bigint")
    return rows.join(out, "__row").drop("__row")
