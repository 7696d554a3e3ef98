"""Windows, shards and packing of a whole corpus against loops over it."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.operators import packing, token_stream
from corpuscope.sources.shards import Shards


def corpus(spark, sizes, seed=0):
    """Documents of so many tokens, under ids in another order than rows; one id is null, one repeats."""
    rng = np.random.default_rng(seed)
    ids = [None, *rng.permutation(len(sizes) - 1).tolist()]
    ids[3] = ids[4]
    rows = [(i, [int(x) for x in rng.integers(0, 65536, n)], "x") for i, n in zip(ids, sizes, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<int>, piece string").coalesce(1)
    return df, [t for _, r in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])) for t in r[1]]


SIZES = [5, 0, 1, 300, 2, 64, 63, 65, 0, 7, 129, 1, 1, 40]


@pytest.mark.parametrize(("size", "share"), [(1, 0.95), (8, 0.95), (64, 0.5), (100, 0.95), (10_000, 0.95)])
def test_windows(spark, size, share):
    df, stream = corpus(spark, SIZES)
    assert token_stream.length(token_stream.streamed(df, "doc_id", F.col("tokens"))) == len(stream)
    got = {(r.part, r.win): (r.inputs, r.labels) for r in token_stream.training_windows(token_stream.streamed(df, "doc_id", F.col("tokens")), len(stream), size, share).collect()}
    end = int(len(stream) * share)
    parts = {"train": stream[:end], "eval": stream[end:]}
    if len(parts["eval"]) < size:
        parts["eval"] = parts["train"]
    want = {(p, w): (t[w * size :][: size + 1][:-1], t[w * size :][: size + 1][1:]) for p, t in parts.items() for w in range(len(t) // size)}
    assert got == want


@pytest.mark.parametrize("size", [7, 64, 5000])
def test_shards(spark, size, tmp_path):
    df, stream = corpus(spark, SIZES, 1)
    n = len(stream)
    rows = token_stream.shards(token_stream.streamed(df, "doc_id", F.col("tokens")), n, size)
    spark.dataSource.register(Shards)
    for _ in range(2):  # written again, the folder holds the same
        rows.write.format("shards").mode("overwrite").save(f"{tmp_path}/out")
    parts = {"train": stream[: int(n * 0.9)], "val": stream[int(n * 0.9) : int(n * (0.9 + (1 - 0.9) / 2))], "test": stream[int(n * (0.9 + (1 - 0.9) / 2)) :]}
    want = {(p, k // size): np.array(t[k : k + size], "<u2").tobytes() for p, t in parts.items() for k in range(0, len(t), size)}
    files = {f: open(f"{tmp_path}/out/{f}", "rb").read() for f in os.listdir(f"{tmp_path}/out")}
    assert files == {f"{p}.{k:08d}.bin": data for (p, k), data in want.items()}
    assert {(r.part, r.shard): bytes(r.data) for r in spark.read.format("shards").load(f"{tmp_path}/out").collect()} == want
    assert b"".join(files[f] for p in ("train", "val", "test") for f in sorted(files) if f.startswith(p)) == np.array(stream, "<u2").tobytes()
    digest = spark.read.format("shards").load(f"{tmp_path}/out").where("part = 'val' and shard = 0").select(F.sha2("data", 256)).first()[0]
    assert digest == hashlib.sha256(want["val", 0]).hexdigest()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(Shards)
    good = spark.createDataFrame([("a", 1, bytearray(b"1"))], "part string, shard long, data binary")
    good.write.format("shards").mode("append").save(f"{tmp_path}/out")
    bad = spark.createDataFrame([("b", k, bytearray(b"2")) for k in range(5)] + [("no/name", 9, bytearray(b"3"))], "part string, shard long, data binary").repartition(3)
    with pytest.raises(Exception, match="letters, digits"):
        bad.write.format("shards").mode("overwrite").save(f"{tmp_path}/out")
    assert [f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".bin")] == ["a.00000001.bin"]


def test_empty_stream(spark):
    none = spark.createDataFrame([], "doc_id long, tokens array<int>")
    stream = token_stream.streamed(none, "doc_id", F.col("tokens"))
    assert token_stream.length(stream) == 0
    assert token_stream.training_windows(stream, 0, 8).count() == 0 and token_stream.shards(stream, 0, 8).count() == 0
    assert packing.packed(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n", 8).count() == 0


def next_fit(sizes, most):
    """A loop over all documents: window and boundary of each."""
    out, window, held, used = [], 0, 0, 0
    for n in sizes:
        joins = held > 0 and used + 1 + n <= most
        if used > 0 and not joins:
            window, held, used = window + 1, 0, 0
            joins = False
        used += joins
        out.append((window, used))
        used, held = used + n, held + 1
    return out


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
@pytest.mark.parametrize("seed", range(4))
def test_packing(spark, block, seed):
    rng = np.random.default_rng(seed)
    most = (10, 40, 25, 1)[seed]
    sizes = [int(x) for x in rng.choice([0, 0, 1, 2, 3, 9, 10, 11, 12, 30, 41, 100], 150)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n long").repartition(5)
    got = [(r.win, r.boundary) for r in packing.packed(df, "doc_id", "n", most, block).orderBy("place").collect()]
    assert got == next_fit(sizes, most)


def test_functions_of_blocks():
    """Whatever is used on entry, a block's summary says what is used and opened in the end."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        sizes = rng.choice([0, 1, 2, 5, 9, 13], int(rng.integers(1, 9)))
        reach, ends, opened = packing.summed_up(sizes, 10)
        for used in range(16):
            laid = packing.laid_out(sizes, 10, used, 0, False)
            j = packing.entered(reach, 10, used, False)
            if j >= len(sizes):
                assert laid[0][-1] == 0 and laid[1][-1] + sizes[-1] == used + np.sum(sizes + 1)
            else:
                assert laid[0][-1] == opened[j] + (used + reach[j] > 0) and laid[1][-1] + sizes[-1] == ends[j]
