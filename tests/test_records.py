"""Packing, windows, sketches and outcomes against hand-written models."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import records
from corpuscope.operators import sketch


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


def test_next_fit(spark):
    pack = lambda sizes: [tuple(p) for p in one(spark, sizes, "array<bigint>", lambda v: records.next_fit(v, 10))]
    assert pack([4, 5, 3]) == [(0, 0), (0, 5), (1, 0)]
    assert pack([20, 1]) == [(0, 0), (1, 0)]
    assert pack([0, 20, 2]) == [(0, 0), (0, 0), (1, 0)]
    assert pack([]) == []


def test_windows_and_labels(spark):
    got = one(spark, [1, 2, 3, 4, 5], "array<int>", lambda v: records.fixed_windows(v, 2))
    assert [(w.inputs, w.labels) for w in got] == [([1], [2]), ([3], [4])]
    assert one(spark, [1, 2, 3], "array<int>", lambda v: records.masked_labels(v, F.array(F.lit(0), F.lit(2)))) == [1, -100, 3]


def test_outcomes(spark):
    kind = lambda out, err, policy=False: spark.range(1).select(records.failure_kind(F.lit(False), F.lit(policy), F.lit(out), F.lit(err)).alias("k")).first().k
    assert [kind("timed out", ""), kind("", "", True), kind("", "Error: x"), kind("", "")] == ["SANDBOX_TIMEOUT", "SANDBOX_POLICY", "COMPILE_FAIL", "TEST_FAIL"]
    assert one(spark, {"token": "a", "k": "b"}, "map<string,string>", records.scrubbed) == {"k": "b"}
    assert one(spark, [0.5, 0.5], "array<double>", records.entropy) == pytest.approx(0.693147, abs=1e-5)


def test_signatures(spark):
    docs = spark.createDataFrame([(1, "foo Foo"), (2, "foo bar"), (3, ""), (4, None)], "id long, t string")
    got = {r.id: r.signature for r in sketch.signatures(docs, "id", "t").collect()}
    slot = lambda i, w: int(hashlib.sha256(f"7:{2 * i + 1}:{2 * i + 2}:{w}".encode()).hexdigest()[:8], 16)
    assert got[1] == [slot(i, "foo") for i in range(128)] and got[1][0] == 3671206260
    assert got[2] == [min(slot(i, w) for w in ("foo", "bar")) for i in range(128)] and got[3] is None and got[4] is None
    rows = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 0, 4]), (None, [1])], "a array<int>, b array<int>").select(sketch.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in rows] == [0.75, 0.0]


def first_fit(sigs, bands, rows):
    seen, kept = set(), set()
    for i, s in sorted(sigs.items()):
        keys = {(b, tuple(s[b * rows : b * rows + rows])) for b in range(bands)} if s else {None}
        if not keys & seen:
            kept.add(i)
            seen |= keys
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_first_equals_one_pass(spark, seed):
    rng = random.Random(seed)
    sigs = {i: [rng.randrange(5) for _ in range(6)] for i in range(60)} | {60: None, 61: None}
    sigs |= {100: [90, 90, 91, 91, 92, 92], 101: [90, 90, 93, 93, 94, 94], 102: [95, 95, 93, 93, 96, 96]}  # a chain: 101 goes, so 102 stays
    df = spark.createDataFrame(list(sigs.items()), "id long, signature array<long>")
    got = {r.id for r in sketch.keep_first(df, "id", 3, 2).collect() if r.kept}
    assert got == first_fit(sigs, 3, 2) and {100, 102} <= got and 101 not in got
    empty = sketch.keep_first(df.where("id < 0"), "id", 3, 2)
    assert empty.count() == 0


@pytest.mark.parametrize(("hot", "sure"), [(0, 0), (3, 2), (50, 32)])
def test_signatures_of_rare_and_long_words(spark, monkeypatch, hot, sure):
    monkeypatch.setattr(sketch, "HOT", hot)
    monkeypatch.setattr(sketch, "SURE", sure)
    monkeypatch.setattr(sketch, "BLOCK", 5)
    rng, long = random.Random(5), "x" * 70
    texts = [" ".join(rng.choice(["a", "b", "c", f"w{rng.randrange(60)}", long, long + "y"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = [(k % 50 if k % 7 else None, t) for k, t in enumerate([*texts, "", None, "..."])]  # null and repeated keys
    docs = spark.createDataFrame(rows, "id long, t string")
    want: dict = {}
    for key, t in rows:
        want.setdefault(key, set()).update((t or "").replace(".", "").split())
    slot = lambda i, w: int(hashlib.sha256(f"7:{2 * i + 1}:{2 * i + 2}:{w}".encode()).hexdigest()[:8], 16)
    found = sketch.signatures(docs, "id", "t", slots=8).collect()
    assert len(found) == len(want) and {r.id: r.signature for r in found} == {k: [min(slot(i, w) for w in s) for i in range(8)] if s else None for k, s in want.items()}
