"""Paths, migrations, table functions and documents against plain Python."""

from __future__ import annotations

import os
import random
import time
from itertools import product

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import tables
from corpuscope.functions.text import chunk_spans
from corpuscope.operators import migration, paths
from corpuscope.sources import documents


def smallest_path(near, a, b):
    """The smallest of all shortest paths, by whole levels of paths."""
    if a not in near or b not in near:
        return []
    level, seen = [[a]], {a}
    while level:
        if found := [p for p in level if p[-1] == b]:
            return min(found)
        longer = [[*p, n] for p in level for n in near[p[-1]] if n not in seen]
        seen |= {p[-1] for p in longer}
        level = longer
    return []


def test_paths(spark):
    rng = random.Random(5)
    links = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(38)] + [(f"line{k}", f"line{k + 1}") for k in range(25)] + [("x", "x"), (None, "n1"), ("n2", None), ("a1", "m2"), ("a1", "m1"), ("m1", "z"), ("m2", "z")]
    near = {}
    for a, b in links:
        if a and b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    ends = [(f"n{i}", f"n{j}") for i, j in product(range(0, 30, 3), range(0, 30, 4))] + [("line0", "line25"), ("line3", "n1"), ("x", "x"), ("nowhere", "nowhere"), ("a1", "z"), ("n1", None), ("z", "m2")]
    pairs = [(k, a, b) for k, (a, b) in enumerate(ends)]
    got = {r.pair: r.path for r in paths.shortest_paths(spark.createDataFrame(links, "source string, target string"), spark.createDataFrame(pairs, "pair long, source string, target string")).collect()}
    assert got == {k: smallest_path(near, a, b) for k, a, b in pairs}
    assert got[len(ends) - 3] == ["a1", "m1", "z"] and len(got[len(ends) - 7]) == 26


@pytest.mark.parametrize("broken", ["fill", "mark"])
def test_a_migration_goes_on(spark, tmp_path, broken):
    """It stops inside the third go, or between its rows and its mark; each row is filled once, filled ones stay."""
    rows = [(k // 2, f"t{k}", 7 if k % 5 == 0 else None) for k in range(60)] + [(None, "no key", None)]
    df = spark.createDataFrame(rows, "id long, text string, tokens long").repartition(3)
    calls = []

    def fill(part):
        calls.append(1)
        if broken == "fill" and len(calls) == 3:
            raise RuntimeError("killed")
        return part.withColumn("tokens", F.coalesce("tokens", F.lit(len(calls)).cast("long")))

    run = lambda **more: migration.migrated(df, "id", fill, str(tmp_path / "m"), size=4, batches=2, **more)
    if broken == "fill":
        with pytest.raises(RuntimeError):
            run()
        assert len(os.listdir(tmp_path / "m/done")) == 2
    else:
        run(most=2)
        fill(df.where("id between 8 and 11")).write.parquet(str(tmp_path / "m/out/go=2"))  # written, never marked
    out = run().collect()
    assert sorted((r.id is not None, r.id, r.text) for r in out) == sorted((i is not None, i, t) for i, t, _ in rows)
    assert all(r.tokens == 7 for r in out if r.text[1:].isdigit() and int(r.text[1:]) % 5 == 0)
    by_id = {}
    for r in out:
        by_id.setdefault(r.id, set()).add(r.go)
    assert all(len(g) == 1 for g in by_id.values()) and {r.go for r in out} == set(range(8))
    before = len(calls)
    assert run().count() == len(rows) and len(calls) == before


def spans(spark, texts):
    spark.udtf.register("text_chunks", tables.TextChunks)
    spark.createDataFrame(list(enumerate(texts)), "i int, t string").createOrReplaceTempView("some_texts")
    return spark.sql("SELECT i, c.* FROM some_texts, LATERAL text_chunks(t) c")


def test_chunks(spark):
    rng = random.Random(3)
    texts = ["", "ab", "x" * 4000, None, *("".join(rng.choice("ab \n😀é") for _ in range(n)) for n in (1500, 1501, 9000))]
    got = {}
    for r in spans(spark, texts).orderBy("i", "chunk").collect():
        got.setdefault(r.i, []).append((r.start, r.end))
        assert texts[r.i][r.start : r.end] == r.text
    want = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunk_spans(F.col("t")).alias("s")).collect()
    assert got == {r.i: [tuple(s) for s in r.s] for r in want if r.s is not None}


def test_chunks_of_a_very_long_text(spark):
    """More than ten thousand chunks come out, one after another."""
    rows = spans(spark, ["word " * 3_200_000])
    one = rows.agg(F.count("*").alias("n"), F.max("end").alias("end"), F.max(F.length("text")).alias("longest")).first()
    assert one.n > 11_000 and one.end == 16_000_000 and one.longest == 1500


PYTHON = """import os
class Outer(Base):
    x = 1

    def inner(self,
  b=2):
        if b:
            def deep():
                return 1

        return b
    class Mid:
        def leaf(self): 
            pass


def after(a):
    return a
# end
"""
JAVA = """package a;
public class Outer {
    private int x = 1; // { not a brace
    public int inner(int a) {
        String s = "}"; if (a > 1) { return 2; }
        return 1;
    }
    private class Mid {
        void leaf(int b) { /* } */
        }
    }
}
interface Second {
    int wanted(int a) throws E {
    }
}
"""


def scoped(text, language):
    made = tables.ScopedSymbols.func() if hasattr(tables.ScopedSymbols, "func") else tables.ScopedSymbols()
    return [(q, a, z) for _, _, q, a, z in made.eval(text, language)]


def test_scopes(spark):
    assert scoped(PYTHON, "python") == [("Outer", 2, 14), ("Outer.inner", 5, 11), ("Outer.inner.deep", 8, 9), ("Outer.Mid", 12, 14), ("Outer.Mid.leaf", 13, 14), ("after", 17, 18)]
    assert scoped(JAVA, "java") == [("Outer", 2, 12), ("Outer.inner", 4, 7), ("Outer.Mid", 8, 11), ("Outer.Mid.leaf", 9, 10), ("Second", 13, 16), ("Second.wanted", 14, 15)]
    assert scoped(None, "python") == [] and scoped("", "java") == [] and scoped("x", "cobol") == []
    assert [q for q, _, _ in scoped("class A {\n  b() {}\n", "javascript")] == ["A"]


def test_scopes_by_brute_force():
    """Random nests of blocks: a symbol's scope names the blocks whose lines are around it."""
    rng = random.Random(7)
    for _ in range(30):
        lines, truth = [], []

        def nest(depth, path, lines=lines, truth=truth, rng=rng):
            for _ in range(rng.randrange(3)):
                name, at = f"f{len(truth)}", len(lines)
                truth.append([".".join([*path, name]), at + 1, None])
                mine = truth[-1]
                lines.append("    " * depth + f"def {name}():")
                lines.append("    " * depth + "    pass")
                if rng.random() < 0.3:
                    lines.append("")
                if depth < 4:
                    nest(depth + 1, [*path, name])
                mine[2] = max(i for i, line in enumerate(lines) if line.strip()) + 1

        nest(0, [])
        assert scoped("\n".join(lines) + "\n", "python") == [tuple(t) for t in truth]


def test_scopes_are_linear():
    took = []
    for n in (2_000, 8_000):
        text = "".join(f"class C{i}:\n    def m(self):\n        return {i}\n" for i in range(n))
        began = time.perf_counter()
        assert len(scoped(text, "python")) == 2 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_documents(spark, tmp_path):
    documents.register(spark)
    path, schema = str(tmp_path / "docs"), "k long, v double, s string, a array<int>"
    rows = [(k, float(k), f"é{k}\n", [k]) for k in range(40)] + [(None, 1.0, None, None)]
    df = spark.createDataFrame(rows, schema).repartitionByRange(4, "k")
    save = lambda df, mode, **o: df.write.format("documents").option("key", "k").options(**o).mode(mode).save(path)
    read = lambda: spark.read.format("documents").schema(schema).option("key", "k").load(path)
    save(df, "append")
    assert sorted(map(repr, map(tuple, read().collect()))) == sorted(map(repr, rows))
    found = read().where("k >= 35")
    assert {r.k for r in found.collect()} == set(range(35, 40)) and found.rdd.getNumPartitions() == 1
    bad = spark.createDataFrame([(100, float("nan"), "x", None), (101, 1.0, "y", None)], schema)
    with pytest.raises(Exception, match="JSON compliant|Out of range"):
        save(bad.coalesce(1), "append")
    assert read().count() == 41
    save(bad, "append", failures="swallow")
    assert {r.k for r in read().where("k > 50").collect()} == {101}
    save(df.where("k < 3"), "overwrite")
    assert {r.k for r in read().collect()} == {0, 1, 2}
    assert spark.read.format("documents").schema(schema).option("key", "k").load(str(tmp_path / "none")).count() == 0
