"""Queries against their SQL on small tables that hold what the test data at sf0.001 lack."""

from __future__ import annotations

import glob
import os
import random

import duckdb
import pytest

from corpuscope import registry
from corpuscope.plans import load_all

load_all()


def same(spark, folder, name, digits=9):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    plain = lambda v: float(f"{v:.{digits}g}") if isinstance(v, float) else v
    want = sorted(repr(tuple(map(plain, r))) for r in found.fetchall())
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in registry.QUERIES[name](spark, str(folder)).collect())
    assert got == want


@pytest.mark.parametrize("above", [1, 0])
def test_median_of_a_large_group(spark, tmp_path, above):
    """One row decides between two quantities; an approximate percentile misses it."""
    rows = [25.0] * 50_000 + [26.0] * (50_000 + above)
    random.Random(3).shuffle(rows)
    lines = spark.createDataFrame([(1, 1, q, "R" if k % 3 else "N") for k, q in enumerate(rows)] + [(1, 2, None, "R")], "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string")
    lines.repartition(8).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "b1", 10.5, 3), (2, "b2", None, None)], "p_partkey long, p_brand string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "high")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    same(spark, tmp_path, "quality_vs_latency")


def test_losses_of_half_a_thousandth_and_of_less_than_none(spark, tmp_path):
    """Balances whose scaled double is just below a half, halves, small negative ones and none."""
    balances = [5075.0, 5095.0, 4625.0, -4625.0, -0.01, -4.99, -5.0, 0.0, 9999.99, None]
    spark.createDataFrame([(k, k % 2, b) for k, b in enumerate(balances)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    same(spark, tmp_path, "scaling_series")


@pytest.mark.parametrize("name", ["suspicious_patterns", "table_mentions", "tokenizer_report"])
def test_words_beside_other_letters(spark, tmp_path, name):
    """Words end where ASCII letters, digits and underscores do, and fold as they do in SQL."""
    words = ["sudo", "\u017fudo", "base64", "p\u212aexec", "chmod", "777", " ", "\x0b", "\n", "\u00f1", "\u00e9", "\u0301", "\u0663", "_", "1", "curl", "wget", "/root/", ".\u017fsh/", "from ", "JOIN t", "def f(", "func g ("]
    pick = random.Random(11)
    texts = ["a sudo\u00f1bo", "\u00e9from t1", "\u00f1def f(x)", "", None] + ["".join(pick.choices(words, k=pick.randint(1, 6))) for _ in range(2000)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, tmp_path, name)


def test_words_are_found_once_for_all_windows(spark):
    """Inside a lambda the tokens were found anew for each window of a text."""
    from pyspark.sql import functions as F

    from corpuscope.functions import records, text

    df = spark.createDataFrame([(" ".join(f"w{k}" for k in range(150)),), (None,), ("one",)], "t string").select(records.fixed_windows(text.word_tokens(F.col("t")), 64).alias("w"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = [r.w for r in df.collect()]
    assert [[(w.inputs[0], w.inputs[-1], w.labels[0], w.labels[-1]) for w in ws or []] for ws in got] == [[("w0", "w62", "w1", "w63"), ("w64", "w126", "w65", "w127")], [], []]


def test_edges_of_a_repository_come_from_two_passes(spark):
    """Tests also meet the symbols of other rows of their path; files without a text keep their edge."""
    from pyspark.sql import functions as F

    from corpuscope.operators import repository
    from corpuscope.operators.cut import cut

    rows = [("a b.py", "def test_x():\n    pass\nclass K:\n    pass\n"), ("a b.py", "def go():\n    pass\n"), ("c.py", None), ("d.py", "def test_y():\n    pass\ndef f():\n    pass\n")]
    parsed = lambda r: cut(repository.parsed(spark.createDataFrame(r, "path string, text string"), "python", "py").drop("text"), "parsed")
    got = {(r.source, r.target) for r in repository.graph(parsed(rows), "shop")[1].where("type = 'TESTS'").collect()}
    assert got == {("a-b.py-test-test_x", "a-b.py-K"), ("a-b.py-test-test_x", "a-b.py-go"), ("d.py-test-test_y", "d.py-f"), ("d.py-test-f", "d.py-test_y")}
    links = repository.graph(parsed(rows[1:]), "shop")[1]
    assert links.where((F.col("source") == "shop") & (F.col("target") == "c.py")).count() == 1
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "size(" not in plan


def test_shards_are_packed_without_python_numbers():
    """A batch of 40 shards; as lists of Python's numbers it took 20 MB and more."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from corpuscope.operators import token_stream

    tokens = np.arange(40 * 65_536, dtype=np.int32) % 65_536
    lists = pa.ListArray.from_arrays(pa.array(np.arange(41, dtype=np.int32) * 65_536), pa.array(tokens))
    batch = pa.RecordBatch.from_arrays([pa.array(["train"] * 40), pa.array(range(40)), lists], ["part", "shard", "tokens"])
    tracemalloc.start()
    for k, out in enumerate(token_stream._packed(iter([batch.slice(3)]))):
        assert out.column(1).to_pylist() == [k + 3] and out.column(2)[0].as_py() == tokens[(k + 3) * 65_536 : (k + 4) * 65_536].astype("<u2").tobytes()
    assert k == 36 and tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()


def test_retrieval_finds_the_tokens_of_a_text_once(spark):
    """A filter on the size of the tokens, which Spark adds to an inner generator, found them again."""
    from corpuscope.operators import dense, ranking

    df = spark.createDataFrame([(1, "ab ab cd x"), (2, None), (3, ""), (4, "x")], "id long, t string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    post = ranking.postings(df, "id", "t")
    assert plan(post).count("regexp_extract_all") == 1
    assert sorted(tuple(r[c] for c in ("doc", "term", "tf", "length")) for r in post.collect()) == [(1, "ab", 2, 3), (1, "cd", 1, 3)]
    vectors = dense.hashed_vectors(df, "id", "t")
    assert plan(vectors).count("regexp_extract_all") == 1
    assert sorted((r.id, len(r.idx)) for r in vectors.collect()) == [(1, 2), (2, 0), (3, 0), (4, 0)]
