"""Operators over source files and claims against hand-written and brute-force results."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpuscope.functions import code
from corpuscope.plans.code import hallucination_audit

SF = "/root/testdata/sf0.001"


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_imports(spark):
    assert one(spark, "import a.b\n  from c import d\nx = 1", lambda t: code.imports(t, "py")) == ["a.b", "c"]
    assert one(spark, "package p\nimport q", lambda t: code.imports(t, "go")) == ["p", "q"]
    assert one(spark, "use std::io;\n", lambda t: code.imports(t, "rs")) == ["std::io"]
    assert one(spark, "import a", lambda t: code.imports(t, "txt")) == []


def test_symbols_start_at_the_blank_lines_before_them(spark):
    text = "x = 1\n\n\ndef f(a):\n    pass\nclass C:\n    def g(self) -> int:\n        pass\n"
    got = [tuple(s) for s in one(spark, text, lambda t: code.symbols(t, "python"))]
    want = []
    for kind, p in code.SYMBOLS["python"].items():
        want += [(kind, m.group(1), text.count("\n", 0, m.start()) + 1, m.group(0).strip()) for m in re.finditer(p, text)]
    assert got == want and [w[2] for w in want] == [2, 7, 6]


def test_patches(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n+c\n"
    assert one(spark, diff, code.changed_lines) == 3 and one(spark, diff, code.patch_size) == 2 and one(spark, diff, code.diff_paths) == ["x.py"]
    assert one(spark, None, code.patch_size) == 10**9
    assert [one(spark, p, code.unsafe_path) for p in ("/a", "c:/a", "a/../b", "a/.git/b", "a/b..c")] == [True, True, True, True, False]


def test_claims(spark):
    assert one(spark, "see `src/a.py` and b.go, src/a.py", code.file_claims) == ["src/a.py", "b.go"]
    assert [tuple(c) for c in one(spark, "I ran the tests\nI executed magic", code.tool_claims)] == [("I ran the tests", True), ("I executed magic", False)]
    assert [tuple(c) for c in one(spark, "a.py imports b.py. a.py imports b.py", code.relation_claims)] == [("a.py", "b.py")]


def test_hallucination_audit_equals_brute_force(spark):
    known = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in re.findall("[A-Za-z0-9_]+", r.text or "")}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        names = {m.group(1) for m in re.finditer(code.SYMBOL_CLAIM.replace("(?U)", ""), r.text or "")}
        names = {n for n in names if len(n) >= 3 and n not in code.NOT_SYMBOLS and (re.search("[A-Z_]", n) or len(n) >= 10)}
        if names:
            want[r.doc_id] = (len(names), len(names - known))
    assert {r.doc_id: (r.claims, r.unsupported) for r in hallucination_audit(spark, SF).collect()} == want
