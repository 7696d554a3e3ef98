"""Queries that SQL can't express, against plain Python."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import candidates, structured
from corpuscope.plans import texts

SF = "/root/testdata/sf0.001"


def test_line_changes(spark):
    pairs = [("a\nb\nc", "a\nc\nd"), (None, "x\ny"), ("same", "same"), ("", ""), ("a\nb\n" * 30, "b\na\n" * 30), ("--x\n+y", "y")]
    got = [r.n for r in spark.createDataFrame(pairs, "a string, b string").select(candidates.line_changes("a", "b").alias("n")).collect()]
    want = []
    for a, b in pairs:
        lines = list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm=""))
        want.append(sum(x.startswith(("+", "-")) for x in lines if not x.startswith(("+++", "---", "@@"))))
    assert got == want


def draw(seed, name, n):
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:8], 16) % n


def spelled(code, pattern, at, new):
    """The match number `at` of a pattern, spelled anew."""
    m = list(re.finditer(pattern, code, re.DOTALL))[at]
    return code[: m.start()] + new(m) + code[m.end() :]


def mistaken(code, operator, seed):
    """One mistake, by rules of this test's own."""
    count = lambda pattern: len(re.findall(pattern, code, re.DOTALL))
    numbers, operands = r"\b\d{1,18}\b", ["+", "-", "*", "/", "%", " and ", " or "]
    constant = spelled(code, numbers, draw(seed, "constant:place", count(numbers)), lambda m: str(int(m[0]) + [1, -1, 2, -2][draw(seed, "constant:shift", 4)])) if count(numbers) else code
    out = code
    if operator == "off-by-one":
        kind = [p for p in (r"(\brange\()(\d+)(\))", r"(\brange\(\d+,\s*)(\d+)(\))", r"(\b\[\s*:\s*)(\d+)(\s*\])") if count(p)]
        out = spelled(code, kind[0], 0, lambda m: f"{m[1]}{int(m[2]) + 1}{m[3]}") if kind else constant
    elif operator == "comparison-reversal" and count(p := "[=!<>]=|[<>]"):
        out = spelled(code, p, draw(seed, "comparison:place", count(p)), lambda m: {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}[m[0]])
    elif operator == "wrong-operand" and count(p := r"[-+*/%]| and | or "):
        out = spelled(code, p, draw(seed, "operand:place", count(p)), lambda m: operands[(operands.index(m[0]) + 1 + draw(seed, "operand:step", 6)) % 7])
    elif operator == "null-check-removal":
        kind = [p for p in (r"\s*if\s+\w+\s+is\s+not\s+None:\s*\n.*?\n\s*", r"\s*if\s+not\s+\w+:\s*\n.*?\n\s*raise") if count(p)]
        out = spelled(code, kind[0], 0, lambda m: "\n" * m[0].count("\n") + "    pass\n") if kind else code
    return constant if out == code else out


@pytest.mark.parametrize("operator", list(candidates.DRAWN))
def test_mutations(spark, operator):
    programs = [p.replace("{0}", "37").replace("{1}", "5") for p in texts._PROGRAMS] + ["pass", "", "a = b[ : 7 ]\n", "x!=1 and 99999999999999999999 <= y", None]
    rows = [(n, p) for n in range(20) for p in programs]
    df = spark.createDataFrame(rows, "n long, code string")
    got = df.select("n", "code", candidates.mutated(F.col("code"), operator, F.col("n")).alias("bad")).collect()
    assert [r.bad for r in got] == [None if p is None else mistaken(p, operator, n) for n, p in rows]


def test_mutations_by_hand(spark):
    made = lambda code, op: spark.createDataFrame([(1, code)], "n long, code string").select(candidates.mutated(F.col("code"), op, F.col("n"))).first()[0]
    assert made("for i in range(10):\n    pass\n", "off-by-one") == "for i in range(11):\n    pass\n"
    assert made("range(2,  99)", "off-by-one") == "range(2,  100)"
    assert made("a < b", "comparison-reversal") == "a >= b"
    assert made("a == b", "comparison-reversal") == "a != b"
    assert made("def h(a):\n    if a is not None:\n        b = a\n    return b\n", "null-check-removal") == "def h(a):\n\n\n    pass\nreturn b\n"
    assert made("def f(x):\n    if not x:\n        raise V\n    return x\n", "null-check-removal") == "def f(x):\n    if not x:\n        raise V\n    return x\n"
    assert made("def f(x):\n    if not x:\n        log()\n        raise V\n", "null-check-removal") == "def f(x):\n\n\n    pass\n V\n"
    assert made("7", "changed-constant") in ("6", "8", "9", "5") and made("none", "changed-constant") == "none"
    assert made("a + b", "wrong-operand") in [f"a {o.strip()} b" for o in "-*/%"] + ["a  and  b", "a  or  b"]
    assert made("int(x)", "wrong-type-conversion") == "float(x)" and made("import os", "broken-import") == "import _missing_os"
    assert made("def f():\n    return 1\n", "dead-code") == "def f():\n    if True:\n        pass  # unreachable\n    return 1"


def test_checksums(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in texts.text_checksums(spark, SF).collect())


def test_stream_dedup(spark, tmp_path):
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    base = " ".join(words * 2)
    rows = [(1, base), (2, base), (3, base + " extra"), (4, " ".join(words[::-1][:5])), (5, ""), (6, None), (7, "completely other words here"), (8, base + " extra"), (9, base + " more")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def signature(text):
        found = {w for w in re.findall("[A-Za-z0-9_]+", (text or "").lower())}
        return tuple(min(int(hashlib.sha256(f"7:{2 * i + 1}:{2 * i + 2}:{w}".encode()).hexdigest()[:8], 16) for w in found) if found else -1 for i in range(128))

    want, seen, bands = {}, set(), set()
    for d, t in rows:
        if (t or "") in seen:
            want[d] = "exact copy"
            continue
        seen.add(t or "")
        s = signature(t)
        mine = {(b, s[b * 8 : b * 8 + 8]) for b in range(16)}
        want[d] = "near copy" if mine & bands else "kept"
        if want[d] == "kept":
            bands |= mine
    assert {r.doc_id: r.verdict for r in texts.stream_dedup(spark, str(tmp_path)).collect()} == want


def test_embedded_json(spark):
    said = ['x {"a": [1, 2]} y "s" 3 {bad} null', "none", None, '{"a": {"b": {}}} tail', "```json\n{\"k\": 1}\n``` {\"z\": 2}", "```{bad}``` {\"z\": 2}"]
    got = [r.v for r in spark.createDataFrame([(s,) for s in said], "s string").select(structured.embedded_json(F.col("s")).alias("v")).collect()]
    decoder = json.JSONDecoder()

    def scan(text):
        out, at = [], 0
        while at < len(text):
            try:
                value, at = decoder.raw_decode(text, at)
                out.append(value)
            except json.JSONDecodeError:
                at += 1
        return out

    assert [None if v is None else [json.loads(x) for x in v] for v in got] == [scan(said[0]), [], None, scan(said[3]), [{"k": 1}], []]


def test_retargeted_patch(spark):
    diff = "diff --git a/x/a.py b/x/a.py\n--- a/x/a.py\n+++ b/x/a.py\n@@ -1 +1 @@\n-a\n+b"
    row = spark.createDataFrame([(diff,)], "d string").select(candidates.retargeted(F.col("d"), F.lit("src/a.py")).alias("d"), candidates.target_fault(F.col("d"), F.array(F.lit("src/a.py"))).alias("f")).first()
    assert row.d == "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -1 +1 @@\n-a\n+b" and row.f is None


def test_bad_lines_do_not_stop_a_stream(spark, tmp_path):
    from corpuscope.streaming import telemetry

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"step": 1, "loss": 0.5}\n\n{broken\n{"step": 2}\n')
    stream = telemetry.parsed_lines(spark.readStream.text(str(tmp_path / "in")), "step int, loss double")
    job = stream.writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    job.awaitTermination()
    got = sorted(map(tuple, spark.table("lines").collect()), key=repr)
    batch = sorted(map(tuple, telemetry.parsed_lines(spark.read.text(str(tmp_path / "in")), "step int, loss double").collect()), key=repr)
    assert got == batch == sorted([(1, 0.5, None), (2, None, None), (None, None, "bad line: {broken")], key=repr)
