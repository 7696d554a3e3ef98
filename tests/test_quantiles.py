"""Exact percentiles against numpy, in groups below and above the size that is bracketed."""

from __future__ import annotations

import numpy as np
import pytest

from corpuscope.operators import quantiles


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_percentiles(spark, accuracy, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(4)
    groups = {"normal": rng.standard_normal(5000), "ties": rng.integers(0, 5, 4000).astype(float), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), None: rng.exponential(1, 700), "same": np.full(3000, 7.0), "skewed": np.concatenate([np.zeros(2990), np.arange(1, 11) * 1e6])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("normal", None), ("none", None)]
    shares = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    got = {r["g"]: r for r in quantiles.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g]["n"] == len(vs)
        assert [got[g][k] for k in shares] == pytest.approx([float(np.quantile(vs, s)) for s in shares.values()], rel=1e-12), g
