"""Tests and intervals from sums and chunks against those over arrays."""

import math

import numpy as np
import pytest

from auditlake.operators import stats


def metrics():
    rng = np.random.default_rng(12)
    out = {"two": (np.array([1.0, 2.0]), np.array([2.0, 2.5])), "same": (np.arange(5.0), np.arange(5.0)), "three": (np.zeros(3), np.array([1.0, 2.0, 4.0]))}
    for n in (4, 5, 8, 30, 200):
        b = rng.normal(0, 1, n)
        out[f"normal{n}"] = (b, b + rng.normal(0.3, 1, n))
        out[f"skewed{n}"] = (b, b + rng.exponential(1, n) ** 3)
    b = rng.integers(0, 4, 80).astype(float)
    out["ties"] = (b, b + rng.integers(-1, 9, 80) ** 2)
    out["constant"] = (np.zeros(6), np.ones(6))
    return out


def frame(spark, data):
    return spark.createDataFrame([(m, k, float(x), float(y)) for m, (b, c) in data.items() for k, (x, y) in enumerate(zip(b, c))], "metric string, key int, b double, c double").repartition(4)


@pytest.mark.parametrize("chunk", [1 << 16, 60])
def test_paired_tests_as_over_arrays(spark, monkeypatch, chunk):
    monkeypatch.setattr(stats, "CHUNK", chunk)
    data = metrics() if chunk > 60 else {k: v for k, v in metrics().items() if k in ("skewed200", "ties", "normal8")}
    got = {r["metric"]: r for r in stats.paired_tests(frame(spark, data)).collect()}
    assert sorted(got) == sorted(data)
    kinds = set()
    for m, (b, c) in data.items():
        want = stats.paired_test(b, c)
        kinds.add(want["test"])
        for name, value in want.items():
            found = got[m][name]
            if isinstance(value, float) and math.isfinite(value):
                assert found == pytest.approx(value, rel=1e-7, abs=1e-9), (m, name)
            else:
                assert found == value or value is None and found is None, (m, name)
    assert chunk == 60 or len(kinds) == 4


def test_hodges_lehmann_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(stats, "CHUNK", 40)
    rng = np.random.default_rng(13)
    data = {"a": rng.normal(0, 1, 150), "b": rng.integers(-3, 4, 130).astype(float), "c": rng.normal(0, 1, 20), None: rng.exponential(1, 90)}
    rows = [(k, float(x)) for k, values in data.items() for x in values]
    got = {r["k"]: r for r in stats.hodges_lehmann_by(spark.createDataFrame(rows, "k string, d double"), "k", "d").collect()}
    for k, values in data.items():
        assert (got[k]["centre"], got[k]["low"], got[k]["high"]) == pytest.approx(stats.hodges_lehmann(values), abs=1e-12) and got[k]["pairs"] == len(values)
