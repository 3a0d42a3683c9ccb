"""Exact quantiles against NumPy, with small brackets so that several steps are needed."""

import numpy as np
import pytest

from skirmish.operators import quantiles


@pytest.mark.parametrize("few,accuracy", [(50_000, 10_000), (20, 50)])
def test_quantiles_are_those_of_numpy(spark, monkeypatch, few, accuracy):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(2)
    n = 5_000
    cols = {"a": rng.normal(size=n), "b": np.exp(rng.normal(size=n) * 20), "c": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 5, n)), "d": rng.normal(size=n)}
    cols["d"][rng.random(n) < 0.3] = np.nan
    rows = [(*[float(v[i]) for v in cols.values()], None) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    q = [0.0, 0.025, 0.5, 0.731, 0.95, 1.0]
    got = quantiles.quantiles(df, {c: q for c in "abcde"})
    for c, v in cols.items():
        want = np.quantile(v[~np.isnan(v)], q)
        assert [got[c, x] for x in q] == pytest.approx(list(want), rel=1e-12), c
    assert all(got["e", x] is None for x in q)


def test_small_columns(spark):
    df = spark.createDataFrame([(1, 3.0), (2, None), (4, None)], "n int, x double")
    assert quantiles.medians(df, ["n", "x"]) == {"n": 2.0, "x": 3.0}
    assert quantiles.medians(df.limit(0), ["n"]) == {"n": None} and quantiles.medians(df, []) == {}
    assert quantiles.quantiles(df, {"n": [0.25]}) == {("n", 0.25): 1.5}
