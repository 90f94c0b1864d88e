"""Percentiles by refining histograms and sums over ordered pairs, against numpy."""

import numpy as np
import pytest

from tessera.functions import pairs, quantiles


@pytest.mark.parametrize("cells", [2, 1024])
def test_percentiles_equal_numpy(spark, monkeypatch, cells):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    rng = np.random.default_rng(1)
    groups = {"even": rng.random(500), "skewed": np.exp(rng.normal(0, 12, 300)) * rng.choice([-1, 1], 300), "ties": np.repeat([1.0, 2.0, 3.0], [200, 1, 99]), "one": np.array([5.0]), "two": np.array([-1.0, 4.0])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("even", None), ("none", None), ("ties", float("nan")), (None, 7.0)]
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 2 / 3, "e": 1.0}
    got = {r["g"]: tuple(r)[1:] for r in quantiles.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(4), wanted).collect()}
    assert set(got) == {*groups, None} and got[None] == (7.0,) * 5
    for g, v in groups.items():
        assert np.allclose(got[g], np.quantile(v, list(wanted.values())), rtol=1e-12, atol=0)


def test_no_rows(spark):
    assert quantiles.percentiles(spark.createDataFrame([], "g int, v double"), {"m": 0.5}).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 200])
@pytest.mark.parametrize("steps", [4, 10_000])
def test_ordered_pairs_equal_all_pairs(n, steps):
    rng = np.random.default_rng(n + steps)
    t, v = rng.integers(0, steps, n) / steps, rng.integers(0, steps, n) / steps
    got = pairs.ordered_sums(t, v, 0.3, 0.02)
    met = [(a, b) for a in range(n) for b in range(n) if t[b] - t[a] >= 0.3]
    assert got[:2] == (len(met), sum(v[b] > v[a] for a, b in met))
    assert abs(got[2] - sum(max(0.0, 0.02 - (v[b] - v[a])) for a, b in met)) < 1e-9 * max(1, n)


def test_ordered_pairs_by_group(spark):
    rows = [("m", 1, 0.1, 0.2), ("m", 1, 0.5, 0.1), ("m", 1, None, 0.9), ("m", 2, 0.1, 0.2), ("m", 2, 0.2, 0.1)]
    got = [tuple(r) for r in pairs.ordered(spark.createDataFrame(rows, "method string, g int, truth double, value double"), ["method", "g"], 0.3, 0.02).collect()]
    assert got == [("m", 1, 1, 0, pytest.approx(0.12))]
