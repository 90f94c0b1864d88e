"""Spectral positions of components that a task iterates in memory, against those that joins iterate."""

import numpy as np
import pytest

from tessera.functions import paths


def test_components_in_memory_equal_those_by_joins(spark, monkeypatch):
    monkeypatch.setattr(paths, "DENSE", 10)
    rng = np.random.default_rng(2)
    grid = [(100 + 7 * x + y, 100 + 7 * u + v) for x in range(8) for y in range(7) for u, v in ((x + 1, y), (x, y + 1)) if u < 8 and v < 7 and rng.random() < 0.95]
    edges = spark.createDataFrame([*grid, *((i, (i + 1) % 30) for i in range(30)), (3, 11), (500, 501)], "a long, b long").coalesce(1)
    made = []
    rounds = paths._iterated
    monkeypatch.setattr(paths, "_iterated", lambda *a: made.append(1) or rounds(*a))
    held = {r["node"]: r for r in paths.spectral(edges, dims=3, tolerance=1e-6).collect()}
    assert not made and max(r["residual"] for r in held.values()) < 1e-6
    monkeypatch.setattr(paths, "HELD_NODES", 40)  # the grid goes by joins, the ring in memory
    other = {r["node"]: r for r in paths.spectral(edges, dims=3, tolerance=1e-6).collect()}
    assert made and held.keys() == other.keys()
    for k, r in held.items():
        assert r["component"] == other[k]["component"] and r["v"] == pytest.approx(other[k]["v"], abs=1e-5)
