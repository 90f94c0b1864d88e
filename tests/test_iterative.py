"""Iterative operators and models against direct computation on small tables."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import boosting, methods, models, paths, pvalues
from tessera.functions.neighbours import nearest


def points(spark, n=120, areas=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, int(i % areas), *map(float, rng.random(2)), float(rng.random())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "point_id long, area_id int, x double, y double, truth double")


def brute(rows, other, k, group, same):
    out = {}
    for i, g, x, y, _ in rows:
        near = sorted(((x - b) ** 2 + (y - c) ** 2, j) for j, h, b, c, _ in other if (not group or g == h) and not (same and i == j))
        out[i] = [j for _, j in near[:k]]
    return out


@pytest.mark.parametrize("group", [None, "area_id"])
def test_nearest_equals_all_pairs(spark, group):
    rows, df = points(spark)
    # a dense clump, one point far away, equal points and an area of two points force the wider passes
    rng = np.random.default_rng(2)
    rows += [(200 + i, 0, 0.5 + 1e-4 * float(rng.random()), 0.5, 0.0) for i in range(60)] + [(300, 0, 9.0, 9.0, 0.0), (301, 1, 0.25, 0.25, 0.0), (302, 1, 0.25, 0.25, 0.0), (303, 7, 0.1, 0.2, 0.0), (304, 7, 0.9, 0.2, 0.0)]
    df = spark.createDataFrame(rows, df.schema)
    got = {}
    for r in nearest(df, df, 5, "point_id", "point_id", group, same=True).orderBy("src", "nth").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == {i: js for i, js in brute(rows, rows, 5, group, True).items() if js}


def test_shortest_paths_equal_dijkstra(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1, 50.0) for i in range(30)] + [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 31, 20), rng.integers(0, 31, 20), rng.integers(60, 900, 20), strict=True)]
    edges += [(b, a, w) for a, b, w in edges]
    want = {}
    for s in (0, 7):
        heap, seen = [(0.0, s)], {}
        while heap:
            d, v = heapq.heappop(heap)
            if v in seen or d > 1200:
                continue
            seen[v] = d
            for a, b, w in edges:
                if a == v:
                    heapq.heappush(heap, (d + w, b))
        want |= {(s, v): d for v, d in seen.items()}
    got = paths.shortest_paths(spark.createDataFrame(edges, "src long, dst long, length double"), spark.createDataFrame([(0,), (7,)], "src long"), 1200.0).collect()
    assert {(r["src"], r["node"]): r["cost"] for r in got} == want


def test_pycnophylactic_equals_numpy_and_keeps_the_mean(spark):
    rows, df = points(spark, 60)
    rows.append((99, 9, 0.5, 0.5, 0.1))
    df = spark.createDataFrame(rows, df.schema)
    target = {0: 0.2, 1: 0.6, 2: 0.9, 9: 0.4}
    seed = df.select("point_id", "area_id", F.create_map(*(F.lit(v) for kv in target.items() for v in kv))[F.col("area_id")].alias("t"), F.col("truth").alias("v"))
    edges = nearest(df, df, 4, "point_id", "point_id", "area_id", same=True)
    got = {r["point_id"]: r["value"] for r in paths.pycnophylactic(seed, edges, 12).collect()}
    near, value, area = brute(rows, rows, 4, "g", True), {r[0]: r[4] for r in rows}, {r[0]: r[1] for r in rows}

    def centred(v):
        mean = {a: np.mean([x for i, x in v.items() if area[i] == a]) for a in target}
        return {i: x + target[area[i]] - mean[area[i]] for i, x in v.items()}

    for _ in range(12):
        value = centred({i: np.mean([value[j] for j in near[i]]) if near[i] else value[i] for i in value})
    clip = lambda v: {i: min(max(x, 0), 1) for i, x in v.items()}
    want = clip(centred(clip(value)))
    assert max(abs(got[i] - want[i]) for i in want if i != 99) < 1e-9 and got[99] == 0.4
    assert all(abs(np.mean([v for i, v in got.items() if area[i] == a]) - t) < 1e-9 for a, t in target.items())


def test_thinning_keeps_the_first(spark):
    rows, df = points(spark, 150)
    kept = []
    for i, _, x, y, _ in rows:
        if all((x - a) ** 2 + (y - b) ** 2 > 0.01 for _, a, b in kept):
            kept.append((i, x, y))
    assert sorted(r["point_id"] for r in paths.thinned(df, 0.1).collect()) == [k[0] for k in kept]


def test_rewiring_keeps_degrees(spark):
    _, df = points(spark)
    edges = nearest(df, df, 4, "point_id", "point_id", same=True).select("src", "dst")
    before = {tuple(r) for r in edges.select(F.least("src", "dst"), F.greatest("src", "dst")).collect()}
    after = [tuple(r) for r in paths.rewired(edges, 4).collect()]
    degree = lambda es: sorted(np.bincount([v for e in es for v in e], minlength=120).tolist())
    assert len(set(after)) == len(after) == len(before) and all(a < b for a, b in after) and degree(after) == degree(before) and set(after) != before


@pytest.mark.parametrize("dense", [1500, 10])
def test_spectral_vectors_are_eigenvectors(spark, monkeypatch, dense):
    """By dense matrices and by iteration: small residuals, the smallest eigenvalues, components apart."""
    monkeypatch.setattr(paths, "DENSE", dense)
    rng = np.random.default_rng(4)
    ring = [(i, (i + 1) % 40) for i in range(40)] + [(0, 7), (3, 20)]
    grid = [(100 + 9 * x + y, 100 + 9 * u + v) for x in range(9) for y in range(9) for u, v in ((x + 1, y), (x, y + 1)) if u < 9 and v < 9 and rng.random() < 0.9]
    edges = [(min(e), max(e)) for e in [*ring, *grid, (500, 501), (600, 600)]]
    rows = paths.spectral(spark.createDataFrame(edges, "a long, b long"), dims=3, tolerance=1e-4).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["component"], {})[r["node"]] = r["v"]
    assert {0, 500} <= set(parts) and parts[0].keys() == set(range(40)) and parts[500].keys() == {500, 501} and max(r["residual"] for r in rows) < 1e-4
    for nodes in parts.values():
        ids = sorted(nodes)
        block = np.array([nodes[i] for i in ids])
        lap = np.zeros((len(ids), len(ids)))
        for a, b in {e for e in edges if e[0] in nodes and e[0] != e[1]}:
            lap[ids.index(a), ids.index(b)] = lap[ids.index(b), ids.index(a)] = 1
        d = lap.sum(1)
        lap = np.eye(len(ids)) - lap / np.sqrt(np.outer(d, d))
        values = np.linalg.eigh(lap)[0][1:4]
        k = len(values)
        assert np.allclose(block[:, :k].T @ block[:, :k], np.eye(k), atol=1e-6) and np.allclose(np.diag(block[:, :k].T @ lap @ block[:, :k]), values, atol=1e-5)
        assert np.abs(lap @ block[:, :k] - block[:, :k] * values).max() < 1e-3


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 101), (7, 3)]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a long, b long")
    got = {r["node"]: r["component"] for r in paths.connected(both).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 101: 90}


def test_p_values():
    assert abs(pvalues.two_sided_t(2.0, 10) - 0.0733880) < 1e-6 and abs(pvalues.two_sided_t(1.0, 1) - 0.5) < 1e-9
    assert abs(pvalues.pearson(0.5, 20) - 0.0247687) < 1e-5 and pvalues.pearson(0.3, 2) is None
    assert pvalues.sign(8, 10) == pytest.approx(2 * (45 + 10 + 1) / 1024) and pvalues.sign(0, 0) is None
    ways = sum(sum(i for i in range(1, 9) if m >> (i - 1) & 1) <= 5 for m in range(256))
    assert pvalues.wilcoxon(5, 8, 0) == pytest.approx(2 * ways / 256)
    assert pvalues.wilcoxon(500, 60, 0) == pytest.approx(math.erfc((915 - 500) / math.sqrt(60 * 61 * 121 / 24) / math.sqrt(2)))


def test_boosted_trees_learn_and_hold_out(spark):
    rng = np.random.default_rng(3)
    x = rng.random((600, 3))
    y = np.where(x[:, 0] > 0.5, 1.0, 0.0) + 0.5 * x[:, 1]
    rows = [(i, i % 2, *map(float, x[i]), float(y[i])) for i in range(600)] + [(1000 + i, 5, 0.1, 0.1, 0.1, 0.1) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, g int, a double, b double, c double, y double")
    got = {r["k"]: r["predicted"] for r in boosting.out_of_fold(df, ["a", "b", "c"], "y", "g", "k", rounds=100).collect()}
    assert set(got) == set(range(600)) and np.corrcoef([got[i] for i in range(600)], y)[0, 1] > 0.97
    noise = df.withColumn("y", F.rand(1))
    score = lambda folds: noise.join(boosting.out_of_fold(noise, ["a", "b", "c"], "y", "g", "k", rounds=60, folds=folds), "k").agg(F.corr("predicted", "y")).first()[0]
    assert score(1) > 0.4 > 0.25 > abs(score(5))


def test_guided_allocation_keeps_targets_and_reads_no_truth(spark):
    rows, df = points(spark)
    areas = spark.createDataFrame([(0, 0.3), (1, 0.5), (2, 0.8)], "area_id int, target double")
    got = models.guided(df.drop("truth"), areas, ["x", "y"]).groupBy("area_id").agg(F.avg("value").alias("m")).collect()
    assert {r["area_id"]: round(r["m"], 9) for r in got} == {0: 0.3, 1: 0.5, 2: 0.8}


def test_methods_can_be_added_and_switched(spark):
    rows, df = points(spark)
    df = df.withColumn("ancillary", F.col("truth") * 50)
    areas = spark.createDataFrame([(0, 1, 0.3, 40, 0.0, 0.0), (1, 1, 0.5, 40, 1.0, 0.0), (2, 1, 0.8, 40, 0.0, 1.0)], "area_id int, county_id int, target double, n_points long, minx double, miny double")
    methods.add_method("half", lambda p, a: p.select("point_id", F.lit(0.5).alias("value")))
    try:
        out = {r["method"]: r for r in methods.compare(df.withColumn("subarea_id", F.col("area_id") * 10), areas, ("half", "uniform", "kriging")).collect()}
        assert out["uniform"]["gap"] < 1e-9 and out["kriging"]["gap"] < 1e-6 and abs(out["half"]["gap"] - (0.2 + 0 + 0.3) / 3) < 1e-9
        value = methods.Settings(method="half", correction="clip", areas=(0, 2)).run(df, areas).groupBy("area_id").agg(F.avg("value").alias("m")).collect()
        assert {r["area_id"]: round(r["m"], 6) for r in value} == {0: 0.3, 2: 0.8}
        with pytest.raises(ValueError):
            methods.Settings(method="none of these").run(df, areas)
    finally:
        methods.METHODS.pop("half")


def test_uncorrelated_features(spark):
    pairs = spark.createDataFrame([("a", "b", 0.995), ("b", "c", -0.999), ("c", "d", 0.2)], "f1 string, f2 string, r double")
    assert models.uncorrelated(pairs, [("a", 1), ("b", 1), ("c", 1), ("d", 1)]) == ["a", "c", "d"] and models.uncorrelated(pairs, [("a", 1), ("b", 0), ("c", 1), ("d", 1)]) == ["b", "d"]
