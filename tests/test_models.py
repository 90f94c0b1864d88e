"""Models against direct computation on small tables."""

import heapq
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import methods, models, paths, pvalues, switches
from tessera.plans import catalog
from tessera.sources import sinks
from tessera.functions.queries import QUERIES


#: Their functions are tested in test_iterative; areas of the smallest table have fewer rows than boosting asks for.
ELSEWHERE = ("sta_13_rank_consistency_p", "mlr_02_boosted_out_of_fold", "mlr_04_redundancy_filter", "mlr_06_leakage_audit", "grf_06_road_knn", "grf_10_rewired", "grf_13_spectral", "dis_04_pycnophylactic")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ELSEWHERE)))
def test_has_rows(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_ridge_leaves_each_row_out(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, *map(float, rng.normal(size=2)), float(rng.normal())) for i in range(40)]
    got = {r["k"]: r for r in models.ridge_leave_one_out(spark.createDataFrame(rows, "k long, g int, a double, b double, y double"), ["a", "b"], "y", "g", "k").collect()}
    for g in (0, 1):
        own = np.array([r for r in rows if r[1] == g])
        x = np.column_stack([np.ones(len(own)), (own[:, 2:4] - own[:, 2:4].mean(0)) / own[:, 2:4].std(0)])
        y = own[:, 4]
        alpha = got[int(own[0, 0])]["alpha"]
        penalty = alpha * np.diag([1e-9, 1, 1])
        for i in range(len(own)):
            keep = np.arange(len(own)) != i
            beta = np.linalg.solve(x[keep].T @ x[keep] + penalty, x[keep].T @ y[keep])
            assert abs(x[i] @ beta - got[int(own[i, 0])]["predicted"]) < 1e-6


def roads():
    """A lattice of 8 x 8 nodes with uneven lengths, as (src, dst, length) in both directions."""
    rng = np.random.default_rng(8)
    edges = [(8 * x + y, 8 * u + v, float(rng.integers(80, 400))) for x in range(8) for y in range(8) for u, v in ((x + 1, y), (x, y + 1)) if u < 8 and v < 8]
    return edges + [(b, a, w) for a, b, w in edges]


def reached(edges, source):
    heap, seen = [(0.0, source)], {}
    while heap:
        d, v = heapq.heappop(heap)
        if v not in seen:
            seen[v] = d
            for a, b, w in edges:
                if a == v:
                    heapq.heappush(heap, (d + w, b))
    return seen


def snapped_points(n=60):
    rng = np.random.default_rng(9)
    return [(i, 0, float(x), float(y), None if i % 11 == 0 else int(rng.integers(0, 64))) for i, (x, y) in enumerate(rng.random((n, 2)))]


@pytest.mark.parametrize("k", [2, 7])
def test_road_neighbours_equal_brute_force(spark, k):
    edges, rows = roads(), snapped_points()
    cost = {s: reached(edges, s) for s in range(64)}
    points = spark.createDataFrame([r[:4] for r in rows], "point_id long, area_id int, x double, y double")
    snapped = spark.createDataFrame([(r[0], r[4]) for r in rows], "point_id long, node long")
    got = {}
    for r in paths.road_knn(points, snapped, spark.createDataFrame(edges, "src long, dst long, length double"), k, 1000.0).orderBy("src", "nth").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    dist = lambda a, b: math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)
    near = {a[0]: sorted((dist(a, b), b[0]) for b in rows if b[0] != a[0])[: 3 * k] for a in rows}
    cutoff = max(500.0, 5000 * max(x[-1][0] for x in near.values()))
    for a in rows:
        ranked = []
        for d, j in near[a[0]]:
            b = rows[j]
            c = d * 1000 if a[4] is None or b[4] is None else cost[a[4]][b[4]]
            if a[4] is None or b[4] is None or c <= cutoff:
                ranked.append((c, d, j))
        assert got[a[0]] == [j for _, _, j in sorted(ranked)[:k]]


def test_network_edges_equal_brute_force(spark):
    from tessera.functions.neighbours import nearest

    edges, rows = roads(), [r for r in snapped_points() if r[4] is not None]
    cost = {s: reached(edges, s) for s in range(64)}
    points = spark.createDataFrame([r[:4] for r in rows], "point_id long, area_id int, x double, y double")
    snapped = spark.createDataFrame([(r[0], r[4]) for r in rows], "point_id long, node long")
    road = spark.createDataFrame(edges, "src long, dst long, length double")
    near = nearest(points, points, 12, "point_id", "point_id", "area_id", same=True)
    found = paths.network_edges(near, snapped, paths.shortest_paths(road, snapped.select(F.col("node").alias("src")), 1500.0), 4000.0).collect()
    want = {}
    for a in rows:
        close = sorted((math.hypot(a[2] - b[2], a[3] - b[3]), b[0], b[4]) for b in rows if b[0] != a[0])[:9]
        want |= {(a[0], j): 1 / (1 + cost[a[4]][m] / 500) for d, j, m in close if d * 4000 < 1000 and cost[a[4]][m] <= 1500}
    assert {(r["src"], r["dst"]) for r in found} == set(want) and all(abs(r["w"] - want[r["src"], r["dst"]]) < 1e-12 for r in found) and len(want) > 20


def test_kriging_equals_numpy(spark):
    rng = np.random.default_rng(2)
    areas = [(i, float(t), float(i % 3), float(i // 3)) for i, t in enumerate(rng.random(6))]
    rows = [(k, int(k % 6), float(k % 6 % 3 + u), float(k % 6 // 3 + v)) for k, (u, v) in enumerate(rng.random((60, 2)))]
    got = {r["point_id"]: r["value"] for r in methods.kriging(spark.createDataFrame(rows, "point_id long, area_id int, x double, y double"), spark.createDataFrame(areas, "area_id int, target double, minx double, miny double")).collect()}
    cx, cy, t = (np.array(v) for v in ([a[2] + 0.5 for a in areas], [a[3] + 0.5 for a in areas], [a[1] for a in areas]))
    gamma = lambda h: np.where(h > 0, 0.01 + 1 - np.exp(-3 * h), 0.0)
    system = np.ones((7, 7))
    system[:6, :6], system[6, 6] = gamma(np.hypot(cx[:, None] - cx, cy[:, None] - cy)), 0
    raw = {}
    for k, _, x, y in rows:
        weights = np.linalg.solve(system, np.append(gamma(np.hypot(cx - x, cy - y)), 1.0))[:6]
        raw[k] = float(weights @ t)
    mean = {a: np.mean([raw[r[0]] for r in rows if r[1] == a]) for a in range(6)}
    ratio = {k: got[k] / raw[k] for k in got}
    for a in range(6):  # each area is brought to its target, by shift or by scale
        own = [r[0] for r in rows if r[1] == a]
        assert abs(np.mean([got[k] for k in own]) - areas[a][1]) < 1e-6
        shift = {round(got[k] - raw[k], 6) for k in own if 0 < got[k] < 1}
        assert len(shift) == 1 or len({round(ratio[k] / (areas[a][1] / mean[a]), 6) for k in own}) == 1


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(200, 3))
    x = np.column_stack([base[:, 0], base[:, 0] * 0.7 + base[:, 1] * 0.3, base[:, 2], base[:, 1]])
    y = x[:, 0] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, d double, y double")
    got = models.principal_components(df, ["a", "b", "c", "d"], "y", 3).orderBy("component").collect()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    for k, r in enumerate(got):
        v = vectors[:, -1 - k]
        loads = np.array([r["loadings"][f] for f in "abcd"])
        assert abs(r["variance_ratio"] - values[-1 - k] / values.sum()) < 1e-9 and min(np.abs(loads - v).max(), np.abs(loads + v).max()) < 1e-6
        assert abs(abs(r["r"]) - abs(np.corrcoef(z @ v, y)[0, 1])) < 1e-6


@pytest.mark.parametrize(("n", "k"), [(8, 1), (25, 2), (200, 5)])
def test_clusters_split_the_variance(spark, n, k):
    rng = np.random.default_rng(n)
    rows = [(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(rng.random((n, 3)))]
    got = models.spatial_clusters(spark.createDataFrame(rows, "point_id long, x double, y double, v double"), "v").collect()
    assert len(got) == k and sum(r["n"] for r in got) == n
    total = np.var([r[3] for r in rows])
    assert all(abs(r["within"] + r["between"] - total) < 1e-9 for r in got) and abs(got[0]["within"] - sum(r["n"] * r["variance"] for r in got) / n) < 1e-9


def made_points(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        a, b, c = rng.random(3)
        rows.append((i, i % 3, float(a), float(b), float(c), float(2 * a + b * b + 0.01 * rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, "k long, g int, a double, b double, c double, y double, noise double")


def test_redundancy_and_leakage(spark):
    df = made_points(spark)
    found = {r["target"]: r for r in models.redundancy(df, ["y", "noise"], ["a", "b", "c", "noise"], "g", "k", rounds=60).collect()}
    assert not found["y"]["admissible"] and found["y"]["boosted"] > 0.9 and found["noise"]["admissible"]
    leak = models.leakage(df.withColumn("near", F.col("y") + 0.001 * F.col("noise")), ["a", "b", "c", "near"], "y", "g", "k", ["near", "c"], rounds=60).collect()
    assert len(leak) == 3 and all(r["adjacent_rank"] == 1 and r["r_in_sample"] > r["r_out_of_fold"] > 0.9 and r["r_leave_one_out"] > 0.99 for r in leak)


def test_importances_find_what_matters(spark):
    df = made_points(spark).withColumn("g", F.when(F.col("a") > 0.5, 1).otherwise(0))
    forest = models.forest_importance(df, ["a", "b", "c"], "y", trees=20).orderBy("place").collect()
    assert [r["feature"] for r in forest] == ["a", "b", "c"] and abs(sum(r["importance"] for r in forest) - 1) < 1e-9 and forest[0]["r2"] > 0.9
    moved = {r["feature"]: r for r in models.permutation_importance(df, ["a", "b", "c"], "y", "g", "k").collect()}
    assert moved["a"]["change"] > 5 * abs(moved["c"]["change"]) and moved["all"]["change"] > 0 and abs(sum(abs(moved[f]["share"]) for f in "abc") - 1) < 1e-9


def test_recovery_by_model(spark):
    got = {(r["target"], r["model"], r["g"]): r for r in models.recovery(made_points(spark), ["a", "b", "c"], ["y", "a"], "g", "k", rounds=60).collect()}
    assert len(got) == 12 and all(r["n"] == 80 for r in got.values())
    assert all(r["r"] > 0.8 if t == "y" else (r["r"] or 0) < 0.7 for (t, _, _), r in got.items())


def test_provenance_refuses_other_metrics(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1, 0.2), ("a", 0.3, 0.2), ("b", 0.5, 0.5)], "method string, value double, truth double")
    got = {r["method"]: (r["rows"], round(r["metric"], 9), r["expected"]) for r in sinks.predictions(df, str(tmp_path / "p"), rows=3, expected={"a": 0.1, "b": 0.004}).collect()}
    assert got == {"a": (2, 0.1, 0.1), "b": (1, 0.0, 0.004)}
    for wrong in ({"a": 0.106}, {"c": 0.1}):
        with pytest.raises(ValueError, match="differ"):
            sinks.predictions(df, str(tmp_path / "q"), expected=wrong)
    assert not (tmp_path / "q").exists()


def test_reproducibility_can_fail(spark):
    runs = [(42, 1, 0.5, 0.1, 1.0, 0.100), (1, 1, 0.503, 0.1, 1.5, 0.104), (2, 1, 0.51, 0.1, 2.5, 0.106), (42, 2, None, 0.1, 1.0, 0.0), (1, 2, 0.1, 0.1, 1.0, 0.0)]
    table = spark.createDataFrame(runs, "seed int, area_id int, r double, rmse double, gap_pct double, sd double")
    got = {(r[0], r[1]): tuple(r)[2:] for r in catalog.run(spark, "val_17_reproducibility", run=table).collect()}
    assert got == {(1, 1): (True, True, True), (2, 1): (False, False, False), (1, 2): (True, True, False)}


@pytest.mark.parametrize("areas", [1, 20, 40, 300])
def test_sign_test_for_any_number_of_areas(spark, areas):
    rows = [(i, f, 0.1 if i < areas * share else -0.2) for i in range(areas) for f, share in (("a", 0.3), ("b", 1.0))] + [(5000, "a", 0.0)]
    got = {r["feature"]: r for r in catalog.run(spark, "sta_14_sign_test", rho=spark.createDataFrame(rows, "area_id int, feature string, rho double")).collect()}
    for f, share in (("a", 0.3), ("b", 1.0)):
        pos = sum(i < areas * share for i in range(areas))
        want = min(1.0, 2 * sum(math.comb(areas, i) for i in range(min(pos, areas - pos) + 1)) / 2**areas)
        assert got[f]["pos"] == pos and abs(got[f]["p"] - want) < 1e-6


def test_one_sided_signed_ranks():
    sums = [sum(i for i in range(1, 9) if m >> (i - 1) & 1) for m in range(256)]
    for plus in (0, 5, 18, 36):
        assert pvalues.wilcoxon_less(plus, 8, 0) == pytest.approx(sum(s <= plus for s in sums) / 256)
        assert pvalues.wilcoxon_greater(plus, 8, 0) == pytest.approx(sum(s >= plus for s in sums) / 256)
    assert pvalues.wilcoxon_less(500, 60, 0) < 0.002 < pvalues.wilcoxon_greater(500, 60, 0)


def test_planar_and_road_neighbours_by_area(spark, sf):
    near = [(r["src"], r["dst"], r["area_id"]) for r in catalog.table(spark, sf, "SELECT src, dst, area_id FROM t_near WHERE nth <= 4").collect()]
    road = {(r["src"], r["dst"]) for r in QUERIES["grf_06_road_knn"](spark, sf).collect()}
    area, planar = {a: g for a, _, g in near}, {(a, b) for a, b, _ in near}
    each = {}
    for p in {a for a, _ in planar | road}:
        one, two = {b for a, b in planar if a == p}, {b for a, b in road if a == p}
        each.setdefault(area[p], []).append(len(one & two) / len(one | two))
    got = {r["area_id"]: r["jaccard"] for r in QUERIES["set_04_neighbour_jaccard"](spark, sf).collect()}
    assert got.keys() == each.keys() and all(abs(got[g] - np.mean(v)) < 1e-9 for g, v in each.items())


def test_rank_consistency_from_its_correlations(spark):
    rows = [(i, f, float(r)) for f, rs in (("a", [0.3, 0.2, 0.4, 0.15, 0.25, 0.35, 0.05]), ("b", [0.1, -0.2, 0.3, -0.4, 0.5]), ("few", [0.1, 0.2])) for i, r in enumerate(rs)]
    table = spark.createDataFrame(rows, "area_id int, feature string, rho double")
    from tessera.functions import queries

    got = {r["feature"]: r for r in queries.rank_consistency(*(catalog.bound(spark, sql, {"rho": table}) for sql in (queries._SUMMARY, queries._SIGNED))).collect()}
    assert set(got) == {"a", "b"} and got["a"]["consistent"] and not got["b"]["consistent"]
    assert abs(got["a"]["sign_p"] - 2 / 128) < 1e-12 and abs(got["a"]["wilcoxon_p"] - 2 / 128) < 1e-12 and got["b"]["positive"] == 3 and abs(got["a"]["middle"] - 0.25) < 1e-12


def test_written_results_are_whole(spark, sf):
    got = {r["name"]: (r["rows"], r["columns"]) for r in QUERIES["snk_01_results"](spark, sf).collect()}
    sizes = {n: catalog.table(spark, sf, f"SELECT count(*) AS n FROM t_{t}").first()["n"] for n, t in (("predictions", "pred"), ("features", "feature"), ("summary", "metric"))}
    assert got == {n: (sizes[n], c) for n, c in (("predictions", 4), ("features", 4), ("summary", 6))}


def test_feature_modes_and_neighbour_means(spark):
    rng = np.random.default_rng(4)
    at = rng.random((40, 2))
    rows = [(i, i % 2, float(at[i, 0]), float(at[i, 1]), None if i % 9 == 0 else float(i), float("inf") if i == 3 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "point_id long, area_id int, x double, y double, a double, b double")
    fixed = switches.repaired(df, ["a", "b"])
    assert {r["point_id"]: (r["a"], r["b"]) for r in fixed.collect()} == {i: (0.0 if i % 9 == 0 else float(i), 999.0 if i == 3 else 1.0) for i in range(40)}
    z = (at - at.mean(0)) / (at.std(0) + 1e-8)
    for mode, names in (("coordinates", 2), ("noise", 3), ("coordinates_noise", 3)):
        made, kept = switches.substituted(df, ["a", "b", "x"], mode)
        got = np.array([[r[c] for c in kept] for r in made.orderBy("point_id").collect()])
        assert got.shape == (40, names) and np.isfinite(got).all()
        if mode != "noise":
            np.testing.assert_allclose(got[:, :2], z, atol=1e-9)
    big = switches.substituted(spark.range(20000).select(F.col("id").alias("point_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), ["p", "q"], "noise")
    m = np.array([[r[c] for c in big[1]] for r in big[0].collect()])
    assert abs(m.mean()) < 0.02 and abs(m.std() - 1) < 0.02 and abs(np.corrcoef(m.T)[0, 1]) < 0.03
    edges = [(i, j, w) for i, j, w in zip(rng.integers(0, 30, 90).tolist(), rng.integers(0, 40, 90).tolist(), (rng.random(90) + 0.1).tolist(), strict=True)]
    made, names = switches.with_neighbour_means(df, ["a"], spark.createDataFrame(edges, "src long, dst long, w double"))
    for r in made.collect():
        near = [(w, rows[j][4]) for i, j, w in edges if i == r["point_id"] and rows[j][4] is not None]
        want = sum(w * v for w, v in near) / sum(w for w, _ in near) if near else r["a"]
        assert (r["mean_a"] is None and want is None) or abs(r["mean_a"] - want) < 1e-9
    assert names == ["a", "mean_a"]


def test_graph_variants(spark):
    rng = np.random.default_rng(6)
    at = rng.random((30, 2)) / 100
    points = spark.createDataFrame([(i, i % 2, float(at[i, 0]), float(at[i, 1])) for i in range(30)], "point_id long, area_id int, x double, y double")
    near = {i: sorted((j for j in range(30) if j != i and j % 2 == i % 2), key=lambda j: (np.hypot(*(at[i] - at[j])), j))[:4] for i in range(30)}
    pairs = {(min(i, j), max(i, j)) for i, js in near.items() for j in js}
    edges = lambda variant, **more: {(r["src"], r["dst"]): r["w"] for r in switches.graph(points, variant, 4, **more).collect()}
    assert edges("self") == {(i, i): 1.0 for i in range(30)}
    assert edges("knn") == {e: 1.0 for a, b in pairs for e in ((a, b), (b, a))}
    degree = lambda es: sorted(Counter(a for a, _ in es).items())
    assert degree(edges("rewired")) == degree(edges("knn")) and edges("rewired") != edges("knn")
    metres = catalog.DEFAULTS["metres"]
    want = {(i, j): round(float(np.exp(-np.hypot(*(at[i] - at[j])) * metres / 300)), 6) for i, js in near.items() for j in js if np.hypot(*(at[i] - at[j])) * metres < 1000}
    assert edges("geographic") == pytest.approx(want, abs=2e-6)
    assert switches.graph(points, "none") is None and switches.graph(points, "given", edges=points) is points
    for bad in ("given", "of another kind"):
        with pytest.raises(ValueError):
            switches.graph(points, bad)


def test_switched_regressions_keep_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, 10 + i % 3 + 10 * (i % 2), *rng.random(4).tolist()) for i in range(120)]
    points = spark.createDataFrame(rows, "point_id long, area_id int, x double, y double, a double, b double")
    areas = spark.createDataFrame([(k, 0.1 + 0.02 * k) for k in sorted({r[1] for r in rows})], "area_id int, target double")
    for switch in ({"feature_mode": "coordinates"}, {"feature_mode": "noise", "graph": "self"}, {"graph": "rewired", "dropped": ("b",)}, {"prefix": "2", "areas": (20, 11, 22)}):
        got = methods.Settings(method="regression", features=("a", "b"), neighbours=3, **switch).run(points, areas)
        means = {r["area_id"]: (r["n"], r["m"]) for r in got.groupBy("area_id").agg(F.count("*").alias("n"), F.avg("value").alias("m")).collect()}
        asked = {20, 22} if "prefix" in switch else {r[1] for r in rows}
        assert set(means) == asked & {r[1] for r in rows}
        assert all(n == sum(r[1] == k for r in rows) and abs(m - 0.1 - 0.02 * k) < 1e-9 for k, (n, m) in means.items())
    for bad in ({"feature_mode": "half"}, {"graph": "of another kind"}, {"dropped": ("a", "b")}):
        with pytest.raises(ValueError):
            methods.Settings(method="regression", features=("a", "b"), **bad).run(points, areas)
