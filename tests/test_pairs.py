"""Plans over pairs of points and destinations that are built without a row for each pair, on rows of their own."""

from hashlib import md5

import numpy as np
import pytest

from tessera.functions import reach, together
from tessera.functions.digests import Ends
from tessera.operators import PLANS
from tessera.plans import catalog
from tessera.sources.fixtures import VIEWS

POINT = "point_id long, area_id int, subarea_id int, x double, y double, ancillary double, truth double"
DEST = "dest_id long, dest_type string, x double, y double, employees long"


def plain(df):
    return sorted((tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def close(a, b):
    return len(a) == len(b) > 0 and all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 3e-5 for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.fixture(scope="module")
def tables(spark):
    """Points and destinations of three types, one of them few, one without a name."""
    rng = np.random.default_rng(8)
    points = [(i, i % 3, 10 * (i % 3), *map(float, rng.uniform(0, 5, 2)), float(rng.uniform(0, 9)), float(rng.random())) for i in range(90)]
    dests = [(i, ("employment", "healthcare", None)[i % 3], *map(float, rng.uniform(0, 5, 2)), 100) for i in range(120)] + [(200, "grocery", 60.0, 60.0, 9), (201, "grocery", 0.5, 0.5, 9)]
    return {"point": spark.createDataFrame(points, POINT).coalesce(1), "dest": spark.createDataFrame(dests, DEST).coalesce(1)}


def without_pairs(spark, name, tables, monkeypatch, **params):
    """The plan's rows, and its statement's over all pairs; the plan may make no table of them."""
    base = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("orders", "nation", "customer", "part")} if name.startswith("acc_23") else {}
    od = catalog.bound(spark, VIEWS["od"], dict(tables), params)
    want = plain(catalog.bound(spark, PLANS[name], base | tables | {"od": od}, params))
    for t in ("od", "times"):
        monkeypatch.setitem(catalog.BUILT, t, lambda *_: pytest.fail("the pairs were made"))
    monkeypatch.setitem(VIEWS, "od_all", "SELECT the pairs were made")
    return plain(catalog.planned(spark, name, base | tables, params)), want


# F4
def test_val_10_makes_no_pairs(spark, tables, monkeypatch):
    got, want = without_pairs(spark, "val_10_root_causes", tables, monkeypatch)
    assert close(got, want) and any(r[0] == "travel_time_computation" and r[3] for r in got)


# F6
def test_acc_02_makes_no_pairs(spark, tables, monkeypatch):
    assert close(*without_pairs(spark, "acc_02_base_features", tables, monkeypatch))


def test_points_without_an_id_are_one_point(spark, tables):
    some = tables["point"].selectExpr("CASE WHEN point_id > 3 THEN point_id END AS point_id", "area_id", "subarea_id", "x", "y", "ancillary", "truth").filter("point_id IS NULL OR point_id > 80")
    dests = tables["dest"].filter("dest_type <> 'grocery'").distinct()
    want = catalog.bound(spark, PLANS["acc_02_base_features"], {"point": some, "dest": dests})
    assert close(plain(catalog.planned(spark, "acc_02_base_features", {"point": some, "dest": dests})), plain(want))


def test_repeated_destinations_count_as_in_the_pairs(spark, tables):
    twice = tables | {"dest": tables["dest"].unionByName(tables["dest"].filter("dest_id < 9"))}
    want = catalog.bound(spark, PLANS["acc_02_base_features"], dict(twice))  # over t_od built by cells
    assert close(plain(catalog.planned(spark, "acc_02_base_features", dict(twice))), plain(want))


# F9
def test_acc_23_makes_no_pairs(spark, tables, monkeypatch):
    areas = spark.createDataFrame([(i, 1, 0.4, 30, 0.0, 0.0) for i in range(3)], "area_id int, county_id int, target double, n_points long, minx double, miny double")
    assert close(*without_pairs(spark, "acc_23_feature_matrix", tables | {"area": areas}, monkeypatch))


# F10
def test_join_10_makes_no_pairs(spark, tables, monkeypatch):
    blank = spark.createDataFrame([(500, 0, 0, None, 1.0, None, None)], POINT)
    twice = tables["dest"].unionByName(tables["dest"].filter("dest_id = 7"))
    got, want = without_pairs(spark, "join_10_od_pairs", {"point": tables["point"].unionByName(blank), "dest": twice}, monkeypatch)
    assert close(got, want) and {r[1] for r in got} == {91 * 40, 91 * 41, 91 * 2}


# F11
@pytest.mark.parametrize("minutes", [10.0, 30.0, 70.0])
def test_acc_07_takes_no_arrays_of_single_points(minutes):
    assert catalog.TALLIED["acc_07_legacy_features"][0][0].tiled
    rng = np.random.default_rng(3)
    x, y, bx, by = rng.uniform(2, 2.2, 1200), rng.uniform(2, 2.2, 1200), rng.uniform(0, 5, 4000), rng.uniform(0, 5, 4000)
    bx[:9], by[:9] = x[:9], y[:9]
    tile = reach.Tile(x, y, bx, by, minutes)
    names = ("least_best", "mean_best", "p90_best", "transit_share", "gravity", "best_5", "best_10", "best_15", "over_300", "mean_km", "squares_km", "squares_time", "products")
    made = {k: reach.TILED[k](tile) for k in names}
    for i in range(0, 1200, 40):
        dx, dy = bx - x[i], by - y[i]
        km = np.sqrt(dx * dx + dy * dy) * 6.0
        near = km / 30.0 * 60.0 <= minutes
        pairs = reach.Pairs(1, np.flatnonzero(near), dx[near], dy[near], km[near], km[near] / 30.0 * 60.0)
        for k in names:
            assert made[k][i] == pytest.approx(reach.SUMMARIES[k][1](pairs), rel=1e-10, abs=1e-9), k


# F5
def test_val_11_makes_no_pairs(spark, tables, monkeypatch):
    got, want = without_pairs(spark, "val_11_distance_time_check", tables, monkeypatch)
    assert close(got, want) and len(got) == 3


def test_percentiles_and_bounds_of_times_over_all_pairs(spark, monkeypatch):
    """Times that repeat, cells cut finer, bounds that leave pairs out, and pairs that come as rows."""
    rng = np.random.default_rng(5)
    at = [(i, *map(float, rng.integers(0, 60, 2) / 30)) for i in range(300)]
    points = spark.createDataFrame(at, "point_id long, x double, y double").coalesce(1)
    dests = spark.createDataFrame([(i, "ab"[i % 2], x, y) for i, x, y in at[:80]], "dest_id long, dest_type string, x double, y double").coalesce(1)
    over, more = reach.dealt(points, dests, 10.0, 12.0), [20.0, 30.0]
    x, y = np.array([p[1] for p in at]), np.array([p[2] for p in at])
    dx, dy = x[:80] - x[:, None], y[:80] - y[:, None]
    km = np.sqrt(dx * dx + dy * dy) * 6.0
    km = np.concatenate([km[km / 30.0 * 60.0 <= 10.0], more])
    monkeypatch.setattr(together, "GATHERED", 50)
    monkeypatch.setattr(together, "FINER", 3)
    plain = spark.createDataFrame([(v,) for v in more], "km double").coalesce(1)
    got, means = together.percentiles(over, plain, 10.0, {"q1": 0.25, "q3": 0.75, "top": 0.9999})
    bounds = {"walk": (6.0, 40.0), "drive": (0.0, 5.0), "transit": (10.0, 25.0)}
    found = {mode: (n, r) for mode, n, r in together.correlated(over, plain, 10.0, bounds, means)}
    for mode, of in together.MODES.items():
        v = of(km)
        assert [got[mode][k] for k in ("q1", "q3", "top")] == pytest.approx(np.quantile(v, [0.25, 0.75, 0.9999]), rel=1e-12)
        held = (v >= bounds[mode][0]) & (v <= bounds[mode][1])
        assert found[mode][0] == held.sum() and found[mode][1] == pytest.approx(np.corrcoef(km[held], v[held])[0, 1], rel=1e-9)


# F2
def test_val_02_makes_no_pairs(spark, tables, monkeypatch):
    """A type with fewer than a hundred pairs has them all, after wider cuts."""
    monkeypatch.setattr(catalog, "FIRST_PAIRS", 300)
    got, want = without_pairs(spark, "val_02_time_distance", tables, monkeypatch)
    assert close(got, want) and {r[0]: r[1] for r in got}["healthcare"] == 100


def test_md5_of_many_prefixes():
    texts = np.array([str(i).encode() for i in (0, 7, 12, 345, 99999, 12345678901)])
    for prefix in (b"1-", b"123-", b"1234567-", b"x" * 50):
        assert Ends(texts).first(prefix).tolist() == [int.from_bytes(md5(prefix + t).digest()[:4], "big") for t in texts.tolist()]
