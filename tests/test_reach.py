"""Tallies of destinations within reach against the plans' own statements over all pairs."""

import numpy as np
import pytest

from tessera.functions import reach
from tessera.operators import PLANS
from tessera.plans import catalog
from tessera.sources.fixtures import VIEWS


def rows(df):
    return sorted((tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def near(a, b):
    return len(a) == len(b) and all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 3e-5 for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.fixture(scope="module", params=[10.0])
def pairs(request, spark, sf):
    reach = {"reach": request.param}
    opened = lambda: catalog.opened(spark, sf, "SELECT * FROM t_od") | {"point": catalog.table(spark, sf, "SELECT * FROM t_point")}
    return opened, catalog.bound(spark, "SELECT * FROM t_od", opened(), reach).cache(), reach


@pytest.mark.parametrize("name", ["access", *catalog.TALLIED])
def test_tallies_equal_the_statement_over_pairs(spark, pairs, name, monkeypatch):
    opened, od, reach = pairs
    want = rows(catalog.bound(spark, VIEWS[name] if name == "access" else PLANS[name], opened() | {"od": od}, reach))
    monkeypatch.setitem(catalog.BUILT, "od", lambda *_: pytest.fail("the pairs were made"))  # fails where a plan writes out all pairs
    got = catalog.bound(spark, "SELECT * FROM t_access", opened(), reach) if name == "access" else catalog.planned(spark, name, opened(), reach)
    assert near(rows(got), want) and want


def test_repeated_point_ids_are_one_point(spark, sf):
    tables = catalog.opened(spark, sf, "SELECT * FROM t_od")
    points = catalog.table(spark, sf, "SELECT * FROM t_point")
    tables["point"] = points.unionByName(points.filter("point_id < 4").selectExpr("point_id", "area_id", "subarea_id", "x + 0.3 AS x", "y", "ancillary", "truth"))
    od = catalog.bound(spark, "SELECT * FROM t_od", dict(tables))
    got, want = catalog.planned(spark, "acc_14_connectivity", dict(tables)), catalog.bound(spark, PLANS["acc_14_connectivity"], tables | {"od": od})
    assert near(rows(got), rows(want))


@pytest.mark.parametrize("points, dests, side, minutes", [(1500, 9000, 0.2, 30.0), (300, 50, 0.8, 30.0), (600, 2000, 2.0, 40.0), (700, 2000, 0.2, 10.0), (1200, 6000, 0.3, 70.0)])
def test_tiles_equal_the_pairs_of_each_point(points, dests, side, minutes):
    rng = np.random.default_rng(points)
    x, y, bx, by = rng.uniform(1, 1 + side, points), rng.uniform(2, 2 + side, points), rng.uniform(0, 5, dests), rng.uniform(0, 5, dests)
    bx[:20], by[:20] = x[:20], y[:20]
    tile = reach.Tile(x, y, bx, by, minutes)
    made, modes = {k: f(tile) for k, f in reach.TILED.items()}, reach.modes.tiled(tile)
    for i in [*range(10), *rng.choice(points, 30).tolist()]:
        dx, dy = bx - x[i], by - y[i]
        km = np.sqrt(dx * dx + dy * dy) * 6.0
        near = km / 30.0 * 60.0 <= minutes
        assert made["n"][i] == near.sum()
        if near.any():
            pairs = reach.Pairs(1, np.flatnonzero(near), dx[near], dy[near], km[near], km[near] / 30.0 * 60.0)
            for k, v in made.items():
                assert v[i] == pytest.approx(reach.SUMMARIES[k][1](pairs), rel=1e-10, abs=1e-10), k
            for got, want in zip(modes, reach.modes(pairs), strict=True):
                assert got[0] == want[0] and [v[i] for v in got[1:]] == pytest.approx(list(want[1:]), rel=1e-9, abs=1e-9)


def test_access_takes_no_arrays_of_single_points():
    for name in ("acc_14_connectivity", "val_01_time_realism", "val_12_pair_counts"):
        assert catalog.TALLIED[name][0][0].tiled


def test_drive_advantage_makes_no_sums_over_pairs(spark, sf):
    assert "mean" not in catalog.TALLIED["acc_03_drive_advantage"][0][1]
    tables = catalog.opened(spark, sf, "SELECT * FROM t_od")
    point = "point_id long, area_id int, subarea_id int, x double, y double, ancillary double, truth double"
    tables["point"] = spark.createDataFrame([(1, 0, 0, 0.5, 0.5, None, None), (2, 0, 0, 4.5, 4.5, None, None), (3, 0, 0, None, 1.0, None, None)], point)
    tables["dest"] = spark.createDataFrame([(1, "a", 0.5, 0.5, 9), (2, "b", 0.5, 0.6, 9), (3, "b", 0.5, 0.5, 9)], "dest_id long, dest_type string, x double, y double, employees long")
    od = catalog.bound(spark, VIEWS["od"], dict(tables))
    want = catalog.bound(spark, PLANS["acc_03_drive_advantage"], tables | {"od": od.filter("km IS NOT NULL")})
    got = rows(catalog.planned(spark, "acc_03_drive_advantage", dict(tables)))
    assert got == rows(want)
    assert (1, "a", -0.2) in got  # its only pair has no distance
