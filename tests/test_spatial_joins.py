"""Radius joins, bands and point-in-polygon against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import neighbours, polygons
from tessera.functions.neighbours import band, lonely, nearest, within
from tessera.plans import catalog


def cloud(seed, n, clump=0):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-3, 3, (n, 2)).tolist() + rng.normal(1, 1e-3, (clump, 2)).tolist()
    return [(i, i % 3, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(10_000, 0, None, 1.0), (10_001, 0, 0.0, None)]


SCHEMA = "id long, area_id int, x double, y double"


@pytest.mark.parametrize("radius", [0.05, 0.7, 100.0])
def test_radius_join_equals_all_pairs(spark, radius):
    a, b = cloud(1, 150, 40), cloud(2, 60, 10)
    got = within(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), radius, "id", "id").collect()
    want = {(i, j) for i, _, x, y in a for j, _, u, v in b if None not in (x, y, u, v) and (u - x) ** 2 + (v - y) ** 2 <= radius * radius}
    assert len(got) == len(want) and {(r["src"], r["dst"]) for r in got} == want
    by_a, by_b = {r[0]: r for r in a}, {r[0]: r for r in b}
    assert all(r["dx"] == by_b[r["dst"]][2] - by_a[r["src"]][2] for r in got)


@pytest.mark.parametrize("group", [None, "area_id"])
def test_band_equals_all_pairs(spark, group):
    a = cloud(3, 200, 30) + [(500, 1, 0.5, 0.5), (501, 1, 0.5, 0.5)]
    got = band(spark.createDataFrame(a, SCHEMA), 0.6, "id", group).collect()
    want = {(i, j) for i, g, x, y in a for j, h, u, v in a if i != j and None not in (x, y, u, v) and math.sqrt((u - x) ** 2 + (v - y) ** 2) <= 0.6 and (not group or g == h)}
    assert len(got) == len(want) and {(r["src"], r["dst"]) for r in got} == want


def test_lonely_points_are_all_found(spark):
    a, b = cloud(4, 200), [(i, i % 3, float(i), 0.0) for i in range(-2, 3)]
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    found = {(r["id"], r["kind"]) for r in lonely(left, right.withColumnRenamed("area_id", "kind"), 1.5, right.select(F.col("area_id").alias("kind")).distinct(), "kind").collect()}
    alone = {(i, k) for i, _, x, y in a if None not in (x, y) for k in range(3) if all((u - x) ** 2 + (v - y) ** 2 > 2.25 for _, h, u, v in b if h == k)}
    assert alone <= found and len(found) < 600


def star(poly, cx, cy, outer, inner, n, hole=0.0):
    """A star of n points around (cx, cy), with a square hole."""
    ring = [(poly, 0, i, cx + r * math.cos(math.pi * i / n), cy + r * math.sin(math.pi * i / n)) for i in range(2 * n) for r in ((outer, inner)[i % 2],)]
    return ring + [(poly, 1, i, cx + hole * u, cy + hole * v) for i, (u, v) in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1)]) if hole]


def boxes():
    square = lambda p, x, y, w: [(p, 0, 0, x, y), (p, 0, 1, x + w, y), (p, 0, 2, x + w, y + w), (p, 0, 3, x, y + w)]
    comb = [(9, 0, 2 * i + j, i * 0.2 - 5, (0.0, 6.0)[(i + j) % 2]) for i in range(50) for j in (0, 1)] + [(9, 0, 100, 5.0, -1.0), (9, 0, 101, -5.0, -1.0)]
    return square(1, 0.0, 0.0, 1.0) + square(2, 1.0, 0.0, 1.0) + square(3, -3.0, -3.0, 6.0) + star(4, 0.3, 0.2, 5.0, 2.0, 60, 0.5) + star(5, -1.0, -1.0, 0.2, 0.1, 5) + star(6, 10.0, 10.0, 50.0, 20.0, 120, 7.0) + comb + [(7, 0, 0, 2.0, 2.0), (8, 0, 0, 1.0, 1.0), (8, 0, 1, 2.0, 2.0)]


def plain(points, corners):
    rings = {}
    for p, r, s, x, y in corners:
        rings.setdefault((p, r), []).append((s, x, y))
    out = set()
    for i, _, px, py in points:
        if None in (px, py):
            continue
        odd = {}
        for (p, _), ring in rings.items():
            ring = sorted(ring)
            for (_, x1, y1), (_, x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                    odd[p] = odd.get(p, 0) ^ 1
        out |= {(i, p) for p, o in odd.items() if o}
    return out


@pytest.mark.parametrize("most", [6, 1000])
def test_points_in_polygons_equal_plain_ray_casting(spark, most):
    rng = np.random.default_rng(6)
    at = np.vstack([rng.uniform(-6, 6, (700, 2)), rng.uniform(-45, 65, (300, 2)), rng.integers(-6, 7, (150, 2)) / 2]).tolist()
    points = [(i, 0, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(5000, 0, None, 0.5)]
    corners = spark.createDataFrame(boxes(), "poly_id long, ring int, seq int, x double, y double").repartition(3)
    got = polygons.contains(spark.createDataFrame(points, SCHEMA), corners, "id", most).collect()
    want = plain(points, boxes())
    assert len(got) == len(want) and {(r["id"], r["poly_id"]) for r in got} == want and len(want) > 500
    cells = polygons.covering(corners, most)
    assert most != 6 or cells.filter("segs IS NULL").count() > 20 and cells.select("level").distinct().count() > 8


def test_no_polygons_and_no_points(spark):
    corners = spark.createDataFrame([], "poly_id long, ring int, seq int, x double, y double")
    points = spark.createDataFrame(cloud(1, 5), SCHEMA)
    assert polygons.contains(points, corners, "id").count() == 0
    assert polygons.contains(points.limit(0), spark.createDataFrame(boxes(), corners.schema), "id").count() == 0


def test_a_polygon_of_nine_cells_keeps_its_points(spark):
    """Points of a polygon that is wider than two cells of the subareas' size."""
    points = [(i, 7, 70, 0.3 * i + 0.1, 1.7, 1.0, 0.5) for i in range(10)]
    corner = [(70, 7, 0, 0, 0.0, 0.0), (70, 7, 0, 1, 3.0, 0.0), (70, 7, 0, 2, 3.0, 3.0), (70, 7, 0, 3, 0.0, 3.0)]
    given = {
        "point": spark.createDataFrame(points, "point_id long, area_id int, subarea_id int, x double, y double, ancillary double, truth double"),
        "corner": spark.createDataFrame(corner, "poly_id int, area_id int, ring int, seq int, x double, y double"),
    }
    rows = catalog.run(spark, "join_04_point_in_polygon_left", **given).collect()
    assert len(rows) == 10 and all(r["subarea_id"] == 70 for r in rows)


def test_counts_and_nearest_times_are_over_all_destinations(spark, sf):
    """Within the reach every pair is there: counts and nearest times equal those over all pairs."""
    sql = "SELECT point_id, dest_type, min(drive_time) AS t, count_if(drive_time <= 5e0) AS c5, count_if(drive_time <= 10e0) AS c10, count_if(drive_time <= 15e0) AS c15 FROM t_{0} GROUP BY point_id, dest_type"
    found = [{tuple(r)[:2]: (round(r["t"], 9), *tuple(r)[3:]) for r in catalog.table(spark, sf, sql.format(t)).collect()} for t in ("od", "od_all")]
    assert found[0] == found[1] and len(found[0]) > 100


def test_reach_is_a_parameter(spark, sf):
    tables = lambda: catalog.opened(spark, sf, "SELECT * FROM t_od")
    sizes = [catalog.bound(spark, "SELECT count(*) AS n FROM t_od", tables(), {"reach": r}).first()["n"] for r in (1e-6, 10.0, 1e6)]
    kinds, points, dests = (catalog.bound(spark, f"SELECT count({c}) AS n FROM {t}", tables()).first()["n"] for c, t in (("DISTINCT dest_type", "t_dest"), ("*", "t_point"), ("*", "t_dest")))
    assert sizes[0] == kinds * points < sizes[1] < sizes[2] == points * dests


@pytest.mark.parametrize("same", [True, False])
def test_nearest_in_clumps_equals_all_pairs(spark, monkeypatch, same):
    """Nine tenths of the points in a hundredth of the width, many at one place: same result, few pairs."""
    monkeypatch.setattr(neighbours, "DENSE", 32)
    rng = np.random.default_rng(12)
    xy = np.vstack([rng.uniform(0, 1, (150, 2)), 0.3 + rng.uniform(0, 0.01, (900, 2)), np.full((200, 2), 0.7), 0.9 + rng.normal(0, 1e-7, (150, 2))])
    rows = [(int(i), 0, float(x), float(y)) for i, (x, y) in zip(rng.permutation(len(xy)), xy, strict=True)]
    left = rows if same else [(i, 0, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1, (60, 2)))]
    got = {}
    for r in nearest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(rows, SCHEMA), 5, "id", "id", same=same).orderBy("src", "nth").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    ids, at = np.array([r[0] for r in rows]), np.array([r[2:] for r in rows])
    for i, _, x, y in left:
        d = (x - at[:, 0]) * (x - at[:, 0]) + (y - at[:, 1]) * (y - at[:, 1])
        order = np.lexsort((ids, d))
        assert got[i] == [int(ids[j]) for j in order if not (same and ids[j] == i)][:5]
    assert len(got) == len(left)


def test_pairs_within_are_dealt_to_tasks_by_their_number(spark):
    rng = np.random.default_rng(11)
    a, b = rng.uniform(0, 5, (3000, 2)), rng.uniform(0, 5, (4000, 2))
    left, right = (spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double").coalesce(1) for at in (a, b))
    found = neighbours.within(left, right, 0.5, "id", "id")
    assert found.rdd.getNumPartitions() == 3
    near = ((a[:, None] - b) ** 2).sum(2) <= 0.25
    assert found.count() == near.sum() and found.agg(F.sum("src"), F.sum("dst")).first()[:] == (int(np.nonzero(near)[0].sum()), int(np.nonzero(near)[1].sum()))
