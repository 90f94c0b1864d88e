"""Steps whose work or storage must not grow with the pairs of dense places."""

from hashlib import md5

import numpy as np
import pytest

from tessera.functions import digests, models, pairs, paths, resampling
from tessera.operators import PLANS
from tessera.plans import catalog


def test_thinning_of_dense_points_writes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(1500), rng.uniform(0, 0.3, (1500, 2)))] + [(9000, None, 0.1)]
    sizes, write = [], paths.stored
    monkeypatch.setattr(paths, "stored", lambda df: (out := write(df), sizes.append(out.count()))[0])
    got = paths.thinned(spark.createDataFrame(rows, "point_id long, x double, y double"), 0.1)
    kept = []
    for i, x, y in sorted(rows[:-1]):
        if all((x - a) ** 2 + (y - b) ** 2 > 0.1 * 0.1 for _, a, b in kept):
            kept.append((i, x, y))
    assert sorted(r["point_id"] for r in got.collect()) == [k[0] for k in kept] + [9000]
    assert max(sizes) < 2000  # 1.1 million ordered pairs, about a fifth of them near


def test_thinning_of_repeated_keys_takes_one_fate(spark):
    rows = [(1, 0.0, 0.0), (2, 0.05, 0.0), (2, 5.0, 5.0), (3, 5.05, 5.0)]
    got = paths.thinned(spark.createDataFrame(rows, "point_id long, x double, y double"), 0.1)
    assert [r["point_id"] for r in got.collect()] in ([1, 3], [3, 1])


def test_marks_equal_md5():
    for ids in ([5, -17, 3], [7, -12, 123456789012345, *range(95, 1200)]):
        marks = digests.Marks(np.array(ids))
        first, last = marks.halves("42-")
        short = marks.first("7-12-")
        for i, x in enumerate(ids):
            want = md5(f"42-{x}".encode()).digest()
            assert (int(first[i]), int(last[i])) == (int.from_bytes(want[:8], "big"), int.from_bytes(want[8:], "big"))
            assert int(short[i]) == int.from_bytes(md5(f"7-12-{x}".encode()).digest()[:4], "big")


def test_draws_hold_few_picks_at_once():
    assert resampling.BLOCK <= 250_000


def same(a, b):
    return sorted(a.collect(), key=repr) == sorted(b.select(*a.columns).collect(), key=repr)


def dests_of(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1, (90, 2)))]
    rows += [(200, "a", None, 0.5), (7, "b", 0.25, 0.5), (201, None, 0.1, 0.1), (None, "a", 0.2, 0.2), (300, "c", 0.1, 0.1)]
    return spark.createDataFrame(rows, "dest_id long, dest_type string, x double, y double")


def test_dispersion_by_blocks_equals_the_statement(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SIDE", 16)
    name, tables = "sps_13_destination_dispersion", {"dest": dests_of(spark)}
    assert same(catalog.planned(spark, name, dict(tables)), catalog.bound(spark, PLANS[name], dict(tables)))


@pytest.mark.parametrize("name", ["join_07_nearest_within", "join_11_mode_merge"])
def test_rebuilt_joins_equal_their_statements(spark, name):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1.5, (60, 2)))] + [(900, None, 0.1)], "point_id long, x double, y double")
    for dests in (dests_of(spark).filter("dest_id IS NOT NULL AND dest_id <> 7 AND dest_type IS NOT NULL"), dests_of(spark).filter("dest_id < 50 AND dest_type IS NOT NULL")):
        got = catalog.planned(spark, name, {"point": points, "dest": dests})
        assert same(got, catalog.bound(spark, PLANS[name], {"point": points, "dest": dests})) and got.count() > 20


def test_inverse_distances_need_no_row_for_each_centroid(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 14, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 5, (80, 2)))] + [(900, 3, None, 0.1), (901, None, 1.0, 1.0), (902, 77, 1.0, 1.0)]
    areas = [(a, 0.1 + a / 20 if a != 4 else None, float(a % 5), float(a // 5)) for a in range(13)]
    for some in (areas, areas[:6], areas[:1]):
        given = lambda: {"point": spark.createDataFrame(rows, "point_id long, area_id int, x double, y double"), "area": spark.createDataFrame(some, "area_id int, target double, minx double, miny double")}  # noqa: B023, E731
        got = catalog.planned(spark, "dis_05_idw", given())
        assert same(got, catalog.bound(spark, PLANS["dis_05_idw"], given()))
    assert "row_number" not in catalog.statement("dis_05_idw") + catalog.statement("dis_11_method_comparison")


@pytest.mark.parametrize("name", ["val_06_missing_profile", "val_14_matrix_check", "val_16_direction_index", "val_22_suite_checklist"])
def test_access_makes_only_what_is_read(spark, sf, name, monkeypatch):
    made = []

    def tally(spark, tables, params, make, columns, kind=None):
        made.append(columns)
        raise LookupError

    monkeypatch.setattr(catalog, "_tally", tally)
    with pytest.raises(LookupError):
        catalog.planned(spark, name, catalog.opened(spark, sf, PLANS[name]))
    assert len(made[0].split(", ")) <= 2 and all(c.split()[0] in PLANS[name] for c in made[0].split(", "))


def test_forest_deals_its_rows_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "FOREST_ROWS", 40)
    points = spark.range(200, numPartitions=1).selectExpr("id AS point_id", "CAST(id % 17 AS DOUBLE) AS a", "CAST(id AS DOUBLE) AS b", "CAST(id % 5 AS DOUBLE) AS truth")
    _, rows = models.forest(points, ["a", "b"], "truth", trees=2)
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 200
