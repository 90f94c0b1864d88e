"""Every plan's rows against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.operators import PLANS
from tessera.plans import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan_matches_oracle(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    rows = got.collect()
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(rows, got.columns) == plain(want.fetchall(), names)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_tables_can_be_given(spark):
    points = spark.createDataFrame([(1, 7, 70, 0.1, 0.1, 10.0, 0.2), (2, 7, 70, 0.9, 0.2, 30.0, 0.6), (3, 7, 71, 0.4, 0.8, None, 0.4)], "point_id long, area_id int, subarea_id int, x double, y double, ancillary double, truth double")
    areas = spark.createDataFrame([(7, 1, 0.4, 3, 0.0, 0.0)], "area_id int, county_id int, target double, n_points long, minx double, miny double")
    out = {r["point_id"]: r["value"] for r in catalog.run(spark, "dis_03_dasymetric", point=points, area=areas).collect()}
    assert len(out) == 3 and abs(sum(out.values()) / 3 - 0.4) < 1e-6


def test_projection_keeps_the_mean(spark, sf):
    points = catalog.bound(spark, "SELECT p.point_id, p.area_id, a.target FROM t_point p JOIN t_area a ON p.area_id = a.area_id", {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "nation")})
    means = catalog.read(spark, sf, "dis_02_bounded_projection").join(points, "point_id").groupBy("area_id").agg({"p": "avg", "target": "min"}).collect()
    assert means and all(r["min(target)"] is None or abs(r["avg(p)"] - r["min(target)"]) < 1e-5 for r in means)
