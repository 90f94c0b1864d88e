"""Named plans: SQL statements over logical tables (t_<name>), bound to DataFrames by the caller.

    run(spark, "dis_03_dasymetric", point=points, area=areas)
    run(spark, "sta_07_bootstrap_ci", params={"draws": 200}, pred=predictions)

Any logical table that is not given is derived from the others by its definition in sources.fixtures, so a plan
over points and areas needs only these two. Tables of neighbours, pairs within reach and points in polygons are built by
cells instead of their definition, which states the same result over all pairs. Numbers written as $name are parameters, with the defaults below.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pairs, quantiles, reach, resampling, together
from ..functions.neighbours import band, lonely, nearest, within
from ..functions.polygons import contains
from ..operators import PLANS
from ..operators.access import _MODES
from ..operators.disaggregation import IDW
from ..sources.ranks import placed
from ..sources.fixtures import BASE, MINUTES, QUANTILES, TIMES, VIEWS
from ..sources.stored import BROADCAST_ROWS, sized, stored

_NAME = re.compile(r"\bt_([a-z_0-9]+)\b")
_PARAM = re.compile(r"\$([a-z_0-9]+)")

#: Defaults of the plans' parameters.
DEFAULTS: dict[str, float | int] = {
    "draws": 1000,
    "permutations": 999,
    "alpha": 0.05,
    "area": 12,
    "least_points": 5,
    "metres": 1110.0,
    "walk_minutes": 15.0,
    "target_low": 0.3,
    "target_high": 0.7,
    "complete_points": 50,
    "reach": 30.0,
    "gap": 0.3,
}


Params = dict[str, float | int]


def tables_of(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def filled(sql: str, params: dict[str, float | int] | None = None) -> str:
    """The statement with its parameters as numbers; doubles keep an exponent in every dialect."""
    known = DEFAULTS | (params or {})

    def number(m: re.Match) -> str:
        v = known[m[1]]
        return repr(v) if isinstance(v, int) else _double(v)

    return _PARAM.sub(number, sql)


def _double(v: float) -> str:
    text = repr(float(v))
    return text if "e" in text else f"{text}e0"


def run(spark: SparkSession, name: str, params: dict[str, float | int] | None = None, **tables: DataFrame) -> DataFrame:
    """The plan's result as a DataFrame over the given tables."""
    return planned(spark, name, dict(tables), params)


def planned(spark: SparkSession, name: str, tables: dict[str, DataFrame], params: Params | None = None) -> DataFrame:
    """The plan's statement, or the one over a tally of t_od that gives the same rows."""
    if name in REBUILT:
        return REBUILT[name](spark, dict(tables), DEFAULTS | (params or {}))
    if name in ACCESSED and "access" not in tables:
        tables = tables | {"access": _access(spark, dict(tables), DEFAULTS | (params or {}), ACCESSED[name])}
    if name not in TALLIED:
        return bound(spark, statement(name), tables, params)
    how, sql, kind = TALLIED[name]
    return bound(spark, sql, tables | {"tally": _tally(spark, dict(tables), DEFAULTS | (params or {}), *how, kind, name in PAIRED)}, params)


def statement(name: str) -> str:
    """The plan's statement, with the inverse distance means as a table that is built."""
    return PLANS[name].replace(f"({IDW})", "t_idw")


def bound(spark: SparkSession, sql: str, tables: dict[str, DataFrame], params: dict[str, float | int] | None = None) -> DataFrame:
    for t in tables_of(sql):
        if t not in tables:
            tables[t] = BUILT[t](spark, tables, DEFAULTS | (params or {})) if t in BUILT else bound(spark, VIEWS[t], tables, params)
    return spark.sql(_NAME.sub(r"{\1}", filled(sql, params)), **{t: tables[t] for t in tables_of(sql)})


def _near16(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    points = bound(spark, "SELECT point_id, area_id, x, y FROM t_point", tables)
    return nearest(points, points, 16, "point_id", "point_id", "area_id", same=True)


def _snap(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    points, nodes = (bound(spark, f"SELECT * FROM t_{t}", tables) for t in ("point", "node"))
    found = nearest(points, nodes, 1, "point_id", "node").select(F.col("src").alias("point_id"), F.col("dst").alias("node"), "d")
    return points.select("point_id", "area_id").join(found.hint("merge"), "point_id").select("point_id", "area_id", "node", "d")


def _near_dest(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    points, dests = (bound(spark, f"SELECT * FROM t_{t}", tables) for t in ("point", "dest"))
    return nearest(points, dests, 20, "point_id", "dest_id").select(F.col("src").alias("point_id"), F.col("dst").alias("dest_id"), "d", "nth")


def _local(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    """The nearest destinations of each type for every area's centre."""
    areas, dests = (bound(spark, f"SELECT * FROM t_{t}", tables) for t in ("extent", "dest"))
    kinds = dests.select("dest_type").distinct()
    centres = areas.select("area_id", F.col("cx").alias("x"), F.col("cy").alias("y")).join(F.broadcast(kinds))  # a few types
    centres = centres.withColumn("key", F.concat_ws("/", "area_id", "dest_type"))
    found = nearest(centres, dests, 20, "key", "dest_id", "dest_type")
    known = found.select(F.split("src", "/")[0].cast("bigint").alias("area_id"), F.col("dst").alias("dest_id"), "d")
    known = known.join(F.broadcast(areas.select("area_id", "extent")) if areas.count() < 100_000 else areas.select("area_id", "extent").hint("merge"), "area_id").filter("d <= 1.5 * extent")
    return known.join(dests.hint("merge"), "dest_id").select(F.col("area_id").cast(areas.schema["area_id"].dataType), "dest_id", "dest_type", "x", "y")


def _far(spark: SparkSession, points: DataFrame, dests: DataFrame, radius: float) -> DataFrame | None:
    """(src, dst, dx, dy): the nearest of a type for points that may have none within the radius; None if there are none."""
    kinds = dests.select("dest_type").distinct()  # a few
    alone = lonely(points, dests, radius, kinds, "dest_type").withColumn("key", F.concat_ws("/", "point_id", "dest_type"))
    if alone.isEmpty():
        return None
    one = nearest(alone, dests, 1, "key", "dest_id", "dest_type").select(F.col("src").alias("key"), "dst")
    ends = one.join(alone.hint("merge"), "key").join(dests.select(F.col("dest_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by")).hint("merge"), "dst")
    return ends.select(F.col("point_id").alias("src"), "dst", (F.col("bx") - F.col("x")).alias("dx"), (F.col("by") - F.col("y")).alias("dy"))


def _timed(spark: SparkSession, found: DataFrame, dests: DataFrame, reach: float) -> DataFrame:
    """t_od's columns for pairs (src, dst, dx, dy, near), without those that are not near or far as they claim."""
    kind_of = dests.select(F.col("dest_id").alias("dst"), "dest_type")
    kind_of = F.broadcast(kind_of) if dests.count() <= BROADCAST_ROWS else kind_of.hint("merge")
    sql = f"SELECT * FROM (SELECT near, {TIMES} FROM (SELECT src AS point_id, dst AS dest_id, dest_type, dx, dy, sqrt(dx * dx + dy * dy) * 6e0 AS km, near FROM {{found}})) WHERE near = (drive_time <= {_double(reach)})"
    return spark.sql(sql, found=found.join(kind_of, "dst")).drop("near")


def _ends(spark: SparkSession, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return bound(spark, "SELECT point_id, x, y FROM t_point", tables), bound(spark, "SELECT dest_id, dest_type, x, y FROM t_dest", tables)


def _od(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    """Pairs of points and destinations within reach, and each point's nearest of a type that has none there."""
    points, dests = _ends(spark, tables)
    radius = params["reach"] / MINUTES * (1 + 1e-9)  # the exact condition follows
    found = within(points, dests, radius, "point_id", "dest_id").select("src", "dst", "dx", "dy").withColumn("near", F.lit(True))
    far = _far(spark, points, dests, radius)
    found = found if far is None else found.unionByName(far.withColumn("near", F.lit(False)))
    return _timed(spark, found, dests, params["reach"])


def _parted(spark: SparkSession, points: DataFrame, dests: DataFrame, params: Params) -> tuple[DataFrame, list[DataFrame]]:
    """Points with an id of their own, and what of t_od is not theirs within reach: all pairs of the others, and the far ones."""
    repeated = stored(points.groupBy("point_id").count().filter("count > 1").select(F.col("point_id").alias("_id")))
    plain = []
    if not repeated.isEmpty():
        same = F.col("point_id").eqNullSafe(F.col("_id"))  # points without an id are one point, too
        plain.append(_od(spark, {"point": points.join(sized(repeated), same, "left_semi"), "dest": dests}, params))
        points = stored(points.join(sized(repeated), same, "left_anti"))
    far = _far(spark, points, dests, params["reach"] / MINUTES * (1 + 1e-9))
    if far is not None:
        plain.append(_timed(spark, far.withColumn("near", F.lit(False)), dests, params["reach"]))
    return points, plain


def _paired(dests: DataFrame) -> DataFrame:
    """Destinations as often as t_od built by cells has them: once with the type of each row of their id, which is not null."""
    known = dests.filter("dest_id IS NOT NULL")
    return known if _unique(known, "dest_id") else stored(known.drop("dest_type").join(known.select("dest_id", "dest_type").hint("merge"), "dest_id").select(*dests.columns))


def _tally(spark: SparkSession, tables: dict[str, DataFrame], params: Params, make: Callable, columns: str, kind: str | None = None, paired: bool = False) -> DataFrame:
    """(point_id, dest_type, columns): what `make` gives for each point's pairs of each type in t_od, made without the pairs.

    Points with none of a type within reach have one pair, their nearest. The pairs of ids that repeat are written out,
    and all are if destinations are more than a task should hold or the caller gives t_od. `paired`: destinations count
    as in _paired.
    """
    of_kind = lambda rows: rows if kind is None else rows.filter(F.col("dest_type") == kind)
    if "od" in tables:
        return reach.of_pairs(of_kind(tables["od"]), make, columns)
    points, dests = _ends(spark, tables)
    points, dests = stored(points), stored(of_kind(dests))
    if dests.count() > reach.MOST_DESTS:
        return reach.of_pairs(_od(spark, {"point": points, "dest": dests}, params), make, columns)
    points, plain = _parted(spark, points, dests, params)
    found = reach.summarised(points, _paired(dests) if paired else dests, params["reach"], MINUTES, make, columns)
    return found.unionByName(stored(reach.of_pairs(reduce(DataFrame.unionByName, plain), make, columns))) if plain else found


#: t_access from a tally.
_ACCESS = """SELECT point_id, dest_type, min_time, mean_time, median_time, count_5, count_10, count_15, p90, mean_transit, least(greatest((mean_walk - mean_time) / mean_walk, -0.2e0), 1e0) AS drive_advantage,
 CASE WHEN n < 2 THEN 0e0 ELSE least(sd_time / (mean_time + 1e-8), 1e0) END AS dispersion, CASE WHEN n < 2 THEN 0e0 ELSE least((max_time - min_time) / (mean_time + 1e-8), 2e0) END AS time_range FROM t_tally"""


def _access(spark: SparkSession, tables: dict[str, DataFrame], params: Params, only: tuple[str, ...] = ()) -> DataFrame:
    """t_access, or only some of its columns that the tally gives as they are."""
    if only:
        return _tally(spark, tables, params, *reach.named(*only))
    names = ("n", "min_time", "max_time", "mean_time", "sd_time", "median_time", "count_5", "count_10", "count_15", "p90", "mean_transit", "mean_walk")
    return bound(spark, _ACCESS, {"tally": _tally(spark, tables, params, *reach.named(*names))}, params)


#: Plans over t_access that read these of its columns alone; the others are not made.
ACCESSED: dict[str, tuple[str, ...]] = {
    "val_06_missing_profile": ("min_time", "mean_time"),
    "val_08_centre_periphery": ("mean_time",),
    "val_14_matrix_check": ("min_time", "count_5"),
    "val_16_direction_index": ("count_10", "mean_time"),
    "val_22_suite_checklist": ("mean_time",),
}

#: SQL for the correlation of kilometres and minutes by car over all pairs of a type, from the moments of each point's.
_CORRELATION = """SELECT t.dest_type, (sum(t.products) + sum(t.n * (t.mean_km - m.km) * (t.mean_time - m.time))) / nullif(sqrt((sum(t.squares_km) + sum(t.n * (t.mean_km - m.km) * (t.mean_km - m.km))) * (sum(t.squares_time) + sum(t.n * (t.mean_time - m.time) * (t.mean_time - m.time)))), 0e0) AS r
 FROM t_tally t JOIN (SELECT dest_type, sum(n * mean_km) / sum(n) AS km, sum(n * mean_time) / sum(n) AS time FROM t_tally GROUP BY dest_type) m ON t.dest_type <=> m.dest_type GROUP BY t.dest_type"""

#: Those of TALLIED whose rows were made from the pairs of t_od built by cells.
PAIRED = ("acc_02_base_features", "val_10_root_causes")

#: Plans over t_od that take a tally of it: what makes the tally, the statement over it, and the only type if there is one.
TALLIED: dict[str, tuple[tuple[Callable, str], str, str | None]] = {
    "acc_02_base_features": (reach.named("min_time", "mean_time", "median_time", "count_5", "count_10", "count_15"), "SELECT point_id, dest_type, round(min_time, 6) AS min_time, round(mean_time, 6) AS mean_time, round(median_time, 6) AS median_time, count_5, count_10, count_15 FROM t_tally", None),
    # walking takes six times the minutes of driving on every pair of TIMES (km / 5 and km / 30 hours), so the ratio of the sums
    # is that of any pair with a distance: what has to be known of all pairs is whether there is one
    "acc_03_drive_advantage": (reach.named("moved"), "SELECT point_id, dest_type, round(least(greatest(CASE WHEN moved > 0 THEN (60e0 / 5e0 - 60e0 / 30e0) / (60e0 / 5e0) END, -0.2e0), 1e0), 6) AS drive_advantage FROM t_tally", None),
    "acc_04_dispersion": (reach.named("n", "min_time", "max_time", "mean_time", "sd_time"), "SELECT point_id, dest_type, round(CASE WHEN n < 2 THEN 0e0 ELSE least(sd_time / (mean_time + 1e-8), 1e0) END, 6) AS dispersion, round(CASE WHEN n < 2 THEN 0e0 ELSE least((max_time - min_time) / (mean_time + 1e-8), 2e0) END, 6) AS time_range FROM t_tally", None),
    "acc_05_strict_percentile": (reach.named("mean_time"), f"SELECT point_id, dest_type, round(CAST(below AS DOUBLE) / n, 6) AS percentile FROM ({placed('(SELECT point_id, dest_type, round(mean_time, 6) AS m FROM t_tally)', 'm', 'dest_type')})", None),
    "acc_07_legacy_features": (reach.named("least_best", "mean_best", "p90_best", "transit_share", "gravity", "best_5", "best_10", "best_15"), "SELECT point_id, dest_type, round(least_best, 6) AS min_time, round(mean_best, 6) AS mean_time, round(p90_best, 6) AS p90, round(transit_share, 6) AS transit_share, round(gravity, 6) AS gravity, best_5 AS count_5, best_10 AS count_10, best_15 AS count_15 FROM t_tally", None),
    "acc_09_directional_diversity": (reach.named("diversity"), "SELECT point_id, round(diversity, 6) AS diversity FROM t_tally", "employment"),
    "acc_10_gradient": (reach.named("n", "t10", "t90"), "SELECT point_id, round(CASE WHEN n < 10 THEN 0.5e0 WHEN t10 = 0e0 THEN 1e0 ELSE least(greatest((t90 - t10) / t10 / 5e0, 0e0), 1e0) END, 6) AS gradient FROM t_tally", "healthcare"),
    "acc_11_concentration": (reach.named("count_5", "count_30"), "SELECT o.point_id, o.dest_type, round(CAST(count_5 AS DOUBLE) / nullif(CAST(count_30 AS DOUBLE), 0e0), 6) AS near_share, round(CAST(count_5 AS DOUBLE) / d.n, 6) AS all_share FROM t_tally o JOIN (SELECT dest_type, CAST(count(*) AS DOUBLE) AS n FROM t_dest GROUP BY dest_type) d ON o.dest_type = d.dest_type", None),
    "acc_12_walkability": (reach.named("n", "walk_15", "walk_20", "walk_15_drive_5", "count_5"), "SELECT point_id, dest_type, round(CAST(walk_20 AS DOUBLE) / n, 6) AS share_20, CASE WHEN walk_15 > 0 THEN 1 ELSE 0 END AS any_15, round(CAST(walk_15_drive_5 AS DOUBLE) / nullif(count_5, 0), 6) AS viable FROM t_tally", None),
    "acc_13_impedance": (reach.named("decayed"), "SELECT point_id, dest_type, round(decayed, 6) AS access FROM t_tally", None),
    "acc_14_connectivity": (reach.named("n", "mean_time", "sd_time"), "SELECT point_id, dest_type, round(CASE WHEN n = 1 THEN 0e0 ELSE least(greatest(sd_time / mean_time, 0e0), 1e0) END, 6) AS connectivity FROM t_tally", None),
    "acc_16_modal": (reach.named("min_walk", "min_time", "near_10"), "SELECT point_id, dest_type, round((min_walk + min_time) / 2e0, 6) AS mean_near, round(abs(min_walk - min_time) / 2e0, 6) AS sd_near, near_10 AS n10, round(abs(min_walk - min_time), 6) AS gap, round(CASE WHEN min_time <= 0e0 THEN 1e0 ELSE min_walk / min_time END, 6) AS ratio FROM t_tally", None),
    "acc_18_mode_summary": (reach.named("drive_3km", "walk_3km"), "SELECT p.point_id, round(coalesce(min(o.drive_3km), 120e0), 6) AS drive, round(coalesce(min(o.walk_3km), 120e0), 6) AS walk FROM t_point p LEFT JOIN t_tally o ON p.point_id = o.point_id GROUP BY p.point_id", None),
    "acc_20_distance_selection": ((reach.selected, "dest_id bigint"), "SELECT point_id, dest_id FROM t_tally", "grocery"),
    "sps_12_distance_decay": (reach.named("min_km"), "SELECT dest_type, round(corr(m, truth), 6) AS r FROM (SELECT o.dest_type, o.point_id, min(o.min_km) AS m, min(p.truth) AS truth FROM t_tally o JOIN t_point p ON o.point_id = p.point_id WHERE p.truth IS NOT NULL GROUP BY o.dest_type, o.point_id) GROUP BY dest_type", None),
    "val_01_time_realism": ((reach.modes, reach.MODES), "SELECT dest_type, feature, CAST(sum(negative) AS BIGINT) AS negative, CAST(sum(zero) AS BIGINT) AS zero, CAST(sum(over_180) AS BIGINT) AS over_180, CAST(sum(over_300) AS BIGINT) AS over_300, CAST(sum(plausible) AS BIGINT) AS plausible, round(sum(n * mean) / sum(n), 6) AS mean, round(sqrt(greatest(sum(squares + n * mean * mean) / sum(n) - (sum(n * mean) / sum(n)) * (sum(n * mean) / sum(n)), 0e0)), 6) AS sd, round(min(least), 6) AS least, round(max(most), 6) AS most FROM t_tally GROUP BY dest_type, feature", None),
    # both times and counts of t_access, and of the pairs the times over 300 minutes and the moments of kilometres and minutes
    "val_10_root_causes": (
        reach.named("mean_time", "count_10", "count_15", "p90", "over_300", "n", "mean_km", "squares_km", "squares_time", "products"),
        PLANS["val_10_root_causes"]
        .replace("SELECT count_if(v > 300e0) AS unreal FROM t_times", "SELECT coalesce(sum(over_300), 0) AS unreal FROM t_tally")
        .replace("SELECT dest_type, corr(km, drive_time) AS r FROM t_od GROUP BY dest_type", _CORRELATION)
        .replace("t_access", "t_tally"),
        None,
    ),
    "val_12_pair_counts": (reach.named("n_5km"), "SELECT round(avg(CAST(n AS DOUBLE)), 6) AS mean, max(n) AS most, min(n) AS least, count_if(n > 10) AS over_10, round(avg(CASE WHEN n < 2 THEN 1e0 ELSE 0e0 END), 6) AS under_2 FROM (SELECT point_id, sum(n_5km) AS n FROM t_tally WHERE n_5km > 0 GROUP BY point_id)", None),
}


def _unique(rows: DataFrame, *keys: str) -> bool:
    return rows.groupBy(*keys).count().filter("count > 1").isEmpty()


def _nearest_within(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    """join_07 by nearest: work grows with the points, not with the pairs of a cell."""
    points, dests = (stored(t) for t in _ends(spark, tables))
    found = nearest(points, dests, 1, "point_id", "dest_id").filter("d <= 0.1")
    return found.select(F.col("src").alias("point_id"), F.col("dst").alias("dest_id"), F.round("d", 6).alias("dist"))


def _mode_merge(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    """join_11 from the pairs under 6 km alone, as they are made: where no id repeats, both sides of its join are one pair."""
    points, dests = (stored(t) for t in _ends(spark, tables))
    if "od" in tables or params["reach"] < 12.5 or not _unique(points, "point_id") or not _unique(dests, "dest_id"):
        return bound(spark, PLANS["join_11_mode_merge"], tables, params)
    found = within(points, dests, 1.0 + 1e-9, "point_id", "dest_id")
    sql = """SELECT point_id, dest_id, CASE WHEN w < d THEN 'walk' ELSE 'drive' END AS best_mode, round(CASE WHEN w < d THEN w ELSE d END, 6) AS combined FROM (
 SELECT point_id, dest_id, km / 30e0 * 60e0 + 4e0 AS d, CASE WHEN km < 1.5e0 THEN km / 5e0 * 60e0 END AS w FROM (SELECT src AS point_id, dst AS dest_id, sqrt(dx * dx + dy * dy) * 6e0 AS km FROM {found}) WHERE km < 6e0)"""
    return spark.sql(sql, found=found)


def _all_pairs(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    """join_10 without its pairs: sums of the kilometres from each block of points to all destinations of a type."""
    if "od_all" in tables:
        return bound(spark, PLANS["join_10_od_pairs"], tables, params)
    points, dests = (stored(t) for t in _ends(spark, tables))
    if dests.count() > reach.MOST_DESTS:
        return bound(spark, PLANS["join_10_od_pairs"], {"point": points, "dest": dests}, params)
    kind = dests.schema["dest_type"].dataType.simpleString()
    sums = reach.dealt(points, dests.withColumn("dest_id", F.lit(0)), math.inf, MINUTES, reach.WIDE)(reach.totals, f"dest_type {kind}, n long, km double")
    sql = """SELECT d.dest_type, d.n * p.n AS pairs, round(s.km / s.n, 6) AS mean_km FROM (SELECT dest_type, count(*) AS n FROM {dests} GROUP BY dest_type) d CROSS JOIN (SELECT count(*) AS n FROM {points}) p
 LEFT JOIN (SELECT dest_type, sum(n) AS n, sum(km) AS km FROM {sums} GROUP BY dest_type) s ON d.dest_type <=> s.dest_type WHERE p.n > 0"""
    return spark.sql(sql, points=points, dests=dests, sums=sums)


def _matrix(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    """acc_23 with the base and the modal features from one tally; from two where ids of destinations repeat, as the modal ones
    count pairs of t_od."""
    if "od" in tables or "access" in tables or "base" in tables:
        return bound(spark, statement("acc_23_feature_matrix"), tables, params)
    tally = _tally(spark, dict(tables), params, *reach.named("n", "min_time", "max_time", "mean_time", "sd_time", "median_time", "count_5", "count_10", "count_15", "mean_walk", "min_walk", "near_10"))
    dests = bound(spark, "SELECT dest_id FROM t_dest", dict(tables))
    plain = _unique(dests, "dest_id") and dests.filter("dest_id IS NULL").isEmpty()
    modal = tally if plain else _tally(spark, dict(tables), params, *reach.named("min_time", "min_walk", "near_10"), paired=True)
    unread = "p90, mean_transit, "
    access = bound(spark, _ACCESS.replace(unread, ""), {"tally": tally}, params)
    base = bound(spark, VIEWS["base"].replace(unread, ""), {"access": access}, params)
    modes = _MODES.replace("min(walk_time) AS mw, min(drive_time) AS md, count_if(least(drive_time, walk_time) <= 10e0) AS n10 FROM t_od GROUP BY point_id, dest_type", "min_walk AS mw, min_time AS md, near_10 AS n10 FROM t_tally")
    return bound(spark, statement("acc_23_feature_matrix").replace(_MODES, modes), tables | {"tally": modal, "base": base}, params)


def _time_check(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    """val_11 without its rows for each pair and mode: quartiles and moments of the distances in the tasks of blocks."""
    points, dests = (stored(t) for t in _ends(spark, tables))
    if {"od", "times", "time_quartile"} & set(tables) or dests.count() > reach.MOST_DESTS:
        return bound(spark, PLANS["val_11_distance_time_check"], tables, params)
    points, plain = _parted(spark, points, dests, params)
    over = reach.dealt(points, _paired(dests), params["reach"], MINUTES)
    rows = stored(reduce(DataFrame.unionByName, plain).select("km")) if plain else spark.createDataFrame([], "km double")
    wanted, means = together.percentiles(over, rows, params["reach"], QUANTILES["time_quartile"][1])
    fences = {mode: (q["q1"] - 1.5 * (q["q3"] - q["q1"]), q["q3"] + 1.5 * (q["q3"] - q["q1"])) for mode, q in wanted.items()}
    found = spark.createDataFrame(together.correlated(over, rows, params["reach"], fences, means) if fences else [], "mode string, n long, r double")
    return spark.sql("SELECT mode, n, round(r, 6) AS r, n >= 10 AND round(r, 9) >= 0.4e0 AS ok FROM {found}", found=found)


#: Pairs of a type that the first cut of val_02 would leave of all of them, and how much wider the next cut is.
FIRST_PAIRS, WIDER = 4096, 64


def _time_distance(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    """val_02 over the pairs of t_od with the smallest md5: its statement takes the first hundred of a type, so a cut that
    leaves as many of each type leaves them all; types with fewer go on with a wider one, up to all of their pairs."""
    name, last = "val_02_time_distance", (1 << 32) - 1
    points, dests = (stored(t) for t in _ends(spark, tables))
    if "od" in tables or dests.count() > reach.MOST_DESTS:
        return bound(spark, PLANS[name], tables, params)
    whole = points.filter("point_id IS NOT NULL")
    blank = points.filter("point_id IS NULL")  # no md5
    own, plain = _parted(spark, whole, dests, params)
    if not blank.isEmpty():
        plain.append(_od(spark, {"point": blank, "dest": dests}, params))
    kinds = {c: t.schema[c].dataType.simpleString() for t in (points, dests) for c in t.columns}
    sizes = {r["dest_type"]: r["count"] for r in dests.groupBy("dest_type").count().collect()}  # a few types
    cut = min(last, (FIRST_PAIRS << 32) // max(1, points.count() * max(sizes.values(), default=1)))
    text = own.withColumn("point_id", F.col("point_id").cast("string"))
    todo, done = _paired(dests).withColumn("dest_id", F.col("dest_id").cast("string")), []
    among = lambda some: reduce(lambda a, k: a | F.col("dest_type").eqNullSafe(F.lit(k)), some, F.lit(False))
    mark = "md5(CAST(point_id AS STRING) || '-' || CAST(dest_id AS STRING))"
    while sizes:
        found = reach.dealt(text, todo, params["reach"], MINUTES)(together.marked(params["reach"], cut), f"point_id string, dest_id string, dest_type {kinds['dest_type']}, dx double, dy double")
        typed = f"SELECT {TIMES} FROM (SELECT CAST(point_id AS {kinds['point_id']}) AS point_id, CAST(dest_id AS {kinds['dest_id']}) AS dest_id, dest_type, dx, dy, sqrt(dx * dx + dy * dy) * 6e0 AS km FROM {{found}})"
        some = reduce(DataFrame.unionByName, [p.filter(f"{mark} IS NULL OR substring({mark}, 1, 8) <= '{cut:08x}'") for p in plain], spark.sql(typed, found=found))
        some = stored(some.filter(among(sizes)))
        counts = {r["dest_type"]: r["count"] for r in some.groupBy("dest_type").count().collect()}
        enough = [k for k in sizes if cut == last or counts.get(k, 0) >= 100]
        done.append(some.filter(among(enough)))
        sizes = {k: n for k, n in sizes.items() if k not in enough}
        todo, cut = todo.filter(among(sizes)), min(last, (cut + 1) * WIDER)
    od = reduce(DataFrame.unionByName, done) if done else _od(spark, {"point": points, "dest": dests}, params)
    return bound(spark, PLANS[name], tables | {"od": od}, params)


def _dispersion(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    found = pairs.dispersion(bound(spark, "SELECT dest_id, dest_type, x, y FROM t_dest", tables), "dest_type", "dest_id")
    return found.select("dest_type", F.round("mean_distance", 6).alias("mean_distance"), "pairs")


#: Plans that are built in another way than by their statement.
REBUILT: dict[str, Callable[[SparkSession, dict[str, DataFrame], Params], DataFrame]] = {"acc_23_feature_matrix": _matrix, "join_10_od_pairs": _all_pairs, "join_07_nearest_within": _nearest_within, "join_11_mode_merge": _mode_merge, "val_02_time_distance": _time_distance, "val_11_distance_time_check": _time_check, "sps_13_destination_dispersion": _dispersion}

#: Centroids that the tasks of the inverse distance means hold, and distances at once.
MOST_CENTROIDS, HELD = 5000, 1 << 20


def _idw(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    """(point_id, area_id, t, v) of IDW: each point's eight nearest centroids of other areas, found without a row for each."""
    points, areas = (bound(spark, f"SELECT * FROM t_{t}", tables) for t in ("point", "area"))
    areas = stored(areas.select("area_id", "target", "minx", "miny"))
    if areas.count() > MOST_CENTROIDS or not _unique(areas, "area_id") or not _unique(points, "point_id"):
        return bound(spark, IDW, tables | {"point": points, "area": areas}, params)
    # a few thousand rows at most, by id so that a stable sort leaves ties to the smaller one
    known = areas.filter("target IS NOT NULL AND area_id IS NOT NULL").orderBy("area_id").toPandas()
    ids, target, cx, cy = known["area_id"].to_numpy(), known["target"].to_numpy(float), known["minx"].to_numpy(float) + 0.5, known["miny"].to_numpy(float) + 0.5

    def means(parts):
        for part in parts:
            step = max(1, HELD // max(1, len(ids)))
            for i in range(0, len(part), step):
                some = part.iloc[i : i + step]
                dx, dy = some["x"].to_numpy(float)[:, None] - cx, some["y"].to_numpy(float)[:, None] - cy
                d2, own = dx * dx + dy * dy, some["area_id"].to_numpy()[:, None] == ids
                first = np.argsort(np.where(own, np.inf, d2), axis=1, kind="stable")[:, :8]
                w = np.where(np.take_along_axis(own, first, axis=1), 0.0, 1.0 / (np.take_along_axis(d2, first, axis=1) + 1e-9))
                v = (w * target[first]).sum(axis=1) / np.where(w.sum(axis=1) == 0.0, np.nan, w.sum(axis=1))
                yield pd.DataFrame({"point_id": some["point_id"], "area_id": some["area_id"], "t": some["t"], "v": v})[(~own).any(axis=1)]

    rows = points.select("point_id", "area_id", "x", "y").join(areas.select("area_id", F.col("target").alias("t")).hint("broadcast"), "area_id")
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("point_id", "area_id")}
    return rows.mapInPandas(means, f"point_id {kinds['point_id']}, area_id {kinds['area_id']}, t double, v double")


def _inside(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    return contains(bound(spark, "SELECT point_id, x, y FROM t_point", tables), bound(spark, "SELECT poly_id, ring, seq, x, y FROM t_corner", tables))


def _band(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    cut = (bound(spark, "SELECT cut FROM t_band_width", tables).first() or {"cut": None})["cut"]
    points = bound(spark, "SELECT point_id, area_id, x, y FROM t_point", tables)
    return band(points, cut if cut is not None else 0.0, "point_id", "area_id")


def _boot(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    rows = stored(bound(spark, "SELECT * FROM t_paired", tables, params))
    few = resampling.bootstrap(rows.filter(F.col("n") <= resampling.MOST_ROWS), params["draws"])
    many = rows.filter(F.col("n") > resampling.MOST_ROWS)
    return few if many.isEmpty() else few.unionByName(bound(spark, VIEWS["boot"], {"paired": many}, params))


def _ordered(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
    keys = ["method", "area_id", "subarea_id"]
    rows = stored(bound(spark, "SELECT method, area_id, subarea_id, truth, value FROM t_pred WHERE truth IS NOT NULL", tables, params))
    large = rows.groupBy(*keys).count().filter(F.col("count") > pairs.MOST_ROWS).select(*keys)
    if large.isEmpty():
        return pairs.ordered(rows, keys, params["gap"], 0.02)
    # groups that no task should hold: the definition by a join
    large = sized(stored(large))
    few, many = (rows.join(large, keys, how) for how in ("left_anti", "left_semi"))
    return pairs.ordered(few, keys, params["gap"], 0.02).unionByName(bound(spark, VIEWS["ordered"], {"pred": many}, params))


def _resampled(name: str, of: Callable[[DataFrame, DataFrame, int], DataFrame], values: str = "centred"):
    def run(spark: SparkSession, tables: dict[str, DataFrame], params: Params) -> DataFrame:
        points = stored(bound(spark, f"SELECT point_id, area_id, z FROM t_{values}", tables, params))
        edges = stored(bound(spark, "SELECT area_id, src, dst, w FROM t_weight", tables, params))
        large = points.groupBy("area_id").count().filter(F.col("count") > resampling.MOST_ROWS).select("area_id")
        if large.isEmpty():
            return of(points, edges, params["permutations"])
        # areas that no task should hold: the definition by joins
        large = sized(stored(large))
        few, many = ([t.join(large, "area_id", how) for t in (points, edges)] for how in ("left_anti", "left_semi"))
        return of(*few, params["permutations"]).unionByName(bound(spark, VIEWS[name], {values: many[0], "weight": many[1]}, params))

    return run


BUILT: dict[str, Callable[[SparkSession, dict[str, DataFrame], Params], DataFrame]] = {"near16": _near16, "snap": _snap, "near_dest": _near_dest, "local": _local, "od": _od, "access": _access, "inside": _inside, "band": _band, "boot": _boot, "ordered": _ordered, "idw": _idw, "permuted_top": _resampled("permuted_top", resampling.permuted_moran), "permuted_pred_top": _resampled("permuted_pred_top", resampling.permuted_moran, "centred_pred"), "local_p": _resampled("local_p", resampling.permuted_local)}


for _name, (_source, _wanted) in QUANTILES.items():
    BUILT[_name] = lambda spark, tables, params, source=_source, wanted=_wanted: quantiles.percentiles(bound(spark, source, tables, params), wanted)


def opened(spark: SparkSession, folder: str, sql: str) -> dict[str, DataFrame]:
    """The base tables below a statement, from the star schema's Parquet files."""
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in needed(sql)}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The plan over the star schema's Parquet files; only the tables that it needs are opened."""
    return planned(spark, name, opened(spark, folder, PLANS[name]))


def table(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Any statement over logical tables of the star schema's Parquet files."""
    return bound(spark, sql, opened(spark, folder, sql))


def needed(sql: str) -> list[str]:
    """The base tables below a statement."""
    out: list[str] = []
    for t in tables_of(sql):
        out += [t] if t in BASE else needed(VIEWS[t])
    return list(dict.fromkeys(out))


def portable(sql: str) -> str:
    """The statement with its logical tables as common table expressions over plain base tables."""
    order: list[str] = []

    def visit(text: str) -> None:
        for t in tables_of(text):
            if t in VIEWS and t not in order:
                visit(VIEWS[t])
                order.append(t)

    visit(sql)
    plain = lambda s: _NAME.sub(lambda m: m[0] if m[1] in VIEWS else m[1], filled(s))
    head = ", ".join(f"t_{t} AS ({plain(VIEWS[t])})" for t in order)
    body = plain(sql).strip()
    if head and body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}" if head else body
