"""Allocation methods by name, kriging, and runs that switches select.

A method takes points (point_id, area_id, x, y, ...) and areas (area_id, target, minx, miny) and returns
(point_id, value). Own methods are added with add_method and compared like the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.disaggregation import SEED
from ..plans import catalog
from ..sources.stored import stored
from . import models, paths, switches
from .neighbours import nearest

Method = Callable[[DataFrame, DataFrame], DataFrame]
METHODS: dict[str, Method] = {}
#: Centroids that one dense system may hold.
MOST_CENTROIDS = 2000


def add_method(name: str, method: Method) -> None:
    METHODS[name] = method


def _plan(name: str, value: str) -> Method:
    def run(points: DataFrame, areas: DataFrame) -> DataFrame:
        return catalog.bound(points.sparkSession, f"SELECT point_id, {value} AS value FROM ({catalog.statement(name)})", {"point": points, "area": areas})

    return run


def pycnophylactic(points: DataFrame, areas: DataFrame, k: int = 8, rounds: int = 50) -> DataFrame:
    seed = catalog.bound(points.sparkSession, SEED, {"point": points, "area": areas})
    edges = nearest(points, points, k, "point_id", "point_id", "area_id", same=True)
    return paths.pycnophylactic(seed, edges, rounds).select("point_id", "value")


def kriging(points: DataFrame, areas: DataFrame, nugget: float = 0.01, sill: float = 1.0, reach: float = 1.0) -> DataFrame:
    """Ordinary kriging of area centroids with an exponential variogram, scaled to each area's mean.

    The one dense system of all points is solved on the driver; it has a row for each area, MOST_CENTROIDS at most.
    """
    known = areas.filter("target IS NOT NULL").select("area_id", (F.col("minx") + 0.5).alias("cx"), (F.col("miny") + 0.5).alias("cy"), "target").orderBy("area_id").limit(MOST_CENTROIDS + 1).toPandas()
    n = len(known)
    if n > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} areas: krige regions one by one")
    cx, cy, t = (known[c].to_numpy(float) for c in ("cx", "cy", "target"))
    gamma = lambda h: np.where(h > 0, nugget + sill * (1 - np.exp(-3 * h / reach)), 0.0)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = gamma(np.hypot(cx[:, None] - cx, cy[:, None] - cy))
    system[n, n] = 0
    weights = np.linalg.solve(system, np.append(t, 0.0)) if n else np.zeros(1)  # the system is symmetric

    def estimate(parts):
        for part in parts:
            h = np.hypot(part["x"].to_numpy()[:, None] - cx, part["y"].to_numpy()[:, None] - cy)
            yield pd.DataFrame({"point_id": part["point_id"], "area_id": part["area_id"], "v": gamma(h) @ weights[:n] + weights[n]})

    kinds = {c: points.schema[c].dataType.simpleString() for c in ("point_id", "area_id")}
    raw = points.select("point_id", "area_id", "x", "y").mapInPandas(estimate, f"point_id {kinds['point_id']}, area_id {kinds['area_id']}, v double")
    raw = stored(raw.join(areas.select("area_id", F.col("target").alias("t")).hint("merge"), "area_id"))
    means = raw.groupBy("area_id").agg(F.avg("v").alias("m"))
    scaled = F.when(F.abs("m") > 1e-9, F.col("v") * F.col("t") / F.col("m")).otherwise(F.col("t"))
    return raw.join(means.hint("merge"), "area_id").select("point_id", F.coalesce(scaled, "v").alias("value"))


add_method("uniform", lambda points, areas: points.join(areas.select("area_id", F.col("target").alias("value")).hint("merge"), "area_id").select("point_id", "value"))
add_method("dasymetric", _plan("dis_03_dasymetric", "value"))
add_method("idw", _plan("dis_05_idw", "p"))
add_method("pycnophylactic", pycnophylactic)
add_method("kriging", kriging)


def compare(points: DataFrame, areas: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """(method, areas, gap, sd, r, rmse): how each method keeps the means, varies, and meets the known truth."""
    parts = None
    truth = points.select("point_id", "area_id", "truth").join(areas.select("area_id", "target").hint("merge"), "area_id")
    for name in names or tuple(METHODS):
        part = METHODS[name](points, areas).withColumn("method", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    rows = parts.join(truth.hint("merge"), "point_id")
    by_area = rows.groupBy("method", "area_id").agg(
        F.abs(F.avg("value") - F.max("target")).alias("gap"), F.stddev_pop("value").alias("sd"), F.try_divide(F.covar_pop("value", "truth"), F.nullif(F.stddev_pop("value") * F.stddev_pop("truth"), F.lit(0.0))).alias("r"),
        F.sqrt(F.avg((F.col("value") - F.col("truth")) ** 2)).alias("rmse"),
    )
    return by_area.groupBy("method").agg(F.count(F.lit(1)).alias("areas"), *(F.avg(c).alias(c) for c in ("gap", "sd", "r", "rmse")))


@dataclass(frozen=True)
class Settings:
    """Switches of a run: target column, method, correction of its values, areas in scope, and what a regression reads.

    The method `regression` learns from the columns `features` without those in `dropped`, in one of the feature modes,
    with the means of the features over the neighbours in one of the graphs.
    """

    target: str = "target"
    method: str = "dasymetric"
    correction: str = "shift"  # "none", "shift" or "clip"
    areas: tuple[int, ...] | None = None
    prefix: str = ""  # of the areas' ids, as text
    features: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    feature_mode: str = "full"
    graph: str = "none"
    neighbours: int = 10

    def _regression(self, points: DataFrame, areas: DataFrame, edges: DataFrame | None) -> DataFrame:
        kept = [f for f in self.features if f not in self.dropped]
        if not kept:
            raise ValueError("a regression needs features")
        rows, names = switches.substituted(switches.repaired(points, kept), kept, self.feature_mode)
        links = switches.graph(points, self.graph, self.neighbours, edges=edges)
        if links is not None:
            rows, names = switches.with_neighbour_means(rows, names, links)
        return models.guided(rows, areas, names).select("point_id", "value")

    def run(self, points: DataFrame, areas: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        """(point_id, area_id, value) as the switches say; edges (src, dst, w) are those of the graph `given`."""
        if self.method not in (*METHODS, "regression") or self.correction not in ("none", "shift", "clip") or self.feature_mode not in switches.FEATURE_MODES or self.graph not in switches.GRAPHS:
            raise ValueError(f"unknown switch: {self.method}, {self.correction}, {self.feature_mode}, {self.graph}")
        areas = areas.withColumn("target", F.col(self.target))
        if self.areas is not None:
            areas, points = areas.filter(F.col("area_id").isin(*self.areas)), points.filter(F.col("area_id").isin(*self.areas))
        if self.prefix:
            areas, points = (t.filter(F.col("area_id").cast("string").startswith(self.prefix)) for t in (areas, points))
        value = self._regression(points, areas, edges) if self.method == "regression" else METHODS[self.method](points, areas)
        rows = points.select("point_id", "area_id").join(value.hint("merge"), "point_id").join(areas.select("area_id", F.col("target").alias("t")).hint("merge"), "area_id")
        rows = rows.select("point_id", "area_id", "t", F.col("value").alias("v"))
        if self.correction != "none":
            rows = paths.recentred(rows)
        if self.correction == "clip":
            rows = paths.clipped(paths.recentred(paths.clipped(rows)))
        return rows.select("point_id", "area_id", F.col("v").alias("value"))
