"""Feature modes and graph variants of a regression-guided run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import PLANS
from ..plans import catalog
from ..sources.stored import stored
from . import paths
from .neighbours import nearest

FEATURE_MODES = ("full", "coordinates", "noise", "coordinates_noise")
GRAPHS = ("none", "self", "knn", "geographic", "rewired", "given")


def _normal(key: str, nth: int, seed: int) -> Column:
    """A standard normal value from a hash of the row's key, the same in every run."""
    part = lambda at: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-{nth}-"), F.col(key).cast("string"))), at, 8), 16, 10).cast("double")
    return F.sqrt(-2 * F.log((part(1) + 1) / 4294967297.0)) * F.cos(2 * F.pi() * part(9) / 4294967296.0)


def substituted(points: DataFrame, features: list[str], mode: str, key: str = "point_id", seed: int = 42) -> tuple[DataFrame, list[str]]:
    """The points with the features of a mode, and their names.

    full leaves all as they are; coordinates has z-scored x and y alone; noise has as many hashed normal columns as
    there were features; coordinates_noise has both, as many columns in all. Where all x are one, their score is 0.
    """
    if mode not in FEATURE_MODES:
        raise ValueError(f"unknown feature mode: {mode}")
    if mode == "full":
        return points, list(features)
    made: dict[str, Column] = {}
    if mode != "noise":
        middle = points.agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy")).first()
        made = {f"_z{c}": (F.col(c) - F.lit(middle[f"m{c}"])) / F.lit((middle[f"s{c}"] or 0.0) + 1e-8) for c in ("x", "y")}
    if mode != "coordinates":
        made |= {f"_noise{i}": _normal(key, i, seed) for i in range(len(features) - len(made))}
    return points.withColumns(made), list(made)


def graph(points: DataFrame, variant: str, k: int = 10, metres: float | None = None, edges: DataFrame | None = None) -> DataFrame | None:
    """Edges (src, dst, w) among the points of an area: to themselves, to and from the k nearest, near ones by
    distance, those k nearest with edges swapped at equal degrees, or the given edges, of a road network say.
    `none` has no graph."""
    if variant not in GRAPHS:
        raise ValueError(f"unknown graph: {variant}")
    if variant == "given" and edges is None:
        raise ValueError("the graph `given` needs edges")
    if variant in ("none", "given"):
        return edges if variant == "given" else None
    if variant == "self":
        return points.select(F.col("point_id").alias("src"), F.col("point_id").alias("dst"), F.lit(1.0).alias("w"))
    near = nearest(points, points, k, "point_id", "point_id", "area_id", same=True)
    if variant == "rewired":
        pairs = paths.rewired(near.select("src", "dst"))
        return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(1.0).alias("w")))
    plan = {"knn": "grf_01_knn_graph", "geographic": "grf_02_geographic_edges"}[variant]
    return catalog.bound(points.sparkSession, PLANS[plan], {"near": near}, {"metres": metres} if metres else None)


def repaired(points: DataFrame, features: list[str]) -> DataFrame:
    """The points with 0 for null and NaN features, 999 and -999 for infinite ones: no point is left out of a model."""
    x = {f: F.col(f).cast("double") for f in features}
    fixed = {f: F.when(c.isNull() | F.isnan(c), 0.0).when(c == float("inf"), 999.0).when(c == float("-inf"), -999.0).otherwise(c) for f, c in x.items()}
    return points.withColumns(fixed)


def with_neighbour_means(points: DataFrame, features: list[str], edges: DataFrame, key: str = "point_id") -> tuple[DataFrame, list[str]]:
    """The points with a column mean_<feature> for each feature, its weighted mean over the point's neighbours.

    A point without neighbours, or whose neighbours have no value, has its own value there.
    """
    rows = points.select(F.col(key).alias("dst"), *features)
    means = edges.join(rows.hint("merge"), "dst").groupBy("src").agg(*(F.try_divide(F.sum(F.col("w") * F.col(f)), F.sum(F.when(F.col(f).isNotNull(), F.col("w")))).alias(f"mean_{f}") for f in features))
    both = points.join(stored(means).withColumnRenamed("src", key).hint("merge"), key, "left")
    names = [f"mean_{f}" for f in features]
    return both.withColumns({n: F.coalesce(F.col(n), F.col(f)) for n, f in zip(names, features, strict=True)}), [*features, *names]
