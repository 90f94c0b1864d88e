"""Queries over models and iterative operators, whose results one SQL statement cannot give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import catalog
from ..plans.catalog import table
from ..sources import sinks
from ..sources.stored import shared_dir, stored
from . import methods, models, paths, pvalues, switches

FEATURES = ["ancillary", "x", "y", "block", "east", "north"]
METRES = catalog.DEFAULTS["metres"]
_POINTS = "SELECT point_id, area_id, x, y, coalesce(ancillary, 0e0) AS ancillary, CAST(point_id % 7 AS DOUBLE) AS block, x - floor(x) AS east, y - floor(y) AS north, truth FROM t_point"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _POINTS)


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "SELECT area_id, target, minx, miny FROM t_area")


def _all(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, f"SELECT * FROM t_{name}")


def mlr_01_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.ridge_leave_one_out(_points(spark, sf_dir), FEATURES, "truth", "area_id", "point_id")


def mlr_02_boosted_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.boosting.out_of_fold(_points(spark, sf_dir), FEATURES, "truth", "area_id", "point_id")


def mlr_03_recovery_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An external target, and one feature held out of the others."""
    return models.recovery(_points(spark, sf_dir), FEATURES, ["truth", "ancillary"], "area_id", "point_id")


def mlr_04_redundancy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.redundancy(_points(spark, sf_dir), ["ancillary", "east", "block"], FEATURES, "area_id", "point_id")


def mlr_06_leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.leakage(_points(spark, sf_dir), FEATURES, "truth", "area_id", "point_id", ["ancillary", "east"])


def mlr_07_permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.permutation_importance(_points(spark, sf_dir), FEATURES, "truth", "area_id", "point_id")


def mlr_08_forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.forest_importance(_points(spark, sf_dir), FEATURES, "truth")


def mlr_09_principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.principal_components(_points(spark, sf_dir), FEATURES, "truth")


def sps_11_spatial_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.spatial_clusters(_points(spark, sf_dir), "truth")


def dis_04_pycnophylactic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methods.pycnophylactic(_all(spark, sf_dir, "point"), _all(spark, sf_dir, "area"))


def dis_06_kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return methods.kriging(_points(spark, sf_dir), _areas(spark, sf_dir))


def dis_11_registered_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered method fitted, scored and compared."""
    return methods.compare(_all(spark, sf_dir, "point"), _all(spark, sf_dir, "area"))


def dis_13_regression_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.guided(_points(spark, sf_dir), _areas(spark, sf_dir), ["ancillary", "block", "east", "north"])


def udf_04_switched_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap, spread and correlation with the truth of a regression under each feature mode and graph, over all areas."""
    points, areas = stored(_points(spark, sf_dir)), stored(_areas(spark, sf_dir))
    roads = grf_06_road_knn(spark, sf_dir).select("src", "dst", F.lit(1.0).alias("w"))
    features = ("ancillary", "block", "east", "north")
    runs = [(mode, "none") for mode in switches.FEATURE_MODES] + [("full", graph) for graph in switches.GRAPHS if graph != "none"]
    found = None
    for mode, graph in runs:
        made = methods.Settings(method="regression", features=features, feature_mode=mode, graph=graph).run(points, areas, roads)
        made = made.select(F.lit(mode).alias("feature_mode"), F.lit(graph).alias("graph"), "point_id", "area_id", "value")
        found = made if found is None else found.unionByName(made)
    rows = found.join(points.select("point_id", "truth").hint("merge"), "point_id").join(areas.select("area_id", "target").hint("merge"), "area_id")
    r = F.try_divide(F.covar_pop("value", "truth"), F.nullif(F.stddev_pop("value") * F.stddev_pop("truth"), F.lit(0.0)))
    by_area = rows.groupBy("feature_mode", "graph", "area_id").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("value") - F.max("target")).alias("gap"), F.stddev_pop("value").alias("sd"), r.alias("r"))
    return by_area.groupBy("feature_mode", "graph").agg(F.count(F.lit(1)).alias("areas"), F.sum("n").alias("points"), *(F.avg(c).alias(c) for c in ("gap", "sd", "r")))


def acc_22_spatial_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that no earlier kept point lies within 100 m of."""
    return paths.thinned(_points(spark, sf_dir), 100 / METRES).select("point_id", "x", "y")


def grf_05_network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapped = table(spark, sf_dir, "SELECT point_id, node FROM t_snap WHERE d * $metres <= 500e0")
    reached = paths.shortest_paths(_all(spark, sf_dir, "road"), snapped.select(F.col("node").alias("src")), 1500.0)
    return paths.network_edges(_all(spark, sf_dir, "near16"), snapped, reached, METRES)


def grf_06_road_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapped = table(spark, sf_dir, "SELECT point_id, CASE WHEN d * $metres <= 500e0 THEN node END AS node FROM t_snap")
    return paths.road_knn(_points(spark, sf_dir), snapped, _all(spark, sf_dir, "road"), 4, METRES)


def grf_07_bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road lengths of up to 1,500 m from every node of the road table."""
    road = _all(spark, sf_dir, "road")
    return paths.shortest_paths(road, road.select("src"), 1500.0)


def grf_10_rewired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.rewired(table(spark, sf_dir, "SELECT src, dst FROM t_near"))


def grf_13_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM t_near")
    return paths.spectral(edges)


def set_04_neighbour_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planar against road neighbours: |both| / |either| of each point, averaged by area."""
    planar = table(spark, sf_dir, "SELECT src, dst, true AS a FROM t_near WHERE nth <= 4")
    road = grf_06_road_knn(spark, sf_dir).select("src", "dst", F.lit(True).alias("b"))
    each = planar.join(road.hint("merge"), ["src", "dst"], "full").groupBy("src").agg((F.count_if(F.col("a") & F.col("b")) / F.count(F.lit(1))).alias("j"))
    areas = _points(spark, sf_dir).select(F.col("point_id").alias("src"), "area_id")
    return each.join(areas.hint("merge"), "src").groupBy("area_id").agg(F.avg("j").alias("jaccard"))


def sta_02_pearson_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.read(spark, sf_dir, "sta_01_pearson")
    return rows.withColumn("p", pvalues.column(pvalues.pearson, "r", "n"))


_SIGNED = """SELECT feature, count(*) AS n, sum(CASE WHEN rho > 0e0 THEN place ELSE 0e0 END) AS plus, sum(CASE WHEN nth = 1 THEN CAST(m AS DOUBLE) * m * m - m ELSE 0e0 END) AS ties FROM (
 SELECT feature, rho, rank() OVER (PARTITION BY feature ORDER BY size_) + (count(*) OVER (PARTITION BY feature, size_) - 1) / 2e0 AS place, count(*) OVER (PARTITION BY feature, size_) AS m, row_number() OVER (PARTITION BY feature, size_ ORDER BY area_id) AS nth
 FROM (SELECT feature, area_id, rho, round(abs(rho), 12) AS size_ FROM t_rho WHERE rho <> 0e0 AND NOT isnan(rho))) GROUP BY feature"""
_SUMMARY = """SELECT feature, count(*) AS areas, avg(rho) AS mean, median(rho) AS middle, percentile_cont(0.75) WITHIN GROUP (ORDER BY rho) - percentile_cont(0.25) WITHIN GROUP (ORDER BY rho) AS iqr, count_if(rho > 0e0) AS positive, count_if(rho < 0e0) AS negative
FROM t_rho WHERE NOT isnan(rho) GROUP BY feature HAVING count(*) >= 5"""


def rank_consistency(summary: DataFrame, signed: DataFrame) -> DataFrame:
    """The summary of rank correlations with both tests' p values and the flag of consistent features."""
    rows = summary.join(signed.hint("merge"), "feature")
    rows = rows.withColumn("sign_p", pvalues.column(pvalues.sign, "positive", F.col("positive") + F.col("negative"))).withColumn("wilcoxon_p", pvalues.column(pvalues.wilcoxon, "plus", "n", "ties"))
    return rows.drop("n", "plus", "ties").withColumn("consistent", (F.col("sign_p") < 0.05) & (F.abs("middle") >= 0.1))


def sta_13_rank_consistency_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_consistency(table(spark, sf_dir, _SUMMARY), table(spark, sf_dir, _SIGNED))


def sta_15_wilcoxon_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank test of each method's error against the uniform one, paired by area."""
    sql = """SELECT method, count(*) AS n, sum(CASE WHEN d > 0e0 THEN place ELSE 0e0 END) AS plus, sum(CASE WHEN nth = 1 THEN CAST(m AS DOUBLE) * m * m - m ELSE 0e0 END) AS ties FROM (
 SELECT method, d, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2e0 AS place, count(*) OVER (PARTITION BY method, abs(d)) AS m, row_number() OVER (PARTITION BY method, abs(d) ORDER BY area_id) AS nth
 FROM (SELECT m.method, m.area_id, round(m.rmse - b.rmse, 9) AS d FROM t_metric m JOIN t_metric b ON m.area_id = b.area_id AND b.method = 'naive' WHERE m.method <> 'naive') WHERE d <> 0e0) GROUP BY method"""
    one = pvalues.column(pvalues.wilcoxon_less, "plus", "n", "ties").alias("p_less")
    return table(spark, sf_dir, sql).select("method", "n", "plus", pvalues.column(pvalues.wilcoxon, "plus", "n", "ties").alias("p"), one)


def sta_20_uncorrelated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = catalog.read(spark, sf_dir, "sta_19_correlation_matrix").select("f1", "f2", "r")
    names = [r["feature"] for r in table(spark, sf_dir, "SELECT DISTINCT feature FROM t_feature WHERE feature <> 'flat'").collect()]
    kept = models.uncorrelated(pairs, [(f, 0 if f == "ancillary" else 1) for f in names])
    return spark.createDataFrame([(f, f in kept) for f in sorted(names)], "feature string, kept boolean")


def snk_01_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions, features and area summary as CSV, a JSON summary beside them; what was written, read back."""
    folder = shared_dir(spark)
    tables = {
        "predictions": table(spark, sf_dir, "SELECT method, point_id, area_id, value FROM t_pred"),
        "features": table(spark, sf_dir, "SELECT area_id, point_id, feature, value FROM t_feature"),
        "summary": table(spark, sf_dir, "SELECT method, area_id, n, gap, sd, rmse FROM t_metric"),
    }
    return sinks.results(tables, folder)


def snk_02_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused where a row is missing or a method's correlation is not that of the metrics computed apart from it."""
    rows = table(spark, sf_dir, "SELECT p.method, p.point_id, p.area_id, p.value, p.truth FROM t_pred p")
    points = table(spark, sf_dir, "SELECT count(*) AS n FROM t_point").first()["n"]
    known = table(spark, sf_dir, "SELECT method, sqrt(sum(n * rmse * rmse) / sum(n)) AS rmse FROM t_metric GROUP BY method").collect()
    return sinks.predictions(rows, shared_dir(spark), rows=3 * points, expected={r["method"]: r["rmse"] for r in known})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        mlr_01_ridge, mlr_02_boosted_out_of_fold, mlr_03_recovery_by_model, mlr_04_redundancy_filter, mlr_06_leakage_audit, mlr_07_permutation_importance, mlr_08_forest_importance, mlr_09_principal_components,
        sps_11_spatial_clusters, dis_04_pycnophylactic, dis_06_kriging, dis_11_registered_methods, dis_13_regression_guided, udf_04_switched_runs, acc_22_spatial_dedupe, grf_05_network_edges, grf_06_road_knn, grf_07_bounded_paths,
        grf_10_rewired, grf_13_spectral, set_04_neighbour_jaccard, sta_02_pearson_p, sta_13_rank_consistency_p, sta_15_wilcoxon_p, sta_20_uncorrelated_features, snk_01_results, snk_02_provenance,
    )
}
