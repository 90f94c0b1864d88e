"""Regression and clustering over all areas at once: aggregated normal equations, and Spark ML."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from . import boosting

ALPHAS = tuple(10 ** (k / 2 - 3) for k in range(13))


def standardised(points: DataFrame, features: list[str], group: str) -> DataFrame:
    """Each feature as its z-score within the group; constant ones become 0."""
    over = Window.partitionBy(group)
    out = points
    for f in features:
        sd = F.stddev_pop(f).over(over)
        out = out.withColumn(f, F.when(sd > 1e-8, (F.col(f) - F.avg(f).over(over)) / sd).otherwise(F.lit(0.0)))
    return out


def ridge_leave_one_out(points: DataFrame, features: list[str], target: str, group: str, key: str, folds: int = 5) -> DataFrame:
    """(key, group, alpha, predicted): each row's prediction without itself, by ridge in its group.

    The normal equations are sums, so a group reaches one task as one row of d x d numbers for each fold, never as
    its points. The penalty of a group is the one with the least cross-validated error, which these sums give too.
    Features that do not vary in a group count as 0.
    """
    rows = standardised(points.filter(F.col(target).isNotNull()), features, group).select(F.col(key).alias("key"), F.col(group).alias("group"), F.col(target).cast("double").alias("y"), F.array(F.lit(1.0), *features).alias("x"))
    d = len(features) + 1
    sums = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(d) for j in range(d)] + [F.sum(F.col("x")[i] * F.col("y")) for i in range(d)] + [F.sum(F.col("y") * F.col("y"))]
    gram = rows.groupBy("group", F.pmod(F.xxhash64("key"), F.lit(folds)).alias("fold")).agg(F.array(*sums).alias("g"))
    kind = rows.schema["group"].dataType.simpleString()
    penalty = np.diag([1e-9] + [1.0] * (d - 1))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        g = np.stack(part["g"])
        xx, xy, yy = g[:, : d * d].reshape(-1, d, d), g[:, d * d : -1], g[:, -1]
        errors = []
        for alpha in ALPHAS:
            error = 0.0
            for k in range(len(g)):
                beta = np.linalg.solve(xx.sum(0) - xx[k] + alpha * penalty + 1e-9 * np.eye(d), xy.sum(0) - xy[k])
                error += yy[k] - 2 * beta @ xy[k] + beta @ xx[k] @ beta
            errors.append(error)
        alpha = ALPHAS[int(np.argmin(errors))]
        inverse = np.linalg.inv(xx.sum(0) + alpha * penalty)
        return pd.DataFrame([(part["group"].iloc[0], alpha, inverse.ravel().tolist(), (inverse @ xy.sum(0)).tolist())], columns=["group", "alpha", "inverse", "beta"])

    fits = gram.groupBy("group").applyInPandas(solve, f"`group` {kind}, alpha double, inverse array<double>, beta array<double>")
    x, b = F.col("x"), F.col("beta")
    hat = sum((x[i] * x[j] * F.col("inverse")[i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))
    fitted = sum((x[i] * b[i] for i in range(d)), F.lit(0.0))
    scored = rows.join(fits.hint("merge"), "group").withColumn("predicted", F.col("y") - (F.col("y") - fitted) / F.greatest(1 - hat, F.lit(1e-9)))
    return scored.select(F.col("key").alias(key), F.col("group").alias(group), "alpha", "predicted")


def assembled(points: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(points)


def recovery(points: DataFrame, features: list[str], targets: list[str], group: str, key: str, rounds: int = boosting.ROUNDS) -> DataFrame:
    """(target, model, group, n, r, rmse): both models' held-out predictions for each target.

    A target that is itself a feature is held out of them; any other column is an external one.
    """
    out = None
    for target in targets:
        use = [f for f in features if f != target]
        own = points.withColumn("_y", F.col(target).cast("double"))
        ridge = ridge_leave_one_out(own, use, "_y", group, key).select(key, "predicted", F.lit("ridge").alias("model"))
        trees = boosting.out_of_fold(own, use, "_y", group, key, rounds).select(key, "predicted", F.lit("boosted").alias("model"))
        scored = stored(ridge.unionByName(trees)).join(own.select(key, group, "_y").hint("merge"), key)
        r = F.try_divide(F.covar_pop("predicted", "_y"), F.nullif(F.stddev_pop("predicted") * F.stddev_pop("_y"), F.lit(0.0)))
        part = scored.groupBy("model", group).agg(F.count(F.lit(1)).alias("n"), r.alias("r"), F.sqrt(F.avg((F.col("predicted") - F.col("_y")) ** 2)).alias("rmse")).withColumn("target", F.lit(target))
        out = part if out is None else out.unionByName(part)
    return out


def redundancy(points: DataFrame, candidates: list[str], features: list[str], group: str, key: str, areas: int = 10, least: float = 0.5, seed: int = 7, rounds: int = boosting.ROUNDS) -> DataFrame:
    """(target, ridge, boosted, admissible): median r of each candidate target over some groups in a seeded order.

    A candidate is admissible if no model recovers it with a median of `least` or more. Choosing groups is the feature.
    """
    some = points.select(group).distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(group).cast("string"))), group).limit(areas)
    found = recovery(points.join(F.broadcast(some), group), features, candidates, group, key, rounds)
    wide = found.groupBy("target").agg(*(F.median(F.when(F.col("model") == m, F.col("r"))).alias(m) for m in ("ridge", "boosted")))
    return wide.withColumn("admissible", F.greatest(F.coalesce("ridge", F.lit(0.0)), F.coalesce("boosted", F.lit(0.0))) < least)


def leakage(points: DataFrame, features: list[str], target: str, group: str, key: str, adjacent: list[str], rounds: int = boosting.ROUNDS) -> DataFrame:
    """(group, r_in_sample, r_out_of_fold, r_leave_one_out, adjacent_rank): what a model seems to know of its own rows.

    adjacent_rank is the best place, by split shares, of the features suspected of standing close to the target.
    """
    ways = {
        "in_sample": boosting.out_of_fold(points, features, target, group, key, rounds, folds=1),
        "out_of_fold": boosting.out_of_fold(points, features, target, group, key, rounds),
        "leave_one_out": ridge_leave_one_out(points, features, target, group, key),
    }
    both = None
    for name, df in ways.items():
        part = df.select(key, "predicted", F.lit(name).alias("way"))
        both = part if both is None else both.unionByName(part)
    scored = stored(both).join(points.select(key, group, F.col(target).alias("_y")).hint("merge"), key)
    r = F.try_divide(F.covar_pop("predicted", "_y"), F.nullif(F.stddev_pop("predicted") * F.stddev_pop("_y"), F.lit(0.0)))
    wide = scored.groupBy(group, "way").agg(r.alias("r")).groupBy(group).agg(*(F.max(F.when(F.col("way") == w, F.col("r"))).alias(f"r_{w}") for w in ways))
    place = F.rank().over(Window.partitionBy(group).orderBy(F.desc("share"), "feature"))
    ranks = boosting.split_shares(points, features, target, group, key, rounds).withColumn("place", place).filter(F.col("feature").isin(*adjacent)).groupBy(group).agg(F.min("place").alias("adjacent_rank"))
    return wide.join(ranks.hint("merge"), group, "left")


#: Rows that one task of a forest reads in each pass.
FOREST_ROWS = 100_000


def forest(points: DataFrame, features: list[str], target: str, trees: int = 100):
    """A fitted random forest and its table of rows."""
    rows = assembled(points.filter(F.col(target).isNotNull()), features)
    parts = -(-rows.count() // FOREST_ROWS)
    if parts > 1:  # the files' own splits may be few and large, and the trees' points are cached as they come
        rows = rows.repartition(parts, *features)
    return RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=6, seed=1).fit(rows), rows


def forest_importance(points: DataFrame, features: list[str], target: str, trees: int = 100) -> DataFrame:
    """(feature, importance, place, top, r2) of a random forest."""
    model, rows = forest(points, features, target, trees)
    ranked = sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    table = points.sparkSession.createDataFrame([(f, w, i + 1, i < 3) for i, (f, w) in enumerate(ranked)], "feature string, importance double, place int, top boolean")
    r2 = model.transform(rows).agg((1 - F.avg((F.col(target) - F.col("prediction")) ** 2) / F.var_pop(target)).alias("r2"))
    return table.crossJoin(F.broadcast(r2))  # one row


def principal_components(points: DataFrame, features: list[str], target: str, k: int = 5) -> DataFrame:
    """(component, variance_ratio, r, loadings): the first k components of standardised features and their r with the target."""
    k = min(k, len(features))
    rows = assembled(points, features)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="scaled", outputCol="pcs").fit(scaled)
    pcs = vector_to_array("pcs")
    found = model.transform(scaled).agg(*(F.corr(pcs[i], F.col(target).cast("double")).alias(f"r{i}") for i in range(k))).first()
    loadings = model.pc.toArray()
    made = [(i + 1, float(model.explainedVariance[i]), found[f"r{i}"], dict(zip(features, loadings[:, i].tolist(), strict=True))) for i in range(k)]
    return points.sparkSession.createDataFrame(made, "component int, variance_ratio double, r double, loadings map<string,double>")


def spatial_clusters(points: DataFrame, value: str, k: int | None = None) -> DataFrame:
    """(cluster, n, mean, variance, within, between, between_share) of k-means on the coordinates.

    k is a tenth of the points by default, one at least and five at most. within and between split the variance of the
    value over all points that have one: the clusters' variances and the squared distances of their means, both
    weighted by n. Points without a value count for the clusters, not for the split.
    """
    rows = assembled(points, ["x", "y"])
    k = max(1, min(5, rows.count() // 10)) if k is None else k
    placed = KMeans(k=k, seed=1).fit(rows).transform(rows) if k > 1 else rows.withColumn("prediction", F.lit(0))
    found = placed.groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.count(value).alias("_w"))
    every = Window.partitionBy()  # a row for each cluster
    share = F.col("_w") / F.sum("_w").over(every)
    middle = F.sum(share * F.col("mean")).over(every)
    split = found.withColumn("_m", middle).withColumns({"within": F.sum(share * F.col("variance")).over(every), "between": F.sum(share * (F.col("mean") - F.col("_m")) ** 2).over(every)})
    return split.withColumn("between_share", F.try_divide("between", F.col("within") + F.col("between"))).drop("_w", "_m")


def permutation_importance(points: DataFrame, features: list[str], target: str, group: str, key: str, repeats: int = 3, trees: int = 20) -> DataFrame:
    """(feature, change, share, place): growth of the areas' constraint error when a feature's values change places.

    The constraint error is the mean over groups of |mean prediction - mean target| in per cent of the target. Values
    change places by joining the rows' ranks in two hashed orders, within parts of about a thousand rows; the row
    `all` scrambles every feature at once. share is the change among the sum of the features' absolute changes.
    """
    rows = points.filter(F.col(target).isNotNull()).select(key, group, target, *features)
    parts = max(1, rows.count() // 1000)
    rows = stored(rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))))
    model, _ = forest(rows, features, target, trees)
    made = rows.select(group, target, *features, F.lit("none").alias("feature"), F.lit(0).alias("repeat"))
    for repeat in range(repeats):
        place = lambda f, repeat=repeat: F.row_number().over(Window.partitionBy("_part").orderBy(F.md5(F.concat(F.lit(f"{repeat}-{f}-"), F.col(key).cast("string")))))
        base = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
        for name, moved in [*((f, [f]) for f in features), ("all", features)]:
            own = base
            for f in moved:
                own = own.drop(f).join(rows.select("_part", f, place(f).alias("_n")).hint("merge"), ["_part", "_n"])
            made = made.unionByName(own.select(group, target, *features, F.lit(name).alias("feature"), F.lit(repeat).alias("repeat")))
    scored = model.transform(assembled(made, features)).groupBy("feature", "repeat", group).agg(F.avg("prediction").alias("p"), F.avg(target).alias("t"))
    errors = scored.groupBy("feature", "repeat").agg(F.avg(100 * F.abs(F.col("p") - F.col("t")) / F.greatest(F.abs("t"), F.lit(1e-6))).alias("e")).groupBy("feature").agg(F.avg("e").alias("e"))
    errors = stored(errors)
    base = errors.filter("feature = 'none'").select(F.col("e").alias("base"))
    change = errors.filter("feature <> 'none'").crossJoin(F.broadcast(base)).select("feature", (F.col("e") - F.col("base")).alias("change"))  # one row
    total = change.filter("feature <> 'all'").agg(F.sum(F.abs("change")).alias("total"))
    return change.crossJoin(F.broadcast(total)).select("feature", "change", F.try_divide("change", "total").alias("share"), F.row_number().over(Window.orderBy(F.desc("change"), "feature")).alias("place"))


def guided(points: DataFrame, areas: DataFrame, features: list[str], key: str = "point_id") -> DataFrame:
    """(key, area_id, value): scores learned from area means alone, shifted so that each area keeps its target.

    The design matrix has a row for each area: its mean features against its target. No point's truth is read.
    """
    means = points.groupBy("area_id").agg(*(F.avg(f).alias(f) for f in features)).join(areas.select("area_id", F.col("target").cast("double").alias("target")).hint("merge"), "area_id").filter("target IS NOT NULL")
    model = LinearRegression(labelCol="target", regParam=0.1).fit(assembled(means, features))
    scored = stored(model.transform(assembled(points, features)).select(key, "area_id", "prediction"))
    shift = scored.groupBy("area_id").agg(F.avg("prediction").alias("m")).join(areas.select("area_id", "target").hint("merge"), "area_id")
    return scored.join(shift.hint("merge"), "area_id").select(key, "area_id", (F.col("prediction") + F.coalesce(F.col("target") - F.col("m"), F.lit(0.0))).alias("value"))


def uncorrelated(pairs: DataFrame, features: list[tuple[str, int]], most: float = 0.99) -> list[str]:
    """The features that stay when of each pair with |r| >= most (f1, f2, r) the one of later priority goes, greedily.

    Only pairs at the bound reach the driver: features are columns, a few thousand at most.
    """
    near = {}
    for r in pairs.filter(F.abs("r") >= most).select("f1", "f2").collect():
        near.setdefault(r["f1"], set()).add(r["f2"])
        near.setdefault(r["f2"], set()).add(r["f1"])
    kept: list[str] = []
    for name, _ in sorted(features, key=lambda f: (f[1], f[0])):
        if not near.get(name, set()) & set(kept):
            kept.append(name)
    return kept
