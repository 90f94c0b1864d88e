"""Boosted trees for every area at once, scored out of fold."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Defaults: trees, their depth, learning rate, share of rows a tree sees, folds, least rows of an area, bins of a
#: feature, rows of an area that are learned from (a hash of the key chooses them), rows scored by one task at once.
ROUNDS, DEPTH, RATE, SHARE, FOLDS, LEAST, BINS, MOST_ROWS, CHUNK = 200, 3, 0.05, 0.8, 5, 50, 64, 20_000, 50_000


def fit(x: np.ndarray, y: np.ndarray, rounds: int, seed: int) -> dict[str, np.ndarray]:
    """Least-squares boosting on binned features; a node without a gain sends all rows left."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    nodes = (1 << DEPTH) - 1
    feature, cut, leaf = np.zeros((rounds, nodes), int), np.full((rounds, nodes), np.inf), np.zeros((rounds, nodes + 1))
    start = y.mean()
    fitted = np.full(n, start)
    for t in range(rounds):
        use = rng.random(n) < SHARE
        left, node = np.where(use, y - fitted, 0.0), np.zeros(n, int)
        for level in range(DEPTH):
            m = 1 << level
            best, where = np.full(m, 1e-12), np.zeros((m, 2), int)
            for f in range(width):
                at = node * BINS + binned[f]
                s, c = (np.cumsum(np.bincount(at, w, m * BINS).reshape(m, BINS), 1) for w in (left, use.astype(float)))
                total, count = s[:, -1:], c[:, -1:]
                gain = s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(count - c, 1) - total**2 / np.maximum(count, 1)
                gain[(c < 1) | (count - c < 1)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(m), k] > best
                best[better], where[better] = gain[np.arange(m), k][better], np.stack([np.full(m, f), k], 1)[better]
            split = best > 1e-12
            first = m - 1
            feature[t, first : first + m] = where[:, 0]
            cut[t, first : first + m] = [edges[f][k] if s and k < len(edges[f]) else np.inf for (f, k), s in zip(where, split, strict=True)]
            f, k = where[node, 0], np.where(split, where[:, 1], BINS)[node]
            node = node * 2 + (binned[f, np.arange(n)] > k)
        c = np.bincount(node, use.astype(float), nodes + 1)
        leaf[t] = RATE * np.bincount(node, left, nodes + 1) / np.maximum(c, 1)
        fitted += leaf[t][node]
    return {"start": np.array([start]), "feature": feature, "cut": cut, "leaf": leaf}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["start"][0])
    rows = np.arange(len(x))
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
        node = np.zeros(len(x), int)
        for level in range(DEPTH):
            at = node + (1 << level) - 1
            node = node * 2 + (x[rows, feature[at]] > cut[at])
        out += leaf[node]
    return out


def importances(model: dict[str, np.ndarray], width: int) -> np.ndarray:
    """How often each feature splits, as shares."""
    used = np.bincount(model["feature"][np.isfinite(model["cut"])], minlength=width).astype(float)
    return used / max(used.sum(), 1)


def _packed(model: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def out_of_fold(points: DataFrame, features: list[str], target: str, group: str, key: str, rounds: int = ROUNDS, folds: int = FOLDS, most_rows: int = MOST_ROWS) -> DataFrame:
    """(key, group, predicted) for rows of groups of at least LEAST rows: boosted trees of the group that never saw the row.

    A hash of the key gives the fold; folds=1 scores the rows that were learned from. An area learns from at most
    most_rows of its rows, so one task's memory is bounded; all its rows are scored, in chunks.
    """
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    rows = points.filter(F.col(target).isNotNull()).select(F.col(key).alias("key"), F.col(group).alias("g"), F.col(target).cast("double").alias("y"), x.alias("x"), F.pmod(F.xxhash64(key), F.lit(folds)).alias("fold"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)
    rows = rows.join(sizes.hint("merge"), "g")
    learned = rows.filter(F.pmod(F.xxhash64(F.lit("learn"), "key"), F.lit(1_000_000)) < F.lit(1_000_000.0 * most_rows) / F.col("n"))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        xs, ys, fold = np.stack(part["x"]), part["y"].to_numpy(), part["fold"].to_numpy()
        seen = [np.ones(len(ys), bool)] if folds == 1 else [fold != k for k in range(folds)]
        made = [(part["g"].iloc[0], k, int(part["n"].iloc[0]), _packed(fit(xs[use], ys[use], rounds, k))) for k, use in enumerate(seen) if use.any()]
        return pd.DataFrame(made, columns=["g", "fold", "n", "model"])

    kind = rows.schema["g"].dataType.simpleString()
    models = learned.groupBy("g").applyInPandas(learn, f"g {kind}, fold long, n long, model binary")
    chunks = F.ceil(F.col("n") / CHUNK).cast("long")
    models = models.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "key"), chunks))

    def score(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(known):
            return pd.DataFrame({"key": [], "g": [], "predicted": []})
        return pd.DataFrame({"key": own["key"], "g": own["g"], "predicted": predict(_unpacked(known["model"].iloc[0]), np.stack(own["x"]))})

    by = ["g", "fold", "chunk"]
    out = dealt.select(*by, "key", "x").groupBy(*by).cogroup(models.select(*by, "model").groupBy(*by)).applyInPandas(score, f"key {rows.schema['key'].dataType.simpleString()}, g {kind}, predicted double")
    return out.select(F.col("key").alias(key), F.col("g").alias(group), "predicted")


def split_shares(points: DataFrame, features: list[str], target: str, group: str, key: str, rounds: int = ROUNDS, most_rows: int = MOST_ROWS) -> DataFrame:
    """(group, feature, share): how often each feature splits in the trees of a group."""
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    rows = points.filter(F.col(target).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(target).cast("double").alias("y"), x.alias("x"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)
    rows = rows.join(sizes.hint("merge"), "g").filter(F.pmod(F.xxhash64(F.lit("learn"), "key"), F.lit(1_000_000)) < F.lit(1_000_000.0 * most_rows) / F.col("n"))

    def shares(part: pd.DataFrame) -> pd.DataFrame:
        made = importances(fit(np.stack(part["x"]), part["y"].to_numpy(), rounds, 0), len(features))
        return pd.DataFrame({"g": part["g"].iloc[0], "feature": features, "share": made})

    kind = rows.schema["g"].dataType.simpleString()
    return rows.groupBy("g").applyInPandas(shares, f"g {kind}, feature string, share double").withColumnRenamed("g", group)
