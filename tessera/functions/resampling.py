"""Bootstrap draws and permutations by group: a group's rows meet all draws of a slice inside one task.

Rows are sent once for each slice of draws, and a group has one slice unless rows x draws exceed WORK; the draws
themselves are never rows of a join. What is drawn follows from md5 sums, so a run can be repeated anywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from .digests import Marks

#: Picks of one slice, rows of a group that one task takes, and picks that are in memory at once (one draw at least).
WORK, MOST_ROWS, BLOCK = 20_000_000, 1_000_000, 250_000
SLICE = ["area_id", "lo", "hi"]


def sliced(rows: DataFrame, draws: int) -> DataFrame:
    """Rows (area_id, n, ...) once for each slice of draws lo to hi of their area."""
    step = F.least(F.greatest(F.floor(F.lit(WORK) / F.col("n")), F.lit(1)), F.lit(draws)).cast("int")
    cut = rows.withColumn("step", step).withColumn("lo", F.explode(F.sequence(F.lit(1), F.lit(draws), F.col("step"))))
    return cut.withColumn("hi", F.least(F.col("lo") + F.col("step") - 1, F.lit(draws))).drop("step", "n")


def _correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row; NaN where a side does not vary."""
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    sa, sb = np.sqrt((a * a).mean(axis=1)), np.sqrt((b * b).mean(axis=1))
    fine = (sa > 1e-9) & (sb > 1e-9)
    return np.where(fine, (a * b).mean(axis=1) / np.where(fine, sa * sb, 1.0), np.nan)


def _picked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    area, lo, hi = key
    rows = rows.sort_values("i")
    n = len(rows)
    truth, v1, v2 = (rows[c].to_numpy(float) for c in ("truth", "v1", "v2"))
    each = max(1, BLOCK // n)
    marks, found = Marks(np.arange(n)), []
    for first in range(lo, hi + 1, each):
        draws = np.arange(first, min(first + each, hi + 1))
        at = np.stack([marks.first(f"{d}-{area}-") % np.uint32(n) for d in draws])
        t, a, b = truth[at], v1[at], v2[at]
        r = [_correlations(x, t) if n >= 10 else np.full(len(draws), np.nan) for x in (a, b)]
        middle = np.median(t, axis=1)
        found.append(pd.DataFrame({"draw": draws, "area_id": area, "r1": r[0], "r2": r[1], "mid": middle, "diff": np.median(a, axis=1) - middle}))
    return pd.concat(found).astype(object).where(lambda x: x.notna(), None)


def bootstrap(paired: DataFrame, draws: int) -> DataFrame:
    """(draw, area_id, r1, r2, mid, diff) for rows (area_id, i, n, truth, v1, v2): n rows drawn with replacement.

    i counts an area's n rows from 0. Correlations of v1 and v2 with truth from ten rows on, medians from two.
    """
    kind = paired.schema["area_id"].dataType.simpleString()
    rows = sliced(paired.filter("n >= 2").select("area_id", "i", "n", "truth", "v1", "v2"), draws)
    return rows.groupBy(*SLICE).applyInPandas(_picked, f"draw int, area_id {kind}, r1 double, r2 double, mid double, diff double")


def _edges_of(points: pd.DataFrame, edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and values in the order of ids, and the edges by place in it."""
    points = points.sort_values("point_id")
    ids = points["point_id"].to_numpy()
    return ids, points["z"].to_numpy(float), np.searchsorted(ids, edges["src"].to_numpy()), np.searchsorted(ids, edges["dst"].to_numpy()), edges["w"].to_numpy(float)


def _permuted(marks: Marks, z: np.ndarray, draw: int) -> np.ndarray:
    """Place k of the order of ids takes the value at place k of an md5 order."""
    first, last = marks.halves(f"{draw}-")
    order = np.argsort(first)
    if (first[order[1:]] == first[order[:-1]]).any():
        order = np.lexsort((last, first))
    return z[order]


def _tops(key: tuple, points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    area, lo, hi = key
    if not len(points) or not len(edges):
        return pd.DataFrame({"draw": [], "area_id": [], "top": []})
    ids, z, src, dst, w = _edges_of(points, edges)
    marks, tops = Marks(ids), []
    for d in range(lo, hi + 1):
        v = _permuted(marks, z, d)
        tops.append(float((w * v[src] * v[dst]).sum()))
    return pd.DataFrame({"draw": range(lo, hi + 1), "area_id": area, "top": tops})


def _hits(key: tuple, points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    _, lo, hi = key
    if not len(points) or not len(edges):
        return pd.DataFrame({"point_id": [], "hits": [], "draws": []})
    ids, z, src, dst, w = _edges_of(points, edges)
    lag = lambda v: np.bincount(src, w * v[dst], len(ids))
    seen = np.abs(z * lag(z)) - 1e-12
    marks, hits = Marks(ids), np.zeros(len(ids), np.int64)
    for d in range(lo, hi + 1):
        hits += np.abs(z * lag(_permuted(marks, z, d))) >= seen
    own = np.unique(src)
    return pd.DataFrame({"point_id": ids[own], "hits": hits[own], "draws": hi - lo + 1})


def _together(points: DataFrame, edges: DataFrame, draws: int, of, schema: str) -> DataFrame:
    sizes = stored(points.groupBy("area_id").agg(F.count(F.lit(1)).alias("n")))
    again = sizes.select(F.col("area_id").alias("area_id"), F.col("n").alias("n"))  # column ids of its own: the two sides are grouped together
    left = sliced(points.join(sizes.hint("merge"), "area_id").select("area_id", "n", "point_id", "z"), draws)
    right = sliced(edges.join(again.hint("merge"), "area_id").select("area_id", "n", "src", "dst", "w"), draws)
    return left.groupBy(*SLICE).cogroup(right.groupBy(*SLICE)).applyInPandas(of, schema)


def permuted_moran(points: DataFrame, edges: DataFrame, draws: int) -> DataFrame:
    """(draw, area_id, top): the weighted sum of products over edges (area_id, src, dst, w) for points (area_id, point_id, z)
    whose values are permuted within their area."""
    return _together(points, edges, draws, _tops, f"draw int, area_id {points.schema['area_id'].dataType.simpleString()}, top double")


def permuted_local(points: DataFrame, edges: DataFrame, draws: int) -> DataFrame:
    """(point_id, p): share of permutations whose |value x neighbours' mean| is no smaller, the observed one included."""
    found = _together(points, edges, draws, _hits, f"point_id {points.schema['point_id'].dataType.simpleString()}, hits long, draws long")
    return found.groupBy("point_id").agg(((F.sum("hits") + 1.0) / (F.sum("draws") + 1.0)).alias("p"))
