"""Counts over all ordered pairs of a group without making the pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import sized, stored

#: Rows of a group that one task takes.
MOST_ROWS = 1_000_000


def _prefixes(t: np.ndarray, gap: float) -> np.ndarray:
    """For each of the sorted values how many stand at least `gap` below it, by the difference as computed."""
    p = np.searchsorted(t, t - gap, side="right")
    while True:
        less = (p > 0) & (t - t[np.maximum(p - 1, 0)] < gap)
        more = (p < len(t)) & (t - t[np.minimum(p, len(t) - 1)] >= gap)
        if not (less.any() or more.any()):
            return p
        p = p - less + (more & ~less)


def ordered_sums(t: np.ndarray, v: np.ndarray, gap: float, margin: float) -> tuple[int, int, float]:
    """Pairs (a, b) with t[b] - t[a] >= gap, those with v[b] > v[a], and the sum of max(0, margin - (v[b] - v[a])).

    In the order of t the partners of b are a prefix. It is cut into blocks whose sizes are powers of two; in each
    block the values are in order, so a search gives how many lie below b's, and running sums how much lies above.
    """
    order = np.argsort(t, kind="stable")
    t, v = t[order], v[order]
    n, p = len(t), _prefixes(t, gap)
    known, rank = np.unique(v, return_inverse=True)
    below, above = np.searchsorted(known, v, side="left"), np.searchsorted(known, v - margin, side="right")
    higher, hinge, wide = 0, 0.0, len(known) + 1
    for level in range(int(p.max(initial=0)).bit_length()):
        block = np.arange(n) >> level
        by_value = np.lexsort((rank, block))
        key = block[by_value] * wide + rank[by_value]
        total = np.concatenate([[0.0], np.cumsum(v[by_value])])
        use = np.flatnonzero(p >> level & 1)
        own = (p[use] >> level) - 1  # the block of this size at the end of the prefix's higher bits
        higher += int((np.searchsorted(key, own * wide + below[use]) - (own << level)).sum())
        first, last = np.searchsorted(key, own * wide + above[use]), (own + 1) << level
        hinge += float((total[last] - total[first] - (last - first) * (v[use] - margin)).sum())
    return int(p.sum()), higher, hinge


def ordered(points: DataFrame, keys: list[str], gap: float, margin: float) -> DataFrame:
    """(keys, pairs, higher, hinge) of groups of rows (keys, truth, value) that have such pairs."""
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["truth", "value"])
        found = ordered_sums(rows["truth"].to_numpy(float), rows["value"].to_numpy(float), gap, margin)
        return pd.DataFrame([(*key, *found)] if found[0] else [], columns=[*keys, "pairs", "higher", "hinge"])

    return points.select(*keys, "truth", "value").groupBy(*keys).applyInPandas(run, f"{kinds}, pairs long, higher long, hinge double")


#: Rows of a block, and distances that a task holds at once.
SIDE, HELD = 4096, 1 << 20


def _block_sums(parts):
    """The sum of distances of each pair of blocks; of rows of one id none counts."""
    for part in parts:
        made = []
        for r in part.itertuples(index=False):
            (a, ax, ay), (b, bx, by) = ([np.asarray(v) for v in side] for side in ((r.a, r.ax, r.ay), (r.b, r.bx, r.by)))
            same, total, step = len(np.intersect1d(a, b)) > 0, 0.0, max(1, HELD // len(b))
            for i in range(0, len(a), step):
                dx, dy = ax[i : i + step, None] - bx, ay[i : i + step, None] - by
                d = np.sqrt(dx * dx + dy * dy)
                total += float(np.where(a[i : i + step, None] == b, 0.0, d).sum() if same else d.sum())
            made.append((r.kind, total / 2 if r.i == r.j else total))
        yield pd.DataFrame(made, columns=["kind", "total"])


def dispersion(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """(kind, mean_distance, pairs): mean distance and number of all pairs of rows (x, y) of a kind with different keys.

    All pairs are compared, in tasks of one pair of blocks each, whose memory does not grow; pairs are counted by keys.
    """
    rows = stored(rows.filter(F.col(kind).isNotNull() & F.col(key).isNotNull()).select(F.col(kind).alias("kind"), F.col(key).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    keys = rows.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"), F.count_if(known).alias("m"))
    of = lambda c: ((F.sum(c) * F.sum(c) - F.sum(F.col(c) * F.col(c))) / 2).cast("bigint")
    counts = stored(keys.groupBy("kind").agg(of("n").alias("pairs"), of("m").alias("known"), F.ceil(F.sum("m") / SIDE).alias("blocks")).filter("pairs > 0"))
    numbered = stored(rows.filter(known).withColumn("nth", F.monotonically_increasing_id()))
    dealt = numbered.join(sized(counts.select("kind", "blocks")), "kind").withColumn("i", F.pmod(F.xxhash64("nth"), F.col("blocks")))
    block = stored(dealt.groupBy("kind", "i").agg(F.collect_list(F.struct("id", "x", "y")).alias("r")).select("kind", "i", F.col("r.id").alias("a"), F.col("r.x").alias("ax"), F.col("r.y").alias("ay")))
    ends = block.select("kind", "i")
    met = ends.join(ends.withColumnRenamed("i", "j").hint("merge"), "kind").filter("i <= j")
    met = met.join(block.hint("merge"), ["kind", "i"]).join(block.withColumnsRenamed({"i": "j", "a": "b", "ax": "bx", "ay": "by"}).hint("merge"), ["kind", "j"])
    # as many partitions as pairs of blocks, up to a few thousand: adaptive execution would merge them by their bytes
    most = max(1, min(4000, ends.join(ends.withColumnRenamed("i", "j").hint("merge"), "kind").filter("i <= j").count()))
    sums = met.repartition(most, "kind", "i", "j").mapInPandas(_block_sums, f"kind {rows.schema['kind'].dataType.simpleString()}, total double")
    totals = stored(sums.groupBy("kind").agg(F.sum("total").alias("total")))
    return counts.join(totals.hint("merge"), "kind", "left").select(F.col("kind").alias(kind), F.try_divide("total", F.col("known").cast("double")).alias("mean_distance"), "pairs")
