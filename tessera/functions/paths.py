"""Iterative operators on edge tables: shortest paths, rewiring, spectral positions, greedy thinning, smoothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import sized, stored
from .neighbours import nearest


def shortest_paths(roads: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """Stored rows (src, node, cost): the least road length from each source to every node within the cutoff.

    roads has (src, dst, length), sources a column src. The frontier of improved nodes is relaxed until nothing
    changes; there is no limit on the number of edges.
    """
    best = stored(sources.select("src").distinct().select("src", F.col("src").alias("node"), F.lit(0.0).alias("cost")))
    frontier = best
    edges = stored(roads.groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min("length").alias("length")))
    while True:
        step = frontier.join(edges.hint("merge"), F.col("node") == F.col("a")).select("src", F.col("b").alias("node"), (F.col("cost") + F.col("length")).alias("cost"))
        step = step.filter(F.col("cost") <= cutoff).groupBy("src", "node").agg(F.min("cost").alias("cost"))
        known = best.select("src", "node", F.col("cost").alias("old"))
        frontier = stored(step.join(known.hint("merge"), ["src", "node"], "left").filter("old IS NULL OR cost < old").select("src", "node", "cost"))
        if frontier.isEmpty():
            return best
        best = stored(best.unionByName(frontier).groupBy("src", "node").agg(F.min("cost").alias("cost")))


def smoothed(points: DataFrame, edges: DataFrame, rounds: int = 50, every: int = 10) -> DataFrame:
    """(point_id, area_id, t, v) after `rounds` of neighbour means, with each area's mean restored.

    points has (point_id, area_id, t, v), edges (src, dst) within areas. A point without neighbours keeps its value.
    Restoring the mean adds one number to all values of an area, which neighbour means within the area pass on
    unchanged; so doing it once at the end is the same as doing it after every round.
    """
    points = stored(points.select("point_id", "area_id", "t", "v"))
    alone = points.select(F.col("point_id").alias("src"), F.col("point_id").alias("dst")).join(edges.select("src").distinct().hint("merge"), "src", "left_anti")
    edges = stored(edges.select("src", "dst").unionByName(alone.select("src", "dst")))
    now = points.select(F.col("point_id").alias("dst"), "v")
    for i in range(rounds):
        now = edges.join(now.hint("merge"), "dst").groupBy("src").agg(F.avg("v").alias("v")).withColumnRenamed("src", "dst")
        if (i + 1) % every == 0:
            now = stored(now)
    done = points.drop("v").join(now.withColumnRenamed("dst", "point_id").hint("merge"), "point_id")
    return recentred(stored(done))


def recentred(points: DataFrame) -> DataFrame:
    """v shifted so that each area's mean is t again; an area without a target is left as it is."""
    shift = points.groupBy("area_id").agg((F.max("t") - F.avg("v")).alias("shift"))
    return points.join(shift.hint("merge"), "area_id").select("point_id", "area_id", "t", (F.col("v") + F.coalesce("shift", F.lit(0.0))).alias("v"))


def clipped(points: DataFrame) -> DataFrame:
    return points.withColumn("v", F.least(F.greatest("v", F.lit(0.0)), F.lit(1.0)))


def pycnophylactic(seed: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(point_id, area_id, value): smoothing, clip, mean restored, clip; a single point of an area gets the target."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("area_id")) <= 1
    done = clipped(recentred(stored(clipped(smoothed(seed, edges, rounds)))))
    return done.select("point_id", "area_id", F.when(alone, F.col("t")).otherwise(F.col("v")).alias("value"))


def thinned(points: DataFrame, distance: float, key: str = "point_id") -> DataFrame:
    """The rows that greedy thinning in key order keeps: a row goes if a kept row of smaller key lies within distance.

    Cells are so small that any two rows of one are near: of a cell's undecided rows only the first may be kept, and it is
    once no undecided row before it is near; then every row near a kept one goes. A round compares each undecided row with
    the firsts of the 25 cells around, so work and storage do not grow with the pairs of near rows. Rows of a key
    that repeats share one fate, which takes the pairs.
    """
    repeated = points.groupBy(key).count().filter("count > 1")
    if not repeated.isEmpty():
        return _thinned_pairs(points, distance, key)
    cell = lambda v: F.floor(F.col(v) / (distance / 2**0.5 * (1 - 1e-9)))
    rows = points.filter(F.col(key).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    undecided = stored(rows.select(F.col(key).alias("a"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), cell("x").alias("cx"), cell("y").alias("cy")))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3))))
    near = (F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2 <= distance * distance

    def copies(firsts: DataFrame) -> DataFrame:
        made = firsts.withColumn("o", around).select("b", "bx", "by", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
        return sized(stored(made))

    gone = None
    while not undecided.isEmpty():
        first = undecided.groupBy("cx", "cy").agg(F.min(F.struct("a", "x", "y")).alias("r"))
        firsts = stored(first.select(F.col("r.a").alias("b"), F.col("r.x").alias("bx"), F.col("r.y").alias("by"), "cx", "cy"))
        waiting = stored(undecided.join(copies(firsts), ["cx", "cy"]).filter((F.col("a") < F.col("b")) & near).select("b").distinct())
        keep = stored(firsts.join(sized(waiting), "b", "left_anti"))
        left = undecided.join(sized(keep.select(F.col("b").alias("a"))), "a", "left_anti")
        close = copies(keep).withColumnsRenamed({"cx": "ox", "cy": "oy"})
        touched = (F.col("cx") == F.col("ox")) & (F.col("cy") == F.col("oy")) & near
        drop = stored(left.join(close, touched, "left_semi"))
        gone = drop.select("a") if gone is None else gone.unionByName(drop.select("a"))
        undecided = stored(left.join(close, touched, "left_anti"))
    return points if gone is None else points.join(gone.withColumnRenamed("a", key).hint("merge"), key, "left_anti")


def _thinned_pairs(points: DataFrame, distance: float, key: str) -> DataFrame:
    """thinned by all pairs of near rows, from cells of the distance's width."""
    cell = lambda v: F.floor(F.col(v) / distance)
    rows = points.select(F.col(key).alias("a"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    other = points.select(F.col(key).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"), around.alias("o"))
    other = other.select("b", "bx", "by", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    near = (F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2 <= distance * distance
    pairs = stored(rows.join(other.hint("merge"), ["cx", "cy"]).filter((F.col("b") < F.col("a")) & near).select("a", "b"))  # b stands before a
    undecided, gone = stored(points.select(F.col(key).alias("a"))), None
    while not undecided.isEmpty():
        waiting = pairs.join(undecided.hint("merge"), "a").join(undecided.select(F.col("a").alias("b")).hint("merge"), "b")
        keep = stored(undecided.join(waiting.select("a").distinct().hint("merge"), "a", "left_anti"))
        drop = stored(waiting.join(keep.select(F.col("a").alias("b")).hint("merge"), "b", "left_semi").select("a").distinct())
        gone = drop if gone is None else gone.unionByName(drop)
        undecided = stored(undecided.join(keep.unionByName(drop).hint("merge"), "a", "left_anti"))
    return points if gone is None else points.join(gone.withColumnRenamed("a", key).hint("merge"), key, "left_anti")


def rewired(edges: DataFrame, rounds: int = 10, seed: int = 7) -> DataFrame:
    """Undirected edges (a, b), a < b, after rounds of double edge swaps that keep every node's degree.

    In each round a hash pairs the edges; (a, b), (c, d) become (a, d), (c, b) where that makes no loop, no edge that
    exists and no edge twice. Under four edges nothing changes.
    """
    now = stored(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct())
    if now.count() < 4:
        return now
    for i in range(rounds):
        mark = F.xxhash64(F.lit(seed), F.lit(i), "a", "b")
        # pairs are made within buckets of about a thousand edges, so that no window holds the table
        buckets = max(1, now.count() // 1000)
        placed = now.withColumn("g", F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(i), "a", "b"), F.lit(buckets))).withColumn("nth", F.row_number().over(Window.partitionBy("g").orderBy(mark, "a", "b")) - 1)
        pair = placed.groupBy("g", F.floor(F.col("nth") / 2).alias("p")).agg(F.max_by(F.struct("a", "b"), "nth").alias("y"), F.min_by(F.struct("a", "b"), "nth").alias("x"), F.count(F.lit(1)).alias("n")).filter("n = 2")
        swap = pair.select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.a").alias("c"), F.col("y.b").alias("d"))
        swap = swap.filter("a <> d AND c <> b AND a <> c AND b <> d").withColumn("id", F.xxhash64("a", "b", "c", "d"))
        made = stored(swap.select("id", "a", "b", "c", "d", F.explode(F.array(F.struct(F.least("a", "d").alias("u"), F.greatest("a", "d").alias("v")), F.struct(F.least("c", "b").alias("u"), F.greatest("c", "b").alias("v")))).alias("e")).select("*", "e.u", "e.v"))
        taken = made.join(now.select(F.col("a").alias("u"), F.col("b").alias("v")).hint("merge"), ["u", "v"], "left_semi").select("id")
        twice = made.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("u", "v"))).filter("n > 1").select("id")
        legal = stored(made.join(taken.unionByName(twice).distinct().hint("merge"), "id", "left_anti"))
        old = legal.select("a", "b").unionByName(legal.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b"))).distinct()
        now = stored(now.join(old.hint("merge"), ["a", "b"], "left_anti").unionByName(legal.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    return now


def connected(both: DataFrame) -> DataFrame:
    """Stored rows (node, component) of edges (a, b) given in both directions: the smallest node of the component.

    In each round a node takes the smallest label around it, then that label's own label.
    """
    now = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "component").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = stored(now.join(near.hint("merge"), "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old")))
        further = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = stored(step.join(further.hint("merge"), "component").select("node", F.least("component", "next").alias("component"), "old"))
        now = after.select("node", "component")
        if after.filter("component <> old").isEmpty():
            return now


#: Nodes of a component that one task solves as a dense matrix; vectors beyond those asked for, and degree of the filter.
DENSE, SPARE, DEGREE = 1500, 4, 12
#: Nodes, and edges in both directions, of a component whose iteration one task holds in memory (about 0.4 GB).
HELD_NODES, HELD_EDGES = 300_000, 6_000_000


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their first entry of largest size positive."""
    if not len(vectors):
        return vectors
    top = np.abs(vectors).round(9).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def spectral(edges: DataFrame, dims: int = 8, tolerance: float = 1e-3, rounds: int = 60, seed: int = 5) -> DataFrame:
    """(node, component, v, residual): in each component the eigenvectors of the normalised Laplacian of undirected
    edges (a, b) with the smallest eigenvalues, the trivial one left out.

    A component of up to DENSE nodes is solved exactly in one task, many of them at once. Larger ones go on by block
    iteration: a Chebyshev filter of DEGREE products with the Laplacian damps all eigenvalues above the block's own, then
    a small matrix of inner products for each component makes the block orthonormal and turns it to its eigenvectors. It
    ends when the component's largest residual |Lv - tv| is below the tolerance, or after `rounds`; `residual` tells
    which. The task of a component of up to HELD_NODES and HELD_EDGES iterates in memory; those beyond go on together,
    with joins and aggregations for products, until all are done. A component of n nodes has n - 1 such vectors at
    most, the rest of v is 0.
    """
    both = stored(edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = connected(both)
    degree = stored(both.groupBy("a").agg(F.count(F.lit(1)).cast("double").alias("n")).join(labels.withColumnRenamed("node", "a").hint("merge"), "a"))
    size, ends = F.count(F.lit(1)), F.sum("n")
    sizes = degree.groupBy("component").agg(F.when(size <= DENSE, "dense").when((size <= HELD_NODES) & (ends <= HELD_EDGES), "held").otherwise("joined").alias("way"))
    degree = stored(degree.join(sizes.hint("merge"), "component"))
    weights = both.join(degree.hint("merge"), "a").join(degree.select(F.col("a").alias("b"), F.col("n").alias("m")).hint("merge"), "b")
    weights = stored(weights.select("a", "b", "component", "way", (1 / F.sqrt(F.col("n") * F.col("m"))).alias("w")))
    kind = both.schema["a"].dataType.simpleString()
    schema = f"node {kind}, component {kind}, v array<double>, residual double"

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        nodes, a = np.unique(part["a"].to_numpy(), return_inverse=True)
        laplacian = np.eye(len(nodes))
        laplacian[a, np.searchsorted(nodes, part["b"].to_numpy())] -= part["w"].to_numpy()
        values, vectors = np.linalg.eigh(laplacian)
        found = _signed(vectors[:, 1 : dims + 1])
        rest = np.linalg.norm(laplacian @ found - found * values[1 : dims + 1], axis=0).max(initial=0.0)
        found = np.pad(found, ((0, 0), (0, dims - found.shape[1])))
        return pd.DataFrame({"node": nodes, "component": part["component"].iloc[0], "v": list(found), "residual": rest})

    done = stored(weights.filter("way = 'dense'").groupBy("component").applyInPandas(solved, schema))
    nodes = degree.select(F.col("a").alias("node"), "component", _start(dims + 1 + SPARE, seed).alias("v"), "way")
    held, joined = nodes.filter("way = 'held'"), nodes.filter("way = 'joined'")
    if not held.isEmpty():
        found = weights.filter("way = 'held'").select("a", "b", "w", "component").groupBy("component")
        done = done.unionByName(stored(found.cogroup(held.select("node", "component", "v").groupBy("component")).applyInPandas(_held(dims, tolerance, rounds), schema)))
    if joined.isEmpty():
        return done
    return done.unionByName(_iterated(stored(weights.filter("way = 'joined'").select("a", "b", "w")), stored(joined.drop("way")), dims, tolerance, rounds, kind))


def _start(b: int, seed: int):
    """The block that the iteration starts with: the trivial vector, and noise."""
    return F.array(F.sqrt("n"), *((F.pmod(F.xxhash64("a", F.lit(seed), F.lit(j)), F.lit(20_001)) / 10_000 - 1) for j in range(1, b)))


def _turn(gram: np.ndarray, ritz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What turns a block to orthonormal Ritz vectors, and their values, from its inner products with itself and its product."""
    d = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    values, vectors = np.linalg.eigh(gram * d[:, None] * d)
    root = d[:, None] * vectors * np.where(values > 1e-10, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    inner = root.T @ ritz @ root + np.diag(np.where(values > 1e-10, 0.0, 4.0))  # directions that are lost come last
    low, turn = np.linalg.eigh(inner)
    return root @ turn, low


def _held(dims: int, tolerance: float, rounds: int):
    """spectral for one component in memory: from its edges (a, b, w) and nodes (node, component, v)."""

    def solve(edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        ids, now = nodes["node"].to_numpy(), np.ascontiguousarray(np.stack(nodes["v"].to_numpy()).T)
        a, to, w = np.searchsorted(ids, edges["a"].to_numpy()), np.searchsorted(ids, edges["b"].to_numpy()), edges["w"].to_numpy(float)
        order = np.argsort(a, kind="stable")
        first, to, w = np.searchsorted(a[order], np.arange(len(ids))), to[order], w[order]

        def product(v: np.ndarray) -> np.ndarray:
            return v - np.stack([np.add.reduceat(w * x[to], first) for x in v])

        for step in range(rounds + 1):
            l = product(now)  # noqa: E741
            ritz = np.triu(now @ l.T)
            turn, values = _turn(now @ now.T, ritz + np.triu(ritz, 1).T)
            now, l = turn.T @ now, turn.T @ l  # noqa: E741
            residual = float(np.linalg.norm(l[1 : dims + 1] - values[1 : dims + 1, None] * now[1 : dims + 1], axis=1).max())
            if step == rounds or residual < tolerance:
                found = _signed(now[1 : dims + 1].T)
                return pd.DataFrame({"node": ids, "component": nodes["component"].to_numpy(), "v": list(found), "residual": residual})
            # Chebyshev polynomial that is small between the block's largest value and 2
            low = min(max(values[-1], 1e-6), 1.9)
            half, middle = (2 - low) / 2, (2 + low) / 2
            before, now = now, (l - middle * now) / half
            for _ in range(2, DEGREE + 1):
                before, now = now, 2 * (product(now) - middle * now) / half - before

    return solve


def _iterated(weights: DataFrame, now: DataFrame, dims: int, tolerance: float, rounds: int, kind: str) -> DataFrame:
    """spectral for the largest components: (node, component, v, residual)."""
    b = dims + 1 + SPARE
    zipped = lambda x, y, of: F.zip_with(x, y, of)

    def applied(block: DataFrame) -> DataFrame:
        """The block with `l`, its product with the Laplacian."""
        sums = weights.join(block.select(F.col("node").alias("b"), "v").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.array(*(F.sum(F.col("w") * F.col("v")[j]) for j in range(b))).alias("s"))
        return block.join(sums.hint("merge"), "node").withColumn("l", zipped("v", "s", lambda v, s: v - s)).drop("s")

    def turned(part: pd.DataFrame) -> pd.DataFrame:
        """(component, turn, values) from sums of products of v with v and with l: an orthonormal block of Ritz vectors."""
        made = []
        for r in part.itertuples(index=False):
            gram, ritz = np.zeros((b, b)), np.zeros((b, b))
            gram[np.triu_indices(b)], ritz[np.triu_indices(b)] = r.g, r.h
            gram, ritz = gram + np.triu(gram, 1).T, ritz + np.triu(ritz, 1).T
            turn, low = _turn(gram, ritz)
            made.append((r.component, turn.ravel().tolist(), low.tolist()))
        return pd.DataFrame(made, columns=["component", "turn", "values"])

    pairs = [(i, j) for i in range(b) for j in range(i, b)]
    for step in range(rounds + 1):
        block = stored(applied(now))
        sums = block.groupBy("component").agg(F.array(*(F.sum(F.col("v")[i] * F.col("v")[j]) for i, j in pairs)).alias("g"), F.array(*(F.sum(F.col("v")[i] * F.col("l")[j]) for i, j in pairs)).alias("h"))
        turns = stored(sums.mapInPandas(lambda parts: map(turned, parts), f"component {kind}, turn array<double>, values array<double>"))
        times = lambda x: F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(b - 1)), F.lit(0.0), lambda t, i: t + F.col(x)[i] * F.col("turn")[i * b + j]))
        block = stored(block.join(sized(turns), "component").select("node", "component", times("v").alias("v"), times("l").alias("l"), "values"))
        off = F.array_max(F.array(*(F.sqrt(F.sum((F.col("l")[j] - F.col("values")[j] * F.col("v")[j]) ** 2)) for j in range(1, dims + 1))))
        state = stored(block.groupBy("component").agg(off.alias("residual"), F.max(F.col("values")[b - 1]).alias("cut")))
        if step == rounds or state.agg(F.max("residual")).first()[0] < tolerance:
            found = block.join(sized(state), "component").select("node", "component", F.slice("v", 2, dims).alias("v"), "residual")
            big = found.groupBy("component").agg(F.array(*(F.max_by(F.col("v")[j], F.struct(F.round(F.abs(F.col("v")[j]), 9), -F.col("node"))) for j in range(dims))).alias("top"))
            return found.join(sized(stored(big)), "component").select("node", "component", zipped("v", "top", lambda v, t: F.when(t < 0, -v).otherwise(v)).alias("v"), "residual")
        # Chebyshev polynomial that is small between the block's largest value and 2
        low = F.least(F.greatest("cut", F.lit(1e-6)), F.lit(1.9))
        half, middle = (2 - F.col("low")) / 2, (2 + F.col("low")) / 2
        two = block.drop("values").join(sized(state.select("component", low.alias("low"))), "component")
        two = two.select("node", "component", "low", F.col("v").alias("before"), zipped("l", "v", lambda l, v: (l - middle * v) / half).alias("v"))
        for i in range(2, DEGREE + 1):
            two = applied(two).select("node", "component", "low", F.col("v").alias("before"), zipped(zipped("l", "v", lambda l, v: 2 * (l - middle * v) / half), "before", lambda x, y: x - y).alias("v"))
            two = stored(two) if i % 3 == 0 else two
        now = two.select("node", "component", "v")


def network_edges(near: DataFrame, snapped: DataFrame, paths: DataFrame, metres: float) -> DataFrame:
    """(src, dst, w) of snapped points among the nine nearest, under 1,000 m apart, with a path: w = 1 / (1 + path / 500)."""
    close = near.filter((F.col("nth") <= 9) & (F.col("d") * metres < 1000))
    a, b = snapped.select(F.col("point_id").alias("src"), F.col("node").alias("na")), snapped.select(F.col("point_id").alias("dst"), F.col("node").alias("nb"))
    ends = close.join(a.hint("merge"), "src").join(b.hint("merge"), "dst")
    path = paths.select(F.col("src").alias("na"), F.col("node").alias("nb"), "cost")
    return ends.join(path.hint("merge"), ["na", "nb"]).select("src", "dst", (1 / (1 + F.col("cost") / 500)).alias("w"))


def road_knn(points: DataFrame, snapped: DataFrame, roads: DataFrame, k: int, metres: float) -> DataFrame:
    """(src, dst, nth): the k nearest of the 3k planar candidates of the own area by road, within a cutoff of five times
    the furthest candidate and 500 m at least; a pair without a snapped end counts by its planar distance."""
    close = nearest(points, points, 3 * k, "point_id", "point_id", "area_id", same=True)
    cutoff = max(500.0, 5 * metres * (close.agg(F.max("d")).first()[0] or 0.0))
    sources = snapped.filter("node IS NOT NULL").select(F.col("node").alias("src")).distinct()
    paths = shortest_paths(roads, sources, cutoff)
    a, b = snapped.select(F.col("point_id").alias("src"), F.col("node").alias("na")), snapped.select(F.col("point_id").alias("dst"), F.col("node").alias("nb"))
    ends = close.join(a.hint("merge"), "src", "left").join(b.hint("merge"), "dst", "left")
    path = paths.select(F.col("src").alias("na"), F.col("node").alias("nb"), "cost")
    cost = F.when(F.col("na").isNull() | F.col("nb").isNull(), F.col("d") * metres).otherwise(F.col("cost"))
    ranked = ends.join(path.hint("merge"), ["na", "nb"], "left").withColumn("cost", cost).filter("cost IS NOT NULL")
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("cost", "d", "dst"))).filter(F.col("place") <= k).select("src", "dst", F.col("place").alias("nth"))
