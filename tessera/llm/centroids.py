"""Centroid clustering (operator 13): exact nearest centroids by Orchard's search.

The centroids, few and small, go to every task with each one's list of the others by distance. A vector starts
at a centroid and walks its list; whenever a closer centroid turns up it goes on with that one's list, skipping
what it has compared before, and it stops where the list is strictly further than twice the vector's distance: no
later centroid can be nearer or as near. All vectors of an Arrow batch take their steps together. A round sends
at most clusters x (dims + 1) sums a task; the sums and the totals of the clusters are what reaches the driver.

Edge cases: null vectors, vectors of another length and those with a null, NaN, infinite or huge component (see
`integer_vectors`) are dropped. Fewer vectors than clusters make fewer clusters. Equal distances go to the
smaller number. Repeated rows and ids are rows like any other; a row with a null id is a first centroid only after
all others. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, integer_vectors, materialise, rows_of


def neighbour_lists(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all centroids by squared distance, ties by number, and these distances."""
    gap = np.array([((centres - c) ** 2).sum(axis=1) for c in centres]).reshape(len(centres), len(centres))
    order = np.argsort(gap, axis=1, kind="stable")
    return order, np.take_along_axis(gap, order, axis=1)


def orchard(x: np.ndarray, centres: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid, squared distance to it, and how many distances were computed."""
    order, gap = lists
    n, k = len(x), len(centres)
    best = np.zeros(n, np.int64)
    distance = ((x - centres[0]) ** 2).sum(axis=1)
    at_list, position = np.zeros(n, np.int64), np.zeros(n, np.int64)
    visited = np.zeros((n, k), bool)
    visited[:, 0] = True
    computed, active = n, np.arange(n)
    while len(active):
        where = at_list[active], position[active]
        going = gap[where] <= 4 * distance[active]
        active, found = active[going], order[where][going]
        fresh = ~visited[active, found]
        rows, found = active[fresh], found[fresh]
        visited[rows, found] = True
        d = ((x[rows] - centres[found]) ** 2).sum(axis=1)
        computed += len(rows)
        position[active] += 1
        tied = (d == distance[rows]) & (found < best[rows])
        best[rows[tied]] = found[tied]
        closer = d < distance[rows]
        rows, found = rows[closer], found[closer]
        best[rows], at_list[rows], position[rows], distance[rows] = found, found, 0, d[closer]
        active = active[position[active] < k]
    return best, distance, computed


def _learn(centres: np.ndarray):
    """A function of batches (v): sums (cluster, at, total) of a task; at = dims is the number of vectors."""
    lists = neighbour_lists(centres)
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x = rows_of(batch.column(0), dims)
            cluster = orchard(x, centres, lists)[0]
            order = np.argsort(cluster, kind="stable")
            there, starts, counts = np.unique(cluster[order], return_index=True, return_counts=True)
            if len(there):
                total[there, :dims] += np.add.reduceat(x[order], starts, axis=0)
                total[there, dims] += counts
        c, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype("i4")), pa.array(at.astype("i4")), pa.array(total[c, at])], ["cluster", "at", "total"])

    return run


def _assign(centres: np.ndarray):
    """A function of batches (id, v): (id, cluster, distance)."""
    lists = neighbour_lists(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = orchard(rows_of(batch.column(1), centres.shape[1]), centres, lists)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype("i4")), pa.array(distance)], ["id", "cluster", "distance"])

    return run


def cluster(embeddings: DataFrame, clusters: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) and the final centroids."""
    table = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("e"))
    vectors = materialise(integer_vectors(table, scale, "e", "id", dims=dims), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(hashed.asc_nulls_last(), "v").limit(clusters).collect()
    centres = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(first) else 0):
        sums = vectors.select("v").mapInArrow(_learn(centres), "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum("total").alias("total"))
        total = np.zeros((len(centres), dims + 1), np.int64)
        for r in sums.collect():  # at most clusters x (dims + 1) rows
            total[r["cluster"], r["at"]] = r["total"]
        used = total[:, dims] > 0
        centres[used] = total[used, :dims] // total[used, dims:]
    kind = columns_of(table, "id")
    found = materialise(vectors.mapInArrow(_assign(centres if len(first) else np.zeros((1, dims), np.int64)), f"{kind}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    of = lambda values, kind: F.array(*(F.lit(v).cast(kind) for v in values or [None]))[F.col("cluster")]
    return found.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        of([inertia.get(c, 0) for c in range(len(centres))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    ), centres


def oracle(clusters: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: str = "1") -> str:
    """The same result in DuckDB."""
    head = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
 WHERE len(embedding) = {dims} AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
b0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {clusters}))"""
    near = "a{i} AS MATERIALIZED (SELECT vec_id, min(struct_pack(d := d, c := c)) AS best FROM (SELECT k.vec_id, b.c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(k.v, b.v)]) AS d FROM kept k, b{i} b) GROUP BY vec_id)"
    steps = []
    for i in range(rounds):
        steps.append(near.format(i=i))
        steps.append(f"m{i} AS (SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY pos) AS v FROM (SELECT a.best.c AS c, u.pos, CAST(sum(k.v[u.pos]) AS DOUBLE) AS s, count(*) AS n FROM kept k JOIN a{i} a USING (vec_id), range(1, {dims + 1}) u(pos) GROUP BY 1, 2) GROUP BY 1)")
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.c, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON b.c = m.c)")
    steps.append(near.format(i=rounds))
    return (
        ", ".join([head, *steps])
        + f"""
SELECT a.vec_id, CAST(a.best.c AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(b.v, 'string_agg', ',')) AS centroid_sha256 FROM a{rounds} a JOIN b{rounds} b ON a.best.c = b.c"""
    )
