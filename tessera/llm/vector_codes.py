"""Vector code compression (operator 11): product codes whose codebooks are learned over tries of distinct parts.

Every vector is cut into equal parts, each with a codebook of its own. The distinct parts of a position and how
many vectors hold them are counted once by an aggregation and stored in lexicographic order. A round reads them
in blocks; each block is a trie over the dimensions, walked depth first: a node adds its dimension's squared
differences to its parent's vector of distances to all entries, so parts with a common prefix share that work, and
a leaf takes the nearest entry and adds its weighted components to the entry's sums. A task holds one block and
the codebooks, and sends at most parts x entries x (width + 1) sums. The last assignment needs no shuffle at all:
each batch of vectors makes its own tries.

Edge cases: null vectors and vectors with a null, NaN, infinite or huge component (see `integer_vectors`) are dropped;
so are vectors of another length than the most frequent one that `parts` divides (of equally frequent ones the
longest), since their parts cannot be compared. Fewer vectors than entries make fewer entries. Equal entries: the
lower index takes all. Repeated rows and ids are rows like any other; a null id comes after all others when first
entries are chosen. Null labels are one label. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, integer_vectors, materialise, rows_of, sized

#: Rows of a subtree that are done level by level in one array; larger subtrees are walked child by child.
BLOCK = 4096


def nearest_entries(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance to it, for distinct rows in lexicographic order."""
    n, width = rows.shape
    entry, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def leaves(low: int, high: int, depth: int, above: np.ndarray) -> None:
        node = above[None]
        owner = np.zeros(high - low, np.int64)
        starts = np.zeros(high - low, bool)
        starts[0] = True
        for j in range(depth, width):
            value = rows[low:high, j]
            starts[1:] |= value[1:] != value[:-1]
            first = np.flatnonzero(starts)
            node = node[owner[first]] + (value[first, None] - book[:, j]) ** 2
            owner = np.cumsum(starts) - 1
        best = node.argmin(axis=1)
        entry[low:high] = best[owner]
        distance[low:high] = node[np.arange(len(node)), best][owner]

    def walk(low: int, high: int, depth: int, above: np.ndarray) -> None:
        if high - low <= BLOCK or depth == width:
            leaves(low, high, depth, above)
            return
        value = rows[low:high, depth]
        edges = [low, *(np.flatnonzero(value[1:] != value[:-1]) + low + 1).tolist(), high]
        start = low
        for a, b in zip(edges, edges[1:], strict=False):  # small children go together
            if b - start > BLOCK:
                if a > start:
                    leaves(start, a, depth, above)
                start = a
            if b - a > BLOCK:
                walk(a, b, depth + 1, above + (rows[a, depth] - book[:, depth]) ** 2)
                start = b
        if high > start:
            leaves(start, high, depth, above)

    if n:
        walk(0, n, 0, np.zeros(len(book), np.int64))
    return entry, distance


def _sorted(rows: np.ndarray) -> np.ndarray:
    return np.lexsort(rows.T[::-1])


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, and which of them each row is."""
    order = _sorted(rows)
    there = rows[order]
    starts = np.ones(len(rows), bool)
    starts[1:] = (there[1:] != there[:-1]).any(axis=1)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(starts) - 1
    return there[starts], which


def _learn(books: np.ndarray):
    """A function of batches (part, v, weight): sums (part, entry, at, total) of a task; at = width is the weight."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            part, rows = batch.column(0).to_numpy(), rows_of(batch.column(1), width)
            weight = batch.column(2).to_numpy().astype(np.int64)
            for p in np.unique(part):
                here = np.flatnonzero(part == p)
                here = here[_sorted(rows[here])]
                entry, _ = nearest_entries(rows[here], books[p])
                w = weight[here, None]
                np.add.at(total[p], entry, np.hstack([rows[here] * w, w]))
        p, e, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p.astype("i4"), e.astype("i4"), at.astype("i4"), total[p, e, at])], ["part", "entry", "at", "total"])

    return run


def _assign(books: np.ndarray, names: list[str]):
    """A function of batches (keys, v): (keys, code, error)."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = rows_of(batch.column(len(names)), parts * width)
            codes, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                there, which = distinct_rows(rows[:, p * width : (p + 1) * width])
                entry, distance = nearest_entries(there, books[p])
                codes[:, p] = entry[which]
                error += distance[which]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], [*names, "code", "error"])

    return run


def codebooks(vectors: DataFrame, length: int, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "id") -> np.ndarray:
    """(parts, entries, width) integers learned from all rows (id, v) of a stored table."""
    width = length // parts
    first = vectors.orderBy(F.col(id_col).asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    cuts = F.array(*(F.struct(F.lit(p).alias("part"), F.slice("v", p * width + 1, width).alias("v")) for p in range(parts)))
    counted = vectors.select(F.explode(cuts).alias("c")).groupBy(F.col("c.part").alias("part"), F.col("c.v").alias("v")).agg(F.count(F.lit(1)).alias("weight"))
    counted = materialise(counted.sortWithinPartitions("part", "v"), "parts")
    for _ in range(rounds):
        sums = counted.mapInArrow(_learn(books), "part int, entry int, at int, total long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))
        total = np.zeros((parts, books.shape[1], width + 1), np.int64)
        for r in sums.collect():  # at most parts x entries x (width + 1) rows
            total[r["part"], r["entry"], r["at"]] = r["total"]
        used = total[:, :, width] > 0
        books[used] = total[used][:, :width] // total[used][:, width:]
    return books


def compress(
    embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, np.ndarray | None]:
    """Rows (id, label, code, error, label_error) and the codebooks; None where no vector can be coded.

    entries is at most 256: an index takes two hex digits of the code.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must lie between 1 and 256")
    kinds = columns_of(embeddings.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")), "id", "label")
    vectors = materialise(integer_vectors(embeddings.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("e")), scale, "e", "id", "label"), "vectors")
    n = F.size("v")
    usual = vectors.filter((n > 0) & (n % parts == 0)).groupBy(n.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length, books = (usual["n"], None) if usual else (0, None)
    vectors = vectors.filter((n == length) & (n > 0))
    if usual:
        books = codebooks(vectors, length, parts, entries, rounds)
    run = _assign(books if usual else np.zeros((parts, 1, 1), np.int64), ["id", "label"])
    coded = materialise(vectors.mapInArrow(run, f"{kinds}, code string, error long"), "coded")
    errors = materialise(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "errors")
    out = coded.join(sized(errors), coded["label"].eqNullSafe(errors["l"])).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error")
    return out, books


def spelled(books: np.ndarray | None) -> str:
    """All entries' components in decimal by part, entry and position, joined by commas."""
    return ",".join(map(str, books.ravel().tolist())) if books is not None else ""


def digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(spelled(books).encode()).hexdigest()


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same result in DuckDB, over vectors of one length."""
    head = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
w AS (SELECT max(len(v)) // {parts} AS w FROM kept),
cut AS MATERIALIZED (SELECT vec_id, part, v[part * w + 1 : part * w + w] AS v FROM kept, w, range({parts}) r(part)),
b0 AS MATERIALIZED (SELECT part, entry, v FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""
    near = "a{i} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best FROM (SELECT c.vec_id, c.part, b.entry, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(c.v, b.v)]) AS d FROM cut c JOIN b{i} b ON c.part = b.part) GROUP BY vec_id, part)"
    steps = []
    for i in range(rounds):
        steps.append(near.format(i=i))
        steps.append(
            f"m{i} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY pos) AS v FROM (SELECT c.part, a.best.entry AS entry, u.pos, CAST(sum(c.v[u.pos]) AS DOUBLE) AS s, count(*) AS n FROM cut c JOIN a{i} a USING (vec_id, part), w, LATERAL (SELECT unnest(range(1, w.w + 1)) AS pos) u GROUP BY 1, 2, 3) GROUP BY 1, 2)"
        )
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.entry = m.entry)")
    steps.append(near.format(i=rounds))
    return (
        ", ".join([head, *steps])
        + f""",
coded AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"""
    )
