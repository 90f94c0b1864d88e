"""Best-fit packing of token sequences (operator 1).

Only lengths decide where an item goes, and there are at most `capacity` different lengths. So the plan is
made on the counts by length (at most `capacity` rows, whatever the corpus): items longer than a third of
the capacity are matched greedily in pairs, the smaller ones go to the tightest remaining gap, each kind of
gap being filled in one step. The plan is a list of runs; documents find their place from their rank among
the items of their length. The plan's size depends on the capacity alone, so it may be broadcast.

Edge cases: null or empty text is one item holding the final id; longer items are cut into pieces of the full
capacity and a rest; ties are broken by document and piece; repeated rows are packed once each; an empty
table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LibraryWords, Words, in_groups
from .common import materialise, partitions, tokenizer_path, with_text

#: An item of each length is dealt into so many groups a shuffle partition before it is ranked.
SALTS = 4


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, items, first bin, items a bin, offset in the bin) for counts by length."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first bin, bins)]
    order: list[int] = []  # the gaps, ascending
    bins = 0

    def put(length: int, items: int, first: int, each: int, offset: int) -> None:
        runs.append((length, rank[length], items, first, each, offset))
        rank[length] += items
        left[length] -= items

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            # the longest partner that still fits; items of one length pair among themselves
            b = next((b for b in reversed(large[: bisect.bisect_right(large, min(a, capacity - a))]) if left[b] - (a == b) > 0), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, bins, 1, 0)
            if b is not None:
                put(b, n, bins, 1, a)
            leave(capacity - a - (b or 0), bins, n)
            bins += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            i = bisect.bisect_left(order, s)
            if i == len(order):  # no gap holds it: as many new bins as its items fill
                n = -(-left[s] // (capacity // s))
                leave(capacity, bins, n)
                bins += n
                continue
            gap = order[i]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[i]
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, full * each, first, each, capacity - gap)
                leave(gap - each * s, first, full)
            if full < n:
                rest = min(left[s], each - 1) if left[s] < each else 0
                if rest:
                    put(s, rest, first + full, rest, capacity - gap)
                    leave(gap - rest * s, first + full, 1)
                leave(gap, first + full + bool(rest), n - full - bool(rest))
    return runs


def token_pieces(docs: DataFrame, capacity: int, path: str | None = None, final_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Cut every document's ids and the final id into pieces: (id, piece, start, length, ids_crc32[, ids])."""
    path = path or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Words(LibraryWords, path)
        last = np.asarray([final_id], "<u4").tobytes()
        for batch in batches:
            for own, texts in in_groups(batch.column(0), batch.column(1).to_pylist()):
                of, piece, start, length, crc, held = [], [], [], [], [], []
                for k, raw in enumerate(coder.texts(texts)):
                    raw += last
                    for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        of.append(k)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if ids:
                            held.append(np.frombuffer(part, "<i4"))
                columns = [own.take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.list_(pa.int32()))] * ids, ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col(id_col).alias("id"), with_text(docs, text_col).alias("text")).mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def pack(items: DataFrame, capacity: int, length_col: str = "length", by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to a stored table of items, each no longer than the capacity.

    The counts by length go to the driver (at most `capacity` rows). Ranks within a length come from a count
    for each (length, salt) and a rank inside it, so that a length that many items have is no single group.
    """
    spark = items.sparkSession
    counts = {r["n"]: r["c"] for r in items.groupBy(F.col(length_col).alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    runs = spark.createDataFrame(plan(counts, capacity), "run_length long, first_rank long, run_items long, first_bin long, each long, run_offset long")
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS * partitions(spark))))
    group = Window.partitionBy(length_col, "_salt")
    before = (
        salted.groupBy(length_col, "_salt").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col(length_col).alias("_l"), F.col("_salt").alias("_s"), F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    ranked = salted.withColumn("_rank", F.row_number().over(group.orderBy(*by)) - 1)
    ranked = ranked.join(before.hint("merge"), (F.col(length_col) == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    at = F.col("_rank") - F.col("first_rank")
    placed = ranked.join(F.broadcast(runs), (F.col(length_col) == F.col("run_length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("first_rank") + F.col("run_items")))
    return placed.select(
        *items.columns,
        (F.col("first_bin") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + at % F.col("each") * F.col(length_col)).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None, final_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack documents; the pieces are stored once, since they are read three times."""
    pieces = materialise(token_pieces(docs, capacity, path, final_id, id_col, text_col, ids), "pieces")
    return pack(pieces, capacity, by=(id_col, "piece"))
