"""Removal of repeated byte strings by two-stage suffix sorting (operator 6).

A byte goes if a string of WINDOW bytes that covers it also starts earlier in the corpus. Comparing all suffixes
of a corpus with each other would move every suffix; instead each window of WINDOW bytes is keyed by the least
hash of its GRAM-byte grams. Equal windows have equal keys, so only segments (maximal runs of window starts with
one key) of the same key need to meet. One shuffle of 40-byte rows brings them together: a segment whose whole
content occurs earlier is settled there, and only different segments of one key go on with their bytes. Those
are concatenated in batches of whole keys and suffix-sorted: suffixes smaller than their successors are sorted
directly, the others are induced by scanning the buckets, and adjacent common prefixes of WINDOW bytes give the
groups of equal windows. Segments of keys that very many different segments share are compared window by window
through an aggregation instead, with the same result, so no key is one task.

Edge cases: null and empty texts, and texts shorter than WINDOW, lose nothing; rows with equal ids are one
document, and a place in it is not earlier than itself; where an id has several texts, the one of the least hash
is the document and the others are left whole, as are rows with a null id; an empty table gives an empty table.
Ids are integers. Offsets are in UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import materialise, sized, with_text
from .near_dedup import CHUNK, _chunks, _mix, range_hashes, whole_groups

WINDOW, GRAM = 100, 32
#: A key with more open segments, or more bytes in them, is compared window by window.
HOT, HOT_BYTES = 4096, 8 << 20
GRAMS, SELF = WINDOW - GRAM + 1, 1 << 40
_U = np.uint64


@lru_cache(1)
def _constants() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 1 << 62)) * 2 + 1
    up, down = np.full(CHUNK + 1, base, _U), np.full(CHUNK + 1, pow(base, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return {"table": rng.integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1), "up": np.multiply.accumulate(up), "down": np.multiply.accumulate(down), "base": base}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    c = _constants()
    if n < len(c["up"]):
        return c["up"][: n + 1], c["down"][: n + 1]
    up, down = np.full(n + 1, c["base"], _U), np.full(n + 1, pow(c["base"], -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sliding(best, x: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of each `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :])


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the texts' offsets."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def segments(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of window starts with one key: (key, content hash, first start, bytes, text's index).

    Where the least gram occurs twice within a run, the run may repeat itself: SELF is added to its bytes.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < WINDOW:
        return none, none, none, none, none
    up, down = _powers(len(raw))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_constants()["table"][raw] * up[:-1], dtype=_U)])
    gram = _mix((total[GRAM:] - total[:-GRAM]) * down[: len(raw) - GRAM + 1])
    low = _sliding(np.minimum, gram, GRAMS)
    of = np.searchsorted(ends, np.arange(len(low)), side="right") - 1
    valid = np.arange(len(low)) + WINDOW <= ends[of + 1]
    new = valid.copy()
    new[1:] &= (low[1:] != low[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(low))
    stop = np.minimum(stop, ends[of[first] + 1] - WINDOW + 1) if len(first) else stop[:0]
    size = stop - first + WINDOW - 1
    content = _mix((total[first + size] - total[first]) * down[first] + size.astype(_U))
    content = _mix(content ^ range_hashes(raw.astype(_U) + _U(1), first, first + size))
    # a gram is some window's least if the largest of the least values around it is its own
    edge = np.zeros(GRAMS - 1, _U)
    least = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, np.where(valid, low, 0), edge]), GRAMS) == gram)
    if len(first) and len(least) > 1:
        a, b = least[:-1], least[1:]
        near = (gram[a] == gram[b]) & (b - a <= GRAMS)
        a, b = a[near], b[near]
        at = np.maximum(np.searchsorted(first, np.maximum(np.minimum(b - GRAMS + 1, a), 0), side="right") - 1, 0)
        end = np.searchsorted(first, a, side="right") - 1
        while len(a):  # the runs whose windows can hold both grams
            hit = (low[first[at]] == gram[b]) & (first[at] <= a) & (b + GRAM <= first[at] + (size[at] & (SELF - 1)))
            size[at[hit]] |= SELF
            more = ~hit & (at < end)
            a, b, at, end = a[more], b[more], at[more] + 1, end[more]
    return low[first].view(np.int64), content.view(np.int64), first, size, of[first]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, content, doc, start, bytes) of the first place of each segment in a batch; bytes < 0: settled."""
    for batch in batches:
        for at, texts in _chunks(batch.column(1)):
            raw, ends = _raw(texts)
            key, content, first, size, of = segments(raw, ends)
            if not len(key):
                continue
            doc, start = batch.column(0).slice(at, len(texts)).to_numpy()[of], first - ends[of]
            order = np.lexsort((start, doc, content, key))
            key, content, doc, start, size = (x[order] for x in (key, content, doc, start, size))
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
            again &= (doc != doc[head]) | (start != start[head])
            # settled places of a document that touch become one
            d, a, b = _merged(doc[again], start[again], start[again] + (size[again] & (SELF - 1)))
            yield _rows(["key", "content", "doc", "start", "bytes"], np.concatenate([key[~again], _mix(d.astype(_U)).view(np.int64)]), np.concatenate([content[~again], a]), np.concatenate([doc[~again], d]), np.concatenate([start[~again], a]), np.concatenate([size[~again], a - b]))


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals [a, b) of each document that touch or overlap."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    if not len(doc):
        return doc, a, b
    # ends are made monotone within a document by shifting each document past the one before
    shift = np.cumsum(np.append(0, doc[1:] != doc[:-1])) * (int(b.max()) + 2)
    reach = np.maximum.accumulate(b + shift)
    new = np.append(True, (a + shift)[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], a[new], (reach - shift)[last]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, start, stop): key null for removed places, else a segment that others of its key may match.

    Reads rows sorted by (key, content, doc, start) as a stream; at most one segment is held back.
    """
    names = ["key", "doc", "start", "stop"]
    key0 = content0 = doc0 = start0 = None
    held, several = None, False  # the only segment of the current key so far

    def out(done: list, keys: list) -> pa.RecordBatch:
        d, a, b = (np.concatenate([x[i] for x in done]) for i in range(3)) if done else (np.zeros(0, np.int64),) * 3
        d, a, b = _merged(d, a, b)
        rest = [np.concatenate([np.atleast_1d(x[i]) for x in keys]) for i in range(4)] if keys else [np.zeros(0, np.int64)] * 4
        column = pa.array(np.concatenate([np.zeros(len(d), np.int64), rest[0]]), pa.int64(), mask=np.arange(len(d) + len(rest[0])) < len(d))
        return pa.RecordBatch.from_arrays([column, *(pa.array(np.concatenate(x), pa.int64()) for x in ((d, rest[1]), (a, rest[2]), (b, rest[3])))], names)

    for batch in batches:
        key, content, doc, start, size = (batch.column(i).to_numpy() for i in range(5))
        settled = size < 0
        done = [(doc[settled], start[settled], start[settled] - size[settled])]
        key, content, doc, start, size = (x[~settled] for x in (key, content, doc, start, size))
        keys: list = []
        own, size = (size & SELF) > 0, size & (SELF - 1)
        if len(key):
            new_key = np.append(key0 is None or key[0] != key0, key[1:] != key[:-1])
            new = new_key | np.append(content0 is None or content[0] != content0, content[1:] != content[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            same_doc = np.where(head >= 0, doc[head], doc0 if doc0 is not None else -1) == doc
            same_start = np.where(head >= 0, start[head], start0 if start0 is not None else -1) == start
            again = ~new & ~(same_doc & same_start)
            done.append((doc[again], start[again], start[again] + size[again]))
            rep = np.flatnonzero(new)
            group = np.cumsum(new_key)[rep]  # 0: the key of the batch before
            n = np.bincount(group, minlength=int(new_key.sum()) + 1)
            if held is not None and n[0]:
                keys.append(held)
                held, several = None, True
            multi = n[group] > 1
            multi[group == 0] = several
            multi |= own[rep]
            keys.append((key[rep[multi]], doc[rep[multi]], start[rep[multi]], (start + size)[rep[multi]]))
            if new_key.any():
                last = rep[group == group[-1]] if len(rep) else rep
                several = len(last) > 1 or bool(own[last[0]])
                held = None if several else tuple(x[last[0]] for x in (key, doc, start, start + size))
            key0, content0 = key[-1], content[-1]
            if head[-1] >= 0:
                doc0, start0 = doc[head[-1]], start[head[-1]]
        yield out(done, keys)


def suffix_array(x: np.ndarray, depth: int = 104) -> np.ndarray:
    """Suffixes of a byte array in the order of their first `depth` bytes (ties in any order), by two stages."""
    n = len(x)
    words = np.zeros(n + depth + 8, np.uint64)
    padded = np.concatenate([x, np.zeros(depth + 16, np.uint8)])
    for i in range(8):
        words |= padded[i : i + len(words)].astype(np.uint64) << np.uint64(56 - 8 * i)
    # a suffix is smaller than its successor if its next different byte is larger; the last one is not
    rises = np.zeros(n, bool)
    rises[:-1] = x[:-1] < x[1:]
    flat = np.append(x[:-1] == x[1:], False)
    decided = np.where(flat, n, np.arange(n))
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    small = rises[np.minimum(decided, n - 1)]
    order = np.flatnonzero(small)
    order = order[np.argsort(words[order], kind="stable")]
    value = words[order]
    new = np.append(True, value[1:] != value[:-1]) if len(order) else np.zeros(0, bool)
    for step in range(8, depth, 8):  # sort on only what is still tied
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        value = words[order[at] + step]
        by = np.lexsort((value, group))
        order[at] = order[at][by]
        group, value = group[by], value[by]
        new[at[1:]] |= (value[1:] != value[:-1]) & (group[1:] == group[:-1])
    bounds = np.searchsorted(x[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[x[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        parts = list(waiting[c])
        now = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        while len(now):  # runs of one byte: a bucket also feeds itself
            before = now - 1
            before = before[before >= 0]
            now = before[(x[before] == c) & ~small[before]]
            if len(now):
                parts.append(now)
        bucket = np.concatenate([*parts, order[bounds[c] : bounds[c + 1]]])
        if len(bucket):
            out.append(bucket)
            before = bucket - 1
            before = before[before >= 0]
            before = before[x[before] > c]
            first = x[before]
            by = np.argsort(first, kind="stable")
            first, before = first[by], before[by]
            cuts = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(first)) if len(cuts) else [], strict=True):
                waiting[first[a]].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_windows(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Starts of windows that also occur at a smaller index; room: bytes left in the own segment."""
    order = suffix_array(x)
    order = order[room[order] >= WINDOW]
    if len(order) < 2:
        return order[:0]
    padded = np.concatenate([x, np.zeros(8, np.uint8)])
    words = np.zeros(len(x), np.uint64)
    for i in range(8):
        words |= padded[i : i + len(x)].astype(np.uint64) << np.uint64(8 * i)
    common = np.zeros(len(order) - 1, np.int64)  # adjacent common prefixes, up to WINDOW
    live = np.arange(len(common))
    for step in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        live = live[words[order[live] + step] == words[order[live + 1] + step]]
        common[live] = step + 8
    new = np.append(True, common < WINDOW)
    least = np.minimum.reduceat(order, np.flatnonzero(new))
    return np.sort(order[order != least[np.cumsum(new) - 1]])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, start, stop) of repeated windows among the segments of each key, rows sorted by (key, doc, start)."""
    for table, _ in whole_groups(batches, 1):
        if not table.num_rows:
            continue
        key, doc, start = (table.column(i).to_numpy() for i in range(3))
        once = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))  # repeated rows
        table, doc, start = table.filter(pa.array(once)), doc[once], start[once]
        pieces = table.column(3).to_pylist()
        size = np.array([len(p) + 1 for p in pieces])
        x = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), size)
        hit = repeated_windows(x, (begin + size - 1)[of] - np.arange(len(x)))
        at = start[of[hit]] + hit - begin[of[hit]]
        yield _rows(["doc", "start", "stop"], *_merged(doc[of[hit]], at, at + WINDOW))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, start, segment) from a document's text and its list of segments."""
    for batch in batches:
        key, doc, start, part = [], [], [], []
        for d, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = text.encode()
            for w in wanted:
                key.append(w["key"])
                doc.append(d)
                start.append(w["start"])
                part.append(raw[w["start"] : w["stop"]])
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(part, pa.binary())], ["key", "doc", "start", "segment"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc, start) of each window of hot segments."""
    for batch in batches:
        for d, s, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            marks = [hashlib.blake2b(part[i : i + WINDOW], digest_size=16).digest() for i in range(len(part) - WINDOW + 1)]
            h = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            yield _rows(["h1", "h2", "doc", "start"], h[:, 0], h[:, 1], np.full(len(h), d), s + np.arange(len(h)))


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, doc): doc is the id of a row that is judged, null for a null id and for the further texts of an id."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column, since smaller ids come earlier")
    rows = docs.select(F.col(id_col).alias("id"), with_text(docs, text_col).alias("text"))
    several = rows.groupBy("id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high")).filter("low != high AND id IS NOT NULL")
    several = materialise(several.select(F.col("id").alias("again"), "low"), "several")
    rows = rows.join(sized(several), F.col("id") == F.col("again"), "left")
    return rows.select("id", "text", F.when(F.col("again").isNull() | (F.xxhash64("text") == F.col("low")), F.col("id").cast("long")).alias("doc"))


def repeated_intervals(judged: DataFrame) -> DataFrame:
    """(doc, start, stop) for rows (doc, text): byte intervals whose every byte is covered by a window that starts earlier elsewhere."""
    texts = judged.filter("doc IS NOT NULL").select("doc", "text")
    rows = texts.mapInArrow(_found, "key long, content long, doc long, start long, bytes long")
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "content", "doc", "start")
    found = materialise(sorted_rows.mapInArrow(_settled, "key long, doc long, start long, stop long"), "segments")
    open_ = found.filter("key IS NOT NULL")
    hot = materialise(open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bytes")).filter(f"n > {HOT} OR bytes > {HOT_BYTES}").select("key", F.lit(True).alias("hot")), "hot")
    any_hot = not hot.isEmpty()
    wanted = open_.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "stop")).alias("wanted"))
    needed = texts.join(sized(materialise(open_.select("doc").distinct(), "ids")), "doc")
    parts = needed.join(wanted.hint("merge"), "doc").mapInArrow(_cut, "key long, doc long, start long, segment binary")
    if any_hot:
        parts = materialise(parts, "parts")
        busy = parts.join(sized(hot), "key").select("key", "doc", "start", "segment").mapInArrow(_windows, "h1 long, h2 long, doc long, start long")
        first = busy.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", F.col("first.doc").alias("d"), F.col("first.start").alias("s"))
        again = busy.join(first.hint("merge"), ["h1", "h2"]).filter("doc != d OR start != s").select("doc", "start", (F.col("start") + WINDOW).alias("stop"))
        parts = parts.join(sized(hot), "key", "left_anti")
    matched = parts.repartition("key").sortWithinPartitions("key", "doc", "start").mapInArrow(_matched, "doc long, start long, stop long")
    done = found.filter("key IS NULL").select("doc", "start", "stop").unionByName(matched)
    return done.unionByName(again) if any_hot else done


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every row: kept holds the remaining bytes, or their SHA-256."""
    texts = _judged(docs, id_col, text_col)
    gone = repeated_intervals(texts).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    joined = texts.join(gone.hint("merge"), "doc", "left").select("id", "text", "gone")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, pieces, at, spans = text.encode(), [], 0, 0
                for start, stop in sorted((g["start"], g["stop"]) for g in gone or ()):
                    if start > at or not spans:
                        pieces.append(raw[at:start])
                        spans += 1
                    at = max(at, stop)
                pieces.append(raw[at:])
                kept = b"".join(pieces)
                for column, x in zip(columns, (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest() if digest else kept), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(strip, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}").withColumnRenamed("id", id_col)
