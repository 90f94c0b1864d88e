"""Document fingerprints by SpotSigs (operator 5).

At each common word (anchor) a text gives one spot signature: the anchor and the chain of the next CHAIN content
words. The fingerprint is the set of signatures, spelled as sorted 32-bit hashes in base64. Two fingerprints are
compared by Jaccard similarity; sets whose sizes alone rule out the threshold are never merged, which is what
partitioning by set length exploits: a set meets only its own and the neighbouring length partition.

Edge cases: null and empty texts have an empty fingerprint (two empty ones are alike, one is unlike any other);
a text without anchors takes every word as an anchor, so it still has signatures; a text of one word has that
word as its signature; rows with equal ids are ordered by text; an empty table gives an empty table; further
columns are ignored. Rows with a null id come first, and the last row is followed by the smallest id.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, materialise, partitions, sized, with_text
from .near_dedup import _chunks, _constants, _mix, byte_values, components, hashed_words, whole_groups

#: Content words of a chain, and sets that one group compares at once.
CHAIN, LARGEST = 2, 512
#: Text of one task when documents meet their neighbours: the tasks grow with the corpus.
TASK_BYTES = 64 << 20
#: Buckets of ids that are put in order together.
BLOCK = 4096
#: Anchors: common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am an auch auf aus bei bin das dem den der des die durch ein eine einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so um und vom von vor war wie wir wird zu zum zur "
    "au aux avec ce ces cette d dans de des du elle en est et il ils je l la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous y "
    "al como con de del el ella ellos en entre era es esta este esto ha hay la las lo los más mi muy no o para pero por que se si sin sobre su sus también te un una y ya"
).split()
_U = np.uint64


#: Every ASCII character but letters and digits separates words; A-Z are a-z.
WORDS = byte_values([b for b in range(128) if not chr(b).isalnum()])


@lru_cache(1)
def _anchors() -> np.ndarray:
    return np.sort(hashed_words(pa.array([" ".join(sorted(set(ANCHORS)))]), WORDS)[0])


def signature_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of each text."""
    anchors, step = _anchors(), _constants()["step"]
    words, first, last = hashed_words(texts, WORDS)
    at = np.searchsorted(anchors, words)
    anchor = np.zeros(len(words), bool)
    anchor[at < len(anchors)] = anchors[at[at < len(anchors)]] == words[at < len(anchors)]
    found = np.add.reduceat(np.append(anchor, False), np.append(first, len(words)))[:-1] if len(words) else np.zeros(len(first))
    bare = np.repeat((found == 0) & (last > first), last - first)  # words of texts without an anchor
    content = np.flatnonzero(~anchor | bare)
    spots = np.flatnonzero(anchor | bare)
    end = np.repeat(last, last - first)
    value = words[spots].copy()
    nth = np.searchsorted(content, spots, side="right")
    for i in range(CHAIN):
        k = nth + i
        follows = np.append(content, len(words))[np.minimum(k, len(content))]
        value = value * step + np.where(follows < end[spots], np.append(words, _U(0))[follows], _U(0))
    value = (_mix(value) >> _U(32)).astype("<u4")
    bounds = np.searchsorted(spots, np.append(first, len(words)))
    bounds[:-1] = np.searchsorted(spots, first)
    stops = np.searchsorted(spots, last)
    return [np.unique(value[a:b]) for a, b in zip(bounds[:-1].tolist(), stops.tolist(), strict=True)]


def spelled(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.tobytes()).decode()


def length_partition(n: int, threshold: float = 0.5) -> int:
    """Sets whose partitions differ by more than one cannot reach the threshold."""
    return 0 if n == 0 else 1 + int(math.log(n) / -math.log(threshold))


def pruned_jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of sorted sets, or 0 where their sizes alone rule out the threshold."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or small < threshold * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def _bounds(docs: DataFrame, id_col: str, text_col: str, quantiles: int = 128) -> tuple[list[int], int]:
    """At most `quantiles` ids that cut the id range into parts of about equal row counts, and the bytes of all texts."""
    got = docs.agg(F.percentile_approx(F.col(id_col), [i / quantiles for i in range(quantiles + 1)], 2000).alias("q"), F.sum(F.octet_length(text_col)).alias("n")).first()
    return sorted(set(got["q"] or [0])), int(got["n"] or 0)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, extra, id, text) such that, sorted, each row with extra = 0 stands before its next document.

    Ids are cut into buckets of consecutive ids, and the first document of each bucket is also added at the end
    of the bucket before. So the texts are shuffled once, and buckets and tasks grow with the texts.
    """
    bounds, size = _bounds(docs, id_col, text_col)
    tasks = max(partitions(docs.sparkSession), math.ceil(size / TASK_BYTES))
    parts = max(1, math.ceil(4 * tasks / len(bounds)))
    i = F.col("id")
    low = F.array(*(F.lit(int(b)).cast("long") for b in bounds))
    step = F.array(*(F.lit(max(1, -(-(b - a) // parts))).cast("long") for a, b in zip(bounds, [*bounds[1:], bounds[-1] + 1], strict=True)))
    q = F.greatest(F.size(F.filter(low, lambda b: b <= i)) - 1, F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), with_text(docs, text_col).alias("text")).withColumn("q", F.coalesce(q, F.lit(0)))
    within = F.least(F.greatest(F.floor((i - F.get(low, F.col("q"))) / F.get(step, F.col("q"))), F.lit(0)), F.lit(parts - 1))
    rows = rows.withColumn("bucket", F.coalesce(F.col("q") * parts + within, F.lit(0)).cast("long")).drop("q")
    first = materialise(rows.groupBy("bucket").agg(F.min("id").alias("first")), "first")  # a row for each bucket
    # the bucket before: within blocks of buckets, and over the blocks' last ones
    block = F.floor(F.col("bucket") / BLOCK)
    last = first.groupBy(block.alias("block")).agg(F.max("bucket").alias("last"))
    order = Window.orderBy("block")  # a row for each BLOCK buckets
    last = last.select("block", F.coalesce(F.lag("last").over(order), F.max("last").over(Window.partitionBy())).alias("earlier"))
    before = first.withColumn("block", block).join(F.broadcast(last), "block")
    before = before.select(F.col("first").alias("fid"), F.coalesce(F.lag("bucket").over(Window.partitionBy("block").orderBy("bucket")), "earlier").alias("to"))
    both = rows.join(sized(materialise(before, "before")), rows["id"] == F.col("fid"), "left")
    own, extra = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("x")), F.struct(F.col("to").alias("b"), F.lit(1).alias("x"))
    placed = both.select("id", "text", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("p"))
    return placed.select(F.col("p.b").alias("bucket"), F.col("p.x").alias("extra"), "id", "text").repartition(tasks, "bucket").sortWithinPartitions("bucket", "extra", "id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, n_signatures, length_partition) of every row, without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = signature_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spelled(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64()), pa.array([length_partition(len(s)) for s in sets], pa.int32())], ["id", "fingerprint", "n_signatures", "length_partition"])

    return docs.select(F.col(id_col).alias("id"), with_text(docs, text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string, n_signatures long, length_partition int").withColumnRenamed("id", id_col)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit (second half from the next document), and their likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held: list[tuple] = []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            texts = [r[3] for r in rows]
            sets = signature_sets(pa.array(texts, pa.string()))
            use = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
            edits = [(t := texts[k])[: len(t) - len(t) // 2] + texts[k + 1][: len(t) // 2] for k in use]
            other = signature_sets(pa.array(edits, pa.string())) if edits else []
            columns = (
                [rows[k][2] for k in use], [len(texts[k]) for k in use], [hashlib.sha256(e.encode()).hexdigest() for e in edits], [spelled(sets[k]) for k in use], [spelled(s) for s in other],
                [pruned_jaccard(sets[k], s) for k, s in zip(use, other, strict=True)], [pruned_jaccard(sets[k], sets[k + 1]) for k in use],
            )
            kinds = (id_kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            id_kind = batch.column(2).type
            size = 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[3])
                if size > 2_000_000:
                    yield made(held)
                    held, size = held[-1:], 0
        if held:
            yield made(held)

    return with_next(docs, id_col, text_col).mapInArrow(run, f"{columns_of(docs.select(F.col(id_col).alias('id')), 'id')}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)


def _tiles(blocks, own):
    """The pairs of blocks, as numbers, that a member of block `own` takes part in."""
    return F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.least(x, own) * blocks + F.greatest(x, own))


def _spanning(threshold: float):
    """Links of each group (part, sig, tile) of rows sorted by set length, spanning its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, 3):
            ids, sets = table.column(4).to_numpy(), [np.frombuffer(x, "<u4") for x in table.column(5).to_pylist()]
            lows, highs = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                label = list(range(a, b))
                for i in range(a, b):
                    for j in range(i + 1, b):
                        if len(sets[j]) * threshold > len(sets[i]):
                            break  # rows are sorted by length: no later set can reach the threshold
                        if label[i - a] != label[j - a] and pruned_jaccard(sets[i], sets[j], threshold) >= threshold:
                            lows.append(ids[i])
                            highs.append(ids[j])
                            old, new = label[j - a], label[i - a]
                            label = [new if x == old else x for x in label]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, ids.dtype)) for x in (lows, highs)], ["low", "id"])

    return run


def meetings(classes: DataFrame, threshold: float) -> DataFrame:
    """(part, sig, id, n, m): the m sets that meet at a signature, from distinct sets (id, raw); n is a set's size.

    A set stands under as many of its rarest signatures as any similar set must share one, in its own length partition
    and the next longer one. Signatures at which the same sets meet give the same links, so one of them is kept; equal
    meetings are told by their size and 128 bits of their ids.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, LARGEST):
                ids, raw = batch.column(0).slice(start, LARGEST).to_numpy(), batch.column(1).slice(start, LARGEST).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(r) // 4 for r in raw])), pa.array(np.frombuffer(b"".join(raw), "<i4"))], ["id", "sig"])

    each = classes.select("id", "raw").mapInArrow(spread, "id long, sig int")
    ranked = each.join(each.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).hint("merge"), "sig")
    own = Window.partitionBy("id")
    rare = ranked.select("id", "sig", F.row_number().over(own.orderBy("df", "sig")).alias("k"), F.count(F.lit(1)).over(own).alias("n")).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    part = F.floor(F.log("n") / -math.log(threshold)).cast("int")
    prefix = materialise(rare.select("id", F.col("n").cast("int").alias("n"), "sig", part.alias("part")), "prefix")
    prefix = prefix.select("id", "n", "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    met = prefix.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64("id", F.lit("b"))).alias("b")).filter("m > 1")
    met = met.groupBy("m", "a", "b").agg(F.min(F.struct("part", "sig")).alias("g")).select("g.part", "g.sig", "m")
    return prefix.join(met.hint("merge"), ["part", "sig"])


def near_classes(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row: the classes of fingerprints linked at the threshold, by their smallest id.

    Sets are partitioned by length; a set meets those of its own and of the next longer partition that share one
    of its rarest signatures, as many of them as any similar set must share one. Equal fingerprints are one class.
    Only ids and signatures are shuffled to find who meets; of signatures that the same sets share, one stays, so near
    copies of a long text are compared once and not for every signature. Groups beyond LARGEST sets are cut into
    blocks, and every pair of blocks is a group.

    Edge cases: a text without signatures (null and empty ones among them) is linked with nothing and has its own id;
    every row of an id counts by its own text; a null id is linked like others but names no component, so a component
    of null ids alone has a null one; an empty table gives an empty table; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _chunks(batch.column(1)):
                sets = signature_sets(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "raw"])

    rows = docs.select(F.col(id_col).alias("id"), with_text(docs, text_col).alias("text")).mapInArrow(sign, f"id {kind}, n int, raw binary")
    signed = materialise(rows, "signed")
    # a class has a number of its own: rows of one id may have several texts
    classes = materialise(signed.filter("n > 0").groupBy("raw").agg(F.min("id").alias("doc")).withColumn("id", F.monotonically_increasing_id()), "classes")
    shared = materialise(meetings(classes, threshold), "shared")
    blocks = F.ceil(F.col("m") / LARGEST).cast("long")
    tiled = shared.select("part", "sig", F.explode(_tiles(blocks, F.pmod(F.xxhash64("id"), blocks))).alias("tile"), "n", "id").join(classes.select("id", "raw").hint("merge"), "id")
    groups = tiled.select("part", "sig", "tile", "n", "id", "raw").repartition("part", "sig", "tile").sortWithinPartitions("part", "sig", "tile", "n", "id")
    linked = components(groups.mapInArrow(_spanning(threshold), "low long, id long"))
    linked = materialise(linked.unionByName(linked.select(F.col("low").alias("id"), "low").distinct()), "linked")
    least = linked.join(classes.select("id", "doc").hint("merge"), "id").groupBy("low").agg(F.min("doc").alias("least"))
    of_class = classes.join(linked.hint("merge"), "id", "left").join(sized(materialise(least, "least")), "low", "left").select("raw", F.when(F.col("low").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id"))
    out = signed.select("id", "n", "raw").join(of_class.hint("merge"), "raw", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
