"""Document scores by cross-entropy difference (operator 9).

Two bigram models of the same form share one vocabulary: the target model counts the documents that the caller
marks, the background model counts all documents. A document's score is its mean loss a token under the target
model less that under the background model; below zero it resembles the target. A document's own counts are
taken out of both models while it is scored, so no document is scored by having been learned.

Every distinct word and every distinct pair of neighbours of the whole corpus is counted by itself; nothing that
grows with the corpus is broadcast or gathered. Grams are told apart by 63 bits of a keyed hash and one bit that
says word or pair. Texts are dealt into parts of about PART_BYTES, and the hash range into buckets, as many as
the corpus has BUCKET_BYTES. A part sends each bucket its distinct grams there, sorted, with their counts; so the
commonest gram comes once a part. The bucket adds them up and answers with the totals alone, in the order in
which the part sent its grams. A task holds one part or one bucket.

Edge cases: null and empty texts have no tokens and null scores; with no target document the target model is
uniform; repeated rows count and are scored each; an empty table gives an empty table; a text of more than
PART_BYTES is a part of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, small_batches, with_text
from .near_dedup import _chunks, _constants, _mix, hashed_words
from .spotsigs import WORDS

#: Weight of the word's own probability beside the pair's counts.
PRIOR = 4.0
PART_BYTES, BUCKET_BYTES = 3 << 20, 3 << 20
#: Text of the parts (or of a share of all grams as large) that one task of a shuffle gets.
TASK_BYTES = 64 << 20
_U = np.uint64


@dataclass(frozen=True)
class Counted:
    """The parts of a corpus (part, size, rows), the totals of their grams (part, bucket, target, background), the
    number of distinct words, the tokens of both models, and the tasks that a shuffle of the parts should have."""

    parts: DataFrame
    totals: DataFrame
    words: int
    tokens: tuple[int, int]
    tasks: int


@dataclass(frozen=True)
class Grams:
    """Distinct grams of some texts in ascending order, and the place among them of each token's word and pair."""

    grams: np.ndarray
    word: np.ndarray
    pair: np.ndarray  # len(grams) for a token with none before it
    first: np.ndarray
    last: np.ndarray


def token_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (even) and of the pairs of a token and the one before (odd), and each text's first and last token."""
    found = [hashed_words(part, WORDS) for _, part in _chunks(texts)]
    words = np.concatenate([w for w, _, _ in found]) if found else np.zeros(0, _U)
    shift = np.cumsum([0, *(len(w) for w, _, _ in found)])
    first, last = (np.concatenate([np.zeros(0, np.int64), *(x[i] + s for x, s in zip(found, shift, strict=False))]) for i in (1, 2))
    before = np.append(np.zeros(1, _U), words[:-1])[: len(words)]
    return words & ~_U(1), _mix(before * _constants()["step"] + words) | _U(1), first, last


def distinct_grams(texts: pa.Array) -> Grams:
    word, pair, first, last = token_grams(texts)
    inner = np.ones(len(word), bool)  # a first token has none before it
    inner[first[last > first]] = False
    grams, at = np.unique(np.concatenate([word, pair[inner]]), return_inverse=True)
    pairs = np.full(len(word), len(grams))
    pairs[inner] = at[len(word) :]
    return Grams(grams, at[: len(word)], pairs, first, last)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of unsigned 64-bit numbers, first bytes first: small numbers leave runs of zeros, which compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _parts(docs: DataFrame, target: Column, id_col: str, text_col: str) -> DataFrame:
    """Stored rows (part, size, rows): neighbouring rows (id, text, t) of one task, as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId() << 32, [], 0

        def stored() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "size", "rows"])

        for batch in batches:
            for at, texts in _chunks(batch.column(1)):
                held.append(batch.slice(at, len(texts)))
                size += texts.nbytes
                if size >= PART_BYTES:
                    yield stored()
                    part, held, size = part + 1, [], 0
        if held:
            yield stored()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), with_text(docs, text_col).alias("text"), F.coalesce(target, F.lit(False)).alias("t"))
    return materialise(rows.mapInArrow(run, "part long, size long, rows binary"), "parts")


def _rows_of(stored: bytes) -> tuple[pa.Array, pa.Array, np.ndarray]:
    table = pa.ipc.open_stream(stored).read_all().combine_chunks()
    ids, texts, marks = (table.column(i).combine_chunks() for i in range(3))
    return ids, texts, marks.to_numpy(zero_copy_only=False).astype(bool)


def _sends(buckets: int):
    """(part, bucket, grams, target, background): the grams as differences, the counts within the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, texts, marks = _rows_of(stored.as_py())
                g = distinct_grams(texts)
                places, of = np.concatenate([g.word, g.pair]), np.tile(np.repeat(marks, g.last - g.first), 2)
                n = len(g.grams)
                background, target = np.bincount(places, minlength=n + 1)[:n], np.bincount(places[of], minlength=n + 1)[:n]
                bucket = (g.grams >> _U(32)) * _U(buckets) >> _U(32)
                at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:n])
                cuts = list(zip(at.tolist(), [*at[1:].tolist(), n], strict=True)) if n else []
                for i in range(0, len(cuts), 32):
                    some = cuts[i : i + 32]
                    columns = [_planes(np.diff(g.grams[a:b], prepend=_U(0))) for a, b in some], [_planes(target[a:b]) for a, b in some], [_planes(background[a:b]) for a, b in some]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part)), pa.array(bucket[[a for a, _ in some]].astype(np.int64)), *(pa.array(c, pa.binary()) for c in columns)], ["part", "bucket", "grams", "target", "background"])

    return run


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of a bucket's rows, their two totals, each row's places among them, and where its places end."""
    sent = [np.cumsum(_numbers(x), dtype=_U) for x in table.column("grams").to_pylist()]
    grams, at = np.unique(np.concatenate(sent), return_inverse=True)
    target, background = (np.bincount(at, np.concatenate([_numbers(x) for x in table.column(c).to_pylist()]).astype(np.float64), len(grams)).astype(np.int64) for c in ("target", "background"))
    return grams, target, background, at, np.cumsum([0, *map(len, sent)])


def _totals(table: pa.Table) -> pa.Table:
    """Each part's totals in the order of its grams; the first row also has the bucket's distinct words and tokens."""
    grams, target, background, at, ends = _added(table)
    word = grams & _U(1) == 0
    first = [[int(x), *[0] * (table.num_rows - 1)] for x in (word.sum(), target[word].sum(), background[word].sum())]
    answers = [[_planes(c[at[a:b]]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)] for c in (target, background)]
    columns = [table.column("part"), table.column("bucket"), *(pa.array(x, pa.binary()) for x in answers), *(pa.array(x, pa.int64()) for x in first)]
    return pa.table(columns, ["part", "bucket", "target", "background", "words", "target_tokens", "background_tokens"])


def _tasks(parts: DataFrame) -> tuple[int, int]:
    """The buckets and the tasks of a shuffle: both grow with the texts."""
    size = parts.agg(F.sum("size")).first()[0] or 0
    least = partitions(parts.sparkSession)
    return max(least, -(-size // BUCKET_BYTES)), max(least, -(-size // TASK_BYTES))


def _sent(parts: DataFrame, buckets: int, tasks: int) -> DataFrame:
    rows = parts.select("part", "rows").mapInArrow(_sends(buckets), "part long, bucket long, grams binary, target binary, background binary")
    return rows.repartition(tasks, "bucket")


def count(docs: DataFrame, target: Column, id_col: str = "doc_id", text_col: str = "text") -> Counted:
    """Counts of both models over all documents; target is true for the documents of the target model."""
    parts = _parts(docs, target, id_col, text_col)
    buckets, tasks = _tasks(parts)
    totals = materialise(_sent(parts, buckets, tasks).groupBy("bucket").applyInArrow(_totals, "part long, bucket long, target binary, background binary, words long, target_tokens long, background_tokens long"), "totals")
    sums = totals.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "target_tokens", "background_tokens"))).first()
    return Counted(parts, totals.select("part", "bucket", "target", "background"), int(sums[0]), (int(sums[1]), int(sums[2])), tasks)


def gram_counts(docs: DataFrame, target: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, target, background): a row for each distinct word (even) and each distinct pair (odd) of the corpus."""

    def rows(table: pa.Table) -> pa.Table:
        grams, one, two, _, _ = _added(table)
        return pa.table([grams.view(np.int64), one, two], ["gram", "target", "background"])

    parts = _parts(docs, target, id_col, text_col)
    return _sent(parts, *_tasks(parts)).groupBy("bucket").applyInArrow(rows, "gram long, target long, background long")


def _own(of: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each token's gram, a place under 2^32, occurs in its own document."""
    _, at, n = np.unique((of.astype(_U) << _U(32)) | place.astype(_U), return_inverse=True, return_counts=True)
    return n[at].astype(np.float64)


def losses(counts: np.ndarray, tokens: np.ndarray, size: int, g: Grams, own_word: np.ndarray, own_pair: np.ndarray) -> np.ndarray:
    """Natural-log loss of each token under one model without its own document.

    counts are the model's, by place; tokens are the model's without the token's document, size is the vocabulary's,
    own_word and own_pair are the document's own counts as far as the model has them.
    """
    counts = np.append(counts, 0).astype(np.float64)
    left = np.maximum(counts[g.word] - own_word, 0)
    alone = (left + 1) / (np.maximum(tokens, 0) + size)
    context = np.append(np.zeros(1), left[:-1])[: len(left)]
    joint = np.maximum(counts[g.pair] - own_pair, 0)
    return -np.log(np.where(g.pair == len(counts) - 1, alone, (joint + PRIOR * alone) / (context + PRIOR)))


def score(docs: DataFrame, target: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, difference) of every row; target is true for the target model's documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    counted = count(docs, target, id_col, text_col)
    size, totals = max(1, counted.words), counted.tokens
    names = ["id", "n_tokens", "target_loss", "background_loss", "difference"]

    def run(stored: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts, marks = _rows_of(stored.column("rows")[0].as_py())
        g = distinct_grams(texts)
        by = np.argsort(answers.column("bucket").to_numpy())
        n = g.last - g.first
        of = np.repeat(np.arange(len(n)), n)
        own = _own(of, g.word), _own(of, g.pair)
        mean = []
        for name, total, known in zip(("target", "background"), totals, (marks, np.ones(len(n), bool)), strict=True):
            got = answers.column(name).to_pylist()
            counts = np.concatenate([np.zeros(0, _U), *(_numbers(got[i]) for i in by)])
            tokens = total - np.where(known, n, 0)
            sums = np.append(0.0, np.cumsum(losses(counts, tokens[of], size, g, *(known[of] * x for x in own))))
            mean.append((sums[g.last] - sums[g.first]) / np.maximum(n, 1))
        columns = [pa.array(x, pa.float64(), mask=n == 0) for x in (*mean, mean[0] - mean[1])]
        return pa.table([ids, pa.array(n, pa.int64()), *columns], names)

    texts, answers = counted.parts.select("part", "rows").repartition(counted.tasks, "part"), counted.totals.repartition(counted.tasks, "part")
    both = texts.groupBy("part").cogroup(answers.groupBy("part"))
    return both.applyInArrow(run, f"id {kind}, n_tokens long, target_loss double, background_loss double, difference double").withColumnRenamed("id", id_col)
