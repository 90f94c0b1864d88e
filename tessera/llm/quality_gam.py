"""Quality classifier: a generalised additive model with pairwise interactions (operator 2).

Shallow trees on one binned feature at a time are boosted cyclically and added up in that feature's lookup
table; afterwards trees on the pairs of features that explain most of what is left fill two-way tables. A
score is the sum of one entry per table, so scoring is vectorised additions.

The fit uses at most `most_rows` labelled rows (a documented bound; the order of a hash of the id chooses them, and
an id counts once). Scores use
the text alone. Edge cases: null and empty texts get the features of an empty text and hence a score; without
labels every score is 0.5; repeated rows are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import in_groups
from .common import fresh, small_batches, with_text

FEATURES = ("log_words", "word_length", "log_longest_word", "distinct_words", "top_word", "repeated_pairs", "repeated_neighbours", "duplicate_lines", "log_words_a_line", "line_ends", "symbols", "exclamation", "upper", "digits", "other_marks", "non_ascii")
LABELLED_ROWS = 60_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
_ENDS = (".", "!", "?")


def features(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    counts = Counter(words)
    raw = text.encode("utf-8", "replace")
    at = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    marks = int(at[list(b"#*$%&|<>")].sum())
    chars = max(1, len(raw) - int(at[[9, 10, 11, 12, 13, 32]].sum()))
    bangs, upper, digits = int(at[33]), int(at[65:91].sum()), int(at[48:58].sum())
    other = int(at[33:127].sum()) - marks - bangs - upper - digits - int(at[97:123].sum()) - int(at[[44, 46]].sum())
    return [
        np.log1p(n), sum(map(len, words)) / n, np.log1p(max(map(len, counts))), len(counts) / n, max(counts.values()) / n,
        1 - len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(x.endswith(_ENDS) for x in lines) / len(lines),
        marks / chars, bangs / chars, upper / chars, digits / chars, other / chars, int(at[128:].sum()) / chars,
    ]


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Newton steps of a shallow tree over ordered bins with gradient sums g and Hessian sums h."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = gl**2 / (hl + l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + l2)
        k = int(np.argmax(gain))
        if gain[k] > g.sum() ** 2 / (h.sum() + l2) + 1e-9:
            return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1, l2), _tree(g[k + 1 :], h[k + 1 :], depth - 1, l2)])
    return np.full(len(g), -g.sum() / (h.sum() + l2))


@dataclass
class Gam:
    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pair_edges: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (i, j, table)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def fit_rows(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, l2: float = 2.0) -> Gam:
    """Boost the tables over labelled rows held in memory."""
    if not len(y):
        return Gam()
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Gam(float(np.log(share / (1 - share))))
    width = x.shape[1]
    model.edges = [_edges(x[:, f], BINS) for f in range(width)]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(width):
            g, h = slope()
            n = len(model.tables[f])
            step = rate * _tree(np.bincount(b[f], g, n), np.bincount(b[f], h, n), 2, l2)
            model.tables[f] += step
            total += step[b[f]]
    pb = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        g, h = slope()
        at = pb[i] * shape[1] + pb[j]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape), shape

    def pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        best, out = -1.0, np.zeros_like(g)
        for k in range(1, g.shape[0]):  # a split of the first feature, then one of the second on either side
            step = np.empty_like(g)
            for part in (slice(0, k), slice(k, None)):
                step[part] = _tree(g[part].sum(0), h[part].sum(0), 1, l2)
            gain = -(g * step + h * step**2 / 2).sum()
            if gain > best:
                best, out = gain, step
        return out

    def gain(pair: tuple[int, int]) -> float:
        g, h, _ = cells(*pair)
        return float((g**2 / (h + l2)).sum())

    chosen = sorted(combinations(range(width), 2), key=gain, reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros(cells(i, j)[2])) for i, j in chosen]
    for _ in range(rounds // 3):
        for i, j, table in model.pairs:
            g, h, _ = cells(i, j)
            step = rate * pair_tree(g, h)
            table += step
            total += step[pb[i], pb[j]]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id's text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _mapped(docs: DataFrame, keep: list[str], text_col: str, names: list[str], of) -> DataFrame:
    """keep's columns and doubles that `of` makes from each group's feature matrix."""
    kept = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} double" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(len(keep)).to_pylist(), 0
            for _, part in in_groups(texts, texts):
                made = of(np.array([features(t) for t in part]))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(part)) for c in batch.columns[:-1]), *(pa.array(c, pa.float64()) for c in made)], [*keep, *names])
                at += len(part)

    small_batches(docs.sparkSession)
    (text,) = fresh(docs, "text")
    return docs.select(*keep, with_text(docs, text_col).alias(text)).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = LABELLED_ROWS) -> Gam:
    """Learn from labelled rows outside the held-out part. At most most_rows labels are broadcast and collected."""
    known = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("_label")).filter(~held_out(id_col) & F.col("_label").isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.max("_label").alias("_label"))
    if known.count() > most_rows:
        known = known.orderBy(F.xxhash64(id_col), id_col).limit(most_rows)
    texts = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(known), id_col)
    # one row for each id, whatever its number of documents
    made = _mapped(texts, [id_col, "_label"], text_col, list(FEATURES), lambda x: list(x.T))
    table = made.groupBy(id_col).agg(F.min(F.struct("_label", *FEATURES)).alias("r")).select("r.*").toPandas()
    return fit_rows(table[list(FEATURES)].to_numpy(), table["_label"].to_numpy())


def score(docs: DataFrame, model: Gam, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep's columns, then score and predicted (made fresh if taken) for every row."""
    scored, predicted = fresh(docs.select(*keep), "score", "predicted")
    out = _mapped(docs, list(keep), text_col, [scored], lambda x: [model.scores(x)])
    return out.withColumn(predicted, (F.col(scored) >= 0.5).cast("int"))
