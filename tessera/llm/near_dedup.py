"""Near-duplicate documents by a chosen-path set similarity join on MinHash tokens (operator 10).

A document is the set of its distinct five-word shingles. Equal sets are one class and only one member goes on.
Each class has 64 MinHash tokens. Every one of TREES independent trees sends a class down two paths, each named
by one of its tokens; a node that holds more than LEAF classes branches again by two tokens that a hash of the
node selects. A pair at similarity 0.75 stays together somewhere in one tree with probability 0.89 at any depth
(the extinction probability s of (1/4 + 3s/4)^2 = s is 1/9). The trees share the 64 tokens, so six of them miss a
pair at exactly 0.75 with probability of about 2.3e-4 rather than (1/9)^6, and fewer above; the tests measure the
recall. The branching factor keeps the number of rows near linear. Nodes of at most LEAF classes are compared
exhaustively. Nodes that no longer shrink hold mostly similar classes and become one candidate cluster each.

Leaves compare tokens and give candidate clusters (spanning links, never all pairs). Within the clusters, links
are confirmed on the full shingle sets, and the components of the confirmed links are the result. A cluster that
is too large for one task is cut into blocks that a few of its members all join; what is then not in the cluster's
main component is compared with all members, block by block, or all pairs of blocks are compared if that makes
fewer rows. A pair that is not compared is already in one component, so no link between components is missed. A
large group of near copies costs its members about once; a large cluster of many small components costs its
members once for each block. Words are told apart by two polynomials modulo a prime (62 bits), shingles by 64 bits of five words.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing; texts of fewer than five
words have one shingle, the whole sequence; repeated rows are one class; every row of an id counts by its own text,
and all rows that have their component's id are kept; a null id is linked like others but is no component's id, unless
all its rows have none; an empty table gives an empty table; very long texts cost linear work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, materialise, sized, small_batches, with_text

TOKENS, TREES, PATHS = 64, 6, 2
#: Largest node compared at once, largest cluster confirmed at once (and block of a larger one) in documents and in
#: shingles, members that stand in all blocks of a cluster, and most levels.
LEAF, CLUSTER, SHINGLES, HUBS, LEVELS = 384, 384, 2_000_000, 4, 12
#: A child this large a share of its parent is dense; tokens that must agree for a candidate (of 64, at 0.75: 48).
DENSE, AGREE = 0.8, 32
CHUNK = 1 << 20

_U = np.uint64


@lru_cache(1)
def _constants() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(10)
    odd = lambda n: rng.integers(0, 1 << 63, n, dtype=_U) * _U(2) + _U(1)
    return {"step": odd(1)[0], "xor": odd(TOKENS), "mul": odd(TOKENS), "roots": rng.permutation(TOKENS)[: TREES * PATHS]}


#: Prime modulus and two bases of the hashes of byte ranges.
MERSENNE, BASES = _U((1 << 31) - 1), (1_288_490_189, 743_029_387)


def byte_values(separators: list[int]) -> np.ndarray:
    """A value for each byte: 0 for separators, A-Z as a-z, and odd numbers below 2^31 for the others."""
    out = np.random.default_rng(31).permutation(1 << 12)[:256].astype(_U) * _U(1 << 18) + _U(1)
    out[65:91] = out[97:123]
    out[separators] = 0
    return out


#: Values of the word definition: A-Z are a-z, words end at the space and 09 to 0D.
LOWER = byte_values([9, 10, 11, 12, 13, 32])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(8)
def _series(factor: int, n: int) -> np.ndarray:
    """1, factor, factor^2, ... (n + 1 of them) modulo MERSENNE."""
    out, power, modulus = np.ones(1, _U), factor, int(MERSENNE)
    while len(out) <= n:  # each round doubles the series
        out = np.concatenate([out, out * _U(power) % MERSENNE])
        power = power * power % modulus
    return out[: n + 1]


def range_hashes(value: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """62-bit hashes of value[start:stop] of each range: two polynomials modulo MERSENNE over values below 2^31.

    Different ranges of n bytes have one hash with probability (n / 2^31)^2, whatever their structure.
    """
    n = len(value)
    size = CHUNK if n <= CHUNK else n
    out = np.zeros(len(starts), _U)
    for base in BASES:
        x = value * _series(base, size)[:n]
        total = np.concatenate([np.zeros(1, _U), np.cumsum((x & MERSENNE) + (x >> _U(31)), dtype=_U)])
        down = _series(pow(base, -1, int(MERSENNE)), size)
        out = out << _U(31) | (total[stops] - total[starts]) % MERSENNE * down[starts] % MERSENNE
    return out


def hashed_words(texts: pa.Array, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and each text's first and last position in them.

    Works on the UTF-8 bytes of the whole array: a word is a run of bytes whose value in table is not 0.
    """
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    value = table[raw]
    inside = np.concatenate([[False], value != 0, [False]])
    cut = np.zeros(len(raw) + 1, bool)
    cut[ends] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    words = _mix(range_hashes(value, starts, stops) + (stops - starts).astype(_U) * _U(0x9E3779B97F4A7C15))
    return words, np.searchsorted(starts, ends[:-1]), np.searchsorted(starts, ends[1:])


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and the texts' offsets into them."""
    c = _constants()
    words, first, last = hashed_words(texts)
    sets, at = [], [0]
    rolled = words.copy()
    for i in range(1, min(k, len(words))):
        rolled[:-i] = rolled[:-i] * c["step"] + words[i:]
    rolled = _mix(rolled)
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= k:
            own = np.unique(rolled[a : b - k + 1])
        elif b > a:
            whole = np.array([b - a], _U)
            for i in range(a, b):
                whole = whole * c["step"] + words[i : i + 1]
            own = _mix(whole)
        else:
            own = words[:0]
        sets.append(own)
        at.append(at[-1] + len(own))
    return np.concatenate(sets) if sets else words[:0], np.array(at)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The array in parts of at most CHUNK bytes, or one text."""
    if not len(texts):
        return
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + CHUNK, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, h1, h2, tokens, roots): set size, 128-bit hash of the set, 64 16-bit tokens, root paths."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _constants()
        for batch in batches:
            for start, texts in _chunks(batch.column(1)):
                sets, at = shingle_sets(texts)
                n = np.diff(at)
                full = np.flatnonzero(n)
                low = np.zeros((len(n), TOKENS), _U)
                h = np.zeros((2, len(n)), _U)
                if len(full):
                    for j in range(TOKENS):
                        v = (sets ^ c["xor"][j]) * c["mul"][j]
                        v = (v ^ (v >> _U(29))) * _U(0xBF58476D1CE4E5B9)
                        low[full, j] = np.minimum.reduceat(v, at[full])
                    h[0, full] = np.add.reduceat(_mix(sets), at[full])
                    h[1, full] = np.add.reduceat(_mix(sets ^ _U(0x9E3779B97F4A7C15)), at[full])
                roots = _mix(low[:, c["roots"]] + c["roots"].astype(_U) * _U(0x9E3779B97F4A7C15))
                tokens = (_mix(low) >> _U(48)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(n)), batch.column(2).slice(start, len(n)), pa.array(n, pa.int64()), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array([t.tobytes() for t in tokens], pa.binary()), pa.array(list(roots.view(np.int64)), pa.list_(pa.int64()))],
                    ["id", "text_hash", "n_shingles", "h1", "h2", "tokens", "roots"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(sign, f"id {kind}, text_hash long, n_shingles long, h1 long, h2 long, tokens binary, roots array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    text = with_text(docs, text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, from rows sorted by their first `keys` integer columns, with group offsets."""

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in range(keys):
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if batch.num_rows and all(batch.column(k)[0] == batch.column(k)[-1] and held[0].column(k)[0] == batch.column(k)[0] for k in range(keys)):
            continue  # still one group
        table = pa.Table.from_batches(held)
        starts = bounds(table)
        yield table.slice(0, starts[-1]), starts
        held = table.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(bounds(table), table.num_rows)


def _lowest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the smallest index of its component."""
    linked = linked | np.eye(len(linked), dtype=bool)
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label, len(label)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _leaf_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, id, low) of the classes that have a candidate partner in their leaf."""
    for table, starts in whole_groups(batches, 1):
        node, ids = (table.column(i).to_numpy() for i in range(2))
        if not len(ids):
            continue
        tokens = np.frombuffer(b"".join(table.column(2).to_pylist()), "<u2").reshape(-1, TOKENS)
        sizes = np.diff(starts)
        low = np.full(len(ids), -1)
        two = starts[:-1][sizes == 2]
        hit = two[(tokens[two] == tokens[two + 1]).sum(1) >= AGREE]
        low[hit] = low[hit + 1] = hit
        for a, m in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = tokens[a : a + m]
            agree = np.zeros((m, m), np.uint8)
            for j in range(TOKENS):
                agree += own[:, j, None] == own[None, :, j]
            linked = agree >= AGREE
            np.fill_diagonal(linked, False)
            some = linked.any(1)
            if some.any():
                low[a : a + m] = np.where(some, _lowest(linked) + a, -1)
        keep = np.flatnonzero(low >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(ids[keep]), pa.array(ids[low[keep]])], ["node", "id", "low"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (low, id, g, mask) from rows (g, tile, id, text, hubs) sorted by (g, tile).

    With low: an exact link, 100 * intersection >= 75 * union, spanning each component of a tile. Without: for a
    tile with hubs, each member's mask of the hubs that its component in the tile holds.
    """
    for table, starts in whole_groups(batches, 2):
        ids = table.column(2).to_numpy()
        group = table.column(0).to_numpy()
        hubs = table.column(4).to_pylist()
        lows, highs, members, masks = [], [], [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            sets, at = shingle_sets(table.column(3).slice(a, b - a).combine_chunks())
            n = np.diff(at)
            m = b - a
            _, column, count = np.unique(sets, return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(m), n)
            shared = count[column] > 1
            rank = np.cumsum(count > 1) - 1
            row, column = row[shared], rank[column[shared]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            both = np.zeros((m, m), np.float64)
            wide = 8192
            for low in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
                i, j = np.searchsorted(column, (low, low + wide))
                part = np.zeros((m, wide), np.float32)
                part[row[i:j], column[i:j] - low] = 1
                both += part @ part.T
            label = _lowest(100 * both >= 75 * (n[:, None] + n[None, :] - both)) if m > 1 else np.zeros(m, int)
            own = ids[a:b]
            far = np.flatnonzero(label != np.arange(m))
            lows.append(own[label[far]])
            highs.append(own[far])
            if hubs[a]:
                mask = np.zeros(m, np.int64)
                for k, hub in enumerate(hubs[a]):
                    mask |= np.isin(label, label[own == hub]).astype(np.int64) << k
                members.append(np.arange(a, b))
                masks.append(mask)
        none = np.zeros(0, np.int64)
        low, high, member, mask = (np.concatenate(x) if x else none for x in (lows, highs, members, masks))
        n = len(low)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([low, ids[member]]).astype(ids.dtype), mask=np.arange(n + len(member)) >= n),
                pa.array(np.concatenate([high, ids[member]]).astype(ids.dtype)),
                pa.array(np.concatenate([np.zeros(n, np.int64), group[member]]).astype(group.dtype)),
                pa.array(np.concatenate([np.zeros(n, np.int64), mask])),
            ],
            ["low", "id", "g", "mask"],
        )


def components(edges: DataFrame) -> DataFrame:
    """(id, low) for the ids of an edge table (low, id): low is the smallest id of the component.

    Alternating large-star and small-star steps; each round is written to the shared folder.
    """
    now = materialise(edges.select(F.least("low", "id").alias("u"), F.greatest("low", "id").alias("v")).filter("u < v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least.hint("merge"), "v").select(F.col("m").alias("a"), F.col("u").alias("b")).filter("a < b").unionByName(least.select(F.col("m").alias("a"), F.col("v").alias("b")))
        now = materialise(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("v").alias("id"), F.col("u").alias("low"))
        before = state


def _tiles(blocks, own):
    """The pairs of blocks, as numbers, that a member of block `own` takes part in."""
    return F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.least(x, own) * blocks + F.greatest(x, own))


def _candidates(classes: DataFrame) -> DataFrame:
    """Stored rows (node, id, low) of all trees for classes (id, tokens, roots): rows of one node and low are candidates for each other."""
    level = classes.select("id", F.explode("roots").alias("node"), F.lit(None).cast("long").alias("parent"))
    found = None
    for depth in range(LEVELS + 1):
        counts = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).filter("n > 1")
        nodes = materialise(level.join(counts.hint("merge"), "node"), "nodes")
        dense = (F.col("n") > LEAF) & (F.lit(depth == LEVELS) | (F.col("n") > DENSE * F.coalesce("parent", F.col("n") * 9)))
        leaves = nodes.filter(f"n <= {LEAF}").select("node", "id").join(classes.select("id", "tokens").hint("merge"), "id").select("node", "id", "tokens")
        ids = columns_of(leaves, "id").replace("`id`", "")
        part = leaves.repartition("node").sortWithinPartitions("node", "id").mapInArrow(_leaf_links, f"node long, id{ids}, low{ids}")
        part = part.unionByName(nodes.filter(dense).select("node", "id", "low"))
        found = part if found is None else found.unionByName(part)
        more = nodes.filter((F.col("n") > LEAF) & ~dense)
        if depth == LEVELS or more.isEmpty():
            return found
        first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(TOKENS))
        second = (first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(TOKENS - 1))) % TOKENS
        level = (
            more.join(classes.select("id", "tokens").hint("merge"), "id")
            .select("id", "node", "tokens", F.col("n").alias("parent"), F.explode(F.array(first, second)).alias("at"))
            .select("id", F.xxhash64("node", "at", F.expr("substring(tokens, cast(at AS int) * 2 + 1, 2)")).alias("node"), "parent")
        )


def _blocks(members: float):
    """Blocks of at most about `members` documents and SHINGLES shingles, from n documents with w shingles."""
    return F.greatest(F.ceil(F.col("n") / members), F.ceil(F.col("w") / SHINGLES), F.lit(1)).cast("long")


def _at(blocks, *key):
    return F.pmod(F.xxhash64("id", *key), blocks)


def _upto(n):
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _open_tiles(members: DataFrame, rest: DataFrame) -> DataFrame:
    """Tiles (g, tile, id, hubs) in which all pairs of blocks of a cluster meet, or all rows of rest and all members.

    Whichever makes fewer rows for the cluster: each leaves no pair out that could join two components.
    """
    half = CLUSTER / 2
    few = rest.groupBy("g").agg(F.count(F.lit(1)).alias("s"), F.sum("n_shingles").alias("v"))
    rows = F.greatest(F.ceil(F.col("s") / half), F.ceil(F.col("v") / SHINGLES)).cast("long")
    whole = members.filter("blocks > 1").withColumn("columns", _blocks(half)).withColumn("g", F.col("low")).join(sized(materialise(few, "few")), "g").withColumn("rows", rows)
    whole = whole.withColumn("pairs", F.col("n") * (F.col("blocks") - 1) <= F.col("s") * F.col("columns") + F.col("n") * F.col("rows"))
    own, blocks = F.col("own"), F.col("blocks")
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: x != own)
    two = whole.filter("pairs").withColumn("own", _at(blocks)).select("g", F.explode(F.transform(others, lambda x: F.least(x, own) * blocks + F.greatest(x, own))).alias("tile"), "id")
    row, column = _at(F.col("rows"), F.lit(1)), _at(F.col("columns"), F.lit(2))
    left = whole.filter("NOT pairs").join(rest.select("g", "id").hint("merge"), ["g", "id"]).select("g", "id", "columns", row.alias("i"), _upto(F.col("columns")).alias("j"))
    right = whole.filter("NOT pairs").select("g", "id", "columns", column.alias("j"), _upto(F.col("rows")).alias("i"))
    open_ = left.unionByName(right).select("g", (F.col("i") * F.col("columns") + F.col("j")).alias("tile"), "id").distinct()
    return two.unionByName(open_).withColumn("hubs", F.lit(None).cast("array<long>"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; ids of any ordered type."""
    signed = materialise(signatures(docs, id_col, text_col), "signed")
    # a class has a number of its own, since rows of one id may have several texts, and a row that stands for it
    first = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    classes = signed.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min_by(F.struct(F.col("id").alias("doc"), "text_hash", "tokens", "roots"), first).alias("x"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "n_shingles", "x.*"), "classes")
    clusters = components(_candidates(classes).select("low", "id"))
    members = clusters.unionByName(clusters.select(F.col("low").alias("id"), "low").distinct()).join(classes.select("id", "n_shingles").hint("merge"), "id")
    # in a cluster of several blocks, a few members stand in every block and hold the blocks together
    hubs = F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64("id", F.lit(j)), "id"))["id"] for j in range(HUBS))))
    sizes = members.groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"), hubs.alias("hubs"))
    sizes = materialise(sizes.withColumn("blocks", _blocks(CLUSTER)), "sizes")
    members = members.join(sizes.withColumn("hubs", F.when(F.col("blocks") > 1, F.col("hubs"))).hint("merge"), "low")
    members = materialise(members, "members")
    wanted = members.select("id").distinct().join(classes.select("id", "doc", "text_hash").hint("merge"), "id")
    wanted = sized(materialise(wanted.select(F.col("id").alias("class"), "doc", F.col("text_hash").alias("hash")), "ids"))
    texts = _texts(docs, id_col, text_col).join(wanted, F.col("id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("hash"))).select(F.col("class").alias("id"), "text").dropDuplicates(["id"])

    def confirmed(groups: DataFrame) -> DataFrame:
        rows = materialise(groups, "groups").join(texts.hint("merge"), "id").select("g", "tile", "id", "text", "hubs")
        return materialise(rows.repartition("g", "tile").sortWithinPartitions("g", "tile", "id").mapInArrow(_confirmed, "low long, id long, g long, mask long"), "links")

    own = members.select(F.col("low").alias("g"), _at(F.col("blocks")).alias("tile"), "id", "hubs")
    extra = sizes.filter("blocks > 1").select(F.col("low").alias("g"), "hubs", F.explode("hubs").alias("id"), "blocks").select("g", _upto(F.col("blocks")).alias("tile"), "id", "hubs")
    found = confirmed(own.unionByName(extra).dropDuplicates(["g", "tile", "id"]))
    links = found.filter("low IS NOT NULL").select("low", "id")
    # what lacks the hub with most members, in its component in its block, may have links across the blocks
    seen = found.filter("low IS NULL").select("g", "id", "mask")
    held = [F.sum(F.shiftright("mask", k).bitwiseAND(F.lit(1))) for k in range(HUBS)]
    main = seen.groupBy("g").agg(F.array(*held).alias("n")).select("g", (F.array_position("n", F.array_max("n")) - 1).cast("int").alias("k"))
    rest = seen.join(main.hint("merge"), "g").filter("shiftright(mask, k) % 2 = 0").select("g", "id").distinct()
    rest = materialise(rest.join(members.select(F.col("low").alias("g"), "id", "n_shingles").hint("merge"), ["g", "id"]), "rest")
    if not rest.isEmpty():
        links = links.unionByName(confirmed(_open_tiles(members, rest)).select("low", "id"))
    final = components(links)
    final = materialise(final.unionByName(final.select(F.col("low").alias("id"), "low").distinct()), "linked")
    least = final.join(classes.select("id", "doc").hint("merge"), "id").groupBy("low").agg(F.min("doc").alias("component_id"))
    linked = classes.join(final.hint("merge"), "id").join(sized(materialise(least, "least")), "low").select("h1", "h2", "n_shingles", "component_id")
    alone = classes.join(final.select("id").hint("merge"), "id", "left_anti").select("h1", "h2", "n_shingles", F.col("doc").alias("component_id"))
    out = signed.select("id", "h1", "h2", "n_shingles").join(linked.unionByName(alone).hint("merge"), ["h1", "h2", "n_shingles"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
