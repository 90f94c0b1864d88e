"""Statistics over all pairs within reach together: percentiles of times, correlations within bounds, and the pairs first by
md5. They are made in the tasks of blocks (`reach.dealt`) and of the few other pairs that are rows (`plain`), so what is
stored grows with blocks and cells, not with the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .digests import Ends
from .reach import Fold, Tile, _drive, _transit, _walk

MODES: dict[str, Callable[[np.ndarray], np.ndarray]] = {"walk": _walk, "drive": _drive, "transit": _transit}
#: Kilometres between which all times grow with the distance; from and to under which they are lines, with slope and height.
BREAKS = (2.0, 15.0)
_BEYOND = float(np.nextafter(BREAKS[1], np.inf))
PIECES = {"walk": [(0.0, np.inf, 12.0, 0.0)], "drive": [(0.0, np.inf, 2.0, 0.0)], "transit": [(0.0, BREAKS[0], 18.0, 0.0), (BREAKS[0], _BEYOND, 4.0, 10.0), (_BEYOND, np.inf, 18.0, 0.0)]}
#: Cells of the first histogram of kilometres, powers of two that a cell is cut into next, pairs whose distances are
#: collected at the end, and powers of two of a kilometre that are fine enough for that at any number.
CELLS, FINER, GATHERED, FINEST = 4096, 12, 200_000, 44

Over = Callable[[Fold, str], DataFrame]
Spans = list[tuple[float, float]]


def _tiles(left: pd.DataFrame, kinds: list[tuple], reach: float) -> Iterator[Tile]:
    for _, _, bx, by in kinds:
        yield Tile(left["ax"].to_numpy(float), left["ay"].to_numpy(float), bx, by, reach)


def _between(tile: Tile, low: float, high: float) -> Iterator[np.ndarray]:
    """The kilometres from `low` to under `high` of a tile's pairs within reach."""
    near, far = low / 6.0, min(high, tile.reach / 2.0) / 6.0
    i, j = tile._reached(near, far)
    for at, mx, my, h in tile.leaves:
        c = np.hypot(tile.bx[i:j] - mx, tile.by[i:j] - my)
        sure = (c > near + h) & (c < far - h)
        for _, km in tile._km(at, i + np.flatnonzero(sure)):
            yield km.ravel()
        for _, km in tile._km(at, i + np.flatnonzero(~sure & (c >= near - h) & (c <= far + h))):
            yield km[(km >= low) & (km < high) & (_drive(km) <= tile.reach)]


def _counts(reach: float, spans: Spans, bits: int) -> Fold:
    """(cell, n): pairs of each cell of 2^-bits kilometres within the spans; powers of two make cells exact."""
    scale = 2.0**bits

    def fold(left: pd.DataFrame, kinds: list[tuple]) -> pd.DataFrame:
        found = [np.zeros(int(high * scale) - int(low * scale), np.int64) for low, high in spans]
        for tile in _tiles(left, kinds, reach):
            for (low, high), n in zip(spans, found, strict=True):
                for km in _between(tile, low, high):
                    n += np.bincount((km * scale).astype(np.int64) - int(low * scale), minlength=len(n))
        some = [(int(low * scale) + np.flatnonzero(n), n[n > 0]) for (low, _), n in zip(spans, found, strict=True)]
        return pd.DataFrame({"cell": np.concatenate([c for c, _ in some]), "n": np.concatenate([n for _, n in some])})

    return fold


def _values(reach: float, spans: Spans) -> Fold:
    """(km, n): the distances within the spans, and how many pairs have them."""

    def fold(left: pd.DataFrame, kinds: list[tuple]) -> pd.DataFrame:
        found = [km for tile in _tiles(left, kinds, reach) for span in spans for km in _between(tile, *span)]
        km, n = np.unique(np.concatenate(found) if found else np.zeros(0), return_counts=True)
        return pd.DataFrame({"km": km, "n": n})

    return fold


def _held(plain: DataFrame, spans: Spans) -> DataFrame:
    inside = F.lit(False)
    for low, high in spans:
        inside = inside | (F.col("km") >= low) & (F.col("km") < high)
    return plain.filter(inside)


def percentiles(over: Over, plain: DataFrame, reach: float, wanted: dict[str, float]) -> tuple[dict[str, dict[str, float]], dict[str, float]]:
    """Exact percentiles of each mode's times over all pairs, and means of kilometres and times to about a cell.

    Times are functions of the distance that grow between BREAKS, so one histogram of distances serves all modes. The
    cells that may hold a wanted place are cut finer until the pairs in them are few; their distances are collected.
    """
    whole = max(16, math.floor(reach / 2) + 1)
    bits, spans = max(0, int(math.log2(CELLS / whole))), [(0.0, float(whole))]

    def histogram(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        more = rows.groupBy(F.floor(F.col("km") * 2.0**bits).cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        found = over(_counts(reach, spans, bits), "cell long, n long").unionByName(more).groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        return found["cell"].to_numpy(np.int64) / 2.0**bits, found["n"].to_numpy(np.int64)

    low, n = histogram(plain)  # of the plain pairs, those further than the reach, too
    high = low + 2.0**-bits
    total = int(n.sum())
    if not total:
        return {}, {}
    means = {"km": float((low * n).sum() / total)} | {mode: float((of(low) * n).sum() / total) for mode, of in MODES.items()}
    places = {name: at * (total - 1) for name, at in wanted.items()}
    ranks = sorted({k for p in places.values() for k in (math.floor(p), math.ceil(p))})
    while True:
        held, ends = np.zeros(len(n), bool), {}
        for mode, of in MODES.items():
            some = np.stack([of(low), of(np.nextafter(low, np.inf)), of(np.nextafter(high, -np.inf))])
            least, most = some.min(axis=0), some.max(axis=0)
            up, down = np.argsort(least), np.argsort(most)
            for k in ranks:
                first = least[up][np.searchsorted(np.cumsum(n[up]), k, "right")]  # the k-th time is no less, and no more than
                last = most[down][np.searchsorted(np.cumsum(n[down]), k, "right")]
                held |= (least <= last) & (most >= first)
                ends[mode, k] = most, first
        spans = []
        for a, b in sorted(zip(low[held].tolist(), high[held].tolist())):
            if spans and spans[-1][1] == a:
                spans[-1] = spans[-1][0], b
            else:
                spans.append((a, b))
        if n[held].sum() <= GATHERED or bits >= FINEST:
            break
        bits += FINER
        finer, m = histogram(_held(plain, spans))
        low, high, n = np.concatenate([low[~held], finer]), np.concatenate([high[~held], finer + 2.0**-bits]), np.concatenate([n[~held], m])
    values = over(_values(reach, spans), "km double, n long").unionByName(_held(plain, spans).select("km", F.lit(1).cast("long").alias("n"))).groupBy("km").agg(F.sum("n").alias("n")).toPandas()
    found = {}
    for mode, of in MODES.items():
        v = of(values["km"].to_numpy(float))
        order = np.argsort(v)
        v, upto = v[order], np.cumsum(values["n"].to_numpy(np.int64)[order])

        def nth(k: int) -> float:
            most, first = ends[mode, k]
            return float(v[np.searchsorted(upto, k - n[~held & (most < first)].sum(), "right")])

        found[mode] = {name: nth(math.floor(p)) + (nth(math.ceil(p)) - nth(math.floor(p))) * (p - math.floor(p)) for name, p in places.items()}
    return found, means


def _first(holds: Callable[[float], bool], low: float, high: float) -> float:
    """The smallest number from `low` to `high` for which `holds`, as it does for all above; `high` if there is none."""
    if holds(low):
        return low
    while low < (middle := low + (high - low) / 2) < high:
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def _parts(mode: str, bounds: tuple[float, float], furthest: float) -> list[tuple[float, float, float, float]]:
    """Kilometres from and to under which a mode's times lie within the bounds, and their slope and height there."""
    of, out = MODES[mode], []
    for low, high, slope, height in PIECES[mode]:
        high = min(high, furthest)
        if low < high:
            at = _first(lambda km: of(km) >= bounds[0], low, high), _first(lambda km: of(km) > bounds[1], low, high)
            out += [(*at, slope, height)] if at[0] < at[1] else []
    return out


def correlated(over: Over, plain: DataFrame, reach: float, bounds: dict[str, tuple[float, float]], means: dict[str, float]) -> list[tuple[str, int, float | None]]:
    """(mode, n, r): pairs with times within the mode's bounds, and the correlation of their kilometres and times.

    Times are lines of the distance between BREAKS, so their sums come from those of the distances under a few cuts.
    """
    furthest = np.nextafter(max(reach / 2.0, plain.agg(F.max("km")).first()[0] or 0.0, BREAKS[1]) * (1 + 1e-9), np.inf)
    parts, about = {mode: _parts(mode, of, furthest) for mode, of in bounds.items()}, means["km"]
    cuts = sorted({c for some in parts.values() for p in some for c in p[:2]})
    of = (lambda km: km - about, lambda km: (km - about) * (km - about))

    def fold(left: pd.DataFrame, kinds: list[tuple]) -> pd.DataFrame:
        made = []
        for tile in _tiles(left, kinds, reach):
            for i, c in enumerate(cuts):
                whole = c / 6.0 > tile.reach / 12.0 + tile.h  # the reach is nearer
                n = tile.n if whole else tile.count(lambda km, c=c: km < c, c)
                made.append((i, int(n.sum()), *tile.sums(*of, below=np.inf if whole else c).sum(axis=1).tolist()))
        return pd.DataFrame(made, columns=["cut", "n", "x", "xx"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            km = batch["km"].to_numpy(float)
            yield pd.DataFrame([(i, int((km < c).sum()), *(float(f(km[km < c]).sum()) for f in of)) for i, c in enumerate(cuts)], columns=["cut", "n", "x", "xx"])

    schema = "cut int, n long, x double, xx double"
    sums = over(fold, schema).unionByName(plain.select("km").mapInPandas(rows, schema)).groupBy("cut").agg(*(F.sum(c).alias(c) for c in ("n", "x", "xx"))).collect()
    under = {cuts[r["cut"]]: np.array([r["n"], r["x"], r["xx"]]) for r in sums}
    found = []
    for mode, some in parts.items():
        n = x = v = xx = xv = vv = 0.0
        for low, high, slope, height in some:
            m, a, aa = under[high] - under[low]
            h = slope * about + height - means[mode]
            n, x, v, xx, xv, vv = n + m, x + a, v + slope * a + h * m, xx + aa, xv + slope * aa + h * a, vv + slope * slope * aa + 2.0 * slope * h * a + h * h * m
        if n > 0:
            top, below = xv - x * v / n, (xx - x * x / n) * (vv - v * v / n)
            found.append((mode, round(n), float(top / math.sqrt(below)) if min(xx - x * x / n, vv - v * v / n) > 1e-15 * n else None))
    return found


def marked(reach: float, cut: int) -> Fold:
    """(point_id, dest_id, dest_type, dx, dy): pairs within reach whose md5 of `<point>-<destination>` begins with four bytes
    of at most `cut`; ids are text."""

    def fold(left: pd.DataFrame, kinds: list[tuple]) -> pd.DataFrame:
        names = ["point_id", "dest_id", "dest_type", "dx", "dy"]
        if not kinds:
            return pd.DataFrame([], columns=names)
        kind = np.repeat(np.arange(len(kinds)), [len(k[1]) for k in kinds])
        ids, bx, by = (np.concatenate([k[i] for k in kinds]) for i in (1, 2, 3))
        texts, points = np.array([i.encode() for i in ids.tolist()]), left["id"].tolist()
        tile, made = Tile(left["ax"].to_numpy(float), left["ay"].to_numpy(float), bx, by, reach), []
        for at, mx, my, h in tile.leaves:
            near = np.flatnonzero(np.hypot(bx - mx, by - my) <= reach / 12.0 + h)
            if not len(near):
                continue
            ends = Ends(texts[near])
            for i in at.tolist():
                for j in near[ends.first(f"{points[i]}-".encode()) <= cut].tolist():
                    dx, dy = bx[j] - tile.x[i], by[j] - tile.y[i]
                    if _drive(np.sqrt(dx * dx + dy * dy) * 6.0) <= reach:
                        made.append((points[i], ids[j], kinds[kind[j]][0], float(dx), float(dy)))
        return pd.DataFrame(made, columns=names)

    return fold
