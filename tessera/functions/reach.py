"""Summaries of each point's destinations within reach, without a row for each pair.

Points are dealt to blocks of one tile each; a block meets the destinations that its box can reach, so what is shuffled
is points and blocks x destinations, and no pair is written. Inside the task of a block the destinations of a type lie in
the order of their distance from the block's centre (`Tile`): a count compares only those about as far as its bound, an
order statistic sorts only those about as far as its rank, and a sum adds up near ones and those about as far as the reach,
while the sum over all between is a smooth function of the place, taken from 256 nodes (to about 1e-12 of itself).
Summaries without such a form get the arrays of one point at a time (`Pairs`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import sized, stored

#: Points of an average block, tiles along a side at least and at most, and destinations that the task of a block holds at
#: most; more take the definition by a join.
BLOCK, TILES, MOST_TILES, MOST_DESTS = 4096, 6, 60, 2_000_000
#: Points of a block that meets all destinations.
WIDE = 16384
#: Nodes along a side of a tile, points of a leaf, and distances held at once.
NODES, LEAF, HELD = 16, 128, 1 << 16


class Pairs:
    """One point's destinations of one type within reach: ids, differences of coordinates, kilometres and minutes."""

    def __init__(self, point: int, dest_id: np.ndarray, dx: np.ndarray, dy: np.ndarray, km: np.ndarray, drive: np.ndarray):
        self.point, self.dest_id, self.dx, self.dy, self.km, self.drive = point, dest_id, dx, dy, km, drive
        self._made: dict[str, np.ndarray] = {}

    @property
    def walk(self) -> np.ndarray:
        if "walk" not in self._made:
            self._made["walk"] = self.km / 5.0 * 60.0
        return self._made["walk"]

    @property
    def transit(self) -> np.ndarray:
        if "transit" not in self._made:
            self._made["transit"] = np.where((self.km >= 2.0) & (self.km <= 15.0), self.km / 15.0 * 60.0 + 10.0, self.walk * 1.5)
        return self._made["transit"]

    @property
    def best(self) -> np.ndarray:
        if "best" not in self._made:
            self._made["best"] = np.minimum(np.minimum(self.walk, self.drive), self.transit)
        return self._made["best"]

    def quantiles(self, of: str, *at: float) -> list[float]:
        """Percentiles with linear interpolation, by one selection."""
        v, n = getattr(self, of), len(self.drive)
        low = [int(np.floor(f * (n - 1))) for f in at]
        part = np.partition(v, sorted({*low, *(min(i + 1, n - 1) for i in low)}))
        return [float(part[i] + (part[min(i + 1, n - 1)] - part[i]) * (f * (n - 1) - i)) for i, f in zip(low, at)]


def _blocks(points: DataFrame, side: float, most: int) -> DataFrame:
    """Stored (id, ax, ay, block): points of one tile, at most about `most` of them."""
    tile = points.withColumns({"tx": F.floor(F.col("ax") / side), "ty": F.floor(F.col("ay") / side)})
    sizes = stored(tile.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / most).alias("slots")))
    dealt = tile.join(sized(sizes), ["tx", "ty"]).withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")))
    return stored(dealt.select("id", "ax", "ay", F.concat_ws("/", "tx", "ty", "slot").alias("block")))


def _transit(km: np.ndarray) -> np.ndarray:
    return np.where((km >= 2.0) & (km <= 15.0), km / 15.0 * 60.0 + 10.0, km / 5.0 * 60.0 * 1.5)


def _drive(km: np.ndarray) -> np.ndarray:
    return km / 30.0 * 60.0


def _walk(km: np.ndarray) -> np.ndarray:
    return km / 5.0 * 60.0


def _best(km: np.ndarray) -> np.ndarray:
    """The least of the times by all modes; no car is overtaken, so it grows with the distance."""
    return np.minimum(np.minimum(_walk(km), _drive(km)), _transit(km))


class Tile:
    """The points of one block and the destinations of one type around it. A destination's distances from two points differ
    by no more than the points lie apart, and so do two points' k-th smallest distances."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bx: np.ndarray, by: np.ndarray, reach: float, nodes: int = NODES):
        self.x, self.y, self.reach, self.nodes = x, y, reach, nodes
        self.middle = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
        self.half = max(np.ptp(x), np.ptp(y)) / 2
        c = np.hypot(bx - self.middle[0], by - self.middle[1])
        order = np.argsort(c)
        self.c, self.bx, self.by = c[order], bx[order], by[order]
        #: what rounding may add to a distance, and a bit more
        self.slack = 1e-9 * (1.0 + self.c[-1])
        self.h = 2**0.5 * self.half + self.slack  # holds all points and nodes
        self.leaves = [self._leaf(at) for at in self._split()]
        self._made: dict[str, np.ndarray] = {}

    def _split(self) -> list[np.ndarray]:
        todo, out = [np.arange(len(self.x))], []
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                out.append(at)
                continue
            v = self.x[at] if np.ptp(self.x[at]) >= np.ptp(self.y[at]) else self.y[at]
            order = np.argpartition(v, len(at) // 2)
            todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
        return out

    def _leaf(self, at: np.ndarray) -> tuple[np.ndarray, float, float, float]:
        x, y = self.x[at], self.y[at]
        mx, my = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
        return at, mx, my, np.hypot(x - mx, y - my).max() + self.slack

    def _km(self, at: np.ndarray, to: np.ndarray):
        """Points and their kilometres to some destinations, not too many at once."""
        step = max(1, HELD // max(1, len(to)))
        bx, by = self.bx[to], self.by[to]
        for i in range(0, len(at), step):
            some = at[i : i + step]
            dx, dy = bx - self.x[some, None], by - self.y[some, None]
            yield some, np.sqrt(dx * dx + dy * dy) * 6.0

    def _reached(self, low: float, high: float) -> tuple[int, int]:
        """Destinations from the first that may be `low` away from a point to the last that may be `high` away."""
        return int(np.searchsorted(self.c, low - self.h)), int(np.searchsorted(self.c, high + self.h, "right"))

    def count(self, holds: Callable[[np.ndarray], np.ndarray], edge: float) -> np.ndarray:
        """How many destinations within reach each point has for whose kilometres `holds`: all nearer than `edge`, none further."""
        edge = min(edge, self.reach / 2.0)
        out, r = np.zeros(len(self.x), np.int64), edge / 6.0
        i, j = self._reached(r, r)
        for at, mx, my, h in self.leaves:
            c = np.hypot(self.bx[i:j] - mx, self.by[i:j] - my)
            sure = c < r - h
            out[at] = i + np.count_nonzero(sure)
            for some, km in self._km(at, i + np.flatnonzero(~sure & (c <= r + h))):
                out[some] += np.count_nonzero(holds(km) & (_drive(km) <= self.reach), axis=1)
        return out

    @property
    def n(self) -> np.ndarray:
        if "n" not in self._made:
            self._made["n"] = self.count(lambda km: km >= 0.0, np.inf)
        return self._made["n"]

    def ranked(self, *ks: np.ndarray) -> list[np.ndarray]:
        """Kilometres of each point's k-th nearest destination, from 0 on; any number where there is none within reach."""
        ks = [np.clip(k, 0, np.maximum(self.n - 1, 0)) for k in ks]
        out = [np.zeros(len(self.x)) for _ in ks]
        for at, mx, my, h in self.leaves:
            low, high = min(int(k[at].min()) for k in ks), max(int(k[at].max()) for k in ks)
            i, j = self._reached(self.c[low] - self.h, self.c[high] + self.h)
            c = np.hypot(self.bx[i:j] - mx, self.by[i:j] - my)
            part = np.partition(c, [low - i, high - i])
            below = c < part[low - i] - 2 * h
            before = i + np.count_nonzero(below)
            for some, km in self._km(at, i + np.flatnonzero(~below & (c <= part[high - i] + 2 * h))):
                km.sort(axis=1)
                for v, k in zip(out, ks, strict=True):
                    v[some] = km[np.arange(len(some)), k[some] - before]
        return out

    def quantile(self, at: float, of: Callable[[np.ndarray], np.ndarray] = _drive) -> np.ndarray:
        """Percentile with linear interpolation of minutes that grow with the distance, by car or another way."""
        place = at * (self.n - 1)
        k = np.floor(place).astype(np.int64)
        low, high = map(of, self.ranked(k, k + 1))
        return low + (high - low) * (place - k)

    def sums(self, *of: Callable[[np.ndarray], np.ndarray], bends: tuple[float, ...] = (), below: float = np.inf) -> np.ndarray:
        """Sums of functions of the kilometres of each point's destinations within reach and `below` kilometres; they are
        smooth but at 0 and at the bends."""
        out, r, n2 = np.zeros((len(of), len(self.x))), min(self.reach / 2.0, below) / 6.0, self.nodes**2
        last = self._reached(0.0, r)[1]
        near = max([4.0 * self.half + self.slack, *(b / 6.0 + self.h for b in bends if b / 6.0 < r / 2)])
        far = min([r, *(b / 6.0 for b in bends if b / 6.0 >= r / 2)]) - self.h
        first, end = int(np.searchsorted(self.c, near, "right")), int(np.searchsorted(self.c, far))
        if len(self.x) < 2 * n2 or end - first < n2:
            first = end = last  # by pairs is as fast
        else:
            out += self._smooth(of, np.arange(first, end))
        plain = np.concatenate([np.arange(first), np.arange(end, last)])
        for at, mx, my, h in self.leaves:
            c = np.hypot(self.bx[plain] - mx, self.by[plain] - my)
            sure = c < r - h
            for some, km in self._km(at, plain[sure]):
                for total, f in zip(out, of, strict=True):
                    total[some] += f(km).sum(axis=1)
            for some, km in self._km(at, plain[~sure & (c <= r + h)]):
                held = (_drive(km) <= self.reach) & (km < below)
                for total, f in zip(out, of, strict=True):
                    total[some] += np.where(held, f(km), 0.0).sum(axis=1)
        return out

    def _smooth(self, of: tuple[Callable[[np.ndarray], np.ndarray], ...], to: np.ndarray) -> np.ndarray:
        """Sums over destinations that all points reach and none is near: polynomials through its values at Chebyshev nodes."""
        angle = (2 * np.arange(self.nodes) + 1) * np.pi / (2 * self.nodes)
        node, weight = np.cos(angle), np.sin(angle) * (-1.0) ** np.arange(self.nodes)

        def basis(v: np.ndarray) -> np.ndarray:
            gap = v[:, None] - node
            hit = gap == 0.0
            share = weight / np.where(hit, 1.0, gap)
            share = np.where(hit.any(axis=1)[:, None], hit, share)
            return share / share.sum(axis=1)[:, None]

        nx, ny = (np.repeat(node, self.nodes), np.tile(node, self.nodes))
        x, y = self.middle[0] + self.half * nx, self.middle[1] + self.half * ny
        values, step = np.zeros((len(of), len(x))), max(1, HELD // len(x))
        for i in range(0, len(to), step):
            dx, dy = self.bx[to[i : i + step]] - x[:, None], self.by[to[i : i + step]] - y[:, None]
            km = np.sqrt(dx * dx + dy * dy) * 6.0
            values += [f(km).sum(axis=1) for f in of]
        size = self.half if self.half > 0 else 1.0
        px, py = basis((self.x - self.middle[0]) / size), basis((self.y - self.middle[1]) / size)
        return np.stack([((px @ v.reshape(self.nodes, self.nodes)) * py).sum(axis=1) for v in values])

    def moments(self, transit: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Mean and sum of squares about it, of the kilometres or of the minutes by transit."""
        of, bends = (_transit, (2.0, 15.0)) if transit else (lambda km: km, ())
        name, n = f"moments {transit}", np.maximum(self.n, 1)
        if name not in self._made:
            about = float(of(self.c[: max(1, int(np.searchsorted(self.c, self.reach / 12.0)))] * 6.0).mean())
            # squares about a number near the mean keep their digits
            total, squares = self.sums(of, lambda km: (of(km) - about) * (of(km) - about), bends=bends)
            self._made[name] = np.stack([total / n, np.maximum(squares - n * (total / n - about) ** 2, 0.0)])
        return tuple(self._made[name])

    def mean_transit(self) -> np.ndarray:
        """Mean minutes by transit: 4 km + 10, but 18 km under 2 and over 15 kilometres."""
        if self.reach > 30.0:
            return self.moments(transit=True)[0]
        under = self.sums(lambda km: 14.0 * km - 10.0, below=2.0)[0]
        return 4.0 * self.moments()[0] + 10.0 + under / np.maximum(self.n, 1)

    def least(self) -> np.ndarray:
        if "least" not in self._made:
            (self._made["least"],) = self.ranked(np.zeros(len(self.x), np.int64))
        return self._made["least"]

    def zero(self) -> np.ndarray:
        return self.count(lambda km: km <= 0.0, 0.0)

    def over(self, minutes: float) -> np.ndarray:
        """Times of all modes that are longer than over 70 minutes, where transit takes 18 km."""
        edges = (_walk, minutes / 12.0), (_drive, minutes / 2.0), (_transit, minutes / 18.0)
        return sum(self.n - self.count(lambda km, f=f: f(km) <= minutes, edge) for f, edge in edges)


Fold = Callable[[pd.DataFrame, list[tuple]], pd.DataFrame]


def dealt(points: DataFrame, dests: DataFrame, reach: float, minutes: float, most: int = BLOCK) -> Callable[[Fold, str], DataFrame]:
    """What runs a function on the points of each block (id, ax, ay) and, by type, the ids and places of the destinations
    that may be within reach of some, and stores the rows that it gives; a schema comes with the function."""
    radius = reach / minutes * (1 + 1e-9)  # the exact condition follows
    there = stored(dests.filter("x IS NOT NULL AND y IS NOT NULL").select("dest_id", "dest_type", F.col("x").alias("bx"), F.col("y").alias("by")))
    here = points.filter("x IS NOT NULL AND y IS NOT NULL").select(F.col("point_id").alias("id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    extent = here.agg(F.greatest(F.max("ax") - F.min("ax"), F.max("ay") - F.min("ay"))).first()[0] or 0.0
    # tiles of about a block's points: the fewer places a tile has, the less of its destinations need looking at by pairs
    own = _blocks(here, (extent or 1.0) / min(MOST_TILES, max(TILES, int(np.ceil(np.sqrt(here.count() / most))))), most)
    boxes = stored(own.groupBy("block").agg(F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1")))
    apart = lambda v, lo, hi: F.greatest(F.col(lo) - F.col(v), F.col(v) - F.col(hi), F.lit(0.0))
    gx, gy = apart("bx", "x0", "x1"), apart("by", "y0", "y1")
    # a few thousand boxes: points / BLOCK and MOST_TILES squared
    met = there.join(F.broadcast(boxes), gx * gx + gy * gy <= radius * radius * (1 + 1e-9)).select("block", "dest_id", "dest_type", "bx", "by")
    # a fixed number of partitions: adaptive execution would merge blocks by their bytes, but their work is their pairs
    n = max(1, min(boxes.count(), 4000))

    def over(fold: Fold, schema: str) -> DataFrame:
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            kinds = [(None if pd.isna(kind) else kind, rows["dest_id"].to_numpy(), rows["bx"].to_numpy(float), rows["by"].to_numpy(float)) for kind, rows in right.groupby("dest_type", sort=False, dropna=False)]
            return fold(left, kinds if len(left) else [])

        return stored(own.repartition(n, "block").groupBy("block").cogroup(met.repartition(n, "block").groupBy("block")).applyInPandas(run, schema))

    return over


def summarised(points: DataFrame, dests: DataFrame, reach: float, minutes: float, make: Callable[[Pairs], Iterable[tuple]], columns: str) -> DataFrame:
    """Stored (point_id, dest_type, columns): the rows that `make` gives for each point (point_id, x, y) and type of dests
    (dest_id, dest_type, x, y) with a destination no further than `reach` minutes by car; `minutes` of one unit."""

    def run(left: pd.DataFrame, kinds: list[tuple]) -> pd.DataFrame:
        out: list[tuple] = []
        if not kinds:
            return pd.DataFrame(out, columns=names)
        if tiled is not None and all(unique or len(np.unique(ids)) == len(ids) for _, ids, _, _ in kinds):
            at = left["id"].to_numpy(), left["ax"].to_numpy(float), left["ay"].to_numpy(float)
            made = []
            for kind, _, bx, by in kinds:
                tile = Tile(*at[1:], bx, by, reach)
                live = tile.n > 0
                if live.any():
                    for columns in tiled(tile):
                        made.append(pd.DataFrame({"point_id": at[0][live], "dest_type": kind} | {c: v[live] if isinstance(v, np.ndarray) else v for c, v in zip(names[2:], columns, strict=True)}))
            return pd.concat(made) if made else pd.DataFrame(out, columns=names)
        for point, x, y in zip(left["id"].tolist(), left["ax"].tolist(), left["ay"].tolist()):
            for kind, ids, bx, by in kinds:
                dx, dy = bx - x, by - y
                km = np.sqrt(dx * dx + dy * dy) * 6.0
                drive = km / 30.0 * 60.0
                near = drive <= reach
                if not near.all():
                    at = np.flatnonzero(near)
                    if not len(at):
                        continue
                    pairs = Pairs(point, ids[at], dx[at], dy[at], km[at], drive[at])
                else:
                    pairs = Pairs(point, ids, dx, dy, km, drive)
                out += [(point, kind, *row) for row in make(pairs)]
        return pd.DataFrame(out, columns=names)

    tiled, unique = getattr(make, "tiled", None), getattr(make, "unique", True)
    kind_of = {c: points.schema[c].dataType.simpleString() for c in ("point_id",)} | {"dest_type": dests.schema["dest_type"].dataType.simpleString()}
    names = ["point_id", "dest_type", *(c.split()[0] for c in columns.split(", "))]
    return dealt(points, dests, reach, minutes)(run, f"point_id {kind_of['point_id']}, dest_type {kind_of['dest_type']}, {columns}")


def totals(left: pd.DataFrame, kinds: list[tuple]) -> pd.DataFrame:
    """(dest_type, n, km): the pairs of a block's points and all destinations of a type, and their kilometres."""
    x, y = left["ax"].to_numpy(float), left["ay"].to_numpy(float)
    made = [(kind, len(x) * len(bx), float(Tile(x, y, bx, by, np.inf).sums(lambda km: km)[0].sum())) for kind, _, bx, by in kinds]
    return pd.DataFrame(made, columns=["dest_type", "n", "km"])


def _diversity(p: Pairs) -> float:
    """Entropy of eight directions, in three bits."""
    if len(p.dx) < 4:
        return 0.0
    share = np.bincount(np.minimum(np.floor((np.arctan2(p.dy, p.dx) + np.pi) / (2.0 * np.pi) * 8.0).astype(int), 7)) / len(p.dx)
    return float(-(share[share > 0] * np.log2(share[share > 0])).sum() / 3.0)


def _least(v: np.ndarray) -> float | None:
    return float(v.min()) if len(v) else None


#: Summaries by name: type and value from one point's pairs of one type.
SUMMARIES: dict[str, tuple[str, Callable[[Pairs], float]]] = {
    "n": ("long", lambda p: len(p.drive)),
    "min_time": ("double", lambda p: float(p.drive.min())),
    "max_time": ("double", lambda p: float(p.drive.max())),
    "mean_time": ("double", lambda p: float(p.drive.mean())),
    "sd_time": ("double", lambda p: float(p.drive.std())),
    "median_time": ("double", lambda p: p.quantiles("drive", 0.5)[0]),
    "count_5": ("long", lambda p: int((p.drive <= 5.0).sum())),
    "count_10": ("long", lambda p: int((p.drive <= 10.0).sum())),
    "count_15": ("long", lambda p: int((p.drive <= 15.0).sum())),
    "count_30": ("long", lambda p: int((p.drive <= 30.0).sum())),
    "p90": ("double", lambda p: p.quantiles("drive", 0.9)[0]),
    "mean_transit": ("double", lambda p: float(p.transit.mean())),
    "mean_walk": ("double", lambda p: float(p.walk.mean())),
    "min_walk": ("double", lambda p: float(p.walk.min())),
    "walk_15": ("long", lambda p: int((p.walk <= 15.0).sum())),
    "walk_20": ("long", lambda p: int((p.walk <= 20.0).sum())),
    "walk_15_drive_5": ("long", lambda p: int(((p.walk <= 15.0) & (p.drive <= 5.0)).sum())),
    "near_10": ("long", lambda p: int((np.minimum(p.drive, p.walk) <= 10.0).sum())),
    "decayed": ("double", lambda p: float(np.exp(-0.1 * p.drive).sum())),
    "min_km": ("double", lambda p: float(p.km.min())),
    "n_5km": ("long", lambda p: len(np.unique(p.dest_id[p.km < 5.0]))),
    "moved": ("long", lambda p: int((p.km > 0.0).sum())),
    "drive_3km": ("double", lambda p: _least(p.drive[(p.km < 3.0) & (p.drive > 0.0)])),
    "walk_3km": ("double", lambda p: _least(p.walk[(p.km < 3.0) & (p.walk > 0.0)])),
    "diversity": ("double", _diversity),
    "t10": ("double", lambda p: float(np.partition(p.drive, len(p.drive) // 10)[len(p.drive) // 10])),
    "t90": ("double", lambda p: float(np.partition(p.drive, min(len(p.drive), 9 * len(p.drive) // 10 + 1) - 1)[min(len(p.drive), 9 * len(p.drive) // 10 + 1) - 1])),
    "least_best": ("double", lambda p: float(p.best.min())),
    "mean_best": ("double", lambda p: float(p.best.mean())),
    "p90_best": ("double", lambda p: p.quantiles("best", 0.9)[0]),
    "transit_share": ("double", lambda p: float(((p.transit < p.drive) & (p.transit < p.walk)).mean())),
    "gravity": ("double", lambda p: float((1.0 / np.maximum(p.best, 1.0)).sum())),
    "best_5": ("long", lambda p: int((p.best <= 5.0).sum())),
    "best_10": ("long", lambda p: int((p.best <= 10.0).sum())),
    "best_15": ("long", lambda p: int((p.best <= 15.0).sum())),
    "over_300": ("long", lambda p: int((p.walk > 300.0).sum() + (p.drive > 300.0).sum() + (p.transit > 300.0).sum())),
    # moments of the kilometres and the minutes by car: means, sums of squares and of products about them
    "mean_km": ("double", lambda p: float(p.km.mean())),
    "squares_km": ("double", lambda p: float(((p.km - p.km.mean()) ** 2).sum())),
    "squares_time": ("double", lambda p: float(((p.drive - p.drive.mean()) ** 2).sum())),
    "products": ("double", lambda p: float(((p.km - p.km.mean()) * (p.drive - p.drive.mean())).sum())),
}


#: The same summaries for all points of a tile; n_5km where no destination's id repeats.
TILED: dict[str, Callable[[Tile], np.ndarray]] = {
    "n": lambda t: t.n,
    "min_time": lambda t: _drive(t.least()),
    "max_time": lambda t: _drive(t.ranked(t.n - 1)[0]),
    "mean_time": lambda t: _drive(t.moments()[0]),
    "sd_time": lambda t: _drive(np.sqrt(t.moments()[1] / np.maximum(t.n, 1))),
    "median_time": lambda t: t.quantile(0.5),
    "count_5": lambda t: t.count(lambda km: _drive(km) <= 5.0, 2.5),
    "count_10": lambda t: t.count(lambda km: _drive(km) <= 10.0, 5.0),
    "count_15": lambda t: t.count(lambda km: _drive(km) <= 15.0, 7.5),
    "count_30": lambda t: t.count(lambda km: _drive(km) <= 30.0, 15.0),
    "p90": lambda t: t.quantile(0.9),
    "mean_transit": lambda t: t.mean_transit(),
    "mean_walk": lambda t: _walk(t.moments()[0]),
    "min_walk": lambda t: _walk(t.least()),
    "walk_15": lambda t: t.count(lambda km: _walk(km) <= 15.0, 1.25),
    "walk_20": lambda t: t.count(lambda km: _walk(km) <= 20.0, 5.0 / 3.0),
    "walk_15_drive_5": lambda t: t.count(lambda km: (_walk(km) <= 15.0) & (_drive(km) <= 5.0), 1.25),
    "near_10": lambda t: t.count(lambda km: np.minimum(_drive(km), _walk(km)) <= 10.0, 5.0),
    "decayed": lambda t: t.sums(lambda km: np.exp(-0.1 * _drive(km)))[0],
    "min_km": lambda t: t.least(),
    "n_5km": lambda t: t.count(lambda km: km < 5.0, 5.0),
    "moved": lambda t: t.n - t.zero(),
    "t10": lambda t: _drive(t.ranked(t.n // 10)[0]),
    "t90": lambda t: _drive(t.ranked(np.minimum(t.n, 9 * t.n // 10 + 1) - 1)[0]),
    "least_best": lambda t: _best(t.least()),
    "mean_best": lambda t: t.sums(_best)[0] / np.maximum(t.n, 1),
    "p90_best": lambda t: t.quantile(0.9, _best),
    # 4 km + 10 and 18 km are never under 2 km
    "transit_share": lambda t: t.count(lambda km: (_transit(km) < _drive(km)) & (_transit(km) < _walk(km)), 0.0) / np.maximum(t.n, 1),
    "gravity": lambda t: t.sums(lambda km: 1.0 / np.maximum(_best(km), 1.0), bends=(0.5,))[0],
    "best_5": lambda t: t.count(lambda km: _best(km) <= 5.0, 2.5),
    "best_10": lambda t: t.count(lambda km: _best(km) <= 10.0, 5.0),
    "best_15": lambda t: t.count(lambda km: _best(km) <= 15.0, 7.5),
    "over_300": lambda t: t.over(300.0),
    "mean_km": lambda t: t.moments()[0],
    "squares_km": lambda t: t.moments()[1],
    "squares_time": lambda t: _drive(_drive(t.moments()[1])),
    "products": lambda t: _drive(t.moments()[1]),
}


def named(*names: str) -> tuple[Callable[[Pairs], Iterable[tuple]], str]:
    """What makes some of SUMMARIES, and their columns."""
    made = [SUMMARIES[n][1] for n in names]

    def make(p: Pairs) -> list[tuple]:
        return [tuple(f(p) for f in made)]

    if all(n in TILED for n in names):
        make.tiled, make.unique = lambda t: [[TILED[n](t) for n in names]], "n_5km" not in names
    return make, ", ".join(f"{n} {SUMMARIES[n][0]}" for n in names)


def of_pairs(od: DataFrame, make: Callable[[Pairs], Iterable[tuple]], columns: str) -> DataFrame:
    """The same rows from given pairs (point_id, dest_id, dest_type, dx, dy, km, drive_time)."""
    names = ["point_id", "dest_type", *(c.split()[0] for c in columns.split(", "))]

    def run(key: tuple, r: pd.DataFrame) -> pd.DataFrame:
        pairs = Pairs(np.nan if key[0] is None else key[0], *(r[c].to_numpy() for c in ("dest_id", "dx", "dy", "km", "drive_time")))
        return pd.DataFrame([(*key, *row) for row in make(pairs)], columns=names)

    kinds = ", ".join(f"{c} {od.schema[c].dataType.simpleString()}" for c in ("point_id", "dest_type"))
    return od.select("point_id", "dest_type", "dest_id", "dx", "dy", "km", "drive_time").groupBy("point_id", "dest_type").applyInPandas(run, f"{kinds}, {columns}")


def modes(p: Pairs) -> list[tuple]:
    """A row for each mode: counts of implausible times, mean, squares about it, least and most."""
    count = lambda m: int(m.sum())
    return [
        (name, len(v), count(v < 0.0), count(v == 0.0), count(v > 180.0), count(v > 300.0), count((v >= 1.0) & (v <= 120.0)), float(v.mean()), float(((v - v.mean()) ** 2).sum()), float(v.min()), float(v.max()))
        for name, v in (("walk", p.walk), ("drive", p.drive), ("transit", p.transit))
    ]


def _tiled_modes(t: Tile) -> list[list]:
    """The rows of `modes` for all points of a tile. Times grow with the distance; by transit they fall at 2 km and jump at 15."""
    km, squares = t.moments()
    most, n2, n15 = t.ranked(t.n - 1)[0], t.count(lambda v: v < 2.0, 2.0), t.count(lambda v: v <= 15.0, 15.0)
    rows = []
    for name, f, mean, spread, edges in (("walk", _walk, _walk(km), 144.0 * squares, (1 / 12, 10.0, 15.0, 25.0)), ("drive", _drive, _drive(km), 4.0 * squares, (0.5, 60.0, 90.0, 150.0)), ("transit", _transit, *t.moments(transit=True), (1 / 18, 15.0, 15.0, 300 / 18))):
        under = [t.count(lambda v, f=f, b=b: f(v) < b if b == 1.0 else f(v) <= b, e) for b, e in zip((1.0, 120.0, 180.0, 300.0), edges, strict=True)]
        ends = [f(t.least()), f(most)]
        if name == "transit":
            ends += [f(v) for k in (n2, n15) for v in t.ranked(k - 1, k)]
        rows.append([name, t.n, np.zeros_like(t.n), t.zero(), t.n - under[2], t.n - under[3], under[1] - under[0], mean, spread, np.min(ends, axis=0), np.max(ends, axis=0)])
    return rows


modes.tiled = _tiled_modes

MODES = "feature string, n long, negative long, zero long, over_180 long, over_300 long, plausible long, mean double, squares double, least double, most double"


def selected(p: Pairs) -> list[tuple]:
    """Ids kept with a probability by distance: the ten nearest of these, and the nearest others up to three in all."""
    h = np.fmod(p.point * 7907 + p.dest_id * 104723, 1000) / 1000.0
    kept = h < np.where(p.km < 2.0, 0.9, np.where(p.km < 5.0, 0.5, 0.1))
    first = np.flatnonzero(kept)
    first = first[_first(10, p.km[first], p.dest_id[first])]
    if len(first) < 3:
        other = np.flatnonzero(~kept)
        first = np.concatenate([first, other[_first(3 - len(first), p.km[other], p.dest_id[other])]])
    return [(int(i),) for i in p.dest_id[first]]


def _first(n: int, v: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the n rows first in the order of v, then id."""
    at = np.flatnonzero(v <= np.partition(v, n - 1)[n - 1]) if len(v) > n else np.arange(len(v))
    return at[np.lexsort((ids[at], v[at]))][:n]
