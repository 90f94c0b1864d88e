"""Points in polygons: cells of several sizes cover each polygon, only cells on its boundary cast rays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import BROADCAST_ROWS, stored

CELL = ["poly_id", "level", "cx", "cy"]


def segments(corners: DataFrame) -> DataFrame:
    """(poly_id, x1, y1, x2, y2) of the closed rings (poly_id, ring, seq, x, y)."""
    ring = Window.partitionBy("poly_id", "ring").orderBy("seq")
    following = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(ring))
    return corners.select("poly_id", F.col("x").alias("x1"), F.col("y").alias("y1"), following("x").alias("x2"), following("y").alias("y2"))


def _crossed(px, py, x1, y1, x2, y2):
    """Whether a ray from (px, py) to the right crosses the segment; ends count by the half-open rule."""
    return ((y1 > py) != (y2 > py)) & (px < F.try_divide((x2 - x1) * (py - y1), y2 - y1) + x1)


def covering(corners: DataFrame, most: int = 16, rounds: int = 6) -> DataFrame:
    """Stored cells (poly_id, level, cx, cy, base, segs) of side 2^-level that cover the polygons.

    A point of a cell is inside if base plus the crossings of a ray with segs is odd. A cell that no segment touches
    is all inside and has no segs, or all outside and is no row. A cell starts as large as the polygon and is cut in
    sixteen, `rounds` times at most, while it has more than `most` segs.

    A segment that passes a cell on the right is crossed by all rays between the heights of its ends: it toggles the
    parity at each end. Toggles below the cell add to its base, two at one height cancel, so of a ring's part beside
    the cell next to nothing is left; the others become vertical segs far to the right.
    """
    lines = stored(segments(corners))
    box = lines.groupBy("poly_id").agg(*(F.min(F.least(f"{v}1", f"{v}2")).alias(f"{v}0") for v in "xy"), *(F.max(F.greatest(f"{v}1", f"{v}2")).alias(f"{v}9") for v in "xy"))
    span = F.greatest(F.col("x9") - F.col("x0"), F.col("y9") - F.col("y0"))
    box = box.withColumn("level", F.when(span > 0, F.floor(-F.log2(span))).otherwise(F.lit(20)).cast("int"))
    index = lambda v: F.floor(F.col(v) * F.pow(F.lit(2.0), F.col("level")))
    cells = box.select("poly_id", "level", F.explode(F.sequence(index("x0"), index("x9"))).alias("cx"), index("y0").alias("b"), index("y9").alias("t"))
    own = stored(cells.select("poly_id", "level", "cx", F.explode(F.sequence("b", "t")).alias("cy"), F.lit(0).alias("base")))  # four a polygon at most
    rows, keys, n = lines, ["poly_id"], own.count()  # a row without x1 is a toggle at y1

    x1, y1, x2, y2, left, low, side = (F.col(c) for c in ("x1", "y1", "x2", "y2", "left", "low", "side"))
    right, high = left + side, low + side
    beside = (F.greatest(y1, y2) >= low) & (F.least(y1, y2) <= high) & (F.greatest(x1, x2) >= left)
    turns = [(x2 - x1) * (v - y1) - (y2 - y1) * (u - x1) for u in (left, right) for v in (low, high)]
    slack = 1e-9 * side * (F.abs(x2 - x1) + F.abs(y2 - y1))
    touches = (F.least(x1, x2) <= right) & (F.least(*turns) <= slack) & (F.greatest(*turns) >= -slack)
    between = (F.greatest(F.least(y1, y2), low) + F.least(F.greatest(y1, y2), high)) / 2
    passes = F.try_divide((x2 - x1) * (between - y1), y2 - y1) + x1 > right
    middle = _crossed(left + side / 2, low + side / 2, x1, y1, x2, y2)

    whole = None
    for step in range(rounds + 1):
        size = F.pow(F.lit(2.0), -F.col("level"))
        placed = own.withColumns({"side": size, "left": F.col("cx") * size, "low": F.col("cy") * size}).drop("base")
        met = rows.join(F.broadcast(placed) if n <= BROADCAST_ROWS else placed.hint("merge"), keys)
        ends = F.when(x1.isNull(), F.array(y1)).when(touches, F.array().cast("array<double>")).when(passes, F.array(y1, y2)).otherwise(F.array().cast("array<double>"))
        met = met.filter(x1.isNull() & (y1 <= high) | beside)
        met = stored(met.select(*CELL, "x1", "y1", "x2", "y2", (x1.isNotNull() & touches).alias("near"), middle.alias("middle"), F.filter(ends, lambda y: y <= high).alias("ends"), low.alias("low"), (low + side / 2).alias("half")))
        toggles = met.select(*CELL, F.explode("ends").alias("y"), "low", "half").groupBy(*CELL, "y").agg(F.count(F.lit(1)).alias("c"), F.min("low").alias("low"), F.min("half").alias("half")).filter("c % 2 = 1")
        toggles = stored(toggles.drop("c"))
        turned = toggles.groupBy(*CELL).agg(F.count_if(F.col("y") <= F.col("low")).alias("below"), F.count_if(F.col("y") > F.col("low")).alias("kept"), F.count_if((F.col("y") > F.col("low")) & (F.col("y") <= F.col("half"))).alias("half"))
        near = met.filter("near").groupBy(*CELL).agg(F.count(F.lit(1)).alias("touching"), F.count_if("middle").alias("mid"))
        state = own.select(*CELL, "base").join(near.hint("merge"), CELL, "left").join(turned.hint("merge"), CELL, "left").fillna(0, ["touching", "mid", "below", "kept", "half"])
        state = stored(state.select(*CELL, (F.col("base") + F.col("below")).cast("int").alias("base"), "touching", (F.col("touching") + F.col("kept")).alias("n"), (F.col("mid") + F.col("half")).alias("mid")))
        none = F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
        full = state.filter("touching = 0 AND (base + mid) % 2 = 1").select(*CELL, F.lit(1).alias("base"), none.alias("segs"))
        far = F.lit(1e300)
        left_over = toggles.filter(F.col("y") > F.col("low")).select(*CELL, far.alias("x1"), F.col("y").alias("y1"), far.alias("x2"), far.alias("y2"))
        segs = met.filter("near").select(*CELL, "x1", "y1", "x2", "y2").unionByName(left_over)
        deep = step == rounds
        ready = state.filter("touching > 0" if deep else f"touching > 0 AND n <= {most}").select(*CELL, "base")
        kept = segs.join(ready.hint("merge"), CELL).groupBy(*CELL).agg(F.min("base").alias("base"), F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("segs"))
        part = full.unionByName(kept)
        whole = part if whole is None else whole.unionByName(part)
        split = state.filter(f"touching > 0 AND n > {most}")
        n = 0 if deep else 16 * split.count()
        if not n:
            return stored(whole)
        parts = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(4) for j in range(4))))
        up = [F.col(c).alias(f"up_{c}") for c in CELL[1:]]
        own = split.select("poly_id", *up, "base", parts.alias("q"))
        own = stored(own.select("*", (F.col("up_level") + 2).alias("level"), (4 * F.col("up_cx") + F.col("q.i")).alias("cx"), (4 * F.col("up_cy") + F.col("q.j")).alias("cy")).drop("q"))
        empty = F.lit(None).cast("double")
        inner = toggles.filter(F.col("y") > F.col("low")).select("poly_id", *up, empty.alias("x1"), F.col("y").alias("y1"), empty.alias("x2"), empty.alias("y2"))
        rows, keys = met.filter("near").select("poly_id", *up, "x1", "y1", "x2", "y2").unionByName(inner), ["poly_id", "up_level", "up_cx", "up_cy"]


def contains(points: DataFrame, corners: DataFrame, key: str = "point_id", most: int = 16, rounds: int = 6) -> DataFrame:
    """(key, poly_id) for every point (key, x, y) inside a polygon, by the parity of a ray's crossings.

    Points exactly on a boundary belong to one side by the half-open rule. A point looks one cell up for each cell
    size in use; rays are cast only in cells that a boundary touches, against their own few segments.
    """
    cells = covering(corners, most, rounds)
    levels = [r["level"] for r in cells.select("level").distinct().collect()]  # a few dozen at most
    size = cells.agg(F.sum(1 + F.coalesce(F.size("segs"), F.lit(0)))).first()[0] or 0
    cells = F.broadcast(cells) if size <= BROADCAST_ROWS else cells.hint("merge")
    scale = F.pow(F.lit(2.0), F.col("level"))
    own = points.filter("x IS NOT NULL AND y IS NOT NULL").select(key, "x", "y", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    own = own.select(key, F.col("x").alias("px"), F.col("y").alias("py"), "level", F.floor(F.col("x") * scale).alias("cx"), F.floor(F.col("y") * scale).alias("cy"))
    crossings = F.coalesce(F.size(F.filter("segs", lambda s: _crossed(F.col("px"), F.col("py"), s["x1"], s["y1"], s["x2"], s["y2"]))), F.lit(0))
    return own.join(cells, ["level", "cx", "cy"]).filter((F.col("base") + crossings) % 2 == 1).select(key, "poly_id")
