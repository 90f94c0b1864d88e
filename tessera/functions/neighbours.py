"""Nearest neighbours and neighbours within a distance by grid cells: exact, without all pairs of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import BROADCAST_ROWS, sized, stored

#: Points of an average cell of the base grid, how much finer or coarser the next grid is, points of a cell that is cut
#: finer, candidates for each wanted neighbour, and finer grids at most.
PER_CELL, COARSER, DENSE, ENOUGH, FINEST = 8, 4, 128, 3, 12
#: Pairs of all rows of both sides that one task of `within` looks at, about, and its tasks at most.
TASK_PAIRS, MOST_TASKS = 4_000_000, 4000

def _grid(scale: float):
    """Cells along a side of a group's grid."""
    return F.greatest(F.floor(F.col("m0") * scale), F.lit(1))


def _cell(v: str, low: str, scale: float):
    m = _grid(scale)
    return F.least(F.greatest(F.floor((F.col(v) - F.col(low)) / F.col("side") * m), F.lit(0)), m - 1)


def _at(rows: DataFrame, x: str, y: str, scale: float) -> DataFrame:
    return rows.withColumns({"cx": _cell(x, "x0", scale), "cy": _cell(y, "y0", scale)})


def _around(cells: DataFrame, *keep: str) -> DataFrame:
    """Rows in their own cell and the eight around it."""
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    return cells.withColumn("o", around).select(*keep, (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))


def _levels(there: DataFrame, todo: DataFrame, boxes: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """Right rows, left rows with the number of the grid that they start on (0: base), and that of the finest grid.

    Cells of more than DENSE right rows are cut finer until there are none; a left row starts on the finest grid whose
    nine cells around it hold ENOUGH candidates. Of right rows at one and the same place only the smallest ids can be
    neighbours of anything.
    """
    cell = ["g", "cx", "cy"]
    most = max(DENSE, 4 * k)
    count = lambda rows, scale: stored(_at(rows.join(boxes, "g"), "bx", "by", scale).groupBy(*cell).agg(F.count(F.lit(1)).alias("n")))
    counts, blocks = count(there, 1), []
    if counts.filter(F.col("n") > most).isEmpty():
        return there, todo.withColumn("level", F.lit(0)), 0
    place = Window.partitionBy("g", "bx", "by").orderBy("dst")
    there = stored(there.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= k + 1).drop("nth"))
    counts = count(there, 1)
    inside, scale = there, 1
    while len(blocks) < FINEST:
        dense = stored(counts.filter(F.col("n") > most).select(*cell))
        if dense.isEmpty():
            break
        inside = stored(_at(inside.join(boxes, "g"), "bx", "by", scale).join(sized(dense), cell, "left_semi").select("g", "dst", "bx", "by"))
        scale *= COARSER
        counts = count(inside, scale)
        blocks.append(stored(_around(counts, "g", "n").groupBy(*cell).agg(F.sum("n").alias("n")).filter(F.col("n") >= ENOUGH * (k + 1)).select(*cell)))
    todo = todo.withColumn("level", F.lit(0))
    for i, block in enumerate(blocks):
        own = _at(todo.join(boxes, "g"), "ax", "ay", COARSER ** (i + 1)).select("g", "src", "ax", "ay", "level", "cx", "cy")
        todo = own.join(sized(block.withColumn("finer", F.lit(i + 1))), cell, "left").select("g", "src", "ax", "ay", F.coalesce("finer", "level").alias("level"))
    return there, stored(todo), len(blocks)


def nearest(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, group: str | None = None, same: bool = False) -> DataFrame:
    """Stored rows (src, dst, d, nth) or (src, dst, group, d, nth): the k nearest rows of right for each row of left.

    Both tables have x and y; with a group only rows of one group meet, with `same` a row does not meet its own id.
    Ties go to the smaller id. Every group has a grid over its own bounding box, with PER_CELL points in an average
    cell, and finer grids where right rows are dense. A point meets its own and the eight cells around, on the finest
    grid that has enough there; if k of these are no further than one cell's side, no other point can be nearer. The
    few points left go on with cells COARSER times as wide, until one cell holds the group. Points without
    coordinates have no neighbours.
    """
    key = F.col(group) if group else F.lit(0)
    todo = left.filter("x IS NOT NULL AND y IS NOT NULL").select(F.col(left_id).alias("src"), key.alias("g"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    there = right.filter("x IS NOT NULL AND y IS NOT NULL").select(F.col(right_id).alias("dst"), key.alias("g"), F.col("x").alias("bx"), F.col("y").alias("by"))
    side = F.greatest(F.max("bx") - F.min("bx"), F.max("by") - F.min("by"))
    box = there.groupBy("g").agg(F.min("bx").alias("x0"), F.min("by").alias("y0"), F.when(side > 0, side).otherwise(F.lit(1.0)).alias("side"), F.greatest(F.lit(1), F.floor(F.sqrt(F.count(F.lit(1)) / PER_CELL))).alias("m0"))
    box = stored(box)
    coarsest, boxes = box.agg(F.max("m0")).first()[0] or 1, sized(box)
    there, todo, level = _levels(there, todo, boxes, k)
    found, scale = None, float(COARSER**level)
    each = Window.partitionBy("src")
    while True:
        cells = _around(_at(there.join(boxes, "g"), "bx", "by", scale), "g", "dst", "bx", "by")
        now = todo.filter(F.col("level") >= level) if level > 0 else todo
        own = _at(now.join(boxes, "g"), "ax", "ay", scale).select("g", "src", "ax", "ay", "cx", "cy", (F.col("side") / _grid(scale)).alias("reach"), (_grid(scale) == 1).alias("whole"))
        pairs = own.join(cells.hint("merge"), ["g", "cx", "cy"])
        if same:
            pairs = pairs.filter("src <> dst")
        pairs = pairs.withColumn("d2", (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
        near = pairs.withColumn("nth", F.row_number().over(each.orderBy("d2", "dst"))).filter(F.col("nth") <= k)
        settled = F.col("whole") | ((F.count(F.lit(1)).over(each) == k) & (F.sqrt(F.max("d2").over(each)) <= F.col("reach")))
        part = stored(near.withColumn("settled", settled).filter("settled").select("src", "dst", "g", F.sqrt("d2").alias("d"), "nth"))
        found = part if found is None else found.unionByName(part)
        if level <= 0 and coarsest * scale < 2:
            break
        todo = stored(todo.join(part.select("src").distinct().hint("merge"), "src", "left_anti"))
        if todo.isEmpty():
            break
        scale, level = scale / COARSER, level - 1
    return found.withColumnRenamed("g", group) if group else found.drop("g")


def _offsets(split: int, half: bool = False) -> list[tuple[int, int]]:
    """Cells (i, j) away that a point within `split` cell sides can lie in; with half, one of each opposite pair."""
    gap = lambda i: max(abs(i) - 1, 0)
    around = range(-split, split + 1)
    return [(i, j) for i in around for j in around if gap(i) ** 2 + gap(j) ** 2 <= split**2 and (not half or i > 0 or i == 0 and j >= 0)]


def within(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, split: int = 3) -> DataFrame:
    """Rows (src, dst, dx, dy) for every row of left and of right that lie no further apart than radius.

    Both have x and y; rows without them meet nothing. Cells have radius / split sides; right rows, which should be the
    fewer, are copied to all cells within the radius and meet left rows by an equi join: in memory if their copies are
    few, else by a sort-merge join whose heavy cells adaptive execution splits. No row of left is copied.
    """
    side, offsets = radius / split, _offsets(split)
    cell = lambda v: F.floor(F.col(v) / side)
    there = stored(right.filter("x IS NOT NULL AND y IS NOT NULL").select(F.col(right_id).alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by")))
    copies = there.withColumn("o", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets))))
    copies = copies.select("dst", "bx", "by", (cell("bx") + F.col("o.i")).alias("cx"), (cell("by") + F.col("o.j")).alias("cy"))
    copies = F.broadcast(copies) if there.count() * len(offsets) <= BROADCAST_ROWS else copies.hint("merge")
    own = left.filter("x IS NOT NULL AND y IS NOT NULL").select(F.col(left_id).alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    # the work is the pairs, not the bytes of left, which may lie in one file: tasks of at most about TASK_PAIRS
    own = own.repartition(max(1, min(left.count() * there.count() // TASK_PAIRS, MOST_TASKS)))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return own.join(copies, ["cx", "cy"]).filter(dx * dx + dy * dy <= radius * radius).select("src", "dst", dx.alias("dx"), dy.alias("dy"))


def band(points: DataFrame, radius: float, key: str, group: str | None = None) -> DataFrame:
    """Rows (src, dst, d), or (src, dst, group, d), of all other points no further away than radius, of the own group.

    A self join by cells of the radius: each pair meets once, in the cell of its first point, and is emitted both ways.
    """
    cell = lambda v: F.floor(F.col(v) / radius)
    g = F.col(group) if group else F.lit(0)
    own = points.filter("x IS NOT NULL AND y IS NOT NULL").select(F.col(key).alias("a"), g.alias("g"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _offsets(1, half=True)))
    other = own.select(F.col("a").alias("b"), "g", F.col("ax").alias("bx"), F.col("ay").alias("by"), "cx", "cy", F.explode(offsets).alias("o"))
    other = other.select("b", "g", "bx", "by", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("same"))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    met = own.join(other.hint("merge"), ["g", "cx", "cy"]).filter(~F.col("same") | (F.col("a") < F.col("b"))).withColumn("d", F.sqrt(d2)).filter(F.col("d") <= radius)
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    out = met.select(both.alias("e"), "g", "d").select("e.src", "e.dst", *([F.col("g").alias(group)] if group else []), "d")
    return out


def lonely(left: DataFrame, right: DataFrame, radius: float, kinds: DataFrame, kind: str, split: int = 3) -> DataFrame:
    """Rows of left x kinds, stored, that may have no row of right of that kind within radius.

    A point has one for certain if its own cell or one of the eight around holds a row of the kind: with sides of a
    third of the radius no two points there are further apart. kinds is a small table (a broadcast of a few types).
    """
    side = radius / split
    cell = lambda v: F.floor(F.col(v) / side)
    near = right.filter("x IS NOT NULL AND y IS NOT NULL").select(kind, cell("x").alias("cx"), cell("y").alias("cy")).distinct()
    near = stored(_around(near, kind).distinct())
    rows = left.filter("x IS NOT NULL AND y IS NOT NULL").join(F.broadcast(kinds)).withColumns({"cx": cell("x"), "cy": cell("y")})
    return stored(rows.join(sized(near), [kind, "cx", "cy"], "left_anti").drop("cx", "cy"))
