"""Exact percentiles of large columns by refining histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

#: Cells that an interval is cut into at each pass.
CELLS = 1024


def percentiles(rows: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """A row (g, name, ...) for each group g of rows (g, v): percentiles of v, interpolated between neighbours.

    v must be finite; nulls and NaN are left out. The smallest and largest value of each interval that holds a wanted
    place are known; a pass counts the values of its cells, and the cell with the place is the next interval, until
    it holds one value. A pass moves CELLS rows an interval, to the driver too; a billion values take three or four.
    Groups must be few.
    """
    rows = stored(rows.select("g", F.col("v").cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)"))
    whole = {r["g"]: r for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    places = {g: {name: f * (r["n"] - 1) for name, f in wanted.items()} for g, r in whole.items()}
    at = {(g, k): (whole[g]["lo"], whole[g]["hi"], 0) for g, of in places.items() for p in of.values() for k in {math.floor(p), math.ceil(p)}}
    while spans := sorted({(g, lo, hi) for (g, _), (lo, hi, _) in at.items() if lo < hi}, key=str):
        table = rows.sparkSession.createDataFrame([(i, *s) for i, s in enumerate(spans)], f"i int, h {rows.schema['g'].dataType.simpleString()}, lo double, hi double")
        met = rows.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("h")) & F.col("v").between(F.col("lo"), F.col("hi")))  # a row for each wanted place
        cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS), F.lit(CELLS - 1))
        counts = met.groupBy("i", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "cell").collect()
        cells: dict[int, list] = {}
        for r in counts:
            cells.setdefault(r["i"], []).append(r)
        number = {s: i for i, s in enumerate(spans)}
        for (g, k), (lo, hi, before) in at.items():
            if lo == hi:
                continue
            for r in cells[number[g, lo, hi]]:
                if before + r["n"] > k:
                    at[g, k] = (r["lo"], r["hi"], before)
                    break
                before += r["n"]
    found = []
    for g, of in places.items():
        low = {name: (at[g, math.floor(p)][0], at[g, math.ceil(p)][0], p - math.floor(p)) for name, p in of.items()}
        found.append((g, *(a + (b - a) * part for a, b, part in low.values())))
    return rows.sparkSession.createDataFrame(found, f"g {rows.schema['g'].dataType.simpleString()}, " + ", ".join(f"`{n}` double" for n in wanted))
