"""Which region a point lies in: polygons with holes as segments, met by cells of a grid in two directions.

Every region has cells of a size of its own, a power of two degrees, so that it is covered by about as many cells as it
has segments, 256 at least.  A cell that no segment touches lies wholly inside or outside, which the middle of its row
tells; only points in cells that a segment touches meet segments, those of their row.  Costs grow with the segments and
the points, not with the size of regions or the number of those in the same latitude.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells on a side that a region has, and the sizes that cells may have as powers of two degrees (a tenth of a metre to the globe's).
FEWEST, MOST, FINEST, COARSEST = 16, 256, -20, 6
#: The part of a cell by which segments are thought thicker than they are, so that rounding moves no point past a border cell.
SLACK = 1e-6
_SIDES = ("y1", "x1", "y2", "x2")
_KEY = ["region", "level", "cy"]


def _finite(*names: str) -> Column:
    both = F.lit(True)
    for n in names:
        both = both & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return both


def _cut(y: Column) -> Column:
    """Where a segment crosses the latitude ``y``."""
    return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")


def _crosses(y: Column) -> Column:
    return (F.col("y1") > y) != (F.col("y2") > y)


def boxes(segments: DataFrame) -> DataFrame:
    """(region, ord, level): the least ``ord`` of a region and the size of its cells, 2 ^ level degrees."""
    span = lambda a, b: F.max(F.greatest(a, b)) - F.min(F.least(a, b))
    sized = segments.groupBy("region").agg(F.min("ord").alias("ord"), F.greatest(span("y1", "y2"), span("x1", "x2")).alias("side"), F.count(F.lit(1)).alias("n"))
    cells = F.least(F.greatest(F.sqrt("n"), F.lit(FEWEST)), F.lit(MOST))
    level = F.when(F.col("side") > 0, F.greatest(F.least(F.ceil(F.log2(F.col("side") / cells)), F.lit(COARSEST)), F.lit(FINEST))).otherwise(F.lit(FINEST))
    return sized.select("region", "ord", level.cast("int").alias("level"))


def strips(segments: DataFrame, sized: DataFrame) -> DataFrame:
    """Each segment once for every row of cells that it touches, with the cells that it touches there, c0 to c1."""
    rows = segments.select("region", *_SIDES).join(sized, "region").withColumn("s", F.pow(F.lit(2.0), "level"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = rows.withColumn("cy", F.explode(F.sequence(F.floor(low / F.col("s") - SLACK), F.floor(high / F.col("s") + SLACK))))
    within = lambda x: F.greatest(F.least(x, F.greatest("x1", "x2")), F.least("x1", "x2"))
    flat = F.col("y1") == F.col("y2")
    a = F.when(flat, F.col("x1")).otherwise(within(_cut(F.greatest(low, (F.col("cy") - SLACK) * F.col("s")))))
    b = F.when(flat, F.col("x2")).otherwise(within(_cut(F.least(high, (F.col("cy") + 1 + SLACK) * F.col("s")))))
    rows = rows.withColumns({"a": a, "b": b})
    return rows.withColumns({"c0": F.floor(F.least("a", "b") / F.col("s") - SLACK), "c1": F.floor(F.greatest("a", "b") / F.col("s") + SLACK)}).drop("a", "b")


def cover(striped: DataFrame) -> DataFrame:
    """(region, ord, level, cy, cx, inside): cells wholly inside, and, with ``inside`` false, those that a segment touches."""
    border = striped.select(*_KEY, "ord", F.explode(F.sequence("c0", "c1")).alias("cx")).distinct()
    middle = (F.col("cy") + 0.5) * F.col("s")
    crossed = striped.where(_crosses(middle)).withColumn("cut", _cut(middle))
    along = Window.partitionBy(*_KEY).orderBy("cut")
    runs = crossed.withColumns({"k": F.row_number().over(along), "to": F.lead("cut").over(along)}).where("k % 2 = 1 AND to IS NOT NULL")
    cells = runs.select(*_KEY, "ord", F.explode(F.sequence(F.floor(F.col("cut") / F.col("s")), F.floor(F.col("to") / F.col("s")))).alias("cx"))
    inner = cells.join(border, [*_KEY, "cx"], "left_anti").distinct()
    return inner.withColumn("inside", F.lit(True)).unionByName(border.withColumn("inside", F.lit(False)))


def in_polygon(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(sid, region) by the even-odd rule; of several regions the one of least ``ord``, then of least name.

    ``points``: sid (unique), lat, lng.  ``segments``: region, ord, y1, x1, y2, x2, those of holes among them.  Points
    and segments without finite coordinates are left out.  A point on a border belongs to the polygon to its east.
    """
    lines, placed = segments.where(_finite(*_SIDES)), points.where(_finite("lat", "lng"))
    sized = boxes(lines)
    # at most COARSEST - FINEST + 1 sizes, however many regions there are
    levels = sorted(r["level"] for r in sized.select("level").distinct().collect())
    striped = strips(lines, sized)
    at = placed.select("sid", "lat", "lng", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "level"))
    met = at.withColumns({"cy": cell("lat"), "cx": cell("lng")}).join(cover(striped), ["level", "cy", "cx"])
    sure = met.where("inside").select("sid", "region", "ord")
    asked = met.where("NOT inside").select("sid", "lat", "lng", *_KEY, "ord")
    crossing = asked.join(striped.select(*_KEY, *_SIDES), _KEY).where(_crosses(F.col("lat")))
    odd = crossing.groupBy("sid", "region", "ord").agg(F.count_if(F.col("lng") < _cut(F.col("lat"))).alias("n")).where("n % 2 = 1")
    every = sure.unionByName(odd.select("sid", "region", "ord"))
    return every.groupBy("sid").agg(F.min_by("region", F.struct("ord", "region")).alias("region"))
