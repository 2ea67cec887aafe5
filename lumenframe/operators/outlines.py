"""Shapes and outlines of labelled regions: perimeters by crossings, hulls, contours as rings.

A region's hull comes from the ends of its rows, one array bounded by the raster's height. Contours are the edges of
marching squares, two by two pixels each, that are joined to rings by what they share; no raster is in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.graph import star_roots
from lumenframe.operators.raster import DS
from lumenframe.operators.regions import shape_moments
from lumenframe.session import drop_table, materialize

#: Which places a cell of two by two pixels joins, by the pixels that are set (1 upper left, 2 upper right, 4 lower left,
#: 8 lower right), the region on the right of the way as y goes down. Of two pixels that share a corner only, each stands alone.
JOINED = {1: "TL", 2: "RT", 3: "RL", 4: "LB", 5: "TB", 6: "RT LB", 7: "RB", 8: "BR", 9: "TL BR", 10: "BT", 11: "BL", 12: "LR", 13: "TR", 14: "LT"}
#: Twice the way from a cell's upper left pixel to the middle of each of its sides: down, right.
SIDES = {"T": (0, 1), "R": (1, 2), "B": (2, 1), "L": (1, 0)}
ROW = 1 << 32


def crossings(labels: DataFrame) -> DataFrame:
    """Per region, how often lines of pixels enter it: ds_id, label, n_h (rows), n_v (columns), n_d (both diagonals)."""
    entered = lambda *by: F.lag(F.struct("y", "x")).over(W.partitionBy(DS, "label", *by).orderBy("y", "x"))
    t = labels.where("label > 0").select(DS, "label", "y", "x", (F.col("y") - F.col("x")).alias("d"), (F.col("y") + F.col("x")).alias("a"))
    t = t.select(DS, "label", "y", "x", entered("y").alias("h"), entered("x").alias("v"), entered("d").alias("p"), entered("a").alias("q"))
    new = lambda c, dy, dx: (~F.coalesce((F.col(f"{c}.y") == F.col("y") - dy) & (F.col(f"{c}.x") == F.col("x") - dx), F.lit(False))).cast("int")
    return t.groupBy(DS, "label").agg(F.count("*").alias("area"), F.sum(new("h", 0, 1)).alias("n_h"), F.sum(new("v", 1, 0)).alias("n_v"), F.sum(new("p", 1, 1) + new("q", 1, -1)).alias("n_d"))


def crofton(n_h: Column, n_v: Column, n_d: Column) -> Column:
    """A perimeter by the lines in four directions that meet it."""
    return math.pi / 4 * (n_h + n_v + n_d / math.sqrt(2))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (y, x), in order."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    sides = []
    for some in (p, p[::-1]):
        out: list = []
        for q in some.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        sides += out[:-1]
    return np.array(sides)


def row_ends(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The middles of the outer sides of pixels at the ends a to b of rows y."""
    return np.concatenate([np.stack(p, 1) for p in ((y, a - 0.5), (y, b + 0.5), (y - 0.5, a), (y + 0.5, a), (y - 0.5, b), (y + 0.5, b))])


def hull_of_rows(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """Pixels whose centres lie in the hull of a region given by its rows' ends, and the largest distance across these pixels."""
    h = hull(row_ends(y, a, b))
    rows = np.arange(y.min(), y.max() + 1)
    lo, hi = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
    for (y0, x0), (y1, x1) in zip(h, np.roll(h, -1, axis=0), strict=True):
        some = (rows >= min(y0, y1)) & (rows <= max(y0, y1))
        if y0 == y1:
            x = np.array([x0, x1])
            lo[some], hi[some] = np.minimum(lo[some], x.min()), np.maximum(hi[some], x.max())
        else:
            x = x0 + (rows[some] - y0) * (x1 - x0) / (y1 - y0)
            lo[some], hi[some] = np.minimum(lo[some], x), np.maximum(hi[some], x)
    left, right = np.ceil(lo - 1e-9), np.floor(hi + 1e-9)
    ok = right >= left
    corners = hull(row_ends(rows[ok].astype(float), left[ok], right[ok]))
    far = max(float(np.hypot(*(corners - c).T).max()) for c in corners)
    return int((right - left + 1)[ok].sum()), far


def hulls(labels: DataFrame) -> DataFrame:
    """ds_id, label, convex (pixels of the hull), feret (the largest distance across it) of each region."""
    rows = labels.where("label > 0").groupBy(DS, "label", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    rows = rows.groupBy(DS, "label").agg(F.sort_array(F.collect_list(F.struct("y", "a", "b"))).alias("r"))
    part = lambda c: F.transform("r", lambda p: p.getField(c).cast("double")).alias(c)
    rows = rows.select(DS, "label", part("y"), part("a"), part("b"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            got = [hull_of_rows(*(np.array(v) for v in r)) for r in zip(*(t.column(c).to_pylist() for c in ("y", "a", "b")), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(DS), t.column("label"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=[DS, "label", "convex", "feret"])

    kinds = {f.name: f.dataType.simpleString() for f in labels.schema.fields}
    return rows.mapInArrow(measured, f"{DS} {kinds[DS]}, label {kinds['label']}, convex long, feret double")


def shape_descriptors(labels: DataFrame) -> DataFrame:
    """shape_moments() of each region with perimeter (Crofton), circularity, solidity and feret."""
    c = crossings(labels)
    perimeter = crofton(F.col("n_h"), F.col("n_v"), F.col("n_d"))
    t = shape_moments(labels).join(c.select(DS, "label", perimeter.alias("perimeter")), [DS, "label"]).join(hulls(labels), [DS, "label"])
    return t.withColumn("circularity", 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter"))).withColumn("solidity", F.col("area") / F.col("convex")).drop("convex")


def contour_steps(labels: DataFrame) -> DataFrame:
    """Steps of the contours of all regions: ds_id, label, u, v (numbers of the points at their ends), and their places y0, x0, y1, x1.

    The points are the middles between pixels of a region and others, so a ring around one pixel has an area of a half.
    What lies outside a raster belongs to no region. Points are numbered by place, in the order in which a raster is read.
    """
    cells = F.array(*[F.struct((F.col("y") - dy).alias("cy"), (F.col("x") - dx).alias("cx"), F.lit(bit).alias("bit")) for dy, dx, bit in ((0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8))])
    t = labels.where("label > 0").select(DS, "label", F.explode(cells).alias("c")).select(DS, "label", "c.*")
    t = t.groupBy(DS, "label", "cy", "cx").agg(F.sum("bit").cast("int").alias("set")).where("set < 15")
    step = lambda way: F.struct(*[F.lit(d).alias(n) for n, d in zip(("dy0", "dx0", "dy1", "dx1"), (*SIDES[way[0]], *SIDES[way[1]]), strict=True)])
    table = F.create_map(*[x for k, ways in JOINED.items() for x in (F.lit(k), F.array(*[step(w) for w in ways.split()]))])
    t = t.select(DS, "label", "cy", "cx", F.explode(table[F.col("set")]).alias("s"))
    place = lambda c, d: 2 * F.col(c) + F.col(f"s.{d}")
    t = t.select(DS, "label", place("cy", "dy0").alias("a"), place("cx", "dx0").alias("b"), place("cy", "dy1").alias("c"), place("cx", "dx1").alias("d"))
    number = lambda y, x: F.col(y).cast("long") * ROW + F.col(x)
    return t.select(DS, "label", number("a", "b").alias("u"), number("c", "d").alias("v"), *[(F.col(p) / 2).alias(n) for p, n in (("a", "y0"), ("b", "x0"), ("c", "y1"), ("d", "x1"))])


def contour_rings(labels: DataFrame) -> DataFrame:
    """Steps of contour_steps() with ring, the smallest point of the ring that each is on."""
    steps = materialize(contour_steps(labels), "contour-steps")
    roots = star_roots(steps.select(F.struct(DS, "label").alias("g"), "u", "v"), "contour-rings")
    return steps.hint("merge").join(roots.select(F.col(f"g.{DS}").alias(DS), F.col("g.label").alias("label"), F.col("node").alias("u"), F.col("root").alias("ring")), [DS, "label", "u"])


def ring_areas(rings: DataFrame) -> DataFrame:
    """ds_id, label, ring, points, area (below 0 for holes), length, and the centre cy, cx of each ring of contour_rings()."""
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    g = rings.groupBy(DS, "label", "ring").agg(F.count("*").alias("points"), (F.sum(cross) / 2).alias("area"), F.sum(F.hypot(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))).alias("length"), F.sum((F.col("y0") + F.col("y1")) * cross).alias("my"), F.sum((F.col("x0") + F.col("x1")) * cross).alias("mx"))
    return g.select(DS, "label", "ring", "points", "area", "length", (F.col("my") / (6 * F.col("area"))).alias("cy"), (F.col("mx") / (6 * F.col("area"))).alias("cx"))


def outlines(labels: DataFrame) -> DataFrame:
    """Regions by their contours: ds_id, label, outer and holes (numbers of rings), net (area less the holes'), outer_length, cy, cx.

    The centre is that of the area without its holes.
    """
    a = ring_areas(contour_rings(labels))
    weigh = lambda c: F.sum(F.col(c) * F.col("area")) / F.sum("area")
    outer = F.col("area") > 0
    return a.groupBy(DS, "label").agg(F.sum(outer.cast("long")).alias("outer"), F.sum((~outer).cast("long")).alias("holes"), F.sum("area").alias("net"), F.sum(F.when(outer, F.col("length"))).alias("outer_length"), weigh("cy").alias("cy"), weigh("cx").alias("cx"))


def ordered_rings(rings: DataFrame) -> DataFrame:
    """Points of contour_rings() in order: ds_id, label, ring, i (from 0, the ring's smallest point), y, x.

    Pointer doubling: each point knows how many steps lead to the ring's end from it, twice as far in each round, so a ring of n
    points takes log n joins. They merge sorted points, as tables broadcast in each round would add up in the driver.
    """
    key = [DS, "label", "ring"]
    at = materialize(rings.select(*key, F.col("u").alias("p"), F.when(F.col("v") != F.col("ring"), F.col("v")).alias("next"), F.lit(1).cast("long").alias("far"), "y0", "x0"), "ring-order")
    while not at.where("next is not null").isEmpty():
        on = at.select(*key, F.col("p").alias("next"), F.col("next").alias("beyond"), F.col("far").alias("more"))
        longer = at.hint("merge").join(on, [*key, "next"], "left")
        new = materialize(longer.select(*key, "p", F.col("beyond").alias("next"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), "y0", "x0"), "ring-order")
        drop_table(at)
        at = new
    size = F.max("far").over(W.partitionBy(*key))
    return at.select(*key, (size - F.col("far")).alias("i"), F.col("y0").alias("y"), F.col("x0").alias("x"))


def simplified(points: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Corners of ordered rings that lie farther than the tolerance from the line of those kept (Douglas-Peucker): same columns.

    Rings are cut at their first point and the one farthest from it. Each round splits all stretches of all rings at
    their farthest point at once, by one maximum a stretch. A ring that would keep less than three corners stays whole.
    """
    key = [DS, "label", "ring"]
    first = points.where("i = 0").select(*key, F.col("y").alias("fy"), F.col("x").alias("fx"))
    n = points.groupBy(*key).agg(F.count("*").alias("n"))
    far = points.join(first, key).groupBy(*key).agg(F.max_by("i", F.struct(F.round(F.hypot(F.col("y") - F.col("fy"), F.col("x") - F.col("fx")), 9), -F.col("i"))).alias("cut"))
    ends = far.join(n, key)
    at = lambda c, name: points.select(*key, F.col("i").alias(c), F.col("y").alias(f"{name}y"), F.col("x").alias(f"{name}x"))
    todo = materialize(ends.select(*key, "n", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("cut").alias("b")), F.struct(F.col("cut").alias("a"), F.col("n").alias("b")))).alias("s")).select(*key, "n", "s.*").where("b > a"), "stretches")
    kept = materialize(todo.select(*key, F.col("a").alias("i")).distinct(), "corners")
    while not todo.isEmpty():
        t = todo.withColumn("z", F.col("b") % F.col("n")).join(at("a", "a"), [*key, "a"]).join(at("z", "z"), [*key, "z"])
        t = t.join(points, key).where("i > a AND i < b")
        dy, dx = F.col("zy") - F.col("ay"), F.col("zx") - F.col("ax")
        span = F.hypot(dy, dx)
        off = F.when(span > 0, F.abs(dx * (F.col("y") - F.col("ay")) - dy * (F.col("x") - F.col("ax"))) / span).otherwise(F.hypot(F.col("y") - F.col("ay"), F.col("x") - F.col("ax")))
        cut = t.groupBy(*key, "n", "a", "b").agg(F.max(F.struct(F.round(off, 9).alias("d"), (-F.col("i")).alias("i"))).alias("m")).where(F.col("m.d") > tolerance).select(*key, "n", "a", "b", (-F.col("m.i")).alias("i"))
        cut = materialize(cut, "cuts")
        kept = materialize(kept.unionByName(cut.select(*key, "i")), "corners")
        todo = materialize(cut.select(*key, "n", F.explode(F.array(F.struct("a", F.col("i").alias("b")), F.struct(F.col("i").alias("a"), "b"))).alias("s")).select(*key, "n", "s.*").where("b - a > 1"), "stretches")
    few = kept.groupBy(*key).count().where("count < 3").select(*key)
    whole = points.join(few, key, "left_semi")
    return points.join(kept.join(few, key, "left_anti"), [*key, "i"]).select(*points.columns).unionByName(whole)
