"""Points of rasters: maxima, atom columns and spots that keep apart, the strongest place of each ray, colours of maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.raster import AXES, DS, gaussian, shape
from lumenframe.session import drop_table, materialize

PLACE = [DS, "y", "x"]


def local_maxima(img: DataFrame) -> DataFrame:
    """Pixels that none of their eight neighbours exceeds; equal neighbours are all maxima."""
    top = img.withColumn("top", F.col("v"))
    for axis, other in AXES:
        top = top.withColumn("top", F.max("top").over(W.partitionBy(DS, other).orderBy(axis).rowsBetween(-1, 1)))
    return top.where("v >= top").drop("top")


def separated(points: DataFrame, distance: float, ties: tuple[str, str] = ("y", "x")) -> DataFrame:
    """Points (ds_id, y, x, v) that remain if, from the strongest on, each takes away those nearer than `distance`.

    Points of equal v come in the order of `ties`. Pairs of near points meet in cells as wide as the distance. In each
    round the points without a stronger one near them stay and their neighbours go, so the result is that of going
    through them one by one. Points at one place count once; an empty table gives an empty result.
    """
    cell = max(1, math.ceil(distance))
    points = materialize(points.select(*PLACE, "v").dropDuplicates(PLACE), "points")
    at = [F.floor(F.col(c) / cell).alias(f"c{c}") for c in ("y", "x")]
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    weak = points.select("*", *at, near.alias("n")).select(DS, (F.col("cy") + F.col("n.a")).alias("cy"), (F.col("cx") + F.col("n.b")).alias("cx"), "y", "x", "v")
    strong = points.select(DS, *at, F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("v").alias("sv"))
    first, second = ties
    before = (F.col("sv") > F.col("v")) | ((F.col("sv") == F.col("v")) & ((F.col(f"s{first}") < F.col(first)) | ((F.col(f"s{first}") == F.col(first)) & (F.col(f"s{second}") < F.col(second)))))
    close = F.pow(F.col("sy") - F.col("y"), F.lit(2)) + F.pow(F.col("sx") - F.col("x"), F.lit(2)) < distance * distance
    pairs = materialize(weak.join(strong, [DS, "cy", "cx"]).where(before & close).select(*PLACE, "sy", "sx"), "point-pairs")
    left, kept = points, []
    while not left.isEmpty():
        stay = materialize(left.join(pairs.select(*PLACE), PLACE, "left_anti"), "points-kept")
        kept.append(stay)
        gone = pairs.join(stay.select(DS, F.col("y").alias("sy"), F.col("x").alias("sx")), [DS, "sy", "sx"], "left_semi").select(*PLACE).distinct()
        rest = materialize(left.join(stay.select(*PLACE).union(gone), PLACE, "left_anti"), "points")
        fewer = pairs.join(rest.select(*PLACE), PLACE, "left_semi").join(rest.select(DS, F.col("y").alias("sy"), F.col("x").alias("sx")), [DS, "sy", "sx"], "left_semi")
        fewer = materialize(fewer.select(*PLACE, "sy", "sx"), "point-pairs")
        drop_table(pairs)
        drop_table(left)
        left, pairs = rest, fewer
    out = left
    for k in kept:
        out = out.union(k)
    return out


def numbered(points: DataFrame, ties: tuple[str, str], most: int) -> DataFrame:
    """The `most` strongest points of each raster with their rank."""
    rank = F.row_number().over(W.partitionBy(DS).orderBy(F.desc("v"), *ties))
    return points.withColumn("rank", rank).where(F.col("rank") <= most)


def detect_columns(img: DataFrame, sigma: float = 2.0, threshold: float = 0.2, min_separation: float = 8.0, bright: bool = True, most: int = 20000) -> DataFrame:
    """Atom columns: maxima of the smoothed raster above a share of its range, apart: ds_id, y, x, v (smoothed), rank.

    Dark columns are those of the negated raster. Beyond a border its pixels go on. A constant raster has none.
    """
    work = img if bright else img.select(*PLACE, (-F.col("v")).alias("v"))
    smooth = materialize(gaussian(work, sigma, replicate=True), "smoothed")
    ends = smooth.groupBy(DS).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("hi > lo")
    found = local_maxima(smooth).join(ends, DS).where(F.col("v") >= F.col("lo") + threshold * (F.col("hi") - F.col("lo")))
    return numbered(separated(found, min_separation, ("x", "y")), ("x", "y"), most)


def find_spots(img: DataFrame, min_radius: float = 10.0, threshold: float = 0.05, min_separation: float = 8.0, most: int = 50, sigma: float = 1.5) -> DataFrame:
    """Diffraction spots: maxima of the smoothed raster above a share of its largest value, beyond min_radius of the beam, apart.

    ds_id, y, x, v (smoothed), rank. A raster without a positive value has none.
    """
    smooth = materialize(gaussian(img, sigma), "smoothed")
    ends = smooth.groupBy(DS).agg(F.max("v").alias("hi"), F.max("y").alias("h"), F.max("x").alias("w")).where("hi > 0")
    off = F.hypot(F.col("y") - F.floor(F.col("h") / 2) - 1, F.col("x") - F.floor(F.col("w") / 2) - 1)
    found = local_maxima(smooth).join(ends, DS).where((F.col("v") >= threshold * F.col("hi")) & (off >= min_radius))
    return numbered(separated(found, min_separation), ("y", "x"), most)


def ring_points(img: DataFrame, r_min: float = 5.0, r_max: float | None = None, n_angles: int = 180) -> DataFrame:
    """The strongest place of each ray from the beam, at whole steps from r_min to below r_max: ds_id, ray, y, x, radius.

    Without r_max, 0.95 of the distance to the nearest border; the nearest of equal pixels is taken.
    """
    s = shape(img).select(DS, F.floor(F.col("h") / 2).alias("cy"), F.floor(F.col("w") / 2).alias("cx"), "h", "w")
    far = F.lit(float(r_max)) if r_max is not None else 0.95 * F.least("cy", "cx", F.col("h") - 1 - F.col("cy"), F.col("w") - 1 - F.col("cx"))
    s = s.withColumn("steps", F.ceil(far - r_min)).where("steps > 0")
    s = s.select(DS, "cy", "cx", "steps", F.explode(F.sequence(F.lit(0), F.lit(n_angles - 1))).alias("ray"))
    s = s.select("*", F.explode(F.expr("sequence(0L, steps - 1)")).alias("step")).withColumn("radius", F.col("step") + r_min)
    turn = F.col("ray") * (2 * math.pi / n_angles)
    s = s.select(DS, "ray", "radius", (F.col("cy") + F.col("radius") * F.sin(turn)).alias("py"), (F.col("cx") + F.col("radius") * F.cos(turn)).alias("px"))
    s = s.select("*", (F.rint("py") + 1).cast("int").alias("y"), (F.rint("px") + 1).cast("int").alias("x"))
    best = s.join(img, PLACE).groupBy(DS, "ray").agg(F.max_by(F.struct("py", "px", "radius"), F.struct("v", -F.col("radius"))).alias("b"))
    return best.select(DS, "ray", (F.col("b.py") + 1).alias("y"), (F.col("b.px") + 1).alias("x"), "b.radius")


def undistorted(y: Column, x: Column, cy: float, cx: float, a: float, b: float, theta: float) -> Column:
    """The radius that a point of an elliptic ring (half axes a, b; a turned by theta) has on a circle of the same area."""
    dy, dx = y - cy, x - cx
    phi = F.atan2(dy, dx) - theta
    ring = F.try_divide(F.lit(a * b), F.hypot(b * F.cos(phi), a * F.sin(phi)))
    return F.hypot(dy, dx) * F.when(ring > 0, math.sqrt(a * b) / ring).otherwise(1.0)


def camera_constant(d: Column, radius: Column) -> Column:
    """Radius times distance of planes, from a ring of a known distance; null unless this is positive."""
    return F.when(d > 0, radius * d)


def colour_composite(maps: DataFrame, colours: DataFrame, add: bool = True, grey: DataFrame | None = None) -> DataFrame:
    """Maps (ds_id, y, x, symbol, v) over each other in colours (symbol, lo, hi, r, g, b): ds_id, y, x, r, g, b of 0 to 255.

    A map counts as far as its value lies in lo..hi, from 0 to 1 (without a range, as far as it is above lo); parts add up, or the largest of each channel counts.
    grey (ds_id, y, x, v of 0 to 255) lies below. colours has a row per map.
    """
    t = F.least(F.lit(1.0), (F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0))
    parts = maps.join(colours, "symbol").withColumn("t", t).where("t > 0").select(*PLACE, *[(F.col("t") * F.col(c)).alias(c) for c in "rgb"])
    base = maps.select(*PLACE).distinct().select(*PLACE, *[F.lit(0.0).alias(c) for c in "rgb"]) if grey is None else grey.select(*PLACE, *[F.col("v").cast("double").alias(c) for c in "rgb"])
    blend = F.sum if add else F.max
    return base.union(parts).groupBy(*PLACE).agg(*[F.rint(F.least(F.lit(255.0), F.greatest(F.lit(0.0), blend(c)))).alias(c) for c in "rgb"])
