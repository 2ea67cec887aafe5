"""Operators on labelled rasters (ds_id, y, x, label; 0 is background), outlines and layers: sizes, shapes, boundaries.

Labels come with the data; a region is one group of an aggregate, so any number of rasters is measured at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.quantiles import quantiles
from lumenframe.operators.raster import DS, above

# Millimetres of a unit of length.
MM = {"nm": 1e-6, "um": 1e-3, "µm": 1e-3, "mm": 1.0, "m": 1e3, "å": 1e-7, "a": 1e-7, "angstrom": 1e-7, "cm": 10.0, "pm": 1e-9}


def region_stats(labels: DataFrame, img: DataFrame, min_area: int = 1, pixel_size: float | None = None) -> DataFrame:
    """Regions of min_area pixels or more, numbered from 1 by label: area, centroid, box, diameter of the equal disk, mean.

    Without a pixel size the calibrated columns are null. Pixels that img lacks count for the area, not for the mean.
    """
    px = labels.where("label > 0").join(img, [DS, "y", "x"], "left")
    g = px.groupBy(DS, "label").agg(F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"), F.avg("v").alias("mean"))
    number = F.row_number().over(W.partitionBy(DS).orderBy("label"))
    size = F.lit(pixel_size).cast("double")
    g = g.where(F.col("area") >= min_area).withColumn("diameter", F.sqrt(4 * F.col("area") / math.pi))
    return g.select(DS, number.alias("id"), *[c for c in g.columns if c != DS], (F.col("area") * size * size).alias("area_cal"), (F.col("diameter") * size).alias("diameter_cal"))


def renumber(labels: DataFrame, stats: DataFrame) -> DataFrame:
    """The label map by the numbers of region_stats(); regions that it left out become background."""
    return labels.join(stats.select(DS, "label", "id"), [DS, "label"], "left").select(DS, "y", "x", F.coalesce("id", F.lit(0)).alias("label"))


def particles(img: DataFrame, labels: DataFrame, threshold: float, bright: bool = True, min_area: int = 1) -> DataFrame:
    """region_stats() of the labelled pixels at or above a threshold (below it for dark particles)."""
    inside = F.col("v") >= threshold if bright else F.col("v") < threshold
    return region_stats(labels.join(img.where(inside).select(DS, "y", "x"), [DS, "y", "x"], "left_semi"), img, min_area)


def boundary_network(labels: DataFrame, pixel_size: float | None = None) -> DataFrame:
    """Per raster: edges between pixels of unlike regions, pixels at such edges, and 2 x 2 windows where three regions meet."""
    row, col = W.partitionBy(DS, "y").orderBy("x"), W.partitionBy(DS, "x").orderBy("y")
    t = labels.select(DS, "y", "x", "label", F.lead("label").over(row).alias("right"), F.lag("label").over(row).alias("left"))
    t = t.select("*", F.lead("label").over(col).alias("down"), F.lag("label").over(col).alias("up"), F.lead("right").over(col).alias("corner"))
    unlike = lambda c: (F.col("label") > 0) & (F.col(c) > 0) & (F.col("label") != F.col(c))
    edges = F.sum(unlike("right").cast("int")) + F.sum(unlike("down").cast("int"))
    touches = F.coalesce(unlike("right"), F.lit(False)) | F.coalesce(unlike("left"), F.lit(False)) | F.coalesce(unlike("down"), F.lit(False)) | F.coalesce(unlike("up"), F.lit(False))
    meet = F.size(F.array_distinct(F.filter(F.array("label", "right", "down", "corner"), lambda c: c > 0))) >= 3
    n = F.coalesce(edges, F.lit(0))
    return t.groupBy(DS).agg(n.alias("network"), F.sum(touches.cast("int")).alias("boundary"), F.sum(meet.cast("int")).alias("junctions"), (n * F.lit(pixel_size).cast("double")).alias("network_cal"))


def astm_number(diameter: Column, unit: Column) -> Column:
    """The grain size number of a mean diameter; null for an unknown unit or a size that isn't positive."""
    mm = F.create_map(*[F.lit(x) for kv in MM.items() for x in kv])[F.lower(F.trim(unit))]
    return F.when(diameter > 0, -6.6439 * F.log2(diameter * mm) - 3.298)


def snapped(a: str, b: str) -> Column:
    """The covariance c, 0 where it is rounding error beside the variances a and b."""
    return F.when(F.abs("c") < 1e-9 * (F.col(a) + F.col(b)), 0.0).otherwise(F.col("c"))


def shape_moments(labels: DataFrame) -> DataFrame:
    """Ellipse of equal second moments per region: area, major and minor axis, eccentricity, orientation, aspect.

    Orientation is the angle from the row axis to the major one in radians; a minor axis of 0 has no aspect.
    """
    g = labels.where("label > 0").groupBy(DS, "label").agg(F.count("*").alias("area"), F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("c"))
    g = g.withColumn("c", snapped("vy", "vx"))
    mean, half = (F.col("vy") + F.col("vx")) / 2, F.sqrt(F.pow((F.col("vy") - F.col("vx")) / 2, F.lit(2)) + F.col("c") * F.col("c"))
    small = F.greatest(F.lit(0.0), mean - half)
    g = g.select("*", (4 * F.sqrt(mean + half)).alias("major"), (4 * F.sqrt(small)).alias("minor"))
    round_ = F.abs(F.col("vy") - F.col("vx")) < 1e-12
    turn = F.when(round_, F.when(F.col("c") > 0, math.pi / 4).otherwise(-math.pi / 4)).otherwise(F.atan2(2 * F.col("c"), F.col("vy") - F.col("vx")) / 2)
    flat = F.coalesce(F.try_divide(F.col("minor"), F.col("major")), F.lit(1.0))
    return g.select(DS, "label", "area", "major", "minor", F.sqrt(F.greatest(F.lit(0.0), 1 - flat * flat)).alias("eccentricity"), turn.alias("orientation"), F.when(F.col("minor") > 1e-9, F.col("major") / F.col("minor")).alias("aspect"))


def shape_class(aspect: Column, circularity: Column, solidity: Column, aggregate: float = 0.85, rod: float = 2.5, sphere: float = 1.3, round_: float = 0.92) -> Column:
    """aggregate (of low solidity), rod-like, sphere-like or intermediate, the first that holds; no aspect is intermediate."""
    return F.when(solidity < aggregate, "aggregate").when(aspect >= rod, "rod-like").when((aspect < sphere) & (circularity > round_), "sphere-like").otherwise("intermediate")


def layer_slices(labels: DataFrame, layers: DataFrame, axis: str = "y", pixel_size: float = 1.0) -> DataFrame:
    """Grains clipped to layers: ds_id, layer, label, area, width, height, aspect, angle, centre and share of the grain.

    layers: ds_id, layer, top, bottom in pixels from 0 along the axis, bottom excluded. Width runs along a layer; the angle
    (degrees) is that of the longest axis to it.
    """
    depth, lateral = (F.col("y") - 1, F.col("x") - 1) if axis == "y" else (F.col("x") - 1, F.col("y") - 1)
    px = labels.where("label > 0").select(DS, "label", depth.alias("d"), lateral.alias("l"))
    whole = px.groupBy(DS, "label").agg(F.count("*").alias("whole"))
    g = px.join(layers, DS).where("d >= top AND d < bottom").groupBy(DS, "layer", "label")
    g = g.agg(F.count("*").alias("area"), (F.max("l") - F.min("l") + 1).alias("w"), (F.max("d") - F.min("d") + 1).alias("h"), F.avg("l").alias("centre_l"), F.avg("d").alias("centre_d"), F.var_pop("l").alias("vl"), F.var_pop("d").alias("vd"), F.covar_pop("l", "d").alias("c"))
    g = g.withColumn("c", snapped("vl", "vd"))
    angle = F.abs(F.degrees(F.atan2(2 * F.col("c"), F.col("vl") - F.col("vd")) / 2))
    return g.join(whole, [DS, "label"]).select(DS, "layer", "label", "area", (F.col("w") * pixel_size).alias("width"), (F.col("h") * pixel_size).alias("height"), (F.col("w") / F.col("h")).alias("aspect"), F.when((F.col("c") == 0) & (F.col("vl") == F.col("vd")), 0.0).otherwise(angle).alias("angle"), "centre_l", "centre_d", (F.col("area") / F.col("whole")).alias("share"))


def layer_summary(labels: DataFrame, layers: DataFrame, axis: str = "y", pixel_size: float = 1.0) -> DataFrame:
    """Per layer: pixels, grains, density per pixel, occupied share, mean width, height, aspect and angle, grains that cross."""
    depth = F.col("y") - 1 if axis == "y" else F.col("x") - 1
    size = labels.select(DS, depth.alias("d")).join(layers, DS).where("d >= top AND d < bottom").groupBy(DS, "layer").agg(F.count("*").alias("pixels"))
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    s = layer_slices(labels, layers, axis, pixel_size).groupBy(DS, "layer").agg(F.count("*").alias("grains"), F.sum("area").alias("area"), mean("width"), mean("height"), mean("aspect"), mean("angle"), F.sum((F.col("share") < 0.999).cast("int")).alias("crossing"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = layers.join(size, [DS, "layer"], "left").join(s, [DS, "layer"], "left")
    return out.select(DS, "layer", ((F.col("bottom") - F.col("top")) * pixel_size).alias("thickness"), zero("pixels"), zero("grains"), F.coalesce(F.try_divide(F.col("grains"), F.col("pixels")), F.lit(0.0)).alias("density"), F.coalesce(F.try_divide(F.col("area"), F.col("pixels")), F.lit(0.0)).alias("occupied"), *[zero(c) for c in ("mean_width", "mean_height", "mean_aspect", "mean_angle", "crossing")])


def depth_profile(img: DataFrame, axis: str = "y", reduce: str = "mean") -> DataFrame:
    """A raster collapsed along its layers: ds_id, i (from 0), v by mean, sum or median."""
    agg = {"mean": F.avg, "sum": F.sum, "median": F.median}[reduce]
    return img.groupBy(DS, (F.col(axis) - 1).alias("i")).agg(agg("v").alias("v"))


def layers_between(found: DataFrame) -> DataFrame:
    """Layers from one interface to the next: ds_id, layer (from 0), top, bottom, thickness."""
    w = W.partitionBy(DS).orderBy("i")
    t = found.select(DS, (F.row_number().over(w) - 1).alias("layer"), F.col("i").cast("double").alias("top"), F.lead("i").over(w).cast("double").alias("bottom"))
    return t.where("bottom is not null").withColumn("thickness", F.col("bottom") - F.col("top"))


def robust_sigma(values: DataFrame, *keys: str) -> DataFrame:
    """1.4826 times the median distance from the median of v, per key."""
    mid = quantiles(values, list(keys), [0.5]).select(*keys, F.col("q")[0].alias("_m"))
    far = values.join(mid, list(keys)).select(*keys, F.abs(F.col("v") - F.col("_m")).alias("v"))
    return quantiles(far, list(keys), [0.5]).select(*keys, (1.4826 * F.col("q")[0]).alias("sigma"))


def conformality(a: DataFrame, b: DataFrame, least: int = 16) -> DataFrame:
    """Correlation of two traces (ds_id, x, depth) over the columns that both have, null for fewer than `least`."""
    both = a.join(b.withColumnRenamed("depth", "other"), [DS, "x"])
    return both.groupBy(DS).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.corr("depth", "other")).alias("r"))


def circle_fit(points: DataFrame) -> DataFrame:
    """Least squares circle of the points (ring, x, y) of each ring: cx, cy, radius, rms of the radii.

    Kasa's linear form about the centroid, from moments in one aggregate; points on a line give nulls.
    """
    mid = points.groupBy("ring").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
    p = points.join(mid, "ring").withColumn("u", F.col("x") - F.col("mx")).withColumn("w", F.col("y") - F.col("my"))
    q = F.col("u") * F.col("u") + F.col("w") * F.col("w")
    m = p.groupBy("ring", "mx", "my", "n").agg(F.avg(F.col("u") * F.col("u")).alias("uu"), F.avg(F.col("w") * F.col("w")).alias("ww"), F.avg(F.col("u") * F.col("w")).alias("uw"), F.avg(F.col("u") * q).alias("uq"), F.avg(F.col("w") * q).alias("wq"))
    det = F.expr("2 * (uu * ww - uw * uw)")
    good = F.expr("uu * ww - uw * uw > 1e-9 * (uu + ww) * (uu + ww)")
    m = m.withColumn("a", F.when(good, F.try_divide(F.expr("uq * ww - wq * uw"), det))).withColumn("b", F.when(good, F.try_divide(F.expr("wq * uu - uq * uw"), det)))
    c = m.select("ring", "n", (F.col("mx") + F.col("a")).alias("cx"), (F.col("my") + F.col("b")).alias("cy"), F.sqrt(F.expr("a * a + b * b + uu + ww")).alias("radius"))
    far = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("radius")
    return points.join(c, "ring").groupBy("ring", "n", "cx", "cy", "radius").agg(F.sqrt(F.avg(far * far)).alias("rms"))


#: Vertices of rings that one task holds.
VERTICES = 500_000


def ring_steps(vertices: DataFrame) -> DataFrame:
    """Closed rings (ring, i, x, y) as steps from one vertex to the next, the last one back to the first: adds x2, y2, at.

    Rings are dealt to tasks of about VERTICES each, so what a task holds doesn't grow with the table.
    """
    vertices = vertices.repartition(1 + vertices.count() // VERTICES, "ring")
    w = W.partitionBy("ring").orderBy("i")
    first = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    to = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    return vertices.select("*", to("x").alias("x2"), to("y").alias("y2"))


def polygon_stats(vertices: DataFrame) -> DataFrame:
    """Area, perimeter and centroid of each ring; the mean of its vertices where the area is 0."""
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    s = ring_steps(vertices).groupBy("ring").agg((F.sum(cross) / 2).alias("s"), F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("perimeter"), F.sum((F.col("x") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y") + F.col("y2")) * cross).alias("sy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    mid = lambda c, m: F.when(F.abs("s") < 1e-12, F.col(m)).otherwise(F.try_divide(F.col(c), 6 * F.col("s")))
    return s.select("ring", F.abs("s").alias("area"), "perimeter", mid("sx", "mx").alias("cx"), mid("sy", "my").alias("cy"))


def outline_harmonics(vertices: DataFrame, harmonics: int = 4) -> DataFrame:
    """Elliptic Fourier coefficients a, b (of x), c, d (of y) of each ring: ring, n from 1. Rings without length have no row."""
    w = W.partitionBy("ring").orderBy("i")
    s = ring_steps(vertices).withColumn("step", F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).where("step > 0")
    s = s.withColumn("t2", F.sum("step").over(w)).withColumn("all", F.sum("step").over(W.partitionBy("ring")))
    s = s.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(harmonics))))
    turn = lambda t: 2 * math.pi * F.col("n") * t / F.col("all")
    t1, t2 = turn(F.col("t2") - F.col("step")), turn(F.col("t2"))
    scale = F.col("all") / (2 * math.pi**2 * F.col("n") * F.col("n"))
    part = lambda to, frm, f: F.sum(scale * (F.col(to) - F.col(frm)) / F.col("step") * (f(t2) - f(t1)))
    return s.groupBy("ring", "n").agg(part("x2", "x", F.cos).alias("a"), part("x2", "x", F.sin).alias("b"), part("y2", "y", F.cos).alias("c"), part("y2", "y", F.sin).alias("d"))


def distances(segments: DataFrame, tilt: float = 0.0, tilt_axis: str = "y", surface: bool = False, pixel_size: float = 1.0) -> DataFrame:
    """Lengths of segments (x1, y1, x2, y2): adds raw and corrected, the tilted axis stretched by 1 / sin (a cross-section) or 1 / cos (a surface)."""
    if not -90 < tilt < 90:
        raise ValueError("tilt must be between -90 and 90 degrees")
    k = 1.0 if tilt == 0 else 1 / (math.cos if surface else math.sin)(math.radians(tilt))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    far = F.hypot(dx, dy * k) if tilt_axis == "y" else F.hypot(dx * k, dy)
    return segments.select("*", (F.hypot(dx, dy) * pixel_size).alias("raw"), (far * pixel_size).alias("corrected"))


def normalized_harmonics(coefficients: DataFrame) -> DataFrame:
    """outline_harmonics() that turn, shift and size of a ring don't change: ring, n, a, b, c, d.

    The start moves to the end of the first ellipse's long axis, that axis turns to x, and its half length becomes 1. Rings
    whose first ellipse has no size have no row.
    """
    first = coefficients.where("n = 1").select("ring", *[F.col(c).alias(f"{c}1") for c in "abcd"])
    first = first.where("a1 <> 0 OR b1 <> 0 OR c1 <> 0 OR d1 <> 0")
    turn = F.atan2(F.expr("2 * (a1 * b1 + c1 * d1)"), F.expr("a1 * a1 - b1 * b1 + c1 * c1 - d1 * d1")) / 2
    first = first.withColumn("t", turn)
    first = first.withColumn("p", F.col("a1") * F.cos("t") + F.col("b1") * F.sin("t")).withColumn("q", F.col("c1") * F.cos("t") + F.col("d1") * F.sin("t"))
    first = first.select("ring", "t", F.atan2("q", "p").alias("s"), F.hypot("p", "q").alias("size")).where("size > 0")
    x = coefficients.join(first, "ring")
    ct, st = F.cos(F.col("n") * F.col("t")), F.sin(F.col("n") * F.col("t"))
    x = x.select("ring", "n", "s", "size", (F.col("a") * ct + F.col("b") * st).alias("a"), (F.col("b") * ct - F.col("a") * st).alias("b"), (F.col("c") * ct + F.col("d") * st).alias("c"), (F.col("d") * ct - F.col("c") * st).alias("d"))
    cs, ss = F.cos("s") / F.col("size"), F.sin("s") / F.col("size")
    return x.select("ring", "n", (cs * F.col("a") + ss * F.col("c")).alias("a"), (cs * F.col("b") + ss * F.col("d")).alias("b"), (cs * F.col("c") - ss * F.col("a")).alias("c"), (cs * F.col("d") - ss * F.col("b")).alias("d"))


def harmonic_distance(one: DataFrame, other: DataFrame) -> DataFrame:
    """Distance of the normalized_harmonics() of every ring from those of one other shape (n, a, b, c, d): ring, distance."""
    far = sum((F.pow(F.col(c) - F.col(f"{c}2"), F.lit(2)) for c in "abcd"), F.lit(0.0))
    t = one.join(F.broadcast(other.select("n", *[F.col(c).alias(f"{c}2") for c in "abcd"])), "n")
    return t.groupBy("ring").agg(F.sqrt(F.sum(far)).alias("distance"))


def ellipse_fit(points: DataFrame) -> DataFrame:
    """Least squares ellipse of the points (ring, x, y) of each ring: ring, n, cx, cy, a, b (half axes, the longer first), angle (from +x to +y).

    The conic under 4 A C - B^2 = 1 comes from sums over the points, so only a few numbers of each ring are solved for.
    Rings of fewer than five points or without an ellipse have no row.
    """
    mid = points.groupBy("ring").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n")).where("n >= 5")
    t = points.join(mid, "ring").select("ring", "mx", "my", "n", (F.col("x") - F.col("mx")).alias("u"), (F.col("y") - F.col("my")).alias("w"))
    powers = [(i, j) for i in range(5) for j in range(5 - i)]
    s = t.groupBy("ring", "mx", "my", "n").agg(*[F.sum(F.pow("u", F.lit(i)) * F.pow("w", F.lit(j))).alias(f"s{i}{j}") for i, j in powers])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0)]
        for b in batches:
            at = {p: b.column(f"s{p[0]}{p[1]}").to_numpy() for p in powers}
            out = []
            for k in range(b.num_rows):
                g = np.array([[at[p[0] + q[0], p[1] + q[1]][k] for q in terms] for p in terms])
                try:
                    back = -np.linalg.solve(g[3:, 3:], g[3:, :3])
                except np.linalg.LinAlgError:
                    out.append(None)
                    continue
                m = g[:3, :3] + g[:3, 3:] @ back
                values, vectors = np.linalg.eig(np.stack([m[2] / 2, -m[1], m[0] / 2]))
                vectors = vectors.real
                good = np.flatnonzero(4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 0)
                if not len(good):
                    out.append(None)
                    continue
                quad = vectors[:, good[0]]
                line = back @ quad
                a2 = np.array([[quad[0], quad[1] / 2], [quad[1] / 2, quad[2]]])
                c = np.linalg.solve(a2, -line[:2] / 2)
                level = c @ a2 @ c + line[:2] @ c + line[2]
                mu, axes = np.linalg.eigh(a2)
                half = -level / mu
                if (half <= 0).any():
                    out.append(None)
                    continue
                half = np.sqrt(half)
                i = int(half.argmax())
                angle = math.atan2(axes[1, i], axes[0, i])
                angle = angle - math.pi if angle > math.pi / 2 else angle + math.pi if angle <= -math.pi / 2 else angle
                out.append((c[0] + b.column("mx")[k].as_py(), c[1] + b.column("my")[k].as_py(), float(half[i]), float(half[1 - i]), angle))
            ok = pa.array([o is not None for o in out])
            cols = [pa.array([float(o[i]) for o in out if o is not None], pa.float64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column("ring").filter(ok), b.column("n").filter(ok), *cols], names=["ring", "n", "cx", "cy", "a", "b", "angle"])

    kind = points.schema["ring"].dataType.simpleString()
    return s.mapInArrow(solve, f"ring {kind}, n long, cx double, cy double, a double, b double, angle double")
