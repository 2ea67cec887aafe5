"""Reductions of 4D scans (ds_id, sy, sx, ky, kx, v), all places from 0: virtual detectors, centres of mass, fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POSITION = ["ds_id", "sy", "sx"]


def aperture(cy: float, cx: float, inner: float, outer: float) -> Column:
    """Detector pixels from inner to outer radius, both included."""
    r2 = F.pow(F.col("ky") - cy, F.lit(2)) + F.pow(F.col("kx") - cx, F.lit(2))
    return (r2 >= inner * inner) & (r2 <= outer * outer)


def virtual_detector(scan: DataFrame, mask: Column) -> DataFrame:
    """Sum over the mask at each position; 0 where it has no pixel."""
    return scan.groupBy(*POSITION).agg(F.sum(F.when(mask, F.col("v")).otherwise(0.0)).alias("v"))


def nav_image(scan: DataFrame) -> DataFrame:
    return scan.groupBy(*POSITION).agg(F.sum("v").alias("v"))


def mean_pattern(scan: DataFrame) -> DataFrame:
    return scan.groupBy("ds_id", "ky", "kx").agg(F.avg("v").alias("v"))


def pattern_center(scan: DataFrame) -> DataFrame:
    """Centroid of the mean pattern."""
    m = mean_pattern(scan)
    return m.groupBy("ds_id").agg(F.try_divide(F.sum(F.col("ky") * F.col("v")), F.sum("v")).alias("cy"), F.try_divide(F.sum(F.col("kx") * F.col("v")), F.sum("v")).alias("cx"))


def com_shift(scan: DataFrame, cy: float, cx: float) -> DataFrame:
    """Centre of mass less the centre; 0 where a pattern has no counts."""
    total = F.sum("v")
    shift = lambda c, at: F.when(total > 0, F.try_divide(F.sum(F.col(c) * F.col("v")), total) - at).otherwise(0.0)
    return scan.groupBy(*POSITION).agg(shift("ky", cy).alias("dy"), shift("kx", cx).alias("dx"))


def dpc(shifts: DataFrame, mrad_per_px: float) -> DataFrame:
    """Field, its magnitude and direction, and its divergence by central differences (one-sided at the borders)."""
    f = shifts.withColumn("fy", F.col("dy") * mrad_per_px).withColumn("fx", F.col("dx") * mrad_per_px)

    def slope(c: str, axis: str, other: str) -> Column:
        w = W.partitionBy("ds_id", other).orderBy(axis)
        before, after, v = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
        one = F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)
        return F.coalesce(one, F.lit(0.0))

    return f.select(*POSITION, "fy", "fx", F.hypot("fy", "fx").alias("magnitude"), F.atan2("fy", "fx").alias("direction"), (slope("fy", "sy", "sx") + slope("fx", "sx", "sy")).alias("divergence"))


def radial_coverage(spark: SparkSession, height: int, width: int, cy: float, cx: float, n_bins: int = 0) -> DataFrame:
    """Detector pixels by ring, of rings of even width out to the farthest pixel: bin, radius (its middle), n; a row for every ring."""
    n_bins = n_bins if n_bins > 0 else max(1, min(height, width) // 2)
    far = max(math.hypot(y - cy, x - cx) for y in (0, height - 1) for x in (0, width - 1))
    step = far / n_bins if far > 0 else 0.0
    g = spark.range(height * width).select(F.expr(f"id div {width}").alias("ky"), (F.col("id") % width).alias("kx"))
    at = F.least(F.lit(n_bins - 1), F.floor(F.sqrt(F.pow(F.col("ky") - cy, F.lit(2)) + F.pow(F.col("kx") - cx, F.lit(2))) / step)) if step else F.lit(0)
    n = g.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    rings = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return rings.join(n, "bin", "left").select("bin", ((F.col("bin") + 0.5) * step).alias("radius"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def coverage_of(scan: DataFrame, n_bins: int = 0) -> DataFrame:
    """radial_coverage() of a scan's detector around the centre of mass of all its patterns; a scan without counts takes the middle."""
    s = scan.agg((F.max("ky") + 1).alias("h"), (F.max("kx") + 1).alias("w"), F.try_divide(F.sum(F.col("ky") * F.col("v")), F.sum("v")).alias("cy"), F.try_divide(F.sum(F.col("kx") * F.col("v")), F.sum("v")).alias("cx")).first()
    h, w = s["h"] or 1, s["w"] or 1
    return radial_coverage(scan.sparkSession, h, w, (h - 1) / 2 if s["cy"] is None else s["cy"], (w - 1) / 2 if s["cx"] is None else s["cx"], n_bins)


def shapes_of(scan: DataFrame, limit: int = 12) -> DataFrame:
    """scan_shapes() of the number of a scan's patterns."""
    return scan_shapes(scan.sparkSession, scan.select("sy", "sx").distinct().count(), limit)


def scan_shapes(spark: SparkSession, n_frames: int, limit: int = 12) -> DataFrame:
    """At most limit factor pairs of a number of frames, squarest first, the taller of two before the wider.

    A scan of one line is always among them: beyond the limit it takes the last place. No frames, no rows.
    """
    r = spark.range(1, max(1, math.isqrt(max(0, n_frames)) + 1)).where(n_frames % F.col("id") == 0).select(F.col("id").alias("a"), F.expr(f"{n_frames} div id").alias("b"))
    both = r.select(F.col("b").alias("rows"), F.col("a").alias("cols")).union(r.where("a <> b"))
    rank = F.row_number().over(W.orderBy(F.greatest("rows", "cols"), F.desc("rows")))  # few: the divisors of one number
    ranked = both.withColumn("rank", rank)
    if limit <= 0:
        return ranked
    line = (F.col("rows") == 1) & (F.col("cols") == n_frames)
    place = F.when(line, F.least("rank", F.lit(limit))).otherwise(F.col("rank"))
    crowded = F.max(F.when(line, F.col("rank"))).over(W.partitionBy()) > limit
    return ranked.withColumn("_crowded", crowded).where((place < limit) | (place == limit) & (line | ~F.col("_crowded"))).select("rows", "cols", place.alias("rank"))
