"""Operators on rasters (ds_id, y, x, v): filters, geometry, levelling, normalisation, histograms.

All work on many rasters at once, keyed by ds_id; a raster has a pixel at every place of its grid. Separable stencils
slide windows along columns, then along rows, so pixels shuffle once per axis and a task holds one line of a raster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.quantiles import quantiles

DS = "ds_id"


def shape(img: DataFrame) -> DataFrame:
    """Height and width of each raster; a row per raster."""
    return img.groupBy(DS).agg(F.max("y").alias("h"), F.max("x").alias("w"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def gaussian_kernel(sigma: float) -> list[float]:
    r = math.ceil(3 * sigma)
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [v / sum(k) for v in k]


AXES = (("y", "x"), ("x", "y"))


def gaussian(img: DataFrame, sigma: float = 1.0, replicate: bool = False) -> DataFrame:
    """Separable blur, half-width ceil(3 sigma); places beyond the border count as 0, or with replicate as the nearest pixel."""
    k = gaussian_kernel(sigma)
    r = len(k) // 2
    for axis, other in AXES:
        w = W.partitionBy(DS, other).orderBy(axis)
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        ends = {True: F.first("v").over(whole), False: F.last("v").over(whole)} if replicate else {True: F.lit(0.0), False: F.lit(0.0)}
        taps = [F.lit(c) * F.coalesce(F.lag("v", i - r).over(w), ends[i > r]) for i, c in enumerate(k)]
        img = img.select(DS, "y", "x", sum(taps[1:], taps[0]).alias("v"))
    return img


def neighbourhood(img: DataFrame, radius: int, square: bool = True, replicate: bool = True) -> DataFrame:
    """(ds_id, y, x, n) with one row for each pixel n in the window of (y, x); replicate clamps places at the borders."""
    offs = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if square or dy * dy + dx * dx <= radius * radius]
    at = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offs])
    target = img.join(shape(img), DS).select(DS, "y", "x", "h", "w", F.explode(at).alias("o"))
    yy, xx = F.col("y") + F.col("o.dy"), F.col("x") + F.col("o.dx")
    if replicate:
        target = target.select(DS, "y", "x", F.greatest(F.lit(1), F.least(F.col("h"), yy)).alias("yy"), F.greatest(F.lit(1), F.least(F.col("w"), xx)).alias("xx"))
    else:
        target = target.where((yy >= 1) & (yy <= F.col("h")) & (xx >= 1) & (xx <= F.col("w"))).select(DS, "y", "x", yy.alias("yy"), xx.alias("xx"))
    source = img.select(DS, F.col("y").alias("yy"), F.col("x").alias("xx"), F.col("v").alias("n"))
    return target.join(source, [DS, "yy", "xx"]).select(DS, "y", "x", "n")


def median(img: DataFrame, window_size: int = 3) -> DataFrame:
    """Median of the square window; places beyond the border count as the nearest pixel."""
    if window_size not in (3, 5, 7):
        raise ValueError("window_size must be 3, 5 or 7")
    r = window_size // 2
    for axis, other in AXES:
        w = W.partitionBy(DS, other).orderBy(axis)
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        ends = {True: F.first("v").over(whole), False: F.last("v").over(whole)}
        taps = [F.coalesce(F.lag("v", o).over(w), ends[o > 0]) if o else F.col("v") for o in range(-r, r + 1)]
        img = img.select(DS, "y", "x", F.array(*taps).alias("v"))
    return img.select(DS, "y", "x", F.element_at(F.array_sort(F.flatten("v")), window_size**2 // 2 + 1).alias("v"))


def unsharp(img: DataFrame, sigma: float = 2.0, amount: float = 1.0) -> DataFrame:
    blur = gaussian(img, sigma).withColumnRenamed("v", "b")
    return img.join(blur, [DS, "y", "x"]).select(DS, "y", "x", (F.col("v") + amount * (F.col("v") - F.col("b"))).alias("v"))


def bin_image(img: DataFrame, bin_size: int = 2, mode: str = "average") -> DataFrame:
    """Blocks of bin_size x bin_size; a remainder of rows or columns is cut off."""
    agg = {"average": F.avg, "sum": F.sum}[mode]
    whole = img.join(shape(img), DS).where((F.col("y") <= F.expr(f"h div {bin_size} * {bin_size}")) & (F.col("x") <= F.expr(f"w div {bin_size} * {bin_size}")))
    at = [(F.expr(f"({c} - 1) div {bin_size}") + 1).cast("int").alias(c) for c in ("y", "x")]
    return whole.groupBy(DS, *at).agg(agg("v").alias("v"))


def area_downsample(img: DataFrame, target_h: int, target_w: int) -> DataFrame:
    """Means of the pixels that fall on each target pixel."""
    s = img.join(shape(img), DS)
    at = [F.least(F.lit(t), F.ceil(F.col(c) * F.lit(float(t)) / F.col(n))).cast("int").alias(c) for c, t, n in (("y", target_h, "h"), ("x", target_w, "w"))]
    return s.groupBy(DS, *at).agg(F.avg("v").alias("v"))


def rotate(img: DataFrame, quarters: int) -> DataFrame:
    """Clockwise turns by 90 degrees."""
    y, x, h, w = (F.col(c) for c in ("y", "x", "h", "w"))
    at = {0: (y, x), 1: (x, h + 1 - y), 2: (h + 1 - y, w + 1 - x), 3: (w + 1 - x, y)}[quarters % 4]
    return img.join(shape(img), DS).select(DS, at[0].cast("int").alias("y"), at[1].cast("int").alias("x"), "v")


def flip(img: DataFrame, horizontal: bool) -> DataFrame:
    s = img.join(shape(img), DS)
    return s.select(DS, "y", (F.col("w") + 1 - F.col("x")).alias("x"), "v") if horizontal else s.select(DS, (F.col("h") + 1 - F.col("y")).alias("y"), "x", "v")


def plane_level(img: DataFrame) -> DataFrame:
    """Subtract the least-squares plane, from moments in one aggregate per raster."""
    cov = lambda a, b: F.covar_pop(a, b)
    m = img.groupBy(DS).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("v").alias("mv"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), cov("x", "y").alias("sxy"), cov("x", "v").alias("sxv"), cov("y", "v").alias("syv"))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    m = m.select(DS, "mx", "my", "mv", F.try_divide(F.expr("sxv * syy - syv * sxy"), det).alias("bx"), F.try_divide(F.expr("syv * sxx - sxv * sxy"), det).alias("by"))
    fit = F.col("mv") + F.coalesce("bx", F.lit(0.0)) * (F.col("x") - F.col("mx")) + F.coalesce("by", F.lit(0.0)) * (F.col("y") - F.col("my"))
    return img.join(m, DS).select(DS, "y", "x", (F.col("v") - fit).alias("v"))


def quadratic_level(img: DataFrame) -> DataFrame:
    """Subtract the least-squares paraboloid of whole rasters (a pixel at every place, all finite).

    On such a grid 1, x, y, x^2, y^2 (less their means) and xy about the centre are orthogonal, so each coefficient is
    a ratio of two sums, and all come from one aggregate. An axis of one or two pixels has no curvature.
    """
    mid = img.groupBy(DS).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("sx"), F.var_pop("y").alias("sy"))
    t = img.join(mid, DS).withColumn("u", F.col("x") - F.col("mx")).withColumn("w", F.col("y") - F.col("my"))
    t = t.select(DS, "y", "x", "v", "u", "w", F.expr("u * u - sx").alias("uu"), F.expr("w * w - sy").alias("ww"), F.expr("u * w").alias("uw"))
    forms = ("u", "w", "uu", "ww", "uw")
    part = lambda f: F.coalesce(F.when(F.sum(F.col(f) * F.col(f)) > 1e-9, F.sum(F.col(f) * F.col("v")) / F.sum(F.col(f) * F.col(f))), F.lit(0.0)).alias(f"k_{f}")
    fit = t.groupBy(DS).agg(F.avg("v").alias("k_1"), *[part(f) for f in forms])
    plane = sum((F.col(f"k_{f}") * F.col(f) for f in forms), F.col("k_1"))
    return t.join(fit, DS).select(DS, "y", "x", (F.col("v") - plane).alias("v"))


def crop(img: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """The rectangle of two corners in any order, ends included, places counted from 1 again."""
    y0, x0 = min(r1, r2), min(c1, c2)
    box = F.col("y").between(y0, max(r1, r2)) & F.col("x").between(x0, max(c1, c2))
    return img.where(box).select(DS, (F.col("y") - (max(y0, 1) - 1)).alias("y"), (F.col("x") - (max(x0, 1) - 1)).alias("x"), "v")


def turn(img: DataFrame, degrees: float) -> DataFrame:
    """Turn counter-clockwise about the centre by any angle, bilinear, in the same frame; beyond a border its pixels go on."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    t = img.join(shape(img), DS)
    dy, dx = F.col("y") - (F.col("h") + 1) / 2, F.col("x") - (F.col("w") + 1) / 2
    clamp = lambda v, n: F.greatest(F.lit(1.0), F.least(F.col(n).cast("double"), v))
    t = t.select(DS, "y", "x", "h", "w", clamp(F.round(c * dy + s * dx + (F.col("h") + 1) / 2, 9), "h").alias("sy"), clamp(F.round(c * dx - s * dy + (F.col("w") + 1) / 2, 9), "w").alias("sx"))
    fy, fx = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
    taps = [F.struct((F.floor("sy") + a).cast("int").alias("yy"), (F.floor("sx") + b).cast("int").alias("xx"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("k")) for a in (0, 1) for b in (0, 1)]
    t = t.select(DS, "y", "x", F.inline(F.array(*taps))).where("k > 0")
    src = img.select(DS, F.col("y").alias("yy"), F.col("x").alias("xx"), "v")
    return t.join(src, [DS, "yy", "xx"]).groupBy(DS, "y", "x").agg(F.sum(F.col("k") * F.col("v")).alias("v"))


def strip_bar(img: DataFrame, content_rows: int) -> DataFrame:
    """Without the rows below the content."""
    return img.where(F.col("y") <= content_rows)


def explode_cube(cube: DataFrame, most: int = 256) -> DataFrame:
    """The channels of a cube as rasters ds_id#channel; more channels than `most` raise, as this many are shown at once."""
    n = cube.agg(F.max("ch").alias("n")).first()["n"]
    if n is not None and n >= most:
        raise ValueError(f"{n + 1} frames are more than {most}")
    return cube.select(F.concat(DS, F.lit("#"), "ch").alias(DS), "y", "x", "v")


def above(img: DataFrame, factor: float = 1.0) -> DataFrame:
    """1 where a pixel is above factor times its raster's mean, else 0."""
    mean = img.groupBy(DS).agg(F.avg("v").alias("_m"))
    return img.join(mean, DS).select(DS, "y", "x", (F.col("v") > factor * F.col("_m")).cast("double").alias("v"))


def above_mean(img: DataFrame) -> DataFrame:
    return above(img)


def morph(img: DataFrame, operation: str = "open", radius: int = 1, square: bool = True) -> DataFrame:
    """Binary morphology of v > 0 with a square or a disk; what lies outside the raster is not set, so borders erode."""
    img = img.select(DS, "y", "x", (F.col("v") > 0).cast("double").alias("v"))
    for erode in {"erode": [True], "dilate": [False], "open": [True, False], "close": [False, True]}[operation]:
        if square:
            for axis, other in AXES:
                n = F.sum("v").over(W.partitionBy(DS, other).orderBy(axis).rowsBetween(-radius, radius))
                img = img.select(DS, "y", "x", (n == 2 * radius + 1 if erode else n > 0).cast("double").alias("v"))
        else:
            size = sum(a * a + b * b <= radius * radius for a in range(-radius, radius + 1) for b in range(-radius, radius + 1))
            n = F.sum("n")
            img = neighbourhood(img, radius, False, replicate=False).groupBy(DS, "y", "x").agg((n == size if erode else n > 0).cast("double").alias("v"))
    return img


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be broadcast if it has at most so many rows; else as it is, and Catalyst chooses."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def sanitize(img: DataFrame) -> DataFrame:
    """Pixels that aren't finite become the median of the finite ones of their raster (0 without any)."""
    fill = quantiles(img.where(finite(F.col("v"))), [DS], [0.5]).select(DS, F.col("q")[0].alias("_f"))
    return img.join(fill, DS, "left").select(DS, "y", "x", F.when(finite(F.col("v")), F.col("v")).otherwise(F.coalesce("_f", F.lit(0.0))).alias("v"))


def normalize01(img: DataFrame, clip_percentile: float = 0.0) -> DataFrame:
    """Stretch to 0..1 by the extremes, or by percentiles with clipping; a constant raster becomes 0. Pixels that aren't
    finite count as the median."""
    p = clip_percentile / 100
    img = sanitize(img)
    ends = img.groupBy(DS).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    ends = ends.join(quantiles(img, [DS], [p, 1 - p]).withColumnRenamed("q", "p"), DS) if p else ends.withColumn("p", F.array("a", "b"))
    flat = F.col("p")[1] <= F.col("p")[0]
    ends = ends.select(DS, F.when(flat, F.col("a")).otherwise(F.col("p")[0]).alias("lo"), F.when(flat, F.col("b")).otherwise(F.col("p")[1]).alias("hi"))
    v = F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return img.join(ends, DS).select(DS, "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias("v"))


def window_level(img: DataFrame, lo: float | None = None, hi: float | None = None, gamma: float = 1.0) -> DataFrame:
    """Linear window to 0..1, then the gamma-th root. Without lo or hi the finite extremes of each raster; pixels that
    aren't finite become 0; an empty window is 1 wide."""
    ends = img.groupBy(DS).agg(F.min(F.when(finite(F.col("v")), F.col("v"))).alias("_a"), F.max(F.when(finite(F.col("v")), F.col("v"))).alias("_b"))
    a, b = (F.col("_a") if lo is None else F.lit(float(lo))), (F.col("_b") if hi is None else F.lit(float(hi)))
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - a) / F.when(b <= a, 1.0).otherwise(b - a)))
    v = F.when(finite(F.col("v")), v).otherwise(0.0)
    return img.join(ends, DS).select(DS, "y", "x", (F.pow(v, F.lit(1 / gamma)) if gamma > 0 and gamma != 1 else v).alias("v"))


def histogram(img: DataFrame, bins: int = 256) -> DataFrame:
    """Counts over the finite range with the last bin closed: ds_id, bin (from 0), centre, n; empty bins have 0."""
    ok = img.where(finite(F.col("v")))
    ends = ok.groupBy(DS).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    wide = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)  # one value: a range of 1 around it
    ends = ends.select(DS, (F.col("lo") - wide).alias("lo"), (F.col("hi") + wide).alias("hi"))
    ends = ends.withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("width"))), F.lit(0))).cast("int")
    n = ok.join(ends, DS).groupBy(DS, at.alias("bin")).agg(F.count("*").alias("n"))
    spine = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(n, [DS, "bin"], "left").select(DS, "bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("centre"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def otsu(img: DataFrame, bins: int = 256) -> DataFrame:
    """The two-class threshold of each raster: the upper edge of the bin after which between-class variance is largest."""
    h = histogram(img, bins)
    up, all_ = W.partitionBy(DS).orderBy("bin"), W.partitionBy(DS)
    h = h.withColumn("w0", F.sum("n").over(up)).withColumn("m0", F.sum(F.col("n") * F.col("bin")).over(up)).withColumn("n_all", F.sum("n").over(all_)).withColumn("m_all", F.sum(F.col("n") * F.col("bin")).over(all_))
    between = F.pow(F.col("m_all") * F.col("w0") - F.col("m0") * F.col("n_all"), F.lit(2)) / (F.col("w0").cast("double") * (F.col("n_all") - F.col("w0")))
    ok = h.where((F.col("w0") > 0) & (F.col("w0") < F.col("n_all"))).withColumn("between", between)
    best = ok.groupBy(DS).agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("bin"))
    ends = img.where(finite(F.col("v"))).groupBy(DS).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return ends.join(best, DS, "left").select(DS, F.coalesce(F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins, F.col("lo")).alias("threshold"))


def gradient(img: DataFrame) -> DataFrame:
    """Central differences, one-sided at the borders: gy, gx."""

    def along(axis: str, other: str) -> Column:
        w = W.partitionBy(DS, other).orderBy(axis)
        before, after, v = F.lag("v").over(w), F.lead("v").over(w), F.col("v")
        return F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)

    return img.select(DS, "y", "x", along("y", "x").alias("gy"), along("x", "y").alias("gx"))


def image_math(a: DataFrame, b: DataFrame, op: str, pairs: DataFrame | None = None) -> DataFrame:
    """add, subtract, divide a / max(b, 1) or ratio a / max(a + b, 1) of rasters, where both have pixels.

    pairs: ds_id, other; which raster of b goes with one of a. Without it, the one with the same ds_id.
    """
    u, v = F.col("v"), F.col("_b")
    out = {"add": u + v, "subtract": u - v, "divide": u / F.greatest(v, F.lit(1.0)), "ratio": u / F.greatest(u + v, F.lit(1.0))}[op]
    other = b.select(F.col(DS).alias("_other"), "y", "x", F.col("v").alias("_b"))
    a = a.withColumn("_other", F.col(DS)) if pairs is None else a.join(pairs.withColumnRenamed("other", "_other"), DS)
    return a.join(other, ["_other", "y", "x"]).select(DS, "y", "x", out.alias("v"))


def mip(stack: list[DataFrame]) -> DataFrame:
    """Largest value of several rasters at each place."""
    out = stack[0]
    for s in stack[1:]:
        out = out.unionByName(s)
    return out.groupBy("y", "x").agg(F.max("v").alias("v"))


def to_display(img: DataFrame, lo: float | None = None, hi: float | None = None, gamma: float = 1.0) -> DataFrame:
    """window_level() in steps of 0 to 255: v int."""
    return window_level(img, lo, hi, gamma).select(DS, "y", "x", F.floor(F.col("v") * 255 + 0.5).cast("int").alias("v"))


def to_uint16(img: DataFrame) -> DataFrame:
    """Each raster over its finite range in steps of 0 to 65535: v int, and lo, hi to get values back. Other pixels are 0;
    a constant raster has a range of 1, one without finite pixels is 0 from 0 to 1.
    """
    ok = finite(F.col("v"))
    ends = img.groupBy(DS).agg(F.min(F.when(ok, F.col("v"))).alias("lo"), F.max(F.when(ok, F.col("v"))).alias("hi"))
    t = img.join(ends, DS)
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    v = F.when(ok, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("lo")) / span)) * 65535 + 0.5)).otherwise(0)
    return t.select(DS, "y", "x", v.cast("int").alias("v"), F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))


def thumbnail(img: DataFrame, most: int = 256) -> DataFrame:
    """Means of square blocks, the smallest that make both sides at most `most` pixels; the last row and column take what is left."""
    s = shape(img).withColumn("b", F.greatest(F.lit(1), F.ceil(F.greatest("h", "w") / most)))
    at = lambda c: F.expr(f"cast(({c} - 1) div b + 1 as int)")
    return img.join(s, DS).groupBy(DS, at("y").alias("y"), at("x").alias("x")).agg(F.avg("v").alias("v"))


def parse_roi(text: Column) -> Column:
    """Corners r1, c1, r2, c2 of a rectangle written as four whole numbers with commas; null for any other text."""
    parts = F.split(text, ",")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("int"))
    ok = (F.size(parts) == 4) & ~F.exists(numbers, lambda n: n.isNull())
    return F.when(ok, F.struct(*[F.get(numbers, i).alias(c) for i, c in enumerate(("r1", "c1", "r2", "c2"))]))


def embed(part: DataFrame, whole: DataFrame, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """A cropped raster in its place in the frame of the whole one, 0 around it."""
    y0, x0 = max(min(r1, r2), 1), max(min(c1, c2), 1)
    moved = part.select(DS, (F.col("y") + (y0 - 1)).alias("y"), (F.col("x") + (x0 - 1)).alias("x"), "v")
    return whole.select(DS, "y", "x").join(moved, [DS, "y", "x"], "left").select(DS, "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


def pyramid(img: DataFrame, levels: int = 4, tile: int = 256) -> DataFrame:
    """Means of blocks of 2^z pixels for zoom levels z from 0, cut into square tiles: ds_id, z, ty, tx (from 0), y, x (within the tile, from 1), v.

    All levels come from one aggregate, as a mean of blocks at the border is that of the pixels it has.
    """
    t = img.select(DS, "y", "x", "v", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("z")).withColumn("b", F.expr("shiftleft(1, z)"))
    at = lambda c: F.expr(f"cast(({c} - 1) div b as int)")
    m = t.groupBy(DS, "z", at("y").alias("r"), at("x").alias("c")).agg(F.avg("v").alias("v"))
    part = lambda c: F.expr(f"cast({c} div {tile} as int)")
    return m.select(DS, "z", part("r").alias("ty"), part("c").alias("tx"), (F.col("r") % tile + 1).alias("y"), (F.col("c") % tile + 1).alias("x"), "v")
