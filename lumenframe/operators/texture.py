"""Texture, noise, classes and wide profiles of rasters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.quantiles import quantiles
from lumenframe.operators.raster import DS, gaussian, gradient, histogram, shape, small_side
from lumenframe.session import materialize

#: Side of the blocks that noise is looked at in.
BLOCK = 16


def second_differences(img: DataFrame) -> DataFrame:
    """The product of second differences along both axes, where the raster has all neighbours."""
    for axis, other in (("y", "x"), ("x", "y")):
        w = W.partitionBy(DS, other).orderBy(axis)
        img = img.select(DS, "y", "x", (F.lag("v").over(w) - 2 * F.col("v") + F.lead("v").over(w)).alias("v")).where("v is not null")
    return img


def block_noise(variances: DataFrame) -> DataFrame:
    """Noise from variances s2 of blocks: the root of the middle of the fullest of up to 50 bins (the first of equal ones)."""
    e = variances.groupBy(DS).agg(F.min("s2").alias("lo"), F.max("s2").alias("hi"), F.least(F.lit(50), F.count("*")).alias("bins"))
    t = variances.join(e, DS).withColumn("bin", F.floor((F.col("s2") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))))
    full = t.where("hi > lo AND bin < bins").groupBy(DS, "bin").agg(F.count("*").alias("n")).groupBy(DS).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"))
    middle = F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / F.col("bins")).otherwise(F.col("lo"))
    return e.join(full, DS, "left").select(DS, F.sqrt(F.greatest(F.lit(0.0), middle)).alias("local"))


def noise(img: DataFrame, method: str = "mad") -> DataFrame:
    """Noise of each raster: ds_id, sigma, snr, snr_db, slope, icept, r2, kind.

    sigma is the median absolute response of second differences, scaled (mad), the commonest deviation of 16 x 16 blocks
    (localvar), or the mean of both. Without noise the ratios are infinite. kind comes from the regression of the variance on
    the mean of 16 x 16 blocks: poisson (r2 above 0.6, rising), gaussian (below 0.4), mixed between, else unknown.
    """
    if method not in ("mad", "localvar", "both"):
        raise ValueError("method must be mad, localvar or both")
    sigma = quantiles(second_differences(img).select(DS, F.abs("v").alias("v")), [DS], [0.5]).select(DS, (F.col("q")[0] / 0.6745 / math.sqrt(20)).alias("sigma"))
    level = img.groupBy(DS).agg(F.avg("v").alias("level"))
    at = [F.expr(f"({c} - 1) div {BLOCK}").alias(f"b{c}") for c in ("y", "x")]
    whole = img.join(shape(img), DS).where(f"y <= h div {BLOCK} * {BLOCK} AND x <= w div {BLOCK} * {BLOCK}")
    blocks = whole.groupBy(DS, *at).agg(F.avg("v").alias("m"), F.var_samp("v").alias("s2"))
    if method != "mad":
        alone = img.groupBy(DS).agg(F.stddev_samp("v").alias("whole"))
        local = alone.join(block_noise(blocks.select(DS, "s2")), DS, "left").select(DS, F.coalesce("local", "whole").alias("local"))
        sigma = sigma.join(local, DS).select(DS, (F.col("local") if method == "localvar" else (F.col("sigma") + F.col("local")) / 2).alias("sigma"))
    fit = blocks.where("m > 0").groupBy(DS).agg(F.count("*").alias("n"), F.regr_slope("s2", "m").alias("slope"), F.regr_intercept("s2", "m").alias("icept"), F.regr_r2("s2", "m").alias("r2"))
    fit = fit.where("n >= 4 AND slope is not null")
    t = sigma.join(level, DS).join(fit, DS, "left")
    snr = F.when((F.col("sigma") > 0) & (F.col("level") > 0), F.col("level") / F.col("sigma")).when(F.col("sigma") == 0, F.lit(float("inf")))
    kind = F.when((F.col("r2") > 0.6) & (F.col("slope") > 0), "poisson").when(F.col("r2") < 0.4, "gaussian").when(F.col("r2") <= 0.6, "mixed").otherwise("unknown")
    return t.select(DS, "sigma", snr.alias("snr"), (20 * F.log10(snr)).alias("snr_db"), "slope", "icept", "r2", kind.alias("kind"))


def structure_tensor(img: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Orientation (radians from +x), coherence and energy of the smoothed gradient products of each pixel."""
    g = gradient(img)
    part = lambda c: gaussian(g.select(DS, "y", "x", c.alias("v")), sigma)
    gx, gy = F.col("gx"), F.col("gy")
    t = part(gx * gx).withColumnRenamed("v", "xx").join(part(gx * gy).withColumnRenamed("v", "xy"), [DS, "y", "x"]).join(part(gy * gy).withColumnRenamed("v", "yy"), [DS, "y", "x"])
    half = F.hypot((F.col("xx") - F.col("yy")) / 2, F.col("xy"))
    energy = F.col("xx") + F.col("yy")
    return t.select(DS, "y", "x", (F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2).alias("orientation"), F.pow(2 * half / (energy + 2.220446049250313e-16), F.lit(2)).alias("coherence"), energy.alias("energy"))


def growth_orientation(img: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Main direction of the gradient, weighted by coherence: ds_id, axis (y: layers lie flat), tilt (degrees), coherence."""
    t = structure_tensor(img, sigma).groupBy(DS).agg(F.sum(F.col("coherence") * F.cos(2 * F.col("orientation"))).alias("c"), F.sum(F.col("coherence") * F.sin(2 * F.col("orientation"))).alias("s"), F.sum("coherence").alias("n"))
    theta = F.atan2(F.col("s"), F.col("c")) / 2
    flat = F.abs(theta) > math.pi / 4
    layer = F.when(flat, F.when(theta > 0, theta - math.pi / 2).otherwise(theta + math.pi / 2)).otherwise(theta)
    return t.select(DS, F.when(flat, "y").otherwise("x").alias("axis"), F.degrees(layer).alias("tilt"), (F.hypot("c", "s") / (F.col("n") + 2.220446049250313e-16)).alias("coherence"))


def _cuts(img: DataFrame, classes: int, bins: int, near: DataFrame | None = None) -> DataFrame:
    """ds_id, b: the bins (b1, b2, ...) after which the classes are parted best; near: ds_id, f1, l1, f2, ..., the first and last bin of each."""
    up = W.partitionBy(DS).orderBy("bin")
    h = histogram(img, bins)
    h = h.select(DS, "bin", F.sum("n").over(up).cast("double").alias("w"), F.sum(F.col("n") * F.col("bin")).over(up).cast("double").alias("m"))
    end = h.where(F.col("bin") == bins - 1).select(DS, F.col("w").alias("we"), F.col("m").alias("me"))
    t, names = end.withColumn("w0", F.lit(0.0)).withColumn("m0", F.lit(0.0)).withColumn("b0", F.lit(-1)), []
    if near is not None:
        t = t.join(near, DS)
    gain = lambda m1, m0, w1, w0: F.coalesce(F.try_divide(F.pow(F.col(m1) - F.col(m0), F.lit(2)), F.col(w1) - F.col(w0)), F.lit(0.0))
    total = F.lit(0.0)
    for i in range(1, classes):
        names.append(f"b{i}")
        after = F.col(f"b{i}") > F.col(f"b{i - 1}")
        allowed = after if near is None else after & F.col(f"b{i}").between(F.col(f"f{i}"), F.col(f"l{i}"))
        t = t.join(h.select(DS, F.col("bin").alias(f"b{i}"), F.col("w").alias(f"w{i}"), F.col("m").alias(f"m{i}")), DS).where(allowed)
        total = total + gain(f"m{i}", f"m{i - 1}", f"w{i}", f"w{i - 1}")
    total = F.round((total + gain("me", f"m{classes - 1}", "we", f"w{classes - 1}")) / F.col("we"), 9)
    return t.where(F.col(f"b{classes - 1}") < bins - 1).groupBy(DS).agg(F.max_by(F.struct(*names), F.struct(total, *[-F.col(n) for n in names])).alias("b"))


def _best_cuts(img: DataFrame, classes: int, bins: int) -> DataFrame:
    """ds_id, b: the bins (b1, b2, ...) after which the classes are parted best, by dynamic programming over the bins.

    The best parting of the bins up to one into k classes is the best of all partings into k - 1 up to an earlier one, so
    a raster takes classes times bins squared rows. Of equal ones (at nine digits of the gain per pixel) the first stays.
    """
    up = W.partitionBy(DS).orderBy("bin")
    h = histogram(img, bins)
    h = h.select(DS, "bin", F.sum("n").over(up).cast("double").alias("w"), F.sum(F.col("n") * F.col("bin")).over(up).cast("double").alias("m"))
    end = h.where(F.col("bin") == bins - 1).select(DS, F.col("w").alias("all"))
    before = h.select(DS, F.col("bin").alias("a"), F.col("w").alias("wa"), F.col("m").alias("ma")).unionByName(end.select(DS, F.lit(-1).alias("a"), F.lit(0.0).alias("wa"), F.lit(0.0).alias("ma")))
    gain = F.coalesce(F.try_divide(F.pow(F.col("m") - F.col("ma"), F.lit(2)), F.col("w") - F.col("wa")), F.lit(0.0))
    pairs = materialize(before.join(h, DS).join(end, DS).where("bin > a").select(DS, "a", F.col("bin").alias("b"), (gain / F.col("all")).alias("g")), "otsu-pairs")
    t = pairs.where("a = -1").select(DS, "b", F.col("g").alias("score"), F.array().cast("array<int>").alias("cuts"))
    for _ in range(classes - 1):
        longer = pairs.where("a >= 0").join(t.select(DS, F.col("b").alias("a"), "score", "cuts"), [DS, "a"])
        whole = longer.select(DS, "b", (F.col("score") + F.col("g")).alias("score"), F.concat("cuts", F.array("a")).alias("cuts"))
        t = whole.groupBy(DS, "b").agg(F.max_by(F.struct("score", "cuts"), F.struct(F.round("score", 9), F.transform("cuts", lambda c: -c))).alias("x")).select(DS, "b", "x.*")
    names = [F.col("cuts")[i].alias(f"b{i + 1}") for i in range(classes - 1)]
    return t.where(F.col("b") == bins - 1).select(DS, F.struct(*names).alias("b"))


#: Bins of the first search for five classes.
COARSE = 64


def multi_otsu(img: DataFrame, classes: int = 3, bins: int = 256) -> DataFrame:
    """Thresholds of 2 to 5 classes: ds_id, t1, t2, ...; upper edges of the bins that part the classes best.

    Up to four classes the best of all choices of bins, by dynamic programming over each raster's histogram. Five classes are
    parted in 64 bins first, then in the bins near those parts.
    """
    if not 2 <= classes <= 5:
        raise ValueError("classes must be 2 to 5")
    names, near = [f"b{i}" for i in range(1, classes)], None
    if classes == 5:
        far = max(2, 2 * round(bins / COARSE))
        middle = {n: F.rint((F.col(f"b.{n}") + 0.5) * bins / COARSE).cast("int") for n in names}
        first = [F.greatest(F.lit(0), m - far).alias(f"f{n[1:]}") for n, m in middle.items()]
        last = [F.least(F.lit(bins - 4 + i), m + far).alias(f"l{n[1:]}") for i, (n, m) in enumerate(middle.items())]
        near = _cuts(img, classes, COARSE).select(DS, *first, *last)
    best = _cuts(img, classes, bins, near) if classes == 5 else _best_cuts(img, classes, bins)
    ends = img.groupBy(DS).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    edge = lambda n: F.col("lo") + (F.col(f"b.{n}") + 1) * (F.col("hi") - F.col("lo")) / bins
    return best.join(ends, DS).select(DS, *[F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(edge(n)).alias(f"t{n[1:]}") for n in names])


def classify(img: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Class of each pixel from 1: one more for each threshold that it is above."""
    names = [c for c in thresholds.columns if c != DS]
    return img.join(thresholds, DS).select(DS, "y", "x", sum(((F.col("v") > F.col(n)).cast("int") for n in names), F.lit(1)).alias("label"))


def class_shares(labels: DataFrame, img: DataFrame) -> DataFrame:
    """Share of the pixels and range of values of each class."""
    t = labels.join(img, [DS, "y", "x"]).groupBy(DS, "label").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    return t.select(DS, "label", (F.col("n") / F.sum("n").over(W.partitionBy(DS))).alias("share"), "min", "max")


def surface_area_ratio(img: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """Area of the surface of two triangles per four pixels to its projection; triangles with a pixel that isn't finite don't count."""
    row, col = W.partitionBy(DS, "y").orderBy("x"), W.partitionBy(DS, "x").orderBy("y")
    t = img.select(DS, "y", "x", F.col("v").alias("a"), F.lead("v").over(row).alias("b"))
    t = t.select(DS, "a", "b", F.lead("a").over(col).alias("c"), F.lead("b").over(col).alias("d"))
    area = lambda corner, u, v: F.sqrt(F.pow(F.col(u) - F.col(corner), F.lit(2)) + F.pow(F.col(v) - F.col(corner), F.lit(2)) + pixel_size**2)
    tri = t.select(DS, F.explode(F.array(area("a", "b", "c"), area("d", "b", "c"))).alias("s"))
    return tri.where("s is not null AND NOT isnan(s) AND s < double('infinity')").groupBy(DS).agg((F.avg("s") / pixel_size).alias("ratio"))


def band_profile(img: DataFrame, x1: float, y1: float, x2: float, y2: float, width: int = 1, reduce: str = "mean", points: int | None = None) -> DataFrame:
    """Bilinear samples along a segment over `width` parallel lines a pixel apart: ds_id, i, distance, v, sem.

    points: number of samples, by default one about every pixel. v is the mean (or sum) over the lines that lie in the raster; sem the error of the mean, null for one line or a sum.
    """
    if reduce not in ("mean", "sum"):
        raise ValueError("reduce must be mean or sum")
    length = math.hypot(x2 - x1, y2 - y1)
    if width > 1 and length == 0:
        raise ValueError("a wide profile needs a length")
    n = points or max(2, math.ceil(length) + 1)
    ux, uy = ((x2 - x1) / length, (y2 - y1) / length) if length else (0.0, 0.0)
    line = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    at = img.sparkSession.range(n).select(F.col("id").alias("i"), line.alias("line"))
    off, t = F.col("line") - (width - 1) / 2, F.col("i") / float(n - 1)
    at = at.select("i", "line", (x1 + (x2 - x1) * t - uy * off).alias("sx"), (y1 + (y2 - y1) * t + ux * off).alias("sy"))
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    taps = [F.struct((F.floor("sy") + b).cast("int").alias("y"), (F.floor("sx") + a).cast("int").alias("x"), ((fx if a else 1 - fx) * (fy if b else 1 - fy)).alias("k")) for a in (0, 1) for b in (0, 1)]
    at = at.select("i", "line", F.explode(F.array(*taps)).alias("c")).select("i", "line", "c.*").where("k > 0")
    s = img.join(F.broadcast(at), ["y", "x"]).groupBy(DS, "i", "line").agg(F.sum(F.col("v") * F.col("k")).alias("v"), F.sum("k").alias("k")).where("k > 0.999999")
    out = s.groupBy(DS, "i").agg((F.avg if reduce == "mean" else F.sum)("v").alias("v"), (F.stddev_pop("v") / F.sqrt(F.count("*"))).alias("sem"))
    sem = F.col("sem") if width > 1 and reduce == "mean" else F.lit(None).cast("double")
    return out.select(DS, "i", (F.col("i") * (length / (n - 1))).alias("distance"), "v", sem.alias("sem"))


def polyline_profile(img: DataFrame, points: list[tuple[float, float]], width: int = 1, reduce: str = "mean") -> DataFrame:
    """band_profile() along the segments of a line of points (x, y), joints once: ds_id, part, i, distance (from the first point), v."""
    if len(points) < 2:
        raise ValueError("a line needs two points")
    out, far = None, 0.0
    for part, ((x1, y1), (x2, y2)) in enumerate(zip(points[:-1], points[1:], strict=True)):
        p = band_profile(img, x1, y1, x2, y2, width, reduce).where(F.col("i") >= min(part, 1))
        p = p.select(DS, F.lit(part).alias("part"), "i", (F.col("distance") + far).alias("distance"), "v")
        out, far = (p if out is None else out.unionByName(p)), far + math.hypot(x2 - x1, y2 - y1)
    return out


def montage(stack: DataFrame, columns: int, gap: int = 0) -> DataFrame:
    """Rasters side by side in the order of ds_id, `columns` in a row, cells as large as the largest raster: one raster `montage`."""
    s = shape(stack)
    number = s.select(DS, (F.row_number().over(W.orderBy(DS)) - 1).alias("n"))  # a row per raster
    cell = s.agg(F.max("h").alias("ch"), F.max("w").alias("cw"))
    t = stack.join(small_side(number), DS).join(F.broadcast(cell))
    y = F.col("y") + F.expr(f"n div {columns}") * (F.col("ch") + gap)
    return t.select(F.lit("montage").alias(DS), y.cast("int").alias("y"), (F.col("x") + F.col("n") % columns * (F.col("cw") + gap)).cast("int").alias("x"), "v")


def clahe(img: DataFrame, clip_limit: float = 0.01, bins: int = 256, tiles: int = 8) -> DataFrame:
    """Local equalisation: each of tiles x tiles has the cumulated histogram of its pixels, counts cut at clip_limit of the
    tile (1 at least) and the excess spread over all bins; a pixel's value comes from the tiles whose centres lie around
    it, bilinear. Values from 0 to 1; a constant raster becomes 0.
    """
    ends = img.groupBy(DS).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("y").alias("h"), F.max("x").alias("w"))
    t = img.join(ends, DS).where("hi > lo")
    t = t.withColumn("bin", F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (bins - 1) + 0.5).cast("int"))
    for c, n, out in (("y", "h", "i"), ("x", "w", "j")):
        t = t.withColumn(out, F.expr(f"cast(((2 * {c} - 1) * {tiles} - 1) div (2 * {n}) as int)"))
    n = t.groupBy(DS, "i", "j", "bin").agg(F.count("*").alias("n"))
    # A table of every bin of every tile; a tile without pixels (fewer rows than tiles) rises evenly.
    spine = ends.where("hi > lo").select(DS, F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("i")).select(DS, "i", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("j"))
    spine = spine.select(DS, "i", "j", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(n, [DS, "i", "j", "bin"], "left")
    tile = W.partitionBy(DS, "i", "j")
    s = spine.select(DS, "i", "j", "bin", F.coalesce("n", F.lit(0)).alias("n")).withColumn("all", F.sum("n").over(tile))
    most = F.greatest(F.lit(1.0), F.floor(clip_limit * F.col("all") + 0.5)) if clip_limit > 0 else F.col("all").cast("double")
    s = s.withColumn("most", most).withColumn("excess", F.sum(F.greatest(F.lit(0.0), F.col("n") - F.col("most"))).over(tile))
    upto = F.sum(F.least("n", F.col("most")) + F.col("excess") / bins).over(tile.orderBy("bin"))
    table = s.select(DS, "i", "j", "bin", F.when(F.col("all") > 0, upto / F.col("all")).otherwise(F.col("bin") / float(bins - 1)).alias("u"))
    sides = []
    for c, n, at in (("y", "h", "i"), ("x", "w", "j")):
        centre = lambda e, n=n: (F.floor(e * F.col(n) / tiles + 0.5) + F.floor((e + 1) * F.col(n) / tiles + 0.5) + 1) / 2
        first = F.when(centre(F.col(at)) <= F.col(c), F.col(at)).otherwise(F.col(at) - 1)
        lo = F.greatest(F.lit(0), first)
        share = F.when((first >= 0) & (first < tiles - 1), (F.col(c) - centre(lo)) / (centre(lo + 1) - centre(lo))).otherwise(0.0)
        sides.append((lo, share))
    (i, wi), (j, wj) = sides
    t = t.select(DS, "y", "x", "bin", i.alias("i0"), wi.alias("wi"), j.alias("j0"), wj.alias("wj"))
    taps = [F.struct((F.col("i0") + a).alias("i"), (F.col("j0") + b).alias("j"), ((F.col("wi") if a else 1 - F.col("wi")) * (F.col("wj") if b else 1 - F.col("wj"))).alias("k")) for a in (0, 1) for b in (0, 1)]
    t = t.select(DS, "y", "x", "bin", F.inline(F.array(*taps))).where("k > 0")
    out = t.join(table, [DS, "i", "j", "bin"]).groupBy(DS, "y", "x").agg(F.sum(F.col("k") * F.col("u")).alias("v"))
    return out.unionByName(img.join(ends.where("hi <= lo"), DS).select(DS, "y", "x", F.lit(0.0).alias("v")))


def luma(rgb: DataFrame) -> DataFrame:
    """Grey of a colour raster (r, g, b) by the weights of Rec. 601."""
    return rgb.select(DS, "y", "x", (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).alias("v"))


def auto_window(img: DataFrame, bins: int = 65536, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Display limits from a cumulated histogram: centres of the first bins at which the share reaches low and high."""
    h = histogram(img, bins).where("n > 0")
    share = F.sum("n").over(W.partitionBy(DS).orderBy("bin")) / F.sum("n").over(W.partitionBy(DS))
    h = h.select(DS, "centre", share.alias("s"))
    return h.groupBy(DS).agg(F.min(F.when(F.col("s") >= low, F.col("centre"))).alias("lo"), F.min(F.when(F.col("s") >= high, F.col("centre"))).alias("hi"))
