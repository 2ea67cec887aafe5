"""Measurements on rasters and populations: statistics, regions, radial and line profiles, roughness, distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.quantiles import blocks, cumulated, quantiles
from lumenframe.operators.raster import DS, finite, plane_level, shape
from lumenframe.session import beside, materialize


def image_stats(img: DataFrame) -> DataFrame:
    """Finite pixels only; population standard deviation."""
    ok = img.where(finite(F.col("v")))
    s = ok.groupBy(DS).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return s.join(quantiles(ok, [DS], [0.5]), DS).select(*s.columns, F.col("q")[0].alias("median"))


def in_rect(r1: int, c1: int, r2: int, c2: int) -> Column:
    """A rectangle by two corners in any order, from 1, ends included."""
    return F.col("y").between(min(r1, r2), max(r1, r2)) & F.col("x").between(min(c1, c2), max(c1, c2))


def in_ellipse(r1: int, c1: int, r2: int, c2: int) -> Column:
    """The ellipse inscribed in the rectangle of pixel centres."""
    cy, cx = (r1 + r2) / 2, (c1 + c2) / 2
    ry, rx = (abs(r2 - r1) + 1) / 2, (abs(c2 - c1) + 1) / 2
    return in_rect(r1, c1, r2, c2) & (F.pow((F.col("y") - cy) / ry, F.lit(2)) + F.pow((F.col("x") - cx) / rx, F.lit(2)) <= 1)


def roi_stats(img: DataFrame, region: Column, pixel_size: float = 1.0) -> DataFrame:
    """Sample standard deviation (0 for one pixel) and area of a region."""
    n = F.count("*")
    return img.where(region).groupBy(DS).agg(n.alias("n"), F.avg("v").alias("mean"), F.when(n == 1, 0.0).otherwise(F.stddev_samp("v")).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), (n * (pixel_size * pixel_size)).alias("area"))


def box_integrate(img: DataFrame, r1: int, c1: int, r2: int, c2: int, reduce: str = "sum") -> DataFrame:
    """Sums (or means) along both axes of a box, in one pass by grouping sets: axis, at (place in the raster), v."""
    if reduce not in ("sum", "mean"):
        raise ValueError("reduce must be sum or mean")
    box = img.where(in_rect(r1, c1, r2, c2))
    sets = box.groupingSets([[F.col(DS), F.col("y")], [F.col(DS), F.col("x")]], DS, "y", "x").agg((F.sum if reduce == "sum" else F.avg)("v").alias("v"))
    return sets.select(DS, F.when(F.col("y").isNull(), "x").otherwise("y").alias("axis"), F.coalesce("y", "x").alias("at"), "v")


def radial_profile(img: DataFrame, n_bins: int = 0, center_x: float | None = None, center_y: float | None = None, normalize: bool = False) -> DataFrame:
    """Mean, maximum, population deviation and number of pixels by radius to the farthest corner; empty rings have no row.

    The centre is the raster's by default, coordinates count from 1. normalize stretches means to 0 to 1 (deviations with them)
    and maxima to 0 to 1, each 0 where all rings are equal.
    """
    s = img.join(shape(img), DS)
    cy = F.lit(float(center_y)) if center_y is not None else F.col("h") / 2 + 0.5
    cx = F.lit(float(center_x)) if center_x is not None else F.col("w") / 2 + 0.5
    bins = F.lit(n_bins) if n_bins else F.expr("least(h, w) div 2")
    corner = F.sqrt(F.pow(F.greatest(cx - 1, F.col("w") - cx), F.lit(2)) + F.pow(F.greatest(cy - 1, F.col("h") - cy), F.lit(2)))
    r = F.sqrt(F.pow(F.col("x") - cx, F.lit(2)) + F.pow(F.col("y") - cy, F.lit(2)))
    at = F.least(bins - 1, F.floor(r / (corner / bins))).cast("int")
    out = s.groupBy(DS, at.alias("bin")).agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"), F.count("*").alias("n"))
    if not normalize:
        return out
    w = W.partitionBy(DS)
    low, span = {c: F.min(c).over(w) for c in ("mean", "max")}, {c: F.max(c).over(w) - F.min(c).over(w) for c in ("mean", "max")}
    to = lambda c, by, less: F.when(span[by] > 0, (F.col(c) - less) / span[by]).otherwise(0.0).alias(c)
    return out.select(DS, "bin", to("mean", "mean", low["mean"]), to("max", "max", low["max"]), to("std", "mean", F.lit(0.0)), "n")


def azimuthal(img: DataFrame, lo: float, hi: float, n_bins: int = 0) -> DataFrame:
    """Mean by radius within the sector [lo, hi) of degrees from +x towards +y, inside the distance to the nearest edge.

    A sector whose end is not beyond its start wraps; 0 to 360 is all. Rings without pixels have no row.
    """
    s = img.join(shape(img), DS)
    cx, cy = (F.col("w") + 1) / 2, (F.col("h") + 1) / 2
    dx, dy = F.col("x") - cx, F.col("y") - cy
    angle = F.degrees(F.atan2(dy, dx))
    angle = F.when(angle < 0, angle + 360).otherwise(angle)
    sector = F.lit(True) if (lo, hi) == (0, 360) else (angle >= lo) & (angle < hi) if lo < hi else (angle >= lo) | (angle < hi)
    r_max = F.greatest(F.lit(1.0), F.least(cx, cy, F.col("w") - cx, F.col("h") - cy))
    bins = F.lit(n_bins) if n_bins > 0 else F.expr("least(h, w) div 2")
    r = F.sqrt(dx * dx + dy * dy)
    return s.where(sector & (r < r_max) & ~F.isnan("v")).groupBy(DS, F.least(bins - 1, F.floor(r / (r_max / bins))).cast("int").alias("bin")).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def line_profile(img: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Bilinear samples along a segment: i, distance, v; samples outside the raster have no row."""
    length = math.hypot(x2 - x1, y2 - y1)
    n = max(2, math.ceil(length) + 1)
    t = F.col("i") / float(n - 1)
    at = img.sparkSession.range(n).withColumnRenamed("id", "i").withColumn("sx", x1 + (x2 - x1) * t).withColumn("sy", y1 + (y2 - y1) * t)
    at = at.withColumn("x0", F.floor("sx")).withColumn("y0", F.floor("sy"))
    corner = F.explode(F.array(*[F.struct((F.col("y0") + dy).cast("int").alias("y"), (F.col("x0") + dx).cast("int").alias("x"), ((F.col("sy") - F.col("y0") if dy else F.col("y0") + 1 - F.col("sy")) * (F.col("sx") - F.col("x0") if dx else F.col("x0") + 1 - F.col("sx"))).alias("k")) for dy in (0, 1) for dx in (0, 1)]))
    taps = at.select("i", corner.alias("c")).select("i", "c.*").where("k > 0")
    out = img.join(F.broadcast(taps), ["y", "x"]).groupBy(DS, "i").agg(F.sum(F.col("v") * F.col("k")).alias("v"), F.sum("k").alias("k"))
    return out.where("k > 0.999999").select(DS, "i", (F.col("i") * (length / (n - 1))).alias("distance"), "v")


def roughness(img: DataFrame, level: bool = True) -> DataFrame:
    """Ra, Rq, Rz, Rsk, Rku (not excess), Rp, Rv after levelling and centring."""
    z = plane_level(img.where(finite(F.col("v")))) if level else img.where(finite(F.col("v")))
    mean = z.groupBy(DS).agg(F.avg("v").alias("_m"))
    z = z.join(mean, DS).select(DS, (F.col("v") - F.col("_m")).alias("v"))
    q = F.sqrt(F.avg(F.col("v") * F.col("v")))
    return z.groupBy(DS).agg(F.avg(F.abs("v")).alias("ra"), q.alias("rq"), (F.max("v") - F.min("v")).alias("rz"), F.try_divide(F.avg(F.pow("v", F.lit(3))), F.pow(q, F.lit(3))).alias("rsk"), F.try_divide(F.avg(F.pow("v", F.lit(4))), F.pow(q, F.lit(4))).alias("rku"), F.max("v").alias("rp"), (-F.min("v")).alias("rv"), F.count("*").alias("n"))


def bearing_curve(img: DataFrame, levels: int = 20) -> DataFrame:
    """Heights that 0..100 % of the surface lies above, in steps; finite pixels only."""
    q = quantiles(img.where(finite(F.col("v"))), [DS], [1 - i / levels for i in range(levels + 1)])
    return q.select(DS, F.posexplode("q").alias("step", "height"))


def hhcf(traces: DataFrame, max_lag: int, least: int = 8) -> DataFrame:
    """Mean squared difference of heights at each lag, per trace (numbered without gaps), where it has enough pairs."""
    w = W.partitionBy("user_id", "block").orderBy("i")
    far = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead("v", k).over(w).alias("u")) for k in range(1, max_lag + 1)])
    d = blocks(traces, "i", 0, max_lag).select("user_id", "v", "own", far.alias("far")).where("own").select("user_id", "v", F.inline("far"))
    d = d.where("u is not null").groupBy("user_id", "lag").agg(F.avg(F.pow(F.col("u") - F.col("v"), F.lit(2))).alias("g"), F.count("*").alias("n"))
    return d.where(F.col("n") >= least)


def summarize(pop: DataFrame) -> DataFrame:
    """Per group: finite values and dropped ones, sample deviation (null for one value), quartiles of type 7."""
    v = F.when(finite(F.col("v")), F.col("v"))
    s = pop.groupBy("grp").agg(F.count(v).alias("n"), (F.count("*") - F.count(v)).alias("dropped"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(pop.where(finite(F.col("v"))), ["grp"], [0.25, 0.5, 0.75])
    return s.join(q, "grp", "left").select(*s.columns, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def fit_normal_lognormal(pop: DataFrame) -> DataFrame:
    """Maximum likelihood fits per group: kind, loc, scale, log likelihood and AIC (two parameters). Lognormal: positive values only."""
    v = pop.where(finite(F.col("v")))
    both = v.select("grp", "v", F.col("v").alias("t"), F.lit("normal").alias("kind")).unionByName(v.where("v > 0").select("grp", "v", F.log("v").alias("t"), F.lit("lognormal").alias("kind")))
    s = both.groupBy("grp", "kind").agg(F.count("*").alias("n"), F.avg("t").alias("loc"), F.stddev_pop("t").alias("scale"), F.sum(F.when(F.col("kind") == "lognormal", F.col("t")).otherwise(0.0)).alias("jac"))
    loglik = -F.col("n") * (F.log(F.col("scale")) + 0.5 * math.log(2 * math.pi) + 0.5) - F.col("jac")
    return s.where("scale > 0").select("grp", "kind", "n", "loc", "scale", loglik.alias("loglik"), (4 - 2 * loglik).alias("aic"))


def fit_weibull(pop: DataFrame, steps: int = 10) -> DataFrame:
    """Maximum likelihood Weibull fit of the positive values per group: grp, kind, n, shape, scale, loglik, aic.

    Newton's steps for the shape on the logarithms less their mean, each one an aggregate; values all equal have no fit.
    Where groups are few, what is known of them is broadcast to their values, so no group is one task.
    """
    t = pop.where(finite(F.col("v")) & (F.col("v") > 0)).select("grp", F.log("v").alias("t"))
    s = t.groupBy("grp").agg(F.count("*").alias("n"), F.avg("t").alias("m"), F.stddev_pop("t").alias("sd")).where("sd > 1e-12")
    s = materialize(s, "weibull-groups")
    near = beside(s)
    z = t.join(near(s), "grp").select("grp", (F.col("t") - F.col("m")).alias("z"))
    k = s.select("grp", "n", "m", (math.pi / math.sqrt(6) / F.col("sd")).alias("k"))
    p = F.exp(F.col("k") * F.col("z"))
    for _ in range(steps):
        sums = z.join(near(k), "grp").groupBy("grp", "n", "m", "k").agg(F.sum(p).alias("s0"), F.sum(p * F.col("z")).alias("s1"), F.sum(p * F.col("z") * F.col("z")).alias("s2"))
        mean = F.col("s1") / F.col("s0")
        step = (mean - 1 / F.col("k")) / (F.col("s2") / F.col("s0") - mean * mean + 1 / (F.col("k") * F.col("k")))
        k = sums.select("grp", "n", "m", F.greatest(F.col("k") - step, F.col("k") / 2).alias("k"))
    out = z.join(near(k), "grp").groupBy("grp", "n", "m", "k").agg((F.log(F.avg(p)) / F.first("k")).alias("ls"))
    loglik = F.col("n") * (F.log("k") - F.col("k") * (F.col("m") + F.col("ls")) + (F.col("k") - 1) * F.col("m") - 1)
    return out.select("grp", F.lit("weibull").alias("kind"), "n", F.col("k").alias("shape"), F.exp(F.col("m") + F.col("ls")).alias("scale"), loglik.alias("loglik"), (4 - 2 * loglik).alias("aic"))


def normal_cdf(z: Column) -> Column:
    """Share of the standard normal distribution up to z, to 1e-7: the error function by a polynomial in 1 / (1 + p x)."""
    x = F.abs(z) / math.sqrt(2)
    u = 1 / (1 + 0.3275911 * x)  # fixed values: Abramowitz and Stegun 7.1.26
    tail = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429)))) * F.exp(-x * x) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


def fit_all(pop: DataFrame, least: int = 8) -> DataFrame:
    """Normal, lognormal and Weibull fits per group, their distance from the values and which one has the smallest AIC.

    grp, kind, n, loc, scale, shape, loglik, aic, ks (largest distance of the cumulated shares), best. Lognormal loc and
    scale are those of the logarithms. Groups of fewer than `least` values have no fit; those with values of 0 or below
    only a normal one.
    """
    ok = pop.where(finite(F.col("v")))
    all_ = ok.groupBy("grp").agg(F.count("*").alias("total"))
    fits = fit_normal_lognormal(ok).withColumn("shape", F.lit(None).cast("double")).unionByName(fit_weibull(ok).withColumn("loc", F.lit(0.0)))
    fits = fits.join(all_, "grp").where((F.col("total") >= least) & (F.col("n") == F.col("total"))).drop("total")
    fits = materialize(fits, "fits")
    t = cumulated(ok, ["grp"]).join(beside(fits)(fits.select("grp", "kind", "loc", "scale", "shape")), "grp")
    v = F.col("v")
    cdf = F.when(F.col("kind") == "weibull", 1 - F.exp(-F.pow(v / F.col("scale"), F.col("shape")))).otherwise(normal_cdf((F.when(F.col("kind") == "normal", v).otherwise(F.log(v)) - F.col("loc")) / F.col("scale")))
    t = t.withColumn("c", cdf)
    far = F.max(F.greatest(F.col("upto") / F.col("size") - F.col("c"), F.col("c") - (F.col("upto") - F.col("n")) / F.col("size")))
    out = fits.join(t.groupBy("grp", "kind").agg(far.alias("ks")), ["grp", "kind"])
    best = F.row_number().over(W.partitionBy("grp").orderBy("aic", "kind")) == 1
    return out.select("grp", "kind", "n", "loc", "scale", "shape", "loglik", "aic", "ks", best.alias("best"))


def r_squared(df: DataFrame, *keys: str) -> DataFrame:
    """1 less the share of the variation of `actual` that `predicted` leaves, per group; 0 where actual is constant."""
    left, all_ = F.sum(F.pow(F.col("actual") - F.col("predicted"), F.lit(2))), F.var_pop("actual") * F.count("*")
    return df.groupBy(*keys).agg(F.when(all_ > 0, 1 - left / all_).otherwise(0.0).alias("r2"))


def histogram_bins(pop: DataFrame, most: int = 200) -> DataFrame:
    """Freedman-Diaconis bins per group (square root rule without spread), last bin closed; only bins with values."""
    v = pop.where(finite(F.col("v")))
    s = v.groupBy("grp").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    s = s.join(quantiles(v, ["grp"], [0.25, 0.75]), "grp").withColumn("iqr", F.col("q")[1] - F.col("q")[0])
    step = 2 * F.col("iqr") / F.cbrt(F.col("n").cast("double"))
    bins = F.least(F.lit(most), F.greatest(F.lit(1), F.coalesce(F.ceil(F.try_divide(F.col("hi") - F.col("lo"), step)), F.ceil(F.sqrt("n"))))).cast("int")
    s = materialize(s.withColumn("bins", bins), "bins")
    at = F.coalesce(F.least(F.col("bins") - 1, F.floor(F.try_divide(F.col("v") - F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")))), F.lit(0)).cast("int")
    return v.join(beside(s)(s.select("grp", "lo", "hi", "bins")), "grp").groupBy("grp", "bins", at.alias("bin")).agg(F.count("*").alias("n"))


def trapezoid(traces: DataFrame) -> DataFrame:
    """Integral over i of each trace (numbered without gaps), and its Poisson variance with composite weights."""
    w = W.partitionBy("user_id", "block").orderBy("i")
    weight = (F.coalesce(F.lead("i").over(w) - F.col("i"), F.lit(0)) + F.coalesce(F.col("i") - F.lag("i").over(w), F.lit(0))) / 2
    t = blocks(traces, "i", 1, 1).select("user_id", "v", "own", weight.alias("k")).where("own")
    return t.groupBy("user_id").agg(F.sum(F.col("v") * F.col("k")).alias("area"), F.sum(F.col("k") * F.col("k") * F.greatest(F.col("v"), F.lit(0.0))).alias("variance"))


def poisson_sigma(c: Column) -> Column:
    """The counting error of a number of counts; negative counts have none."""
    return F.sqrt(F.greatest(c, F.lit(0.0)))


def fraction_sigma(parts: DataFrame, *group: str) -> DataFrame:
    """Fractions q / sum(q) within each group and their errors in percentage points, from independent errors q_sigma.

    Adds fraction and fraction_sigma; one part alone has the error 0, and a sum that isn't positive gives null.
    """
    q, v = F.col("q"), F.col("q_sigma") * F.col("q_sigma")
    all_ = W.partitionBy(*group)
    t = parts.withColumn("_s", F.sum(q).over(all_)).withColumn("_v", F.sum(v).over(all_)).withColumn("_n", F.count("*").over(all_))
    f = F.when(F.col("_s") > 0, q / F.col("_s"))
    # The derivatives are (1 - f) / s by the own part and -f / s by each other one.
    var = (F.pow(1 - f, F.lit(2)) * v + f * f * (F.col("_v") - v)) / (F.col("_s") * F.col("_s"))
    return t.select(*parts.columns, f.alias("fraction"), F.when(F.col("_s") > 0, F.when(F.col("_n") == 1, 0.0).otherwise(100 * F.sqrt(F.greatest(var, F.lit(0.0))))).alias("fraction_sigma"))
