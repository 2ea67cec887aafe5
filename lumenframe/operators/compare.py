"""Results beside each other: measurement groups, samples by a parameter, populations and fitted curves, peak markers, lattices, the steps behind a result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.quantiles import quantiles
from lumenframe.operators.raster import DS, finite
from lumenframe.session import beside, materialize

#: Columns of a raster that meet the sampled ones in one task.
BLOCK = 4096
#: Columns whose neighbours one task looks for.
COLUMNS = 10_000

#: Kinds of measurements by the group that they count in.
GROUPS = {"distance": "Distance", "profile": "Distance", "polyline": "Distance", "angle": "Angle", "roi": "ROI mean", "ellipse": "ROI mean", "polygon": "Area", "lasso": "Area"}


def measure_groups(measures: DataFrame) -> DataFrame:
    """Per ds_id and group of measurements (kind, v): n, mean, std (of the population), min, q1, median, q3, max.

    Kinds without a number, such as notes, and values that aren't finite count in no group.
    """
    known = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
    t = measures.select(DS, F.try_element_at(known, F.col("kind")).alias("group"), "v").where(F.col("group").isNotNull() & finite(F.col("v")))
    s = t.groupBy(DS, "group").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return s.join(quantiles(t, [DS, "group"], [0.25, 0.5, 0.75]), [DS, "group"]).select(*s.columns, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def compare_samples(samples: DataFrame, values: DataFrame) -> DataFrame:
    """Mean, deviation (of the population) and number of each sample's values beside its parameter, or why it is left out.

    samples: parameter, sample, ord, value (number), text (of a parameter that is none). values: sample, v, unit (null
    where its image isn't calibrated). Result: parameter, sample, value, unit, mean, std, n, reason; the first that holds
    of: no parameter, categorical, no regions, not calibrated, mixed units, other unit (than the first sample that stays).
    """
    v = values.groupBy("sample").agg(F.count("*").alias("drawn"), F.count(F.when(F.col("unit").isNotNull(), F.col("v"))).alias("n"), F.min("unit").alias("unit"), F.max("unit").alias("last"), F.avg(F.when(F.col("unit").isNotNull(), F.col("v"))).alias("mean"), F.stddev_pop(F.when(F.col("unit").isNotNull(), F.col("v"))).alias("std"))
    t = samples.join(v, "sample", "left")
    number = finite(F.col("value"))
    reason = F.when(~number & F.col("text").isNull(), "no parameter").when(~number, "categorical").when(F.col("drawn").isNull(), "no regions").when(F.col("n") == 0, "not calibrated").when(F.col("unit") != F.col("last"), "mixed units")
    t = t.withColumn("reason", reason)
    first = t.where("reason is null").groupBy("parameter").agg(F.min_by("unit", F.struct("ord", "sample")).alias("first"))
    t = t.join(first, "parameter", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("unit") != F.col("first"), "other unit")))
    kept = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return t.select("parameter", "sample", "value", *[kept(c) for c in ("unit", "mean", "std", "n")], "reason")


def size_values(objects: DataFrame) -> DataFrame:
    """Sizes of objects (ds_id, px, calibrated, unit): calibrated ones if every object of the image has one, else pixels: adds v, v_unit."""
    all_ = F.min(F.col("calibrated").isNotNull()).over(W.partitionBy(DS))
    return objects.select("*", F.when(all_, F.col("calibrated")).otherwise(F.col("px")).alias("v"), F.when(all_, F.col("unit")).otherwise("px").alias("v_unit"))


def fitted_curve(fits: DataFrame, points: int = 200) -> DataFrame:
    """Counts that a fit expects per bin: grp, kind, i, x, y at points from lo to hi.

    fits: grp, kind, loc, scale, shape (as fit_all() gives them), and lo, hi, n, width of the histogram's bins.
    """
    t = fits.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    t = t.withColumn("x", F.col("lo") + F.col("i") * ((F.col("hi") - F.col("lo")) / max(1, points - 1)))
    x, scale, shape = F.col("x"), F.col("scale"), F.col("shape")
    bell = lambda z: F.exp(-z * z / 2) / (scale * math.sqrt(2 * math.pi))
    normal = bell((x - F.col("loc")) / scale)
    lognormal = F.when(x > 0, bell((F.log(x) - F.col("loc")) / scale) / x).otherwise(0.0)
    weibull = F.when(x > 0, shape / scale * F.pow(x / scale, shape - 1) * F.exp(-F.pow(x / scale, shape))).when((x == 0) & (shape == 1), 1 / scale).otherwise(0.0)
    y = F.when(scale > 0, F.when(F.col("kind") == "normal", normal).when(F.col("kind") == "lognormal", lognormal).otherwise(weibull)).otherwise(0.0)
    return t.select("grp", "kind", "i", "x", (y * F.col("n") * F.col("width")).alias("y"))


def peak_markers(lines: DataFrame) -> DataFrame:
    """One marker for each symbol and line: of chosen lines (chosen, i the order) the last, else the first of the others: symbol, line, energy, chosen."""
    best = F.max_by(F.struct("energy", "chosen"), F.struct("chosen", F.when(F.col("chosen"), F.col("i")).otherwise(-F.col("i"))))
    return lines.groupBy("symbol", "line").agg(best.alias("b")).select("symbol", "line", "b.energy", "b.chosen")


def lattice(spots: DataFrame) -> DataFrame:
    """Real cells from two spots of a centred transform: spots with y1, x1, y2, x2, h, w, pixel_size; adds ax, ay, bx, by, a, b, gamma, d1, d2, area.

    Null where a spot is the centre or both lie on one line through it.
    """
    part = lambda c, n: (F.col(c) - F.floor(F.col(n) / 2) - 1) / (F.col(n) * F.col("pixel_size"))
    t = spots.select("*", part("x1", "w").alias("_p"), part("y1", "h").alias("_q"), part("x2", "w").alias("_r"), part("y2", "h").alias("_s"))
    det = F.col("_p") * F.col("_s") - F.col("_q") * F.col("_r")
    longest = F.greatest(F.hypot("_p", "_q"), F.hypot("_r", "_s"))
    t = t.withColumn("_d", F.when(F.abs(det) > 2.220446049250313e-16 * longest * longest, det))
    t = t.select(*spots.columns, "_p", "_q", "_r", "_s", (F.col("_s") / F.col("_d")).alias("ax"), (-F.col("_r") / F.col("_d")).alias("ay"), (-F.col("_q") / F.col("_d")).alias("bx"), (F.col("_p") / F.col("_d")).alias("by"))
    a, b = F.hypot("ax", "ay"), F.hypot("bx", "by")
    cos = (F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")) / (a * b)
    return t.select(*spots.columns, "ax", "ay", "bx", "by", a.alias("a"), b.alias("b"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))).alias("gamma"), F.try_divide(F.lit(1.0), F.hypot("_p", "_q")).alias("d1"), F.try_divide(F.lit(1.0), F.hypot("_r", "_s")).alias("d2"), F.abs(F.col("ax") * F.col("by") - F.col("ay") * F.col("bx")).alias("area"))


def pair_strain(points: DataFrame, a1: tuple[float, float], a2: tuple[float, float], origin: tuple[float, float], neighbours: int = 8, reach: float | None = None) -> DataFrame:
    """Strain of each column (ds_id, id, y, x) against the lattice of a1, a2 and an origin (all x, y): exx, eyy, exy, rotation, and ux, uy.

    The displacements of a column's nearest lattice places, itself included, are fitted by a plane. Places farther than
    `reach` (three of the longer vector) are no neighbours; columns with less than three, or all on a line, have no strain.
    """
    det = a1[0] * a2[1] - a1[1] * a2[0]
    if abs(det) < 1e-9:
        raise ValueError("the lattice vectors lie on a line")
    reach = reach or 3 * max(math.hypot(*a1), math.hypot(*a2))
    dx, dy = F.col("x") - origin[0], F.col("y") - origin[1]
    t = points.select(DS, "id", "x", "y", F.rint((a2[1] * dx - a2[0] * dy) / det).alias("i"), F.rint((a1[0] * dy - a1[1] * dx) / det).alias("j"))
    t = t.select(DS, "id", "x", "y", (origin[0] + a1[0] * F.col("i") + a2[0] * F.col("j")).alias("px"), (origin[1] + a1[1] * F.col("i") + a2[1] * F.col("j")).alias("py"))
    t = t.select(DS, "id", "px", "py", (F.col("x") - F.col("px")).alias("ux"), (F.col("y") - F.col("py")).alias("uy"), F.floor(F.col("px") / reach).alias("cx"), F.floor(F.col("py") / reach).alias("cy"))
    near = F.explode(F.array(*[F.struct((F.col("cx") + a).alias("cx"), (F.col("cy") + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    other = t.select(DS, F.col("id").alias("oid"), F.col("px").alias("ox"), F.col("py").alias("oy"), F.col("ux").alias("ou"), F.col("uy").alias("ow"), near.alias("c")).select("*", "c.*").drop("c")
    cells = 1 + points.count() // COLUMNS
    p = t.repartition(cells, DS, "cx", "cy").hint("merge").join(other.repartition(cells, DS, "cx", "cy"), [DS, "cx", "cy"]).withColumn("far", F.round(F.hypot(F.col("ox") - F.col("px"), F.col("oy") - F.col("py")), 9)).where(F.col("far") <= reach)
    rank = F.row_number().over(W.partitionBy(DS, "id").orderBy("far", F.col("oid") != F.col("id"), "oid"))
    p = p.withColumn("rank", rank).where(F.col("rank") <= neighbours + 1)
    cov = lambda a, b: F.covar_pop(a, b).alias(f"{a}{b}")
    s = p.groupBy(DS, "id", "ux", "uy").agg(F.count("*").alias("n"), cov("ox", "ox"), cov("oy", "oy"), cov("ox", "oy"), cov("ox", "ou"), cov("oy", "ou"), cov("ox", "ow"), cov("oy", "ow"))
    d = F.col("oxox") * F.col("oyoy") - F.col("oxoy") * F.col("oxoy")
    s = s.withColumn("d", F.when((F.col("n") >= 4) & (d > 1e-9), d))
    slope = lambda u: ((F.col(f"ox{u}") * F.col("oyoy") - F.col(f"oy{u}") * F.col("oxoy")) / F.col("d"), (F.col(f"oy{u}") * F.col("oxox") - F.col(f"ox{u}") * F.col("oxoy")) / F.col("d"))
    (xx, xy), (yx, yy) = slope("ou"), slope("ow")
    return s.select(DS, "id", "ux", "uy", xx.alias("exx"), yy.alias("eyy"), ((xy + yx) / 2).alias("exy"), ((yx - xy) / 2).alias("rotation"))


def ancestry(steps: DataFrame) -> DataFrame:
    """The steps behind each output, along first inputs: steps (n, output, input, op) give output, depth (0 is the last step), n, op.

    Of several steps with one output the last recorded counts; a circle ends where it closes. One join per level of depth.
    """
    made = steps.where("output is not null").groupBy("output").agg(F.max_by(F.struct("n", "input", "op"), "n").alias("s")).select("output", "s.*")
    made = materialize(made, "steps")
    before = made.select(F.col("output").alias("input"), F.col("n").alias("_n"), F.col("op").alias("_op"), F.col("input").alias("_input"))
    at = made.select("output", F.lit(0).alias("depth"), "n", "op", "input", F.array("output").alias("seen"))
    levels = []
    while not levels or not at.isEmpty():
        levels.append(at.select("output", "depth", "n", "op"))
        seen = F.array_append("seen", F.col("input"))
        more = at.join(before, "input").where(~F.array_contains("seen", F.col("input")))
        at = materialize(more.select("output", (F.col("depth") + 1).alias("depth"), F.col("_n").alias("n"), F.col("_op").alias("op"), F.col("_input").alias("input"), seen.alias("seen")), "steps-before")
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def methods(chain: DataFrame) -> DataFrame:
    """The steps of ancestry() in words, first to last: output, text."""
    return chain.groupBy("output").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "op"))), lambda s: s["op"]), "; ").alias("text"))


def lattice_vectors(points: DataFrame, neighbours: int = 6, min_angle: float = 15.0, sample: int = 400, bins: int = 36) -> DataFrame:
    """Two lattice vectors from columns (ds_id, id, y, x): ds_id, a1x, a1y, a2x, a2y, ox, oy (the column nearest to the middle), spacing.

    The first `sample` columns by id look for their nearest neighbours among all columns of their raster. Those among
    themselves bound how far these are; the raster's columns meet them in blocks of BLOCK, and only those within the
    bounds are kept and ranked, so no raster is in one task. Steps of 0.3 to 1.8 times the median distance of nearest neighbours, turned to
    point to +x, are counted by direction in bins of 180 degrees; a1 is the mean of those within 12 degrees of the fullest
    one, a2 of those near the fullest of the directions more than min_angle off. Rasters of fewer than four columns, and those whose
    steps don't give two such directions with two steps each that aren't on a line, have no row.
    """
    order = F.row_number().over(W.partitionBy(DS).orderBy("id"))
    mid = points.groupBy(DS).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n")).where("n >= 4")
    mid = materialize(mid, "lattice-middles")
    p = points.join(beside(mid)(mid), DS)
    origin = p.groupBy(DS).agg(F.min_by(F.struct("x", "y"), F.struct(F.round(F.pow(F.col("x") - F.col("mx"), F.lit(2)) + F.pow(F.col("y") - F.col("my"), F.lit(2)), 9), "id")).alias("o"))
    # The first columns by id: a bound for each raster before any are ranked against each other.
    few = materialize(p.select(DS, "id", "x", "y", "n").withColumn("rank", order).where(F.col("rank") <= sample).drop("rank"), "lattice-sample")
    parts = F.ceil(F.col("n") / BLOCK)
    other = p.select(DS, F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.pmod(F.xxhash64("id"), parts).alias("part"))
    d2 = F.round(F.pow(F.col("ox") - F.col("x"), F.lit(2)) + F.pow(F.col("oy") - F.col("y"), F.lit(2)), 9)
    nearest = lambda t: t.where("oid <> id").withColumn("d2", d2).withColumn("k", F.row_number().over(W.partitionBy(DS, "id").orderBy("d2", "oid"))).where(F.col("k") <= neighbours)
    bound = nearest(few.join(few.select(DS, F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy")), DS)).where(F.col("k") == neighbours)
    few = few.join(bound.select(DS, "id", F.col("d2").alias("most")), [DS, "id"], "left")
    dealt = few.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    close = other.hint("merge").join(dealt, [DS, "part"]).where(F.coalesce(d2 <= F.col("most"), F.lit(True)))
    near = nearest(close)
    steps = materialize(near.select(DS, "k", F.sqrt("d2").alias("far"), (F.col("ox") - F.col("x")).alias("u"), (F.col("oy") - F.col("y")).alias("w")), "lattice-steps")
    spacing = steps.where("k = 1 AND far > 0").groupBy(DS).agg(F.percentile("far", 0.5).alias("spacing"))
    v = steps.join(spacing, DS).where("far > 0.3 * spacing AND far < 1.8 * spacing")
    turn = F.when((F.col("u") < 0) | ((F.abs("u") < 1e-9) & (F.col("w") < 0)), -1.0).otherwise(1.0)
    v = v.select(DS, "spacing", (turn * F.col("u")).alias("u"), (turn * F.col("w")).alias("w")).withColumn("angle", F.atan2("w", "u"))
    v = materialize(v.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("angle") + math.pi / 2) / (math.pi / bins)))), "lattice-directions")
    off = lambda c: F.abs(F.pmod(F.col("angle") - F.col(c) + math.pi / 2, F.lit(math.pi)) - math.pi / 2)
    fullest = lambda t, c: t.groupBy(DS, "bin").agg(F.count("*").alias("n")).groupBy(DS).agg(((F.max_by("bin", F.struct("n", -F.col("bin"))) + 0.5) * (math.pi / bins) - math.pi / 2).alias(c))
    mean = lambda t, c: t.groupBy(DS).agg(F.avg("u").alias(f"{c}x"), F.avg("w").alias(f"{c}y"), F.count("*").alias("n")).where("n >= 2").drop("n")
    one = v.join(fullest(v, "c1"), DS)
    a1 = mean(one.where(off("c1") <= math.radians(12)), "a1")
    rest = one.where(off("c1") > math.radians(min_angle))
    a2 = mean(rest.join(fullest(rest, "c2"), DS).where(off("c2") <= math.radians(12)), "a2")
    out = a1.join(a2, DS).join(spacing, DS).join(origin, DS)
    flat = F.abs(F.col("a1x") * F.col("a2y") - F.col("a1y") * F.col("a2x")) < 1e-6 * F.col("spacing") * F.col("spacing")
    return out.where(~flat).select(DS, "a1x", "a1y", "a2x", "a2y", F.col("o.x").alias("ox"), F.col("o.y").alias("oy"), "spacing")
