"""Crystals and diffraction: phases (name, a, b, c, alpha, beta, gamma, centering), reflections, spots, rings.

Reflections are enumerated per phase by a bounded range of indices, so a table of phases of any size is one plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.quantiles import range_of

# Lattice constants in Angstrom of cubic phases, with their centering.
CUBIC = {
    "Silicon": (5.4309, "F"), "SrTiO3": (3.9050, "P"), "MgO": (4.2112, "F"), "LaAlO3": (3.7900, "P"), "GaAs": (5.6533, "F"), "Ge": (5.6576, "F"),
    "Aluminum": (4.0495, "F"), "Copper": (3.6149, "F"), "Gold": (4.0782, "F"), "Silver": (4.0862, "F"), "Platinum": (3.9231, "F"),
    "Palladium": (3.8898, "F"), "Nickel": (3.5238, "F"), "Iron (BCC)": (2.8665, "I"), "Tungsten": (3.1648, "I"), "Chromium": (2.8839, "I"),
    "Molybdenum": (3.1472, "I"), "NiO": (4.1771, "F"), "CoO": (4.2612, "F"), "Cu2O (cuprite)": (4.2696, "P"), "InAs": (6.0583, "F"),
    "InP": (5.8688, "F"), "CdTe": (6.4810, "F"), "ZnSe": (5.6676, "F"), "CaF2 (fluorite)": (5.4626, "F"), "NaCl (halite)": (5.6402, "F"),
}
# Hexagonal and trigonal phases: a, c in Angstrom, centering.
HEXAGONAL = {
    "Sapphire (Al2O3)": (4.7589, 12.9910, "R"), "GaN (wurtzite)": (3.1890, 5.1864, "P"), "Titanium (HCP)": (2.9505, 4.6826, "P"),
    "Cobalt (HCP)": (2.5071, 4.0695, "P"), "ZnO (wurtzite)": (3.2498, 5.2066, "P"), "Fe2O3 (hematite)": (5.0356, 13.7489, "R"), "SiO2 (quartz)": (4.9134, 5.4052, "P"),
}
#: Phases whose planes one task enumerates.
PHASES = 256
PHASE = "name string, a double, b double, c double, alpha double, beta double, gamma double, centering string"


def phases(spark: SparkSession) -> DataFrame:
    """The built-in phases; others come as rows of the same schema, such as those of sources.read_cif()."""
    rows = [(n, a, a, a, 90.0, 90.0, 90.0, c) for n, (a, c) in CUBIC.items()] + [(n, a, a, c, 90.0, 90.0, 120.0, k) for n, (a, c, k) in HEXAGONAL.items()]
    return spark.createDataFrame(rows, PHASE)


def with_custom(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Phases of which a custom one replaces the built-in one of the same name in any case."""
    key = F.lower("name")
    return builtin.join(custom.select(key.alias("_k")).distinct(), key == F.col("_k"), "left_anti").unionByName(custom)


def find_phase(table: DataFrame, text: str) -> DataFrame:
    """The phase whose name holds the text in any case; of several the first by name."""
    return table.where(F.contains(F.lower("name"), F.lit(text.strip().lower()))).orderBy("name").limit(1)


def wavelength(kv: Column) -> Column:
    """Relativistic wavelength of electrons in Angstrom."""
    h, m, e, c = 6.62607015e-34, 9.1093837015e-31, 1.602176634e-19, 299792458.0
    v = kv * 1e3
    return h / F.sqrt(2 * m * e * v * (1 + v * (e / (2 * m * c * c)))) * 1e10


def d_spacing(h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    """Distance of the planes hkl of a phase's cell, by the reciprocal metric; null for 000."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    ca, cb, cg = (F.cos(F.radians(x)) for x in ("alpha", "beta", "gamma"))
    sin2 = lambda x: 1 - x * x
    u, v, w = h / a, k / b, l / c
    g = sin2(ca) * u * u + sin2(cb) * v * v + sin2(cg) * w * w + 2 * u * v * (ca * cb - cg) + 2 * v * w * (cb * cg - ca) + 2 * u * w * (ca * cg - cb)
    volume = 1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg
    return F.when(g > 0, F.sqrt(volume / g))


def allowed(h: Column, k: Column, l: Column) -> Column:  # noqa: E741
    """Whether the lattice's centering lets hkl through; R in the obverse setting."""
    even = lambda x: x % 2 == 0
    c = F.upper("centering")
    rules = {"F": even(h + k) & even(k + l), "I": even(h + k + l), "A": even(k + l), "B": even(h + l), "C": even(h + k), "R": (k + l - h) % 3 == 0}
    out = F.lit(True)
    for name, rule in rules.items():
        out = F.when(c == name, rule).otherwise(out)
    return out


def indices(table: DataFrame, most: int) -> DataFrame:
    """Allowed hkl of each phase with no index beyond `most`: the phase's columns, h, k, l, d.

    Phases are dealt by name to tasks of about PHASES each, so what a task holds doesn't grow with the table and
    aggregates by name need no other exchange.
    """
    table = table.repartition(1 + table.count() // PHASES, "name")
    span = F.sequence(F.lit(-most), F.lit(most))
    t = table.withColumn("h", F.explode(span)).withColumn("k", F.explode(span)).withColumn("l", F.explode(span))
    h, k, l = (F.col(c) for c in "hkl")  # noqa: E741
    return t.where((h != 0) | (k != 0) | (l != 0)).where(allowed(h, k, l)).withColumn("d", d_spacing(h, k, l))


def reflections(table: DataFrame, most: int = 5, lam: float = 1.5406, min_d: float = 0.0) -> DataFrame:
    """Families of planes of each phase: name, h, k, l, d, multiplicity, two_theta (degrees, null beyond the limit).

    Planes whose distances agree to 8 digits are a family. It is named by one whose first index that isn't 0 is positive,
    of the fewest negative indices, then the largest sum, then the smallest |h|, |k|, |l|.
    """
    t = indices(table, most).where(F.col("d") >= min_d)
    positive = F.expr("h > 0 OR h = 0 AND k > 0 OR h = 0 AND k = 0 AND l > 0")
    negative = F.expr("cast(h < 0 as int) + cast(k < 0 as int) + cast(l < 0 as int)")
    order = F.struct(~positive, negative, F.expr("-(h + k + l)"), F.abs("h"), F.abs("k"), F.abs("l"))
    g = t.groupBy("name", F.round("d", 8).alias("dr")).agg(F.avg("d").alias("d"), F.count("*").alias("multiplicity"), F.min_by(F.struct("h", "k", "l"), order).alias("b"))
    s = lam / (2 * F.col("d"))
    return g.select("name", "b.h", "b.k", "b.l", "d", "multiplicity", F.when(s <= 1, 2 * F.degrees(F.asin(s))).alias("two_theta"))


def zone_reflections(table: DataFrame, zone: tuple[int, int, int], most: int = 5) -> DataFrame:
    """Reflections of the zero-order Laue zone: those with h u + k v + l w = 0."""
    u, v, w = zone
    return indices(table, most).where(F.col("h") * u + F.col("k") * v + F.col("l") * w == 0).select("name", "h", "k", "l", "d")


def structure_factor(planes: DataFrame, basis: DataFrame, debye_waller: float = 0.0) -> DataFrame:
    """Intensity of each reflection by name, from the basis (name, weight, x, y, z), a bounded table: adds intensity.

    The square of the sum of weight exp(-B s^2) exp(2 pi i (h x + k y + l z)), s = 1 / (2 d).
    """
    t = planes.join(F.broadcast(basis), "name")
    phase = 2 * math.pi * (F.col("h") * F.col("x") + F.col("k") * F.col("y") + F.col("l") * F.col("z"))
    f = F.col("weight") * F.exp(-debye_waller / (4 * F.col("d") * F.col("d")))
    g = t.groupBy(*planes.columns).agg(F.sum(f * F.cos(phase)).alias("re"), F.sum(f * F.sin(phase)).alias("im"))
    return g.select(*planes.columns, (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("intensity"))


def strong(intensities: DataFrame, least: float = 0.01) -> DataFrame:
    """Intensities as a share of the largest of their phase, those below `least` left out."""
    rel = F.try_divide(F.col("intensity"), F.max("intensity").over(W.partitionBy("name")))
    return intensities.withColumn("relative", rel).where(F.col("relative") >= least)


def ring_radius(d: Column, width: int, pixel_size: float, camera_length: float | None = None, kv: float = 200.0) -> Column:
    """Radius in pixels of the ring of a distance: of a transform without a camera length, else of a pattern; null beyond the limit."""
    if camera_length is None:
        return F.when(d > 0, width * pixel_size / d)
    s = wavelength(F.lit(kv)) / (2 * d)
    return F.when((d > 0) & (s <= 1), camera_length * F.tan(2 * F.asin(s)) / pixel_size)


def measured_d(spots: DataFrame, height: int, width: int, pixel_size: float, camera_length: float | None = None, kv: float = 200.0) -> DataFrame:
    """Distances of spots (spot, y, x from 1) from their radius to the centre: adds d; a spot at the centre has none."""
    r = F.hypot(F.col("y") - (height // 2 + 1), F.col("x") - (width // 2 + 1))
    top = F.lit(width * pixel_size) if camera_length is None else wavelength(F.lit(kv)) * (camera_length / pixel_size)
    return spots.withColumn("d", F.when(r > 0, top / r))


def index_spots(spots: DataFrame, table: DataFrame, tolerance: float = 0.05, most: int = 5) -> DataFrame:
    """Share of the spots (spot, d) that each phase explains within a relative tolerance: name, matched, score, error, rank.

    A spot takes the nearest family of a phase; phases rank by score, then by mean error (to 12 digits, as the order in which
    a mean is summed changes later ones), then by name. No spot meets a family: each family of a lattice has an interval of
    distances, and the spots in it and their sum are differences of running counts and sums over all spots, which are sorted
    within ranges of values. Phases of one lattice share its families.
    """
    cells = F.sort_array(F.collect_set(F.struct("a", "b", "c", "alpha", "beta", "gamma", "centering")))
    named = table.where("name is not null").groupBy("name").agg(cells.alias("cells"))
    lattices = named.groupBy("cells").agg(F.min("name").alias("lattice"))
    ends = _family_ends(reflections(lattices.select(F.col("lattice").alias("name"), F.inline("cells")), most), tolerance)
    finite = spots.where(F.abs("d") < float("inf")).groupBy(F.col("d").alias("v")).agg(F.count("*").alias("n"))
    none = F.lit(None)
    t = finite.select("v", "n", none.cast("string").alias("lattice"), none.cast("double").alias("ref"), none.cast("int").alias("sign")).unionByName(ends.withColumn("n", F.lit(0).cast("long")))
    t = t.withColumn("range", range_of(F.col("v")))
    upto = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = t.groupBy("range").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"))
    before = before.select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(upto), F.lit(0.0)).alias("s0"))
    run = W.partitionBy("range").orderBy("v")
    t = t.withColumn("n1", F.sum("n").over(run)).withColumn("s1", F.sum(F.col("n") * F.col("v")).over(run)).where("lattice is not null").join(before, "range")
    # Over the three ends of an interval: spots up to the upper one less those up to the lower one, and what the sums of
    # (d - ref) / ref above ref and (ref - d) / ref below come to.
    count, total = F.col("n0") + F.col("n1"), F.col("s0") + F.col("s1")
    far = F.when(F.col("sign") == 0, -2).otherwise(1) * (total / F.col("ref") - count)
    best = t.groupBy("lattice").agg(F.sum(F.col("sign") * count).alias("matched"), F.sum(far).alias("far")).where("matched > 0")
    best = named.join(lattices, "cells").join(best, "lattice").select("name", "matched", F.greatest(F.lit(0.0), F.col("far") / F.col("matched")).alias("error"))
    n = spots.agg(F.count("*").alias("n"))
    out = table.select("name").join(best, "name", "left").join(F.broadcast(n))
    out = out.select("name", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), F.coalesce(F.try_divide(F.col("matched"), F.col("n")), F.lit(0.0)).alias("score"), "error")
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.round("error", 12).asc_nulls_last(), "name")))


def _family_ends(families: DataFrame, tolerance: float) -> DataFrame:
    """Of each family (name, d) the distances whose nearest one it is, within the tolerance: lattice, ref, and three rows of v, sign.

    Sign -1 is the largest distance below the interval, 0 the family's own and 1 the largest one in it. Between two families
    distances go to the nearer one up to their harmonic mean, where both are as far off relative to themselves.
    """
    ref, order = F.col("ref"), W.partitionBy("lattice").orderBy("ref")

    def largest(about: Column, holds) -> Column:
        """Of the doubles next to this value the largest for which a comparison holds as it is computed."""
        return F.array_max(F.filter(F.transform(F.sequence(F.lit(-8), F.lit(8)), lambda i: about + i * (about * 2.0**-53)), holds))

    t = families.select(F.col("name").alias("lattice"), F.col("d").alias("ref"))
    over = F.lead("ref").over(order)
    top = F.least(largest(ref * (1 + tolerance), lambda v: (v - ref) / ref < tolerance), 2 * ref * over / (ref + over))
    t = t.withColumn("top", F.greatest(ref, top))
    t = t.withColumn("low", F.least(ref, F.greatest(largest(ref * (1 - tolerance), lambda v: (ref - v) / ref >= tolerance), F.lag("top").over(order))))
    end = lambda c, sign: F.struct(F.col(c).alias("v"), F.lit(sign).alias("sign"))
    return t.select("lattice", "ref", F.inline(F.array(end("low", -1), end("ref", 0), end("top", 1))))
