"""From spectra to compositions: corrections, errors, edges, identification. Inputs are those of operators.spectral.

Element tables are small and broadcast; everything that grows with pixels is an aggregate or a window over one pixel.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.measure import fraction_sigma
from lumenframe.operators.raster import small_side
from lumenframe.operators.spectral import K_FACTORS, K_LINES, LEAST, MASSES, PIXEL, _law, assign_lines, background, centroid, detect_peaks, within
from lumenframe.operators.texture import band_profile
from lumenframe.session import materialize

# The elements in order of atomic number.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I "
    "Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U"
).split()
Z = {s: i + 1 for i, s in enumerate(ELEMENTS)}
# Densities in g/cm3.
DENSITIES = {
    "B": 2.34, "C": 2.267, "N": 0.001251, "O": 0.001429, "F": 0.001696, "Na": 0.968, "Mg": 1.738, "Al": 2.70, "Si": 2.3296, "P": 1.823, "S": 2.07,
    "Cl": 0.003214, "K": 0.862, "Ca": 1.55, "Sc": 2.985, "Ti": 4.507, "V": 6.11, "Cr": 7.19, "Mn": 7.47, "Fe": 7.874, "Co": 8.90, "Ni": 8.908, "Cu": 8.96,
    "Zn": 7.14, "Ga": 5.91, "Ge": 5.323, "As": 5.727, "Sr": 2.64, "Y": 4.472, "Zr": 6.52, "Nb": 8.57, "Mo": 10.28, "Pd": 12.023, "Ag": 10.49, "In": 7.31,
    "Sn": 7.265, "Ba": 3.51, "La": 6.145, "Hf": 13.31, "Ta": 16.69, "W": 19.25, "Pt": 21.45, "Au": 19.32, "Pb": 11.34,
}
# Onsets in eV of the edges that a survey looks for.
K_EDGES = {"Li": 55, "B": 188, "C": 284, "N": 401, "O": 532, "F": 685, "Na": 1072, "Mg": 1305, "Al": 1560, "Si": 1839}
L_EDGES = {
    "Al": 73, "Si": 99, "P": 135, "S": 165, "Cl": 200, "Ar": 245, "K": 294, "Ca": 346, "Sc": 397, "Ti": 456, "V": 513, "Cr": 575, "Mn": 640, "Fe": 708,
    "Co": 778, "Ni": 855, "Cu": 931, "Zn": 1020, "Ga": 1115, "Ge": 1217, "As": 1323, "Se": 1436, "Br": 1550, "Sr": 1940, "Y": 2080, "Zr": 2222,
}
M_EDGES = {"Nb": 205, "Mo": 227, "Ru": 279, "Pd": 335, "Ag": 367, "Sn": 485, "Sb": 528, "Ba": 781, "La": 832, "Ce": 883, "W": 1809, "Pt": 2122, "Au": 2206}
# Fixed values of the detector: Fano factor, eV per pair, and the width in eV at the energy in keV that anchors the noise.
FANO, PAIR_EV, ANCHOR_KEV, ANCHOR_EV = 0.12, 3.85, 5.899, 130.0
FWHM = 2 * math.sqrt(2 * math.log(2))
# Significance from which a finding is strong, clear or weak.
BANDS = (("strong", 100.0), ("clear", 30.0), ("weak", 10.0))


def elements(spark: SparkSession, symbols: list[str]) -> DataFrame:
    """symbol, z, mass, density of the asked elements; 1, 1 and 5 where nothing is known."""
    dense = lambda s: DENSITIES.get(s, 5.0)
    return spark.createDataFrame([(s, float(Z.get(s, 1)), MASSES.get(s, 1.0), dense(s)) for s in symbols], "symbol string, z double, mass double, density double")


# Energies (keV) of the K lines that absorption is known for.
ABSORBED_KEV = {
    "C": 0.277, "N": 0.392, "O": 0.525, "F": 0.677, "Na": 1.041, "Mg": 1.254, "Al": 1.487, "Si": 1.740, "P": 2.013, "S": 2.308,
    "Cl": 2.622, "K": 3.314, "Ca": 3.692, "Ti": 4.511, "V": 4.952, "Cr": 5.415, "Mn": 5.899, "Fe": 6.404, "Co": 6.930, "Ni": 7.478,
    "Cu": 8.048, "Zn": 8.639, "Ga": 9.252, "Ge": 9.886, "As": 10.544, "Sr": 14.165, "Y": 14.958, "Zr": 15.775, "Nb": 16.615,
    "Mo": 17.479, "Ba": 32.194, "La": 33.442,
}


def absorption(emitter: str, absorber: str) -> float:
    """Mass absorption (cm2/g) of the emitter's K line in the absorber; 100 for emitters without a known one and unknown absorbers."""
    if emitter not in ABSORBED_KEV or absorber not in MASSES or absorber not in Z:
        return 100.0
    wavelength_cm = 12.398 / ABSORBED_KEV[emitter] * 1e-8
    return 1e22 * Z[absorber] ** 4 * wavelength_cm**3 / MASSES[absorber]


def absorption_pairs(found: DataFrame) -> DataFrame:
    """absorption_table() of the elements found (ds_id, symbol) in each spectrum, those with a known emitter and absorber: ds_id, emitter, absorber, mac."""
    rows = [(s, ABSORBED_KEV.get(s), float(Z[s]) if s in Z else None, MASSES.get(s)) for s in sorted({*ABSORBED_KEV, *MASSES})]
    known = found.select("ds_id", "symbol").distinct().join(found.sparkSession.createDataFrame(rows, "symbol string, kev double, z double, mass double"), "symbol")
    a = known.where("kev is not null").select("ds_id", F.col("symbol").alias("emitter"), "kev")
    b = known.where("z is not null AND mass is not null").select("ds_id", F.col("symbol").alias("absorber"), "z", "mass")
    return a.join(b, "ds_id").select("ds_id", "emitter", "absorber", F.expr("1e22D * z * z * z * z * power(12.398D / kev * 1e-8D, 3) / mass").alias("mac"))


def absorption_table(spark: SparkSession, symbols: list[str]) -> DataFrame:
    """emitter, absorber, mac for all pairs of the asked elements."""
    return spark.createDataFrame([(a, b, absorption(a, b)) for a in symbols for b in symbols], "emitter string, absorber string, mac double")


def shares(maps: DataFrame) -> DataFrame:
    """Cliff-Lorimer weight fractions of each pixel that has counts: adds w."""
    q = F.greatest("v", F.lit(0.0)) * F.col("k")
    t = maps.withColumn("q", q).withColumn("qs", F.sum("q").over(W.partitionBy(*PIXEL))).where("qs > 0")
    return t.select(*PIXEL, "symbol", "mass", (F.col("q") / F.col("qs")).alias("w"))


def composition_profile(maps: DataFrame, x1: float, y1: float, x2: float, y2: float, width: int = 1, points: int | None = None) -> DataFrame:
    """Atomic percent along a segment, over `width` parallel lines, at `points` samples: ds_id, symbol, i, distance, atomic_pct. Pixels without counts leave gaps."""
    a = F.col("w") / F.col("mass")
    at = shares(maps).withColumn("v", 100 * a / F.sum(a).over(W.partitionBy(*PIXEL)))
    lines = band_profile(at.select(F.struct("ds_id", "symbol").alias("ds_id"), "y", "x", "v"), x1, y1, x2, y2, width, points=points)
    return lines.select("ds_id.ds_id", "ds_id.symbol", "i", "distance", F.col("v").alias("atomic_pct"))


def _mean_shares(w: DataFrame) -> DataFrame:
    """Mean weight fractions per raster and element, summing to 1; one row per element of a raster."""
    m = w.groupBy("ds_id", "symbol").agg(F.avg("w").alias("w"))
    return m.select("ds_id", "symbol", (F.col("w") / F.sum("w").over(W.partitionBy("ds_id"))).alias("w"))


def correction_factors(mean: DataFrame, symbols: list[str], thickness_nm: float, take_off: float, density: float | None = None) -> DataFrame:
    """Atomic number and absorption factors at a mean composition: ds_id, symbol, z_factor, a_factor."""
    spark = mean.sparkSession
    m = mean.join(F.broadcast(elements(spark, symbols)), "symbol")
    over = W.partitionBy("ds_id")
    rho = F.lit(float(density)) if density else F.sum(F.col("w") * F.col("density")).over(over)
    m = m.select("ds_id", "symbol", "w", "z", F.sum(F.col("w") * F.col("z")).over(over).alias("zm"), rho.alias("rho"))
    depth = thickness_nm * 1e-7 / math.sin(math.radians(take_off))
    mac = F.broadcast(absorption_table(spark, symbols))
    chi = mean.join(mac, F.col("symbol") == F.col("absorber")).groupBy("ds_id", F.col("emitter").alias("symbol")).agg(F.sum(F.col("mac") * F.col("w")).alias("m"))
    c = F.col("m") * F.col("rho") * depth
    a = F.when(F.abs(c) >= 1e-6, c / (1 - F.exp(-c))).otherwise(1.0)
    z = 1 + (F.col("zm") / F.col("z") - 1) * (1 - math.exp(-thickness_nm / 200))
    return m.join(chi, ["ds_id", "symbol"]).select("ds_id", "symbol", z.alias("z_factor"), a.alias("a_factor"))


def zaf(maps: DataFrame, symbols: list[str], thickness_nm: float = 100.0, take_off: float = 20.0, density: float | None = None, iterations: int = 3) -> DataFrame:
    """Mean weight and atomic percent of thin films after corrections at the mean composition: ds_id, symbol, weight_pct, atomic_pct, z_factor, a_factor.

    maps: element_maps(); their shares are written once, and each iteration is one aggregate over these. Fluorescence is left out.
    """
    if not 0 < take_off < 90:
        raise ValueError("take_off must be between 0 and 90 degrees")
    first = w = materialize(shares(maps), "zaf-shares")
    for _ in range(max(1, iterations)):
        f = correction_factors(_mean_shares(w), symbols, thickness_nm, take_off, density)
        t = first.join(f, ["ds_id", "symbol"]).withColumn("u", F.col("w") / (F.col("z_factor") * F.col("a_factor")))
        w = t.select(*PIXEL, "symbol", "mass", (F.col("u") / F.sum("u").over(W.partitionBy(*PIXEL))).alias("w"), "z_factor", "a_factor")
    a = F.col("w") / F.col("mass")
    w = w.withColumn("a", a / F.sum(a).over(W.partitionBy(*PIXEL)))
    return w.groupBy("ds_id", "symbol").agg((100 * F.avg("w")).alias("weight_pct"), (100 * F.avg("a")).alias("atomic_pct"), F.first("z_factor").alias("z_factor"), F.first("a_factor").alias("a_factor"))


def dose(current_na: float, seconds: float) -> float:
    """Electrons of a beam current over a live time."""
    return current_na * 1e-9 * seconds / 1.602176634e-19


def zeta(maps: DataFrame, symbols: list[str], factors: list[float], electrons: float, take_off: float = 20.0, absorbing: bool = True, iterations: int = 5) -> DataFrame:
    """Weight fractions and mass thickness (kg/m2) of each pixel that has counts: ds_id, y, x, symbol, weight_pct, mass_thickness.

    factors: kg/m2 per element. Self-absorption is iterated within the row of a pixel, which holds one count per element.
    """
    if electrons <= 0 or min(factors) <= 0:
        raise ValueError("the dose and the factors must be positive")
    n = range(len(symbols))
    v = F.greatest("v", F.lit(0.0))
    px = maps.groupBy(*PIXEL).agg(F.array(*[F.sum(F.when(F.col("symbol") == s, v).otherwise(0.0)) for s in symbols]).alias("c")).where(F.aggregate("c", F.lit(0.0), lambda a, b: a + b) > 0)
    z = [F.lit(float(f)) for f in factors]
    total = lambda g: sum((g[i] * z[i] for i in n), F.lit(0.0))
    csc = 1 / math.sin(math.radians(take_off))

    def absorbed(g: Column, _: Column) -> Column:
        out = []
        for i in n:
            chi = csc * sum((absorption(symbols[i], symbols[j]) / 10 * g[j] * z[j] for j in n), F.lit(0.0)) / electrons
            out.append(F.col("c")[i] * F.when(F.abs(chi) >= 1e-6, chi / (1 - F.exp(-chi))).otherwise(1.0))
        return F.array(*out)

    steps = max(1, iterations) - 1 if absorbing else 0
    px = px.withColumn("g", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("c"), absorbed)) if steps else px.withColumn("g", F.col("c"))
    px = px.withColumn("q", total(F.col("g")))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), (100 * F.col("g")[i] * z[i] / F.col("q")).alias("weight_pct")) for i, s in enumerate(symbols)]))
    return px.select(*PIXEL, each.alias("e"), (F.col("q") / electrons).alias("mass_thickness")).select(*PIXEL, "e.*", "mass_thickness")


def composition_sigma(maps: DataFrame) -> DataFrame:
    """Weight and atomic percent of each raster's summed counts with their counting errors: ds_id, symbol, weight_pct, weight_sigma, atomic_pct, atomic_sigma."""
    t = maps.groupBy("ds_id", "symbol", "k", "mass").agg(F.sum("v").alias("n"))
    err = F.sqrt(F.greatest("n", F.lit(0.0)))
    w = fraction_sigma(t.select("ds_id", "symbol", (F.col("k") * F.col("n")).alias("q"), (F.col("k") * err).alias("q_sigma")), "ds_id")
    a = fraction_sigma(t.select("ds_id", "symbol", (F.col("k") / F.col("mass") * F.col("n")).alias("q"), (F.col("k") / F.col("mass") * err).alias("q_sigma")), "ds_id")
    pick = lambda d, p: d.select("ds_id", "symbol", (100 * F.col("fraction")).alias(f"{p}_pct"), F.col("fraction_sigma").alias(f"{p}_sigma"))
    return pick(w, "weight").join(pick(a, "atomic"), ["ds_id", "symbol"])


def fano_fwhm(kev: Column) -> Column:
    """Width in eV of a line, through the detector's anchor; 0 where the model has none."""
    slope = FWHM**2 * FANO * PAIR_EV
    return F.sqrt(F.greatest(F.lit(0.0), ANCHOR_EV**2 + slope * (kev - ANCHOR_KEV) * 1000))


def split_artifacts(artifacts: DataFrame, lines: DataFrame, clearance: float = 2.0) -> DataFrame:
    """Artifacts with `blocked`: whether a line lies within clearance times the sum of both widths (one sigma)."""
    sigma = lambda c: fano_fwhm(c) / FWHM / 1000
    line = F.broadcast(lines.select(F.col("energy").alias("line_energy")))
    near = F.abs(F.col("energy") - F.col("line_energy")) < clearance * (sigma(F.col("energy")) + sigma(F.col("line_energy")))
    return artifacts.join(line, near, "left_semi").withColumn("blocked", F.lit(True)).unionByName(artifacts.join(line, near, "left_anti").withColumn("blocked", F.lit(False)))


def continuum(spectrum: DataFrame, e0_kev: float, exclude: DataFrame | None = None) -> DataFrame:
    """Bremsstrahlung (e0 - e) / e scaled to each spectrum: ds_id, ch, e, continuum, net (0 at least).

    Weights are 1 / max(counts, 1). exclude: windows lo, hi that don't count, a bounded table; nor do channels from e0 on.
    """
    c = F.when(F.col("e") < e0_kev, (e0_kev - F.col("e")) / F.greatest(F.col("e"), F.lit(1e-9))).otherwise(0.0)
    used = spectrum.where(F.col("e") < e0_kev)
    if exclude is not None:
        used = used.join(F.broadcast(exclude.select("lo", "hi")), within(F.col("lo"), F.col("hi")), "left_anti")
    wt = 1 / F.greatest(F.col("v"), F.lit(1.0))
    fit = used.groupBy("ds_id").agg(F.greatest(F.lit(0.0), F.try_divide(F.sum(wt * c * F.col("v")), F.sum(wt * c * c))).alias("amp"))
    return spectrum.join(fit, "ds_id").select("ds_id", "ch", "e", (F.col("amp") * c).alias("continuum"), F.greatest(F.lit(0.0), F.col("v") - F.col("amp") * c).alias("net"))


def recalibrate(spectrum: DataFrame, anchors: list[float], search: float = 0.15) -> DataFrame:
    """Gain and offset that carry the centroids around the anchor energies to them: ds_id, gain, offset, n; one anchor shifts only."""
    c = centroid(spectrum, anchors, search).where("centre is not null").groupBy("ds_id")
    a, b = F.regr_slope("anchor", "centre"), F.regr_intercept("anchor", "centre")
    return c.agg(F.coalesce(a, F.lit(1.0)).alias("gain"), F.coalesce(b, F.avg(F.col("anchor") - F.col("centre"))).alias("offset"), F.count("*").alias("n"))


def pixel_spectrum(cube: DataFrame, pixels: DataFrame) -> DataFrame:
    """Sum spectrum of the listed pixels (ds_id, y, x); one listed twice counts once."""
    return cube.join(pixels, PIXEL, "left_semi").groupBy("ds_id", "ch", "e").agg(F.sum("v").alias("v"))


def window_readout(spectrum: DataFrame, windows: DataFrame) -> DataFrame:
    """Counts of windows (id, lo, hi) above the mean rate of flanks as wide as they are: ds_id, id, gross, background, net, sigma, share.

    net may be negative; sigma counts the flanks' error as well; a window without channels has no row.
    """
    w = F.broadcast(windows.select("id", "lo", "hi", (F.col("hi") - F.col("lo")).alias("width")))
    t = spectrum.withColumn("total", F.sum("v").over(W.partitionBy("ds_id"))).join(w, within(F.col("lo") - F.col("width"), F.col("hi") + F.col("width")))
    left, right = F.col("e") < F.col("lo"), F.col("e") > F.col("hi")
    side = lambda c: (F.sum(F.when(c, F.col("v"))), F.count(F.when(c, 1)))
    (sl, nl), (sr, nr) = side(left), side(right)
    inside = ~left & ~right
    g = t.groupBy("ds_id", "id").agg(F.sum(F.when(inside, F.col("v"))).alias("gross"), F.count(F.when(inside, 1)).alias("n"), sl.alias("sl"), nl.alias("nl"), sr.alias("sr"), nr.alias("nr"), F.first("total").alias("total")).where("n > 0")
    sides = F.when((F.col("nl") > 0) & (F.col("nr") > 0), 2).otherwise(1)
    scale = lambda m: F.when(F.col(m) > 0, F.col("n") / F.col(m) / sides).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    back = scale("nl") * zero("sl") + scale("nr") * zero("sr")
    var = F.greatest(F.lit(0.0), F.col("gross") + F.pow(scale("nl"), F.lit(2)) * zero("sl") + F.pow(scale("nr"), F.lit(2)) * zero("sr"))
    return g.select("ds_id", "id", "gross", back.alias("background"), (F.col("gross") - back).alias("net"), F.sqrt(var).alias("sigma"), F.try_divide(F.col("gross") - back, F.col("total")).alias("share"))


def band(significance: Column) -> Column:
    out = F.lit("trace")
    for name, least in reversed(BANDS):
        out = F.when(significance >= least, name).otherwise(out)
    return out


def identify_elements(spectrum: DataFrame, tolerance: float = 0.15, half_window: float = 0.085) -> DataFrame:
    """Elements with a line at a peak: ds_id, symbol, energy, net, significance, band, relative (to the strongest, 0 to 1)."""
    near = assign_lines(detect_peaks(spectrum), tolerance)
    best = near.groupBy("ds_id", "symbol").agg(F.min_by("energy", F.struct(F.abs(F.col("e") - F.col("energy")), "ch", "energy")).alias("energy"))
    t = best.select("symbol", "energy").distinct()
    read = window_readout(spectrum, t.select(F.col("symbol").alias("id"), (F.col("energy") - half_window).alias("lo"), (F.col("energy") + half_window).alias("hi")))
    s = best.join(read.withColumnRenamed("id", "symbol"), ["ds_id", "symbol"])
    sig = F.coalesce(F.try_divide(F.col("net"), F.col("sigma")), F.lit(0.0))
    top = F.max("net").over(W.partitionBy("ds_id"))
    return s.select("ds_id", "symbol", "energy", "net", sig.alias("significance"), band(sig).alias("band"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("net"), top), F.lit(0.0)))).alias("relative"))


def window_conflicts(windows: DataFrame) -> DataFrame:
    """Pairs of windows (id, energy, lo, hi), a bounded table, that overlap or whose lines are closer than the detector's width: a, b, overlap, close."""
    one = lambda p: windows.select(*[F.col(c).alias(f"{c}_{p}") for c in ("id", "energy", "lo", "hi")])
    overlap = (F.col("lo_a") < F.col("hi_b")) & (F.col("lo_b") < F.col("hi_a"))
    close = F.abs(F.col("energy_a") - F.col("energy_b")) < fano_fwhm((F.col("energy_a") + F.col("energy_b")) / 2) / 1000
    pairs = one("a").join(F.broadcast(one("b")), (F.col("id_a") < F.col("id_b")) & (overlap | close))
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), overlap.alias("overlap"), close.alias("close"))


def edge_table(spark: SparkSession) -> DataFrame:
    """symbol, edge, onset (eV)."""
    rows = [(s, n, float(e)) for n, t in (("K", K_EDGES), ("L23", L_EDGES), ("M45", M_EDGES)) for s, e in t.items()]
    return spark.createDataFrame(rows, "symbol string, edge string, onset double")


def identify_edges(spectrum: DataFrame, fit_width: float = 50.0, width: float = 50.0, gap: float = 2.0) -> DataFrame:
    """Jump at each tabulated edge that the axis (eV) holds with both windows: ds_id, symbol, edge, onset, net, significance, band."""
    axis = spectrum.groupBy("ds_id").agg(F.min("e").alias("e0"), F.max("e").alias("e1"))
    edges = axis.join(F.broadcast(edge_table(spectrum.sparkSession)), (F.col("onset") - gap - fit_width >= F.col("e0")) & (F.col("onset") + width <= F.col("e1")))
    t = spectrum.join(small_side(edges), "ds_id").where(within(F.col("onset") - gap - fit_width, F.col("onset") + width))
    fit, sig = F.col("e") <= F.col("onset") - gap, F.col("e") >= F.col("onset")
    x, y = _law("powerlaw")
    law = t.where(fit).groupBy("ds_id", "symbol", "edge").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icept"))
    net = F.sum(F.greatest(F.lit(0.0), F.col("v") - F.exp(F.col("icept") + F.col("slope") * x)))
    s = t.where(sig).join(law.where("slope is not null"), ["ds_id", "symbol", "edge"]).groupBy("ds_id", "symbol", "edge", "onset").agg(net.alias("net"), F.sum("v").alias("gross"), F.count("*").alias("n")).where("n >= 2")
    strength = F.coalesce(F.try_divide(F.col("net"), F.sqrt(F.greatest("gross", F.lit(0.0)))), F.lit(0.0))
    return s.select("ds_id", "symbol", "edge", "onset", "net", strength.alias("significance"), band(strength).alias("band"))


def cross_section(shell: Column, onset: Column, delta: Column, e0_kv: float, beta_mrad: float) -> Column:
    """Partial cross-section (m2) of a K or L edge in the hydrogenic model, by trapezoids; null for other shells."""
    a0, ry, rest = 5.29177210903e-11, 13.605693122994, 510998.95
    gamma = 1 + e0_kv * 1e3 / rest
    t = rest / 2 * (1 - 1 / gamma**2)
    power = F.when(shell == "K", 2.7).when(shell == "L", 1.7)
    fill = F.when(shell == "K", 2.0).when(shell == "L", 4.0)
    form = lambda e: F.pow(onset / e, power)
    angle = lambda e: F.log1p(F.pow(beta_mrad * 1e-3 * 2 * gamma * t / e, F.lit(2)))

    def area(f, to: Column, n: int) -> Column:
        step = to / (n - 1)
        end = lambda i: F.when(i.isin(0, n - 1), 0.5).otherwise(1.0)
        return step * F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + end(i) * f(onset + i * step))

    norm = area(form, F.greatest(50 * delta, F.lit(5000.0)), 4000)
    return area(lambda e: 4 * math.pi * a0**2 * (ry / e) * (ry / t) * form(e) * angle(e), delta, 400) * fill / norm


def edge_quantify(cube: DataFrame, edges: DataFrame, e0_kv: float, beta_mrad: float, method: str = "powerlaw") -> DataFrame:
    """Atomic percent of each pixel from core-loss edges: ds_id, y, x, element, intensity, ratio, atomic_pct.

    edges, a bounded table: element, shell (K or L), onset, s0, s1 (signal window), b0, b1 (background window), in the units of e.
    One range join for all edges; the intensity is the area of the residuals that aren't negative, over the channels.
    """
    sigma = cross_section(F.col("shell"), F.col("onset"), F.col("s1") - F.col("s0"), e0_kv, beta_mrad)
    t = F.broadcast(edges.withColumn("sigma", sigma))
    fit, sig = within(F.col("b0"), F.col("b1")), within(F.col("s0"), F.col("s1"))
    used = cube.join(t, fit | sig)
    x, y = _law(method)
    key = [*PIXEL, "element"]
    law = used.where(fit).groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icept"))
    net = F.greatest(F.lit(0.0), F.col("v") - F.exp(F.col("icept") + F.col("slope") * x))
    s = used.where(sig).join(law, key).select(*key, "sigma", "e", net.alias("s"))
    w = W.partitionBy(*key).orderBy("e")
    s = s.withColumn("a", (F.lead("e").over(w) - F.col("e")) * (F.lead("s").over(w) + F.col("s")) / 2)
    s = s.groupBy(*key, "sigma").agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("intensity"))
    s = s.withColumn("ratio", F.coalesce(F.try_divide(F.col("intensity"), F.col("sigma")), F.lit(0.0)))
    return s.select(*key, "intensity", "ratio", F.coalesce(100 * F.try_divide(F.col("ratio"), F.sum("ratio").over(W.partitionBy(*PIXEL))), F.lit(0.0)).alias("atomic_pct"))


def near_edge(spectrum: DataFrame, onset: float, fit: tuple[float, float], window: tuple[float, float] = (0.0, 30.0), jump: float = 5.0, method: str = "powerlaw") -> DataFrame:
    """Fine structure past an edge, over the mean signal of its first `jump` units: ds_id, rel (energy from the onset), intensity."""
    if not fit[0] < fit[1] < onset:
        raise ValueError("the fit window must increase and end below the onset")
    s = background(spectrum, fit, method).select("ds_id", "e", "signal")
    step = F.avg(F.when(within(onset, onset + jump), F.col("signal"))).over(W.partitionBy("ds_id"))
    s = s.withColumn("jump", F.greatest(step, F.lit(LEAST))).where(within(onset + window[0], onset + window[1]))
    return s.select("ds_id", (F.col("e") - onset).alias("rel"), (F.col("signal") / F.col("jump")).alias("intensity"))


def savgol_weights(window: int, polyorder: int, order: int = 0, delta: float = 1.0) -> np.ndarray:
    """Weights of the window's values (columns) for the fitted polynomial's derivative at each of its places (rows)."""
    if window % 2 == 0 or window <= polyorder or not 0 <= order <= polyorder or not math.isfinite(delta) or delta == 0:
        raise ValueError("window must be odd and above polyorder, order at most polyorder, delta finite and not 0")
    at = np.arange(window) - window // 2
    fit = np.linalg.pinv(np.vander(at, polyorder + 1, increasing=True).astype(float))
    rise = np.array([[math.perm(p, order) * float(a) ** (p - order) if p >= order else 0.0 for p in range(polyorder + 1)] for a in at])
    return rise @ fit / delta**order


def savgol(spectrum: DataFrame, window: int, polyorder: int, order: int = 0, delta: float = 1.0) -> DataFrame:
    """Savitzky-Golay smoothing (order 0) or a derivative of spectra over channels 0, 1, ...; places near an end use the last full window.

    Spectra shorter than the window have no rows.
    """
    spark, half = spectrum.sparkSession, window // 2
    k = savgol_weights(window, polyorder, order, delta)
    weights = spark.createDataFrame([(i - half, j - half, float(k[i, j])) for i in range(window) for j in range(window)], "place int, off int, k double")
    n = spectrum.groupBy("ds_id").agg(F.count("*").cast("int").alias("n"))
    centre = F.greatest(F.lit(half), F.least(F.col("n") - 1 - half, F.col("ch")))
    t = spectrum.join(n, "ds_id").where(F.col("n") >= window).select("ds_id", F.col("ch").alias("at"), F.col("e").alias("at_e"), centre.alias("centre"))
    t = t.join(F.broadcast(weights), F.col("at") - F.col("centre") == F.col("place")).select("ds_id", "at", "at_e", (F.col("centre") + F.col("off")).alias("ch"), "k")
    return t.join(spectrum, ["ds_id", "ch"]).groupBy("ds_id", F.col("at").alias("ch"), F.col("at_e").alias("e")).agg(F.sum(F.col("k") * F.col("v")).alias("v"))


def edge_atomic_sigma(spectrum: DataFrame, edges: DataFrame) -> DataFrame:
    """Counting errors of atomic percents: ds_id, element, atomic_pct, atomic_sigma (percentage points).

    edges, a bounded table: element, s0, s1 (signal window), ratio (areal), sigma (cross-section). The variance of each edge's
    integral by trapezoids is that of the gross counts within its window; windows of fewer than two channels and edges without a
    cross-section have a null error.
    """
    t = spectrum.join(F.broadcast(edges), within(F.col("s0"), F.col("s1")))
    w = W.partitionBy("ds_id", "element").orderBy("e")
    before, after = F.lag("e").over(w), F.lead("e").over(w)
    weight = (F.coalesce(after, F.col("e")) - F.coalesce(before, F.col("e"))) / 2
    var = t.select("ds_id", "element", (weight * weight * F.greatest("v", F.lit(0.0))).alias("s")).groupBy("ds_id", "element").agg(F.when(F.count("*") >= 2, F.sum("s")).alias("var"))
    all_ = spectrum.select("ds_id").distinct().join(F.broadcast(edges.select("element", "ratio", "sigma"))).join(var, ["ds_id", "element"], "left")
    q = all_.withColumn("v", F.when(F.col("sigma") > 0, F.col("var") / (F.col("sigma") * F.col("sigma"))))
    one = W.partitionBy("ds_id")
    total, others = F.sum("ratio").over(one), F.sum("v").over(one) - F.col("v")
    f = F.col("ratio") / total
    known = F.count("v").over(one) == F.count("*").over(one)
    sigma = F.when(known & (total > 0), 100 * F.sqrt(((1 - f) * (1 - f) * F.col("v") + f * f * others) / (total * total)))
    return q.select("ds_id", "element", F.coalesce(100 * F.try_divide(F.col("ratio"), total), F.lit(0.0)).alias("atomic_pct"), sigma.alias("atomic_sigma"))


def zeta_from_k(symbols: DataFrame, zeta_si: float) -> DataFrame:
    """Absolute factors of elements (symbol) from that of silicon and their factors relative to it: symbol, zeta; 1 where none is known."""
    if zeta_si <= 0:
        raise ValueError("the factor of silicon must be above 0")
    table = symbols.sparkSession.createDataFrame(list(K_FACTORS.items()), "symbol string, k double")
    return symbols.select("symbol").distinct().join(F.broadcast(table), "symbol", "left").select("symbol", (F.coalesce("k", F.lit(1.0)) * zeta_si).alias("zeta"))


def solid_angle(area_mm2: float, distance_mm: float) -> float:
    """Solid angle of a detector, for small ones: its area over its distance squared."""
    if area_mm2 <= 0 or distance_mm <= 0:
        raise ValueError("area and distance must be above 0")
    return area_mm2 / distance_mm**2


def to_kev(energy: Column, unit: Column) -> Column:
    """Energies in keV by the name of their unit (eV, keV, meV in any case); others stay as they are."""
    name = F.lower(F.trim(unit))
    return F.when(name == "ev", energy * 1e-3).when(name == "mev", energy * 1e-6).otherwise(energy)


def chemical_sigma(whole: Column, waviness: Column) -> Column:
    """The width of an interface that its waviness doesn't explain; null where that is as large as the whole."""
    return F.when(waviness < whole, F.sqrt(whole * whole - waviness * waviness))
