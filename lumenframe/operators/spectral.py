"""Operators on spectral cubes (ds_id, y, x, ch, e, v): sums, element maps, quantification, backgrounds, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.raster import small_side

# K, L and M line energies in keV.
K_LINES = {
    "Be": 0.108, "B": 0.183, "C": 0.277, "N": 0.392, "O": 0.525, "F": 0.677, "Ne": 0.849, "Na": 1.041, "Mg": 1.254, "Al": 1.487, "Si": 1.740,
    "P": 2.013, "S": 2.307, "Cl": 2.622, "Ar": 2.957, "K": 3.314, "Ca": 3.692, "Sc": 4.091, "Ti": 4.511, "V": 4.952, "Cr": 5.415, "Mn": 5.899,
    "Fe": 6.404, "Co": 6.930, "Ni": 7.478, "Cu": 8.048, "Zn": 8.639, "Ga": 9.252, "Ge": 9.886, "As": 10.544, "Se": 11.222, "Br": 11.924,
    "Rb": 13.395, "Sr": 14.165, "Y": 14.958, "Zr": 15.775, "Nb": 16.615, "Mo": 17.479, "Ru": 19.279, "Rh": 20.216, "Pd": 21.177, "Ag": 22.163,
    "Cd": 23.174, "In": 24.210, "Sn": 25.271,
}
L_LINES = {
    "Ca": 0.341, "Ti": 0.452, "V": 0.511, "Cr": 0.573, "Mn": 0.637, "Fe": 0.705, "Co": 0.776, "Ni": 0.851, "Cu": 0.930, "Zn": 1.012, "Ga": 1.098,
    "Ge": 1.188, "As": 1.282, "Zr": 2.042, "Nb": 2.166, "Mo": 2.293, "Ru": 2.559, "Rh": 2.697, "Pd": 2.839, "Ag": 2.984, "Cd": 3.133, "In": 3.287,
    "Sn": 3.444, "Sb": 3.605, "Ba": 4.466, "La": 4.651, "Ce": 4.840, "Nd": 5.230, "Sm": 5.636, "Gd": 6.057, "Dy": 6.495, "Er": 6.949, "Yb": 7.416,
    "Hf": 7.899, "Ta": 8.146, "W": 8.398, "Re": 8.652, "Os": 8.911, "Ir": 9.175, "Pt": 9.442, "Au": 9.713, "Hg": 9.989, "Tl": 10.269, "Pb": 10.551,
    "Bi": 10.839, "Th": 12.968, "U": 13.615,
}
M_LINES = {
    "Hf": 1.645, "Ta": 1.710, "W": 1.775, "Re": 1.843, "Os": 1.910, "Ir": 1.980, "Pt": 2.051, "Au": 2.123, "Hg": 2.196, "Tl": 2.271, "Pb": 2.342,
    "Bi": 2.420, "Th": 2.996, "U": 3.171,
}
# A line's energy as a share of its absorption edge.
EDGE_SHARE = {"K": 0.90, "L": 0.80, "M": 0.93}
# Cliff-Lorimer factors at 200 kV relative to Si.
K_FACTORS = {
    "B": 4.50, "C": 3.00, "N": 2.20, "O": 1.80, "F": 1.50, "Na": 1.10, "Mg": 0.95, "Al": 0.87, "Si": 1.00, "P": 0.97, "S": 0.93, "Cl": 0.92,
    "K": 1.01, "Ca": 1.03, "Sc": 1.05, "Ti": 1.07, "V": 1.09, "Cr": 1.13, "Mn": 1.18, "Fe": 1.21, "Co": 1.25, "Ni": 1.28, "Cu": 1.32, "Zn": 1.36,
    "Ga": 1.52, "Ge": 1.56, "As": 1.58, "Se": 1.62, "Br": 1.66, "Sr": 2.50, "Y": 2.55, "Zr": 2.60, "Nb": 2.65, "Mo": 2.70, "Ru": 2.80, "Pd": 2.85,
    "Ag": 2.90, "Sn": 2.95, "Sb": 3.00, "Ba": 2.70, "La": 2.10, "Ce": 2.15, "Hf": 1.70, "Ta": 1.75, "W": 1.80, "Pt": 1.90, "Au": 1.85,
}
# Standard atomic weights.
MASSES = {
    "H": 1.008, "He": 4.0026, "Li": 6.94, "Be": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Ne": 20.180, "Na": 22.990,
    "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Ar": 39.948, "K": 39.098, "Ca": 40.078, "Sc": 44.956, "Ti": 47.867,
    "V": 50.942, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38, "Ga": 69.723, "Ge": 72.630,
    "As": 74.922, "Se": 78.971, "Br": 79.904, "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224, "Nb": 92.906, "Mo": 95.95, "Ru": 101.07,
    "Rh": 102.91, "Pd": 106.42, "Ag": 107.87, "Cd": 112.41, "In": 114.82, "Sn": 118.71, "Sb": 121.76, "Ba": 137.33, "La": 138.91, "Ce": 140.12,
    "Nd": 144.24, "Sm": 150.36, "Gd": 157.25, "Dy": 162.50, "Er": 167.26, "Yb": 173.04, "Hf": 178.49, "Ta": 180.95, "W": 183.84, "Re": 186.21,
    "Os": 190.23, "Ir": 192.22, "Pt": 195.08, "Au": 196.97, "Hg": 200.59, "Tl": 204.38, "Pb": 207.2, "Bi": 208.98, "Th": 232.04, "U": 238.03,
}
#: Pixels that any spectrum has: the key of per-pixel work.
PIXEL = ["ds_id", "y", "x"]


def lines(spark: SparkSession, symbols: list[str] | None = None) -> DataFrame:
    """The K lines: symbol, energy, k, mass; k and mass are 1 where none is known."""
    rows = [(s, e, K_FACTORS.get(s, 1.0), MASSES.get(s, 1.0)) for s, e in K_LINES.items() if symbols is None or s in symbols]
    return spark.createDataFrame(rows, "symbol string, energy double, k double, mass double")


def line_table(spark: SparkSession, symbols: list[str] | None = None) -> DataFrame:
    """All K, L and M lines: symbol, line, energy."""
    rows = [(s, n, e) for n, t in (("K", K_LINES), ("L", L_LINES), ("M", M_LINES)) for s, e in t.items() if symbols is None or s in symbols]
    return spark.createDataFrame(rows, "symbol string, line string, energy double")


def lines_in_range(table: DataFrame, lo: float, hi: float) -> DataFrame:
    """Lines of a line_table() with an energy from lo to hi (in any order), both included."""
    return table.where(F.col("energy").between(min(lo, hi), max(lo, hi)))


def principal_lines(table: DataFrame, beam_kv: float, least: float = 1.5) -> DataFrame:
    """The line that each element is measured by: symbol, line, energy. table: line_table().

    The first of K, L, M whose edge the beam exceeds by the overvoltage `least`; without one, that of the largest overvoltage.
    """
    share = F.create_map(*[F.lit(x) for kv in EDGE_SHARE.items() for x in kv])
    over = F.lit(float(beam_kv)) / (F.col("energy") / share[F.col("line")])
    enough = over >= least
    best = F.struct(enough.alias("enough"), F.when(enough, 0.0).otherwise(over).alias("over"), F.when(F.col("line") == "K", 3).when(F.col("line") == "L", 2).otherwise(1).alias("first"), "line", "energy")
    return table.groupBy("symbol").agg(F.max(best).alias("b")).select("symbol", "b.line", "b.energy")


def element_windows(spectrum: DataFrame, beam_kv: float, symbols: list[str], half_window: float = 0.085) -> DataFrame:
    """Window of each element's principal line: ds_id, symbol, line, energy, lo, hi, reason (null, or why it can't be used)."""
    axis = spectrum.groupBy("ds_id").agg(F.min("e").alias("e0"), F.max("e").alias("e1"))
    spark = spectrum.sparkSession
    asked = spark.createDataFrame([(s,) for s in symbols], "symbol string").join(F.broadcast(principal_lines(line_table(spark, symbols), beam_kv)), "symbol", "left")
    t = axis.join(F.broadcast(asked))
    reason = F.when(F.col("energy").isNull(), "no line").when(~F.col("energy").between(F.col("e0"), F.col("e1")), "outside the axis")
    return t.select("ds_id", "symbol", "line", "energy", (F.col("energy") - half_window).alias("lo"), (F.col("energy") + half_window).alias("hi"), reason.alias("reason"))


def sum_spectrum(cube: DataFrame) -> DataFrame:
    return cube.groupBy("ds_id", "ch", "e").agg(F.sum("v").alias("v"))


def raster_of(cube: DataFrame) -> DataFrame:
    """A cube as one raster: its sum over channels."""
    return cube.groupBy(*PIXEL).agg(F.sum("v").alias("v"))


def within(lo: float | Column, hi: float | Column) -> Column:
    return (F.col("e") >= lo) & (F.col("e") <= hi)


def element_map(cube: DataFrame, lo: float, hi: float, background: str = "none", width: float | None = None, gap: float = 0.0, e0_kev: float | None = None) -> DataFrame:
    """Counts in a window, less a background from the windows of `width` (default: the window's own) on either side.

    none: all counts; linear: the mean rate of the two sides (or of the one that has channels); bremsstrahlung: the
    continuum (e0 - e) / e below the beam energy e0_kev, scaled to both sides by least squares. Negative values are 0.
    """
    lo, hi = min(lo, hi), max(lo, hi)
    peak = within(lo, hi)
    if background == "none":
        return cube.where(peak).groupBy(*PIXEL).agg(F.sum("v").alias("v"))
    if background not in ("linear", "bremsstrahlung"):
        raise ValueError("background must be none, linear or bremsstrahlung")
    width, gap = width if width and width > 0 else hi - lo, max(gap, 0.0)
    left = (F.col("e") >= lo - gap - width) & (F.col("e") < lo - gap)
    right = (F.col("e") > hi + gap) & (F.col("e") <= hi + gap + width)
    used = cube.where(peak | left | right)
    if background == "linear":
        rate = F.coalesce((F.avg(F.when(left, F.col("v"))) + F.avg(F.when(right, F.col("v")))) / 2, F.avg(F.when(left | right, F.col("v"))), F.lit(0.0))
        base = rate * F.count(F.when(peak, 1))
    else:
        if e0_kev is None or e0_kev <= hi:
            raise ValueError("the beam energy e0_kev must exceed the window")
        c = F.when(F.col("e") < e0_kev, (e0_kev - F.col("e")) / F.greatest(F.col("e"), F.lit(1e-9))).otherwise(0.0)
        side = left | right
        scale = F.try_divide(F.sum(F.when(side, c * F.col("v"))), F.sum(F.when(side, c * c)))
        base = F.coalesce(scale * F.sum(F.when(peak, c)), F.lit(0.0))
    gross = F.sum(F.when(peak, F.col("v")).otherwise(0.0))
    return used.groupBy(*PIXEL).agg(F.greatest(F.lit(0.0), gross - base).alias("v"))


def element_maps(cube: DataFrame, symbols: list[str], half_window: float = 0.2) -> DataFrame:
    """Counts around each element's line: one range join with the bounded line table for all elements."""
    table = F.broadcast(lines(cube.sparkSession, symbols))
    return cube.join(table, F.abs(F.col("e") - F.col("energy")) <= half_window).groupBy(*PIXEL, "symbol", "k", "mass").agg(F.sum("v").alias("v"))


def line_maps(cube: DataFrame, symbols: list[str], beam_kv: float, half_window: float = 0.085, background: str = "linear") -> DataFrame:
    """Net counts at each element's principal line, as element_maps(): one range join for all elements.

    Elements without a line on the axis have no rows (element_windows() says why). linear: the mean rate of two windows as
    wide as the peak's on either side, or of the one that has channels; negative values are 0.
    """
    if background not in ("none", "linear"):
        raise ValueError("background must be none or linear")
    spark = cube.sparkSession
    usable = element_windows(cube, beam_kv, symbols, half_window).where("reason is null")
    known = spark.createDataFrame([(s, K_FACTORS.get(s, 1.0), MASSES.get(s, 1.0)) for s in symbols], "symbol string, k double, mass double")
    t = usable.join(F.broadcast(known), "symbol").select(F.col("ds_id").alias("_ds"), "symbol", "k", "mass", "lo", "hi")
    width = 2 * half_window if background == "linear" else 0.0
    used = cube.join(small_side(t), (F.col("ds_id") == F.col("_ds")) & within(F.col("lo") - width, F.col("hi") + width))
    left, right = F.col("e") < F.col("lo"), F.col("e") > F.col("hi")
    peak = ~left & ~right
    rate = F.coalesce((F.avg(F.when(left, F.col("v"))) + F.avg(F.when(right, F.col("v")))) / 2, F.avg(F.when(~peak, F.col("v"))), F.lit(0.0))
    net = F.sum(F.when(peak, F.col("v")).otherwise(0.0)) - rate * F.count(F.when(peak, 1))
    return used.groupBy(*PIXEL, "symbol", "k", "mass").agg(F.greatest(F.lit(0.0), net).alias("v"))


def cliff_lorimer(maps: DataFrame) -> DataFrame:
    """Weight and atomic percent per element as means over the pixels that have counts. maps: element_maps()."""
    pixel = W.partitionBy(*PIXEL)
    i = maps.withColumn("w", F.greatest("v", F.lit(0.0)) * F.col("k")).withColumn("a", F.greatest("v", F.lit(0.0)) * F.col("k") / F.col("mass"))
    i = i.withColumn("ws", F.sum("w").over(pixel)).withColumn("as_", F.sum("a").over(pixel)).where("ws > 0")
    return i.groupBy("ds_id", "symbol").agg((100 * F.avg(F.col("w") / F.col("ws"))).alias("weight_pct"), (100 * F.avg(F.col("a") / F.col("as_"))).alias("atomic_pct"), F.count("*").alias("n"))


#: Counts and energies below this count as this where their logarithm is taken.
LEAST = 2.220446049250313e-16


def _law(method: str) -> tuple[Column, Column]:
    """x and y of the straight line that a background method fits."""
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(LEAST)))
    if method not in ("powerlaw", "exponential"):
        raise ValueError("method must be powerlaw or exponential")
    return (log("e") if method == "powerlaw" else F.col("e")), log("v")


def background(spectrum: DataFrame, fit: tuple[float, float], method: str = "powerlaw") -> DataFrame:
    """Pre-edge background of each spectrum: ds_id, ch, e, signal (0 at least), background, a, r (or the exponent b).

    powerlaw: a e^-r from logarithms of both; exponential: a exp(b e). A fit window of fewer than two channels gives nulls.
    """
    x, y = _law(method)
    law = spectrum.where(within(*fit)).groupBy("ds_id").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icept"))
    base = F.exp(F.col("icept") + F.col("slope") * x)
    rate = (-F.col("slope")).alias("r") if method == "powerlaw" else F.col("slope").alias("b")
    return spectrum.join(law, "ds_id").select("ds_id", "ch", "e", F.greatest(F.lit(0.0), F.col("v") - base).alias("signal"), base.alias("background"), F.exp("icept").alias("a"), rate)


def edge_map(cube: DataFrame, signal: tuple[float, float], fit: tuple[float, float] | None = None, method: str = "powerlaw") -> DataFrame:
    """Net signal of each pixel above the background that its own fit window gives; negative residuals count as 0.

    Without a fit window, all counts of the signal window.
    """
    if fit is None:
        return cube.where(within(*signal)).groupBy(*PIXEL).agg(F.sum("v").alias("v"))
    x, y = _law(method)
    s, f = within(*signal), within(*fit)
    used = cube.where(s | f)
    law = used.where(f).groupBy(*PIXEL).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icept"))
    net = F.greatest(F.lit(0.0), F.col("v") - F.exp(F.col("icept") + F.col("slope") * x))
    return used.where(s).join(law, PIXEL).groupBy(*PIXEL).agg(F.sum(net).alias("v"))


def thickness_map(cube: DataFrame, zero_loss: tuple[float, float], least: float = 100.0) -> DataFrame:
    """ln(total / zero loss) where both are sound."""
    s = cube.groupBy(*PIXEL).agg(F.sum("v").alias("total"), F.sum(F.when(within(*zero_loss), F.col("v")).otherwise(0.0)).alias("zero"))
    return s.where((F.col("total") >= least) & (F.col("zero") > 0) & (F.col("total") > F.col("zero"))).select(*PIXEL, F.log(F.col("total") / F.col("zero")).alias("v"))


def detect_peaks(spectrum: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Strict local maxima of the spectrum smoothed over three channels, of at least a share of the largest."""
    w = W.partitionBy("ds_id").orderBy("ch")
    s = spectrum.withColumn("s", F.sum("v").over(w.rowsBetween(-1, 1)) / 3)
    s = s.withColumn("top", F.max("s").over(W.partitionBy("ds_id"))).withColumn("before", F.lag("s").over(w)).withColumn("after", F.lead("s").over(w))
    return s.where((F.col("s") > F.col("before")) & (F.col("s") > F.col("after")) & (F.col("s") >= threshold * F.col("top"))).select("ds_id", "ch", "e", F.col("s").alias("height"))


def assign_lines(peaks: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """K, L and M lines within a tolerance of each peak, nearest first: ds_id, ch, e, symbol, line, energy, rank."""
    near = peaks.join(F.broadcast(line_table(peaks.sparkSession)), F.abs(F.col("e") - F.col("energy")) <= tolerance)
    rank = F.row_number().over(W.partitionBy("ds_id", "ch").orderBy(F.abs(F.col("e") - F.col("energy")), "symbol", "line"))
    return near.select("ds_id", "ch", "e", "symbol", "line", "energy", rank.alias("rank"))


def sum_artifacts(of: DataFrame, e_max: float) -> DataFrame:
    """Energies at which two photons of lines (symbol, energy), a bounded table, count as one, and silicon escape peaks.

    Pairs are unordered; an escape peak lies 1.74 keV below its line.
    """
    a = of.select(F.col("symbol").alias("a"), F.col("energy").alias("ea"))
    b = of.select(F.col("symbol").alias("b"), F.col("energy").alias("eb"))
    pairs = a.join(F.broadcast(b), F.col("a") <= F.col("b")).select("a", "b", F.lit("sum").alias("kind"), (F.col("ea") + F.col("eb")).alias("energy"))
    escape = a.where("ea > 1.839").select("a", F.lit(None).cast("string").alias("b"), F.lit("escape").alias("kind"), (F.col("ea") - 1.74).alias("energy"))
    return pairs.unionByName(escape).where(F.col("energy").between(0.2, e_max))


def centroid(spectrum: DataFrame, anchors: list[float], search: float) -> DataFrame:
    """Centre of mass of the counts around each anchor energy."""
    at = spectrum.sparkSession.createDataFrame([(a,) for a in anchors], "anchor double")
    return spectrum.join(F.broadcast(at), F.abs(F.col("e") - F.col("anchor")) <= search).groupBy("ds_id", "anchor").agg((F.sum(F.col("e") * F.col("v")) / F.sum("v")).alias("centre"))
