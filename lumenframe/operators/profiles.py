"""Depth profiles and interfaces: blurred slopes, peaks that keep apart, persistence over scales, traces and their cleaning.

A line of a raster is one array, bounded by the raster's side; lines of all rasters are worked on at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.raster import DS, finite
from lumenframe.session import materialize


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """A Gaussian's weights out to `truncate` sigma."""
    n = int(truncate * sigma + 0.5)
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-n, n + 1)]
    return [k / sum(w) for k in w]


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _folded(i: Column, n: Column) -> Column:
    """A place beyond an end as the place that mirrors it (the end itself comes twice)."""
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def blur_line(a: Column, sigma: float) -> Column:
    """A line blurred by a Gaussian; ends are mirrored."""
    w = kernel(sigma)
    half = len(w) // 2
    taps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(k).alias("k")) for o, k in zip(range(-half, half + 1), w, strict=True)])
    n = F.size(a)
    at = lambda i: F.aggregate(taps, F.lit(0.0), lambda s, t: s + t["k"] * F.element_at(a, (_folded(i + t["o"], n) + 1).cast("int")))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(a)


def slope_line(a: Column) -> Column:
    """Central differences of a line of two values or more, one-sided at the ends."""
    n = F.size(a)
    v = lambda i: F.element_at(a, i.cast("int"))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == 1, v(F.lit(2)) - v(F.lit(1))).when(i == n, v(n) - v(n - 1)).otherwise((v(i + 1) - v(i - 1)) / 2))


def steep_line(a: Column, sigma: float) -> Column:
    """Absolute slopes of a line, blurred first where sigma is above 0."""
    slopes = lambda b: F.transform(slope_line(b), lambda g: F.abs(g))
    return let(blur_line(a, sigma), slopes) if sigma > 0 else slopes(a)


def apart(peaks: Column, distance: int) -> Column:
    """Peaks (i, h) of which none has a higher one nearer than a distance, by place: the highest stays, then the next one.

    Of equally high ones the later goes first.
    """
    ranked = lambda some: F.array_sort(some, lambda p, q: F.when(p["h"] > q["h"], -1).when(p["h"] < q["h"], 1).otherwise(q["i"] - p["i"]))
    kept = lambda some: F.aggregate(ranked(some), F.filter(some, lambda p: F.lit(False)), lambda k, p: F.when(F.exists(k, lambda o: F.abs(o["i"] - p["i"]) < distance), k).otherwise(F.concat(k, F.array(p))))
    return F.array_sort(let(peaks, kept))


def peaks_of(g: Column, least: Column, distance: int) -> Column:
    """Local maxima (i from 0, h) of a line of at least a height that keep apart; the middle of a plateau counts for it."""
    n = F.size(g)
    v = lambda i: F.element_at(g, (i + 1).cast("int"))

    def top(i: Column) -> Column:
        """Where a plateau begins at i, its last place; null where the line doesn't fall after it."""
        end = F.aggregate(F.sequence(i, n - 1), F.struct(i.alias("e"), F.lit(True).alias("go")), lambda s, j: F.struct(F.when(s["go"] & (v(j) == v(i)), j).otherwise(s["e"]).alias("e"), (s["go"] & (v(j) == v(i))).alias("go")))["e"]
        end = F.when(v(i + 1) == v(i), end).otherwise(i)
        return F.when((end < n - 1) & (v(F.least(end + 1, n - 1)) < v(i)), end)

    rises = F.filter(F.sequence(F.lit(1), n - 2), lambda i: (v(i - 1) < v(i)) & (v(i) >= least))
    found = F.transform(rises, lambda i: F.struct(((i + top(i)) / 2).cast("int").alias("i"), v(i).alias("h")))
    found = F.filter(found, lambda p: p["i"].isNotNull())
    return F.when(n > 2, apart(found, max(1, distance)))


def strongest(peaks: Column, layers: int) -> Column:
    """The layers - 1 highest peaks, by place; all where layers is below 2."""
    if layers < 2:
        return peaks
    ranked = F.array_sort(peaks, lambda p, q: F.when(p["h"] > q["h"], -1).when(p["h"] < q["h"], 1).otherwise(q["i"] - p["i"]))
    return F.array_sort(F.slice(ranked, 1, layers - 1))


def as_lines(profile: DataFrame, *keys: str) -> DataFrame:
    """A row for each profile (keys, i, v): keys, line (its values by i)."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"])
    return profile.groupBy(*keys).agg(line.alias("line"))


def interfaces(profile: DataFrame, sensitivity: float = 0.3, n_layers: int = 0, smooth: float = 1.5, min_separation: int = 5) -> DataFrame:
    """Places where a depth profile is steepest: ds_id, i (from 0), slope.

    Peaks of the absolute slope of the blurred profile, of at least a share of the highest, that keep min_separation apart.
    n_layers above 1 keeps the n_layers - 1 steepest. Profiles of under 5 values or without a slope have none.
    """
    t = as_lines(profile, DS).where(F.size("line") >= 5).select(DS, steep_line(F.col("line"), max(smooth, 1e-6)).alias("g"))
    t = t.select(DS, "g", F.array_max("g").alias("top")).where("top > 0")
    found = strongest(peaks_of(F.col("g"), sensitivity * F.col("top"), min_separation), n_layers)
    return t.select(DS, F.inline(found)).select(DS, "i", F.col("h").alias("slope"))


def persistent_interfaces(profile: DataFrame, scales: tuple[float, ...] = (2.0, 4.0, 8.0), sensitivity: float = 0.3, n_layers: int = 0, min_separation: int = 5, persistence: int | None = None) -> DataFrame:
    """Interfaces that stay over scales of blur: ds_id, i (from 0), support (scales that have it), slope (at the last scale).

    A peak at any scale is kept where `persistence` scales (a majority by default) have a peak within min_separation of it.
    Of kept ones nearer than that the first stays. n_layers above 1 keeps the n_layers - 1 steepest at the last scale.
    """
    need = persistence if persistence is not None else len(scales) // 2 + 1
    t = as_lines(profile, DS).where(F.size("line") >= 5)
    t = t.select(DS, *[steep_line(F.col("line"), s).alias(f"g{n}") for n, s in enumerate(scales)])
    places = lambda n: F.when(F.array_max(f"g{n}") > 0, F.transform(peaks_of(F.col(f"g{n}"), sensitivity * F.array_max(f"g{n}"), min_separation), lambda p: p["i"])).otherwise(F.array().cast("array<int>"))
    t = t.select(DS, F.col(f"g{len(scales) - 1}").alias("g"), F.array(*[places(n) for n in range(len(scales))]).alias("at"))
    near = lambda c: F.size(F.filter("at", lambda some: F.exists(some, lambda p: F.abs(p - c) <= min_separation)))
    held = F.filter(F.transform(F.array_sort(F.array_distinct(F.flatten("at"))), lambda c: F.struct(c.alias("i"), near(c).alias("support"))), lambda p: p["support"] >= need)
    first = F.aggregate(held, F.filter(held, lambda p: F.lit(False)), lambda k, p: F.when((F.size(k) == 0) | (p["i"] - F.element_at(k, -1)["i"] > min_separation), F.concat(k, F.array(p))).otherwise(k))
    t = t.select(DS, "g", first.alias("kept"))
    found = F.transform("kept", lambda p: F.struct(p["i"].alias("i"), F.element_at("g", p["i"] + 1).alias("h"), p["support"].alias("support")))
    return t.select(DS, F.inline(strongest(found, n_layers))).select(DS, "i", "support", F.col("h").alias("slope"))


def trace_interface(img: DataFrame, position: float, window: int = 10, axis: str = "y", smooth: float = 1.0) -> DataFrame:
    """Depth of an interface on each line across the layers: ds_id, x (the line, from 1), depth (from 0).

    The steepest place of the blurred line within the window around a position, refined by a parabola through its neighbours.
    axis y: lines are columns; x: lines are rows.
    """
    if axis not in ("x", "y"):
        raise ValueError("axis must be x or y")
    other = "x" if axis == "y" else "y"
    lines = as_lines(img.select(DS, F.col(other).alias("x"), F.col(axis).alias("i"), "v"), DS, "x").where(F.size("line") >= 2)
    g = lines.select(DS, "x", F.size("line").alias("n"), steep_line(F.col("line"), smooth).alias("g"))
    at = round(position)
    lo, hi = max(1, at - window), F.least(F.col("n") - 1, F.lit(at + window + 1))
    part = F.slice("g", lo + 1, F.greatest(F.lit(0), hi - lo))
    k = F.when(hi - lo >= 1, F.array_position(part, F.array_max(part)).cast("int") - 1 + lo)
    t = g.select(DS, "x", "n", "g", k.alias("k"))
    v = lambda o: F.try_element_at("g", F.col("k") + 1 + o)
    bend = v(-1) - 2 * v(0) + v(1)
    shift = F.when(F.abs(bend) > 1e-12, 0.5 * (v(-1) - v(1)) / bend).otherwise(0.0)
    inside = (F.col("k") > 0) & (F.col("k") < F.col("n") - 1)
    depth = F.when(F.col("k").isNull(), F.lit(float(at))).when(inside, F.col("k") + F.greatest(F.lit(-0.5), F.least(F.lit(0.5), shift))).otherwise(F.col("k").cast("double"))
    return t.select(DS, "x", depth.alias("depth"))


def _line_fit(t: DataFrame, keys: list[str]) -> DataFrame:
    """Slope and intercept of depth over x of the kept points, by moments; the mean alone where all x are equal."""
    return t.where("kept").groupBy(*keys).agg(F.coalesce(F.regr_slope("depth", "x"), F.lit(0.0)).alias("b"), F.coalesce(F.regr_intercept("depth", "x"), F.avg("depth")).alias("a"), F.count("*").alias("n"))


def _quadratic_fit(t: DataFrame, keys: list[str]) -> DataFrame:
    """Coefficients of depth over u = x - mean x, of degree 2, by sums in one aggregate after the means."""
    mid = t.where("kept").groupBy(*keys).agg(F.avg("x").alias("mx"))
    u = F.col("x") - F.col("mx")
    s = t.where("kept").join(mid, keys).groupBy(*keys).agg(F.first("mx").alias("mx"), F.count("*").alias("n"), *[F.sum(F.pow(u, F.lit(p))).alias(f"s{p}") for p in (1, 2, 3, 4)], *[F.sum(F.pow(u, F.lit(p)) * F.col("depth")).alias(f"t{p}") for p in (0, 1, 2)])
    det = F.expr("n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)")
    a = F.expr("t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)")
    b = F.expr("n * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)")
    c = F.expr("n * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)")
    ok = F.abs(det) > 1e-9
    return s.select(*keys, "mx", *[F.when(ok, x / det).otherwise(F.col("t0") / F.col("n") if name == "a" else 0.0).alias(name) for name, x in (("a", a), ("b", b), ("c", c))])


def clean_trace(trace: DataFrame, order: int = 2, kappa: float = 4.0, rounds: int = 3, keys: tuple[str, ...] = (DS,)) -> DataFrame:
    """A trace (keys, x, depth) less its fit of degree 0 to 2: keys, x, depth, kept, residual (null where not kept).

    Points farther from the fit than kappa times 1.4826 times the median distance of the kept residuals from their median go
    before the next fit, up to `rounds` times or until the same points are kept. Traces of fewer finite points than order + 2
    and than 4 keep none; a round that would leave fewer changes nothing.
    """
    if order not in (0, 1, 2):
        raise ValueError("order must be 0, 1 or 2")
    by, least = list(keys), max(order + 2, 4)
    t = materialize(trace.select(*by, "x", "depth", (F.col("depth").isNotNull() & finite(F.col("depth"))).alias("good")), "trace")
    n = t.where("good").groupBy(*by).agg(F.count("*").alias("n"))
    t = t.join(n, by, "left").select(*by, "x", "depth", (F.col("good") & (F.col("n") >= least)).alias("good"))
    t = t.withColumn("kept", F.col("good"))

    def fitted(t: DataFrame) -> DataFrame:
        """t with the residual of every finite depth."""
        if order == 2:
            fit, at = _quadratic_fit(t, by), F.expr("a + b * (x - mx) + c * (x - mx) * (x - mx)")
        elif order == 1:
            fit, at = _line_fit(t, by), F.expr("a + b * x")
        else:
            fit, at = t.where("kept").groupBy(*by).agg(F.avg("depth").alias("a")), F.col("a")
        return t.join(fit, by, "left").select(*by, "x", "depth", "good", "kept", F.when(F.col("good"), F.col("depth") - at).alias("residual"))

    for _ in range(rounds):
        res = materialize(fitted(t), "trace")
        # A trace has a point for each line of a raster, so its median is one of a bounded group.
        mid = res.where("kept").groupBy(*by).agg(F.percentile("residual", 0.5).alias("m"))
        far = res.where("kept").join(mid, by).groupBy(*by).agg((1.4826 * F.percentile(F.abs(F.col("residual") - F.col("m")), 0.5)).alias("s"))
        near = F.col("good") & ((F.col("s") <= 0) & F.col("kept") | (F.col("s") > 0) & (F.abs("residual") <= kappa * F.col("s")))
        new = res.join(far, by, "left").withColumn("now", F.coalesce(near, F.lit(False)))
        some = new.where("now").groupBy(*by).agg(F.count("*").alias("left"))
        new = new.join(some, by, "left").withColumn("now", F.when(F.col("left") >= least, F.col("now")).otherwise(F.col("kept")))
        new = materialize(new.select(*by, "x", "depth", "good", "kept", "now"), "trace")
        same = new.where("kept <> now").isEmpty()
        t = new.select(*by, "x", "depth", "good", F.col("now").alias("kept"))
        if same:
            break
    out = fitted(t)
    return out.select(*by, "x", "depth", "kept", F.when(F.col("kept"), F.col("residual")).alias("residual"))


def noise_corrected(r: np.ndarray) -> tuple[float, float, float]:
    """Roughness of residuals in their order without the jitter of single lines, with it, and that jitter."""
    if len(r) < 2:
        return math.nan, math.nan, math.nan
    raw = 1.4826 * float(np.median(np.abs(r - np.median(r))))
    if len(r) < 3:
        return raw, raw, math.nan
    floor = math.sqrt(float(np.median(np.diff(r) ** 2)) / 0.4549 / 2)
    return math.sqrt(max(raw * raw - floor * floor, 0.0)), raw, floor


def trace_sigma(cleaned: DataFrame, keys: tuple[str, ...] = (DS,), block: int = 64, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Roughness of a clean_trace() and its interval: keys, n, quality, sigma, raw, noise, low, high.

    raw is 1.4826 times the median distance of the kept residuals from their median, noise the same of neighbours' differences,
    sigma what is left of raw without it; quality the share of lines that are kept. The interval is that of sigma over
    replicates of blocks of neighbouring residuals, drawn again and again. A trace is one array, bounded by the raster's side.
    Null for traces of fewer than two kept points.
    """
    by = list(keys)
    r = F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("x", "residual")))), lambda p: p["residual"])
    rows = cleaned.groupBy(*by).agg(r.alias("r"), F.count("*").alias("all"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for values, whole in zip(b.column("r").to_pylist(), b.column("all").to_pylist(), strict=True):
                v = np.array(values, float)
                sigma = noise_corrected(v)
                low = high = math.nan
                if len(v) > 3:
                    rng, size = np.random.default_rng(seed), min(block, max(2, len(v) // 4))
                    starts = rng.integers(0, len(v) - size + 1, (replicates, -(-len(v) // size)))
                    drawn = v[(starts[:, :, None] + np.arange(size)).reshape(replicates, -1)[:, : len(v)]]
                    low, high = np.quantile([noise_corrected(d)[0] for d in drawn], [(1 - level) / 2, (1 + level) / 2])
                out.append((len(v), len(v) / whole, *[None if math.isnan(x) else float(x) for x in (*sigma, low, high)]))
            columns = [pa.array([o[i] for o in out], pa.int64() if i == 0 else pa.float64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in by], *columns], names=[*by, "n", "quality", "sigma", "raw", "noise", "low", "high"])

    return rows.mapInArrow(measured, ", ".join(f"{k} {kinds[k]}" for k in by) + ", n long, quality double, sigma double, raw double, noise double, low double, high double")
