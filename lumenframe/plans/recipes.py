"""Recipes: JSON lists of {"op", "params"} over rasters and spectral cubes, checked as a whole before anything runs.

Each operation states its parameters as a Spark schema, defaults by name, and a rule by name as a SQL expression over the
parameters. A step's parameters are one row: given values are cast to the schema, and one projection tells which of them are
missing, of another kind or against their rule.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StructType

from lumenframe.operators import measure, quantify, raster, spectral, texture
from lumenframe.sources import tables

# Words that stand for false.
FALSE_WORDS = ["false", "no", "0", "off", ""]


@dataclass(frozen=True)
class Op:
    """schema: DDL of the parameters; a parameter without a default must be given, one with the default None may be left out."""

    run: Callable[..., DataFrame]
    schema: str = ""
    defaults: dict[str, Any] = field(default_factory=dict)
    rules: dict[str, str] = field(default_factory=dict)
    produces: str = "image"
    takes: str = "image"

    def fields(self) -> StructType:
        return StructType.fromDDL(self.schema) if self.schema else StructType([])


def _quantify(cube: DataFrame, elements: list[str], method: str, half_window: float, beam_kv: float, thickness: float, take_off: float) -> DataFrame:
    maps = spectral.line_maps(cube, elements, beam_kv, half_window)
    return spectral.cliff_lorimer(maps) if method == "cliff-lorimer" else quantify.zaf(maps, elements, thickness, take_off)


def _totals(maps: DataFrame) -> DataFrame:
    return maps.groupBy("ds_id", "symbol").agg(F.sum("v").alias("total"), F.max("v").alias("max"))


def _roughness(img: DataFrame, level: str, pixel_size: float) -> DataFrame:
    flat = {"none": lambda i: i, "plane": raster.plane_level, "quadratic": raster.quadratic_level}[level](img)
    return measure.roughness(flat, level=False).join(texture.surface_area_ratio(flat, pixel_size).withColumnRenamed("ratio", "sar"), "ds_id", "left")


def _morph(img: DataFrame, operation: str, radius: int, shape: str) -> DataFrame:
    return raster.morph(raster.above_mean(img), operation, radius, shape == "square")


def _distribution(img: DataFrame, values: list[float], fit: str) -> DataFrame:
    pop = img.sparkSession.createDataFrame([("values", v) for v in values], "grp string, v double")
    if fit == "none":
        return measure.summarize(pop)
    fits = measure.fit_all(pop)
    return fits if fit == "all" else fits.where(F.col("kind") == fit)


def windows_of(texts: list[str]) -> list[tuple[float, float]]:
    """Windows from texts 'lo:hi'."""
    out = []
    for t in texts:
        lo, colon, hi = t.partition(":")
        if not colon:
            raise ValueError(f"{t!r} is no window lo:hi")
        out.append((float(lo), float(hi)))
    return out


def _edges(cube: DataFrame, elements: list[str], shells: list[str], onset_ev: list[float], signal_windows: list[str], bg_windows: list[str], e0_kv: float, beta_mrad: float, method: str) -> DataFrame:
    rows = [(s, n, o, *w, *b) for s, n, o, w, b in zip(elements, shells, onset_ev, windows_of(signal_windows), windows_of(bg_windows), strict=True)]
    edges = cube.sparkSession.createDataFrame(rows, "element string, shell string, onset double, s0 double, s1 double, b0 double, b1 double")
    return quantify.edge_quantify(cube, edges, e0_kv, beta_mrad, method)


def _profile(cube: DataFrame, elements: list[str], x1: float, y1: float, x2: float, y2: float, n_points: int, width: int, half_window: float, beam_kv: float) -> DataFrame:
    return quantify.composition_profile(spectral.line_maps(cube, elements, beam_kv, half_window), x1, y1, x2, y2, width, n_points)


def _one_of(name: str, *words: str) -> dict[str, str]:
    return {name: f"{name} IN ({', '.join(repr(w) for w in words)})"}


CUBE = {"takes": "cube"}
VALUE = {"produces": "value"}
LINES = {"half_window": 0.085, "beam_kv": 200.0}
LINES_RULES = {"elements": "size(elements) > 0 AND NOT exists(elements, s -> s = '')", "half_window": "half_window >= 0", "beam_kv": "beam_kv >= 0"}
SAME_SIZE = {c: f"size({c}) = size(elements)" for c in ("shells", "onset_ev", "signal_windows", "bg_windows")}

OPS: dict[str, Op] = {
    "gaussian": Op(raster.gaussian, "sigma double", {"sigma": 1.0}, {"sigma": "sigma >= 0"}),
    "median": Op(raster.median, "window_size int", {"window_size": 3}, {"window_size": "window_size IN (3, 5, 7)"}),
    "unsharp": Op(raster.unsharp, "sigma double, amount double", {"sigma": 2.0, "amount": 1.0}, {"sigma": "sigma >= 0"}),
    "bin": Op(raster.bin_image, "bin_size int, mode string", {"bin_size": 2, "mode": "average"}, {"bin_size": "bin_size >= 1", **_one_of("mode", "average", "sum")}),
    "plane_level": Op(lambda img, order: raster.plane_level(img) if order == 1 else raster.quadratic_level(img), "order int", {"order": 1}, {"order": "order BETWEEN 1 AND 2"}),
    "multiotsu": Op(lambda img, n_classes: texture.classify(img, texture.multi_otsu(img, n_classes)).withColumnRenamed("label", "v"), "n_classes int", {"n_classes": 3}, {"n_classes": "n_classes BETWEEN 2 AND 5"}),
    "clahe": Op(texture.clahe, "clip_limit double, bins int", {"clip_limit": 0.01, "bins": 256}, {"clip_limit": "clip_limit >= 0", "bins": "bins >= 2"}),
    "crop": Op(raster.crop, "r1 int, c1 int, r2 int, c2 int", {}, {c: f"{c} >= 1" for c in ("r1", "c1", "r2", "c2")}),
    "rotate": Op(raster.turn, "degrees double"),
    "strip_databar": Op(raster.strip_bar, "content_rows int", {}, {"content_rows": "content_rows >= 1"}),
    "morph": Op(_morph, "operation string, radius int, shape string", {"operation": "open", "radius": 1, "shape": "square"}, {**_one_of("operation", "erode", "dilate", "open", "close"), "radius": "radius >= 1", **_one_of("shape", "square", "disk")}),
    "rotate90": Op(lambda img: raster.rotate(img, 1)),
    "rotate180": Op(lambda img: raster.rotate(img, 2)),
    "rotate270": Op(lambda img: raster.rotate(img, 3)),
    "fliph": Op(lambda img: raster.flip(img, True)),
    "flipv": Op(lambda img: raster.flip(img, False)),
    "normalize": Op(raster.normalize01, "clip_percentile double", {"clip_percentile": 0.0}, {"clip_percentile": "clip_percentile BETWEEN 0 AND 50"}),
    "image_stats": Op(measure.image_stats, **VALUE),
    "roughness": Op(_roughness, "level string, pixel_size double", {"level": "plane", "pixel_size": 1.0}, {**_one_of("level", "none", "plane", "quadratic"), "pixel_size": "pixel_size > 0"}, **VALUE),
    "radial_profile": Op(measure.radial_profile, "n_bins int, center_x double, center_y double, normalize boolean", {"n_bins": 0, "center_x": None, "center_y": None, "normalize": False}, {"n_bins": "n_bins >= 0"}, **VALUE),
    "noise": Op(texture.noise, "method string", {"method": "mad"}, _one_of("method", "mad", "localvar", "both"), **VALUE),
    "distribution_fit": Op(_distribution, "values array<double>, fit string", {"fit": "all"}, {"values": "size(values) > 0 AND NOT exists(values, v -> v IS NULL)", **_one_of("fit", "all", "normal", "lognormal", "weibull", "none")}, **VALUE),
    "auto_window": Op(texture.auto_window, **VALUE),
    "otsu": Op(raster.otsu, "bins int", {"bins": 256}, {"bins": "bins >= 2"}, **VALUE),
    "eds_element_map": Op(lambda cube, e_lo, e_hi, bg, bg_width, bg_gap, e0_kev: spectral.element_map(cube, e_lo, e_hi, bg, bg_width, bg_gap, e0_kev), "e_lo double, e_hi double, bg string, bg_width double, bg_gap double, e0_kev double", {"bg": "linear", "bg_width": None, "bg_gap": 0.0, "e0_kev": None}, {**_one_of("bg", "none", "linear", "bremsstrahlung"), "e_hi": "e_hi > e_lo", "bg_gap": "bg_gap >= 0"}, **CUBE),
    "eels_map": Op(lambda cube, signal_lo, signal_hi, bg_lo, bg_hi, method: spectral.edge_map(cube, (signal_lo, signal_hi), None if bg_lo is None or bg_hi is None else (bg_lo, bg_hi), method), "signal_lo double, signal_hi double, bg_lo double, bg_hi double, method string", {"bg_lo": None, "bg_hi": None, "method": "powerlaw"}, {"signal_hi": "signal_hi > signal_lo", "bg_hi": "bg_hi IS NULL OR bg_hi > bg_lo", **_one_of("method", "powerlaw", "exponential")}, **CUBE),
    "eels_quantify": Op(_edges, "elements array<string>, shells array<string>, onset_ev array<double>, signal_windows array<string>, bg_windows array<string>, e0_kv double, beta_mrad double, method string", {"e0_kv": 200.0, "beta_mrad": 10.0, "method": "powerlaw"}, {"elements": LINES_RULES["elements"], **SAME_SIZE, "e0_kv": "e0_kv >= 0", "beta_mrad": "beta_mrad >= 0", **_one_of("method", "powerlaw", "exponential")}, **VALUE, **CUBE),
    "sum_image": Op(spectral.raster_of, **CUBE),
    "explode": Op(raster.explode_cube, "most int", {"most": 256}, {"most": "most >= 1"}, **CUBE),
    "eds_element_maps": Op(lambda cube, elements, half_window, bg, beam_kv: _totals(spectral.line_maps(cube, elements, beam_kv, half_window, bg)), "elements array<string>, half_window double, bg string, beam_kv double", {**LINES, "bg": "linear"}, {**LINES_RULES, **_one_of("bg", "none", "linear")}, **VALUE, **CUBE),
    "eds_quantify": Op(_quantify, "elements array<string>, method string, half_window double, beam_kv double, thickness double, take_off double", {**LINES, "method": "cliff-lorimer", "thickness": 100.0, "take_off": 20.0}, {**LINES_RULES, **_one_of("method", "cliff-lorimer", "zaf"), "thickness": "thickness >= 0", "take_off": "take_off BETWEEN 0.1 AND 89.9"}, **VALUE, **CUBE),
    "composition_profile": Op(_profile, "elements array<string>, x1 double, y1 double, x2 double, y2 double, n_points int, width int, half_window double, beam_kv double", {**LINES, "n_points": 200, "width": 1}, {**LINES_RULES, "n_points": "n_points >= 2", "width": "width >= 1"}, **VALUE, **CUBE),
    "savgol": Op(lambda cube, window, polyorder: quantify.savgol(spectral.sum_spectrum(cube), window, polyorder), "window int, polyorder int", {"window": 11, "polyorder": 3}, {"window": "window >= 1", "polyorder": "polyorder >= 0"}, **VALUE, **CUBE),
    "savgol_derivative": Op(lambda cube, window, polyorder, order, delta: quantify.savgol(spectral.sum_spectrum(cube), window, polyorder, order, delta), "window int, polyorder int, order int, delta double", {"window": 11, "polyorder": 3, "order": 1, "delta": 1.0}, {"window": "window >= 1", "polyorder": "polyorder >= 0", "order": "order >= 1"}, **VALUE, **CUBE),
}


def _typed(given: Column, kind: DataType) -> Column:
    """A value given as text (JSON for lists) as one of the kind; null where it is none."""
    if isinstance(kind, BooleanType):
        return ~F.lower(F.trim(given)).isin(FALSE_WORDS)
    if isinstance(kind, IntegerType):
        whole = given.try_cast("double")
        return F.when(whole == F.rint(whole), whole.try_cast("int"))
    if isinstance(kind, ArrayType):
        parts = F.coalesce(F.from_json(given, "array<string>"), F.split(given, ","))
        return F.transform(parts, lambda p: F.trim(p).try_cast(kind.elementType))
    return given.try_cast(kind)


def resolve(step: dict, spark: SparkSession | None = None) -> tuple[Op, dict[str, Any]]:
    """The operation of a step and its parameters, defaults filled in; unknown operations and parameters are refused."""
    spark = spark or SparkSession.builder.getOrCreate()
    name, given = step.get("op"), step.get("params") or {}
    if name not in OPS:
        raise ValueError(f"unknown operation {name!r}")
    op = OPS[name]
    fields = op.fields()
    if unknown := set(given) - set(fields.names):
        raise ValueError(f"{name}: unknown parameters {sorted(unknown)}")
    if missing := [c for c in fields.names if given.get(c) is None and c not in op.defaults]:
        raise ValueError(f"{name}: {', '.join(missing)} is needed")
    if not fields.names:
        return op, {}
    text = {c: v if isinstance(v, str) else json.dumps(v) for c, v in given.items() if v is not None}
    row = spark.range(1).select(*[_typed(F.lit(text[f.name]), f.dataType).alias(f.name) if f.name in text else F.lit(op.defaults[f.name]).cast(f.dataType).alias(f.name) for f in fields])
    rules = [F.coalesce(F.expr(op.rules[c]), F.lit(False)).alias(f"ok {c}") for c in op.rules]
    got = row.select("*", *rules).first()
    wrong = [c for c in text if got[c] is None]
    wrong += [c for c in op.rules if not got[f"ok {c}"] and c not in wrong and (c in text or op.defaults.get(c) is not None)]
    if wrong:
        raise ValueError(f"{name}: " + ", ".join(f"{c} can't be {given.get(c)!r}" for c in wrong))
    return op, {c: list(v) if isinstance(v := got[c], list) else v for c in fields.names}


def load(text: str) -> list[dict]:
    """A recipe from JSON: a list of steps, or an object with steps."""
    got = json.loads(text)
    steps = got.get("steps") if isinstance(got, dict) else got
    if not isinstance(steps, list) or not all(isinstance(s, dict) for s in steps):
        raise ValueError("a recipe is a list of steps")
    return steps


def check(steps: list[dict], first: str, spark: SparkSession | None = None) -> list[tuple[dict, Op, dict[str, Any]]]:
    """The steps with their operations; one that needs a cube after the image steps began is refused."""
    kind, out = first, []
    for s in steps:
        op, params = resolve(s, spark)
        if op.takes != kind:
            raise ValueError(f"{s['op']} needs a {op.takes}, not a {kind}")
        kind = "image" if op.produces == "image" else kind
        out.append((s, op, params))
    return out


def run(data: DataFrame, steps: list[dict]) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """Apply steps to rasters or a cube: image steps chain, value steps look at the data so far. All are checked before the first one runs."""
    values = []
    for step, op, params in check(steps, "cube" if "e" in data.columns else "image", data.sparkSession):
        out = op.run(data, **params)
        if op.produces == "image":
            data = out
        else:
            values.append((step["op"], out))
    return data, values


def save(data: DataFrame, values: list[tuple[str, DataFrame]], steps: list[dict], out: str) -> None:
    """Outputs below a new folder: image (Parquet), a CSV folder for each value step by its number, and the steps that made them."""
    data.write.parquet(f"{out}/image")
    for i, (name, v) in enumerate(values):
        tables.write_csv(v, f"{out}/{i:02d}-{name}")
    data.sparkSession.createDataFrame([(json.dumps({"steps": steps}),)], "value string").coalesce(1).write.text(f"{out}/provenance")
