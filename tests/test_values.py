"""Operators against values that are known by other means: formulas, small cases, parameters that a fit must recover."""

import math

import numpy as np
import pytest

from lumenframe.operators import fourd, measure, raster, spectral
from tests.test_raster import array, frame


def spectrum(spark, e, v):
    return spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(zip(e, v, strict=True))], "ds_id string, ch int, e double, v double")


def cube(spark, e, pixels):
    rows = [("a", i + 1, 1, c, float(x), float(y)) for i, v in enumerate(pixels) for c, (x, y) in enumerate(zip(e, v, strict=True))]
    return spark.createDataFrame(rows, "ds_id string, y int, x int, ch int, e double, v double")


def test_morphology_erodes_at_borders(spark):
    a = np.zeros((6, 7))
    a[:3, :3] = 1
    f = frame(spark, a)
    eroded = array(raster.morph(f, "erode"))
    assert eroded.sum() == 1 and eroded[1, 1] == 1
    assert (array(raster.morph(f, "open")) == a).all()
    assert array(raster.morph(f, "dilate")).sum() == 16
    assert array(raster.morph(f, "erode", 1, square=False)).sum() == 1
    assert array(raster.morph(frame(spark, np.ones((5, 5))), "close")).sum() == 9


def test_window_level_and_normalisation(spark):
    a = np.array([[0.0, 2.0, np.nan, 4.0]])
    f = frame(spark, a)
    assert array(raster.window_level(f, 3, 3)).tolist() == [[0, 0, 0, 1]]
    assert array(raster.window_level(f, gamma=2)).tolist() == [[0, pytest.approx(math.sqrt(0.5)), 0, 1]]
    assert array(raster.normalize01(f)).tolist() == [[0, 0.5, 0.5, 1]]
    h = raster.histogram(frame(spark, np.full((2, 2), 3.0)), 2).collect()
    assert sorted((r["centre"], r["n"]) for r in h) == [(2.75, 0), (3.25, 4)]


def test_image_math_by_raster(spark):
    a, b = np.array([[4.0, 6.0]]), np.array([[0.0, 2.0]])
    both = frame(spark, b, "b").union(frame(spark, b + 1, "other"))
    pairs = spark.createDataFrame([("a", "b")], "ds_id string, other string")
    want = {"ratio": [[1, 0.75]], "divide": [[4, 3]], "subtract": [[4, 4]], "add": [[4, 8]]}
    for op, w in want.items():
        assert array(raster.image_math(frame(spark, a), both, op, pairs)).tolist() == w
    assert array(raster.image_math(frame(spark, a), frame(spark, b), "add")).tolist() == [[4, 8]]


def test_scan_shapes(spark):
    rows = [(r["rows"], r["cols"]) for r in fourd.scan_shapes(spark, 16384, 12).orderBy("rank").collect()]
    assert len(rows) == 12 and rows[:3] == [(128, 128), (256, 64), (64, 256)] and rows[-1] == (1, 16384)
    assert [(r["rows"], r["cols"]) for r in fourd.scan_shapes(spark, 1).collect()] == [(1, 1)] and fourd.scan_shapes(spark, 0).count() == 0


def test_radial_coverage_counts_every_pixel(spark):
    got = fourd.radial_coverage(spark, 10, 8, 4.0, 3.0).orderBy("bin").collect()
    assert len(got) == 4 and sum(r["n"] for r in got) == 80
    assert got[0]["radius"] == pytest.approx(math.hypot(5, 4) / 8)


def test_azimuthal_inside_the_nearest_edge(spark):
    f = frame(spark, np.ones((8, 8)))
    d = np.hypot(*np.mgrid[-3.5:4.5, -3.5:4.5])
    assert sum(r["n"] for r in measure.azimuthal(f, 0, 360, 4).collect()) == int((d < 3.5).sum())
    assert sum(r["n"] for r in measure.azimuthal(f, 90, 90, 4).collect()) == int((d < 3.5).sum())


def test_backgrounds_recover_their_laws(spark):
    e = np.linspace(400, 700, 600)
    r = spectral.background(spectrum(spark, e, 5e6 * e**-2.5), (420, 600)).first()
    assert r["r"] == pytest.approx(2.5) and r["a"] == pytest.approx(5e6, rel=1e-6) and r["signal"] == pytest.approx(0, abs=1e-6)
    e = np.linspace(100, 200, 300)
    r = spectral.background(spectrum(spark, e, 2e4 * np.exp(-0.03 * e)), (100, 160), "exponential").first()
    assert r["b"] == pytest.approx(-0.03) and r["a"] == pytest.approx(2e4, rel=1e-6)


def test_edge_map_finds_a_step(spark):
    e = 300 + 2.0 * np.arange(400)
    v = 8000 * (e / 300) ** -3.0 + 40 * (e >= 532)
    got = spectral.edge_map(cube(spark, e, [v, v - 40 * (e >= 532)]), (532, 572), (462, 522)).orderBy("y").collect()
    n = ((e >= 532) & (e <= 572)).sum()
    assert got[0]["v"] == pytest.approx(40 * n, rel=1e-6) and got[1]["v"] == pytest.approx(0, abs=1e-6)
    assert spectral.edge_map(cube(spark, e, [v]), (532, 572)).first()["v"] == pytest.approx(v[(e >= 532) & (e <= 572)].sum())


def test_element_map_backgrounds(spark):
    e = np.round(0.01 * np.arange(1200), 2)
    flat = np.full(1200, 2.0)
    peak = flat + 60 * np.exp(-((e - 6.404) ** 2) / (2 * 0.03**2))
    net = (peak - flat)[(e >= 6.2) & (e <= 6.6)].sum()
    assert spectral.element_map(cube(spark, e, [peak]), 6.6, 6.2, "linear", 0.2, 0.05).first()["v"] == pytest.approx(net, rel=1e-6)
    # a peak at the axis' end has one side only
    assert spectral.element_map(cube(spark, e[:661], [peak[:661]]), 6.2, 6.6, "linear", 0.2, 0.05).first()["v"] == pytest.approx(net, rel=1e-3)
    brems = 5 * (20 - np.maximum(e, 0.01)) / np.maximum(e, 0.01)
    got = spectral.element_map(cube(spark, e[100:], [(brems + peak - flat)[100:]]), 6.2, 6.6, "bremsstrahlung", 0.3, 0.05, 20.0).first()["v"]
    assert got == pytest.approx(net, rel=1e-3)
    with pytest.raises(ValueError, match="beam energy"):
        spectral.element_map(cube(spark, e, [peak]), 6.2, 6.6, "bremsstrahlung")


def test_lines(spark):
    t = spectral.line_table(spark)
    got = {r["symbol"]: (r["line"], r["energy"]) for r in spectral.principal_lines(t, 200.0).collect()}
    assert got["Si"] == ("K", 1.74) and got["Au"] == ("L", 9.713)
    low = {r["symbol"]: r["line"] for r in spectral.principal_lines(t, 10.0).collect()}
    assert low["Cu"] == "L" and low["Au"] == "M" and low["Sn"] == "L"
    assert [(r["symbol"], r["line"]) for r in spectral.lines_in_range(spectral.line_table(spark, ["Si"]), 1.8, 1.6).collect()] == [("Si", "K")]


def test_fraction_errors(spark):
    parts = spark.createDataFrame([("a", 30.0, 3.0), ("a", 70.0, 4.0), ("b", 5.0, 1.0), ("c", 0.0, 0.0)], "g string, q double, q_sigma double")
    got = {(r["g"], r["q"]): (r["fraction"], r["fraction_sigma"]) for r in measure.fraction_sigma(parts, "g").collect()}
    want = 100 * math.sqrt((0.7 * 3 / 100) ** 2 + (0.3 * 4 / 100) ** 2)
    assert got["a", 30.0] == (pytest.approx(0.3), pytest.approx(want)) and got["a", 70.0][1] == pytest.approx(want)
    assert got["b", 5.0] == (1.0, 0.0) and got["c", 0.0] == (None, None)
