"""Displays, frames, descriptors of outlines, ellipses, errors and factors by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import compare, fits, measure, quantify, raster, regions, texture

RNG = np.random.default_rng(4)


def frame(spark, img, ds="a"):
    return spark.createDataFrame([(ds, y + 1, x + 1, float(v)) for y, line in enumerate(img) for x, v in enumerate(line)], "ds_id string, y int, x int, v double")


def array(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["y"] - 1, r["x"] - 1] = r["v"]
    return out


def test_display_and_uint16(spark):
    img = np.array([[0.0, 1.0, 2.0], [np.nan, np.inf, 4.0]])
    assert array(raster.to_display(frame(spark, img), 1, 3), img.shape).tolist() == [[0, 0, 128], [0, 0, 255]]
    got = raster.to_uint16(frame(spark, img)).orderBy("y", "x").collect()
    assert [r["v"] for r in got] == [0, 16384, 32768, 0, 0, 65535] and (got[0]["lo"], got[0]["hi"]) == (0.0, 4.0)
    none = raster.to_uint16(frame(spark, np.array([[np.nan]]))).first()
    assert (none["v"], none["lo"], none["hi"]) == (0, 0.0, 1.0)
    assert {r["v"] for r in raster.to_uint16(frame(spark, np.full((2, 2), 7.0))).collect()} == {0}


def test_thumbnails_pyramids_and_frames(spark):
    img = RNG.random((10, 7))
    got = array(raster.thumbnail(frame(spark, img), 4), (4, 3))
    want = np.array([[img[a : a + 3, b : b + 3].mean() for b in range(0, 7, 3)] for a in range(0, 10, 3)])
    assert np.allclose(got, want)
    tiles = raster.pyramid(frame(spark, img), 3, 4).collect()
    assert len(tiles) == 70 + 5 * 4 + 3 * 2
    for r in tiles:
        y, x, b = r["ty"] * 4 + r["y"] - 1, r["tx"] * 4 + r["x"] - 1, 2 ** r["z"]
        assert r["v"] == pytest.approx(img[y * b : y * b + b, x * b : x * b + b].mean())
    part = raster.crop(frame(spark, img), 8, 6, 3, 2)
    want = np.zeros_like(img)
    want[2:8, 1:6] = img[2:8, 1:6]
    assert np.allclose(array(raster.embed(part, frame(spark, img), 8, 6, 3, 2), img.shape), want)
    texts = spark.createDataFrame([("1, 2,3,4",), ("1,2,3",), ("a,2,3,4",), (None,), ("",)], "t string")
    assert [r["p"] and tuple(r["p"]) for r in texts.select(raster.parse_roi(F.col("t")).alias("p")).collect()] == [(1, 2, 3, 4), None, None, None, None]


def ring(n, a, b, turn=0.0, cx=0.0, cy=0.0, start=0.0):
    t = np.linspace(0, 2 * math.pi, n, endpoint=False) + start
    x, y = a * np.cos(t), b * np.sin(t)
    return cx + x * math.cos(turn) - y * math.sin(turn), cy + x * math.sin(turn) + y * math.cos(turn)


def test_descriptors_keep_under_turns_shifts_and_sizes(spark):
    bump = lambda x, y: (x + 0.3 * np.cos(3 * np.arctan2(y, x)), y)
    base = bump(*ring(120, 5, 2))
    c, s = math.cos(0.7), math.sin(0.7)
    turned = (3 * (c * base[0] - s * base[1]) + 10, 3 * (s * base[0] + c * base[1]) - 4)
    other = ring(120, 5, 4)
    rows = [(k, i, float(x), float(y)) for k, (xs, ys) in enumerate((base, turned, other)) for i, (x, y) in enumerate(zip(np.roll(xs, 17 * k), np.roll(ys, 17 * k), strict=True))]
    h = regions.normalized_harmonics(regions.outline_harmonics(spark.createDataFrame(rows, "ring int, i int, x double, y double"), 6)).cache()
    first = h.where("ring = 0 AND n = 1").first()
    assert first["a"] == pytest.approx(1) and abs(first["b"]) < 1e-9 and abs(first["c"]) < 1e-9
    far = {r["ring"]: r["distance"] for r in regions.harmonic_distance(h, h.where("ring = 0")).collect()}
    assert far[0] == 0 and far[1] < 1e-6 and far[2] > 0.1


def test_ellipses(spark):
    planted = {0: (5.0, 3.0, 0.4, 10.0, -2.0), 1: (8.0, 2.0, -1.2, 0.0, 30.0), 2: (4.0, 4.0, 0.0, 1.0, 1.0)}
    rows = [(k, float(x), float(y)) for k, (a, b, t, cx, cy) in planted.items() for x, y in zip(*ring(40, a, b, t, cx, cy), strict=True)]
    rows += [(7, 0.0, 1.0), (7, 1.0, 1.0)] + [(8, float(i), float(i)) for i in range(9)]
    got = {r["ring"]: r for r in regions.ellipse_fit(spark.createDataFrame(rows, "ring int, x double, y double")).collect()}
    assert {0, 1, 2} <= set(got) and 7 not in got
    for k, (a, b, t, cx, cy) in planted.items():
        r = got[k]
        assert (r["a"], r["b"], r["cx"], r["cy"]) == pytest.approx((a, b, cx, cy), abs=1e-6) and r["n"] == 40
        assert k == 2 or r["angle"] == pytest.approx(t, abs=1e-6)


def test_errors_factors_and_units(spark):
    e = np.arange(0, 10, 0.5)
    v = RNG.integers(50, 90, len(e)).astype(float)
    spectrum = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(e, v, strict=True))], "ds_id string, ch int, e double, v double")
    edges = [("A", 1.0, 4.0, 30.0, 2.0), ("B", 5.0, 8.0, 50.0, 4.0)]
    got = {r["element"]: r for r in quantify.edge_atomic_sigma(spectrum, spark.createDataFrame(edges, "element string, s0 double, s1 double, ratio double, sigma double")).collect()}
    var = []
    for _, lo, hi, _, sigma in edges:
        own = v[(e >= lo) & (e <= hi)]
        k = np.full(len(own), 0.5)
        k[[0, -1]] = 0.25
        var.append((k * k * own).sum() / sigma**2)
    f = np.array([30, 50]) / 80
    for i, name in enumerate("AB"):
        want = 100 * math.sqrt(((1 - f[i]) ** 2 * var[i] + f[i] ** 2 * var[1 - i]) / 80**2)
        assert got[name]["atomic_sigma"] == pytest.approx(want) and got[name]["atomic_pct"] == pytest.approx(100 * f[i])
    one = quantify.edge_atomic_sigma(spectrum, spark.createDataFrame([("A", 1.0, 1.2, 3.0, 2.0)], "element string, s0 double, s1 double, ratio double, sigma double")).first()
    assert one["atomic_sigma"] is None
    z = {r["symbol"]: r["zeta"] for r in quantify.zeta_from_k(spark.createDataFrame([("Si",), ("Fe",), ("Qq",)], "symbol string"), 500.0).collect()}
    assert z == {"Si": 500.0, "Fe": pytest.approx(605.0), "Qq": 500.0}
    assert quantify.solid_angle(30.0, 10.0) == 0.3
    t = spark.createDataFrame([(2000.0, " eV", 3.0, 2.0), (2.0, "KEV", 2.0, 2.0), (5.0, "", 1.0, 4.0), (4e6, "meV", None, 1.0)], "e double, u string, a double, b double")
    got = t.select(quantify.to_kev(F.col("e"), F.col("u")).alias("k"), quantify.chemical_sigma(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["k"] for r in got] == [2.0, 2.0, 5.0, 4.0] and [r["s"] for r in got] == [pytest.approx(math.sqrt(5)), None, None, None]
    with pytest.raises(ValueError):
        quantify.zeta_from_k(t, 0)


def test_self_affine_growth_and_noise(spark):
    lag = np.arange(1, 60)
    rows = [(k, int(i), float(2 * 0.2**2 + 2 * s * s * (1 - math.exp(-((i / x) ** (2 * h)))))) for k, (s, x, h) in enumerate(((1.0, 8.0, 0.7), (2.5, 14.0, 0.5))) for i in lag]
    got = fits.fit_self_affine(spark.createDataFrame(rows, "user_id int, lag int, g double"), ("user_id",)).orderBy("user_id").collect()
    assert (got[0]["length"], got[0]["hurst"]) == pytest.approx((8.0, 0.7), rel=1e-3) and (got[1]["length"], got[1]["hurst"]) == pytest.approx((14.0, 0.5), rel=1e-3)
    flat = texture.noise(frame(spark, np.full((40, 40), 3.0))).first()
    assert flat["sigma"] == 0 and math.isinf(flat["snr"])
    img = 100 + RNG.normal(0, 2, (64, 64))
    for m in ("mad", "localvar", "both"):
        assert texture.noise(frame(spark, img), m).first()["sigma"] == pytest.approx(2, rel=0.4)
    p = measure.radial_profile(frame(spark, img), 6, 10.0, 20.0, True).collect()
    assert min(r["mean"] for r in p) == 0 and max(r["max"] for r in p) == 1
    box = measure.box_integrate(frame(spark, img), 2, 3, 5, 9, "mean").where("axis = 'y' AND at = 4").first()
    assert box["v"] == pytest.approx(img[3, 2:9].mean())


def test_lattice_vectors(spark):
    rows = [(ds, 20 * i + j, 50 + a[0] * i + b[0] * j + RNG.normal(0, 0.05), 40 + a[1] * i + b[1] * j + RNG.normal(0, 0.05)) for ds, a, b in (("a", (9.0, 1.0), (2.0, 7.0)), ("b", (6.0, 0.0), (3.0, 5.2))) for i in range(20) for j in range(20)]
    rows += [("few", k, 1.0 * k, 0.0) for k in range(3)] + [("line", k, 1.0 * k, 0.0) for k in range(9)]
    got = {r["ds_id"]: r for r in compare.lattice_vectors(spark.createDataFrame(rows, "ds_id string, id long, x double, y double")).collect()}
    assert set(got) == {"a", "b"}
    for ds, area in (("a", 61.0), ("b", 31.2)):
        r = got[ds]
        assert abs(r["a1x"] * r["a2y"] - r["a1y"] * r["a2x"]) == pytest.approx(area, rel=0.03)
