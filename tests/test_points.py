"""Points, local equalisation, fits and classifiers against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import learning, measure, points, raster, texture
from lumenframe.operators.quantiles import cumulated
from tests.test_raster import array, frame


def test_separated_is_the_greedy_choice(spark):
    rng = np.random.default_rng(3)
    for distance, ties in ((4.0, ("y", "x")), (2.5, ("x", "y"))):
        places = {tuple(p) for p in rng.integers(-20, 25, (260, 2)).tolist()}
        rows = [("ab"[i % 2], y, x, float(rng.integers(0, 12))) for i, (y, x) in enumerate(sorted(places))]
        got = points.separated(spark.createDataFrame(rows, "ds_id string, y int, x int, v double"), distance, ties)
        kept = []
        for d, y, x, v in sorted(rows, key=lambda r: (r[0], -r[3], *((r[1], r[2]) if ties[0] == "y" else (r[2], r[1])))):
            if all(e != d or (a - y) ** 2 + (b - x) ** 2 >= distance**2 for e, a, b, _ in kept):
                kept.append((d, y, x, v))
        assert sorted(tuple(r) for r in got.select("ds_id", "y", "x", "v").collect()) == sorted(kept)


def test_separated_of_repeats_and_nothing(spark):
    t = spark.createDataFrame([("a", 1, 1, 2.0), ("a", 1, 1, 2.0), ("b", 1, 1, 2.0)], "ds_id string, y int, x int, v double")
    assert points.separated(t, 3.0).count() == 2
    assert points.separated(t.where("false"), 3.0).count() == 0


def test_columns_and_spots(spark):
    yy, xx = np.mgrid[0:40, 0:50]
    a = sum(np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / 8) * h for y, x, h in ((8, 9, 5), (8, 29, 4), (26, 40, 3), (30, 12, 2)))
    found = points.detect_columns(frame(spark, a), 1.0, 0.2, 6.0).orderBy("rank").collect()
    assert [(r["y"], r["x"]) for r in found] == [(9, 10), (9, 30), (27, 41), (31, 13)]
    assert points.detect_columns(frame(spark, -a), 1.0, 0.2, 6.0, bright=False).count() == 4
    assert points.detect_columns(frame(spark, np.ones((9, 9)))).count() == 0
    spots = points.find_spots(frame(spark, a), 13.0, 0.05, 6.0).orderBy("rank").collect()
    assert [(r["y"], r["x"]) for r in spots] == [(9, 10), (27, 41), (31, 13)]  # one lies too near the beam
    assert points.find_spots(frame(spark, a), 13.0, 0.05, 6.0, most=2).count() == 2
    assert points.find_spots(frame(spark, a * 0)).count() == 0


def test_replicated_border(spark):
    a = np.random.default_rng(1).normal(size=(5, 7))
    k = np.array(raster.gaussian_kernel(1.0))
    p = np.pad(a, 3, mode="edge")
    p = np.apply_along_axis(np.convolve, 0, p, k, "valid")
    assert np.allclose(array(raster.gaussian(frame(spark, a), 1.0, replicate=True)), np.apply_along_axis(np.convolve, 1, p, k, "valid"))


def test_ring_on_a_circle(spark):
    yy, xx = np.mgrid[0:61, 0:61]
    ring = np.exp(-((np.hypot(yy - 30, xx - 30) - 18) ** 2) / 2)
    got = points.ring_points(frame(spark, ring), n_angles=24).collect()
    assert len(got) == 24 and all(abs(r["radius"] - 18) <= 1 and math.hypot(r["y"] - 31, r["x"] - 31) == pytest.approx(r["radius"]) for r in got)
    r = spark.range(8).select(F.col("id") * (math.pi / 4)).toDF("t")
    on = r.select((5 + 6 * F.cos("t") * math.sin(0.4) + 3 * F.sin("t") * math.cos(0.4)).alias("y"), (7 + 6 * F.cos("t") * math.cos(0.4) - 3 * F.sin("t") * math.sin(0.4)).alias("x"))
    assert all(v[0] == pytest.approx(math.sqrt(18)) for v in on.select(points.undistorted(F.col("y"), F.col("x"), 5.0, 7.0, 6.0, 3.0, 0.4)).collect())


def test_composite(spark):
    maps = spark.createDataFrame([("a", 1, 1, "Si", 5.0), ("a", 1, 1, "O", 20.0), ("a", 1, 2, "Si", -1.0), ("a", 1, 2, "O", 0.0)], "ds_id string, y int, x int, symbol string, v double")
    colours = spark.createDataFrame([("Si", 0.0, 10.0, 200.0, 0.0, 100.0), ("O", 0.0, 10.0, 0.0, 255.0, 240.0)], "symbol string, lo double, hi double, r double, g double, b double")
    grey = spark.createDataFrame([("a", 1, 1, 7.0), ("a", 1, 2, 9.0)], "ds_id string, y int, x int, v double")
    rgb = lambda df: [tuple(r)[3:] for r in df.orderBy("x").collect()]
    assert rgb(points.colour_composite(maps, colours)) == [(100, 255, 255), (0, 0, 0)]
    assert rgb(points.colour_composite(maps, colours, add=False)) == [(100, 255, 240), (0, 0, 0)]
    assert rgb(points.colour_composite(maps, colours, grey=grey)) == [(107, 255, 255), (9, 9, 9)]


def test_clahe(spark):
    a = np.random.default_rng(2).gamma(2, size=(21, 34))

    def expected(a, clip, bins, n=8):
        h, w = a.shape
        b = np.floor((a - a.min()) / (a.max() - a.min()) * (bins - 1) + 0.5).astype(int)
        ye, xe = (np.floor(np.linspace(0, s, n + 1) + 0.5).astype(int) for s in (h, w))
        lut = np.zeros((n, n, bins))
        for i in range(n):
            for j in range(n):
                t = b[ye[i] : ye[i + 1], xe[j] : xe[j + 1]]
                if not t.size:
                    lut[i, j] = np.linspace(0, 1, bins)
                    continue
                c, most = np.bincount(t.ravel(), minlength=bins).astype(float), max(1, math.floor(clip * t.size + 0.5))
                c = np.minimum(c, most) + np.maximum(0, c - most).sum() / bins
                lut[i, j] = np.cumsum(c) / c.sum()
        weight = lambda e, s: np.array([np.interp(np.arange(1, s + 1), (e[:-1] + e[1:] + 1) / 2, np.eye(n)[i]) for i in range(n)])
        wy, wx = weight(ye, h), weight(xe, w)
        return sum(wy[i][:, None] * wx[j][None, :] * lut[i, j][b] for i in range(n) for j in range(n))

    for img, clip in ((a, 0.1), (a[:5], 0.02), (a, 0.5)):
        assert np.allclose(array(texture.clahe(frame(spark, img), clip, 32)), expected(img, clip, 32))
    assert np.all(array(texture.clahe(frame(spark, np.full((4, 4), 3.0)))) == 0)


def test_five_classes(spark):
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.normal(m, 1.5, 120) for m in (10, 30, 55, 75, 100)])[:600].reshape(20, 30)
    t = texture.multi_otsu(frame(spark, a), 5).first()
    assert [int((a <= t[f"t{i}"]).sum()) for i in range(1, 5)] == [120, 240, 360, 480]
    with pytest.raises(ValueError):
        texture.multi_otsu(frame(spark, a), 6)


def test_fits(spark):
    rng = np.random.default_rng(8)
    data = {"w": rng.weibull(2.3, 900) * 40, "l": np.exp(rng.normal(2, 0.4, 700)), "n": rng.normal(50, 9, 800), "neg": rng.normal(0, 1, 50), "few": np.array([1.0, 2.0, 3.0]), "same": np.full(20, 4.0)}
    pop = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("w", float("nan"))], "grp string, v double")
    got = {(r["grp"], r["kind"]): r for r in measure.fit_all(pop).collect()}
    assert {k for k, r in got.items() if r["best"]} == {("w", "weibull"), ("l", "lognormal"), ("n", "normal"), ("neg", "normal")}
    assert {k for k in got if k[0] in ("neg", "few", "same")} == {("neg", "normal")}
    x, f = data["w"], got["w", "weibull"]
    lo, hi = 0.1, 20.0
    for _ in range(80):  # the root of the likelihood's derivative
        k = (lo + hi) / 2
        lo, hi = (k, hi) if (x**k * np.log(x)).sum() / (x**k).sum() - 1 / k - np.log(x).mean() < 0 else (lo, k)
    scale = (x**k).mean() ** (1 / k)
    assert f["shape"] == pytest.approx(k) and f["scale"] == pytest.approx(scale) and f["n"] == 900
    assert f["loglik"] == pytest.approx((np.log(k / scale) + (k - 1) * np.log(x / scale) - (x / scale) ** k).sum())
    s = np.sort(data["n"])
    c = np.array([0.5 * (1 + math.erf((v - s.mean()) / s.std() / math.sqrt(2))) for v in s])
    i = np.arange(len(s))
    assert got["n", "normal"]["ks"] == pytest.approx(max(((i + 1) / len(s) - c).max(), (c - i / len(s)).max()), abs=1e-6)
    assert measure.fit_all(pop.where("false")).count() == 0


def test_cumulated(spark):
    v = np.random.default_rng(0).integers(-5, 6, 300)
    got = cumulated(spark.createDataFrame([("g", float(x)) for x in v], "grp string, v double"), ["grp"]).collect()
    assert {(r["v"], r["n"], r["upto"], r["size"]) for r in got} == {(float(x), int((v == x).sum()), int((v <= x).sum()), 300) for x in set(v.tolist())}


def test_softmax(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 1, (40, 3)) for m in ((0, 0, 5), (3, 0, 5), (0, 4, 5))])
    x[:, 2] = 5.0  # doesn't vary
    y = np.repeat([2, 5, 9], 40)
    df = spark.createDataFrame([(i, r, int(c)) for i, (r, c) in enumerate(zip(x.tolist(), y, strict=True))] + [(999, [1.0, 1.0, 1.0], None)], "id int, features array<double>, label int")
    m = learning.softmax_train(df, 3, steps=6)
    z = np.hstack([np.ones((120, 1)), (x - x.mean(0)) / np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), 1)])
    w, hot = np.zeros((4, 3)), np.eye(3)[np.repeat([0, 1, 2], 40)]
    soft = lambda w: np.exp(z @ w) / np.exp(z @ w).sum(1, keepdims=True)
    for _ in range(6):
        w -= 0.5 * (z.T @ (soft(w) - hot) / 120 + 1e-3 * np.vstack([np.zeros(3), w[1:]]))
    assert m.classes == [2, 5, 9] and m.steps == 6 and np.allclose(np.array(m.weights).T, w)
    got = learning.softmax_predict(df.where("label is not null"), m).orderBy("id").collect()
    assert np.allclose([r["shares"] for r in got], soft(w)) and np.mean([r["predicted"] == r["label"] for r in got]) > 0.9
    assert learning.softmax_train(df, 3, steps=50, tolerance=10.0).steps == 2
    with pytest.raises(ValueError):
        learning.softmax_train(df.where("false"), 3)


def test_forest(spark):
    nodes = [(0, 0, 0, 0.5, 1, 2, [0.5, 0.5]), (0, 1, -1, 0.0, -1, -1, [1.0, 0.0]), (0, 2, 1, 2.0, 3, 4, [0.5, 0.5]), (0, 3, -1, 0.0, -1, -1, [0.2, 0.8]), (0, 4, -1, 0.0, -1, -1, [0.0, 1.0]), (1, 0, -1, 0.0, -1, -1, [0.6, 0.4])]
    n = spark.createDataFrame(nodes, "tree int, node int, feature int, threshold double, left int, right int, shares array<double>")
    rows = spark.createDataFrame([(1, [0.5, 9.0]), (2, [0.6, 2.0]), (3, [0.6, 2.1])], "id int, features array<double>")
    got = {r["id"]: (r["shares"], r["predicted"]) for r in learning.forest_predict(rows, n, ["a", "b"]).collect()}
    assert got[1] == (pytest.approx([0.8, 0.2]), "a") and got[2] == (pytest.approx([0.4, 0.6]), "b") and got[3] == (pytest.approx([0.3, 0.7]), "b")


def test_r_squared(spark):
    t = spark.createDataFrame([("a", 1.0, 1.5), ("a", 3.0, 2.5), ("b", 2.0, 1.0), ("b", 2.0, 2.0)], "g string, actual double, predicted double")
    assert {r["g"]: r["r2"] for r in measure.r_squared(t, "g").collect()} == {"a": pytest.approx(0.75), "b": 0.0}
