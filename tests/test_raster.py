"""Raster and measurement operators against numpy on the golden raster and small cases."""

import numpy as np
import pytest

from lumenframe.operators import measure, raster

Y, X = np.mgrid[1:65, 1:97]
BASE = np.sin(Y / 7) * np.cos(X / 11) + 0.001 * Y * X / (64 * 96)
NOISY = BASE + 0.05 * np.sin(13 * Y + 7 * X)


def frame(spark, a, ds="a"):
    return spark.createDataFrame([(ds, int(i) + 1, int(j) + 1, float(v)) for (i, j), v in np.ndenumerate(a)], "ds_id string, y int, x int, v double")


def array(df):
    rows = df.collect()
    out = np.full((max(r["y"] for r in rows), max(r["x"] for r in rows)), np.nan)
    for r in rows:
        out[r["y"] - 1, r["x"] - 1] = r["v"]
    return out


def test_gaussian_and_median(spark):
    g = array(raster.gaussian(frame(spark, NOISY), 2.0))
    k = np.array(raster.gaussian_kernel(2.0))
    want = np.apply_along_axis(lambda v: np.convolve(v, k, "same"), 0, NOISY)
    want = np.apply_along_axis(lambda v: np.convolve(v, k, "same"), 1, want)
    assert np.allclose(g, want, atol=1e-12)
    assert array(raster.gaussian(frame(spark, BASE), 2.0))[19, 29] == pytest.approx(-0.2426330164, abs=1e-9)
    m = array(raster.median(frame(spark, NOISY), 5))
    p = np.pad(NOISY, 2, "edge")
    want = np.median(np.lib.stride_tricks.sliding_window_view(p, (5, 5)), axis=(2, 3))
    assert np.allclose(m, want)
    with pytest.raises(ValueError, match="window_size"):
        raster.median(frame(spark, NOISY), 4)


def test_geometry_and_bins(spark):
    a = np.arange(35.0).reshape(5, 7)
    f = frame(spark, a)
    for n in range(4):
        assert (array(raster.rotate(f, n)) == np.rot90(a, -n)).all()
    assert (array(raster.flip(f, True)) == a[:, ::-1]).all() and (array(raster.flip(f, False)) == a[::-1]).all()
    assert (array(raster.bin_image(f, 2, "sum")) == a[:4, :6].reshape(2, 2, 3, 2).sum(axis=(1, 3))).all()


def test_many_rasters_at_once(spark):
    a, b = np.arange(12.0).reshape(3, 4), np.ones((3, 4))
    both = frame(spark, a, "a").union(frame(spark, b, "b"))
    got = {r["ds_id"]: r for r in measure.image_stats(both).collect()}
    assert got["a"]["std"] == pytest.approx(a.std()) and got["b"]["std"] == 0
    flat = array(raster.normalize01(both).where("ds_id = 'b'"))
    assert (flat == 0).all()


def test_plane_roughness_and_otsu(spark):
    rng = np.random.default_rng(3)
    a = 3 + 0.2 * Y[:20, :30] - 0.1 * X[:20, :30] + rng.normal(size=(20, 30))
    f = frame(spark, a)
    m = np.column_stack([np.ones(600), Y[:20, :30].ravel(), X[:20, :30].ravel()])
    want = a.ravel() - m @ np.linalg.lstsq(m, a.ravel(), rcond=None)[0]
    assert np.allclose(array(raster.plane_level(f)).ravel(), want)
    r = measure.roughness(f).first()
    assert r["rq"] == pytest.approx(want.std()) and r["ra"] == pytest.approx(np.abs(want).mean()) and r["rku"] == pytest.approx((want**4).mean() / want.std() ** 4)
    two = np.where(X[:20, :30] > 15, 10.0, 1.0)
    assert 1 < raster.otsu(frame(spark, two)).first()["threshold"] <= 10


def test_empty_raster(spark):
    empty = spark.createDataFrame([], "ds_id string, y int, x int, v double")
    for df in (raster.gaussian(empty), raster.median(empty), raster.bin_image(empty), raster.plane_level(empty), raster.otsu(empty), measure.image_stats(empty), measure.roughness(empty)):
        assert df.count() == 0
