"""Regions, quantification, crystals and texture against numpy and values known by other means."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import crystal, profiles, quantify, raster, regions, texture
from lumenframe.operators.quantiles import blocks, quantiles
from lumenframe.plans import recipes
from lumenframe.streaming.watch import watch
from tests.test_raster import array, frame
from tests.test_values import cube, spectrum


def labels(spark, a):
    return spark.createDataFrame([("a", int(i) + 1, int(j) + 1, int(v)) for (i, j), v in np.ndenumerate(a)], "ds_id string, y int, x int, label int")


def test_quantiles_of_hot_and_odd_groups(spark):
    rng = np.random.default_rng(5)
    data = {"hot": np.concatenate([np.zeros(3000), rng.normal(size=500)]), "one": np.array([-3.5]), "two": np.array([-1.0, 1e9]), "small": rng.normal(size=300) * 1e-300, "near": 1e6 + rng.random(400)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "grp string, v double")
    ps = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["grp"]: r["q"] for r in quantiles(df, ["grp"], ps).collect()}
    for k, v in data.items():
        assert np.allclose(got[k], np.quantile(v, ps), rtol=1e-12, atol=0), k
    assert quantiles(df.where("false"), ["grp"], ps).count() == 0


def test_blocks_see_their_neighbours(spark):
    t = spark.range(1, 60).select(F.lit(1).alias("user_id"), F.col("id").cast("int").alias("i"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    from pyspark.sql import Window as W

    w = W.partitionBy("block").orderBy("i")
    got = blocks(t, "i", 2, 3, size=7).select("i", "own", F.lead("i", 3).over(w).alias("n"), F.lag("i", 2).over(w).alias("p")).where("own").orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(1, 60))
    assert all(r["n"] == (r["i"] + 3 if r["i"] < 57 else None) and r["p"] == (r["i"] - 2 if r["i"] > 2 else None) for r in got)


def test_regions(spark):
    a = np.zeros((6, 8), int)
    a[1:3, 1:5], a[4, 6], a[3:6, 1:3] = 4, 7, 9
    img = np.arange(48.0).reshape(6, 8)
    got = regions.region_stats(labels(spark, a), frame(spark, img), 2, 2.0).orderBy("id").collect()
    assert [(r["id"], r["label"], r["area"], r["y0"], r["x1"], r["area_cal"]) for r in got] == [(1, 4, 8, 2, 5, 32.0), (2, 9, 6, 4, 3, 24.0)]
    assert got[0]["mean"] == img[a == 4].mean() and got[0]["diameter"] == pytest.approx(math.sqrt(32 / math.pi))
    n = regions.boundary_network(labels(spark, a)).first()
    assert (n["network"], n["boundary"], n["junctions"], n["network_cal"]) == (2, 4, 0, None)
    m = {r["label"]: r for r in regions.shape_moments(labels(spark, a)).collect()}
    assert m[4]["orientation"] == pytest.approx(math.pi / 2) and m[4]["aspect"] == pytest.approx(math.sqrt(1.25 / 0.25)) and m[7]["aspect"] is None
    assert regions.region_stats(labels(spark, a).where("false"), frame(spark, img)).count() == 0


def test_outlines(spark):
    rows = [(1, i, x, y) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 3), (0, 3)])] + [(2, i, 5 + 2 * math.cos(t), 1 + 2 * math.sin(t)) for i, t in enumerate(np.linspace(0, 2 * math.pi, 64, endpoint=False).tolist())] + [(3, i, float(i), float(i)) for i in range(4)]
    v = spark.createDataFrame([(a, b, float(c), float(d)) for a, b, c, d in rows], "ring int, i int, x double, y double")
    p = {r["ring"]: r for r in regions.polygon_stats(v).collect()}
    assert (p[1]["area"], p[1]["perimeter"], p[1]["cx"], p[1]["cy"]) == (12, 14, 2, 1.5) and p[3]["area"] == 0 and p[3]["cx"] == 1.5
    c = {r["ring"]: r for r in regions.circle_fit(v).collect()}
    assert c[2]["radius"] == pytest.approx(2) and c[2]["cx"] == pytest.approx(5) and c[2]["rms"] == pytest.approx(0, abs=1e-6) and c[3]["radius"] is None
    h = {r["n"]: r for r in regions.outline_harmonics(v.where("ring = 2"), 2).collect()}
    assert h[1]["a"] == pytest.approx(2, rel=5e-3) and h[1]["d"] == pytest.approx(2, rel=5e-3) and abs(h[2]["a"]) < 1e-6


def test_layers(spark):
    a = np.zeros((12, 4), int)
    a[2:8] = 1
    bands = spark.createDataFrame([("a", 0, 0.0, 5.0), ("a", 1, 5.0, 12.0)], "ds_id string, layer int, top double, bottom double")
    s = regions.layer_slices(labels(spark, a), bands).orderBy("layer").collect()
    assert [(r["area"], r["height"], r["share"]) for r in s] == [(12, 3.0, 0.5), (12, 3.0, 0.5)] and s[0]["angle"] == 0
    step = np.repeat(np.where(np.arange(30) < 12, 1.0, 5.0)[:, None], 5, axis=1)
    assert [r["i"] for r in profiles.interfaces(regions.depth_profile(frame(spark, step))).collect()] in ([11], [12])
    assert all(abs(r["depth"] - 11.5) <= 0.5 for r in profiles.trace_interface(frame(spark, step), 12, 5).collect())


def test_zeta_by_hand_and_zaf_of_thin_films(spark):
    maps = spark.createDataFrame([("a", 1, 1, "Fe", 1.0, 55.845, 2000.0), ("a", 1, 1, "O", 1.0, 15.999, 1000.0)], "ds_id string, y int, x int, symbol string, k double, mass double, v double")
    got = {r["symbol"]: r for r in quantify.zeta(maps, ["Fe", "O"], [500.0, 1000.0], 1e10, absorbing=False).collect()}
    assert got["Fe"]["weight_pct"] == pytest.approx(50) and got["O"]["mass_thickness"] == pytest.approx(2e-4)
    thick = {r["symbol"]: r["weight_pct"] for r in quantify.zeta(maps, ["Fe", "O"], [500.0, 1000.0], 1e10).collect()}
    assert thick["O"] > 50 and sum(thick.values()) == pytest.approx(100)
    thin = {r["symbol"]: r["weight_pct"] for r in quantify.zaf(maps, ["Fe", "O"], 1e-6).collect()}
    assert thin["Fe"] == pytest.approx(200 / 3, rel=1e-6)
    assert quantify.dose(1.0, 1.0) / 1e9 == pytest.approx(6.2415, abs=1e-4)


def test_widths_and_continuum(spark):
    w = spark.createDataFrame([(5.899,), (8.048,)], "e double").select(quantify.fano_fwhm(F.col("e")).alias("w")).collect()
    assert w[0]["w"] == pytest.approx(130) and w[1]["w"] > 130
    e = np.linspace(0.5, 12, 100)
    law = 3 * np.where(e < 10, (10 - e) / e, 0)
    s = spectrum(spark, e, law + 50 * np.exp(-((e - 6.4) ** 2) / 0.02))
    got = quantify.continuum(s, 10.0, spark.createDataFrame([(5.5, 7.3)], "lo double, hi double")).orderBy("ch").collect()
    assert np.allclose([r["continuum"] for r in got], law)


def test_edges_by_pixel_and_cross_sections(spark):
    e = 300 + 2.0 * np.arange(400)
    bg = 8000 * (e / 300) ** -3.0
    v = bg + 40 * (e >= 532) + 25 * (e >= 708)
    rows = [("O", "K", 532.0, 532.0, 572.0, 462.0, 522.0), ("Fe", "L", 708.0, 708.0, 748.0, 632.0, 698.0)]
    edges = spark.createDataFrame(rows, "element string, shell string, onset double, s0 double, s1 double, b0 double, b1 double")
    got = {r["element"]: r for r in quantify.edge_quantify(cube(spark, e, [v]), edges, 200.0, 10.0).collect()}
    assert got["O"]["intensity"] == pytest.approx(40 * 40, rel=1e-6) and got["O"]["atomic_pct"] + got["Fe"]["atomic_pct"] == pytest.approx(100)
    found = {(r["symbol"], r["edge"]): r for r in quantify.identify_edges(spectrum(spark, e, v)).collect()}
    assert found["O", "K"]["net"] == pytest.approx(40 * 26, rel=1e-6) and found["O", "K"]["band"] == "trace"
    assert found["O", "K"]["significance"] == pytest.approx(40 * 26 / math.sqrt(v[(e >= 532) & (e <= 582)].sum()))
    assert found["N", "K"]["significance"] < 1e-3

    sigma = edges.select("element", quantify.cross_section(F.col("shell"), F.col("onset"), F.lit(40.0), 200.0, 10.0).alias("s")).collect()
    assert all(1e-27 < r["s"] < 1e-23 for r in sigma)
    rel = quantify.near_edge(spectrum(spark, e, v), 532.0, (462.0, 522.0)).collect()
    assert all(r["intensity"] == pytest.approx(1, rel=1e-6) for r in rel) and len(rel) == 16


@pytest.mark.parametrize("order,want", [(0, lambda x: x**3 - x), (1, lambda x: 3 * x**2 - 1)])
def test_savgol_keeps_polynomials_to_the_ends(spark, order, want):
    x = np.arange(20) * 0.5
    got = [r["v"] for r in quantify.savgol(spectrum(spark, x, x**3 - x), 7, 3, order, 0.5).orderBy("ch").collect()]
    assert np.allclose(got, want(x))
    with pytest.raises(ValueError):
        quantify.savgol_weights(6, 2)


def test_crystals(spark):
    si = crystal.phases(spark).where("name = 'Silicon'")
    got = crystal.reflections(si, 3).orderBy(F.desc("d")).collect()
    assert [(r["h"], r["k"], r["l"], r["multiplicity"]) for r in got[:3]] == [(1, 1, 1, 8), (0, 0, 2, 6), (0, 2, 2, 12)]
    assert got[0]["d"] == pytest.approx(5.4309 / math.sqrt(3))
    assert crystal.wavelength(F.lit(200.0)) is not None
    assert spark.range(1).select(crystal.wavelength(F.lit(200.0)).alias("w")).first()["w"] == pytest.approx(0.02507934, rel=1e-6)
    d = [r["d"] for r in got]
    spots = spark.createDataFrame([(i, v * 1.001) for i, v in enumerate(d[:4])], "spot int, d double")
    best = crystal.index_spots(spots, crystal.phases(spark).where("centering = 'F'"), 0.005).orderBy("rank").first()
    assert best["name"] == "Silicon" and best["score"] == 1


def test_texture(spark):
    rng = np.random.default_rng(2)
    flat = 100 + rng.normal(scale=3, size=(64, 64))
    n = texture.noise(frame(spark, flat)).first()
    lap = np.diff(np.diff(flat, 2, axis=0), 2, axis=1)
    assert n["sigma"] == pytest.approx(np.median(abs(lap)) / 0.6745 / math.sqrt(20)) and n["kind"] == "gaussian"
    y, x = np.mgrid[0:40, 0:40]
    o = texture.growth_orientation(frame(spark, np.sin(y / 3.0)), 2.0).first()
    assert o["axis"] == "y" and abs(o["tilt"]) < 1e-6 and o["coherence"] > 0.99
    three = np.select([x < 10, x < 25], [1.0, 5.0], 9.0)
    t = texture.multi_otsu(frame(spark, three), 3, 64).first()
    assert 1 < t["t1"] < 5 < t["t2"] < 9
    assert texture.surface_area_ratio(frame(spark, three * 0)).first()["ratio"] == pytest.approx(1)
    assert texture.surface_area_ratio(frame(spark, 1.0 * x)).first()["ratio"] == pytest.approx(math.sqrt(2))
    ramp = texture.band_profile(frame(spark, 1.0 * x), 5, 20, 30, 20, 5).orderBy("i").collect()
    assert [r["v"] for r in ramp] == pytest.approx(list(range(4, 30))) and all(r["sem"] == 0 for r in ramp)


def test_frames(spark):
    y, x = np.mgrid[0:9, 0:12]
    a = 2.0 + x - 0.5 * y + 0.1 * x * x - 0.3 * y * y + 0.05 * x * y
    assert np.allclose(array(raster.quadratic_level(frame(spark, a))), 0, atol=1e-9)
    assert (array(raster.crop(frame(spark, a), 3, 8, 6, 2)) == a[2:6, 1:8]).all()
    sq = np.arange(25.0).reshape(5, 5)
    assert np.allclose(array(raster.turn(frame(spark, sq), 90)), np.rot90(sq))
    assert np.allclose(array(raster.turn(frame(spark, sq), 0)), sq)


def test_recipe_of_a_cube(spark, tmp_path):
    e = np.round(0.01 * np.arange(1200), 2)
    v = 2 + 60 * np.exp(-((e - 6.404) ** 2) / (2 * 0.03**2)) + 40 * np.exp(-((e - 1.74) ** 2) / (2 * 0.03**2))
    steps = [{"op": "eds_quantify", "params": {"elements": "Fe, Si"}}, {"op": "eds_element_map", "params": {"e_lo": 6.2, "e_hi": 6.6}}, {"op": "image_stats"}]
    img, values = recipes.run(cube(spark, e, [v, v]), steps)
    q = {r["symbol"]: r["weight_pct"] for r in values[0][1].collect()}
    assert q["Fe"] == pytest.approx(100 * 60 * 1.21 / (60 * 1.21 + 40), rel=1e-3)
    recipes.save(img, values, steps, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/image").count() == 2
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/01-image_stats").first()["n"] == "2"
    with pytest.raises(ValueError, match="needs a cube"):
        recipes.run(cube(spark, e, [v]), [steps[1], steps[0]])
    with pytest.raises(ValueError, match="is needed"):
        recipes.resolve({"op": "rotate"})


def test_watch_goes_on_after_an_error(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    frame(spark, np.ones((4, 4))).coalesce(1).write.parquet(src)
    watch(spark, src, out, ck, [{"op": "eds_element_map", "params": {"e_lo": 1, "e_hi": 2}}]).awaitTermination()
    assert "needs a cube" in spark.read.json(f"{out}/_errors").first()["error"]
