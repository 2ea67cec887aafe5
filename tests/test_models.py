"""Trees, clusters, components, fits, interfaces, traces, defects and the settling watch against brute force and planted cases."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import clusters, defects, fits, forest, learning, profiles
from lumenframe.plans import recipes
from lumenframe.streaming.watch import watch_settled

RNG = np.random.default_rng(9)


def gini(y):
    return 1 - sum((np.bincount(y, minlength=2) / len(y)) ** 2) if len(y) else 0


def best_cut(x, y, edges, least):
    """Best (score, feature, edge) by trying them all."""
    out = []
    for f, own in enumerate(edges):
        for e in own:
            left = x[:, f] <= e
            if min(left.sum(), (~left).sum()) >= least:
                out.append((round(sum(np.bincount(y[s], minlength=2) @ np.bincount(y[s], minlength=2) / s.sum() for s in (left, ~left)), 9), -f, -e))
    return max(out) if out else None


def test_tree_equals_brute_force(spark):
    x = RNG.random((300, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(int)
    edges = [[0.1 * i for i in range(1, 10)]] * 3
    rows = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label int")
    nodes, classes = forest.forest_train(rows, 3, n_trees=1, max_depth=3, min_leaf=4, max_features=3, bootstrap=False, edges=edges)
    tree = {r["node"]: r for r in nodes.collect()}
    assert classes == [0, 1]

    def check(node, some, depth):
        t = tree[node]
        assert t["shares"][1] == pytest.approx(y[some].mean())
        cut = best_cut(x[some], y[some], edges, 4) if depth < 3 and 0 < y[some].mean() < 1 else None
        if cut is None:
            assert t["feature"] == -1
            return
        assert (t["feature"], t["threshold"]) == (-cut[1], -cut[2])
        left = x[:, t["feature"]] <= t["threshold"]
        check(t["left"], some & left, depth + 1)
        check(t["right"], some & ~left, depth + 1)

    check(0, np.ones(300, bool), 0)


def test_forest_learns(spark):
    x = RNG.normal(size=(600, 4))
    y = ((x[:, 0] ** 2 + x[:, 1] ** 2) > 1.4).astype(int)
    rows = spark.createDataFrame([(i, [*a.tolist(), None] if i == 5 else a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, label int")
    nodes, classes = forest.forest_train(rows.where("id < 400"), 4, n_trees=12, max_depth=6, min_leaf=2)
    again, _ = forest.forest_train(rows.where("id < 400"), 4, n_trees=12, max_depth=6, min_leaf=2)
    assert nodes.exceptAll(again).count() == 0 and nodes.select("tree").distinct().count() == 12
    got = learning.forest_predict(rows.where("id >= 400"), nodes, classes, depth=6).join(rows, "id")
    right = got.where("predicted = label").count()
    assert right > 1.2 * max(y[400:].sum(), 200 - y[400:].sum())
    w = np.concatenate([forest.draws(np.arange(20_000), t, 0) for t in range(3)])
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.04)


def test_kmeans(spark):
    x = np.concatenate([RNG.normal(c, 0.3, (60, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    rows = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)] + [(999, None)], "id long, features array<double>")
    starts = x[[0, 1, 2]].copy()
    found = clusters.kmeans(rows, 3, starts=starts.tolist(), steps=20, tolerance=1e-6)
    c = starts.copy()
    for _ in range(20):
        near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.stack([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(3)])
    assert np.allclose(np.sort(found.centres, axis=0), np.sort(c, axis=0)) or found.inertia <= ((x[:, None] - c) ** 2).sum(2).min(1).sum() + 1e-9
    best = clusters.kmeans(rows, 3, seed=3, replicates=3)
    assert best.inertia == pytest.approx(sum(((x[i * 60 : i * 60 + 60] - x[i * 60 : i * 60 + 60].mean(0)) ** 2).sum() for i in range(3)))
    assert clusters.cluster_of(rows, best).where("cluster is null").count() == 1
    sub = {r["id"]: r["sublattice"] for r in clusters.sublattices(rows.where("id < 180"), 3, seed=3).collect()}
    assert len(set(map(sub.get, range(60, 120)))) == 1 and sub[70] == 1


def test_components(spark):
    v = RNG.random((5, 6, 8)) @ RNG.random((8, 8))
    cube = spark.createDataFrame([("c", y + 1, x + 1, ch, 1.0 * ch, float(v[y, x, ch])) for y in range(5) for x in range(6) for ch in range(8)], "ds_id string, y int, x int, ch int, e double, v double")
    found = clusters.decompose(cube)
    flat = v.reshape(30, 8)
    u, s, vt = np.linalg.svd(flat - flat.mean(0), full_matrices=False)
    assert np.allclose(found.singular, s, atol=1e-5) and np.allclose(np.abs(found.spectra), np.abs(vt), atol=1e-5) and sum(found.shares) == pytest.approx(100)
    two = clusters.decompose(cube, 2)
    want = ((u[:, :2] * s[:2]) @ vt[:2] + flat.mean(0)).reshape(5, 6, 8)
    for r in clusters.denoised(cube, two).collect():
        assert r["v"] == pytest.approx(want[r["y"] - 1, r["x"] - 1, r["ch"]], abs=1e-6)


def test_planted_peaks_of_all_pixels(spark):
    """Curves without noise: parameters come back at 1e-4 for every pixel; with a bound in the way they rest on it."""
    e = np.linspace(0.1, 10, 120)
    parts = [fits.Part("l", "power_law", (None, None), settings={"below": 2.0}), fits.Part("g", "gaussian", (None, 3.0, 0.3)), fits.Part("p", "pseudo_voigt", (None, 7.0, 0.4, 0.5))]
    planted, rows = {}, []
    for k in range(30):
        p = np.array([[RNG.uniform(50, 90), RNG.uniform(0.8, 1.4), RNG.uniform(20, 60), RNG.uniform(2.9, 3.2), RNG.uniform(0.2, 0.4), RNG.uniform(20, 60), RNG.uniform(6.8, 7.2), RNG.uniform(0.3, 0.5), RNG.uniform(0.2, 0.8)]])
        planted[k] = p[0]
        rows += [("c", k, 1, ch, float(e[ch]), float(v)) for ch, v in enumerate(fits.model_curves(e, parts, p)[0])]
    cube = spark.createDataFrame(rows, "ds_id string, y int, x int, ch int, e double, v double")
    got = fits.fit_spectra(fits.spectra_rows(cube, "ds_id", "y", "x"), parts, "poisson").collect()
    assert len(got) == 30
    for r in got:
        assert r["converged"] and np.allclose(r["params"], planted[r["y"]], rtol=1e-4) and r["r2"] == pytest.approx(1)
        assert r["areas"][0] == pytest.approx(planted[r["y"]][2] * planted[r["y"]][4] * math.sqrt(2 * math.pi), rel=1e-4)
    held = [fits.Part("g", "gaussian", (None, 3.0, 0.3), upper=(None, 2.5), fixed=("sigma",)), fits.Part("b", "polynomial", (None, 0.0))]
    one = fits.fit_spectra(fits.spectra_rows(cube.where("y = 0"), "y"), held).first()
    assert one["params"][1] == pytest.approx(2.5) and one["errors"][2] == 0
    with pytest.raises(Exception, match="fewer than two"):
        fits.fit_spectra(fits.spectra_rows(cube, "y"), held, fit_range=(50, 60)).collect()
    assert fits.fit_spectra(fits.spectra_rows(cube.where("false"), "y"), held).count() == 0


def test_voigt_and_edges(spark):
    x = np.linspace(-40, 40, 200_001)
    v = fits.voigt_profile(x, 0.5, 0.2)
    assert v.sum() * (x[1] - x[0]) == pytest.approx(1, abs=5e-3)
    t = np.linspace(-6, 6, 4001)
    folded = (np.exp(-0.5 * (t / 0.5) ** 2) / (0.5 * math.sqrt(2 * math.pi)) * 0.2 / math.pi / ((1.0 - t) ** 2 + 0.04)).sum() * (t[1] - t[0])
    assert fits.voigt_profile(np.array([1.0]), 0.5, 0.2)[0] == pytest.approx(folded, rel=1e-6)
    e = np.linspace(150, 900, 150)
    edges = [("C", "K", 284.0), ("O", "K", 532.0)]
    parts = [fits.Part("b", "power_law", (None, None)), *fits.edge_parts(edges, e, 200.0, 10.0)]
    rows = [("c", 1, k + 1, ch, float(e[ch]), float(v)) for k in range(4) for ch, v in enumerate(fits.model_curves(e, parts, np.array([[1e9, 2.7, 40.0 + 10 * k, 30.0]]))[0])]
    cube = spark.createDataFrame(rows, "ds_id string, y int, x int, ch int, e double, v double")
    got = {(r["x"], r["element"]): r for r in fits.fit_edges_map(cube, edges, 200.0, 10.0).collect()}
    whole = {(r["x"], r["element"]): r for r in fits.fit_edges(cube, edges, 200.0, 10.0, keys=("ds_id", "x")).collect()}
    for k in range(4):
        share = 100 * (40 + 10 * k) / (70 + 10 * k)
        assert got[k + 1, "C"]["atomic_pct"] == pytest.approx(share, rel=1e-3) and whole[k + 1, "C"]["atomic_pct"] == pytest.approx(share, rel=1e-4)


def test_artifacts_measured_and_removed(spark):
    e = np.arange(200) * 0.05
    arts = spark.createDataFrame([("Si", "Si", "sum", 3.48), ("Fe", None, "escape", 4.66)], "a string, b string, kind string, energy double")
    width = lambda x: math.sqrt(130**2 + 5.545177 * 0.12 * 3.85 * (x - 5.899) * 1000) / 2.354820045 / 1000
    v = 50 + 2 * e + sum(n / (width(c) * math.sqrt(2 * math.pi)) * np.exp(-0.5 * ((e - c) / width(c)) ** 2) for c, n in ((3.48, 40.0), (4.66, 25.0)))
    spectrum = spark.createDataFrame([("c", ch, float(a), float(b)) for ch, (a, b) in enumerate(zip(e, v, strict=True))], "ds_id string, ch int, e double, v double")
    m = fits.measure_artifacts(spectrum, arts).cache()
    got = {r["energy"]: r["net"] for r in m.collect()}
    assert got[3.48] == pytest.approx(40, rel=1e-3) and got[4.66] == pytest.approx(25, rel=1e-3)
    clean = fits.remove_artifacts(spectrum, m).collect()
    assert max(abs(r["v"] - 50 - 2 * r["e"]) for r in clean) < 0.1


def plain_peaks(g, least, distance):
    """Peaks by the rule: strict local maxima (middles of plateaus), the higher ones keep others away."""
    found, i = [], 1
    while i < len(g) - 1:
        if g[i - 1] < g[i]:
            j = i
            while j + 1 < len(g) and g[j + 1] == g[i]:
                j += 1
            if j + 1 < len(g) and g[j + 1] < g[i] and g[i] >= least:
                found.append((i + j) // 2)
            i = j
        i += 1
    kept = []
    for p in sorted(found, key=lambda p: (-g[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


def blurred(line, sigma):
    n = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    return np.convolve(np.pad(line, n, mode="symmetric"), k / k.sum(), "valid")


def test_interfaces(spark):
    lines = {f"p{k}": np.repeat(RNG.random(7) * 10, 12) + RNG.normal(0, 0.3, 84) for k in range(3)} | {"flat": np.ones(40), "short": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(n, i, float(v)) for n, line in lines.items() for i, v in enumerate(line)], "ds_id string, i int, v double")
    got, held = profiles.interfaces(df).collect(), profiles.persistent_interfaces(df).collect()
    two = profiles.interfaces(df, n_layers=3).collect()
    for n, line in lines.items():
        if len(line) < 5 or np.ptp(line) == 0:
            assert not [r for r in got if r["ds_id"] == n]
            continue
        g = np.abs(np.gradient(blurred(line, 1.5)))
        want = plain_peaks(g, 0.3 * g.max(), 5)
        assert sorted(r["i"] for r in got if r["ds_id"] == n) == want
        assert sorted(r["i"] for r in two if r["ds_id"] == n) == sorted(sorted(want, key=lambda i: g[i])[-2:])
        per = [plain_peaks(s, 0.3 * s.max(), 5) for s in (np.abs(np.gradient(blurred(line, t))) for t in (2.0, 4.0, 8.0))]
        keep = []
        for c in sorted({p for pk in per for p in pk}):
            if sum(any(abs(p - c) <= 5 for p in pk) for pk in per) >= 2 and (not keep or c - keep[-1] > 5):
                keep.append(c)
        assert sorted(r["i"] for r in held if r["ds_id"] == n) == keep


def plain_clean(y, order=2, kappa=4.0, rounds=3):
    """The rule of clean_trace() with numpy's fits."""
    x, keep = np.arange(len(y), dtype=float), np.isfinite(y)
    for _ in range(rounds):
        res = y - np.polyval(np.polyfit(x[keep], y[keep], order), x)
        s = 1.4826 * np.median(np.abs(res[keep] - np.median(res[keep])))
        new = np.isfinite(y) & (np.abs(res) <= kappa * s)
        if (new == keep).all():
            break
        keep = new
    return keep, y - np.polyval(np.polyfit(x[keep], y[keep], order), x)


def test_trace_and_its_roughness(spark):
    """Planted: a smooth wave of a known deviation, a bow, jitter of single lines and wild lines."""
    rows, lines, planted = [], {}, {}
    for seed in range(20):
        rng = np.random.default_rng(seed)
        wave = blurred(rng.normal(size=3000), 6.0)
        wave *= 1.5 / wave.std()
        x = np.arange(3000)
        y = 20 + 0.002 * x + 1e-6 * x**2 + wave + rng.normal(0, 0.3, 3000) + np.where(x % 157 == 9, 40, 0)
        name = f"t{seed:02d}"
        lines[name], planted[name] = y, 1.5
        rows += [(name, int(i), float(v)) for i, v in enumerate(y)]
    trace = spark.createDataFrame(rows, "ds_id string, x int, depth double")
    clean = profiles.clean_trace(trace).cache()
    assert clean.where("x % 157 = 9 AND kept").count() == 0
    keep, res = plain_clean(lines["t03"])
    got = {r["x"]: r for r in clean.where("ds_id = 't03'").collect()}
    assert [got[i]["kept"] for i in range(3000)] == keep.tolist()
    assert all(got[i]["residual"] == pytest.approx(res[i], abs=1e-6) for i in range(3000) if keep[i])
    found = profiles.trace_sigma(clean).collect()
    assert len(found) == 20 and sum(r["low"] <= 1.5 <= r["high"] for r in found) >= 19
    assert all(0.9 < r["quality"] < 1 and r["noise"] == pytest.approx(0.3, abs=0.1) for r in found)
    short = profiles.clean_trace(spark.createDataFrame([("a", x, float("nan") if x == 2 else 1.0 * x) for x in range(4)], "ds_id string, x int, depth double"))
    assert short.where("kept").count() == 0 and profiles.trace_sigma(short).first()["sigma"] is None


def test_defects_and_scale_bar(spark):
    img = RNG.random((70, 83))
    df = spark.createDataFrame([("a", y + 1, x + 1, float(img[y, x])) for y in range(70) for x in range(83)], "ds_id string, y int, x int, v double")
    ks = [np.array(defects.oriented_kernel(7, a)) for a in (0.0, 45.0)]
    pad = np.pad(img, 3)
    want = np.max([np.abs(sum(k[a, b] * pad[6 - a : 76 - a, 6 - b : 89 - b] for a in range(7) for b in range(7))) for k in ks], axis=0)
    for r in defects.line_response(df, 7, (0.0, 45.0)).collect():
        assert r["v"] == pytest.approx(want[r["y"] - 1, r["x"] - 1])
    img = np.full((100, 200), 50.0)
    img[90:93, 20:80] = 255.0
    img[95, 10:14] = 0.0
    bar = spark.createDataFrame([("a", y + 1, x + 1, float(img[y, x])) for y in range(100) for x in range(200)], "ds_id string, y int, x int, v double")
    got = defects.scale_bar(bar.unionByName(bar.withColumn("ds_id", F.lit("b")).withColumn("v", F.lit(1.0)))).orderBy("ds_id").collect()
    assert tuple(got[0])[1:] == (True, 60, 21, 80, 91) and tuple(got[1])[1:] == (False, 0, 0, 0, 0)


def test_recipes_cover_values_and_words(spark):
    img = spark.createDataFrame([("a", y, x, float(y * x)) for y in range(1, 33) for x in range(1, 33)], "ds_id string, y int, x int, v double")
    steps = [{"op": "roughness", "params": {"level": "quadratic"}}, {"op": "noise", "params": {"method": "both"}}, {"op": "radial_profile", "params": {"center_x": "4", "center_y": 5, "normalize": "yes"}}, {"op": "distribution_fit", "params": {"values": "1, 2, 3, 4, 5, 6, 7, 8, 9", "fit": "normal"}}, {"op": "morph", "params": {"shape": "disk"}}]
    out, values = recipes.run(img, steps)
    assert [n for n, _ in values] == ["roughness", "noise", "radial_profile", "distribution_fit"]
    assert values[3][1].select("kind").distinct().collect()[0][0] == "normal" and values[2][1].agg(F.max("mean")).first()[0] == 1.0
    assert {r["v"] for r in out.select("v").distinct().collect()} == {0.0, 1.0}
    cube = spark.createDataFrame([("c", y, x, ch, 1.0 + 0.2 * ch, 50.0 + ch) for y in range(1, 5) for x in range(1, 5) for ch in range(40)], "ds_id string, y int, x int, ch int, e double, v double")
    _, values = recipes.run(cube, [{"op": "composition_profile", "params": {"elements": "Si,Fe", "x1": 1, "y1": 1, "x2": 4, "y2": 1, "n_points": 7}}, {"op": "eels_quantify", "params": {"elements": ["A", "B"], "shells": "K,L", "onset_ev": "3,5", "signal_windows": "3:4,5:6", "bg_windows": "1:2.5,3:4.5"}}])
    assert values[0][1].where("symbol = 'Si'").count() == 7 and values[1][1].count() == 32
    frames, _ = recipes.run(cube, [{"op": "explode"}, {"op": "fliph"}])
    assert frames.select("ds_id").distinct().count() == 40
    for bad in ({"op": "roughness", "params": {"level": "cubic"}}, {"op": "crop", "params": {"r1": 1}}, {"op": "bin", "params": {"bin_size": 2.5}}, {"op": "eels_quantify", "params": {"elements": "A", "shells": "K,L", "onset_ev": "3", "signal_windows": "3:4", "bg_windows": "1:2"}}):
        with pytest.raises(ValueError):
            recipes.resolve(bad, spark)


def test_a_growing_file_fires_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    staged = tmp_path / "staged"
    spark.createDataFrame([("a", y, x, float(y)) for y in range(1, 5) for x in range(1, 5)], "ds_id string, y int, x int, v double").coalesce(1).write.parquet(str(staged))
    data = next(staged.glob("part-*.parquet")).read_bytes()
    q = watch_settled(spark, str(src), str(out), str(ck), [{"op": "fliph"}], 0.5)
    try:
        for end in (len(data) // 3, len(data) // 2, len(data)):
            (src / "a.parquet").write_bytes(data[:end])
            time.sleep(0.3)
        stop = time.time() + 60
        while time.time() < stop and not list(out.glob("batch=*/part-*")):
            time.sleep(0.5)
        time.sleep(3)
    finally:
        q.stop()
    assert spark.read.parquet(str(out)).count() == 16
