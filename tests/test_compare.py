"""Results beside each other on small tables."""

import math

import numpy as np
import pytest

from lumenframe.operators import compare


def test_measure_groups(spark):
    rows = [("a", "distance", 1.0), ("a", "polyline", 3.0), ("a", "profile", float("nan")), ("a", "text", 5.0), ("a", "angle", None), ("b", "lasso", 2.0)]
    got = {(r["ds_id"], r["group"]): r for r in compare.measure_groups(spark.createDataFrame(rows, "ds_id string, kind string, v double")).collect()}
    assert set(got) == {("a", "Distance"), ("b", "Area")}
    d = got["a", "Distance"]
    assert (d["n"], d["mean"], d["std"], d["q1"], d["median"], d["q3"]) == (2, 2.0, 1.0, 1.5, 2.0, 2.5)


def test_samples(spark):
    samples = [("t", s, i, v, x) for i, (s, v, x) in enumerate([("none", None, None), ("word", None, "hot"), ("empty", 1.0, None), ("raw", 2.0, None), ("mixed", 3.0, None), ("first", 9.0, None), ("other", 5.0, None), ("good", 4.0, None)])]
    values = [("raw", 1.0, None), ("mixed", 1.0, "um"), ("mixed", 2.0, "nm"), ("first", 1.0, "nm"), ("first", 3.0, "nm"), ("first", 99.0, None), ("other", 1.0, "um"), ("good", 7.0, "nm"), ("none", 7.0, "nm")]
    got = {r["sample"]: r for r in compare.compare_samples(spark.createDataFrame(samples, "parameter string, sample string, ord int, value double, text string"), spark.createDataFrame(values, "sample string, v double, unit string")).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"none": "no parameter", "word": "categorical", "empty": "no regions", "raw": "not calibrated", "mixed": "mixed units", "first": None, "other": "other unit", "good": None}
    assert (got["first"]["mean"], got["first"]["std"], got["first"]["n"], got["first"]["unit"]) == (2.0, 1.0, 2, "nm") and got["other"]["mean"] is None


def test_sizes(spark):
    t = spark.createDataFrame([("a", 4.0, 2.0, "nm"), ("a", 6.0, 3.0, "nm"), ("b", 4.0, 2.0, "nm"), ("b", 6.0, None, "nm")], "ds_id string, px double, calibrated double, unit string")
    assert sorted((r["ds_id"], r["v"], r["v_unit"]) for r in compare.size_values(t).collect()) == [("a", 2.0, "nm"), ("a", 3.0, "nm"), ("b", 4.0, "px"), ("b", 6.0, "px")]


def test_curves_hold_all_counts(spark):
    fits = [("g", "normal", 5.0, 1.0, None, -5.0, 15.0), ("g", "lognormal", 1.0, 0.3, None, 0.0, 30.0), ("g", "weibull", 0.0, 4.0, 2.0, 0.0, 30.0), ("g", "broken", 0.0, 0.0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame([(*f, 100, 2.0) for f in fits], "grp string, kind string, loc double, scale double, shape double, lo double, hi double, n int, width double")
    got = {}
    for r in compare.fitted_curve(df, 401).orderBy("i").collect():
        got.setdefault(r["kind"], []).append((r["x"], r["y"]))
    for k, xy in got.items():
        x, y = np.array(xy).T
        assert len(x) == 401 and np.trapezoid(y, x) == pytest.approx(0 if k == "broken" else 200, rel=1e-3, abs=1e-9)


def test_markers(spark):
    t = spark.createDataFrame([("Fe", "K", 6.4, False, 1), ("Fe", "K", 6.41, True, 2), ("Fe", "K", 6.42, True, 3), ("Cu", "K", 8.0, False, 4), ("Cu", "K", 8.1, False, 5)], "symbol string, line string, energy double, chosen boolean, i int")
    assert sorted(tuple(r) for r in compare.peak_markers(t).collect()) == [("Cu", "K", 8.0, False), ("Fe", "K", 6.42, True)]


def test_lattice(spark):
    t = spark.createDataFrame([(33.0, 43.0, 41.0, 33.0, 64, 64, 0.5), (33.0, 33.0, 41.0, 33.0, 64, 64, 0.5), (33.0, 43.0, 33.0, 53.0, 64, 64, 0.5)], "y1 double, x1 double, y2 double, x2 double, h int, w int, pixel_size double")
    a, b, c = compare.lattice(t).collect()
    assert (a["a"], a["b"], a["gamma"], a["d1"], a["area"]) == (pytest.approx(3.2), pytest.approx(4.0), pytest.approx(90.0), pytest.approx(3.2), pytest.approx(12.8))
    assert b["a"] is None and b["d1"] is None and c["area"] is None


def test_strain_of_a_sheared_lattice(spark):
    e = np.array([[0.01, 0.004], [-0.002, 0.02]])
    rows = []
    for n in range(49):
        p = np.array([10.0 * (n % 7), 8.0 * (n // 7)])
        rows.append(("a", n, *(p + e @ p + 100).tolist()))
    df = spark.createDataFrame(rows, "ds_id string, id int, x double, y double")
    got = compare.pair_strain(df, (10.0, 0.0), (0.0, 8.0), (100.0, 100.0)).collect()
    assert len(got) == 49
    for r in got:
        assert (r["exx"], r["eyy"], r["exy"], r["rotation"]) == (pytest.approx(0.01), pytest.approx(0.02), pytest.approx(0.001), pytest.approx(-0.003))
    few = compare.pair_strain(df.where("id < 3"), (10.0, 0.0), (0.0, 8.0), (100.0, 100.0)).collect()
    assert len(few) == 3 and all(r["exx"] is None and not math.isnan(r["ux"]) for r in few)
    with pytest.raises(ValueError):
        compare.pair_strain(df, (1.0, 1.0), (2.0, 2.0), (0.0, 0.0))


def test_ancestry(spark):
    log = [(1, "b", "a", "gaussian"), (2, "c", "b", "old"), (3, "c", "b", "median"), (4, None, "c", "stats"), (5, "x", "y", "flip"), (6, "y", "x", "turn")]
    chain = compare.ancestry(spark.createDataFrame(log, "n int, output string, input string, op string"))
    assert sorted((r["output"], r["depth"], r["op"]) for r in chain.collect()) == [("b", 0, "gaussian"), ("c", 0, "median"), ("c", 1, "gaussian"), ("x", 0, "flip"), ("x", 1, "turn"), ("y", 0, "turn"), ("y", 1, "flip")]
    assert {r["output"]: r["text"] for r in compare.methods(chain).collect()}["c"] == "gaussian; median"
