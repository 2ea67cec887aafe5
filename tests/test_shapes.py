"""Connected regions, outlines, hulls, particles against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import graph, outlines, particles

RNG = np.random.default_rng(7)


def frame(spark, *images, column="v", kind="double"):
    rows = [(f"i{k}", y + 1, x + 1, v) for k, img in enumerate(images) for y, line in enumerate(img.tolist()) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, f"ds_id string, y int, x int, {column} {kind}")


def array(df, k, shape, column="label"):
    out = np.zeros(shape, int)
    for r in df.where(f"ds_id = 'i{k}'").collect():
        out[r["y"] - 1, r["x"] - 1] = r[column]
    return out


def flood(mask, connectivity, same=None):
    """Labels by flooding, in the order in which pixels are read."""
    out, n = np.zeros(mask.shape, int), 0
    near = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if connectivity == 8 else [])
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        n += 1
        out[y, x], todo = n, [(y, x)]
        while todo:
            a, b = todo.pop()
            for dy, dx in near:
                c, d = a + dy, b + dx
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not out[c, d] and (same is None or same[c, d] == same[a, b]):
                    out[c, d] = n
                    todo.append((c, d))
    return out


@pytest.mark.parametrize(("connectivity", "band"), [(4, 3), (8, 3), (8, 256)])
def test_labels(spark, connectivity, band):
    spiral = np.zeros((23, 23), int)
    for k in range(0, 12, 2):
        spiral[k : 23 - k, k : 23 - k] = 1
        spiral[k + 1 : 22 - k, k + 1 : 22 - k] = 0
    spiral[2:20:4, 1] = spiral[3:20:4, 21] = 1
    images = [RNG.random((30, 41)) < 0.5, RNG.random((17, 9)) < 0.6, spiral > 0, np.zeros((4, 4), bool)]
    got = graph.label_components(frame(spark, *[i.astype(float) for i in images]), connectivity, band=band).cache()
    for k, img in enumerate(images):
        assert (array(got, k, img.shape) == flood(img, connectivity)).all()
    assert graph.label_components(frame(spark, np.ones((1, 1))).where("false")).count() == 0


def test_small_regions_and_connected_labels(spark):
    mask = RNG.random((20, 20)) < 0.4
    whole = flood(mask, 4)
    size = np.bincount(whole.ravel())
    kept = [k for k in range(1, whole.max() + 1) if size[k] >= 3]
    want = np.vectorize(lambda v: kept.index(v) + 1 if v in kept else 0)(whole)
    assert (array(graph.label_components(frame(spark, mask.astype(float)), 4, 3, band=4), 0, mask.shape) == want).all()
    lab = RNG.integers(0, 4, (16, 18))
    n, want = 0, np.zeros(lab.shape, int)
    for v in range(1, 4):
        own = flood(lab == v, 8)
        want[own > 0] = own[own > 0] + n
        n += own.max()
    assert (array(graph.connected_labels(frame(spark, lab, column="label", kind="int"), connectivity=8, band=5), 0, lab.shape) == want).all()


def test_large_raster(spark):
    """A raster of 1,024 x 1,024: bands meet in stars, and the number of regions is that of a flood."""
    n = 1024
    img = spark.range(n * n).select(F.lit("a").alias("ds_id"), (F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"), (F.pmod(F.xxhash64("id"), F.lit(100)) < 38).cast("double").alias("v"))
    got = graph.label_components(img, 8, band=64).where("label > 0")
    mask = np.zeros((n, n), bool)
    for r in img.where("v > 0").select("y", "x").toPandas().to_numpy():
        mask[r[0], r[1]] = True
    want = flood(mask, 8)
    pd = got.toPandas()
    assert (want[pd["y"], pd["x"]] == pd["label"]).all() and len(pd) == mask.sum()


def test_particles(spark):
    img = RNG.random((30, 30))
    img[3:9, 4:10] += 5
    img[20:25, 15:28] += 4
    got = particles.particle_analysis(frame(spark, img), min_area=4).orderBy("id").collect()
    assert [r["area"] for r in got] == [36, 65]
    dark = particles.particle_analysis(frame(spark, -img), bright=False, min_area=4).count()
    assert dark == 2
    labels = np.zeros((6, 9), int)
    labels[:, :4], labels[:, 4:7], labels[2, 8] = 1, 2, 3
    assert particles.boundary_segments(frame(spark, labels, column="label", kind="int")).first()["segments"] == 1
    grains = np.where(np.arange(9)[None] < 4, 1, 2) * np.ones((6, 1), int)
    assert particles.grain_network(frame(spark, grains, column="label", kind="int")).first()["network"] == 6


def disk(n, r):
    y, x = np.indices((n, n)) - n // 2
    return (y * y + x * x <= r * r).astype(int)


def test_shapes(spark):
    blob = flood(RNG.random((24, 24)) < 0.55, 4)
    blob = (blob == np.bincount(blob.ravel())[1:].argmax() + 1).astype(int)
    images = [disk(41, 15), np.pad(np.ones((60, 60), int), 3), np.eye(7, dtype=int), blob, np.pad(np.ones((1, 1), int), 1)]
    got = {r["ds_id"]: r for r in outlines.shape_descriptors(frame(spark, *images, column="label", kind="int")).collect()}
    assert got["i0"]["circularity"] == pytest.approx(1, abs=0.05) and got["i0"]["solidity"] > 0.95
    assert got["i0"]["feret"] == pytest.approx(math.hypot(31, 1), abs=0.5)
    assert got["i1"]["solidity"] == 1 and got["i1"]["circularity"] == pytest.approx(0.874, abs=0.02)
    assert got["i4"]["perimeter"] == pytest.approx(math.pi / 4 * (2 + 2 / math.sqrt(2)))
    for k, img in enumerate(images):
        ys, xs = np.nonzero(img)
        pts = np.concatenate([np.stack([ys + a, xs + b], 1) for a, b in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))])
        h = outlines.hull(pts)

        def inside(y, x, h=h):
            return all((b[0] - a[0]) * (x - a[1]) - (b[1] - a[1]) * (y - a[0]) >= -1e-9 for a, b in zip(h, np.roll(h, -1, axis=0), strict=True))

        convex = sum(inside(y, x) for y in range(img.shape[0]) for x in range(img.shape[1]))
        assert got[f"i{k}"]["solidity"] == pytest.approx(img.sum() / convex)


def test_rings_and_holes(spark):
    ring = disk(21, 8) - disk(21, 3)
    touching = np.array([[1, 0], [0, 1]])
    lab = frame(spark, ring, touching, np.ones((3, 4), int), column="label", kind="int")
    got = {r["ds_id"]: r for r in outlines.outlines(lab).collect()}
    assert (got["i0"]["outer"], got["i0"]["holes"]) == (1, 1)
    assert got["i0"]["net"] == pytest.approx(ring.sum(), rel=0.05) and got["i0"]["cy"] == pytest.approx(11)
    assert got["i1"]["outer"] == 2 and got["i1"]["net"] == 1.0
    assert got["i2"]["net"] == 3 * 4 - 0.5
    points = outlines.ordered_rings(outlines.contour_rings(lab)).cache()
    for key in points.select("ds_id", "ring").distinct().collect():
        p = points.where((F.col("ds_id") == key["ds_id"]) & (F.col("ring") == key["ring"])).orderBy("i").collect()
        assert [r["i"] for r in p] == list(range(len(p)))
        steps = [math.hypot(a["y"] - b["y"], a["x"] - b["x"]) for a, b in zip(p, p[1:] + p[:1], strict=True)]
        assert max(steps) <= 1
    big = points.where("ds_id = 'i0'")
    few = outlines.simplified(big, 1.0)
    assert 3 <= few.groupBy("ring").count().agg(F.min("count")).first()[0] and few.count() < big.count() / 2


def corners(p, tolerance):
    """Douglas-Peucker of an open line, recursively."""
    if len(p) < 3:
        return p
    (y0, x0), (y1, x1) = p[0][1:], p[-1][1:]
    span = math.hypot(y1 - y0, x1 - x0)
    off = [abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / span if span else math.hypot(y - y0, x - x0) for _, y, x in p[1:-1]]
    k = max(range(len(off)), key=lambda i: (round(off[i], 9), -i)) + 1
    return corners(p[: k + 1], tolerance)[:-1] + corners(p[k:], tolerance) if round(off[k - 1], 9) > tolerance else [p[0], p[-1]]


def test_simplified_equals_recursion(spark):
    t = np.linspace(0, 2 * math.pi, 60, endpoint=False)
    y, x = 10 * np.sin(t) + RNG.random(60), 14 * np.cos(t) + RNG.random(60)
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))]
    df = spark.createDataFrame([("a", 1, 5, *q) for q in p], "ds_id string, label int, ring long, i long, y double, x double")
    far = max(range(60), key=lambda i: (round(math.hypot(y[i] - y[0], x[i] - x[0]), 9), -i))
    closed = [*p, (60, p[0][1], p[0][2])]
    want = {q[0] for q in corners(closed[: far + 1], 1.5) + corners(closed[far:], 1.5)} - {60}
    assert {r["i"] for r in outlines.simplified(df, 1.5).collect()} == want
