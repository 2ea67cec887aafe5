"""Line defects by oriented filters and test lines, and scale bars in the bottom strip of a raster."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.raster import DS, shape

#: Rows of a raster that a task filters at once.
BAND = 64


def oriented_kernel(length: int, degrees: float) -> list[list[float]]:
    """A Gaussian along a direction times the slope of one across it; what is above and below 0 adds up to 1 each."""
    half, across = length // 2, length / 6
    along, turn = 2 * across, math.radians(degrees)
    k = np.zeros((length, length))
    for y in range(-half, half + 1):
        for x in range(-half, half + 1):
            u, v = x * math.cos(turn) + y * math.sin(turn), -x * math.sin(turn) + y * math.cos(turn)
            k[y + half, x + half] = math.exp(-0.5 * (u / along) ** 2) * -(v / across**2) * math.exp(-0.5 * (v / across) ** 2)
    up, down = k[k > 0].sum(), -k[k < 0].sum()
    if up > 0 and down > 0:
        k = np.where(k > 0, k / up, k / down)
    return k.tolist()


def line_response(img: DataFrame, kernel_length: int = 15, angles: tuple[float, ...] = (0.0, 45.0, 90.0, 135.0)) -> DataFrame:
    """The largest absolute answer of each pixel to the oriented kernels: ds_id, y, x, v. Pixels outside a raster count as 0.

    Rows are filtered in bands with the rows that kernels reach beyond them, so a task holds a band of one raster.
    """
    size = kernel_length + (kernel_length % 2 == 0)
    kernels, half = [np.array(oriented_kernel(size, a)) for a in angles], size // 2

    def filtered(t: pa.Table) -> pa.Table:
        band = t.column("band")[0].as_py()
        y, x, v = (t.column(c).to_numpy() for c in ("y", "x", "v"))
        top, left = band * BAND + 1 - half, int(x.min()) - half
        block = np.zeros((BAND + 2 * half, int(x.max()) - left + 1 + half))
        block[y - top, x - left] = v
        out = np.zeros((BAND, block.shape[1] - 2 * half))
        for k in kernels:
            got = np.zeros_like(out)
            for dy in range(size):
                for dx in range(size):
                    if k[dy, dx]:
                        got += k[dy, dx] * block[2 * half - dy : 2 * half - dy + BAND, 2 * half - dx : 2 * half - dx + out.shape[1]]
            out = np.maximum(out, np.abs(got))
        own = (y > band * BAND) & (y <= (band + 1) * BAND)
        y, x = y[own], x[own]
        return pa.table({DS: t.column(DS).filter(pa.array(own)), "y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "v": out[y - band * BAND - 1, x - left - half]})

    first, last = F.expr(f"greatest(0, (y - 1 - {half}) div {BAND})").cast("int"), F.expr(f"(y - 1 + {half}) div {BAND}").cast("int")
    banded = img.select(DS, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"), F.explode(F.sequence(first, last)).alias("band"))
    return banded.groupBy(DS, "band").applyInArrow(filtered, f"{DS} {img.schema[DS].dataType.simpleString()}, y int, x int, v double")


def otsu_middle(img: DataFrame, bins: int = 256) -> DataFrame:
    """ds_id, t: the middle of the bin at which two classes are parted best (the first of equal ones, at six digits)."""
    e = img.groupBy(DS).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("all")).where("hi > lo")
    at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    n = img.join(e, DS).groupBy(DS, at.alias("b")).agg(F.count("*").alias("n"))
    h = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("b")).join(n, [DS, "b"], "left")
    up = W.partitionBy(DS).orderBy("b")
    p, c = F.coalesce("n", F.lit(0)) / F.col("all"), F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    h = h.select(DS, "b", c.alias("c"), F.sum(p).over(up).alias("w"), F.sum(p * c).over(up).alias("m"), F.sum(p * c).over(W.partitionBy(DS)).alias("mt"))
    between = F.when((F.col("w") > 1e-10) & (1 - F.col("w") > 1e-10), F.pow(F.col("mt") * F.col("w") - F.col("m"), F.lit(2)) / (F.col("w") * (1 - F.col("w")))).otherwise(0.0)
    return h.groupBy(DS).agg(F.max_by("c", F.struct(F.round(between, 6), -F.col("b"))).alias("t"))


def count_defect_lines(img: DataFrame, direction: float | None = None, kernel_length: int = 15, grid: int = 50, thickness: float | None = None, pixel_size: float = 1.0) -> DataFrame:
    """Crossings of line defects with test lines: ds_id, crossings, lines, length, density.

    A defect is where the line_response() is at Otsu's threshold or above. Test lines are every grid-th row and column before
    the last one (the middle ones where there are none); a crossing is a step onto a defect along one. The density is twice
    the crossings over the length of the lines, and over the foil's thickness where it is known.
    """
    answer = line_response(img, kernel_length, (0.0, 45.0, 90.0, 135.0) if direction is None else (direction,))
    s = shape(img)
    t = answer.join(otsu_middle(answer), DS, "left").join(s, DS).select(DS, "y", "x", "h", "w", F.coalesce((F.col("v") >= F.col("t")).cast("int"), F.lit(0)).alias("on"))

    def steps(along: str, across: str, size: str) -> DataFrame:
        chosen = F.when(F.col(size) > grid, (F.col(across) % grid == 0) & (F.col(across) < F.col(size))).otherwise(F.col(across) == F.rint(F.col(size) / 2))
        w = W.partitionBy(DS, across).orderBy(along)
        return t.where(chosen).select(DS, ((F.col("on") == 1) & (F.lag("on").over(w) == 0)).cast("int").alias("n"))

    hits = steps("x", "y", "h").unionByName(steps("y", "x", "w")).groupBy(DS).agg(F.sum("n").alias("crossings"))
    many = lambda c: F.when(F.col(c) > grid, F.ceil(F.col(c) / grid) - 1).otherwise(F.lit(1))
    out = s.join(hits, DS, "left").select(DS, F.coalesce("crossings", F.lit(0)).alias("crossings"), (many("h") + many("w")).cast("long").alias("lines"), ((many("h") * F.col("w") + many("w") * F.col("h")) * pixel_size).alias("length"))
    return out.withColumn("density", F.coalesce(F.try_divide(2 * F.col("crossings"), F.col("length") * (thickness or 1.0)), F.lit(0.0)))


def scale_bar(img: DataFrame) -> DataFrame:
    """The scale bar of each raster: ds_id, found, length, x1, x2, y (0 where none is found).

    Sought in the bottom 15 % (10 rows at least) of rasters of 10 by 20 pixels or more whose strip spans 1 or more: the longest
    run of white (above 0.85 of the span), then of black (below 0.15), of 20 pixels and 3 % of the width or more, 60 % at
    most. Rows below belong to the bar while more than 70 % of its inner columns are set; it is 15 rows high at most. Of
    equally long ones white goes first, then the upper, then the left one.
    """
    s = shape(img).withColumn("strip", F.least(F.col("h"), F.greatest(F.lit(10), F.rint(F.col("h") * 0.15).cast("int"))))
    t = img.join(s.where("h >= 10 AND w >= 20"), DS).where(F.col("y") > F.col("h") - F.col("strip"))
    ends = t.groupBy(DS).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("hi - lo >= 1")
    norm = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    set_ = F.explode(F.array(F.struct(F.lit(1).alias("white"), (norm > 0.85).cast("int").alias("on")), F.struct(F.lit(0).alias("white"), (norm < 0.15).cast("int").alias("on"))))
    row = W.partitionBy(DS, "white", "y").orderBy("x")
    bw = t.join(ends, DS).select(DS, "y", "x", "h", "w", set_.alias("b")).select(DS, "y", "x", "h", "w", "b.*")
    bw = bw.withColumn("upto", F.sum("on").over(row))
    island = bw.where("on = 1").withColumn("k", F.col("x") - F.row_number().over(row))
    runs = island.groupBy(DS, "white", "y", "k").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.count("*").alias("length"), F.first("w").alias("w"), F.first("h").alias("h"))
    runs = runs.where((F.col("length") >= 20) & (F.col("length") >= 0.03 * F.col("w")) & (F.col("length") <= 0.6 * F.col("w"))).drop("k")
    below = runs.select("*", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("down"))
    at = lambda x, name: bw.select(DS, "white", (F.col("y")).alias("yy"), F.col("x").alias(x), F.col("upto").alias(name))
    below = below.withColumn("yy", F.col("y") + F.col("down")).withColumn("a", F.col("x1") + 1).withColumn("z", F.col("x2") - 2)
    set_in = below.join(at("a", "before"), [DS, "white", "yy", "a"], "left").join(at("z", "through"), [DS, "white", "yy", "z"], "left")
    ok = F.coalesce((F.col("through") - F.col("before")) / (F.col("z") - F.col("a")) > 0.7, F.lit(False))
    height = set_in.groupBy(DS, "white", "y", "x1", "x2", "length").agg(F.min(F.when(~ok, F.col("down"))).alias("height")).where("height is not null")
    best = height.groupBy(DS).agg(F.max_by(F.struct("length", "x1", "x2", "y"), F.struct("length", "white", -F.col("y"), -F.col("x1"))).alias("b"))
    zero = F.lit(0)
    return s.join(best, DS, "left").select(DS, F.col("b").isNotNull().alias("found"), F.coalesce("b.length", zero.cast("long")).alias("length"), *[F.coalesce(f"b.{c}", zero).alias(c) for c in ("x1", "x2", "y")])
