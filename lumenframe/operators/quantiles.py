"""Exact quantiles and neighbours of groups of any size: no group is held or sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that values are counted in, for each doubling of their size.
RANGES = 1024
#: Places of a trace that one task holds.
BLOCK = 65536


def range_of(v: Column) -> Column:
    """Number of the range that a finite value is in; it grows with the value."""
    size = F.abs(v)
    return F.when(size > 0, F.signum(v) * (F.floor(F.log2(size) * RANGES) + 1200 * RANGES)).otherwise(0.0).cast("long")


def value_ranges(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct finite values (keys, v, n, range), and ranges of values (keys, range, m rows, before, size of the group)."""
    t = df.groupBy(*keys, "v").agg(F.count("*").alias("n")).withColumn("range", range_of(F.col("v")))
    s = t.groupBy(*keys, "range").agg(F.sum("n").alias("m"))
    all_ = W.partitionBy(*keys)
    return t, s.select(*keys, "range", "m", (F.sum("m").over(all_.orderBy("range")) - F.col("m")).alias("before"), F.sum("m").over(all_).alias("size"))


def cumulated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct finite values of each group with their number and that of all up to them: keys, v, n, upto, size."""
    t, s = value_ranges(df, keys)
    run = F.sum("n").over(W.partitionBy(*keys, "range").orderBy("v"))
    return t.withColumn("run", run).join(s, [*keys, "range"]).select(*keys, "v", "n", (F.col("before") + F.col("run")).alias("upto"), "size")


def quantiles(df: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """Quantiles of type 7 of v per group: the keys and q, an array in the order of ps.

    Distinct values are counted, then ranges of values; prefix sums of these tell the range of each rank, and only such
    ranges are sorted. v must be finite; rows with a null key are left out, and a group without rows has none.
    """
    t, s = value_ranges(df, keys)
    places = []
    for i, p in enumerate(ps):
        h = (F.col("size") - 1) * p
        for rank, share in ((F.floor(h), 1 - (h - F.floor(h))), (F.least(F.floor(h) + 1, F.col("size") - 1), h - F.floor(h))):
            places.append(F.struct(F.lit(i).alias("i"), (rank - F.col("before")).alias("rank"), share.alias("share")))
    within = F.filter(F.array(*places), lambda p: (p["rank"] >= 0) & (p["rank"] < F.col("m")))
    hit = s.select(*keys, "range", F.inline(within))
    run = F.sum("n").over(W.partitionBy(*keys, "range").orderBy("v"))
    near = t.join(hit.select(*keys, "range"), [*keys, "range"], "left_semi").withColumn("upto", run)
    got = near.join(hit, [*keys, "range"]).where("rank < upto AND rank >= upto - n")
    one = got.groupBy(*keys, "i").agg(F.sum(F.col("share") * F.col("v")).alias("v"))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("q")).select(*keys, F.transform("q", lambda x: x["v"]).alias("q"))


def blocks(df: DataFrame, place: str, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """Rows of long sequences dealt to blocks of `size` places, with copies of the neighbours that a block looks at: adds block, own.

    Windows partitioned by the sequence and its block then see `before` places back and `after` ahead of every own row.
    """
    at = F.floor(F.col(place) / size)
    homes = F.filter(F.array(F.when((F.col(place) % size) < after, at - 1), at, F.when((F.col(place) % size) >= size - before, at + 1)), lambda x: x.isNotNull())
    return df.withColumn("block", F.explode(homes)).withColumn("own", F.col("block") == at)
