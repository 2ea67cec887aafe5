"""Calibrated views over relational tables: rasters, cubes, scans, populations and traces as long DataFrames.

Schemas: raster (ds_id, y, x, v), cube (ds_id, y, x, ch, e, v), scan (ds_id, sy, sx, ky, kx, v), population (grp, v),
trace (user_id, i, v). Pixel coordinates count from 1, channels and detector coordinates from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEIGHT, WIDTH = 64, 96
E0_KEV, STEP_KEV = 0.1, 0.15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, height: int, width: int, ds_id: str) -> DataFrame:
    return spark.range(height * width).select(F.lit(ds_id).alias("ds_id"), (F.expr(f"id div {width}") + 1).cast("int").alias("y"), (F.col("id") % width + 1).cast("int").alias("x"))


def _lineitem_raster(spark: SparkSession, sf_dir: str, ds_id: str, value) -> DataFrame:
    at = [(1 + F.col("l_orderkey") % HEIGHT).cast("int").alias("y"), (1 + F.col("l_partkey") % WIDTH).cast("int").alias("x")]
    sums = table(spark, sf_dir, "lineitem").groupBy(*at).agg(value.cast("double").alias("v"))
    return grid(spark, HEIGHT, WIDTH, ds_id).join(sums, ["y", "x"], "left").select("ds_id", "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


def pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64 x 96 raster of summed quantities."""
    return _lineitem_raster(spark, sf_dir, "pix", F.sum("l_quantity"))


def pix_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second raster of the same shape, of line counts."""
    return _lineitem_raster(spark, sf_dir, "pix_b", F.count("*"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster 128 wide of a pixel for each order, so its rows grow with the table."""
    at = [F.expr("1 + o_orderkey div 128").cast("int").alias("y"), (1 + F.col("o_orderkey") % 128).cast("int").alias("x")]
    return table(spark, sf_dir, "orders").select(F.lit("field").alias("ds_id"), *at, F.col("o_totalprice").cast("double").alias("v"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of 64 channels over a grid 25 wide; values are whole numbers, so sums are exact."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("ch", "c"))
    at = [F.expr("1 + vec_id div 25").cast("int").alias("y"), (1 + F.col("vec_id") % 25).cast("int").alias("x")]
    return e.select(F.lit("cube").alias("ds_id"), *at, "ch", (F.lit(E0_KEV) + F.lit(STEP_KEV) * F.col("ch")).alias("e"), F.floor((F.col("c").cast("double") + 1) * 1000).cast("double").alias("v"))


def scan4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube's rows as 8 x 8 detector patterns."""
    c = cube(spark, sf_dir)
    return c.select("ds_id", (F.col("y") - 1).alias("sy"), (F.col("x") - 1).alias("sx"), F.expr("ch div 8").cast("int").alias("ky"), (F.col("ch") % 8).alias("kx"), "v")


def populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("v"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each user numbered from 1 in order of time: within days, after the counts of the days before, so no user is one task."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("v"), F.to_date("ts").alias("day"))
    days = e.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    days = days.select("user_id", "day", (F.sum("n").over(W.partitionBy("user_id").orderBy("day")) - F.col("n")).alias("before"))
    at = F.row_number().over(W.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    return e.join(days, ["user_id", "day"]).select("user_id", (F.col("before") + at).cast("int").alias("i"), "v")


def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label map on the cube's grid; 0 is background."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("cube").alias("ds_id"), F.expr("1 + vec_id div 25").cast("int").alias("y"), (1 + F.col("vec_id") % 25).cast("int").alias("x"), F.coalesce("label", F.lit(0)).alias("label"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline for each order: a vertex per line, in the order of lines (of parts and quantities, where a number repeats)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ring"), F.expr("l_linenumber * 1000000000L + l_partkey * 100 + cast(l_quantity as long)").alias("i"), F.col("l_quantity").alias("x"), (F.col("l_partkey") % 47).cast("double").alias("y"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment for each order."""
    at = lambda c, m: (F.col(c) % m).cast("double")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), at("o_orderkey", 83).alias("x1"), at("o_custkey", 59).alias("y1"), at("o_custkey", 71).alias("x2"), at("o_orderkey", 61).alias("y2"))


#: The same views as SQL, for statements of expected results.
VIEWS_SQL = {
    "pix": "SELECT g.y, g.x, coalesce(s.v, 0.0::DOUBLE) AS v FROM (SELECT a.y, b.x FROM range(1, 65) a(y), range(1, 97) b(x)) g LEFT JOIN (SELECT 1 + l_orderkey % 64 AS y, 1 + l_partkey % 96 AS x, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL) s ON s.y = g.y AND s.x = g.x",
    "field": "SELECT 1 + o_orderkey // 128 AS y, 1 + o_orderkey % 128 AS x, o_totalprice::DOUBLE AS v FROM orders",
    "pix_b": "SELECT g.y, g.x, coalesce(s.v, 0.0::DOUBLE) AS v FROM (SELECT a.y, b.x FROM range(1, 65) a(y), range(1, 97) b(x)) g LEFT JOIN (SELECT 1 + l_orderkey % 64 AS y, 1 + l_partkey % 96 AS x, count(*)::DOUBLE AS v FROM lineitem GROUP BY ALL) s ON s.y = g.y AND s.x = g.x",
    "cube": "SELECT 1 + vec_id // 25 AS y, 1 + vec_id % 25 AS x, ch, 0.1::DOUBLE + 0.15::DOUBLE * ch AS e, floor((embedding[ch + 1]::DOUBLE + 1) * 1000)::DOUBLE AS v FROM embeddings, range(64) r(ch)",
    "scan4d": "SELECT vec_id // 25 AS sy, vec_id % 25 AS sx, ch // 8 AS ky, ch % 8 AS kx, floor((embedding[ch + 1]::DOUBLE + 1) * 1000)::DOUBLE AS v FROM embeddings, range(64) r(ch)",
    "region_labels": "SELECT 1 + vec_id // 25 AS y, 1 + vec_id % 25 AS x, coalesce(label, 0) AS label FROM embeddings",
    "rings": "SELECT l_orderkey AS ring, l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_quantity::BIGINT AS i, l_quantity AS x, (l_partkey % 47)::DOUBLE AS y FROM lineitem",
    "segments": "SELECT o_orderkey AS id, (o_orderkey % 83)::DOUBLE AS x1, (o_custkey % 59)::DOUBLE AS y1, (o_custkey % 71)::DOUBLE AS x2, (o_orderkey % 61)::DOUBLE AS y2 FROM orders",
    "populations": "SELECT o_orderpriority AS grp, o_totalprice AS v FROM orders",
    "traces": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value AS v FROM events",
}


def with_views(body: str, *views: str) -> str:
    """A statement with these views in front; body may go on with further common tables (', name AS (...) SELECT ...')."""
    return "WITH " + ", ".join(f"{v} AS ({VIEWS_SQL[v]})" for v in views) + " " + body
