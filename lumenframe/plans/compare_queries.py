"""Queries of results beside each other, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import adapters as A
from lumenframe.operators import compare, measure
from lumenframe.plans.catalogue import FITS
from lumenframe.plans.registry import query, r, rounded

KINDS = ["distance", "polyline", "angle", "note", "roi", "lasso"]
MEASURES = lambda s, d: A.table(s, d, "lineitem").select(F.col("l_returnflag").alias("ds_id"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_suppkey") % 6 + 1).cast("int")).alias("kind"), F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice").cast("double")).alias("v"))
MEASURES_SQL = f"me AS (SELECT l_returnflag AS flag, {KINDS!r}[l_suppkey % 6 + 1] AS kind, l_extendedprice::DOUBLE AS v FROM lineitem WHERE l_linenumber < 7), gr AS (SELECT flag, CASE kind WHEN 'angle' THEN 'Angle' WHEN 'roi' THEN 'ROI mean' WHEN 'lasso' THEN 'Area' WHEN 'note' THEN NULL ELSE 'Distance' END AS g, v FROM me)"
query("measure_groups", lambda s, d: rounded(compare.measure_groups(MEASURES(s, d)).withColumnRenamed("ds_id", "flag"), 4), f"WITH {MEASURES_SQL} SELECT flag, g AS \"group\", count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3 FROM gr WHERE g IS NOT NULL GROUP BY flag, g")
SAMPLES = lambda s, d: A.table(s, d, "supplier").select(F.lit("age").alias("parameter"), F.col("s_suppkey").alias("sample"), F.col("s_suppkey").alias("ord"), F.when(F.col("s_suppkey") % 5 > 1, F.col("s_nationkey").cast("double")).alias("value"), F.when(F.col("s_suppkey") % 5 == 1, "old").alias("text"))
UNIT = "CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 11 = 0 AND l_partkey % 2 = 0 THEN 'um' WHEN l_suppkey % 13 = 0 THEN 'um' WHEN l_partkey % 3 > 0 THEN 'nm' END"
VALUES = lambda s, d: A.table(s, d, "lineitem").where("l_suppkey % 9 > 0").select(F.col("l_suppkey").alias("sample"), F.col("l_quantity").cast("double").alias("v"), F.expr(UNIT).alias("unit"))
COMPARE = f"vs AS (SELECT l_suppkey AS sample, l_quantity::DOUBLE AS v, {UNIT} AS unit FROM lineitem WHERE l_suppkey % 9 > 0), ag AS (SELECT sample, count(unit) AS n, count(DISTINCT unit) AS units, any_value(unit) AS unit, avg(v) FILTER (unit IS NOT NULL) AS mean, stddev_pop(v) FILTER (unit IS NOT NULL) AS std FROM vs GROUP BY sample), wy AS (SELECT s_suppkey AS sample, CASE WHEN s_suppkey % 5 > 1 THEN s_nationkey::DOUBLE END AS value, unit, mean, std, n, CASE WHEN s_suppkey % 5 = 0 THEN 'no parameter' WHEN s_suppkey % 5 = 1 THEN 'categorical' WHEN n IS NULL THEN 'no regions' WHEN n = 0 THEN 'not calibrated' WHEN units > 1 THEN 'mixed units' END AS reason FROM supplier LEFT JOIN ag ON sample = s_suppkey), fi AS (SELECT arg_min(unit, sample) AS first FROM wy WHERE reason IS NULL), al AS (SELECT * REPLACE (coalesce(reason, CASE WHEN unit <> first THEN 'other unit' END) AS reason) FROM wy, fi)"
query("compare_samples", lambda s, d: compare.compare_samples(SAMPLES(s, d), VALUES(s, d)).drop("parameter"), f"WITH {COMPARE} SELECT sample, {r('value')}, CASE WHEN reason IS NULL THEN unit END AS unit, {r('CASE WHEN reason IS NULL THEN mean END', 'mean')}, {r('CASE WHEN reason IS NULL THEN std END', 'std')}, CASE WHEN reason IS NULL THEN n END AS n, reason FROM al")
OBJECTS = lambda s, d: A.table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).cast("string").alias("ds_id"), F.col("p_size").cast("double").alias("px"), F.when(F.expr("p_partkey % 40 > 9 OR p_size > 8"), F.col("p_size") * 0.25).alias("calibrated"), F.lit("nm").alias("unit"))
query("size_values", lambda s, d: compare.size_values(OBJECTS(s, d)).select("id", "v", "v_unit"), f"WITH o AS (SELECT p_partkey AS id, p_partkey % 40 AS d, p_size::DOUBLE AS px, CASE WHEN p_partkey % 40 > 9 OR p_size > 8 THEN p_size * 0.25::DOUBLE END AS c FROM part), k AS (SELECT d, count(*) = count(c) AS whole FROM o GROUP BY d) SELECT id, {r('CASE WHEN whole THEN c ELSE px END', 'v')}, CASE WHEN whole THEN 'nm' ELSE 'px' END AS v_unit FROM o JOIN k USING (d)")


def _curve(s, d):
    pop = A.populations(s, d)
    fits = measure.fit_normal_lognormal(pop).withColumn("shape", F.lit(None).cast("double"))
    ends = pop.groupBy("grp").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("width", (F.col("hi") - F.col("lo")) / 25)
    return compare.fitted_curve(fits.join(ends, "grp"), 40)


query("fitted_curves", lambda s, d: rounded(_curve(s, d), 3), f", {FITS}, en AS (SELECT grp, min(v) AS lo, max(v) AS hi FROM populations GROUP BY grp), xs AS (SELECT g.*, i, lo + i * (hi - lo) / 39 AS x, n * (hi - lo) / 25 AS k FROM g JOIN en USING (grp), range(40) q(i)) SELECT grp, kind, i::INT AS i, round(x, 3) AS x, round(k * CASE kind WHEN 'normal' THEN exp(-((x - loc) ** 2) / (2 * scale ** 2)) / (scale * sqrt(2 * pi())) ELSE exp(-((ln(x) - loc) ** 2) / (2 * scale ** 2)) / (x * scale * sqrt(2 * pi())) END, 3) + 0.0 AS y FROM xs", "populations")
MARKS = lambda s, d: A.table(s, d, "part").select(F.col("p_brand").alias("symbol"), (F.col("p_size") % 3).alias("line"), F.col("p_retailprice").cast("double").alias("energy"), (F.col("p_partkey") % 4 == 0).alias("chosen"), F.col("p_partkey").alias("i"))
query("peak_markers", lambda s, d: compare.peak_markers(MARKS(s, d)), f"SELECT p_brand AS symbol, p_size % 3 AS line, {r('p_retailprice::DOUBLE', 'energy')}, p_partkey % 4 = 0 AS chosen FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size % 3 ORDER BY p_partkey % 4 = 0 DESC, CASE WHEN p_partkey % 4 = 0 THEN -p_partkey ELSE p_partkey END) = 1")
SPOTS = lambda s, d: A.table(s, d, "part").select(F.col("p_partkey").alias("id"), (30 + F.col("p_partkey") % 11).cast("double").alias("y1"), (60 + F.col("p_size") % 13).cast("double").alias("x1"), (20 + F.col("p_partkey") % 7).cast("double").alias("y2"), (35 + F.col("p_size") % 17).cast("double").alias("x2"), F.lit(64).alias("h"), F.lit(96).alias("w"), F.lit(0.25).alias("pixel_size"))
LATTICE = "g AS (SELECT p_partkey AS id, (60 + p_size % 13 - 49) / 24.0::DOUBLE AS p, (30 + p_partkey % 11 - 33) / 16.0::DOUBLE AS q, (35 + p_size % 17 - 49) / 24.0::DOUBLE AS r, (20 + p_partkey % 7 - 33) / 16.0::DOUBLE AS s FROM part), n AS (SELECT *, CASE WHEN abs(p * s - q * r) > 1e-14 THEN abs(p * s - q * r) END AS d FROM g)"
query("lattice", lambda s, d: compare.lattice(SPOTS(s, d)).select("id", "a", "b", "gamma", "d1", "d2", "area"), f"WITH {LATTICE} SELECT id, {r('sqrt(r * r + s * s) / d', 'a')}, {r('sqrt(p * p + q * q) / d', 'b')}, {r('CASE WHEN d IS NOT NULL THEN degrees(acos(greatest(-1, least(1, (-(p * r + q * s)) / sqrt((r * r + s * s) * (p * p + q * q)))))) END', 'gamma')}, {r('1 / sqrt(p * p + q * q)', 'd1')}, {r('1 / sqrt(r * r + s * s)', 'd2')}, {r('1 / d', 'area')} FROM n")
COLUMNS = lambda s, d: A.table(s, d, "part").select(F.lit("a").alias("ds_id"), F.col("p_partkey").alias("id"), (5.0 * (F.col("p_partkey") % 25) + 1.5 * F.expr("p_partkey div 25") + F.col("p_size") % 7 * 0.1).alias("x"), (6.0 * F.expr("p_partkey div 25") + F.col("p_partkey") % 5 * 0.1).alias("y"))
STRAIN = "c AS (SELECT p_partkey AS id, p_partkey % 25 AS i, p_partkey // 25 AS j, p_size % 7 * 0.1::DOUBLE AS u, p_partkey % 5 * 0.1::DOUBLE AS w FROM part), e AS (SELECT id, 5.0::DOUBLE * i + 1.5::DOUBLE * j AS x, 6.0::DOUBLE * j AS y, i, j, u, w FROM c), n AS (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy, b.u, b.w FROM e a JOIN e b ON b.i BETWEEN a.i - 5 AND a.i + 5 AND b.j BETWEEN a.j - 5 AND a.j + 5 WHERE round(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 9) <= 3 * sqrt(38.25::DOUBLE) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 9), b.id) <= 9), m AS (SELECT id, var_pop(dx) AS xx, var_pop(dy) AS yy, covar_pop(dx, dy) AS xy, covar_pop(dx, u) AS xu, covar_pop(dy, u) AS yu, covar_pop(dx, w) AS xw, covar_pop(dy, w) AS yw FROM n GROUP BY id), s AS (SELECT id, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b, (xw * yy - yw * xy) / (xx * yy - xy * xy) AS c, (yw * xx - xw * xy) / (xx * yy - xy * xy) AS d FROM m)"
query("pair_strain", lambda s, d: compare.pair_strain(COLUMNS(s, d), (5.0, 0.0), (1.5, 6.0), (0.0, 0.0)).drop("ux", "uy"), f"WITH {STRAIN} SELECT id, {r('a', 'exx')}, {r('d', 'eyy')}, {r('(b + c) / 2', 'exy')}, {r('(c - b) / 2', 'rotation')} FROM s")
LOG = lambda s, d: A.table(s, d, "part").select(F.col("p_partkey").alias("n"), F.col("p_partkey").cast("string").alias("output"), F.expr("p_partkey div 3").cast("string").alias("input"), F.col("p_brand").alias("op"))
BACK = "WITH RECURSIVE b AS (SELECT p_partkey AS leaf, 0 AS depth, p_partkey AS n, p_brand AS op FROM part UNION ALL SELECT leaf, depth + 1, p_partkey, p_brand FROM b JOIN part ON p_partkey = n // 3 AND p_partkey <> n)"
query("ancestry", lambda s, d: compare.ancestry(LOG(s, d)), f"{BACK} SELECT leaf::VARCHAR AS output, depth, n, op FROM b")
query("methods", lambda s, d: compare.methods(compare.ancestry(LOG(s, d))), f"{BACK} SELECT leaf::VARCHAR AS output, string_agg(op, '; ' ORDER BY depth DESC) AS text FROM b GROUP BY leaf")
