"""Queries of displays, frames, outlines' descriptors and errors, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import adapters as A
from lumenframe.operators import compare, measure, quantify, raster, regions, texture
from lumenframe.plans.analysis_queries import SUM, SUM_SQL, values
from lumenframe.plans.registry import query, r, rounded
from lumenframe.plans.structure_queries import STEPS
from lumenframe.plans.table_queries import FOUND, FOUND_SQL

ENDS = "e AS (SELECT min(v) AS lo, max(v) AS hi FROM field)"
query("display", lambda s, d: raster.to_display(A.field(s, d), 100000.0, 400000.0, 2.0), " SELECT y, x, floor(sqrt(greatest(0, least(1, (v - 100000) / 300000))) * 255 + 0.5)::INT AS v FROM field", "field")
query("uint16", lambda s, d: raster.to_uint16(A.field(s, d)), f", {ENDS} SELECT y, x, floor((v - lo) / (hi - lo) * 65535 + 0.5)::INT AS v, {r('lo')}, {r('hi')} FROM field, e", "field")
# Means of prices are dyadic, so a shift keeps them off the ties of five digits
query("thumbnail", lambda s, d: raster.thumbnail(A.field(s, d), 40).withColumn("v", F.col("v") + 1e-7), f", s AS (SELECT greatest(1, ceil(greatest(max(y), max(x)) / 40.0))::INT AS b FROM field) SELECT ((y - 1) // b + 1)::INT AS y, ((x - 1) // b + 1)::INT AS x, {r('avg(v) + 1e-7::DOUBLE', 'v')} FROM field, s GROUP BY 1, 2", "field")
query("embedded_roi", lambda s, d: raster.embed(raster.crop(A.field(s, d), 9, 70, 3, 21), A.field(s, d), 9, 70, 3, 21), f" SELECT y, x, CASE WHEN y BETWEEN 3 AND 9 AND x BETWEEN 21 AND 70 THEN round(v, 5) + 0.0 ELSE 0 END AS v FROM field", "field")
TEXTS = lambda: F.concat_ws(",", F.col("o_orderkey"), F.col("o_custkey"), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise((F.col("o_orderkey") % 90).cast("string")), F.col("o_custkey") % 50)
query("parsed_rois", lambda s, d: A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), raster.parse_roi(TEXTS()).alias("p")).select("id", "p.r1", "p.c1", "p.r2", "p.c2"), "SELECT o_orderkey AS id, CASE WHEN ok THEN o_orderkey::INT END AS r1, CASE WHEN ok THEN o_custkey::INT END AS c1, CASE WHEN ok THEN (o_orderkey % 90)::INT END AS r2, CASE WHEN ok THEN (o_custkey % 50)::INT END AS c2 FROM (SELECT *, o_orderkey % 7 <> 0 AS ok FROM orders)")
query("noise_local", lambda s, d: texture.noise(A.pix(s, d), "localvar").select("ds_id", "sigma", "snr"), f", bl AS (SELECT var_samp(v) AS s2 FROM pix GROUP BY (y - 1) // 16, (x - 1) // 16), e AS (SELECT min(s2) AS lo, max(s2) AS hi, least(50, count(*)) AS k FROM bl), b AS (SELECT floor((s2 - lo) / ((hi - lo) / k))::INT AS b FROM bl, e), m AS (SELECT b FROM b, e WHERE b < k GROUP BY b ORDER BY count(*) DESC, b LIMIT 1), g AS (SELECT sqrt(lo + (b + 0.5::DOUBLE) * (hi - lo) / k) AS sigma FROM m, e) SELECT {r('sigma')}, {r('(SELECT avg(v) FROM pix) / sigma', 'snr')} FROM g", "pix")
query("radial_profile_around", lambda s, d: measure.radial_profile(A.pix(s, d), 12, 20.0, 11.5, True), f", t AS (SELECT v, sqrt((x - 20) ** 2 + (y - 11.5::DOUBLE) ** 2) AS d FROM pix), b AS (SELECT least(11, floor(d / (sqrt(76.0::DOUBLE ** 2 + 52.5::DOUBLE ** 2) / 12)))::INT AS bin, v FROM t), g AS (SELECT bin, avg(v) AS m, max(v) AS x, stddev_pop(v) AS s, count(*) AS n FROM b GROUP BY bin) SELECT bin, {r('(m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ())', 'mean')}, {r('(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())', 'max')}, {r('s / (max(m) OVER () - min(m) OVER ())', 'std')}, n FROM g", "pix")
query("box_means", lambda s, d: measure.box_integrate(A.pix(s, d), 5, 7, 30, 50, "mean"), f"SELECT 'y' AS axis, y AS at, {r('avg(v)', 'v')} FROM pix WHERE y BETWEEN 5 AND 30 AND x BETWEEN 7 AND 50 GROUP BY y UNION ALL SELECT 'x', x, round(avg(v), 5) FROM pix WHERE y BETWEEN 5 AND 30 AND x BETWEEN 7 AND 50 GROUP BY x", "pix")
# Descriptors of outlines
HARM = f"{STEPS}, dd AS (SELECT *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS step FROM st), tt AS (SELECT *, sum(step) OVER (PARTITION BY ring ORDER BY i) AS t2, sum(step) OVER (PARTITION BY ring) AS al FROM dd WHERE step > 0), hh AS (SELECT ring, n, al / (2 * pi() ** 2 * n * n) / step AS k, x2 - x AS dx, y2 - y AS dy, cos(2 * pi() * n * t2 / al) - cos(2 * pi() * n * (t2 - step) / al) AS c, sin(2 * pi() * n * t2 / al) - sin(2 * pi() * n * (t2 - step) / al) AS s FROM tt, range(1, 4) r(n)), co AS (SELECT ring, n::INT AS n, sum(k * dx * c) AS a, sum(k * dx * s) AS b, sum(k * dy * c) AS c, sum(k * dy * s) AS d FROM hh GROUP BY ring, n), f1 AS (SELECT ring, a AS a1, b AS b1, c AS c1, d AS d1, atan2(2 * (a * b + c * d), a * a - b * b + c * c - d * d) / 2 AS t FROM co WHERE n = 1), f2 AS (SELECT ring, t, a1 * cos(t) + b1 * sin(t) AS p, c1 * cos(t) + d1 * sin(t) AS q FROM f1), f3 AS (SELECT ring, t, atan2(q, p) AS s, sqrt(p * p + q * q) AS z FROM f2), n1 AS (SELECT ring, n, s, z, a * cos(n * t) + b * sin(n * t) AS a, b * cos(n * t) - a * sin(n * t) AS b, c * cos(n * t) + d * sin(n * t) AS c, d * cos(n * t) - c * sin(n * t) AS d FROM co JOIN f3 USING (ring)), nh AS (SELECT ring, n, (cos(s) * a + sin(s) * c) / z AS a, (cos(s) * b + sin(s) * d) / z AS b, (cos(s) * c - sin(s) * a) / z AS c, (cos(s) * d - sin(s) * b) / z AS d FROM n1)"
#: Rings of six corners or more have a first ellipse that no rounding turns.
WIDE = "JOIN (SELECT ring FROM rings GROUP BY ring HAVING count(*) >= 6) w USING (ring)"
SHAPED = lambda s, d: regions.normalized_harmonics(regions.outline_harmonics(A.rings(s, d).join(A.rings(s, d).groupBy("ring").count().where("count >= 6").select("ring"), "ring"), 3))
SIZE = lambda df: df.groupBy("ring").agg(F.sqrt(F.sum(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c") + F.col("d") * F.col("d"))).alias("size"))
query("outline_descriptors", lambda s, d: rounded(SIZE(SHAPED(s, d)), 4), f", {HARM} SELECT ring, round(sqrt(sum(a * a + b * b + c * c + d * d)), 4) + 0.0 AS size FROM nh {WIDE} GROUP BY ring", "rings")
NEEDLE = [(1, 1.0, 0.0, 0.0, 0.5), (2, 0.0, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0, 0.0)]
query("outline_distances", lambda s, d: rounded(regions.harmonic_distance(SHAPED(s, d).withColumn("d", F.abs("d")), s.createDataFrame(NEEDLE, "n int, a double, b double, c double, d double")), 4), f", {HARM} SELECT ring, round(sqrt(sum((a - CASE n WHEN 1 THEN 1 ELSE 0 END) ** 2 + b * b + c * c + (abs(d) - CASE n WHEN 1 THEN 0.5 ELSE 0 END) ** 2)), 4) + 0.0 AS distance FROM nh {WIDE} GROUP BY ring", "rings")
# Errors, factors, units
EDGES = [("A", 2.0, 4.0, 3.0, 2.0), ("B", 5.0, 7.0, 5.0, 4.0)]
VAR = "t AS (SELECT element, e, v, (coalesce(lead(e) OVER w, e) - coalesce(lag(e) OVER w, e)) / 2 AS k FROM u JOIN ed ON e BETWEEN s0 AND s1 WINDOW w AS (PARTITION BY element ORDER BY e)), va AS (SELECT element, sum(k * k * v) / any_value(sigma) ** 2 AS v, any_value(ratio) AS q FROM t JOIN ed USING (element) GROUP BY element), su AS (SELECT *, sum(v) OVER () AS vs, sum(q) OVER () AS qs FROM va)"
query("edge_atomic_sigma", lambda s, d: quantify.edge_atomic_sigma(SUM(s, d), s.createDataFrame(EDGES, "element string, s0 double, s1 double, ratio double, sigma double")), f", {SUM_SQL}, {values('ed(element, s0, s1, ratio, sigma)', EDGES)}, {VAR} SELECT element, {r('100 * q / qs', 'atomic_pct')}, {r('100 * sqrt(((1 - q / qs) ** 2 * v + (q / qs) ** 2 * (vs - v)) / qs ** 2)', 'atomic_sigma')} FROM su", "cube")
KF = values("kf(symbol, k)", list(quantify.K_FACTORS.items()))
query("zeta_from_k", lambda s, d: quantify.zeta_from_k(FOUND(s, d), 520.0), f", {FOUND_SQL}, {KF} SELECT symbol, {r('coalesce(k, 1) * 520.0::DOUBLE', 'zeta')} FROM fs LEFT JOIN kf USING (symbol)", "cube")
UNITS = lambda: F.when(F.col("ch") % 3 == 0, " eV").when(F.col("ch") % 3 == 1, "keV").otherwise("px")
query("energies_in_kev", lambda s, d: SUM(s, d).select("ch", quantify.to_kev(F.col("e"), UNITS()).alias("kev")), f", {SUM_SQL} SELECT ch, {r('CASE WHEN ch % 3 = 0 THEN e / 1000 ELSE e END', 'kev')} FROM u", "cube")
query("pyramid", lambda s, d: raster.pyramid(A.field(s, d), 3, 32).withColumn("v", F.col("v") + 1e-7), f", z AS (SELECT z::INT AS z, (y - 1) // (1 << z) AS r, (x - 1) // (1 << z) AS c, avg(v) AS v FROM field, range(3) q(z) GROUP BY ALL) SELECT z, (r // 32)::INT AS ty, (c // 32)::INT AS tx, (r % 32 + 1)::INT AS y, (c % 32 + 1)::INT AS x, {r('v + 1e-7::DOUBLE', 'v')} FROM z", "field")
# A lattice of all suppliers: rows of ten, each shifted, with small errors
GRID = lambda s, d: A.table(s, d, "supplier").select(F.lit("g").alias("ds_id"), F.col("s_suppkey").alias("id"), (7.0 * (F.col("s_suppkey") % 10) + 1.5 * F.expr("s_suppkey div 10") + (F.col("s_suppkey") % 7) / 20.0).alias("x"), (6.0 * F.expr("s_suppkey div 10") + (F.col("s_suppkey") % 5) / 20.0).alias("y"))
GRID_SQL = "g AS (SELECT s_suppkey AS id, 7.0::DOUBLE * (s_suppkey % 10) + 1.5::DOUBLE * (s_suppkey // 10) + (s_suppkey % 7) / 20.0::DOUBLE AS x, 6.0::DOUBLE * (s_suppkey // 10) + (s_suppkey % 5) / 20.0::DOUBLE AS y FROM supplier)"
NEAREST = "fw AS (SELECT * FROM g ORDER BY id LIMIT 400), nn AS (SELECT fw.id, g.x - fw.x AS u, g.y - fw.y AS w, sqrt((g.x - fw.x) ** 2 + (g.y - fw.y) ** 2) AS far, row_number() OVER (PARTITION BY fw.id ORDER BY round((g.x - fw.x) ** 2 + (g.y - fw.y) ** 2, 9), g.id) AS k FROM fw JOIN g ON g.id <> fw.id), sp AS (SELECT quantile_cont(far, 0.5) AS spacing FROM nn WHERE k = 1), vv AS (SELECT CASE WHEN u < 0 OR abs(u) < 1e-9 AND w < 0 THEN -u ELSE u END AS u, CASE WHEN u < 0 OR abs(u) < 1e-9 AND w < 0 THEN -w ELSE w END AS w FROM nn, sp WHERE k <= 6 AND far > 0.3::DOUBLE * spacing AND far < 1.8::DOUBLE * spacing), va AS MATERIALIZED (SELECT u, w, atan2(w, u) AS a, least(35, floor((atan2(w, u) + pi() / 2) / (pi() / 36)))::INT AS b FROM vv)"
OFF = "abs((a - c + pi() / 2) - floor((a - c + pi() / 2) / pi()) * pi() - pi() / 2)"
MAIN = f"m1 AS (SELECT (b + 0.5::DOUBLE) * (pi() / 36) - pi() / 2 AS c FROM va GROUP BY b ORDER BY count(*) DESC, b LIMIT 1), re AS (SELECT va.* FROM va, m1 WHERE {OFF} > radians(15)), m2 AS (SELECT (b + 0.5::DOUBLE) * (pi() / 36) - pi() / 2 AS c FROM re GROUP BY b ORDER BY count(*) DESC, b LIMIT 1), a1 AS (SELECT avg(u) AS a1x, avg(w) AS a1y FROM va, m1 WHERE {OFF} <= radians(12)), a2 AS (SELECT avg(u) AS a2x, avg(w) AS a2y FROM re, m2 WHERE {OFF} <= radians(12)), og AS (SELECT x AS ox, y AS oy FROM g, (SELECT avg(x) AS mx, avg(y) AS my FROM g) ORDER BY round((x - mx) ** 2 + (y - my) ** 2, 9), id LIMIT 1)"
query("lattice_vectors", lambda s, d: compare.lattice_vectors(GRID(s, d)), f"WITH {GRID_SQL}, {NEAREST}, {MAIN} SELECT " + ", ".join(r(c) for c in ("a1x", "a1y", "a2x", "a2y", "ox", "oy", "spacing")) + " FROM a1, a2, og, sp")
