"""Queries of regions, layers, outlines, profiles and texture, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import adapters as A
from lumenframe.operators import raster, regions, spectral
from lumenframe.plans.registry import query, r, rounded

MAP = lambda s, d: spectral.raster_of(A.cube(s, d))
MAP_SQL = "img AS (SELECT y, x, sum(v) AS v FROM cube GROUP BY y, x)"
# Regions
REGION = "g AS (SELECT label, count(*) AS area, avg(l.y) AS cy, avg(l.x) AS cx, min(l.y) AS y0, min(l.x) AS x0, max(l.y) AS y1, max(l.x) AS x1, avg(v) AS mean FROM region_labels l JOIN img USING (y, x) WHERE label > 0 GROUP BY label HAVING count(*) >= 46), s AS (SELECT *, (row_number() OVER (ORDER BY label))::INT AS id, sqrt(4 * area / pi()) AS diameter FROM g)"
STATS = lambda s, d: regions.region_stats(A.region_labels(s, d), MAP(s, d), 46, 0.5)
query("region_stats", STATS, f", {MAP_SQL}, {REGION} SELECT id, label, area, {r('cy')}, {r('cx')}, y0, x0, y1, x1, {r('mean')}, {r('diameter')}, {r('area * 0.25::DOUBLE', 'area_cal')}, {r('diameter * 0.5::DOUBLE', 'diameter_cal')} FROM s", "cube", "region_labels")
query("region_renumber", lambda s, d: regions.renumber(A.region_labels(s, d), STATS(s, d)), f", {MAP_SQL}, {REGION} SELECT l.y, l.x, coalesce(id, 0) AS label FROM region_labels l LEFT JOIN s USING (label)", "cube", "region_labels")
query("particles_dark", lambda s, d: regions.particles(MAP(s, d), A.region_labels(s, d), 64000.0, bright=False).select("ds_id", "id", "label", "area", "mean", "diameter"), f", {MAP_SQL} SELECT (row_number() OVER (ORDER BY label))::INT AS id, label, count(*) AS area, {r('avg(v)', 'mean')}, {r('sqrt(4 * count(*) / pi())', 'diameter')} FROM region_labels JOIN img USING (y, x) WHERE label > 0 AND v < 64000 GROUP BY label", "cube", "region_labels")
NETWORK = "p AS (SELECT a.y, a.x, a.label AS a, b.label AS b FROM region_labels a JOIN region_labels b ON (b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1) WHERE a.label > 0 AND b.label > 0 AND a.label <> b.label), q AS (SELECT DISTINCT a.y, a.x FROM region_labels a JOIN region_labels b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 WHERE a.label > 0 AND b.label > 0 AND a.label <> b.label), j AS (SELECT a.y, a.x FROM region_labels a JOIN region_labels b ON b.y - a.y IN (0, 1) AND b.x - a.x IN (0, 1) GROUP BY a.y, a.x HAVING count(*) = 4 AND count(DISTINCT nullif(b.label, 0)) >= 3)"
query("boundary_network", lambda s, d: regions.boundary_network(A.region_labels(s, d), 0.5), f", {NETWORK} SELECT (SELECT count(*) FROM p) AS network, (SELECT count(*) FROM q) AS boundary, (SELECT count(*) FROM j) AS junctions, {r('(SELECT count(*) FROM p) * 0.5::DOUBLE', 'network_cal')}", "region_labels")
UNITS = "u(unit, mm) AS (VALUES ('nm', 1e-6::DOUBLE), ('um', 1e-3::DOUBLE), ('parsec', NULL))"
query("grain_size_number", lambda s, d: STATS(s, d).select("label", F.explode(F.array(F.lit("nm"), F.lit("um"), F.lit("parsec"))).alias("unit"), "diameter").select("label", "unit", regions.astm_number(F.col("diameter"), F.col("unit")).alias("g")), f", {MAP_SQL}, {REGION}, {UNITS} SELECT label, unit, {r('-6.6439::DOUBLE * log2(diameter * mm) - 3.298::DOUBLE', 'g')} FROM s, u", "cube", "region_labels")
SHAPE = "m AS (SELECT label, count(*) AS area, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c FROM region_labels WHERE label > 0 GROUP BY label), e AS (SELECT *, (vy + vx) / 2 + sqrt(((vy - vx) / 2) ** 2 + c * c) AS l1, (vy + vx) / 2 - sqrt(((vy - vx) / 2) ** 2 + c * c) AS l2 FROM m)"
query("shape_moments", lambda s, d: regions.shape_moments(A.region_labels(s, d)), f", {SHAPE} SELECT label, area, {r('4 * sqrt(l1)', 'major')}, {r('4 * sqrt(l2)', 'minor')}, {r('sqrt(1 - l2 / l1)', 'eccentricity')}, {r('atan2(2 * c, vy - vx) / 2', 'orientation')}, {r('sqrt(l1 / l2)', 'aspect')} FROM e", "region_labels")
SIZES = lambda s, d: A.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 > 0, F.col("p_size") / 10).alias("aspect"), (F.col("p_partkey") % 100 / 100).alias("circularity"), ((F.col("p_partkey") * 7) % 100 / 100).alias("solidity"))
query("shape_class", lambda s, d: SIZES(s, d).select("p_partkey", regions.shape_class(F.col("aspect"), F.col("circularity"), F.col("solidity")).alias("kind")), "SELECT p_partkey, CASE WHEN (p_partkey * 7) % 100 < 85 THEN 'aggregate' WHEN p_size % 7 > 0 AND p_size >= 25 THEN 'rod-like' WHEN p_size % 7 > 0 AND p_size < 13 AND p_partkey % 100 > 92 THEN 'sphere-like' ELSE 'intermediate' END AS kind FROM part")
# Layers
BANDS = lambda s: s.createDataFrame([("cube", 0, 0.0, 4.5), ("cube", 1, 4.5, 12.0), ("cube", 2, 12.0, 19.0), ("cube", 3, 90.0, 99.0)], "ds_id string, layer int, top double, bottom double")
BANDS_SQL = "b(layer, top, bottom) AS (VALUES (0, 0.0::DOUBLE, 4.5::DOUBLE), (1, 4.5::DOUBLE, 12.0::DOUBLE), (2, 12.0::DOUBLE, 19.0::DOUBLE), (3, 90.0::DOUBLE, 99.0::DOUBLE)), px AS (SELECT layer, label, (y - 1) AS d, (x - 1) AS l FROM region_labels JOIN b ON y - 1 >= top AND y - 1 < bottom), w AS (SELECT label, count(*) AS whole FROM region_labels GROUP BY label), g AS (SELECT layer, px.label, count(*) AS area, (max(l) - min(l) + 1) * 0.5::DOUBLE AS width, (max(d) - min(d) + 1) * 0.5::DOUBLE AS height, (max(l) - min(l) + 1)::DOUBLE / (max(d) - min(d) + 1) AS aspect, abs(degrees(atan2(2 * covar_pop(l, d), var_pop(l) - var_pop(d)) / 2)) AS angle, avg(l) AS centre_l, avg(d) AS centre_d, count(*)::DOUBLE / any_value(whole) AS share FROM px JOIN w USING (label) WHERE px.label > 0 GROUP BY layer, px.label)"
query("layer_slices", lambda s, d: regions.layer_slices(A.region_labels(s, d), BANDS(s), "y", 0.5), f", {BANDS_SQL} SELECT layer, label, area, " + ", ".join(r(c) for c in ("width", "height", "aspect", "angle", "centre_l", "centre_d", "share")) + " FROM g", "region_labels")
query("layer_summary", lambda s, d: regions.layer_summary(A.region_labels(s, d), BANDS(s), "y", 0.5), f", {BANDS_SQL}, z AS (SELECT layer, count(*) AS pixels FROM px GROUP BY layer), a AS (SELECT layer, count(*) AS grains, sum(area)::BIGINT AS area, avg(width) AS mean_width, avg(height) AS mean_height, avg(aspect) AS mean_aspect, avg(angle) AS mean_angle, count(*) FILTER (share < 0.999) AS crossing FROM g GROUP BY layer) SELECT layer, {r('(bottom - top) * 0.5::DOUBLE', 'thickness')}, coalesce(pixels, 0) AS pixels, coalesce(grains, 0) AS grains, {r('coalesce(grains::DOUBLE / pixels, 0)', 'density')}, {r('coalesce(area::DOUBLE / pixels, 0)', 'occupied')}, " + ", ".join(r(f"coalesce({c}, 0)", c) for c in ("mean_width", "mean_height", "mean_aspect", "mean_angle")) + ", coalesce(crossing, 0) AS crossing FROM b LEFT JOIN z USING (layer) LEFT JOIN a USING (layer)", "region_labels")
for name, agg in (("mean", "avg(v)"), ("sum", "sum(v)"), ("median", "quantile_cont(v, 0.5)")):
    query(f"depth_profile_{name}", lambda s, d, n=name: regions.depth_profile(A.pix(s, d), "y", n), f"SELECT y - 1 AS i, {r(agg, 'v')} FROM pix GROUP BY y", "pix")
query("robust_sigma", lambda s, d: regions.robust_sigma(A.traces(s, d), "user_id"), f", m AS (SELECT user_id, quantile_cont(v, 0.5) AS m FROM traces GROUP BY user_id) SELECT user_id, {r('1.4826::DOUBLE * quantile_cont(abs(v - m), 0.5)', 'sigma')} FROM traces JOIN m USING (user_id) GROUP BY user_id", "traces")
# Outlines and lengths
STEPS = "st AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM rings WINDOW w AS (PARTITION BY ring ORDER BY i))"
query("polygon_stats", lambda s, d: rounded(regions.polygon_stats(A.rings(s, d)), 4), f", {STEPS}, a AS (SELECT ring, sum(x * y2 - x2 * y) / 2 AS s, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS perimeter, sum((x + x2) * (x * y2 - x2 * y)) AS sx, sum((y + y2) * (x * y2 - x2 * y)) AS sy, avg(x) AS mx, avg(y) AS my FROM st GROUP BY ring) SELECT ring, round(abs(s), 4) AS area, round(perimeter, 4) AS perimeter, round(CASE WHEN abs(s) < 1e-12 THEN mx ELSE sx / (6 * s) END, 4) + 0.0 AS cx, round(CASE WHEN abs(s) < 1e-12 THEN my ELSE sy / (6 * s) END, 4) + 0.0 AS cy FROM a", "rings")
query("outline_harmonics", lambda s, d: rounded(regions.outline_harmonics(A.rings(s, d), 3), 4), f", {STEPS}, d AS (SELECT *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS step FROM st), t AS (SELECT *, sum(step) OVER (PARTITION BY ring ORDER BY i) AS t2, sum(step) OVER (PARTITION BY ring) AS tt FROM d WHERE step > 0), h AS (SELECT ring, n, tt / (2 * pi() ** 2 * n * n) / step AS k, x2 - x AS dx, y2 - y AS dy, cos(2 * pi() * n * t2 / tt) - cos(2 * pi() * n * (t2 - step) / tt) AS c, sin(2 * pi() * n * t2 / tt) - sin(2 * pi() * n * (t2 - step) / tt) AS s FROM t, range(1, 4) r(n)) SELECT ring, n::INT AS n, round(sum(k * dx * c), 4) + 0.0 AS a, round(sum(k * dx * s), 4) + 0.0 AS b, round(sum(k * dy * c), 4) + 0.0 AS c, round(sum(k * dy * s), 4) + 0.0 AS d FROM h GROUP BY ring, n", "rings")
CIRCLES = lambda s, d: A.rings(s, d).select((F.col("ring") % 40).alias("ring"), "x", "y")
KASA = "c AS (SELECT ring % 40 AS ring, x, y FROM rings), o AS (SELECT ring, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM c GROUP BY ring), u AS (SELECT ring, mx, my, n, x - mx AS u, y - my AS w FROM c JOIN o USING (ring)), m AS (SELECT ring, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n, avg(u * u) AS uu, avg(w * w) AS ww, avg(u * w) AS uw, avg(u * (u * u + w * w)) AS uq, avg(w * (u * u + w * w)) AS wq FROM u GROUP BY ring), k AS (SELECT *, (uq * ww - wq * uw) / (2 * (uu * ww - uw * uw)) AS a, (wq * uu - uq * uw) / (2 * (uu * ww - uw * uw)) AS b FROM m), f AS (SELECT ring, n, mx + a AS cx, my + b AS cy, sqrt(a * a + b * b + uu + ww) AS radius FROM k)"
query("circle_fit", lambda s, d: regions.circle_fit(CIRCLES(s, d)), f", {KASA} SELECT ring, n, {r('cx')}, {r('cy')}, {r('radius')}, {r('sqrt(avg((sqrt((x - cx) ** 2 + (y - cy) ** 2) - radius) ** 2))', 'rms')} FROM c JOIN f USING (ring) GROUP BY ring, n, cx, cy, radius", "rings")
query("tilted_distances", lambda s, d: regions.distances(A.segments(s, d), 52.0, "y").select("id", "raw", "corrected"), f"SELECT id, {r('sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)', 'raw')}, {r('sqrt((x2 - x1) ** 2 + ((y2 - y1) / sin(radians(52))) ** 2)', 'corrected')} FROM segments", "segments")
# Frames
query("crop", lambda s, d: raster.crop(A.pix(s, d), 40, 60, 11, 21), f"SELECT y - 10 AS y, x - 20 AS x, {r('v')} FROM pix WHERE y BETWEEN 11 AND 40 AND x BETWEEN 21 AND 60", "pix")
TURN = "a AS (SELECT y, x, greatest(1, least(64, round(cos(radians(12)) * (y - 32.5::DOUBLE) + sin(radians(12)) * (x - 48.5::DOUBLE) + 32.5::DOUBLE, 9))) AS sy, greatest(1, least(96, round(cos(radians(12)) * (x - 48.5::DOUBLE) - sin(radians(12)) * (y - 32.5::DOUBLE) + 48.5::DOUBLE, 9))) AS sx FROM pix), c AS (SELECT y, x, floor(sy)::INT + p AS yy, floor(sx)::INT + q AS xx, (CASE WHEN p = 1 THEN sy - floor(sy) ELSE floor(sy) + 1 - sy END) * (CASE WHEN q = 1 THEN sx - floor(sx) ELSE floor(sx) + 1 - sx END) AS k FROM a, range(2) u(p), range(2) w(q))"
query("turn", lambda s, d: raster.turn(A.pix(s, d), 12.0), f", {TURN} SELECT c.y, c.x, {r('sum(k * v)', 'v')} FROM c JOIN pix p ON p.y = yy AND p.x = xx WHERE k > 0 GROUP BY c.y, c.x", "pix")
QUAD = "t AS (SELECT y, x, v, x - 48.5::DOUBLE AS u, y - 32.5::DOUBLE AS w FROM pix), f AS (SELECT *, u * u - 9215 / 12.0::DOUBLE AS uu, w * w - 4095 / 12.0::DOUBLE AS ww FROM t), k AS (SELECT avg(v) AS k1, sum(u * v) / sum(u * u) AS ku, sum(w * v) / sum(w * w) AS kw, sum(uu * v) / sum(uu * uu) AS kuu, sum(ww * v) / sum(ww * ww) AS kww, sum(u * w * v) / sum(u * w * u * w) AS kuw FROM f)"
query("quadratic_level", lambda s, d: raster.quadratic_level(A.pix(s, d)), f", {QUAD} SELECT y, x, {r('v - k1 - ku * u - kw * w - kuu * uu - kww * ww - kuw * u * w', 'v')} FROM f, k", "pix")
query("cube_frames", lambda s, d: raster.explode_cube(A.cube(s, d)).select(F.col("ds_id").alias("frame"), "y", "x", "v"), "SELECT 'cube#' || ch AS frame, y, x, v FROM cube", "cube")
LINE = "ln(symbol, lo, hi) AS (VALUES ('Si', 1.655::DOUBLE, 1.825::DOUBLE), ('Fe', 6.319::DOUBLE, 6.489::DOUBLE), ('Au', 9.713::DOUBLE - 0.085::DOUBLE, 9.8::DOUBLE)), z AS (SELECT y, x, symbol, v, e < lo AS l, e > hi AS r FROM cube JOIN ln ON e >= lo - 0.17::DOUBLE AND e <= hi + 0.17::DOUBLE WHERE symbol <> 'Au')"
query("line_maps", lambda s, d: spectral.line_maps(A.cube(s, d), ["Si", "Fe", "Au", "Xx"], 200.0).drop("k", "mass"), f", {LINE} SELECT y, x, symbol, {r('greatest(0, coalesce(sum(v) FILTER (NOT l AND NOT r), 0) - coalesce((avg(v) FILTER (l) + avg(v) FILTER (r)) / 2, avg(v) FILTER (l OR r), 0) * count(*) FILTER (NOT l AND NOT r))', 'v')} FROM z GROUP BY y, x, symbol", "cube")
