"""Queries of the library over the driver's tables, each with the SQL that states its result. Reals are rounded to 5 digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import adapters as A
from lumenframe.operators import fourd, measure, raster, spectral
from lumenframe.plans.registry import SQL, Q, query, r, rounded

# Rasters
query("image_stats", lambda s, d: measure.image_stats(A.pix(s, d)), f"SELECT count(*) AS n, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')}, {r('quantile_cont(v, 0.5)', 'median')} FROM pix", "pix")
query("bin_average", lambda s, d: raster.bin_image(A.pix(s, d), 2), f"SELECT (y - 1) // 2 + 1 AS y, (x - 1) // 2 + 1 AS x, {r('avg(v)', 'v')} FROM pix GROUP BY ALL", "pix")
query("bin_sum_trimmed", lambda s, d: raster.bin_image(A.pix(s, d), 5, "sum"), f"SELECT (y - 1) // 5 + 1 AS y, (x - 1) // 5 + 1 AS x, {r('sum(v)', 'v')} FROM pix WHERE y <= 60 AND x <= 95 GROUP BY (y - 1) // 5 + 1, (x - 1) // 5 + 1", "pix")
query("area_downsample", lambda s, d: raster.area_downsample(A.pix(s, d), 20, 30), f"SELECT least(20, ceil(y * 20.0::DOUBLE / 64))::INT AS y, least(30, ceil(x * 30.0::DOUBLE / 96))::INT AS x, {r('avg(v)', 'v')} FROM pix GROUP BY least(20, ceil(y * 20.0::DOUBLE / 64))::INT, least(30, ceil(x * 30.0::DOUBLE / 96))::INT", "pix")
for n, (yy, xx) in {1: ("x", "65 - y"), 2: ("65 - y", "97 - x"), 3: ("97 - x", "y")}.items():
    query(f"rotate{90 * n}", lambda s, d, n=n: raster.rotate(A.pix(s, d), n), f"SELECT {yy} AS y, {xx} AS x, {r('v')} FROM pix", "pix")
query("fliph", lambda s, d: raster.flip(A.pix(s, d), True), f"SELECT y, 97 - x AS x, {r('v')} FROM pix", "pix")
query("flipv", lambda s, d: raster.flip(A.pix(s, d), False), f"SELECT 65 - y AS y, x, {r('v')} FROM pix", "pix")
GAUSS = "k AS (SELECT o, exp(-o * o / 8.0::DOUBLE) / (SELECT sum(exp(-p * p / 8.0::DOUBLE)) FROM range(-6, 7) t(p)) AS k FROM range(-6, 7) u(o)), gy AS (SELECT y + o AS y, x, sum(v * k) AS v FROM pix, k GROUP BY y + o, x), g AS (SELECT y, x + o AS x, sum(v * k) AS v FROM gy, k WHERE y BETWEEN 1 AND 64 GROUP BY y, x + o)"
query("gaussian", lambda s, d: raster.gaussian(A.pix(s, d), 2.0), f", {GAUSS} SELECT y, x, {r('v')} FROM g WHERE x BETWEEN 1 AND 96", "pix")
query("unsharp", lambda s, d: raster.unsharp(A.pix(s, d), 2.0, 1.5), f", {GAUSS} SELECT y, x, {r('p.v + 1.5::DOUBLE * (p.v - g.v)', 'v')} FROM pix p JOIN g USING (y, x)", "pix")
query("median3", lambda s, d: raster.median(A.pix(s, d), 3), f"SELECT p.y, p.x, {r('quantile_cont(q.v, 0.5)', 'v')} FROM pix p, range(-1, 2) a(dy), range(-1, 2) b(dx), pix q WHERE q.y = greatest(1, least(64, p.y + dy)) AND q.x = greatest(1, least(96, p.x + dx)) GROUP BY p.y, p.x", "pix")
PLANE = "m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(v) AS mv, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy, covar_pop(x, v) AS sxv, covar_pop(y, v) AS syv FROM pix), z AS (SELECT y, x, v - (mv + (sxv * syy - syv * sxy) / (sxx * syy - sxy * sxy) * (x - mx) + (syv * sxx - sxv * sxy) / (sxx * syy - sxy * sxy) * (y - my)) AS v FROM pix, m)"
query("plane_level", lambda s, d: raster.plane_level(A.pix(s, d)), f", {PLANE} SELECT y, x, {r('v')} FROM z", "pix")
query("roughness", lambda s, d: measure.roughness(A.pix(s, d)), f", {PLANE}, c AS (SELECT v - avg(v) OVER () AS v FROM z), q AS (SELECT sqrt(avg(v * v)) AS q FROM c) SELECT {r('avg(abs(v))', 'ra')}, {r('any_value(q)', 'rq')}, {r('max(v) - min(v)', 'rz')}, {r('avg(v ** 3) / any_value(q) ** 3', 'rsk')}, {r('avg(v ** 4) / any_value(q) ** 4', 'rku')}, {r('max(v)', 'rp')}, {r('-min(v)', 'rv')}, count(*) AS n FROM c, q", "pix")
MASK = "m AS (SELECT y, x, v > (SELECT avg(v) FROM pix) AS v FROM pix)"
NEAR = "t AS (SELECT a - 1 AS y, b - 1 AS x, false AS v FROM range(67) p(a), range(99) q(b) WHERE a - 1 NOT BETWEEN 1 AND 64 OR b - 1 NOT BETWEEN 1 AND 96), {out} AS (SELECT p.y, p.x, {agg}(q.v) AS v FROM {src} p JOIN (SELECT y, x, v FROM {src} UNION ALL SELECT * FROM t) q ON q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY p.y, p.x)"
AGAIN = NEAR[NEAR.index("{out}") :]
for op, aggs in (("erode", ["bool_and"]), ("dilate", ["bool_or"]), ("open", ["bool_and", "bool_or"]), ("close", ["bool_or", "bool_and"])):
    steps = ", ".join((AGAIN if i else NEAR).format(out=f"m{i}", agg=agg, src=f"m{i - 1}" if i else "m") for i, agg in enumerate(aggs))
    query(f"morph_{op}", lambda s, d, op=op: raster.morph(raster.above_mean(A.pix(s, d)), op), f", {MASK}, {steps} SELECT y, x, v::INT::DOUBLE AS v FROM m{len(aggs) - 1}", "pix")
query("normalize01", lambda s, d: raster.normalize01(A.pix(s, d)), f", e AS (SELECT min(v) AS a, max(v) AS b FROM pix) SELECT y, x, {r('(v - a) / (b - a)', 'v')} FROM pix, e", "pix")
query("robust_normalize01", lambda s, d: raster.normalize01(A.pix(s, d), 2.0), f", e AS (SELECT quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM pix) SELECT y, x, {r('greatest(0, least(1, (v - a) / (b - a)))', 'v')} FROM pix, e", "pix")
query("window_level", lambda s, d: raster.window_level(A.pix(s, d), 20.0, 400.0, 0.5), f"SELECT y, x, {r('greatest(0, least(1, (v - 20) / 380.0::DOUBLE)) ** 2', 'v')} FROM pix", "pix")
query("window_level_auto", lambda s, d: raster.window_level(A.pix(s, d), gamma=2.0), f"SELECT y, x, {r('sqrt((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()))', 'v')} FROM pix", "pix")
HIST = "e AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {n} AS w FROM pix), h AS (SELECT b AS bin, any_value(lo) AS lo, any_value(w) AS w, count(v) AS n FROM range({n}) s(b) CROSS JOIN e LEFT JOIN pix ON least({n} - 1, floor((v - lo) / w))::INT = b GROUP BY b)"
query("histogram", lambda s, d: raster.histogram(A.pix(s, d), 64), f", {HIST.format(n=64)} SELECT bin, {r('lo + (bin + 0.5::DOUBLE) * w', 'centre')}, n FROM h", "pix")
query("otsu", lambda s, d: raster.otsu(A.pix(s, d), 256), f", {HIST.format(n=256)}, c AS (SELECT *, (sum(n) OVER a)::BIGINT AS w0, (sum(n * bin) OVER a)::BIGINT AS m0, (sum(n) OVER ())::BIGINT AS na, (sum(n * bin) OVER ())::BIGINT AS ma FROM h WINDOW a AS (ORDER BY bin)) SELECT {r('lo + (bin + 1) * w', 'threshold')} FROM c WHERE w0 > 0 AND w0 < na ORDER BY (ma * w0 - m0 * na)::DOUBLE ** 2 / (w0::DOUBLE * (na - w0)) DESC, bin LIMIT 1", "pix")
query("gradient", lambda s, d: raster.gradient(A.pix(s, d)), f", g AS (SELECT y, x, v, lag(v) OVER a AS y0, lead(v) OVER a AS y1, lag(v) OVER b AS x0, lead(v) OVER b AS x1 FROM pix WINDOW a AS (PARTITION BY x ORDER BY y), b AS (PARTITION BY y ORDER BY x)) SELECT y, x, {r('CASE WHEN y0 IS NULL THEN y1 - v WHEN y1 IS NULL THEN v - y0 ELSE (y1 - y0) / 2 END', 'gy')}, {r('CASE WHEN x0 IS NULL THEN x1 - v WHEN x1 IS NULL THEN v - x0 ELSE (x1 - x0) / 2 END', 'gx')} FROM g", "pix")
PAIR = lambda s: s.createDataFrame([("pix", "pix_b")], "ds_id string, other string")
for op, term in {"ratio": "a.v / greatest(a.v + b.v, 1)", "divide": "a.v / greatest(b.v, 1)", "subtract": "a.v - b.v", "add": "a.v + b.v"}.items():
    query(f"image_math_{op}", lambda s, d, op=op: raster.image_math(A.pix(s, d), A.pix_b(s, d), op, PAIR(s)), f"SELECT y, x, {r(term, 'v')} FROM pix a JOIN pix_b b USING (y, x)", "pix", "pix_b")
query("max_projection", lambda s, d: raster.mip([A.pix(s, d), raster.flip(A.pix(s, d), True)]), f"SELECT a.y, a.x, {r('greatest(a.v, b.v)', 'v')} FROM pix a JOIN pix b ON b.y = a.y AND b.x = 97 - a.x", "pix")
# Measurements
query("roi_stats", lambda s, d: measure.roi_stats(A.pix(s, d), measure.in_rect(40, 10, 5, 60), 0.5), f"SELECT count(*) AS n, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')}, {r('count(*) * 0.25::DOUBLE', 'area')} FROM pix WHERE y BETWEEN 5 AND 40 AND x BETWEEN 10 AND 60", "pix")
query("ellipse_stats", lambda s, d: measure.roi_stats(A.pix(s, d), measure.in_ellipse(5, 10, 40, 60)), f"SELECT count(*) AS n, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')}, {r('count(*)::DOUBLE', 'area')} FROM pix WHERE y BETWEEN 5 AND 40 AND x BETWEEN 10 AND 60 AND ((y - 22.5::DOUBLE) / 18) ** 2 + ((x - 35) / 25.5::DOUBLE) ** 2 <= 1", "pix")
query("box_marginals", lambda s, d: measure.box_integrate(A.pix(s, d), 3, 4, 30, 50), f", b AS (SELECT * FROM pix WHERE y BETWEEN 3 AND 30 AND x BETWEEN 4 AND 50) SELECT 'y' AS axis, y AS at, {r('sum(v)', 'v')} FROM b GROUP BY y UNION ALL SELECT 'x', x, round(sum(v), 5) + 0.0 FROM b GROUP BY x", "pix")
query("radial_profile", lambda s, d: measure.radial_profile(A.pix(s, d)), f", c AS (SELECT v, sqrt((x - 48.5::DOUBLE) ** 2 + (y - 32.5::DOUBLE) ** 2) AS rr, sqrt(47.5::DOUBLE ** 2 + 31.5::DOUBLE ** 2) / 32 AS w FROM pix) SELECT least(31, floor(rr / w))::INT AS bin, {r('avg(v)', 'mean')}, {r('max(v)', 'max')}, {r('stddev_pop(v)', 'std')}, count(*) AS n FROM c GROUP BY least(31, floor(rr / w))::INT", "pix")
RADII = "c AS (SELECT v, x - 48.5::DOUBLE AS dx, y - 32.5::DOUBLE AS dy FROM pix), a AS (SELECT v, sqrt(dx * dx + dy * dy) AS rr, CASE WHEN atan2(dy, dx) < 0 THEN degrees(atan2(dy, dx)) + 360 ELSE degrees(atan2(dy, dx)) END AS t FROM c)"
for name, (lo, hi) in {"sector": (300.0, 30.0), "whole": (0.0, 360.0), "equal_ends": (45.0, 45.0)}.items():
    inside = "true" if name == "whole" else f"(t >= {lo} OR t < {hi})"
    query(f"azimuthal_{name}", lambda s, d, lo=lo, hi=hi: measure.azimuthal(A.pix(s, d), lo, hi, 16), f", {RADII} SELECT least(15, floor(rr / (31.5::DOUBLE / 16)))::INT AS bin, {r('avg(v)', 'mean')}, count(*) AS n FROM a WHERE {inside} AND rr < 31.5::DOUBLE GROUP BY least(15, floor(rr / (31.5::DOUBLE / 16)))::INT", "pix")
query("line_profile", lambda s, d: measure.line_profile(A.pix(s, d), 5.0, 8.0, 70.0, 50.0), f", s AS (SELECT i, 5 + 65 * (i / 78.0::DOUBLE) AS sx, 8 + 42 * (i / 78.0::DOUBLE) AS sy FROM range(79) t(i)), c AS (SELECT i, floor(sx)::INT + dx AS x, floor(sy)::INT + dy AS y, (CASE WHEN dx = 1 THEN sx - floor(sx) ELSE floor(sx) + 1 - sx END) * (CASE WHEN dy = 1 THEN sy - floor(sy) ELSE floor(sy) + 1 - sy END) AS k FROM s, range(2) a(dx), range(2) b(dy)) SELECT i, {r('i * (sqrt(65.0::DOUBLE ** 2 + 42.0::DOUBLE ** 2) / 78)', 'distance')}, {r('sum(v * k)', 'v')} FROM c JOIN pix USING (y, x) WHERE k > 0 GROUP BY i", "pix")
query("bearing_curve", lambda s, d: measure.bearing_curve(A.pix(s, d), 10), f", q AS (SELECT quantile_cont(v, [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0]) AS q FROM pix) SELECT i::INT AS step, {r('q[i + 1]', 'height')} FROM q, range(11) t(i)", "pix")
query("hhcf", lambda s, d: rounded(measure.hhcf(A.traces(s, d), 4), 2), f"SELECT a.user_id, lag::INT AS lag, round(avg((b.v - a.v) ** 2), 2) + 0.0 AS g, count(*) AS n FROM traces a, range(1, 5) l(lag), traces b WHERE b.user_id = a.user_id AND b.i = a.i + lag GROUP BY a.user_id, lag HAVING count(*) >= 8", "traces")
query("trapezoid", lambda s, d: measure.trapezoid(A.traces(s, d)), f", k AS (SELECT user_id, v, (coalesce(lead(i) OVER w - i, 0) + coalesce(i - lag(i) OVER w, 0)) / 2.0::DOUBLE AS k FROM traces WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, {r('sum(v * k)', 'area')}, {r('sum(k * k * greatest(v, 0))', 'variance')} FROM k GROUP BY user_id", "traces")
query("distribution_summary", lambda s, d: measure.summarize(A.populations(s, d)), f"SELECT grp, count(v) AS n, count(*) - count(v) AS dropped, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'min')}, {r('max(v)', 'max')}, {r('quantile_cont(v, 0.25)', 'q1')}, {r('quantile_cont(v, 0.5)', 'median')}, {r('quantile_cont(v, 0.75)', 'q3')} FROM populations GROUP BY grp", "populations")
FITS = "b AS (SELECT grp, 'normal' AS kind, v AS t, 0.0::DOUBLE AS j FROM populations UNION ALL SELECT grp, 'lognormal', ln(v), ln(v) FROM populations WHERE v > 0), f AS (SELECT grp, kind, count(*) AS n, avg(t) AS loc, stddev_pop(t) AS scale, sum(j) AS jac FROM b GROUP BY grp, kind), g AS (SELECT *, -n * (ln(scale) + 0.5::DOUBLE * ln(2 * pi()) + 0.5::DOUBLE) - jac AS l FROM f)"
query("distribution_fits", lambda s, d: rounded(measure.fit_normal_lognormal(A.populations(s, d)), 3), f", {FITS} SELECT grp, kind, n, round(loc, 3) + 0.0 AS loc, round(scale, 3) + 0.0 AS scale, round(l, 3) + 0.0 AS loglik, round(4 - 2 * l, 3) + 0.0 AS aic FROM g", "populations")
query("histogram_bins", lambda s, d: measure.histogram_bins(A.populations(s, d)), ", s AS (SELECT grp, count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM populations GROUP BY grp), b AS (SELECT *, least(200, greatest(1, ceil((hi - lo) / (2 * iqr / cbrt(n)))))::INT AS bins FROM s) SELECT grp, bins, least(bins - 1, floor((v - lo) / ((hi - lo) / bins)))::INT AS bin, count(v) AS n FROM populations JOIN (SELECT grp, lo, hi, bins FROM b) b USING (grp) GROUP BY ALL", "populations")
# Spectra
query("sum_spectrum", lambda s, d: spectral.sum_spectrum(A.cube(s, d)), f"SELECT ch, {r('e')}, {r('sum(v)', 'v')} FROM cube GROUP BY ch, e", "cube")
query("element_map", lambda s, d: spectral.element_map(A.cube(s, d), 1.5, 2.1), f"SELECT y, x, {r('sum(v)', 'v')} FROM cube WHERE e >= 1.5 AND e <= 2.1 GROUP BY y, x", "cube")
SIDES = "w AS (SELECT y, x, e, v, e >= 1.17::DOUBLE AND e < 1.47::DOUBLE AS l, e > 2.12::DOUBLE AND e <= 2.42::DOUBLE AS r, e >= 1.52::DOUBLE AND e <= 2.07::DOUBLE AS p, (20 - e) / e AS c FROM cube)"
query("element_map_linear", lambda s, d: spectral.element_map(A.cube(s, d), 1.52, 2.07, "linear", 0.3, 0.05), f", {SIDES} SELECT y, x, {r('greatest(0, sum(v) FILTER (p) - 0.5::DOUBLE * (avg(v) FILTER (l) + avg(v) FILTER (r)) * count(*) FILTER (p))', 'v')} FROM w GROUP BY y, x", "cube")
query("element_map_bremsstrahlung", lambda s, d: spectral.element_map(A.cube(s, d), 1.52, 2.07, "bremsstrahlung", 0.3, 0.05, 20.0), f", {SIDES} SELECT y, x, {r('greatest(0, sum(v) FILTER (p) - sum(c * v) FILTER (l OR r) / sum(c * c) FILTER (l OR r) * sum(c) FILTER (p))', 'v')} FROM w GROUP BY y, x", "cube")
ELEMENTS = ["Si", "Fe", "O"]
LINES3 = "t(symbol, energy, k, mass) AS (VALUES ('Si', 1.740::DOUBLE, 1.00::DOUBLE, 28.085::DOUBLE), ('Fe', 6.404::DOUBLE, 1.21::DOUBLE, 55.845::DOUBLE), ('O', 0.525::DOUBLE, 1.80::DOUBLE, 15.999::DOUBLE))"
MAPS = f"{LINES3}, i AS (SELECT y, x, symbol, k, mass, sum(v) AS v FROM cube JOIN t ON abs(e - energy) <= 0.2::DOUBLE GROUP BY ALL)"
query("element_maps", lambda s, d: spectral.element_maps(A.cube(s, d), ELEMENTS).drop("k", "mass"), f", {MAPS} SELECT y, x, symbol, {r('v')} FROM i", "cube")
query("cliff_lorimer", lambda s, d: spectral.cliff_lorimer(spectral.element_maps(A.cube(s, d), ELEMENTS)), f", {MAPS}, f AS (SELECT symbol, v * k / sum(v * k) OVER p AS w, (v * k / mass) / sum(v * k / mass) OVER p AS a FROM i WINDOW p AS (PARTITION BY y, x)) SELECT symbol, {r('100 * avg(w)', 'weight_pct')}, {r('100 * avg(a)', 'atomic_pct')}, count(*) AS n FROM f GROUP BY symbol", "cube")
LAW = "l AS (SELECT *, {x} AS lx, ln(greatest(v, 2.220446049250313e-16)) AS ly FROM {src}), p AS (SELECT {keys} regr_slope(ly, lx) AS b, regr_intercept(ly, lx) AS a FROM l WHERE e >= 1 AND e <= 3.5 {group})"
for method, x in (("powerlaw", "ln(e)"), ("exponential", "e")):
    query(f"edge_map_{method}", lambda s, d, m=method: spectral.edge_map(A.cube(s, d), (4.0, 6.0), (1.0, 3.5), m), f", {LAW.format(x=x, src='cube', keys='y, x,', group='GROUP BY y, x')} SELECT y, x, {r('sum(greatest(0, v - exp(a + b * lx)))', 'v')} FROM l JOIN p USING (y, x) WHERE e >= 4 AND e <= 6 GROUP BY y, x", "cube")
    rate = "-b AS r" if method == "powerlaw" else "b"
    query(f"background_{method}", lambda s, d, m=method: rounded(spectral.background(spectral.sum_spectrum(A.cube(s, d)), (1.0, 3.5), m), 4), f", u AS (SELECT ch, e, sum(v) AS v FROM cube GROUP BY ch, e), {LAW.format(x=x, src='u', keys='', group='')} SELECT ch, round(e, 4) AS e, round(greatest(0, v - exp(a + b * lx)), 4) + 0.0 AS signal, round(exp(a + b * lx), 4) + 0.0 AS background, round(exp(a), 4) + 0.0 AS a, round({rate.split(' AS ')[0]}, 4) + 0.0 AS {rate.split(' AS ')[-1]} FROM l, p", "cube")
query("edge_map_direct", lambda s, d: spectral.edge_map(A.cube(s, d), (4.0, 6.0)), f"SELECT y, x, {r('sum(v)', 'v')} FROM cube WHERE e >= 4 AND e <= 6 GROUP BY y, x", "cube")
KLM = "t(symbol, line, energy, edge) AS (VALUES " + ", ".join(f"('{s}', '{n}', {e}::DOUBLE, {e}::DOUBLE / {spectral.EDGE_SHARE[n]}::DOUBLE)" for n, t in (("K", spectral.K_LINES), ("L", spectral.L_LINES), ("M", spectral.M_LINES)) for s, e in t.items()) + ")"
BEST = "p AS (SELECT symbol, line, energy FROM t QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ({kv} / edge >= 1.5) DESC, CASE WHEN {kv} / edge >= 1.5 THEN line END, {kv} / edge DESC, line) = 1)"
query("element_windows", lambda s, d: spectral.element_windows(spectral.sum_spectrum(A.cube(s, d)), 200.0, ["Si", "Au", "Fe", "Xx", "Mo"]), f", {KLM}, {BEST.format(kv=200)}, x AS (SELECT min(e) AS e0, max(e) AS e1 FROM cube) SELECT s.symbol, line, {r('energy')}, {r('energy - 0.085::DOUBLE', 'lo')}, {r('energy + 0.085::DOUBLE', 'hi')}, CASE WHEN energy IS NULL THEN 'no line' WHEN energy < e0 OR energy > e1 THEN 'outside the axis' END AS reason FROM (VALUES ('Si'), ('Au'), ('Fe'), ('Xx'), ('Mo')) s(symbol) LEFT JOIN p USING (symbol), x", "cube")
PARTS = "q AS (SELECT y, x, symbol, v AS q, sqrt(greatest(v, 0)) AS qs FROM i)"
query("fraction_sigma", lambda s, d: measure.fraction_sigma(spectral.element_maps(A.cube(s, d), ELEMENTS).select("ds_id", "y", "x", "symbol", F.col("v").alias("q"), measure.poisson_sigma(F.col("v")).alias("q_sigma")), "ds_id", "y", "x"), f", {MAPS}, {PARTS}, t AS (SELECT *, sum(q) OVER p AS s, sum(qs * qs) OVER p AS vs, count(*) OVER p AS n FROM q WINDOW p AS (PARTITION BY y, x)) SELECT y, x, symbol, {r('q')}, {r('qs', 'q_sigma')}, CASE WHEN s > 0 THEN round(q / s, 5) + 0.0 END AS fraction, CASE WHEN s > 0 THEN CASE WHEN n = 1 THEN 0 ELSE round(100 * sqrt(((1 - q / s) ** 2 * qs * qs + (q / s) ** 2 * (vs - qs * qs)) / (s * s)), 5) + 0.0 END END AS fraction_sigma FROM t".replace(", t AS (SELECT *, sum(q)", ", tt AS (SELECT *, sum(q)").replace(" FROM t", " FROM tt"), "cube")
query("thickness_map", lambda s, d: spectral.thickness_map(A.cube(s, d), (0.0, 2.0)), f", t AS (SELECT y, x, sum(v) AS a, sum(v) FILTER (e >= 0 AND e <= 2) AS z FROM cube GROUP BY y, x) SELECT y, x, {r('ln(a / z)', 'v')} FROM t WHERE a >= 100 AND z > 0 AND a > z", "cube")
PEAKS = "s AS (SELECT ch, e, sum(v) AS v FROM cube GROUP BY ch, e), b AS (SELECT ch, e, sum(v) OVER (ORDER BY ch ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS h FROM s), c AS (SELECT *, lag(h) OVER w AS h0, lead(h) OVER w AS h1, max(h) OVER () AS top FROM b WINDOW w AS (ORDER BY ch)), p AS (SELECT ch, e, h FROM c WHERE h > h0 AND h > h1 AND h >= 0.05::DOUBLE * top)"
query("detect_peaks", lambda s, d: spectral.detect_peaks(spectral.sum_spectrum(A.cube(s, d))), f", {PEAKS} SELECT ch, {r('e')}, {r('h', 'height')} FROM p", "cube")
ALL_LINES = "t(symbol, energy) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in spectral.K_LINES.items()) + ")"
query("anchor_centroids", lambda s, d: spectral.centroid(spectral.sum_spectrum(A.cube(s, d)), [1.74, 6.404], 0.4), f", s AS (SELECT e, sum(v) AS v FROM cube GROUP BY e) SELECT {r('anchor')}, {r('sum(e * v) / sum(v)', 'centre')} FROM s JOIN (VALUES (1.74::DOUBLE), (6.404::DOUBLE)) a(anchor) ON abs(e - anchor) <= 0.4::DOUBLE GROUP BY anchor", "cube")
# 4D scans
query("virtual_bright_field", lambda s, d: fourd.virtual_detector(A.scan4d(s, d), fourd.aperture(3.5, 3.5, 0.0, 2.5)), f"SELECT sy, sx, {r('sum(v) FILTER ((ky - 3.5::DOUBLE) ** 2 + (kx - 3.5::DOUBLE) ** 2 <= 6.25)', 'v')} FROM scan4d GROUP BY sy, sx", "scan4d")
query("virtual_annular", lambda s, d: fourd.virtual_detector(A.scan4d(s, d), fourd.aperture(3.5, 3.5, 2.5, 4.0)), f"SELECT sy, sx, {r('sum(v) FILTER ((ky - 3.5::DOUBLE) ** 2 + (kx - 3.5::DOUBLE) ** 2 BETWEEN 6.25 AND 16)', 'v')} FROM scan4d GROUP BY sy, sx", "scan4d")
query("nav_image", lambda s, d: fourd.nav_image(A.scan4d(s, d)), f"SELECT sy, sx, {r('sum(v)', 'v')} FROM scan4d GROUP BY sy, sx", "scan4d")
query("mean_pattern", lambda s, d: fourd.mean_pattern(A.scan4d(s, d)), f"SELECT ky, kx, {r('avg(v)', 'v')} FROM scan4d GROUP BY ky, kx", "scan4d")
query("pattern_center", lambda s, d: fourd.pattern_center(A.scan4d(s, d)), f", m AS (SELECT ky, kx, avg(v) AS v FROM scan4d GROUP BY ky, kx) SELECT {r('sum(ky * v) / sum(v)', 'cy')}, {r('sum(kx * v) / sum(v)', 'cx')} FROM m", "scan4d")
query("com_shift", lambda s, d: fourd.com_shift(A.scan4d(s, d), 3.5, 3.5), f"SELECT sy, sx, {r('sum(ky * v) / sum(v) - 3.5::DOUBLE', 'dy')}, {r('sum(kx * v) / sum(v) - 3.5::DOUBLE', 'dx')} FROM scan4d GROUP BY sy, sx", "scan4d")
DPC = "c AS (SELECT sy, sx, 2 * (sum(ky * v) / sum(v) - 3.5::DOUBLE) AS fy, 2 * (sum(kx * v) / sum(v) - 3.5::DOUBLE) AS fx FROM scan4d GROUP BY sy, sx), g AS (SELECT *, lag(fy) OVER a AS y0, lead(fy) OVER a AS y1, lag(fx) OVER b AS x0, lead(fx) OVER b AS x1 FROM c WINDOW a AS (PARTITION BY sx ORDER BY sy), b AS (PARTITION BY sy ORDER BY sx))"
query("dpc_maps", lambda s, d: fourd.dpc(fourd.com_shift(A.scan4d(s, d), 3.5, 3.5), 2.0), f", {DPC} SELECT sy, sx, {r('fy')}, {r('fx')}, {r('sqrt(fy * fy + fx * fx)', 'magnitude')}, {r('atan2(fy, fx)', 'direction')}, {r('coalesce(CASE WHEN y0 IS NULL THEN y1 - fy WHEN y1 IS NULL THEN fy - y0 ELSE (y1 - y0) / 2 END, 0) + coalesce(CASE WHEN x0 IS NULL THEN x1 - fx WHEN x1 IS NULL THEN fx - x0 ELSE (x1 - x0) / 2 END, 0)', 'divergence')} FROM g", "scan4d")


def _events(s: SparkSession, d: str) -> DataFrame:
    from lumenframe.streaming.watch import windowed_events

    out = windowed_events(A.table(s, d, "events"))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


query("windowed_events", _events, f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, {r('sum(value)', 'total')} FROM events GROUP BY date_trunc('hour', ts), event_type")


def _load() -> None:
    """The other modules of queries register theirs when they are imported."""
    from lumenframe.plans import analysis_queries, compare_queries, crystal_queries, point_queries, region_queries, shape_queries, structure_queries, table_queries, value_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
