"""Queries of crystals, diffraction, texture and wide profiles, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import adapters as A
from lumenframe.operators import crystal, texture
from lumenframe.plans.analysis_queries import values
from lumenframe.plans.registry import query, r

# Phases
ROWS = [(n, a, a, a, 90.0, 90.0, 90.0, c) for n, (a, c) in crystal.CUBIC.items()] + [(n, a, a, c, 90.0, 90.0, 120.0, k) for n, (a, c, k) in crystal.HEXAGONAL.items()]
PHASES = values("ph(name, a, b, c, al, be, ga, centering)", ROWS)
CUSTOM = [("silicon", 5.5, 5.5, 5.5, 90.0, 90.0, 90.0, "F"), ("Odd", 4.1, 5.2, 6.3, 81.0, 95.0, 104.0, "C")]
# The volume form of the distance, beside the reciprocal metric of the operator.
D = "sqrt(a * a * b * b * c * c * (1 - cos(radians(al)) ** 2 - cos(radians(be)) ** 2 - cos(radians(ga)) ** 2 + 2 * cos(radians(al)) * cos(radians(be)) * cos(radians(ga))) / ((h * b * c * sin(radians(al))) ** 2 + (k * a * c * sin(radians(be))) ** 2 + (l * a * b * sin(radians(ga))) ** 2 + 2 * h * k * a * b * c * c * (cos(radians(al)) * cos(radians(be)) - cos(radians(ga))) + 2 * k * l * a * a * b * c * (cos(radians(be)) * cos(radians(ga)) - cos(radians(al))) + 2 * h * l * a * b * b * c * (cos(radians(al)) * cos(radians(ga)) - cos(radians(be)))))"
LET = "CASE centering WHEN 'F' THEN (h + k) % 2 = 0 AND (k + l) % 2 = 0 AND (h + l) % 2 = 0 WHEN 'I' THEN (h + k + l) % 2 = 0 WHEN 'C' THEN (h + k) % 2 = 0 WHEN 'R' THEN (k + l - h) % 3 = 0 ELSE true END"
HKL = "ix AS (SELECT name, h, k, l, {d} AS d FROM {src}, range(-{m}, {m} + 1) p(h), range(-{m}, {m} + 1) q(k), range(-{m}, {m} + 1) s(l) WHERE (h <> 0 OR k <> 0 OR l <> 0) AND {let})"
FAM = "fa AS (SELECT name, round(d, 8) AS dr, avg(d) AS d, count(*) AS multiplicity, arg_min(struct_pack(h := h::INT, k := k::INT, l := l::INT), (NOT (h > 0 OR h = 0 AND k > 0 OR h = 0 AND k = 0 AND l > 0))::INT * 1e9 + ((h < 0)::INT + (k < 0)::INT + (l < 0)::INT) * 1e8 + (100 - (h + k + l)) * 1e5 + abs(h) * 1e4 + abs(k) * 1e2 + abs(l)) AS b FROM ix GROUP BY name, round(d, 8))"
BOTH = lambda s: crystal.phases(s).where("name IN ('Silicon', 'Tungsten', 'ZnO (wurtzite)', 'Sapphire (Al2O3)')").unionByName(s.createDataFrame(CUSTOM[1:], crystal.PHASE))
CU = values("cu(name, a, b, c, al, be, ga, centering)", CUSTOM[1:])
BOTH_SQL = f"{PHASES}, {CU}, bo AS (SELECT * FROM ph WHERE name IN ('Silicon', 'Tungsten', 'ZnO (wurtzite)', 'Sapphire (Al2O3)') UNION ALL SELECT * FROM cu)"
ATOMS = [("Silicon", 14.0, x + o, y + o, z + o) for o in (0.0, 0.25) for x, y, z in ((0.0, 0.0, 0.0), (0.5, 0.5, 0.0), (0.5, 0.0, 0.5), (0.0, 0.5, 0.5))]
SI = lambda s: crystal.strong(crystal.structure_factor(crystal.zone_reflections(crystal.phases(s).where("name = 'Silicon'"), (0, 0, 1), 6), s.createDataFrame(ATOMS, "name string, weight double, x double, y double, z double"), 0.5))
LAM = "(6.62607015e-34::DOUBLE / sqrt(2 * 9.1093837015e-31::DOUBLE * 1.602176634e-19::DOUBLE * 200000 * (1 + 1.602176634e-19::DOUBLE * 200000 / (2 * 9.1093837015e-31::DOUBLE * 299792458.0::DOUBLE ** 2))) * 1e10::DOUBLE)"
SPOTS = lambda s, d: A.table(s, d, "supplier").where("s_suppkey < 60").select(F.col("s_suppkey").alias("spot"), (F.col("s_suppkey") * 37 % 480 + 17).cast("double").alias("y"), (F.col("s_suppkey") * 101 % 470 + 21).cast("double").alias("x"))
SPOTS_SQL = "sp AS (SELECT s_suppkey AS spot, (s_suppkey * 37 % 480 + 17)::DOUBLE AS y, (s_suppkey * 101 % 470 + 21)::DOUBLE AS x FROM supplier WHERE s_suppkey < 60), me AS (SELECT spot, 512 * 0.2::DOUBLE / sqrt((y - 257) ** 2 + (x - 257) ** 2) AS d FROM sp WHERE y <> 257 OR x <> 257)"
# Texture
LAP = "ly AS (SELECT y, x, lag(v) OVER w - 2 * v + lead(v) OVER w AS v FROM pix WINDOW w AS (PARTITION BY x ORDER BY y)), lx AS (SELECT lag(v) OVER w - 2 * v + lead(v) OVER w AS v FROM ly WHERE v IS NOT NULL WINDOW w AS (PARTITION BY y ORDER BY x))"
NOISE = f"{LAP}, sg AS (SELECT quantile_cont(abs(v), 0.5) / 0.6745::DOUBLE / sqrt(20) AS sigma FROM lx WHERE v IS NOT NULL), bl AS (SELECT avg(v) AS m, var_samp(v) AS s2 FROM pix GROUP BY (y - 1) // 16, (x - 1) // 16), rg AS (SELECT regr_slope(s2, m) AS slope, regr_intercept(s2, m) AS icept, regr_r2(s2, m) AS r2 FROM bl WHERE m > 0), av AS (SELECT avg(v) AS level FROM pix)"
query("noise", lambda s, d: texture.noise(A.pix(s, d)), f", {NOISE} SELECT {r('sigma')}, {r('level / sigma', 'snr')}, {r('20 * log10(level / sigma)', 'snr_db')}, {r('slope')}, {r('icept')}, {r('r2')}, CASE WHEN r2 > 0.6 AND slope > 0 THEN 'poisson' WHEN r2 < 0.4 THEN 'gaussian' WHEN r2 <= 0.6 THEN 'mixed' ELSE 'unknown' END AS kind FROM sg, rg, av", "pix")
BLUR = "k AS (SELECT o, exp(-o * o / 2.0::DOUBLE) / (SELECT sum(exp(-p * p / 2.0::DOUBLE)) FROM range(-3, 4) t(p)) AS k FROM range(-3, 4) u(o)), gr AS (SELECT y, x, CASE WHEN lag(v) OVER a IS NULL THEN lead(v) OVER a - v WHEN lead(v) OVER a IS NULL THEN v - lag(v) OVER a ELSE (lead(v) OVER a - lag(v) OVER a) / 2 END AS gy, CASE WHEN lag(v) OVER b IS NULL THEN lead(v) OVER b - v WHEN lead(v) OVER b IS NULL THEN v - lag(v) OVER b ELSE (lead(v) OVER b - lag(v) OVER b) / 2 END AS gx FROM pix WINDOW a AS (PARTITION BY x ORDER BY y), b AS (PARTITION BY y ORDER BY x)), by_ AS (SELECT y + o AS y, x, sum(gx * gx * k) AS xx, sum(gx * gy * k) AS xy, sum(gy * gy * k) AS yy FROM gr, k GROUP BY y + o, x), bx AS (SELECT y, x + o AS x, sum(xx * k) AS xx, sum(xy * k) AS xy, sum(yy * k) AS yy FROM by_, k WHERE y BETWEEN 1 AND 64 GROUP BY y, x + o), st AS (SELECT y, x, atan2(2 * xy, xx - yy) / 2 AS orientation, (2 * sqrt(((xx - yy) / 2) ** 2 + xy * xy) / (xx + yy + 2.220446049250313e-16)) ** 2 AS coherence, xx + yy AS energy FROM bx WHERE x BETWEEN 1 AND 96)"
query("structure_tensor", lambda s, d: texture.structure_tensor(A.pix(s, d), 1.0).select("ds_id", "y", "x", "coherence", F.round("energy", 3).alias("energy"), F.abs(F.sin(F.col("orientation"))).alias("rise")), f", {BLUR} SELECT y, x, {r('coherence')}, round(energy, 3) + 0.0 AS energy, {r('abs(sin(orientation))', 'rise')} FROM st", "pix")
query("growth_orientation", lambda s, d: texture.growth_orientation(A.pix(s, d), 1.0), f", {BLUR}, su AS (SELECT sum(coherence * cos(2 * orientation)) AS c, sum(coherence * sin(2 * orientation)) AS s, sum(coherence) AS n FROM st), th AS (SELECT *, atan2(s, c) / 2 AS t FROM su) SELECT CASE WHEN abs(t) > pi() / 4 THEN 'y' ELSE 'x' END AS axis, {r('degrees(CASE WHEN abs(t) <= pi() / 4 THEN t WHEN t > 0 THEN t - pi() / 2 ELSE t + pi() / 2 END)', 'tilt')}, {r('sqrt(c * c + s * s) / n', 'coherence')} FROM th", "pix")
BINS = "e AS (SELECT min(v) AS lo, max(v) AS hi FROM pix), h AS (SELECT b AS bin, count(v) AS n FROM range({n}) s(b) CROSS JOIN e LEFT JOIN pix ON least({n} - 1, floor((v - lo) / ((hi - lo) / {n})))::INT = b GROUP BY b), c AS MATERIALIZED (SELECT bin, (sum(n) OVER a)::DOUBLE AS w, (sum(n * bin) OVER a)::DOUBLE AS m FROM h WINDOW a AS (ORDER BY bin))"
GAIN = "coalesce(({b}.m - {a}.m) ** 2 / nullif({b}.w - {a}.w, 0), 0)"
OTSU3 = f"{BINS.format(n=256)}, z AS (SELECT * FROM c WHERE bin = 255), o AS (SELECT p.bin AS b1, q.bin AS b2 FROM c p, c q, z WHERE p.bin < q.bin AND q.bin < 255 ORDER BY round((coalesce(p.m ** 2 / nullif(p.w, 0), 0) + {GAIN.format(a='p', b='q')} + {GAIN.format(a='q', b='z')}) / z.w, 9) DESC, p.bin, q.bin LIMIT 1), th AS (SELECT lo + (b1 + 1) * (hi - lo) / 256 AS t1, lo + (b2 + 1) * (hi - lo) / 256 AS t2 FROM o, e)"
query("multi_otsu3", lambda s, d: texture.multi_otsu(A.pix(s, d), 3), f", {OTSU3} SELECT {r('t1')}, {r('t2')} FROM th", "pix")
OTSU4 = f"{BINS.format(n=256)}, z AS (SELECT * FROM c WHERE bin = 255), o AS (SELECT p.bin AS b1, q.bin AS b2, s.bin AS b3 FROM c p, c q, c s, z WHERE p.bin < q.bin AND q.bin < s.bin AND s.bin < 255 ORDER BY round((coalesce(p.m ** 2 / nullif(p.w, 0), 0) + {GAIN.format(a='p', b='q')} + {GAIN.format(a='q', b='s')} + {GAIN.format(a='s', b='z')}) / z.w, 9) DESC, p.bin, q.bin, s.bin LIMIT 1)"
query("multi_otsu4", lambda s, d: texture.multi_otsu(A.pix(s, d), 4), f", {OTSU4} SELECT " + ", ".join(r(f"lo + (b{i} + 1) * (hi - lo) / 256", f"t{i}") for i in (1, 2, 3)) + " FROM o, e", "pix")
CLASSES = lambda s, d: texture.classify(A.pix(s, d), texture.multi_otsu(A.pix(s, d), 3))
query("class_shares", lambda s, d: texture.class_shares(CLASSES(s, d), A.pix(s, d)), f", {OTSU3} SELECT (1 + (v > t1)::INT + (v > t2)::INT)::INT AS label, {r('count(*) / 6144.0::DOUBLE', 'share')}, min(v) AS min, max(v) AS max FROM pix, th GROUP BY 1", "pix")
query("surface_area_ratio", lambda s, d: texture.surface_area_ratio(A.pix(s, d), 20.0), f", q AS (SELECT a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM pix a JOIN pix b ON b.y = a.y AND b.x = a.x + 1 JOIN pix c ON c.x = a.x AND c.y = a.y + 1 JOIN pix d ON d.y = a.y + 1 AND d.x = a.x + 1) SELECT {r('avg(sqrt((b - a) ** 2 + (c - a) ** 2 + 400) + sqrt((b - d) ** 2 + (c - d) ** 2 + 400)) / 2 / 20', 'ratio')} FROM q", "pix")
# Profiles
BAND = "s AS (SELECT i, j, {x1} + {dx} * (i / {n}.0::DOUBLE) - {uy}::DOUBLE * (j - 2) AS sx, {y1} + {dy} * (i / {n}.0::DOUBLE) + {ux}::DOUBLE * (j - 2) AS sy FROM range({n} + 1) t(i), range(5) u(j)), c AS (SELECT i, j, floor(sx)::INT + a AS x, floor(sy)::INT + b AS y, (CASE WHEN a = 1 THEN sx - floor(sx) ELSE floor(sx) + 1 - sx END) * (CASE WHEN b = 1 THEN sy - floor(sy) ELSE floor(sy) + 1 - sy END) AS k FROM s, range(2) p(a), range(2) q(b)), l AS (SELECT i, j, sum(v * k) AS v FROM c JOIN pix USING (y, x) WHERE k > 0 GROUP BY i, j HAVING sum(k) > 0.999999)"
BAND_SQL = BAND.format(x1=10, y1=20, dx=40, dy=30, n=50, ux=0.8, uy=0.6)
for red, agg, sem in (("mean", "avg(v)", "round(stddev_pop(v) / sqrt(count(*)), 5)"), ("sum", "sum(v)", "NULL::DOUBLE")):
    query(f"band_profile_{red}", lambda s, d, m=red: texture.band_profile(A.pix(s, d), 10.0, 20.0, 50.0, 50.0, 5, m), f", {BAND_SQL} SELECT i, i::DOUBLE AS distance, {r(agg, 'v')}, {sem} AS sem FROM l GROUP BY i", "pix")
query("polyline_profile", lambda s, d: texture.polyline_profile(A.pix(s, d), [(5.0, 5.0), (25.0, 5.0), (25.0, 17.0)]), f", p AS (SELECT 0 AS part, x - 5 AS i, (x - 5)::DOUBLE AS distance, v FROM pix WHERE y = 5 AND x BETWEEN 5 AND 25 UNION ALL SELECT 1, y - 5, 20.0::DOUBLE + y - 5, v FROM pix WHERE x = 25 AND y BETWEEN 6 AND 17) SELECT part, i, distance, {r('v')} FROM p", "pix")
query("montage", lambda s, d: texture.montage(A.pix(s, d).unionByName(A.pix_b(s, d)), 2, 4), f" SELECT y, x, {r('v')} FROM pix UNION ALL SELECT y, x + 100, round(v, 5) FROM pix_b", "pix", "pix_b")
AUTO = "e AS (SELECT min(v) AS lo, max(v) AS hi FROM pix), h AS (SELECT least(1023, floor((v - lo) / ((hi - lo) / 1024)))::INT AS bin, count(*) AS n FROM pix, e GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) / 6144.0::DOUBLE AS s FROM h)"
query("auto_window", lambda s, d: texture.auto_window(A.pix(s, d), 1024), f", {AUTO} SELECT {r('lo + ((SELECT min(bin) FROM c WHERE s >= 0.005) + 0.5::DOUBLE) * (hi - lo) / 1024', 'lo')}, {r('lo + ((SELECT min(bin) FROM c WHERE s >= 0.995) + 0.5::DOUBLE) * (hi - lo) / 1024', 'hi')} FROM e", "pix")
