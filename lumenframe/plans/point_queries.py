"""Queries of points, local equalisation, fits of populations and classifiers, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import adapters as A
from lumenframe.operators import learning, measure, points, spectral, texture
from lumenframe.plans.catalogue import FITS
from lumenframe.plans.registry import query, r, rounded

# Equalisation: tiles of 8 x 12 pixels, counts cut at floor(0.05 * 96 + 0.5) = 5
CLAHE = "e AS (SELECT min(v) AS lo, max(v) AS hi FROM pix), b AS (SELECT y, x, floor((v - lo) / (hi - lo) * 255 + 0.5::DOUBLE)::INT AS bin, (y - 1) // 8 AS i, (x - 1) // 12 AS j FROM pix, e), tl AS (SELECT i, j, bin, count(*) AS n FROM b GROUP BY i, j, bin), ex AS (SELECT i, j, sum(greatest(n - 5, 0)) AS excess FROM tl GROUP BY i, j), lut AS (SELECT i, j, k, (coalesce(sum(least(n, 5)) FILTER (bin <= k), 0) + (k + 1) * any_value(excess) / 256.0::DOUBLE) / 96 AS u FROM tl JOIN ex USING (i, j), range(256) q(k) GROUP BY i, j, k), wt AS (SELECT y, x, bin, p.i, q.j, greatest(0, 1 - abs(least(7, greatest(0, (y - 4.5::DOUBLE) / 8)) - p.i)) * greatest(0, 1 - abs(least(7, greatest(0, (x - 6.5::DOUBLE) / 12)) - q.j)) AS w FROM b, range(8) p(i), range(8) q(j))"

# Five classes: all choices in 64 bins, then those within 8 bins of these in 256
PARTS = "{h} AS MATERIALIZED (SELECT b, coalesce(n, 0) AS n FROM range({n}) q(b) LEFT JOIN (SELECT least({n} - 1, floor((v - lo) / ((hi - lo) / {n})))::INT AS b, count(*) AS n FROM pix, e GROUP BY 1) USING (b)), {h}c AS MATERIALIZED (SELECT b, (sum(n) OVER o)::DOUBLE AS w, (sum(n * b) OVER o)::DOUBLE AS m FROM {h} WINDOW o AS (ORDER BY b)), {h}f AS MATERIALIZED (SELECT i.b AS a, j.b AS b, CASE WHEN j.w > i.w THEN (j.m - i.m) ** 2 / (j.w - i.w) ELSE 0 END AS g FROM (SELECT * FROM {h}c UNION ALL SELECT -1, 0, 0) i, {h}c j WHERE j.b > i.b), {h}b AS MATERIALIZED (SELECT p.b AS b1, q.b AS b2, r.b AS b3, s.b AS b4 FROM {h}f p JOIN {h}f q ON q.a = p.b JOIN {h}f r ON r.a = q.b JOIN {h}f s ON s.a = r.b JOIN {h}f t ON t.a = s.b{near} WHERE p.a = -1 AND t.b = {n} - 1 ORDER BY round((p.g + q.g + r.g + s.g + t.g) / 6144, 9) DESC, 1, 2, 3, 4 LIMIT 1)"
NEAR = " JOIN hb ON " + " AND ".join(f"{t}.b BETWEEN greatest(0, round_even((hb.b{i} + 0.5) * 4, 0) - 8) AND least({251 + i}, round_even((hb.b{i} + 0.5) * 4, 0) + 8)" for i, t in enumerate("pqrs", 1))
OTSU5 = f"e AS (SELECT min(v) AS lo, max(v) AS hi FROM pix), {PARTS.format(h='h', n=64, near='')}, {PARTS.format(h='x', n=256, near=NEAR)}"
query("multi_otsu5", lambda s, d: texture.multi_otsu(A.pix(s, d), 5), f", {OTSU5} SELECT " + ", ".join(r(f"lo + (b{i} + 1) * (hi - lo) / 256", f"t{i}") for i in range(1, 5)) + " FROM xb, e", "pix")

# Maxima that keep apart: one by one from the strongest, the kept ones in a list
KERNEL = "k AS (SELECT o, exp(-o * o / {s2}::DOUBLE) / (SELECT sum(exp(-p * p / {s2}::DOUBLE)) FROM range(-{n}, {n} + 1) t(p)) AS k FROM range(-{n}, {n} + 1) u(o))"
REPLICATE = "gy AS (SELECT p.y, p.x, sum(q.v * k) AS v FROM pix p, k, pix q WHERE q.x = p.x AND q.y = greatest(1, least(64, p.y + o)) GROUP BY p.y, p.x), g AS MATERIALIZED (SELECT p.y, p.x, sum(q.v * k) AS v FROM gy p, k, gy q WHERE q.y = p.y AND q.x = greatest(1, least(96, p.x + o)) GROUP BY p.y, p.x)"
ZEROS = "gy AS (SELECT p.y, p.x, sum(q.v * k) AS v FROM pix p, k, pix q WHERE q.x = p.x AND q.y = p.y + o GROUP BY p.y, p.x), g AS MATERIALIZED (SELECT p.y, p.x, sum(q.v * k) AS v FROM gy p, k, gy q WHERE q.y = p.y AND q.x = p.x + o GROUP BY p.y, p.x)"
MAXIMA = "mx AS (SELECT a.y, a.x, a.v FROM g a, range(-1, 2) p(dy), range(-1, 2) q(dx), g b WHERE b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.y, a.x, a.v HAVING a.v >= max(b.v)), cd AS MATERIALIZED (SELECT y, x, v, row_number() OVER (ORDER BY v DESC, {order}) AS i FROM mx, (SELECT min(v) AS lo, max(v) AS hi FROM g) WHERE {ok}), go AS (SELECT 0::BIGINT AS i, []::STRUCT(y BIGINT, x BIGINT, v DOUBLE)[] AS kept UNION ALL SELECT c.i, CASE WHEN len([m FOR m IN kept IF (m.y - c.y) ** 2 + (m.x - c.x) ** 2 < {d2}]) > 0 THEN kept ELSE list_append(kept, struct_pack(y := c.y::BIGINT, x := c.x::BIGINT, v := c.v::DOUBLE)) END FROM go JOIN cd c ON c.i = go.i + 1), en AS (SELECT unnest(kept) AS m FROM go WHERE i = (SELECT max(i) FROM go))"


def _apart(smooth: str, order: str, ok: str, d2: int, s2: float, n: int) -> str:
    body = f", {KERNEL.format(s2=s2, n=n)}, {smooth}, {MAXIMA.format(order=order, ok=ok, d2=d2)} SELECT m.y::INT AS y, m.x::INT AS x, {r('m.v', 'v')}, (row_number() OVER (ORDER BY m.v DESC, {', '.join('m.' + c for c in order.split(', '))}))::INT AS rank FROM en"
    return A.with_views(body, "pix").replace("WITH ", "WITH RECURSIVE ", 1)


query("detect_columns", lambda s, d: points.detect_columns(A.pix(s, d), 1.0, 0.2, 5.0), _apart(REPLICATE, "x, y", "v >= lo + 0.2::DOUBLE * (hi - lo)", 25, 2.0, 3))
query("find_spots", lambda s, d: points.find_spots(A.pix(s, d), 10.0, 0.05, 8.0, 10000), _apart(ZEROS, "y, x", "v >= 0.05::DOUBLE * hi AND sqrt((y - 33) ** 2 + (x - 49) ** 2) >= 10", 64, 4.5, 5))
RAYS = "ra AS (SELECT ray, 5.0::DOUBLE + step AS radius, 32 + (5.0::DOUBLE + step) * sin(ray * (2 * pi() / 37)) AS py, 48 + (5.0::DOUBLE + step) * cos(ray * (2 * pi() / 37)) AS px FROM range(37) a(ray), range(25) b(step)), be AS (SELECT ray, radius, py + 1 AS py, px + 1 AS px FROM ra JOIN pix p ON p.y = round_even(py, 0) + 1 AND p.x = round_even(px, 0) + 1 QUALIFY row_number() OVER (PARTITION BY ray ORDER BY v DESC, radius) = 1)"
query("ring_points", lambda s, d: points.ring_points(A.pix(s, d), n_angles=37), f", {RAYS} SELECT ray::INT AS ray, {r('py', 'y')}, {r('px', 'x')}, {r('radius')} FROM be", "pix")
query("undistorted_radii", lambda s, d: points.ring_points(A.pix(s, d), n_angles=37).select("ray", points.undistorted(F.col("y"), F.col("x"), 33.5, 48.5, 18.0, 15.0, 0.3).alias("radius")).withColumn("constant", points.camera_constant(F.lit(2.35), F.col("radius"))), f", {RAYS}, un AS (SELECT ray, py - 33.5::DOUBLE AS dy, px - 48.5::DOUBLE AS dx FROM be), ph AS (SELECT ray, sqrt(dy * dy + dx * dx) * sqrt(270.0::DOUBLE) * sqrt((15 * cos(atan2(dy, dx) - 0.3::DOUBLE)) ** 2 + (18 * sin(atan2(dy, dx) - 0.3::DOUBLE)) ** 2) / 270 AS radius FROM un) SELECT ray::INT AS ray, {r('radius')}, {r('2.35::DOUBLE * radius', 'constant')} FROM ph", "pix")
COLOURS = [("Si", 0.0, 9000.0, 255.0, 40.0, 0.0), ("O", 500.0, 4000.0, 0.0, 90.0, 255.0)]
CO = "co(symbol, lo, hi, r, g, b) AS (VALUES ('Si', 0.0::DOUBLE, 9000.0::DOUBLE, 255, 40, 0), ('O', 500.0::DOUBLE, 4000.0::DOUBLE, 0, 90, 255)), ln(symbol, c) AS (VALUES ('Si', 1.74::DOUBLE), ('O', 0.525::DOUBLE)), mp AS (SELECT y, x, symbol, sum(v) AS v FROM cube JOIN ln ON abs(e - c) <= 0.2 GROUP BY y, x, symbol), pt AS (SELECT y, x, least(1, greatest(0, (v - lo) / (hi - lo))) AS t, r, g, b FROM mp JOIN co USING (symbol))"
for blend in ("sum", "max"):
    query(f"colour_composite_{blend}", lambda s, d, b=blend: points.colour_composite(spectral.element_maps(A.cube(s, d), ["Si", "O"], 0.2), s.createDataFrame(COLOURS, "symbol string, lo double, hi double, r double, g double, b double"), b == "sum"), f", {CO} SELECT y, x, " + ", ".join(f"round_even(least(255, {blend}(t * {c})), 0)::DOUBLE + 0.0 AS {c}" for c in "rgb") + " FROM pt GROUP BY y, x", "cube")

# Populations
STEPS = 10
WEIBULL = "lt AS MATERIALIZED (SELECT grp, ln(v) AS t FROM populations WHERE v > 0), ms AS (SELECT grp, count(*) AS n, avg(t) AS m, pi() / sqrt(6) / stddev_pop(t) AS k0 FROM lt GROUP BY grp), zt AS MATERIALIZED (SELECT grp, t - m AS z FROM lt JOIN ms USING (grp)), k0 AS (SELECT grp, k0 AS k FROM ms)" + "".join(
    f", s{i} AS MATERIALIZED (SELECT grp, k, sum(exp(k * z)) AS a, sum(z * exp(k * z)) AS b, sum(z * z * exp(k * z)) AS c FROM zt JOIN k{i} USING (grp) GROUP BY grp, k), k{i + 1} AS MATERIALIZED (SELECT grp, greatest(k / 2, k - (b / a - 1 / k) / (c / a - (b / a) ** 2 + 1 / k ** 2)) AS k FROM s{i})" for i in range(STEPS)
) + f", we AS (SELECT grp, any_value(n) AS n, k AS shape, exp(any_value(m)) * avg(exp(k * z)) ** (1 / k) AS scale, any_value(m) AS m FROM zt JOIN k{STEPS} USING (grp) JOIN ms USING (grp) GROUP BY grp, k), wf AS (SELECT grp, 'weibull' AS kind, n, 0.0::DOUBLE AS loc, scale, shape, n * (ln(shape) - shape * ln(scale) + (shape - 1) * m - 1) AS l FROM we)"
query("weibull_fits", lambda s, d: rounded(measure.fit_weibull(A.populations(s, d)), 3), f", {WEIBULL} SELECT grp, kind, n, round(shape, 3) + 0.0 AS shape, round(scale, 3) + 0.0 AS scale, round(l, 3) + 0.0 AS loglik, round(4 - 2 * l, 3) + 0.0 AS aic FROM wf", "populations")
U = "(1 / (1 + 0.3275911::DOUBLE * abs(q) / sqrt(2)))"
TAIL = f"({U} * (0.254829592::DOUBLE + {U} * (-0.284496736::DOUBLE + {U} * (1.421413741::DOUBLE + {U} * (-1.453152027::DOUBLE + {U} * 1.061405429::DOUBLE)))) * exp(-q * q / 2) / 2)"
ALL = f"af AS (SELECT grp, kind, n, loc, scale, NULL::DOUBLE AS shape, l FROM g UNION ALL SELECT * FROM wf), rk AS (SELECT grp, kind, v, rank() OVER w AS below, count(*) OVER (PARTITION BY grp, kind) AS size, row_number() OVER w AS upto, CASE kind WHEN 'normal' THEN (v - loc) / scale WHEN 'lognormal' THEN (ln(v) - loc) / scale END AS q, 1 - exp(-((v / scale) ** shape)) AS wc FROM populations JOIN af USING (grp) WINDOW w AS (PARTITION BY grp, kind ORDER BY v)), ks AS (SELECT grp, kind, max(greatest(upto / size::DOUBLE - c, c - (below - 1) / size::DOUBLE)) AS ks FROM (SELECT *, CASE WHEN kind = 'weibull' THEN wc WHEN q < 0 THEN {TAIL} ELSE 1 - {TAIL} END AS c FROM rk) GROUP BY grp, kind)"
query("distribution_choice", lambda s, d: rounded(measure.fit_all(A.populations(s, d)).select("grp", "kind", "ks", "best"), 4), f", {FITS}, {WEIBULL}, {ALL} SELECT grp, kind, round(ks, 4) + 0.0 AS ks, row_number() OVER (PARTITION BY grp ORDER BY l DESC, kind) = 1 AS best FROM af JOIN ks USING (grp, kind)", "populations")

# Classifiers
WIDTH, GD = 4, 3
ROWS = lambda s, d: A.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), F.transform("embedding", lambda v: v.cast("double")).alias("features"))
SOFTMAX = f"ft AS MATERIALIZED (SELECT vec_id AS id, label, f, embedding[f]::DOUBLE AS v FROM embeddings, range(1, {WIDTH + 1}) q(f) WHERE embedding IS NOT NULL), st AS MATERIALIZED (SELECT f, avg(v) AS m, stddev_samp(v) AS s FROM ft WHERE label IS NOT NULL GROUP BY f), z AS MATERIALIZED (SELECT id, label, f, (v - m) / s AS v FROM ft JOIN st USING (f) UNION ALL SELECT DISTINCT id, label, 0, 1.0::DOUBLE FROM ft), cl AS (SELECT DISTINCT label AS c FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), w0 AS (SELECT c, f, 0.0::DOUBLE AS w FROM cl, range({WIDTH + 1}) q(f))" + "".join(
    f", p{i} AS MATERIALIZED (SELECT id, label, c, e / sum(e) OVER (PARTITION BY id) AS p FROM (SELECT id, any_value(label) AS label, c, exp(sum(v * w)) AS e FROM z JOIN w{i} USING (f) GROUP BY id, c))" + (f", w{i + 1} AS MATERIALIZED (SELECT w.c, w.f, any_value(w.w) - 0.5::DOUBLE * (avg((p.p - (p.label = w.c)::INT) * z.v) + CASE WHEN w.f > 0 THEN 0.001::DOUBLE * any_value(w.w) ELSE 0 END) AS w FROM w{i} w JOIN p{i} p ON p.c = w.c AND p.label IS NOT NULL JOIN z ON z.id = p.id AND z.f = w.f GROUP BY w.c, w.f)" if i < GD else "") for i in range(GD + 1)
)


def _softmax(s, d):
    model = learning.softmax_train(ROWS(s, d), WIDTH, steps=GD)
    t = learning.softmax_predict(ROWS(s, d).where("features is not null"), model)
    return t.select("id", "predicted", F.array_max("shares").alias("share"))


query("softmax_labels", _softmax, f"WITH {SOFTMAX} SELECT id, arg_max(c, (round(p, 12), -c)) AS predicted, {r('max(p)', 'share')} FROM p{GD} GROUP BY id")
# Three small trees: tree, node, feature, threshold, left, right, shares of two classes
NODES = [
    (0, 0, 0, 0.0, 1, 2, [0.5, 0.5]), (0, 1, -1, 0.0, -1, -1, [0.9, 0.1]), (0, 2, 3, 0.05, 3, 4, [0.3, 0.7]), (0, 3, -1, 0.0, -1, -1, [0.6, 0.4]), (0, 4, -1, 0.0, -1, -1, [0.05, 0.95]),
    (1, 0, 1, -0.02, 1, 2, [0.5, 0.5]), (1, 1, -1, 0.0, -1, -1, [0.2, 0.8]), (1, 2, -1, 0.0, -1, -1, [0.65, 0.35]),
    (2, 0, -1, 0.0, -1, -1, [0.45, 0.55]),
]
TREES = "tr AS (SELECT vec_id AS id, CASE WHEN embedding[1]::DOUBLE <= 0 THEN 0.9::DOUBLE WHEN embedding[4]::DOUBLE <= 0.05::DOUBLE THEN 0.6::DOUBLE ELSE 0.05::DOUBLE END AS a, CASE WHEN embedding[2]::DOUBLE <= -0.02::DOUBLE THEN 0.2::DOUBLE ELSE 0.65::DOUBLE END AS b, 0.45::DOUBLE AS c FROM embeddings WHERE embedding IS NOT NULL)"
FOREST = lambda s, d: learning.forest_predict(ROWS(s, d).where("features is not null"), s.createDataFrame(NODES, "tree int, node int, feature int, threshold double, left int, right int, shares array<double>"), [3, 7], depth=3)
query("forest_labels", lambda s, d: FOREST(s, d).select("id", F.col("shares")[0].alias("share"), "predicted"), f"WITH {TREES} SELECT id, {r('(a + b + c) / 3', 'share')}, CASE WHEN a + b + c >= 1.5::DOUBLE THEN 3 ELSE 7 END AS predicted FROM tr")
PAIRS = lambda s, d: A.table(s, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("actual"), (F.col("l_quantity") * 1500).cast("double").alias("predicted"))
query("r_squared", lambda s, d: measure.r_squared(PAIRS(s, d), "l_returnflag"), f"WITH p AS (SELECT l_returnflag, l_extendedprice::DOUBLE AS a, (l_quantity * 1500)::DOUBLE AS p FROM lineitem) SELECT l_returnflag, {r('1 - sum((a - p) ** 2) / (var_pop(a) * count(*))', 'r2')} FROM p GROUP BY l_returnflag")
