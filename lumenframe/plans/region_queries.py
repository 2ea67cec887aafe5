"""Queries of connected regions, clusters, decompositions and trained trees, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe import adapters as A
from lumenframe.operators import clusters, forest, graph, particles, regions, texture
from lumenframe.plans.registry import query, r

N8 = "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) d(dy, dx)"
N4 = "(VALUES (-1, 0), (0, -1), (0, 1), (1, 0)) d(dy, dx)"


def regions_sql(mask: str, near: str = N8, same: str = "", keep: str = "") -> str:
    """Common tables ro(y, x, r): each pixel of `mask` with the first pixel of its region in reading order; keep: columns to agree in."""
    extra = f", {keep}" if keep else ""
    return f"m AS MATERIALIZED (SELECT y, x{extra} FROM {mask}), ro(y, x, r{extra}) USING KEY (y, x) AS (SELECT y, x, (y * 100000 + x)::BIGINT{extra} FROM m UNION ALL SELECT p.y, p.x, min(w.r){', ' + ', '.join('any_value(p.' + c + ')' for c in keep.split(', ')) if keep else ''} FROM ro w, {near}, recurring.ro p WHERE p.y = w.y + dy AND p.x = w.x + dx AND w.r < p.r{same} GROUP BY p.y, p.x)"


def recursive(body: str, *views: str) -> str:
    return A.with_views(body, *views).replace("WITH ", "WITH RECURSIVE ", 1)


OVER = lambda s, d: A.field(s, d).withColumn("v", (F.col("v") > 120000).cast("double"))
for name, near, c in (("label_components", N8, 8), ("label_components_4", N4, 4)):
    query(name, lambda s, d, c=c: graph.label_components(OVER(s, d), c), recursive(f", {regions_sql('field WHERE v > 120000', near)}, nu AS (SELECT r, row_number() OVER (ORDER BY r) AS label FROM (SELECT DISTINCT r FROM ro)) SELECT f.y, f.x, coalesce(label, 0)::INT AS label FROM field f LEFT JOIN ro ON ro.y = f.y AND ro.x = f.x LEFT JOIN nu ON nu.r = ro.r", "field"))
BIG = ", nu AS (SELECT r, row_number() OVER (ORDER BY r) AS label FROM ro GROUP BY r HAVING count(*) >= 3)"
query("label_components_large", lambda s, d: graph.label_components(OVER(s, d), 4, 3).where("label > 0").groupBy("ds_id", "label").agg(F.count("*").alias("area")), recursive(f", {regions_sql('field WHERE v > 120000', N4)}{BIG} SELECT label::INT AS label, count(*) AS area FROM ro JOIN nu USING (r) GROUP BY label", "field"))
WAS = "region_labels WHERE label > 0"
PIECES = f"{regions_sql(WAS, N8, ' AND w.label = p.label', 'label')}, nu AS (SELECT r, row_number() OVER (ORDER BY any_value(label), r) AS n FROM ro GROUP BY r)"
query("connected_labels", lambda s, d: graph.connected_labels(A.region_labels(s, d), connectivity=8), recursive(f", {PIECES} SELECT l.y, l.x, coalesce(n, 0)::INT AS label FROM region_labels l LEFT JOIN ro ON ro.y = l.y AND ro.x = l.x LEFT JOIN nu ON nu.r = ro.r", "region_labels"))
TWO = "e AS (SELECT min(v) AS lo, max(v) AS hi FROM field), h AS (SELECT b AS bin, count(v) AS n FROM range(256) s(b) CROSS JOIN e LEFT JOIN field ON least(255, floor((v - lo) / ((hi - lo) / 256)))::INT = b GROUP BY b), c AS (SELECT bin, (sum(n) OVER a)::DOUBLE AS w, (sum(n * bin) OVER a)::DOUBLE AS m FROM h WINDOW a AS (ORDER BY bin)), z AS (SELECT * FROM c WHERE bin = 255), th AS (SELECT lo + (b + 1) * (hi - lo) / 256 AS t FROM e, (SELECT p.bin AS b FROM c p, z WHERE p.bin < 255 ORDER BY round((coalesce(p.m ** 2 / nullif(p.w, 0), 0) + coalesce((z.m - p.m) ** 2 / nullif(z.w - p.w, 0), 0)) / z.w, 9) DESC, p.bin LIMIT 1))"
PART = f"{TWO}, mk AS MATERIALIZED (SELECT y, x, v FROM field, th WHERE v >= t), {regions_sql('mk', N8)}, ps AS (SELECT r, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, avg(v) AS mean FROM ro JOIN mk USING (y, x) GROUP BY r)"
query("particle_analysis", lambda s, d: particles.particle_analysis(A.field(s, d), min_area=2).select("ds_id", "id", "area", "cy", "cx", "y0", "x0", "y1", "x1", "mean", "diameter"), recursive(f", {PART} SELECT (row_number() OVER (ORDER BY r))::INT AS id, area, {r('cy')}, {r('cx')}, y0, x0, y1, x1, {r('mean')}, {r('sqrt(4 * area / pi())', 'diameter')} FROM ps WHERE area >= 2", "field"))
UNLIKE = "(SELECT DISTINCT a.y, a.x FROM region_labels a, " + N4 + ", region_labels b WHERE b.y = a.y + dy AND b.x = a.x + dx AND a.label > 0 AND b.label > 0 AND a.label <> b.label)"
query("boundary_segments", lambda s, d: particles.boundary_segments(A.region_labels(s, d)), recursive(f", {regions_sql(UNLIKE, N8)} SELECT count(DISTINCT r) AS segments FROM ro", "region_labels"))
query("particle_shapes", lambda s, d: regions.shape_moments(graph.label_components(OVER(s, d), 8, 4)).select("label", "area", "major", "minor"), recursive(f", {regions_sql('field WHERE v > 120000', N8)}, nu AS (SELECT r, (row_number() OVER (ORDER BY r))::INT AS label FROM ro GROUP BY r HAVING count(*) >= 4), g AS (SELECT label, count(*) AS area, var_pop(ro.y) AS vy, var_pop(ro.x) AS vx, covar_pop(ro.y, ro.x) AS c FROM ro JOIN nu USING (r) GROUP BY label), q AS (SELECT *, (vy + vx) / 2 AS mid, sqrt(((vy - vx) / 2) ** 2 + c * c) AS half FROM g) SELECT label, area, {r('4 * sqrt(mid + half)', 'major')}, {r('4 * sqrt(greatest(0, mid - half))', 'minor')} FROM q", "field"))
query("class_regions", lambda s, d: graph.connected_labels(texture.classify(A.pix(s, d), texture.multi_otsu(A.pix(s, d), 2)), connectivity=4).groupBy("ds_id", "label").agg(F.count("*").alias("area")), recursive(f", {TWO.replace('field', 'pix')}, cl AS MATERIALIZED (SELECT y, x, (1 + (v > t)::INT)::INT AS k FROM pix, th), {regions_sql('cl', N4, ' AND w.k = p.k', 'k')}, nu AS (SELECT r, (row_number() OVER (ORDER BY any_value(k), r))::INT AS label, count(*) AS area FROM ro GROUP BY r) SELECT label, area FROM nu", "pix"))

# Clusters: three Lloyd steps from the first vectors
K, WIDE, LLOYD = 4, 4, 3
VECTORS = lambda s, d: A.table(s, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.slice(F.transform("embedding", lambda v: v.cast("double")), 1, WIDE).alias("features"))
FEATURES = f"ft AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding[1:{WIDE}], lambda v: v::DOUBLE) AS f FROM embeddings WHERE embedding IS NOT NULL)"


def lloyd_sql(starts: str, rows: str = "ft", steps: int = LLOYD) -> str:
    """Common tables k0 to k<steps> (c, f) of centres and nr (id, c, d2) of rows with the nearest."""
    near = "SELECT id, any_value(x.f) AS f, arg_min(c, (d2, c)) AS c, min(d2) AS d2 FROM (SELECT r.id, r.f, k.c, list_sum(list_transform(list_zip(r.f, k.f), lambda z: (z[1] - z[2]) ** 2)) AS d2 FROM {rows} r, {k} k) x GROUP BY id"
    out = [f"k0 AS ({starts})"]
    for i in range(steps):
        out.append(f"n{i} AS MATERIALIZED ({near.format(rows=rows, k=f'k{i}')})")
        out.append(f"k{i + 1} AS MATERIALIZED (SELECT c, [{', '.join(f'avg(f[{j}])' for j in range(1, WIDE + 1))}] AS f FROM n{i} GROUP BY c)")
    return ", ".join([*out, f"nr AS MATERIALIZED ({near.format(rows=rows, k=f'k{steps}')})"])


def _starts(s, d):
    got = VECTORS(s, d).orderBy("id").limit(K).collect()
    return [list(row["features"]) for row in got]


FIRST = f"SELECT (row_number() OVER (ORDER BY id))::INT AS c, f FROM ft ORDER BY id LIMIT {K}"


def _kmeans(s, d):
    rows = VECTORS(s, d)
    found = clusters.kmeans(rows, K, steps=LLOYD, tolerance=0.0, starts=_starts(s, d))
    return clusters.cluster_of(rows, found).select("id", "cluster", "distance")


query("kmeans", _kmeans, f"WITH {FEATURES}, {lloyd_sql(FIRST)} SELECT id, c AS cluster, {r('sqrt(d2)', 'distance')} FROM nr")


def _inertia(s, d):
    """Ten steps from k-means++ starts leave less than the variation around the mean."""
    rows = VECTORS(s, d)
    found = clusters.kmeans(rows, K, steps=10, seed=1)
    total = rows.agg(*[(F.var_pop(F.col("features")[i]) * F.count("*")).alias(f"v{i}") for i in range(WIDE)])
    return total.select((F.lit(found.inertia) < sum((F.col(f"v{i}") for i in range(WIDE)), F.lit(0.0))).alias("less"), F.lit(len(found.centres)).alias("clusters"))


query("kmeans_plus_plus", _inertia, f"SELECT true AS less, {K} AS clusters FROM embeddings LIMIT 1")
# Decomposition: sums over all components against traces of powers of the Gram matrix
GRAM = "px AS (SELECT vec_id, ch, floor((embedding[ch + 1]::DOUBLE + 1) * 1000)::DOUBLE AS v FROM embeddings, range(64) q(ch)), ce AS MATERIALIZED (SELECT vec_id, ch, v - avg(v) OVER (PARTITION BY ch) AS v FROM px), gm AS MATERIALIZED (SELECT a.ch AS i, b.ch AS j, sum(a.v * b.v) AS g FROM ce a JOIN ce b USING (vec_id) GROUP BY a.ch, b.ch), g2 AS MATERIALIZED (SELECT a.i, b.j, sum(a.g * b.g) AS g FROM gm a JOIN gm b ON a.j = b.i GROUP BY a.i, b.j), tr AS (SELECT sum(g) FILTER (i = j) AS t FROM gm)"


def _shares(s, d):
    found = clusters.decompose(A.cube(s, d), 64)
    at = s.createDataFrame([(p / 100,) for p in found.shares], "p double")
    return at.agg(F.count("*").alias("components"), F.sum("p").alias("share"), (F.sum(F.col("p") * F.col("p")) * 1000).alias("square"), (F.sum(F.col("p") * F.col("p") * F.col("p")) * 1000000).alias("cube"), F.lit(1.0).alias("first") if not found.shares else F.lit(found.shares == sorted(found.shares, reverse=True)).cast("double").alias("first"))


query("spectral_components", _shares, f"WITH {GRAM} SELECT 64::BIGINT AS components, 1.0::DOUBLE AS share, round(1000 * (SELECT sum(g * g) FROM gm) / t ** 2, 5) AS square, round(1000000 * (SELECT sum(a.g * b.g) FROM g2 a JOIN gm b ON a.i = b.j AND a.j = b.i) / t ** 3, 5) AS \"cube\", 1.0::DOUBLE AS first FROM tr")
query("component_scores", lambda s, d: clusters.projections(A.cube(s, d), clusters.decompose(A.cube(s, d), 64)).groupBy("ds_id", "y", "x").agg(F.sum(F.col("v") * F.col("v")).alias("v")), f"WITH {GRAM} SELECT 1 + vec_id // 25 AS y, 1 + vec_id % 25 AS x, {r('sum(v * v)', 'v')} FROM ce GROUP BY vec_id")
# Sublattices: the vectors' first two values, standardised, Lloyd steps from both signs
query("sublattices", lambda s, d: clusters.sublattices(VECTORS(s, d), 2, starts=[[1.0] * WIDE, [-1.0] * WIDE], steps=LLOYD, tolerance=0.0).groupBy("sublattice").agg(F.count("*").alias("n"), F.avg(F.col("features")[0]).alias("level")), f"WITH {FEATURES}, ms AS (SELECT {', '.join(f'avg(f[{j}]) AS m{j}, stddev_samp(f[{j}]) AS s{j}' for j in range(1, WIDE + 1))} FROM ft), zt AS MATERIALIZED (SELECT id, [{', '.join(f'(f[{j}] - m{j}) / s{j}' for j in range(1, WIDE + 1))}] AS f FROM ft, ms), {lloyd_sql('SELECT * FROM (VALUES (1, ' + str([1.0] * WIDE) + '::DOUBLE[]), (2, ' + str([-1.0] * WIDE) + '::DOUBLE[])) v(c, f)', 'zt')}, lv AS (SELECT c, count(*) AS n, avg(ft.f[1]) AS level FROM nr JOIN ft USING (id) GROUP BY c) SELECT (row_number() OVER (ORDER BY level DESC))::INT AS sublattice, n, {r('level')} FROM lv")
# One tree of two levels over all rows, cut at even steps
EDGES = [[float(v) for v in range(5, 50, 5)], [float(v) for v in range(4, 49, 4)]]
PARTS = lambda s, d: A.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")).alias("features"), (F.col("p_size") + F.col("p_partkey") % 50 > 50).cast("int").alias("label"))
CUT = "SELECT {keep}f, e, nl, sl, nr, sr FROM (SELECT {keep}f, e, count(*) FILTER (v <= e) AS nl, sum(y) FILTER (v <= e) AS sl, count(*) FILTER (v > e) AS nr, sum(y) FILTER (v > e) AS sr FROM {rows} JOIN ed USING (f) GROUP BY {keep}f, e) WHERE nl >= 5 AND nr >= 5 QUALIFY row_number() OVER ({part}ORDER BY round((sl ** 2 + (nl - sl) ** 2) / nl::DOUBLE + (sr ** 2 + (nr - sr) ** 2) / nr::DOUBLE, 9) DESC, f, e) = 1"
TREE = f"pt AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, (p_partkey % 50)::DOUBLE AS b, (p_size + p_partkey % 50 > 50)::INT AS y FROM part), l AS (SELECT id, y, 0 AS f, a AS v FROM pt UNION ALL SELECT id, y, 1, b FROM pt), ed AS (SELECT 0 AS f, unnest({EDGES[0]})::DOUBLE AS e UNION ALL SELECT 1, unnest({EDGES[1]})::DOUBLE), c0 AS MATERIALIZED ({CUT.format(keep='', rows='l', part='')}), s1 AS MATERIALIZED (SELECT l.*, CASE WHEN (CASE c0.f WHEN 0 THEN a ELSE b END) <= c0.e THEN 1 ELSE 2 END AS node FROM l JOIN pt USING (id), c0), c1 AS MATERIALIZED ({CUT.format(keep='node, ', rows='s1', part='PARTITION BY node ')})"


def _tree(s, d):
    nodes, _ = forest.forest_train(PARTS(s, d), 2, n_trees=1, max_depth=2, min_leaf=5, max_features=2, bootstrap=False, edges=EDGES)
    return nodes.where("node <= 2").select("node", "feature", "threshold", F.col("shares")[1].alias("share"))


query("forest_train", _tree, f"WITH {TREE}, rt AS (SELECT 0 AS node, f, e, (SELECT avg(y) FROM pt) AS share FROM c0 UNION ALL SELECT node, c1.f, c1.e, (SELECT avg(y) FROM s1 WHERE s1.node = c1.node) FROM c1) SELECT node, f AS feature, e AS threshold, {r('share')} FROM rt")


def _forest_beats(s, d):
    """Held-out parts: trees against the commonest label."""
    from lumenframe.operators.learning import forest_predict

    held = F.col("id") % 3 == 0
    nodes, classes = forest.forest_train(PARTS(s, d).where(~held), 2, n_trees=8, max_depth=5, min_leaf=2, max_features=1)
    got = forest_predict(PARTS(s, d).where(held), nodes, classes, depth=5).join(PARTS(s, d).select("id", "label"), "id")
    return got.agg((F.avg((F.col("predicted") == F.col("label")).cast("double")) > F.greatest(F.avg("label"), 1 - F.avg("label"))).alias("better"), F.count("*").alias("held_out"))


query("forest_held_out", _forest_beats, "SELECT true AS better, count(*) AS held_out FROM part WHERE p_partkey % 3 = 0")
