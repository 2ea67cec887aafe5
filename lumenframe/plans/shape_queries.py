"""Queries of outlines, hulls and fits, each with the SQL that states its result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenframe import adapters as A
from lumenframe.operators import fits, outlines, quantify
from lumenframe.operators.outlines import JOINED, SIDES
from lumenframe.plans.analysis_queries import SUM, values
from lumenframe.plans.region_queries import recursive
from lumenframe.plans.registry import query, r

# Contours of the labelled regions
WAYS = values("wy(k, dy0, dx0, dy1, dx1)", [(k, *SIDES[w[0]], *SIDES[w[1]]) for k, ways in JOINED.items() for w in ways.split()])
STEPS = f"{WAYS}, cl AS (SELECT label, y - dy AS cy, x - dx AS cx, sum(bit)::INT AS k FROM region_labels, (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)) b(dy, dx, bit) WHERE label > 0 GROUP BY ALL), sp AS MATERIALIZED (SELECT label, (2 * cy + dy0)::BIGINT * 4294967296 + 2 * cx + dx0 AS u, (2 * cy + dy1)::BIGINT * 4294967296 + 2 * cx + dx1 AS v, cy + dy0 / 2.0::DOUBLE AS y0, cx + dx0 / 2.0::DOUBLE AS x0, cy + dy1 / 2.0::DOUBLE AS y1, cx + dx1 / 2.0::DOUBLE AS x1 FROM cl JOIN wy USING (k)), nx AS MATERIALIZED (SELECT label, u AS a, v AS b FROM sp UNION ALL SELECT label, v, u FROM sp), rt(label, p, r) USING KEY (label, p) AS (SELECT label, u, u FROM sp UNION ALL SELECT o.label, o.p, min(w.r) FROM rt w JOIN nx ON nx.label = w.label AND nx.a = w.p JOIN recurring.rt o ON o.label = nx.label AND o.p = nx.b WHERE w.r < o.r GROUP BY o.label, o.p), rg AS MATERIALIZED (SELECT sp.*, r AS ring FROM sp JOIN rt ON rt.label = sp.label AND rt.p = sp.u)"
AREAS = "ar AS (SELECT label, ring, count(*) AS points, sum(x0 * y1 - x1 * y0) / 2 AS area, sum(sqrt((y1 - y0) ** 2 + (x1 - x0) ** 2)) AS length, sum((y0 + y1) * (x0 * y1 - x1 * y0)) / 6 AS my, sum((x0 + x1) * (x0 * y1 - x1 * y0)) / 6 AS mx FROM rg GROUP BY label, ring)"
RINGS = lambda s, d: outlines.contour_rings(A.region_labels(s, d))
query("contour_rings", lambda s, d: outlines.ring_areas(RINGS(s, d)).select("label", "ring", "points", "area", "length", "cy", "cx"), recursive(f", {STEPS}, {AREAS} SELECT label, ring, points, {r('area')}, {r('length')}, {r('my / area', 'cy')}, {r('mx / area', 'cx')} FROM ar", "region_labels"))
query("outlines", lambda s, d: outlines.outlines(A.region_labels(s, d)), recursive(f", {STEPS}, {AREAS} SELECT label, count(*) FILTER (area > 0) AS outer, count(*) FILTER (area <= 0) AS holes, {r('sum(area)', 'net')}, {r('sum(length) FILTER (area > 0)', 'outer_length')}, {r('sum(my) / sum(area)', 'cy')}, {r('sum(mx) / sum(area)', 'cx')} FROM ar GROUP BY label", "region_labels"))
query("ordered_rings", lambda s, d: outlines.ordered_rings(RINGS(s, d)), recursive(f", {STEPS}, wk(label, ring, i, u, y, x, v) AS (SELECT label, ring, 0::BIGINT, u, y0, x0, v FROM rg WHERE u = ring UNION ALL SELECT rg.label, rg.ring, i + 1, rg.u, rg.y0, rg.x0, rg.v FROM wk JOIN rg ON rg.label = wk.label AND rg.u = wk.v WHERE rg.u <> rg.ring) SELECT label, ring, i, y, x FROM wk", "region_labels"))
# Perimeters, hulls
CROSS = "ps AS (SELECT label, y, x FROM region_labels WHERE label > 0), en AS (SELECT p.label, dy, dx, count(*) AS n FROM ps p, (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) d(dy, dx) WHERE NOT EXISTS (SELECT 1 FROM ps q WHERE q.label = p.label AND q.y = p.y - dy AND q.x = p.x - dx) GROUP BY ALL), pe AS (SELECT label, pi() / 4 * sum(n * CASE WHEN dy = 0 OR dx = 0 THEN 1 ELSE 1 / sqrt(2) END) AS perimeter FROM en GROUP BY label), ac AS (SELECT label, count(*) AS area FROM ps GROUP BY label)"
ENDS = "UNION ALL ".join(f"SELECT label, {y} AS y, {x} AS x FROM {{t}} " for y, x in (("y::DOUBLE", "a - 0.5::DOUBLE"), ("y::DOUBLE", "b + 0.5::DOUBLE"), ("y - 0.5::DOUBLE", "a::DOUBLE"), ("y + 0.5::DOUBLE", "a::DOUBLE"), ("y - 0.5::DOUBLE", "b::DOUBLE"), ("y + 0.5::DOUBLE", "b::DOUBLE")))
HULLS = f"re AS (SELECT label, y, min(x) AS a, max(x) AS b FROM ps GROUP BY label, y), pt AS MATERIALIZED ({ENDS.format(t='re')}), yr AS (SELECT label, unnest(range(min(y), max(y) + 1)) AS y FROM re GROUP BY label), sd AS (SELECT r.label, r.y, min(CASE WHEN q.y = p.y THEN least(p.x, q.x) ELSE p.x + (r.y - p.y) * (q.x - p.x) / (q.y - p.y) END) AS lo, max(CASE WHEN q.y = p.y THEN greatest(p.x, q.x) ELSE p.x + (r.y - p.y) * (q.x - p.x) / (q.y - p.y) END) AS hi FROM yr r JOIN pt p ON p.label = r.label AND p.y <= r.y JOIN pt q ON q.label = r.label AND q.y >= r.y GROUP BY r.label, r.y), hp AS MATERIALIZED (SELECT label, y, ceil(lo - 1e-9) AS a, floor(hi + 1e-9) AS b FROM sd WHERE floor(hi + 1e-9) >= ceil(lo - 1e-9)), hq AS MATERIALIZED ({ENDS.format(t='hp')}), cv AS (SELECT label, sum(b - a + 1) AS convex FROM hp GROUP BY label), fe AS (SELECT p.label, max(sqrt((p.y - q.y) ** 2 + (p.x - q.x) ** 2)) AS feret FROM hq p JOIN hq q USING (label) GROUP BY p.label)"
query("shape_descriptors", lambda s, d: outlines.shape_descriptors(A.region_labels(s, d)).select("label", "area", "perimeter", "circularity", "solidity", "feret"), f", {CROSS}, {HULLS} SELECT label, area, {r('perimeter')}, {r('4 * pi() * area / perimeter ** 2', 'circularity')}, {r('area / convex', 'solidity')}, {r('feret')} FROM ac JOIN pe USING (label) JOIN cv USING (label) JOIN fe USING (label)", "region_labels")

# Peaks and edges: systems of three unknowns, solved by determinants
SYMBOLS = ["Si", "Fe", "Ca"]
ENERGY = {"Si": 1.740, "Fe": 6.404, "Ca": 3.692}
WIDE = {s: float(np.sqrt(max(0.0, quantify.ANCHOR_EV**2 + quantify.FWHM**2 * quantify.FANO * quantify.PAIR_EV * (e - quantify.ANCHOR_KEV) * 1000)) / quantify.FWHM / 1000) for s, e in ENERGY.items()}


def solved(src: str, key: str, curves: list[str], w: str = "1.0::DOUBLE") -> str:
    """Common table so({key}p1, p2, p3): least squares of v by three curves over the rows of src."""
    s = [f"sum({w} * ({curves[i]}) * ({curves[j]})) AS a{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum({w} * ({curves[i]}) * v) AS b{i}" for i in range(3)]
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    m = ["a00", "a01", "a02", "a01", "a11", "a12", "a02", "a12", "a22"]
    put = lambda c: [f"b{i // 3}" if i % 3 == c else x for i, x in enumerate(m)]
    by = f"{key}, " if key else ""
    return f"su AS (SELECT {by}{', '.join(s)} FROM {src}{f' GROUP BY {key}' if key else ''}), so AS (SELECT {by}{', '.join(f'{det(put(c))} / {det(m)} AS p{c + 1}' for c in range(3))} FROM su)"


PEAK_CURVES = [f"exp(-0.5::DOUBLE * ((e - {ENERGY[s]!r}::DOUBLE) / {WIDE[s]!r}::DOUBLE) ** 2)" for s in SYMBOLS]
PEAKS3 = f"u AS (SELECT ch, e, sum(v) AS v FROM cube GROUP BY ch, e), {solved('u', '', PEAK_CURVES, '1 / greatest(v, 1)')}"
AREA = lambda i: f"p{i + 1} * {WIDE[SYMBOLS[i]]!r}::DOUBLE * sqrt(2 * pi()) / 1000"
query("fit_peaks", lambda s, d: fits.fit_peaks(SUM(s, d), SYMBOLS).select("symbol", "line", "energy", (F.col("net") / 1000).alias("net")), f", {PEAKS3} " + " UNION ALL ".join(f"SELECT '{s}' AS symbol, 'K' AS line, {ENERGY[s]!r}::DOUBLE AS energy, {r(AREA(i), 'net')} FROM so" for i, s in enumerate(SYMBOLS)), "cube")
FACTOR = {s: (fits.K_FACTORS.get(s, 1.0), fits.MASSES.get(s, 1.0)) for s in SYMBOLS}
query("quantify_peaks", lambda s, d: fits.quantify_peaks(SUM(s, d), SYMBOLS).select("symbol", "weight_pct", "atomic_pct"), f", {PEAKS3}, q AS (" + " UNION ALL ".join(f"SELECT '{s}' AS symbol, ({AREA(i)}) * {FACTOR[s][0]!r}::DOUBLE AS q, {FACTOR[s][1]!r}::DOUBLE AS m FROM so" for i, s in enumerate(SYMBOLS)) + f") SELECT symbol, {r('100 * q / sum(q) OVER ()', 'weight_pct')}, {r('100 * (q / m) / sum(q / m) OVER ()', 'atomic_pct')} FROM q", "cube")
EDGES = [("C", "K", 284.0), ("O", "K", 532.0)]
AXIS = 100 * (A.E0_KEV + A.STEP_KEV * np.arange(64))
SHAPES = np.stack([AXIS**-1.5, *[p.curve(AXIS, np.ones((1, 1)))[0] for p in fits.edge_parts(EDGES, AXIS, 200.0, 10.0)]], 1)
DESIGN = values("ds(ch, s1, s2, s3)", [(i, *map(float, row)) for i, row in enumerate(SHAPES) if 100 <= AXIS[i] <= 900])
EVS = lambda s, d: A.cube(s, d).withColumn("e", 100 * F.col("e"))
EDGE_SQL = f"{DESIGN}, u AS (SELECT y, x, v, s1, s2, s3 FROM cube JOIN ds USING (ch)), {solved('u', 'y, x', ['s1', 's2', 's3'])}, n AS (SELECT y, x, greatest(0, p2) AS a, greatest(0, p3) AS b FROM so)"
query("edge_fit_map", lambda s, d: fits.fit_edges_map(EVS(s, d), EDGES, 200.0, 10.0, (100.0, 900.0), 1.5).withColumn("amount", F.col("amount") / 1000), f", {EDGE_SQL} SELECT y, x, 'C' AS element, {r('a / 1000', 'amount')}, {r('coalesce(100 * a / nullif(a + b, 0), 0)', 'atomic_pct')} FROM n UNION ALL SELECT y, x, 'O', {r('b / 1000', 'amount')}, {r('coalesce(100 * b / nullif(a + b, 0), 0)', 'atomic_pct')} FROM n", "cube")
query("spectrum_continuum_fit", lambda s, d: fits.fit_spectra(fits.spectra_rows(SUM(s, d), "ds_id"), [fits.Part("b", "kramers", (None,), (-fits.INF,), settings={"e0": 20.0}), fits.Part("c", "polynomial", (None, 0.0))], "poisson").select((F.col("params")[0] / 1000).alias("kramers"), (F.col("params")[1] / 1000).alias("level"), (F.col("params")[2] / 1000).alias("slope")), f", u AS (SELECT ch, e, sum(v) AS v FROM cube GROUP BY ch, e), {solved('u', '', ['(20 - e) / e', '1', 'e'], '1 / greatest(v, 1)')} SELECT {r('p1 / 1000', 'kramers')}, {r('p2 / 1000', 'level')}, {r('p3 / 1000', 'slope')} FROM so", "cube")
