"""Queries of quantification, edges and calibration, each with the SQL that states its result."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenframe import adapters as A
from lumenframe.operators import quantify as qf
from lumenframe.operators import spectral
from lumenframe.plans.catalogue import ALL_LINES, ELEMENTS, LINES3, MAPS, PEAKS
from lumenframe.plans.registry import query, r

PICK = lambda s, d: spectral.element_maps(A.cube(s, d), ELEMENTS)
SUM = lambda s, d: spectral.sum_spectrum(A.cube(s, d))
SUM_SQL = "u AS (SELECT ch, e, sum(v) AS v FROM cube GROUP BY ch, e)"


def values(name: str, rows: list[tuple]) -> str:
    """A common table of literals; reals as DOUBLE."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)
    return f"{name} AS (VALUES " + ", ".join("(" + ", ".join(map(lit, row)) + ")" for row in rows) + ")"


# Corrections
MAC = values("mac(em, ab, mac)", [(a, b, qf.absorption(a, b)) for a in ELEMENTS for b in ELEMENTS])
EL = values("el(symbol, z, density)", [(s, float(qf.Z[s]), qf.DENSITIES[s]) for s in ELEMENTS])


def _zaf_sql(iterations: int, t: float, angle: float) -> str:
    """The iteration written out: means, factors and shares of each step."""
    out = [f"{MAPS}, {MAC}, {EL}", "w0 AS (SELECT y, x, symbol, mass, v * k / sum(v * k) OVER (PARTITION BY y, x) AS w FROM i)"]
    for n in range(iterations):
        out.append(f"a{n} AS (SELECT symbol, avg(w) / sum(avg(w)) OVER () AS w FROM w{n} GROUP BY symbol)")
        out.append(f"c{n} AS (SELECT em AS symbol, sum(mac * w) AS m FROM a{n} JOIN mac ON ab = symbol GROUP BY em)")
        chi = f"m * (SELECT sum(w * density) FROM a{n} JOIN el USING (symbol)) * {t * 1e-7 / math.sin(math.radians(angle))!r}::DOUBLE"
        out.append(f"f{n} AS (SELECT symbol, 1 + ((SELECT sum(w * z) FROM a{n} JOIN el USING (symbol)) / z - 1) * (1 - exp(-{t / 200!r}::DOUBLE)) AS zf, {chi} / (1 - exp(-{chi})) AS af FROM c{n} JOIN el USING (symbol))")
        out.append(f"w{n + 1} AS (SELECT y, x, symbol, mass, (w / (zf * af)) / sum(w / (zf * af)) OVER (PARTITION BY y, x) AS w, zf, af FROM w0 JOIN f{n} USING (symbol))")
    last = f"w{iterations}"
    return ", " + ", ".join(out) + f", z AS (SELECT *, (w / mass) / sum(w / mass) OVER (PARTITION BY y, x) AS a FROM {last}) SELECT symbol, {r('100 * avg(w)', 'weight_pct')}, {r('100 * avg(a)', 'atomic_pct')}, {r('any_value(zf)', 'z_factor')}, {r('any_value(af)', 'a_factor')} FROM z GROUP BY symbol"


query("zaf", lambda s, d: qf.zaf(PICK(s, d), ELEMENTS, 150.0, 25.0), _zaf_sql(3, 150.0, 25.0), "cube")
ZF = values("zf(symbol, zeta)", [("Si", 500.0), ("Fe", 605.0), ("O", 900.0)])
DOSE = 1e10


def _zeta_sql(steps: int) -> str:
    out = [f"{MAPS}, {MAC}, {ZF}", "g0 AS (SELECT y, x, symbol, v AS c, v AS g, zeta FROM i JOIN zf USING (symbol))"]
    for n in range(steps):
        out.append(f"x{n} AS (SELECT y, x, em, {1 / math.sin(math.radians(20))!r}::DOUBLE * sum(mac / 10 * g * zeta) / {DOSE}::DOUBLE AS chi FROM g{n} JOIN mac ON ab = symbol GROUP BY y, x, em)")
        out.append(f"g{n + 1} AS (SELECT g.y, g.x, symbol, c, c * CASE WHEN abs(chi) >= 1e-6 THEN chi / (1 - exp(-chi)) ELSE 1 END AS g, zeta FROM g{n} g JOIN x{n} x ON g.y = x.y AND g.x = x.x AND em = symbol)")
    return ", " + ", ".join(out) + f" SELECT y, x, symbol, {r('100 * g * zeta / sum(g * zeta) OVER (PARTITION BY y, x)', 'weight_pct')}, {r(f'sum(g * zeta) OVER (PARTITION BY y, x) / {DOSE}::DOUBLE', 'mass_thickness')} FROM g{steps}"


query("zeta_absorption", lambda s, d: qf.zeta(PICK(s, d), ELEMENTS, [500.0, 605.0, 900.0], DOSE, iterations=4), _zeta_sql(3), "cube")
query("zeta_thin", lambda s, d: qf.zeta(PICK(s, d), ELEMENTS, [500.0, 605.0, 900.0], DOSE, absorbing=False), _zeta_sql(0), "cube")
SIGMA = f"{MAPS}, el AS (SELECT symbol, k, mass, sum(v) AS n FROM i GROUP BY symbol, k, mass), w AS (SELECT symbol, k * n AS q, k * k * n AS v, sum(k * n) OVER () AS s, sum(k * k * n) OVER () AS vs FROM el), a AS (SELECT symbol, k / mass * n AS q, (k / mass) ** 2 * n AS v, sum(k / mass * n) OVER () AS s, sum((k / mass) ** 2 * n) OVER () AS vs FROM el)"
query("composition_sigma", lambda s, d: qf.composition_sigma(PICK(s, d)), f", {SIGMA} SELECT w.symbol, {r('100 * w.q / w.s', 'weight_pct')}, {r('100 * sqrt(((1 - w.q / w.s) ** 2 * w.v + (w.q / w.s) ** 2 * (w.vs - w.v)) / w.s ** 2)', 'weight_sigma')}, {r('100 * a.q / a.s', 'atomic_pct')}, {r('100 * sqrt(((1 - a.q / a.s) ** 2 * a.v + (a.q / a.s) ** 2 * (a.vs - a.v)) / a.s ** 2)', 'atomic_sigma')} FROM w JOIN a USING (symbol)", "cube")
query("composition_profile", lambda s, d: qf.composition_profile(PICK(s, d), 3.0, 10.0, 20.0, 10.0), f", {MAPS}, a AS (SELECT y, x, symbol, 100 * (v * k / mass) / sum(v * k / mass) OVER (PARTITION BY y, x) AS a FROM i) SELECT symbol, x - 3 AS i, (x - 3)::DOUBLE AS distance, {r('a', 'atomic_pct')} FROM a WHERE y = 10 AND x BETWEEN 3 AND 20", "cube")
query("composition_profile_wide", lambda s, d: qf.composition_profile(PICK(s, d), 3.0, 10.0, 20.0, 10.0, 3), f", {MAPS}, a AS (SELECT y, x, symbol, 100 * (v * k / mass) / sum(v * k / mass) OVER (PARTITION BY y, x) AS a FROM i) SELECT symbol, x - 3 AS i, (x - 3)::DOUBLE AS distance, {r('avg(a)', 'atomic_pct')} FROM a WHERE y BETWEEN 9 AND 11 AND x BETWEEN 3 AND 20 GROUP BY symbol, x", "cube")
# The detector
SLOPE = qf.FWHM**2 * qf.FANO * qf.PAIR_EV
WIDTH = "sqrt(greatest(0, 16900.0::DOUBLE + " + repr(SLOPE) + "::DOUBLE * ({e} - 5.899::DOUBLE) * 1000))"
CONT = "c AS (SELECT ch, e, v, CASE WHEN e < 9 THEN (9 - e) / e ELSE 0 END AS c, 1 / greatest(v, 1) AS w FROM u), a AS (SELECT greatest(0, sum(w * c * v) / sum(w * c * c)) AS amp FROM c WHERE e < 9 AND NOT (e BETWEEN 1.5 AND 2.2) AND NOT (e BETWEEN 6 AND 7))"
query("continuum", lambda s, d: qf.continuum(SUM(s, d), 9.0, s.createDataFrame([(1.5, 2.2), (6.0, 7.0)], "lo double, hi double")), f", {SUM_SQL}, {CONT} SELECT ch, {r('e')}, {r('amp * c', 'continuum')}, {r('greatest(0, v - amp * c)', 'net')} FROM c, a", "cube")
query("recalibrate", lambda s, d: qf.recalibrate(SUM(s, d), [1.74, 6.404, 3.692], 0.4), f", {SUM_SQL}, {values('an(anchor)', [(1.74,), (6.404,), (3.692,)])}, c AS (SELECT anchor, sum(e * v) / sum(v) AS centre FROM u JOIN an ON abs(e - anchor) <= 0.4::DOUBLE GROUP BY anchor) SELECT {r('regr_slope(anchor, centre)', 'gain')}, {r('regr_intercept(anchor, centre)', '\"offset\"')}, count(*) AS n FROM c", "cube")
query("recalibrate_one", lambda s, d: qf.recalibrate(SUM(s, d), [6.404], 0.4), f", {SUM_SQL} SELECT 1.0::DOUBLE AS gain, {r('6.404::DOUBLE - sum(e * v) / sum(v)', '\"offset\"')}, 1::BIGINT AS n FROM u WHERE abs(e - 6.404::DOUBLE) <= 0.4::DOUBLE", "cube")
query("pixel_spectrum", lambda s, d: qf.pixel_spectrum(A.cube(s, d), A.region_labels(s, d).where("label = 3")), f"SELECT ch, {r('e')}, {r('sum(v)', 'v')} FROM cube SEMI JOIN (SELECT y, x FROM region_labels WHERE label = 3) p USING (y, x) GROUP BY ch, e", "cube", "region_labels")
# Windows
WIN = [("low", 0.0, 0.33), ("mid", 1.52, 2.07), ("wide", 4.0, 6.02), ("off", 30.0, 31.0)]
READ = "t AS (SELECT id, lo, hi, e, v, sum(v) OVER (PARTITION BY id) AS total FROM {src}, {win}), g AS (SELECT id, any_value(total) AS total, sum(v) FILTER (e >= lo AND e <= hi) AS gross, count(*) FILTER (e >= lo AND e <= hi) AS n, coalesce(sum(v) FILTER (e < lo AND e >= lo - (hi - lo)), 0) AS sl, count(*) FILTER (e < lo AND e >= lo - (hi - lo)) AS nl, coalesce(sum(v) FILTER (e > hi AND e <= hi + (hi - lo)), 0) AS sr, count(*) FILTER (e > hi AND e <= hi + (hi - lo)) AS nr FROM t GROUP BY id), k AS (SELECT *, CASE WHEN nl > 0 THEN n::DOUBLE / nl / CASE WHEN nr > 0 THEN 2 ELSE 1 END ELSE 0 END AS kl, CASE WHEN nr > 0 THEN n::DOUBLE / nr / CASE WHEN nl > 0 THEN 2 ELSE 1 END ELSE 0 END AS kr FROM g WHERE n > 0), ro AS (SELECT id, gross, kl * sl + kr * sr AS background, gross - kl * sl - kr * sr AS net, sqrt(greatest(0, gross + kl * kl * sl + kr * kr * sr)) AS sigma, (gross - kl * sl - kr * sr) / total AS share FROM k)"
query("window_readout", lambda s, d: qf.window_readout(SUM(s, d), s.createDataFrame(WIN, "id string, lo double, hi double")), f", {SUM_SQL}, {values('wn(id, lo, hi)', WIN)}, {READ.format(src='u', win='wn')} SELECT id, " + ", ".join(r(c) for c in ("gross", "background", "net", "sigma", "share")) + " FROM ro", "cube")
BAND = "CASE WHEN {s} >= 100 THEN 'strong' WHEN {s} >= 30 THEN 'clear' WHEN {s} >= 10 THEN 'weak' ELSE 'trace' END AS band"
IDENT = f"{PEAKS}, {ALL_LINES.replace('t(symbol', 'ln(symbol')}, b AS (SELECT symbol, energy AS energy FROM p JOIN ln ON abs(e - energy) <= 0.15::DOUBLE GROUP BY symbol, energy), wn AS (SELECT symbol AS id, energy - 0.085::DOUBLE AS lo, energy + 0.085::DOUBLE AS hi FROM b)"
IDENT = IDENT.replace(", b AS (SELECT ch, e, sum(v) OVER", ", bx AS (SELECT ch, e, sum(v) OVER").replace("FROM b WINDOW", "FROM bx WINDOW")
# Edges
EDGES = [("X", "K", 4.0, 4.0, 6.0, 1.0, 3.5), ("Y", "L", 7.0, 7.0, 9.0, 4.5, 6.5)]
EDGES_SQL = values("ed(element, shell, onset, s0, s1, b0, b1)", EDGES)


def _sigma_sql(e0: float, beta: float) -> str:
    gamma = 1 + e0 * 1e3 / 510998.95
    t = 510998.95 / 2 * (1 - 1 / gamma**2)
    pref = 4 * math.pi * 5.29177210903e-11**2 * 13.605693122994**2 / t
    form = "(onset / e) ** CASE shell WHEN 'K' THEN 2.7::DOUBLE ELSE 1.7::DOUBLE END"
    half = "CASE WHEN i IN (0, {m}) THEN 0.5 ELSE 1 END"
    body = "SELECT *, onset + i * w / 399 AS e FROM (SELECT *, s1 - s0 AS w FROM ed), range(400) p(i)"
    norm = "SELECT *, onset + i * w / 3999 AS e FROM (SELECT *, greatest(50 * (s1 - s0), 5000) AS w FROM ed), range(4000) p(i)"
    a = f"sa AS (SELECT element, any_value(w) / 399 * sum({half.format(m=399)} * {pref!r}::DOUBLE / e * {form} * ln(1 + ({beta * 1e-3 * 2 * gamma * t!r}::DOUBLE / e) ** 2)) AS a FROM ({body}) GROUP BY element)"
    b = f"sb AS (SELECT element, any_value(CASE shell WHEN 'K' THEN 2 ELSE 4 END) / (any_value(w) / 3999 * sum({half.format(m=3999)} * {form})) AS g FROM ({norm}) GROUP BY element)"
    return f"{a}, {b}, sg AS (SELECT element, a * g AS sigma FROM sa JOIN sb USING (element))"


CORE = "l AS (SELECT y, x, element, e, v, e BETWEEN b0 AND b1 AS f, e BETWEEN s0 AND s1 AS g FROM cube JOIN ed ON e BETWEEN b0 AND b1 OR e BETWEEN s0 AND s1), q AS (SELECT y, x, element, regr_slope(ln(greatest(v, 2.220446049250313e-16)), ln(e)) AS m, regr_intercept(ln(greatest(v, 2.220446049250313e-16)), ln(e)) AS c FROM l WHERE f GROUP BY y, x, element), n AS (SELECT y, x, element, e, greatest(0, v - exp(c + m * ln(e))) AS s FROM l JOIN q USING (y, x, element) WHERE g), tz AS (SELECT y, x, element, (lead(e) OVER w - e) * (lead(s) OVER w + s) / 2 AS a FROM n WINDOW w AS (PARTITION BY y, x, element ORDER BY e)), iy AS (SELECT y, x, element, coalesce(sum(a), 0) AS intensity FROM tz GROUP BY y, x, element), rt AS (SELECT *, intensity / sigma AS ratio FROM iy JOIN sg USING (element))"
EDGE_DF = lambda s: s.createDataFrame(EDGES, "element string, shell string, onset double, s0 double, s1 double, b0 double, b1 double")
query("edge_quantify", lambda s, d: qf.edge_quantify(A.cube(s, d), EDGE_DF(s), 200.0, 10.0).drop("ratio"), f", {EDGES_SQL}, {_sigma_sql(200.0, 10.0)}, {CORE} SELECT y, x, element, {r('intensity')}, {r('coalesce(100 * ratio / nullif(sum(ratio) OVER (PARTITION BY y, x), 0), 0)', 'atomic_pct')} FROM rt", "cube")
LAW1 = "p AS (SELECT regr_slope(ln(greatest(v, 2.220446049250313e-16)), ln(e)) AS m, regr_intercept(ln(greatest(v, 2.220446049250313e-16)), ln(e)) AS c FROM u WHERE e >= 1 AND e <= 3.5), sg AS (SELECT e, greatest(0, v - exp(c + m * ln(e))) AS s FROM u, p)"
query("near_edge", lambda s, d: qf.near_edge(SUM(s, d), 4.0, (1.0, 3.5), (0.0, 3.0), 1.0), f", {SUM_SQL}, {LAW1} SELECT {r('e - 4', 'rel')}, {r('s / greatest(2.220446049250313e-16, (SELECT avg(s) FROM sg WHERE e BETWEEN 4 AND 5))', 'intensity')} FROM sg WHERE e BETWEEN 4 AND 7", "cube")
EV = lambda s, d: SUM(s, d).select("ds_id", "ch", (F.col("e") * 100).alias("e"), "v")
SURVEY = values("ed(symbol, edge, onset)", [(s, n, float(e)) for n, t in (("K", qf.K_EDGES), ("L23", qf.L_EDGES), ("M45", qf.M_EDGES)) for s, e in t.items()])
JUMPS = f"{SUM_SQL}, sp AS (SELECT e * 100 AS e, v FROM u), {SURVEY}, ok AS (SELECT ed.* FROM ed, (SELECT min(e) AS e0, max(e) AS e1 FROM sp) WHERE onset - 52 >= e0 AND onset + 50 <= e1), l AS (SELECT symbol, edge, onset, e, v, ln(greatest(v, 2.220446049250313e-16)) AS ly FROM sp, ok WHERE e BETWEEN onset - 52 AND onset + 50), f AS (SELECT symbol, edge, regr_slope(ly, ln(e)) AS m, regr_intercept(ly, ln(e)) AS c FROM l WHERE e <= onset - 2 GROUP BY symbol, edge), n AS (SELECT symbol, edge, onset, sum(greatest(0, v - exp(c + m * ln(e)))) AS net, sum(v) AS gross FROM l JOIN f USING (symbol, edge) WHERE e >= onset AND m IS NOT NULL GROUP BY symbol, edge, onset HAVING count(*) >= 2)"
query("identify_edges", lambda s, d: qf.identify_edges(EV(s, d)), f", {JUMPS} SELECT symbol, edge, onset, {r('net')}, {r('net / sqrt(gross)', 'significance')}, {BAND.format(s='net / sqrt(gross)')} FROM n", "cube")
# Smoothing: the weights of five places and a parabola are plain fractions.
W5 = {-2: (31, 9, -3, -5, 3), -1: (9, 13, 12, 6, -5), 0: (-3, 12, 17, 12, -3), 1: (-5, 6, 12, 13, 9), 2: (3, -5, -3, 9, 31)}
D5 = {-2: (-54, 13, 40, 27, -26), -1: (-34, 3, 20, 17, -6), 0: (-14, -7, 0, 7, 14), 1: (6, -17, -20, -3, 34), 2: (26, -27, -40, -13, 54)}
for name, order, weights, per in (("savgol", 0, W5, 35.0), ("savgol_derivative", 1, D5, 70.0 * 0.15)):
    k = values("k(place, off, k)", [(p, j - 2, w / per) for p, row in weights.items() for j, w in enumerate(row)])
    query(name, lambda s, d, o=order: qf.savgol(SUM(s, d), 5, 2, o, 0.15), f", {SUM_SQL}, {k} SELECT a.ch, {r('a.e', 'e')}, {r('sum(k * b.v)', 'v')} FROM u a JOIN k ON place = a.ch - greatest(2, least(61, a.ch)) JOIN u b ON b.ch = greatest(2, least(61, a.ch)) + off GROUP BY a.ch, a.e", "cube")
