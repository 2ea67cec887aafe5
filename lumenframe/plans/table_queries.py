"""Queries of lines, crystals, scans, interfaces and defects over what the tables hold, each with the SQL that states its result."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenframe import adapters as A
from lumenframe.operators import crystal, defects, fourd, profiles, regions, spectral, texture
from lumenframe.operators import quantify as qf
from lumenframe.plans.analysis_queries import BAND, EV, JUMPS, READ, SUM, WIDTH, values
from lumenframe.plans.catalogue import BEST, KLM, PEAKS
from lumenframe.plans.crystal_queries import ATOMS, D, FAM, HKL, LAM, LET, PHASES
from lumenframe.plans.point_queries import CLAHE
from lumenframe.plans.registry import query, r

# Lines of the elements that have a line at a peak of the cube's sum spectrum
PK = PEAKS.replace(", b AS (SELECT ch, e, sum(v) OVER", ", bx AS (SELECT ch, e, sum(v) OVER").replace("FROM b WINDOW", "FROM bx WINDOW").replace(" p AS (", " pk AS (")
FOUND_SQL = f"{PK}, {KLM}, asg AS (SELECT ch, e, symbol, line, energy FROM pk JOIN t ON abs(e - energy) <= 0.15::DOUBLE), fs AS MATERIALIZED (SELECT DISTINCT symbol FROM asg)"
ASSIGNED = lambda s, d: spectral.assign_lines(spectral.detect_peaks(SUM(s, d)))
FOUND = lambda s, d: ASSIGNED(s, d).select("ds_id", "symbol").distinct()
TABLE = lambda s, d: spectral.line_table(s).join(FOUND(s, d).select("symbol"), "symbol")
query("assign_lines", ASSIGNED, f", {FOUND_SQL} SELECT ch, {r('e')}, symbol, line, {r('energy')}, (row_number() OVER (PARTITION BY ch ORDER BY abs(e - energy), symbol, line))::INT AS rank FROM asg", "cube")
query("principal_lines", lambda s, d: spectral.principal_lines(TABLE(s, d), 15.0), f", {FOUND_SQL}, {BEST.format(kv=15)} SELECT symbol, line, {r('energy')} FROM p SEMI JOIN fs USING (symbol)", "cube")
query("lines_in_range", lambda s, d: spectral.lines_in_range(TABLE(s, d), 2.5, 1.5), f", {FOUND_SQL} SELECT symbol, line, {r('energy')} FROM t SEMI JOIN fs USING (symbol) WHERE energy BETWEEN 1.5 AND 2.5", "cube")
ART = "u AS (SELECT symbol, energy FROM t SEMI JOIN fs USING (symbol) WHERE line = 'K'), a AS (SELECT a.symbol AS a, b.symbol AS b, 'sum' AS kind, a.energy + b.energy AS energy FROM u a JOIN u b ON a.symbol <= b.symbol WHERE a.energy + b.energy BETWEEN 0.2 AND 12 UNION ALL SELECT symbol, NULL, 'escape', energy - 1.74::DOUBLE FROM u WHERE energy > 1.839 AND energy - 1.74 BETWEEN 0.2 AND 12)"
KS = lambda s, d: TABLE(s, d).where("line = 'K'").select("symbol", "energy")
query("sum_artifacts", lambda s, d: spectral.sum_artifacts(KS(s, d), 12.0), f", {FOUND_SQL}, {ART} SELECT a, b, kind, {r('energy')} FROM a", "cube")
NEAR = f"abs(a.energy - u.energy) < 2 * ({WIDTH.format(e='a.energy')} + {WIDTH.format(e='u.energy')}) / {qf.FWHM * 1000!r}::DOUBLE"
query("artifacts_blocked", lambda s, d: qf.split_artifacts(spectral.sum_artifacts(KS(s, d), 12.0), KS(s, d)), f", {FOUND_SQL}, {ART} SELECT a, b, kind, {r('energy')}, EXISTS (SELECT 1 FROM u WHERE {NEAR}) AS blocked FROM a", "cube")
query("line_widths", lambda s, d: TABLE(s, d).select("symbol", "line", qf.fano_fwhm(F.col("energy")).alias("fwhm")), f", {FOUND_SQL} SELECT symbol, line, {r(WIDTH.format(e='energy'), 'fwhm')} FROM t SEMI JOIN fs USING (symbol)", "cube")
EM = values("em(symbol, kev)", list(qf.ABSORBED_KEV.items()))
AB = values("ab(symbol, z, mass)", [(s, float(qf.Z[s]), m) for s, m in spectral.MASSES.items() if s in qf.Z])
query("absorption_table", lambda s, d: qf.absorption_pairs(FOUND(s, d)), f", {FOUND_SQL}, {EM}, {AB} SELECT em.symbol AS emitter, ab.symbol AS absorber, {r('1e22::DOUBLE * z ** 4 * (12.398::DOUBLE / kev * 1e-8::DOUBLE) ** 3 / mass', 'mac')} FROM em, ab WHERE em.symbol IN (FROM fs) AND ab.symbol IN (FROM fs)", "cube")
IDENT = f"{FOUND_SQL}, b AS (SELECT symbol, arg_min(energy, (abs(e - energy), ch, energy)) AS energy FROM asg GROUP BY symbol), wn AS (SELECT symbol AS id, energy - 0.085::DOUBLE AS lo, energy + 0.085::DOUBLE AS hi FROM b)"
READING = READ.replace("t AS (", "tr AS (").replace("FROM t ", "FROM tr ").replace("FROM t)", "FROM tr)")
query("identify_elements", lambda s, d: qf.identify_elements(SUM(s, d)), f", {IDENT}, {READING.format(src='s', win='wn')} SELECT id AS symbol, {r('energy')}, {r('net')}, {r('net / sigma', 'significance')}, {BAND.format(s='net / sigma')}, {r('greatest(0, least(1, net / max(net) OVER ()))', 'relative')} FROM ro JOIN b ON symbol = id", "cube")
WINDOWS = lambda s, d: TABLE(s, d).select(F.concat("symbol", F.lit(" "), "line").alias("id"), "energy", (F.col("energy") - 0.085).alias("lo"), (F.col("energy") + 0.085).alias("hi"))
OVERLAP = "a.lo < b.hi AND b.lo < a.hi"
CLOSE = f"abs(a.energy - b.energy) < {WIDTH.format(e='((a.energy + b.energy) / 2)')} / 1000"
query("window_conflicts", lambda s, d: qf.window_conflicts(WINDOWS(s, d)), f", {FOUND_SQL}, w AS (SELECT symbol || ' ' || line AS id, energy, energy - 0.085::DOUBLE AS lo, energy + 0.085::DOUBLE AS hi FROM t SEMI JOIN fs USING (symbol)) SELECT a.id AS a, b.id AS b, {OVERLAP} AS overlap, {CLOSE} AS close FROM w a JOIN w b ON a.id < b.id AND ({OVERLAP} OR {CLOSE})", "cube")
# Cross-sections of the edges found in the spectrum, its axis taken as 100 eV a keV
GAMMA = 1 + 200e3 / 510998.95
KINETIC = 510998.95 / 2 * (1 - 1 / GAMMA**2)
PREFACTOR = 4 * math.pi * 5.29177210903e-11**2 * 13.605693122994**2 / KINETIC
SHELL = "CASE shell WHEN 'K' THEN 2.7::DOUBLE ELSE 1.7::DOUBLE END"
HALF = "CASE WHEN i IN (0, {m}) THEN 0.5::DOUBLE ELSE 1 END"
SIGMA = f"sa AS (SELECT id, 50 / 399.0::DOUBLE * sum({HALF.format(m=399)} * {PREFACTOR!r}::DOUBLE / e * (onset / e) ** {SHELL} * ln(1 + ({10e-3 * 2 * GAMMA * KINETIC!r}::DOUBLE / e) ** 2)) AS a FROM (SELECT *, onset + i * 50 / 399.0::DOUBLE AS e FROM ed2, range(400) q(i)) GROUP BY id), sb AS (SELECT id, any_value(CASE shell WHEN 'K' THEN 2 ELSE 4 END) / (5000 / 3999.0::DOUBLE * sum({HALF.format(m=3999)} * (onset / e) ** {SHELL})) AS g FROM (SELECT *, onset + i * 5000 / 3999.0::DOUBLE AS e FROM ed2, range(4000) q(i)) GROUP BY id)"
query("cross_sections", lambda s, d: qf.identify_edges(EV(s, d)).select("symbol", "edge", (1e26 * qf.cross_section(F.when(F.col("edge") == "K", "K").otherwise("L"), F.col("onset"), F.lit(50.0), 200.0, 10.0)).alias("sigma")), f", {JUMPS}, ed2 AS (SELECT symbol || edge AS id, symbol, edge, onset, CASE edge WHEN 'K' THEN 'K' ELSE 'L' END AS shell FROM n), {SIGMA} SELECT symbol, edge, {r('1e26::DOUBLE * a * g', 'sigma')} FROM ed2 JOIN sa USING (id) JOIN sb USING (id)", "cube")

# Crystals: a cell for each supplier
CELLS_SQL = "cu AS (SELECT CASE WHEN s_suppkey = 3 THEN 'silicon' ELSE 'Cell ' || s_suppkey END AS name, 3 + (s_suppkey % 37) / 10.0::DOUBLE AS a, 3 + (s_suppkey % 37) / 10.0::DOUBLE AS b, CASE WHEN s_suppkey % 3 = 0 THEN 3 + (s_suppkey % 37) / 10.0::DOUBLE ELSE 4 + (s_suppkey % 11) / 4.0::DOUBLE END AS c, 90.0::DOUBLE AS al, 90.0::DOUBLE AS be, CASE WHEN s_suppkey % 3 = 1 THEN 120.0::DOUBLE ELSE 90.0::DOUBLE END AS ga, CASE WHEN s_suppkey % 3 = 0 THEN ['F', 'I', 'P'][1 + s_suppkey % 2] ELSE 'P' END AS centering FROM supplier)"


def cells(s, d):
    k = F.col("s_suppkey")
    side = 3 + (k % 37) / 10.0
    c = F.when(k % 3 == 0, side).otherwise(4 + (k % 11) / 4.0)
    name = F.when(k == 3, "silicon").otherwise(F.concat(F.lit("Cell "), k.cast("string")))
    centering = F.when(k % 3 == 0, F.when(k % 2 == 0, "F").otherwise("I")).otherwise("P")
    return A.table(s, d, "supplier").select(name.alias("name"), side.alias("a"), side.alias("b"), c.alias("c"), F.lit(90.0).alias("alpha"), F.lit(90.0).alias("beta"), F.when(k % 3 == 1, 120.0).otherwise(90.0).alias("gamma"), centering.alias("centering"))


FEW = lambda s, d: cells(s, d).where("a < 4.0")
FEW_SQL = "fw AS (SELECT * FROM cu WHERE a < 4.0)"
query("phases_with_custom", lambda s, d: crystal.with_custom(crystal.phases(s), cells(s, d)).select("name", "a", "c", "gamma", "centering"), f"WITH {PHASES}, {CELLS_SQL} SELECT name, {r('a')}, {r('c')}, {r('ga', 'gamma')}, centering FROM ph WHERE lower(name) NOT IN (SELECT lower(name) FROM cu) UNION ALL SELECT name, {r('a')}, {r('c')}, {r('ga', 'gamma')}, centering FROM cu")
query("find_phase", lambda s, d: crystal.find_phase(crystal.with_custom(crystal.phases(s), cells(s, d)), "CELL 1").select("name", "a"), f"WITH {PHASES}, {CELLS_SQL} SELECT name, {r('a')} FROM (SELECT name, a FROM ph UNION ALL SELECT name, a FROM cu) WHERE lower(name) LIKE '%cell 1%' ORDER BY name LIMIT 1")
query("wavelengths", lambda s, d: A.table(s, d, "part").select((60.0 + 5 * F.col("p_size")).alias("kv")).distinct().select("kv", (1000 * crystal.wavelength(F.col("kv"))).alias("pm")), f"SELECT kv, {r('6.62607015e-34::DOUBLE / sqrt(2 * 9.1093837015e-31::DOUBLE * 1.602176634e-19::DOUBLE * kv * 1000 * (1 + 1.602176634e-19::DOUBLE * kv * 1000 / (2 * 9.1093837015e-31::DOUBLE * 299792458.0::DOUBLE ** 2))) * 1e13::DOUBLE', 'pm')} FROM (SELECT DISTINCT 60.0::DOUBLE + 5 * p_size AS kv FROM part)")
query("reflections", lambda s, d: crystal.reflections(FEW(s, d), 4, 1.5406, 0.6123).withColumn("d", 100 * F.col("d")), f"WITH {CELLS_SQL}, {FEW_SQL}, {HKL.format(d=D, src='fw', m=4, let=LET)}, {FAM} SELECT name, b.h AS h, b.k AS k, b.l AS l, {r('100 * d', 'd')}, multiplicity, CASE WHEN 1.5406::DOUBLE / (2 * d) <= 1 THEN round(2 * degrees(asin(1.5406::DOUBLE / (2 * d))), 5) END AS two_theta FROM fa WHERE d >= 0.6123")
query("zone_reflections", lambda s, d: crystal.zone_reflections(cells(s, d), (1, 1, 0), 3), f"WITH {CELLS_SQL}, {HKL.format(d=D, src='cu', m=3, let=LET)} SELECT name, h::INT AS h, k::INT AS k, l::INT AS l, {r('d')} FROM ix WHERE h + k = 0")
CUBIC = lambda s, d: cells(s, d).where("centering = 'F'")
BASIS = lambda s, d: CUBIC(s, d).select("name").crossJoin(F.broadcast(s.createDataFrame([a[1:] for a in ATOMS], "weight double, x double, y double, z double")))
query("diffraction_pattern", lambda s, d: crystal.strong(crystal.structure_factor(crystal.zone_reflections(CUBIC(s, d), (0, 0, 1), 4), BASIS(s, d), 0.5)).drop("intensity"), f"WITH {CELLS_SQL}, sc AS (SELECT * FROM cu WHERE centering = 'F'), {HKL.format(d=D, src='sc', m=4, let=LET)}, {values('bas(name, weight, x, y, z)', ATOMS)}, i AS (SELECT ix.name, h, k, l, d, sum(weight * exp(-0.5::DOUBLE / (4 * d * d)) * cos(2 * pi() * (h * x + k * y + l * z))) ** 2 + sum(weight * exp(-0.5::DOUBLE / (4 * d * d)) * sin(2 * pi() * (h * x + k * y + l * z))) ** 2 AS f FROM ix, bas WHERE l = 0 GROUP BY ix.name, h, k, l, d) SELECT name, h::INT AS h, k::INT AS k, l::INT AS l, {r('d')}, {r('f / max(f) OVER (PARTITION BY name)', 'relative')} FROM i QUALIFY f / max(f) OVER (PARTITION BY name) >= 0.01")
query("ring_radii", lambda s, d: cells(s, d).select("name", crystal.ring_radius(F.col("a"), 512, 0.05, 200.0).alias("camera"), crystal.ring_radius(F.col("a"), 512, 0.2).alias("transform")), f"WITH {CELLS_SQL} SELECT name, {r(f'200 * tan(2 * asin({LAM} / (2 * a))) / 0.05::DOUBLE', 'camera')}, {r('512 * 0.2::DOUBLE / a', 'transform')} FROM cu")
SPOTS = lambda s, d: A.table(s, d, "supplier").select(F.col("s_suppkey").alias("spot"), (F.col("s_suppkey") * 37 % 480 + 17).cast("double").alias("y"), (F.col("s_suppkey") * 101 % 470 + 21).cast("double").alias("x"))
SPOTS_SQL = "sp AS (SELECT s_suppkey AS spot, (s_suppkey * 37 % 480 + 17)::DOUBLE AS y, (s_suppkey * 101 % 470 + 21)::DOUBLE AS x FROM supplier), me AS (SELECT spot, 512 * 0.2::DOUBLE / sqrt((y - 257) ** 2 + (x - 257) ** 2) AS d FROM sp WHERE y <> 257 OR x <> 257)"
query("index_spots", lambda s, d: crystal.index_spots(crystal.measured_d(SPOTS(s, d), 512, 512, 0.2), FEW(s, d), 0.02, 4), f"WITH {CELLS_SQL}, {FEW_SQL}, {HKL.format(d=D, src='fw', m=4, let=LET)}, {FAM}, {SPOTS_SQL}, nn AS (SELECT name, spot, min(abs(fa.d - me.d) / fa.d) AS far FROM fa, me GROUP BY name, spot), bs AS (SELECT name, count(*) AS matched, avg(far) AS error FROM nn WHERE far < 0.02 GROUP BY name), sc AS (SELECT fw.name, coalesce(matched, 0) AS matched, coalesce(matched::DOUBLE / (SELECT count(*) FROM sp), 0) AS score, error FROM fw LEFT JOIN bs USING (name)) SELECT name, matched, {r('score')}, {r('error')}, (row_number() OVER (ORDER BY score DESC, error ASC NULLS LAST, name))::INT AS rank FROM sc")
# Scans
CENTRE = "ce AS (SELECT sum(ky * v) / sum(v) AS cy, sum(kx * v) / sum(v) AS cx FROM scan4d), px AS (SELECT DISTINCT ky, kx FROM scan4d), w AS (SELECT cy, cx, sqrt(greatest(cy, 7 - cy) ** 2 + greatest(cx, 7 - cx) ** 2) / 4 AS w FROM ce)"
query("radial_coverage", lambda s, d: fourd.coverage_of(A.scan4d(s, d)), f", {CENTRE}, n AS (SELECT least(3, floor(sqrt((ky - cy) ** 2 + (kx - cx) ** 2) / w))::INT AS bin, count(*) AS n FROM px, w GROUP BY 1) SELECT i::INT AS bin, {r('(i + 0.5::DOUBLE) * w', 'radius')}, coalesce(n, 0) AS n FROM range(4) u(i) LEFT JOIN n ON n.bin = i, w", "scan4d")
query("scan_shapes", lambda s, d: fourd.shapes_of(A.scan4d(s, d), 0), ", q AS (SELECT count(*) AS q FROM (SELECT DISTINCT sy, sx FROM scan4d)), f AS (SELECT i AS \"rows\", q // i AS cols FROM q, range(1, (SELECT q + 1 FROM q)) t(i) WHERE q % i = 0) SELECT *, (row_number() OVER (ORDER BY greatest(\"rows\", cols), \"rows\" DESC))::INT AS rank FROM f", "scan4d")

# Interfaces: blurred with mirrored ends, then peaks of the slope that keep apart
FOLD = "CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"


def blur_sql(name: str, src: str, sigma: float, n: int, key: str = "") -> str:
    """Common table <name>({key}, i, v): src blurred along i."""
    half = int(4 * sigma + 0.5)
    k = [math.exp(-(o * o) / (2 * sigma * sigma)) for o in range(-half, half + 1)]
    rows = ", ".join(f"({o}, {w / sum(k)!r}::DOUBLE)" for o, w in zip(range(-half, half + 1), k, strict=True))
    by = f"a.{key}, " if key else ""
    same = f"b.{key} = a.{key} AND " if key else ""
    return f"{name} AS MATERIALIZED (SELECT {by}a.i, sum(b.v * k) AS v FROM {src} a, (VALUES {rows}) w(o, k), {src} b WHERE {same}b.i = {FOLD.format(i='a.i + o', n=n)} GROUP BY {by}a.i)"


def steep_sql(name: str, src: str, n: int, key: str = "") -> str:
    part = f"PARTITION BY {key} " if key else ""
    by = f"{key}, " if key else ""
    return f"{name} AS MATERIALIZED (SELECT {by}i, abs(CASE WHEN i = 0 THEN lead(v) OVER w - v WHEN i = {n - 1} THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END) AS g FROM {src} WINDOW w AS ({part}ORDER BY i))"


def apart_sql(n: str, slope: str, distance: int) -> str:
    """Common table pk_<n>(i, g): peaks of `slope` of 0.3 of the highest or more, of which the higher ones keep the others away."""
    return f"cd_{n} AS MATERIALIZED (SELECT i, g, row_number() OVER (ORDER BY g DESC, i DESC) AS k FROM (SELECT i, g, lag(g) OVER w AS g0, lead(g) OVER w AS g2, max(g) OVER () AS top FROM {slope} WINDOW w AS (ORDER BY i)) WHERE g0 < g AND g > g2 AND g >= 0.3::DOUBLE * top), go_{n} AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT c.k, CASE WHEN len([x FOR x IN kept IF abs(x - c.i) < {distance}]) > 0 THEN kept ELSE list_append(kept, c.i::BIGINT) END FROM go_{n} q JOIN cd_{n} c ON c.k = q.k + 1), pk_{n} AS MATERIALIZED (SELECT i, g FROM {slope} WHERE i IN (SELECT unnest(kept) FROM go_{n} WHERE k = (SELECT max(k) FROM go_{n})))"


DEPTH = "dp AS MATERIALIZED (SELECT y - 1 AS i, avg(v) AS v FROM pix GROUP BY y)"
PROFILE = lambda s, d: regions.depth_profile(A.pix(s, d))
FACES = f"{DEPTH}, {blur_sql('bl', 'dp', 1.5, 64)}, {steep_sql('sg', 'bl', 64)}, {apart_sql('a', 'sg', 5)}"
rec = lambda body: A.with_views(body, "pix").replace("WITH ", "WITH RECURSIVE ", 1)
query("interfaces", lambda s, d: profiles.interfaces(PROFILE(s, d), 0.3), rec(f", {FACES} SELECT i::INT AS i, {r('g', 'slope')} FROM pk_a"))
query("interfaces_strongest", lambda s, d: profiles.interfaces(PROFILE(s, d), 0.3, n_layers=4), rec(f", {FACES} SELECT i::INT AS i, {r('g', 'slope')} FROM pk_a ORDER BY g DESC, i DESC LIMIT 3"))
query("layers_between", lambda s, d: regions.layers_between(profiles.interfaces(PROFILE(s, d), 0.3)), rec(f", {FACES}, n AS (SELECT (row_number() OVER w - 1)::INT AS layer, i::DOUBLE AS top, (lead(i) OVER w)::DOUBLE AS bottom FROM pk_a WINDOW w AS (ORDER BY i)) SELECT *, bottom - top AS thickness FROM n WHERE bottom IS NOT NULL"))
SCALES = ", ".join(f"{blur_sql(f'bl_{n}', 'dp', s, 64)}, {steep_sql(f'sg_{n}', f'bl_{n}', 64)}, {apart_sql(n, f'sg_{n}', 5)}" for n, s in (("x", 2.0), ("y", 4.0), ("z", 8.0)))
HELD = "cn AS (SELECT i FROM pk_x UNION SELECT i FROM pk_y UNION SELECT i FROM pk_z), hd AS MATERIALIZED (SELECT i, support, row_number() OVER (ORDER BY i) AS k FROM (SELECT i, " + " + ".join(f"(EXISTS (SELECT 1 FROM pk_{n} p WHERE abs(p.i - cn.i) <= 5))::INT" for n in "xyz") + " AS support FROM cn) WHERE support >= 2), fi AS (SELECT 0::BIGINT AS k, -100::BIGINT AS last, []::BIGINT[] AS kept UNION ALL SELECT h.k, CASE WHEN h.i - last > 5 THEN h.i ELSE last END, CASE WHEN h.i - last > 5 THEN list_append(kept, h.i::BIGINT) ELSE kept END FROM fi JOIN hd h ON h.k = fi.k + 1)"
query("persistent_interfaces", lambda s, d: profiles.persistent_interfaces(PROFILE(s, d)), rec(f", {DEPTH}, {SCALES}, {HELD} SELECT hd.i::INT AS i, support, {r('g', 'slope')} FROM hd JOIN sg_z USING (i) WHERE hd.i IN (SELECT unnest(kept) FROM fi WHERE k = (SELECT max(k) FROM fi))"))


def trace_sql(n: str, at: int, window: int, axis: str = "y") -> str:
    """Common table tr_<n>(x, depth)."""
    key, along, size = ("x", "y", 64) if axis == "y" else ("y", "x", 96)
    src = f"ln_{n} AS (SELECT {key} AS x, {along} - 1 AS i, v FROM pix)"
    return f"{src}, {blur_sql(f'lb_{n}', f'ln_{n}', 1.0, size, 'x')}, {steep_sql(f'ls_{n}', f'lb_{n}', size, 'x')}, nb_{n} AS (SELECT *, lag(g) OVER w AS g0, lead(g) OVER w AS g2 FROM ls_{n} WINDOW w AS (PARTITION BY x ORDER BY i)), tr_{n} AS MATERIALIZED (SELECT x, i + CASE WHEN abs(g0 - 2 * g + g2) > 1e-12 THEN greatest(-0.5::DOUBLE, least(0.5::DOUBLE, 0.5::DOUBLE * (g0 - g2) / (g0 - 2 * g + g2))) ELSE 0 END AS depth FROM nb_{n} WHERE i >= {max(1, at - window)} AND i < {min(size - 1, at + window + 1)} QUALIFY row_number() OVER (PARTITION BY x ORDER BY g DESC, i) = 1)"


ONE, TWO = trace_sql("a", 20, 8), trace_sql("b", 45, 8)
TRACES = lambda s, d: (profiles.trace_interface(A.pix(s, d), 20.0, 8), profiles.trace_interface(A.pix(s, d), 45.0, 8))
query("trace_interface", lambda s, d: TRACES(s, d)[0], f", {ONE} SELECT x, {r('depth')} FROM tr_a", "pix")
query("trace_interface_rows", lambda s, d: profiles.trace_interface(A.pix(s, d), 48.0, 10, "x"), f", {trace_sql('c', 48, 10, 'x')} SELECT x, {r('depth')} FROM tr_c", "pix")
query("conformality", lambda s, d: regions.conformality(*TRACES(s, d)), f", {ONE}, {TWO} SELECT count(*) AS n, {r('corr(a.depth, b.depth)', 'r')} FROM tr_a a JOIN tr_b b USING (x)", "pix")
CLEAN = "c0 AS MATERIALIZED (SELECT x, depth, true AS kept FROM tr_a)" + "".join(f", l{i} AS (SELECT regr_slope(depth, x) AS b, regr_intercept(depth, x) AS a FROM c{i} WHERE kept), q{i} AS MATERIALIZED (SELECT x, depth, kept, depth - a - b * x AS res FROM c{i}, l{i}), m{i} AS (SELECT quantile_cont(res, 0.5) AS m FROM q{i} WHERE kept), s{i} AS (SELECT 1.4826::DOUBLE * quantile_cont(abs(res - m), 0.5) AS s FROM q{i}, m{i} WHERE kept), c{i + 1} AS MATERIALIZED (SELECT x, depth, abs(res) <= 1.5::DOUBLE * s AS kept FROM q{i}, s{i})" for i in range(4))
CLEANED = lambda s, d: profiles.clean_trace(TRACES(s, d)[0], order=1, kappa=1.5)
query("clean_trace", lambda s, d: CLEANED(s, d).select("x", "kept", "residual"), f", {ONE}, {CLEAN} SELECT x, kept, CASE WHEN kept THEN round(res, 5) + 0.0 END AS residual FROM q3", "pix")
ROUGH = "k AS (SELECT x, res FROM q3 WHERE kept), rw AS (SELECT 1.4826::DOUBLE * quantile_cont(abs(res - (SELECT quantile_cont(res, 0.5) FROM k)), 0.5) AS raw FROM k), nf AS (SELECT sqrt(quantile_cont(d * d, 0.5) / 0.4549::DOUBLE / 2) AS noise FROM (SELECT res - lag(res) OVER (ORDER BY x) AS d FROM k) WHERE d IS NOT NULL)"
query("trace_roughness", lambda s, d: profiles.trace_sigma(CLEANED(s, d)).select("n", "quality", "sigma", "raw", "noise"), f", {ONE}, {CLEAN}, {ROUGH} SELECT (SELECT count(*) FROM k) AS n, {r('(SELECT count(*) FROM k) / (SELECT count(*)::DOUBLE FROM q3)', 'quality')}, {r('sqrt(greatest(raw ** 2 - noise ** 2, 0))', 'sigma')}, {r('raw')}, {r('noise')} FROM rw, nf", "pix")

# Line defects and scale bars
HALF_K = 7
KERNELS = {n: defects.oriented_kernel(15, a) for n, a in enumerate((0.0, 45.0, 90.0, 135.0))}
KERNEL_ROWS = ", ".join(f"({n}, {dy - HALF_K}, {dx - HALF_K}, {w!r}::DOUBLE)" for n, k in KERNELS.items() for dy, row in enumerate(k) for dx, w in enumerate(row))
RESPONSE = f"kr(n, dy, dx, w) AS (VALUES {KERNEL_ROWS}), rs AS MATERIALIZED (SELECT y, x, max(abs(f)) AS v FROM (SELECT p.y + dy AS y, p.x + dx AS x, n, sum(p.v * w) AS f FROM pix p, kr GROUP BY ALL) WHERE y BETWEEN 1 AND 64 AND x BETWEEN 1 AND 96 GROUP BY y, x)"
OTSU = "e AS (SELECT min(v) AS lo, max(v) AS hi FROM rs), h AS (SELECT b, count(v) / 6144.0::DOUBLE AS p, any_value(lo) + (b + 0.5::DOUBLE) * (any_value(hi) - any_value(lo)) / 256 AS c FROM range(256) q(b) CROSS JOIN e LEFT JOIN rs ON least(255, floor((v - lo) / (hi - lo) * 256))::INT = b GROUP BY b), cu AS (SELECT b, c, sum(p) OVER o AS w, sum(p * c) OVER o AS m FROM h WINDOW o AS (ORDER BY b)), th AS (SELECT c AS t FROM cu, (SELECT m AS mt FROM cu WHERE b = 255) ORDER BY round(CASE WHEN w > 1e-10 AND 1 - w > 1e-10 THEN (mt * w - m) ** 2 / (w * (1 - w)) ELSE 0 END, 6) DESC, b LIMIT 1), mk AS MATERIALIZED (SELECT y, x, v >= t AS on_ FROM rs, th)"
HITS = "SELECT count(*) FILTER (u) AS n FROM (SELECT on_ AND NOT lag(on_) OVER (PARTITION BY {a} ORDER BY {b}) AS u FROM mk WHERE {a} % 10 = 0 AND {a} < {n})"
query("defect_response", lambda s, d: defects.line_response(A.pix(s, d)), f", {RESPONSE} SELECT y, x, {r('v')} FROM rs", "pix")
query("defect_lines", lambda s, d: defects.count_defect_lines(A.pix(s, d), grid=10, pixel_size=2.0, thickness=50.0), f", {RESPONSE}, {OTSU}, c AS (SELECT ({HITS.format(a='y', b='x', n=64)}) + ({HITS.format(a='x', b='y', n=96)}) AS n) SELECT n AS crossings, 15::BIGINT AS lines, {(6 * 96 + 9 * 64) * 2.0}::DOUBLE AS length, {r(f'2 * n / ({(6 * 96 + 9 * 64) * 2.0}::DOUBLE * 50)', 'density')} FROM c", "pix")
BARRED = lambda s, d: A.pix(s, d).withColumn("v", F.when(F.col("y").between(58, 60) & F.col("x").between(20, 49), F.col("v") + 5000).otherwise(F.col("v")))
BAR = "bp AS MATERIALIZED (SELECT y, x, CASE WHEN y BETWEEN 58 AND 60 AND x BETWEEN 20 AND 49 THEN v + 5000 ELSE v END AS v FROM pix WHERE y > 54), nm AS MATERIALIZED (SELECT y, x, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS v FROM bp), bw AS MATERIALIZED (SELECT white, y, x, CASE WHEN white THEN v > 0.85::DOUBLE ELSE v < 0.15::DOUBLE END AS o FROM nm, (VALUES (true), (false)) q(white)), rn AS MATERIALIZED (SELECT white, y, min(x) AS a, max(x) AS b, count(*) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY white, y ORDER BY x) AS k FROM bw WHERE o) GROUP BY white, y, k HAVING count(*) BETWEEN 20 AND 57), lo AS (SELECT rn.white, rn.y, rn.a, rn.b, rn.n, s.y AS yy, avg(s.o::INT) > 0.7::DOUBLE AS ok FROM rn JOIN bw s ON s.white = rn.white AND s.y > rn.y AND s.x BETWEEN rn.a + 2 AND rn.b - 2 GROUP BY rn.white, rn.y, rn.a, rn.b, rn.n, s.y), hg AS (SELECT white, y, a, b, n, coalesce(min(yy) FILTER (NOT ok), 65) - y AS height FROM rn LEFT JOIN lo USING (white, y, a, b, n) GROUP BY white, y, a, b, n)"
query("scale_bar", lambda s, d: defects.scale_bar(BARRED(s, d)).where("found"), f", {BAR} SELECT true AS found, n AS length, a AS x1, b AS x2, y FROM hg WHERE height <= 15 ORDER BY n DESC, white DESC, y, a LIMIT 1", "pix")
query("scale_bar_none", lambda s, d: defects.scale_bar(A.pix(s, d)), "SELECT false AS found, 0::BIGINT AS length, 0 AS x1, 0 AS x2, 0 AS y FROM lineitem LIMIT 1")
# Equalised values are dyadic, so a shift keeps them off the ties of five digits
query("clahe", lambda s, d: texture.clahe(A.pix(s, d), 0.05).withColumn("v", F.col("v") + 1e-7), f", {CLAHE} SELECT y, x, {r('sum(w * u) + 1e-7::DOUBLE', 'v')} FROM wt JOIN lut ON lut.i = wt.i AND lut.j = wt.j AND k = bin WHERE w > 0 GROUP BY y, x", "pix")
