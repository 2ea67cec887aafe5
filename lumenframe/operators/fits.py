"""Fits of sums of curves to spectra: peaks, edges and backgrounds, all spectra of a batch at once.

A spectrum is one row of arrays, bounded by its channels. Damped Gauss-Newton steps are taken for every spectrum of a batch
together: normal equations are sums over its channels, steps end at the bounds, a parameter that is pushed against a bound
rests for the step, and each spectrum has a damping of its own. A model's parts and starts are small and go with the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.quantify import FWHM, fano_fwhm
from lumenframe.operators.spectral import K_FACTORS, MASSES, line_table, principal_lines

#: Numbers of a batch's Jacobian that are held at once.
HELD = 4_000_000
INF = math.inf
#: Half width at half height of a Lorentzian that is as wide as a Gaussian of sigma 1.
AS_WIDE = math.sqrt(2 * math.log(2))


@cache
def _weideman(n: int = 40) -> tuple[np.ndarray, float]:
    """Coefficients of a rational approximation of the Faddeeva function."""
    scale, m = math.sqrt(n / math.sqrt(2)), 2 * n
    t = scale * np.tan(np.arange(-m + 1, m) * math.pi / m / 2)
    f = np.append(0, np.exp(-(t**2)) * (scale**2 + t**2))
    return np.flipud(np.real(np.fft.fft(np.fft.fftshift(f)))[1 : n + 1] / (2 * m)), scale


def voigt_profile(x: np.ndarray, sigma: np.ndarray | float, gamma: np.ndarray | float) -> np.ndarray:
    """A Gaussian of deviation sigma folded with a Lorentzian of half width gamma (above 0 at least one of both), of area 1."""
    sigma, gamma = np.maximum(sigma, 1e-12), np.maximum(gamma, 1e-12)
    z = (x + 1j * gamma) / (sigma * math.sqrt(2))
    a, scale = _weideman()
    u = (scale + 1j * z) / (scale - 1j * z)
    w = 2 * np.polyval(a, u) / (scale - 1j * z) ** 2 + 1 / math.sqrt(math.pi) / (scale - 1j * z)
    return w.real / (sigma * math.sqrt(2 * math.pi))


def kramers(e: np.ndarray, e0: float) -> np.ndarray:
    """Bremsstrahlung by energy: (e0 - e) / e below e0, else 0."""
    return np.where((e < e0) & (e > 0), (e0 - e) / np.maximum(e, 1e-9), 0.0)


def edge_shape(e: np.ndarray, shell: str, onset: float, e0_kv: float, beta_mrad: float) -> np.ndarray:
    """Cross-section per eV (m2) of a K or L edge at energies e, 0 below the onset."""
    occupied, s = {"K": (2, 3.7), "L": (4, 2.7)}[shell]
    gamma = 1 + e0_kv * 1e3 / 510998.95
    t = 510998.95 / 2 * (1 - 1 / gamma**2)
    form = lambda x: (x / onset) * (onset / x) ** s
    grid = np.linspace(onset, onset + 5000.0, 4000)
    g = form(grid)
    norm = occupied / float(((g[1:] + g[:-1]) / 2 * np.diff(grid)).sum())
    x = np.maximum(e, onset)
    angle = np.log(1 + (beta_mrad * 1e-3 / (x / (2 * gamma * t))) ** 2)
    return np.where(e >= onset, 4 * math.pi * 5.29177210903e-11**2 * (13.605693122994 / x) * (13.605693122994 / t) * norm * form(x) * angle, 0.0)


@dataclass(frozen=True)
class Part:
    """A term of a model. kind: gaussian, lorentzian, pseudo_voigt, voigt (amp, center, sigma, gamma), power_law (amp,
    exponent), polynomial (c0, c1, ...), kramers (amp), edge (amp) or self_affine (rough, length, hurst, nugget: the noise squared). start, lower, upper: by parameter; a start of None is guessed
    from each spectrum (heights at the center, a law below `settings['below']`). fixed: parameters that keep their start.
    """

    name: str
    kind: str
    start: tuple = ()
    lower: tuple = ()
    upper: tuple = ()
    fixed: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)

    def names(self) -> tuple[str, ...]:
        if self.kind == "polynomial":
            return tuple(f"c{i}" for i in range(len(self.start)))
        return {"gaussian": ("amp", "center", "sigma"), "lorentzian": ("amp", "center", "gamma"), "pseudo_voigt": ("amp", "center", "sigma", "eta"), "voigt": ("amp", "center", "sigma", "gamma"), "power_law": ("amp", "exponent"), "kramers": ("amp",), "edge": ("amp",), "self_affine": ("rough", "length", "hurst", "nugget")}[self.kind]

    def bounds(self) -> tuple[list[float], list[float]]:
        low = {"amp": 0.0, "sigma": 1e-9, "gamma": 1e-9, "eta": 0.0, "exponent": 0.0, "rough": 1e-6, "length": 0.5, "hurst": 0.05, "nugget": 0.0}
        high = {"eta": 1.0, "exponent": 12.0, "hurst": 1.0}
        names = self.names()
        own = lambda given, i: given[i] if i < len(given) and given[i] is not None else None
        lo = [own(self.lower, i) if own(self.lower, i) is not None else low.get(n, -INF) for i, n in enumerate(names)]
        hi = [own(self.upper, i) if own(self.upper, i) is not None else high.get(n, INF) for i, n in enumerate(names)]
        return lo, hi

    def curve(self, e: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Values at energies e (channels) for parameters p (spectra x parameters). Peaks have the height amp."""
        a = p[:, :1]
        if self.kind == "polynomial":
            return sum(p[:, i : i + 1] * e**i for i in range(p.shape[1]))
        if self.kind == "power_law":
            return a * np.maximum(e, 1e-12) ** -p[:, 1:2]
        if self.kind == "self_affine":
            return 2 * p[:, 3:4] + 2 * a * a * (1 - np.exp(-((e / np.maximum(p[:, 1:2], 1e-9)) ** (2 * p[:, 2:3]))))
        if self.kind == "kramers":
            return a * kramers(e, self.settings["e0"])
        if self.kind == "edge":
            return a * self.settings["scale"] * edge_shape(e, self.settings["shell"], self.settings["onset"], self.settings["e0_kv"], self.settings["beta_mrad"])
        x, s = e - p[:, 1:2], np.maximum(p[:, 2:3], 1e-12)
        if self.kind == "gaussian":
            return a * np.exp(-0.5 * (x / s) ** 2)
        if self.kind == "lorentzian":
            return a * s * s / (x * x + s * s)
        if self.kind == "pseudo_voigt":
            eta, g = np.clip(p[:, 3:4], 0, 1), AS_WIDE * s
            return a * (eta * g * g / (x * x + g * g) + (1 - eta) * np.exp(-0.5 * (x / s) ** 2))
        return a * voigt_profile(x, s, p[:, 3:4]) / voigt_profile(np.zeros_like(s), s, p[:, 3:4])

    def area(self, p: np.ndarray) -> np.ndarray:
        """Areas of a peak for parameters p (spectra x parameters)."""
        a, s = p[:, 0], p[:, 2]
        gauss, lorentz = a * s * math.sqrt(2 * math.pi), a * math.pi * s
        if self.kind == "gaussian":
            return gauss
        if self.kind == "lorentzian":
            return lorentz
        if self.kind == "pseudo_voigt":
            return (1 - p[:, 3]) * gauss + p[:, 3] * lorentz * AS_WIDE
        return a / voigt_profile(np.zeros_like(s), s, p[:, 3])

    def starts(self, e: np.ndarray, v: np.ndarray) -> np.ndarray:
        names, n = self.names(), len(v)
        out = np.zeros((n, len(names)))
        for i, s in enumerate(self.start):
            if s is not None:
                out[:, i] = s
        guess = [i for i, name in enumerate(names) if i >= len(self.start) or self.start[i] is None]
        if not guess:
            return out
        if self.kind == "power_law":
            pre = (e > 0) & (e < self.settings.get("below", INF))
            x = np.log(e[pre])
            y = np.log(np.maximum(v[:, pre], 1e-9))
            ok = (v[:, pre] > 0).astype(float)
            m = np.maximum(ok.sum(1), 1)
            mx, my = (ok * x).sum(1) / m, (ok * y).sum(1) / m
            sxx = (ok * (x - mx[:, None]) ** 2).sum(1)
            slope = np.where(sxx > 0, (ok * (x - mx[:, None]) * (y - my[:, None])).sum(1) / np.maximum(sxx, 1e-300), -3.0)
            law = np.stack([np.exp(my - slope * mx), -slope], 1)
            bad = ok.sum(1) < 2
            law[bad] = np.stack([np.maximum(v[bad].max(1), 1.0), np.full(bad.sum(), 3.0)], 1)
            out[:, guess] = law[:, guess]
            return out
        if self.kind in ("kramers", "edge", "polynomial"):
            probe = np.ones((1, len(names)))
            top = max(float(self.curve(e, probe).max()), 1e-300)
            out[:, guess] = (np.maximum(v.max(1), 1e-9) / top * 0.1)[:, None]
            return out
        near = np.abs(e - out[:, 1:2]) <= 2 * np.maximum(out[:, 2:3], 1e-12)
        out[:, 0] = np.maximum(np.where(near, v, 0.0).max(1), 1.0)
        return out


def model_curves(e: np.ndarray, parts: list[Part], p: np.ndarray) -> np.ndarray:
    """Sum of the parts for parameters p (spectra x all parameters)."""
    out, at = np.zeros((len(p), len(e))), 0
    for part in parts:
        n = len(part.names())
        out += part.curve(e, p[:, at : at + n])
        at += n
    return out


def jacobian(e: np.ndarray, parts: list[Part], p: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Derivatives by the free parameters: spectra x channels x free; central differences within the part that has them."""
    out, at, column = np.zeros((len(p), len(e), int(free.sum()))), 0, 0
    for part in parts:
        n = len(part.names())
        own = p[:, at : at + n]
        for i in np.flatnonzero(free[at : at + n]):
            h = np.maximum(np.abs(own[:, i]), 1e-3) * 6e-6
            up, down = own.copy(), own.copy()
            up[:, i] += h
            down[:, i] -= h
            out[:, :, column] = (part.curve(e, up) - part.curve(e, down)) / (2 * h)[:, None]
            column += 1
        at += n
    return out


def fit_batch(e: np.ndarray, v: np.ndarray, w: np.ndarray, parts: list[Part], steps: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, their errors, chi squared over the degrees of freedom and whether it converged, for spectra v with weights w."""
    p = np.concatenate([part.starts(e, v) for part in parts], 1)
    lo, hi = (np.array(sum((list(part.bounds()[i]) for part in parts), [])) for i in (0, 1))
    free = np.array([n not in part.fixed for part in parts for n in part.names()])
    p[:, free] = np.clip(p[:, free], lo[free], hi[free])
    k, damp, done = int(free.sum()), np.full(len(p), 1e-3), np.zeros(len(p), bool)
    cost = (w * (model_curves(e, parts, p) - v) ** 2).sum(1)
    for _ in range(steps):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        q, weight = p[at], w[at]
        j = jacobian(e, parts, q, free)
        r = model_curves(e, parts, q) - v[at]
        a = np.einsum("rnk,rn,rnl->rkl", j, weight, j)
        g = np.einsum("rnk,rn->rk", j, weight * r)
        x = q[:, free]
        rests = ((x <= lo[free]) & (g > 0)) | ((x >= hi[free]) & (g < 0))
        diag = np.einsum("rkk->rk", a)
        a = a + np.eye(k) * (damp[at, None] * np.maximum(diag, 1e-300))[:, None, :]
        a = np.where(rests[:, :, None] | rests[:, None, :], np.eye(k), a)
        scale = 1 / np.sqrt(np.maximum(np.einsum("rkk->rk", a), 1e-300))
        step = scale * np.linalg.solve(a * scale[:, :, None] * scale[:, None, :] + 1e-14 * np.eye(k), (np.where(rests, 0.0, -g) * scale)[:, :, None])[:, :, 0]
        new = q.copy()
        new[:, free] = np.clip(x + step, lo[free], hi[free])
        now = (weight * (model_curves(e, parts, new) - v[at]) ** 2).sum(1)
        better = now < cost[at]
        small = (np.abs(new[:, free] - x) <= 1e-10 * np.maximum(np.abs(x), 1e-6)).all(1)
        flat = better & (cost[at] - now <= 1e-14 * np.maximum(cost[at], 1e-300)) & (damp[at] < 1e-6)
        done[at] = small | flat | (damp[at] > 1e12)
        keep = at[better]
        p[keep], cost[keep] = new[better], now[better]
        damp[at] = np.where(better, np.maximum(damp[at] / 5, 1e-12), damp[at] * 4)
    dof = np.maximum((w > 0).sum(1) - k, 1)
    chi2 = cost / dof
    errors = np.zeros_like(p)
    j = jacobian(e, parts, p, free)
    a = np.einsum("rnk,rn,rnl->rkl", j, w, j)
    scale = 1 / np.sqrt(np.maximum(np.einsum("rkk->rk", a), 1e-300))
    inverse = np.linalg.pinv(a * scale[:, :, None] * scale[:, None, :]) * scale[:, :, None] * scale[:, None, :]
    errors[:, free] = np.sqrt(np.maximum(np.einsum("rkk->rk", inverse) * chi2[:, None], 0.0))
    return p, errors, chi2, done


def spectra_rows(cube: DataFrame, *keys: str) -> DataFrame:
    """A row for each spectrum of a cube or sum spectrum: keys, e, v (arrays by channel)."""
    pairs = F.array_sort(F.collect_list(F.struct("ch", "e", "v")))
    return cube.groupBy(*keys).agg(pairs.alias("p")).select(*keys, F.transform("p", lambda p: p["e"]).alias("e"), F.transform("p", lambda p: F.coalesce(p["v"].cast("double"), F.lit(0.0))).alias("v"))


FITTED = "params array<double>, errors array<double>, areas array<double>, chi2 double, r2 double, converged boolean"


def fit_spectra(rows: DataFrame, parts: list[Part], weights: str | None = None, fit_range: tuple[float, float] | None = None, steps: int = 200) -> DataFrame:
    """Fits of a model to each spectrum: the keys of rows (spectra_rows()), params, errors (one sigma), areas (of the peaks),
    chi2 (over the degrees of freedom), r2 (over the fitted channels), converged.

    weights: None (even) or 'poisson' (1 over the counts, 1 at least). fit_range: energies that count, both ends included; fewer
    than two channels within it raise. Fixed parameters have the error 0. An empty table gives an empty result.
    """
    if weights not in (None, "poisson"):
        raise ValueError("weights must be None or 'poisson'")
    keys = [f for f in rows.schema.fields if f.name not in ("e", "v")]
    total = sum(len(part.names()) for part in parts)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(b.column("e").to_pylist(), b.column("v").to_pylist(), strict=True)]
            out: list = [None] * len(lists)
            axes: dict[bytes, list[int]] = {}
            for i, (x, _) in enumerate(lists):
                axes.setdefault(x.tobytes(), []).append(i)
            for own in axes.values():
                e = lists[own[0]][0]
                used = np.ones(len(e), bool) if fit_range is None else (e >= fit_range[0]) & (e <= fit_range[1])
                if used.sum() < 2:
                    raise ValueError("the fitted range holds fewer than two channels")
                size = max(1, HELD // (int(used.sum()) * total))
                for s in range(0, len(own), size):
                    some = own[s : s + size]
                    v = np.stack([lists[i][1] for i in some])[:, used]
                    w = np.ones_like(v) if weights is None else 1 / np.maximum(v, 1.0)
                    p, err, chi2, ok = fit_batch(e[used], v, w, parts, steps)
                    rest = ((model_curves(e[used], parts, p) - v) ** 2).sum(1)
                    var = ((v - v.mean(1, keepdims=True)) ** 2).sum(1)
                    r2 = np.where(var > 0, 1 - rest / np.maximum(var, 1e-300), 0.0)
                    areas, at = [], 0
                    for part in parts:
                        n = len(part.names())
                        if n >= 3 and part.kind not in ("polynomial", "self_affine"):
                            areas.append(part.area(p[:, at : at + n]))
                        at += n
                    areas = np.stack(areas, 1) if areas else np.zeros((len(some), 0))
                    for i, row in zip(some, zip(p.tolist(), err.tolist(), areas.tolist(), chi2.tolist(), r2.tolist(), ok.tolist(), strict=True), strict=True):
                        out[i] = row
            names = [n.split()[0] for n in FITTED.split(", ")]
            kinds = [pa.list_(pa.float64())] * 3 + [pa.float64(), pa.float64(), pa.bool_()]
            columns = [pa.array([o[c] for o in out], kinds[c]) for c in range(6)]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keys], *columns], names=[*[f.name for f in keys], *names])

    return rows.mapInArrow(fit, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", " + FITTED)


def fit_self_affine(differences: DataFrame, keys: tuple[str, ...], rough: float = 1.0, length: float = 5.0) -> DataFrame:
    """Growth of height differences g with lag (as measure.hhcf() gives them): keys, rough, length, hurst, noise, r2.

    The model is 2 noise^2 + 2 rough^2 (1 - exp(-(lag / length)^(2 hurst))); rough and length start where they are given.
    """
    rows = spectra_rows(differences.select(*keys, F.col("lag").alias("ch"), F.col("lag").cast("double").alias("e"), F.col("g").alias("v")), *keys)
    got = fit_spectra(rows, [Part("s", "self_affine", (rough, length, 0.8, 0.01))])
    names = ("rough", "length", "hurst")
    return got.select(*keys, *[F.col("params")[i].alias(n) for i, n in enumerate(names)], F.sqrt(F.col("params")[3]).alias("noise"), "r2")


def peak_parts(cube: DataFrame, elements: list[str], beam_kv: float = 200.0, center_tol: float = 0.0, lorentzian: float = 0.0) -> list[tuple[Part, str, float]]:
    """A peak for each element that has a line: the part, its line and energy. Widths are the detector's and stay."""
    lines = principal_lines(line_table(cube.sparkSession, elements), beam_kv).select("symbol", "line", "energy", (fano_fwhm(F.col("energy")) / FWHM / 1000).alias("sigma")).collect()
    by = {r["symbol"]: r for r in lines}
    out = []
    for s in elements:
        if s in by:
            r = by[s]
            fixed = ("sigma", "gamma") if center_tol > 0 else ("center", "sigma", "gamma")
            kind, start = ("voigt", (None, r["energy"], r["sigma"], lorentzian)) if lorentzian > 0 else ("gaussian", (None, r["energy"], r["sigma"]))
            out.append((Part(s, kind, start, (0.0, r["energy"] - center_tol), (INF, r["energy"] + center_tol), fixed), r["line"], r["energy"]))
    return out


def fit_peaks(cube: DataFrame, elements: list[str], keys: tuple[str, ...] = ("ds_id",), beam_kv: float = 200.0, background: tuple[Part, ...] = (), weights: str | None = "poisson", center_tol: float = 0.0, lorentzian: float = 0.0) -> DataFrame:
    """Peaks of elements fitted together to each spectrum by `keys`: keys, symbol, line, energy, net, net_sigma, chi2.

    Elements without a line have no row; without any it raises. Peaks are Gaussians of the detector's width, or Voigt profiles
    of a natural half width; centers may move by center_tol keV.
    """
    found = peak_parts(cube, elements, beam_kv, center_tol, lorentzian)
    if not found:
        raise ValueError("no line of these elements")
    parts = [*background, *[p for p, _, _ in found]]
    first = sum(len(p.names()) for p in background)
    wide = len(found[0][0].names())
    peaks_before = sum(len(p.names()) >= 3 and p.kind != "polynomial" for p in background)
    got = fit_spectra(spectra_rows(cube, *keys), parts, weights)
    rows = []
    for i, (p, line, energy) in enumerate(found):
        area = F.col("areas")[peaks_before + i]
        share = F.coalesce(F.try_divide(F.col("errors")[first + i * wide], F.col("params")[first + i * wide]), F.lit(0.0))
        unit = float(p.area(np.array([[1.0, *p.start[1:]]]))[0])
        sigma = F.when(F.lit(center_tol > 0), F.abs(area) * share).otherwise(F.col("errors")[first + i * wide] * unit)
        rows.append(F.struct(F.lit(p.name).alias("symbol"), F.lit(line).alias("line"), F.lit(energy).alias("energy"), area.alias("net"), sigma.alias("net_sigma")))
    return got.select(*keys, "chi2", F.explode(F.array(*rows)).alias("_part")).select(*keys, "_part.*", "chi2")


def quantify_peaks(cube: DataFrame, elements: list[str], keys: tuple[str, ...] = ("ds_id",), **how) -> DataFrame:
    """Composition from fitted peaks by the factors of the elements: keys, symbol, net, weight_pct, atomic_pct."""
    from pyspark.sql import Window as W

    fitted = fit_peaks(cube, elements, keys, **how)
    known = F.broadcast(cube.sparkSession.createDataFrame([(s, K_FACTORS.get(s, 1.0), MASSES.get(s, 1.0)) for s in elements], "symbol string, k double, mass double"))
    q = F.greatest(F.col("net"), F.lit(0.0)) * F.col("k")
    w = W.partitionBy(*keys)
    share = lambda c: F.coalesce(100 * F.try_divide(c, F.sum(c).over(w)), F.lit(0.0))
    return fitted.join(known, "symbol").select(*keys, "symbol", "net", share(q).alias("weight_pct"), share(q / F.col("mass")).alias("atomic_pct"))


def edge_parts(edges: list[tuple[str, str, float]], e: np.ndarray, e0_kv: float, beta_mrad: float) -> list[Part]:
    """An edge for each (element, shell, onset), all scaled alike so that the strongest shape has a height of 1 on the axis."""
    tops = [float(edge_shape(e, shell, onset, e0_kv, beta_mrad).max()) for _, shell, onset in edges]
    scale = 1 / max([t for t in tops if t > 0] or [1.0])
    return [Part(f"{s}_{shell}", "edge", (None,), settings={"shell": shell, "onset": onset, "e0_kv": e0_kv, "beta_mrad": beta_mrad, "scale": scale}) for s, shell, onset in edges]


def _axis(cube: DataFrame) -> np.ndarray:
    """Energies of a cube's channels, which all its spectra share."""
    return np.array([r["e"] for r in cube.groupBy("ch").agg(F.first("e").alias("e")).orderBy("ch").collect()])


def fit_edges(cube: DataFrame, edges: list[tuple[str, str, float]], e0_kv: float, beta_mrad: float, fit_range: tuple[float, float] | None = None, keys: tuple[str, ...] = ("ds_id",), weights: str | None = None) -> DataFrame:
    """A power law and all edges (element, shell, onset in the units of e) fitted together to each spectrum: keys, element,
    amount, amount_sigma, atomic_pct, exponent, chi2, r2. Without a range all channels above 0 from the first one on count.
    """
    axis = _axis(cube)
    span = fit_range or (float(axis[axis > 0].min()), float(axis.max()))
    law = Part("background", "power_law", (None, None), settings={"below": min(o for _, _, o in edges)})
    got = fit_spectra(spectra_rows(cube, *keys), [law, *edge_parts(edges, axis, e0_kv, beta_mrad)], weights, span)
    total = F.aggregate(F.slice("params", 3, len(edges)), F.lit(0.0), lambda a, b: a + b)
    rows = [F.struct(F.lit(s).alias("element"), F.col("params")[2 + i].alias("amount"), F.col("errors")[2 + i].alias("amount_sigma"), F.coalesce(100 * F.try_divide(F.col("params")[2 + i], total), F.lit(0.0)).alias("atomic_pct")) for i, (s, _, _) in enumerate(edges)]
    return got.select(*keys, F.explode(F.array(*rows)).alias("_part"), F.col("params")[1].alias("exponent"), "chi2", "r2").select(*keys, "_part.*", "exponent", "chi2", "r2")


def fit_edges_map(cube: DataFrame, edges: list[tuple[str, str, float]], e0_kv: float, beta_mrad: float, fit_range: tuple[float, float] | None = None, exponent: float | None = None) -> DataFrame:
    """Edges fitted to every pixel with one exponent of the background: ds_id, y, x, element, amount, atomic_pct.

    The exponent comes from the fit of all spectra's sum unless it is given, so each pixel is one linear system of the law's and the
    edges' amounts, solved from sums over its channels. Amounts below 0 count as 0.
    """
    axis = _axis(cube)
    span = fit_range or (float(axis[axis > 0].min()), float(axis.max()))
    if exponent is None:
        whole = cube.groupBy(F.lit("all").alias("ds_id"), "ch").agg(F.first("e").alias("e"), F.sum("v").alias("v"))
        exponent = fit_edges(whole, edges, e0_kv, beta_mrad, span).first()["exponent"]
    used = (axis >= span[0]) & (axis <= span[1])
    shapes = [np.maximum(axis, 1e-12) ** -exponent, *[p.curve(axis, np.ones((1, 1)))[0] for p in edge_parts(edges, axis, e0_kv, beta_mrad)]]
    design = np.stack(shapes, 1)[used]
    solve = np.linalg.pinv(design)  # unknowns x channels: bounded by the axis
    table = [(int(c), [float(v) for v in solve[:, i]]) for i, c in enumerate(np.flatnonzero(used))]
    at = cube.join(F.broadcast(cube.sparkSession.createDataFrame(table, "ch int, s array<double>")), "ch")
    sums = at.groupBy("ds_id", "y", "x").agg(*[F.greatest(F.lit(0.0), F.sum(F.col("v") * F.col("s")[1 + i])).alias(f"n{i}") for i in range(len(edges))])
    total = sum((F.col(f"n{i}") for i in range(len(edges))), F.lit(0.0))
    rows = [F.struct(F.lit(s).alias("element"), F.col(f"n{i}").alias("amount"), F.coalesce(100 * F.try_divide(F.col(f"n{i}"), total), F.lit(0.0)).alias("atomic_pct")) for i, (s, _, _) in enumerate(edges)]
    return sums.select("ds_id", "y", "x", F.explode(F.array(*rows)).alias("p")).select("ds_id", "y", "x", "p.*")


def measure_artifacts(cube: DataFrame, artifacts: DataFrame, keys: tuple[str, ...] = ("ds_id",)) -> DataFrame:
    """Net areas of sum and escape peaks (a bounded table: a, b, kind, energy) fitted together on a straight background: keys, kind, a, b, energy, net, net_sigma."""
    rows = artifacts.select("kind", "a", "b", "energy", (fano_fwhm(F.col("energy")) / FWHM / 1000).alias("sigma")).orderBy("energy", "a", "b").collect()
    if not rows:
        raise ValueError("no artifacts")
    parts = [Part("base", "polynomial", (None, 0.0)), *[Part(f"p{i}", "gaussian", (None, r["energy"], max(r["sigma"], 1e-3)), fixed=("center", "sigma")) for i, r in enumerate(rows)]]
    got = fit_spectra(spectra_rows(cube, *keys), parts, "poisson")
    out = [F.struct(F.lit(r["kind"]).alias("kind"), F.lit(r["a"]).alias("a"), F.lit(r["b"]).cast("string").alias("b"), F.lit(r["energy"]).alias("energy"), F.col("areas")[i].alias("net"), (F.col("errors")[2 + 3 * i] * max(r["sigma"], 1e-3) * math.sqrt(2 * math.pi)).alias("net_sigma")) for i, r in enumerate(rows)]
    return got.select(*keys, F.explode(F.array(*out)).alias("_part")).select(*keys, "_part.*")


def remove_artifacts(spectrum: DataFrame, measured: DataFrame) -> DataFrame:
    """Counts less the measured peaks, 0 at least: ds_id, ch, e, v. Peaks are spread over the channels by their width."""
    peaks = measured.where("net > 0").select("ds_id", "energy", "net", (fano_fwhm(F.col("energy")) / FWHM / 1000).alias("s"))
    curve = F.col("net") / (F.col("s") * math.sqrt(2 * math.pi)) * F.exp(-0.5 * F.pow((F.col("e") - F.col("energy")) / F.col("s"), F.lit(2)))
    off = spectrum.join(peaks, "ds_id").groupBy("ds_id", "ch").agg(F.sum(curve).alias("off"))
    return spectrum.join(off, ["ds_id", "ch"], "left").select("ds_id", "ch", "e", F.greatest(F.lit(0.0), F.col("v") - F.coalesce("off", F.lit(0.0))).alias("v"))
