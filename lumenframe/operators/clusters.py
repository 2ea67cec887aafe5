"""Clusters of rows of features (an array column): k-means, sublattices of columns, decomposition into spectra.

Centres, Gram matrices and spectra go by the number of features and clusters, so the driver may hold them; rows are read
by one aggregate a step and never gathered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.learning import standardize
from lumenframe.operators.raster import DS
from lumenframe.session import materialize


@dataclass(frozen=True)
class Clusters:
    """centres: of clusters 1 to k; inertia: sum of squared distances to the own centre; steps: rounds that were taken."""

    centres: list[list[float]]
    inertia: float
    steps: int


def _squared(features: str, centres: list[list[float]]) -> Column:
    """Squared distances of a row to all centres."""
    far = [sum((F.pow(F.col(features)[i] - c, F.lit(2)) for i, c in enumerate(centre)), F.lit(0.0)) for centre in centres]
    return F.array(*far)


def _nearest(features: str, centres: list[list[float]]) -> Column:
    far = _squared(features, centres)
    return F.array_position(far, F.array_min(far)).cast("int")


def _share(key: Column, *salt: int) -> Column:
    """A number between 0 and 1 (both excluded) for each row."""
    return (F.pmod(F.xxhash64(key, *map(F.lit, salt)), F.lit((1 << 52) - 1)) + 1) / float(1 << 52)


def kmeans_starts(rows: DataFrame, k: int, key: str = "id", features: str = "features", seed: int = 0) -> list[list[float]]:
    """k-means++ starts: the next one is a row with a chance by its squared distance to the nearest so far.

    Each row has a key of -ln(u) over that square, u from a hash of its id; the row with the smallest key is drawn, so a
    start takes one aggregate. Where all rows are starts already, one is drawn evenly.
    """
    centres: list[list[float]] = []
    for j in range(k):
        wait = -F.log(_share(F.col(key), seed, j))
        if centres:
            d2 = F.array_min(_squared(features, centres))
            wait = F.struct((d2 <= 0).alias("same"), F.when(d2 > 0, wait / d2).otherwise(wait).alias("wait"))
        first = rows.agg(F.min_by(features, wait).alias("f")).first()["f"]
        if first is None:
            raise ValueError("no rows")
        centres.append([float(v) for v in first])
    return centres


def kmeans(rows: DataFrame, k: int, key: str = "id", features: str = "features", steps: int = 100, tolerance: float = 1e-4, seed: int = 0, replicates: int = 1, starts: list[list[float]] | None = None) -> Clusters:
    """Lloyd's k-means, the best of some replicates by inertia. Rows without features, or with a null among them, are left out.

    A step is one aggregate: counts and means by nearest centre (the first of equally near ones). A cluster without rows goes
    on from a row drawn by a hash. Stops when no centre's coordinate moves by the tolerance or more.
    """
    rows = materialize(rows.where(F.col(features).isNotNull() & ~F.exists(features, lambda v: v.isNull())).select(key, features), "kmeans-rows")
    best = None
    for rep in range(1 if starts else replicates):
        centres, done = starts or kmeans_starts(rows, k, key, features, seed + rep), 0
        width = len(centres[0])
        for done in range(1, steps + 1):
            t = rows.select(key, features, _nearest(features, centres).alias("c"))
            means = {r["c"]: r for r in t.groupBy("c").agg(*[F.avg(F.col(features)[i]).alias(f"m{i}") for i in range(width)]).collect()}
            new = []
            for c in range(k):
                if c + 1 in means:
                    new.append([means[c + 1][f"m{i}"] for i in range(width)])
                else:
                    new.append([float(v) for v in rows.agg(F.min_by(features, _share(F.col(key), seed + rep, done, c)).alias("f")).first()["f"]])
            moved = max(abs(a - b) for p, q in zip(new, centres, strict=True) for a, b in zip(p, q, strict=True))
            centres = new
            if moved < tolerance:
                break
        inertia = rows.agg(F.sum(F.array_min(_squared(features, centres))).alias("s")).first()["s"] or 0.0
        if best is None or inertia < best.inertia:
            best = Clusters(centres, inertia, done)
    return best


def cluster_of(rows: DataFrame, found: Clusters, features: str = "features") -> DataFrame:
    """Adds cluster (from 1; null without features) and distance to its centre."""
    far = _squared(features, found.centres)
    return rows.withColumn("cluster", F.when(F.col(features).isNotNull(), _nearest(features, found.centres))).withColumn("distance", F.sqrt(F.array_min(far)))


def sublattices(columns: DataFrame, k: int, key: str = "id", features: str = "features", seed: int = 0, starts: list[list[float]] | None = None, steps: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """Adds sublattice from 1 to columns by k-means over standardised features; 1 has the largest mean of the first feature."""
    if k == 1:
        return columns.withColumn("sublattice", F.lit(1))
    width = len(columns.select(features).where(F.col(features).isNotNull()).first()[0])
    means, devs = standardize(columns.where(F.col(features).isNotNull()), width, features)
    z = columns.withColumn("_z", F.when(F.col(features).isNotNull(), F.array(*[(F.col(features)[i] - m) / d for i, (m, d) in enumerate(zip(means, devs, strict=True))])))
    found = kmeans(z.select(F.col(key), F.col("_z")), k, key, "_z", steps, tolerance, seed, starts=starts)
    t = cluster_of(z, found, "_z")
    level = {r["cluster"]: r["m"] for r in t.where("cluster is not null").groupBy("cluster").agg(F.avg(F.col(features)[0]).alias("m")).collect()}
    order = sorted(range(1, k + 1), key=lambda c: (-level.get(c, -math.inf), c))
    number = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i + 1)])
    return t.withColumn("sublattice", number[F.col("cluster")]).drop("cluster", "distance", "_z")


@dataclass(frozen=True)
class Spectra:
    """Components of one cube: spectra[j] over the channels, singular values, shares of the variation in percent, mean spectrum."""

    spectra: list[list[float]]
    singular: list[float]
    shares: list[float]
    mean: list[float]


def gram(cube: DataFrame, centred: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Matrix of sums of products of channels over the pixels of one cube, mean spectrum, number of pixels.

    A pixel's spectrum is one array, bounded by the channels; the products are added by one aggregate of channels squared rows.
    Channels that a pixel lacks count as 0.
    """
    ends = cube.agg(F.max("ch").alias("m"), F.count_distinct(DS).alias("n")).first()
    if ends["m"] is None or ends["n"] != 1:
        raise ValueError("a decomposition takes one cube with pixels")
    width = ends["m"] + 1
    pixels = materialize(spectra_of(cube, width), "gram-pixels")
    s = pixels.agg(F.count("*").alias("n"), *[F.avg(F.col("f")[i]).alias(f"m{i}") for i in range(width)]).first()
    mean = np.array([s[f"m{i}"] for i in range(width)]) if centred else np.zeros(width)
    off = F.zip_with("f", F.array(*[F.lit(float(v)) for v in mean]), lambda a, b: a - b)
    pairs = pixels.select(off.alias("d")).select("d", F.posexplode("d").alias("i", "a")).select("i", F.transform("d", lambda b: b * F.col("a")).alias("p"))
    rows = pairs.groupBy("i").agg(*[F.sum(F.col("p")[j]).alias(f"g{j}") for j in range(width)])
    out = np.zeros((width, width))
    for r in rows.collect():
        out[r["i"]] = [r[f"g{j}"] for j in range(width)]
    return out, mean, s["n"]


def spectra_of(cube: DataFrame, width: int) -> DataFrame:
    """A row for each pixel: ds_id, y, x, f (its values by channel, 0 where it has none)."""
    by = F.map_from_entries(F.collect_list(F.struct("ch", "v")))
    return cube.where(F.col("v").isNotNull()).groupBy(DS, "y", "x").agg(by.alias("m")).select(DS, "y", "x", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0))).alias("f"))


def decompose(cube: DataFrame, components: int = 0, centred: bool = True) -> Spectra:
    """Components of the spectra of one cube, strongest first (20 at most, or as many as asked for).

    Eigenvectors of the Gram matrix, which is as large as the channels squared, are found on the driver. The largest entry
    of each is positive. Scores of pixels are projections(), and projections of few components are the cube without noise.
    """
    g, mean, n = gram(cube, centred)
    if n < 2:
        raise ValueError("a decomposition takes two pixels")
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    k = min(components or 20, n, len(values))
    total = float(values.sum())
    lead = np.abs(vectors[:, :k]).argmax(0)
    spectra = vectors[:, :k] * np.where(vectors[lead, np.arange(k)] < 0, -1.0, 1.0)
    shares = 100 * values[:k] / total if total > 0 else np.zeros(k)
    return Spectra(spectra.T.tolist(), np.sqrt(values[:k]).tolist(), shares.tolist(), mean.tolist())


def projections(cube: DataFrame, found: Spectra) -> DataFrame:
    """Score maps: ds_id, y, x, component (from 1), v."""
    width = len(found.mean)
    table = [(ch, [s[ch] for s in found.spectra], found.mean[ch]) for ch in range(width)]
    t = cube.join(F.broadcast(cube.sparkSession.createDataFrame(table, "ch int, s array<double>, m double")), "ch")
    sums = [F.sum(F.col("v") * F.col("s")[j]).alias(f"p{j}") for j in range(len(found.spectra))]
    base = [sum(s[ch] * found.mean[ch] for ch in range(width)) for s in found.spectra]
    p = t.groupBy(DS, "y", "x").agg(*sums)
    return p.select(DS, "y", "x", F.posexplode(F.array(*[F.col(f"p{j}") - b for j, b in enumerate(base)])).alias("component", "v")).withColumn("component", F.col("component") + 1)


def denoised(cube: DataFrame, found: Spectra) -> DataFrame:
    """The cube as its components give it: ds_id, y, x, ch, e, v."""
    scores = projections(cube, found).groupBy(DS, "y", "x").agg(F.sort_array(F.collect_list(F.struct("component", "v"))).alias("p"))
    table = [(ch, [s[ch] for s in found.spectra], found.mean[ch]) for ch in range(len(found.mean))]
    t = cube.drop("v").join(scores, [DS, "y", "x"]).join(F.broadcast(cube.sparkSession.createDataFrame(table, "ch int, s array<double>, m double")), "ch")
    back = F.aggregate(F.zip_with("p", "s", lambda p, s: p["v"] * s), F.lit(0.0), lambda a, b: a + b)
    return t.select(DS, "y", "x", "ch", "e", (back + F.col("m")).alias("v"))
