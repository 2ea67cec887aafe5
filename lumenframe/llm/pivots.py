"""Embedding near-dedup with a pivot-permutation index.

Pivots are a bounded sample of the vectors, thinned so that none are near each other: a large group of near copies has one
pivot, which all its members have, and not many of about equal nearness, of which each would have others. Every vector is described by its nearest pivots in order; an inverted list
per label and pivot holds the vectors that have it among them. Shared pivots are counted for each two vectors of a list;
those that share enough are candidates, and candidates are verified by their cosine in double precision. Lists are cut into blocks that meet two by two, so no task
holds a whole list; a pair is counted where its smallest shared pivot is, so once. Equal vectors are one class with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import components, table
from lumenframe.session import materialize

MIN_PIVOTS, MAX_PIVOTS = 32, 8192
#: Numbers that the sample for the pivots holds at most, and pivots of lengths that are none of the 16 commonest.
MOST_NUMBERS, RANDOM_PIVOTS = 1 << 25, 256
#: Vectors read for each pivot, so that enough are left of a sample that is mostly one group.
SAMPLE = 4


def choose_pivots(vectors: DataFrame, n: int, threshold: float) -> np.ndarray:
    """Up to n vectors by the smallest hash of their id, none within twice the linking angle of one before it: n x
    dimensions, unit length. Beyond 60 degrees nothing is left out."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * n).select("v").toArrow().column(0).combine_chunks()  # SAMPLE * MAX_PIVOTS at most
    p = sample.flatten().to_numpy().astype(np.float64).reshape(len(sample), -1)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    near = max(0.5, float(np.cos(min(np.pi, 2 * np.arccos(np.clip(threshold, -1, 1))))))
    kept, m = np.empty((n, p.shape[1])), 0
    for v in p:
        if m < n and (not m or (kept[:m] @ v).max() < near):
            kept[m] = v
            m += 1
    return kept[:m]


@lru_cache(64)
def random_pivots(d: int) -> np.ndarray:
    """RANDOM_PIVOTS directions of d dimensions, the same in every process."""
    p = np.random.default_rng(d).normal(size=(RANDOM_PIVOTS, d))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def _describe(pivots: dict[int, np.ndarray], nearest: int):
    """id, label, n, v -> pivots (sorted numbers of the nearest ones, i16 bytes), one row per pivot, and v as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(3)
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            ends = ends - ends[0]
            for d in np.unique(np.diff(ends)):
                at = np.flatnonzero(np.diff(ends) == d)
                x = np.stack([flat[ends[i] : ends[i + 1]] for i in at])
                p = pivots[int(d)] if int(d) in pivots else random_pivots(int(d))
                unit = x.astype(np.float64)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                near = np.sort(np.argsort(-(unit @ p.T), axis=1, kind="stable")[:, :nearest], axis=1).astype(np.int16)
                k = near.shape[1]
                take = pa.array(np.repeat(at, k))
                raw = pa.array([r.tobytes() for r in x], pa.binary()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                own = pa.array([r.tobytes() for r in near], pa.binary()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(np.full(len(take), d, np.int32)), pa.array(near.ravel().astype(np.int32)), own, raw], ["id", "label", "n", "dim", "pivot", "near", "raw"])

    return run


def _count_links(threshold: float, shared: int, dtype: np.dtype):
    """Links within groups of rows g, side, id, n, pivot, near, raw sorted by g -> id, links, root."""

    def group(t: pa.Table) -> pa.RecordBatch | None:
        side, ids, n = (t.column(c).to_numpy() for c in ("side", "id", "n"))
        pivot = t.column("pivot")[0].as_py()
        x = np.frombuffer(b"".join(t.column("raw").to_pylist()), dtype).reshape(len(ids), -1).astype(np.float64)
        near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.int16).reshape(len(ids), -1)
        norm = np.linalg.norm(x, axis=1)
        two = bool(side.any())
        i, j = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(ids)),) * 2
        if not len(i) or not len(j):
            return None
        pivots, column = np.unique(near, return_inverse=True)
        has = np.zeros((len(ids), len(pivots)), np.float32)
        np.put_along_axis(has, column.reshape(near.shape), 1.0, axis=1)
        before = int(np.searchsorted(pivots, pivot))
        hit = has[i] @ has[j].T >= min(shared, near.shape[1])
        hit &= has[i][:, :before] @ has[j][:, :before].T == 0  # else a list before this one has the pair
        if not two:
            np.fill_diagonal(hit, False)
        a, b = hit.any(axis=1), hit.any(axis=0)
        if not a.any():
            return None
        i, j, hit = i[a], j[b], hit[np.ix_(a, b)]
        hit &= (x[i] @ x[j].T) / np.outer(norm[i], norm[j]) >= threshold
        if not hit.any():
            return None
        links = np.zeros(len(ids), np.int64)
        links[i] += hit @ n[j]
        if two:
            links[j] += hit.T @ n[i]
        root, big = ids.copy(), np.iinfo(np.int64).max
        while True:
            old = root.copy()
            root[i] = np.minimum(root[i], np.where(hit, root[j][None, :], big).min(axis=1))
            root[j] = np.minimum(root[j], np.where(hit, root[i][:, None], big).min(axis=0))
            if (root == old).all():
                break
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], ["id", "links", "root"]) if some.any() else None

    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        g = t.column("g").to_numpy()
        starts = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s > 1 and (out := group(t.slice(int(s), int(e - s)).combine_chunks())) is not None:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 5_000:
                t = pa.Table.from_batches(held)
                g = t.column("g").to_numpy()
                end = int(np.flatnonzero(g == g[-1])[0])
                if end:
                    yield from flush(t.slice(0, end))
                held = t.slice(end).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def pivot_links(vectors: DataFrame, threshold: float = 0.98, nearest: int = 8, shared: int = 3, block: int = 1024, n_pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of one label (not null) with cosine >= threshold, and the components that they make.

    Returns one row per row: vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept
    (vec_id = component_id). Vectors that are null, empty, zero, or hold null or non-finite values link with nothing,
    nor do rows without an id; vectors of different lengths aren't compared. Rows that repeat an id count as vectors of
    their own in n_links and as one in components. Candidates share at least shared of their nearest pivots: the index
    is approximate (see the tests for its recall against brute force) and no link below the threshold is returned. The
    number of pivots grows with the root of the number of vectors, from 32 to 8192 (fewer where 4 times as many vectors
    have over 2^25 numbers), or is what SAMPLE times as many vectors have that aren't near each other; of lengths that are
    none of the 16 commonest, pivots are 256 random directions. A group of near copies is one pivot's list, so all its
    pairs are compared. An empty table gives an empty result; other columns aren't read.
    """
    spark = vectors.sparkSession
    wide = vectors.schema[vector_col].dataType.elementType
    kind = T.FloatType() if isinstance(wide, T.FloatType) else T.DoubleType()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(T.ArrayType(kind)).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(valid, F.col("v")))
    classes = materialize(rows.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "pivot-classes")
    dims = {r["d"]: r["c"] for r in classes.groupBy(F.size("v").alias("d")).count().withColumnRenamed("count", "c").orderBy(F.desc("c")).limit(16).collect()}
    pivots = {d: choose_pivots(classes.where(F.size("v") == d), n_pivots or int(np.clip(np.sqrt(c), MIN_PIVOTS, max(MIN_PIVOTS, min(MAX_PIVOTS, MOST_NUMBERS // (SAMPLE * d))))), threshold) for d, c in dims.items()}
    described = classes.select("id", "label", "n", "v").mapInArrow(_describe(pivots, nearest), "id long, label string, n long, dim int, pivot int, near binary, raw binary")
    described = materialize(described, "pivot-lists")
    sizes = described.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    lists = described.join(sizes, ["label", "dim", "pivot"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = lists.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("label", "dim", "pivot", F.least("own", "other"), F.greatest("own", "other"))
    groups = spread.select(key.alias("g"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "id", "n", "pivot", "near", "raw")
    dtype = np.dtype(np.float32 if isinstance(kind, T.FloatType) else np.float64)
    found = groups.repartition("g").sortWithinPartitions("g", "id").mapInArrow(_count_links(threshold, shared, dtype), "id long, links long, root long")
    found = materialize(found, "pivot-links")
    comps = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")), "pivot-cc")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "id", "left").join(comps, "id", "left").select("label", "v", F.col("id").alias("rep"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    component = F.coalesce("component_id", "rep", "id")
    out = rows.join(by_class, ["label", "v"], "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op2_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_links(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
