"""What several of these operators share: words, word hashes, split folds and connected components."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def lower_ascii(text: str | None) -> str:
    """ascii_lower for Python strings."""
    if not text:
        return ""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds that learning and holding out go by."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


class WordHashes(dict):
    """64-bit hashes by word; the store is emptied when it has max_words, so its size stays bounded."""

    def __init__(self, max_words: int = 400_000):
        super().__init__()
        self.max_words = max_words

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) >= self.max_words:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; with fewer words, of the whole sequence; empty without words."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(min(k, len(words))):
        h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + words[i : i + n])
    return h


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: src, dst (long, any direction, self-links and repeats allowed). Returns id, component_id (smallest id
    reachable) for every id in edges. Each round is a minimum per node (taken before the shuffle) and a join for either
    star, so no node's neighbours meet in one task. Rounds end when all links are stars: no node has two smaller
    neighbours, or a smaller and a larger one. Links that are so from the start take no round: each round is a query of
    several jobs, which the driver plans and keeps record of.
    """
    e = edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = materialize(e, name)
    while True:
        role = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"))
        nodes = e.select(F.inline(F.array(role("u", 1), role("v", 0)))).groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        r = nodes.agg(F.count("*").alias("n"), F.count_if(F.col("ups") > F.col("least")).alias("open")).first()
        if not r["n"]:
            return edges.sparkSession.createDataFrame([], "id long, component_id long")
        if not r["open"]:
            break
        # A larger neighbour u of v goes to the smallest neighbour of v, or to v if none is smaller.
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        large = e.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = materialize(small.select(F.col("x.a").alias("u"), F.col("x.b").alias("v")).where("u <> v").distinct(), name)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(e.select(F.col("v"), F.col("v")).distinct())
