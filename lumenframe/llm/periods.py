"""Runs of words that repeat periodically in a text (maximal repetitions), found by probing a harmonic grid.

For each period p the words at the places jp and (j+1)p are compared. A run of four periods or more holds four such places
in a row, so only these three equalities can be part of one; they are extended to both sides by comparing chunks of the
text with themselves p words later. Periods go upwards, and places within runs found before are left out: a run of a
smallest period p can't hold them. All periods of a text of n words take n log n comparisons. Texts of usual length probe
the whole grid at once, by a table of it; longer ones period by period, so memory stays a few numbers a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.arrays import raw_bytes
from lumenframe.llm.common import table

#: Words that are compared first on each side of a place, then four times as many, up to the second number.
CHUNK, MOST = 32, 1 << 16
#: Bytes of text that are worked on at once; words of the texts that the table of the grid covers.
SLICE, TABLE = 4 << 20, 1 << 14
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _equal_right(w: np.ndarray, i: int, p: int) -> int:
    """First place from i on whose word isn't that p places later."""
    end, size = len(w) - p, CHUNK
    while i < end:
        m = min(size, end - i)
        unlike = w[i : i + m] != w[i + p : i + p + m]
        k = int(unlike.argmax())
        if unlike[k]:
            return i + k
        i, size = i + m, min(size * 4, MOST)
    return i


def _equal_left(w: np.ndarray, i: int, p: int) -> int:
    """Smallest place from which all words up to place i are those p places later."""
    size = CHUNK
    while i > 0:
        m = min(size, i)
        unlike = (w[i - m : i] != w[i - m + p : i + p])[::-1]
        k = int(unlike.argmax())
        if unlike[k]:
            return i - k
        i, size = i - m, min(size * 4, MOST)
    return i


@cache
def _grid(times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places jp and periods p of the grid, by the last of `times` places from jp on; how many of them end before each place."""
    p = np.arange(1, TABLE // (times - 1) + 1)
    n = np.maximum(0, (TABLE - 1 - (times - 1) * p) // p + 1)
    period = np.repeat(p, n)
    at = (np.arange(len(period)) - np.repeat(np.cumsum(n) - n, n)) * period
    last = at + (times - 1) * period
    order = np.argsort(last, kind="stable")
    return at[order].astype(np.int32), period[order].astype(np.int32), np.searchsorted(last[order], np.arange(TABLE + 1))


def _hits(w: np.ndarray, times: int) -> Iterator[tuple[int, list[int]]]:
    """Periods, upwards, with the grid places at which `times` words in a row on the grid are equal."""
    n = len(w)
    if n <= TABLE:
        at, period, upto = _grid(times)
        at, period = at[: upto[n]], period[: upto[n]]
        hit = np.flatnonzero(w[at] == w[at + period])
        for i in range(1, times - 1):
            at, period = at[hit], period[hit]
            hit = np.flatnonzero(w[at + i * period] == w[at + (i + 1) * period])
        at, period = at[hit], period[hit]
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        edges = np.flatnonzero(np.diff(period, prepend=0, append=0))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(period[a]), at[a:b].tolist()
        return
    for p in range(1, n // times + 1):
        g = w[::p]
        same = g[1:] == g[:-1]
        m = len(same) - times + 2
        hit = same[:m] & same[1 : m + 1]
        for i in range(2, times - 1):
            hit &= same[i : m + i]
        if hit.any():
            yield p, (np.flatnonzero(hit) * p).tolist()


def periodic_runs(w: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of words (given as numbers), by start and period.

    A run has a smallest period p, max(least, times * p) words or more, and no neighbour that goes on with that period.
    """
    if times < 3:
        raise ValueError("a run must hold three periods at least")
    out: dict[tuple[int, int], int] = {}
    reach = None  # where the furthest run found over each place ends
    for p, places in _hits(w, times):
        upto = 0  # where the stretch of equal words that was extended last ends
        for at in places:
            if at < upto or (reach is not None and reach[at] > at + (times - 1) * p):
                continue
            start, upto = _equal_left(w, at, p), _equal_right(w, at, p)
            end = upto + p
            if end - start >= max(least, times * p) and (start, end) not in out:  # else it has a smaller period
                out[start, end] = p
                reach = np.zeros(len(w), np.int64) if reach is None else reach
                np.maximum(reach[start:end], end, out=reach[start:end])
    return sorted(((start, end - start, p) for (start, end), p in out.items()), key=lambda r: (r[0], r[2]))


def kept_parts(n: int, runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what stays of n words when each run is cut to its first period."""
    out, at = [], 0
    for a, b in sorted((s + p, s + length) for s, length, p in runs):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, n)] if at < n else out


class Words:
    """The words of many texts: equal ones have equal numbers, and any choice of them is written as texts again."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        solid = ~_SPACE[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inside = at[:-1][at[:-1] < len(data)]
        begins[inside] = solid[inside]
        starts = np.flatnonzero(begins)
        self.bytes = data[solid]
        self.at = np.append(np.cumsum(solid)[starts] - 1, len(self.bytes)).astype(np.int64)
        self.of_text = np.searchsorted(starts, at)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(self.at), pa.py_buffer(self.bytes)])
        self.numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def texts(self, chosen: list[np.ndarray]) -> pa.Array:
        """For each array of words (by their places among all) a text of these, joined by one space."""
        n = np.fromiter(map(len, chosen), np.int64, len(chosen))
        word = np.concatenate(chosen) if len(chosen) else np.zeros(0, np.int64)
        size = self.at[word + 1] - self.at[word]
        gap = np.ones(len(word), np.int64)
        gap[np.cumsum(n)[n > 0] - 1] = 0
        ends = np.append(0, np.cumsum(size + gap))
        out = np.full(ends[-1], 32, np.uint8)
        where = np.arange(size.sum()) + np.repeat(np.append(0, np.cumsum(gap))[:-1], size)
        out[where] = self.bytes[where + np.repeat(self.at[word] - ends[:-1], size)]
        offsets = ends[np.append(0, np.cumsum(n))].astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(chosen), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _run_lists(rows: list[list[tuple]]) -> pa.ListArray:
    flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 3)
    parts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rows])), pa.int32()), parts)


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4, choose: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per row of docs: id, n_words, runs (array of start, length, period by start and period) and collapsed.

    Words are runs of anything but ASCII white space; collapsed: the words left when every run is cut to its first period,
    joined by one space. choose(id, n) may give the places of the words to look at, in their order, instead of all n.
    A null or empty text has no words, no runs and an empty text. Rows that repeat an id are rows of their own, a null id
    stays null. An empty table gives an empty result. Other columns aren't read. Runs may overlap by less than two of the
    larger period.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw_bytes(batch.column("text"))
            ids = batch.column("id")
            edges = np.flatnonzero(np.diff(at[:-1] // SLICE, prepend=-1)).tolist() if len(ids) else []
            for i, j in zip(edges, [*edges[1:], len(ids)], strict=True):
                words = Words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                n, runs, kept = [], [], []
                for k in range(i, j):
                    a, b = int(words.of_text[k - i]), int(words.of_text[k - i + 1])
                    order = choose(ids[k].as_py(), b - a) if choose else None
                    order = np.arange(b - a) if order is None else order
                    found = periodic_runs(words.numbers[a + order] if choose else words.numbers[a:b], least, times)
                    n.append(len(order))
                    runs.append(found)
                    kept.append(a + (order if not found else np.concatenate([order[s:e] for s, e in kept_parts(len(order), found)])))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), _run_lists(runs), words.texts(kept).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return docs.mapInArrow(find, f"id {kind}, n_words long, runs {RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """The run with the greatest length; of several that with the smallest start, then period. Null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    return F.when(best.isNotNull(), F.struct(best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period")))


def repeated_tail(doc_id: object, n: int) -> np.ndarray | None:
    """For a tenth of the ids (crc32 of the id as text) the words from a place on are the first few of them again and again."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = word_runs(table(spark, sf_dir, "documents"), choose=repeated_tail).withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')])),
             lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END)) AS h
  FROM documents
), t AS (
  SELECT doc_id, w, len(w)::BIGINT AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), x AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] FOR i IN range(n)] ELSE w END AS w FROM t
), e AS MATERIALIZED (
  SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM x
), pr AS (
  SELECT a.doc_id, b.i - a.i AS p, a.i FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND (b.i - a.i) * 4 <= a.n
), st AS MATERIALIZED (
  SELECT doc_id, p, min(i) AS s, count(*) + p AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM pr)
  GROUP BY doc_id, p, k HAVING count(*) + p >= greatest(6, 4 * p)
), r AS MATERIALIZED (
  SELECT * FROM st a WHERE NOT EXISTS (SELECT 1 FROM st b WHERE b.doc_id = a.doc_id AND b.s = a.s AND b.l = a.l AND b.p < a.p AND a.p % b.p = 0)
), q AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, l := l, p := p), (-l, s, p)) AS best, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM r GROUP BY doc_id
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = e.doc_id AND e.i >= r.s + r.p AND e.i < r.s + r.l) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM x LEFT JOIN q USING (doc_id) LEFT JOIN k USING (doc_id)
"""
