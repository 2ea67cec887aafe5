"""MinHash near-dedup with HyperMinHash registers.

A document is the set of hashes of its word shingles. The top 7 bits of a hash choose one of 128 buckets; of the
smallest hash in a bucket the register keeps the number of leading zeros (6 bits) and the 10 bits after the first one.
Bands of registers are the keys of buckets of candidates. Documents with equal sets are one class from the start.

1. In each candidate bucket the smallest member is its centre. Each document is checked on full sets against the centre
   that it shares most buckets with, which joins most groups of copies at one check a document; components are found.
2. Where a bucket still holds more than one component, members are checked against its centre if theirs differs.
3. Buckets that still hold more than one component are compared within: pairs of different components, by their sizes
   and by the Jaccard estimate from registers, corrected for chance collisions. Each member's most similar partners come
   first, in windows that grow until no pair is left, so every pair is checked or already connected. Places in a window
   change as components merge and blocks are dealt anew, so a round takes all pairs in it and leaves out those already
   checked by comparing with a table of them. A bitmap of
   element parities rules out pairs whose sets differ in too many elements: the bits in which two bitmaps differ are at
   most as many as the elements in which the sets differ, so no link is lost. Each round goes on with the buckets of
   which the one before left pairs beyond its window, if they hold more than one component.
   A bucket with more members than a block is first cut into smaller ones: with the elements of all sets in one order,
   those of few sets first, sets that link share an element near the front of both. So its members meet in the buckets
   of these elements, of which each has as many as its size allows, and not all with all. Members that don't link
   differ in elements of their own, which come first, so most buckets have one member and are gone. Only what is in
   an element's bucket of more than a block is compared block by block.

No pairs within a component are made, so a large group of near copies costs about as many checks as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.arrays import symbols, words
from lumenframe.llm.common import components, mix64, table
from lumenframe.llm.exact import build_filter, filter_bits, probe_filter
from lumenframe.llm.tokens import slices
from lumenframe.session import drop_table, materialize

P_BITS, MANTISSA = 7, 10
BUCKETS = 1 << P_BITS
#: E[equal registers by chance] for sets much larger than the buckets: COLLIDE * 2^(p - r + 1).
COLLIDE = 0.169919487159739
#: Bits of a set's bitmap of parities.
PARITY = 2048
#: Counters of the sets that hold an element; elements share them.
COUNTERS, PARTS = 1 << 17, 16


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of hashes of all runs of k words (with fewer words, of the whole sequence) of each text: the hashes, sorted
    within each text, and the place where each text's begin, and the last one's end."""
    s, at = symbols(column)
    w = words(s)
    h, first = w.hash(), w.per_text(at)
    n = np.diff(first)
    own, hashes = [], []
    for size in range(1, k + 1):
        some = np.flatnonzero(n >= size if size == k else n == size)
        if not len(some):
            continue
        count = n[some] - size + 1
        place = np.arange(count.sum()) + np.repeat(first[some] - (np.cumsum(count) - count), count)
        x = np.full(len(place), 0x9E3779B97F4A7C15, np.uint64)
        for i in range(size):
            x = mix64(x * np.uint64(0x2545F4914F6CDD1D) + h[place + i])
        own.append(np.repeat(some, count))
        hashes.append(x)
    if not own:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    o, x = np.concatenate(own), np.concatenate(hashes)
    order = np.lexsort((x, o))
    o, x = o[order], x[order]
    new = np.append(True, (x[1:] != x[:-1]) | (o[1:] != o[:-1]))
    o, x = o[new], x[new]
    return x, np.searchsorted(o, np.arange(len(n) + 1))


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sets of hashes (sorted within each set): sets x buckets; 0 for an empty bucket."""
    out = np.zeros((len(at) - 1, BUCKETS), np.uint16)
    if not len(hashes):
        return out
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bucket = (hashes >> np.uint64(64 - P_BITS)).astype(np.int64)
    least = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])))
    low = hashes[least] & np.uint64((1 << (64 - P_BITS)) - 1)
    exponent = np.frexp(np.maximum(low, 1).astype(np.float64))[1] - 1
    shift = exponent - MANTISSA
    mantissa = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64), low << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out[own[least], bucket[least]] = ((64 - P_BITS - exponent).astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)
    return out


def parities(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """PARITY bits as bytes for each set: bit i tells whether an odd number of hashes is i modulo PARITY."""
    n = len(at) - 1
    own = np.repeat(np.arange(n), np.diff(at))
    odd = np.bincount(own * PARITY + (hashes & np.uint64(PARITY - 1)).astype(np.int64), minlength=n * PARITY) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, PARITY), axis=1)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and the number of buckets that they rest on."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    chance = COLLIDE * 2.0 ** (P_BITS - MANTISSA + 1) * used / BUCKETS
    return np.clip((equal - chance) / np.maximum(used - chance, 1e-9), 0, 1), used


def band_keys(regs: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band with a full register. regs: documents x buckets."""
    bands = BUCKETS // rows
    keys = np.tile(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(regs), 1))
    some = np.zeros(keys.shape, bool)
    for r in range(rows):  # a band takes registers spread over the buckets
        part = regs[:, r * bands : (r + 1) * bands]
        keys = mix64(keys * np.uint64(0x2545F4914F6CDD1D) + part.astype(np.uint64))
        some |= part != 0
    at = np.nonzero(some)
    return at[0], keys[at].view(np.int64)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array over the bytes of data, cut at the elements at."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * data.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of about a MB and at most so many rows."""
    for whole in batches:
        for b in slices(whole, 1 << 20):
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)


def shingle_sets(docs: DataFrame, k: int, what: str) -> DataFrame:
    """id, n, key, regs, parity (what='sketch') or id, members (what='set', the sorted hashes) of documents with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            s, at = shingles(b.column(1), k)
            if what == "set":
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(s.view(np.int64)))], ["id", "members"])
                continue
            raw, n = memoryview(s).cast("B") if len(s) else memoryview(b""), np.diff(at)
            key = [blake2b(raw[8 * i : 8 * j], digest_size=16).digest() if j > i else None for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            each = np.arange(len(n) + 1)
            regs, parity = _binary(registers(s, at).ravel(), each * BUCKETS), _binary(parities(s, at).ravel(), each * (PARITY // 8))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(key, pa.binary()), regs, parity], ["id", "n", "key", "regs", "parity"])

    return docs.mapInArrow(run, "id long, members array<long>" if what == "set" else "id long, n long, key binary, regs binary, parity binary")


def _bands(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                regs = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                row, key = band_keys(regs, rows)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], ["bucket", "id", "n"])

    return run


def plausible(n: tuple, regs: tuple, parity: tuple, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether two sets' sizes, parities and estimate allow a link, and the estimates (0 where the first two don't)."""
    differ = np.bitwise_count(parity[0] ^ parity[1]).sum(axis=1, dtype=np.int64)
    ok = (den * np.minimum(*n) >= num * np.maximum(*n)) & ((num + den) * differ <= (den - num) * (n[0] + n[1]))
    est, at, most = np.zeros(len(ok)), np.flatnonzero(ok), num / den
    est[at], used = estimate(regs[0][at], regs[1][at])
    ok[at] = est[at] >= most - 4 * np.sqrt(most * (1 - most) / np.maximum(used, 1))
    return ok, est


def _unpacked(regs: pa.Array, parity: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(regs.to_pylist()), np.uint16).reshape(-1, BUCKETS), np.frombuffer(b"".join(parity.to_pylist()), np.uint64).reshape(-1, PARITY // 64)


def _hopeful(num: int, den: int):
    """Pairs a, b, na, ra, pa, nb, rb, pb that may link -> a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (ra, pa_), (rb, pb) = _unpacked(b.column(3), b.column(4)), _unpacked(b.column(6), b.column(7))
            ok, _ = plausible((b.column(2).to_numpy(), b.column(5).to_numpy()), (ra, rb), (pa_, pb), num, den)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """members -> part, counts: how many elements of the sets of a task fall on each counter."""
    n = np.zeros(COUNTERS, np.int64)
    for b in _small(batches):
        n += np.bincount(b.column(0).flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
    if n.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(list(n.reshape(PARTS, -1)), pa.list_(pa.int64()))], ["part", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, counts of several tasks -> those of all."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for part, n in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            sums[part] = sums.get(part, 0) + n.values.to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["part", "counts"])


def held_by(sets: DataFrame) -> np.ndarray:
    """COUNTERS numbers: about how many of the sets hold an element, by its last bits."""
    added = sets.select("members").mapInArrow(_counted, "part int, counts array<long>").repartition("part").mapInArrow(_added, "part int, counts array<long>")
    out = np.zeros((PARTS, COUNTERS // PARTS), np.int64)
    for r in added.collect():  # COUNTERS numbers, however many sets
        out[r["part"]] = r["counts"]
    return out.ravel()


def _fronts(held: np.ndarray, num: int, den: int):
    """id, members -> bucket (an element), id, n, top: the elements that can be the first one shared with a set that links.

    Elements come in the order of held and then of their hashes. If the first that two sets share is at place p of one
    with n elements, they share n - p at most, so a link needs another set of top elements at most, and of num / den of n at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            x, n = b.column(1).flatten().to_numpy(), np.diff(b.column(1).offsets.to_numpy())
            own = np.repeat(np.arange(len(n)), n)
            x = x[np.lexsort((x, held[x & (COUNTERS - 1)], own))]
            size = n[own].astype(np.int64)
            top = (num + den) * (size - np.arange(len(x)) + np.repeat(np.cumsum(n) - n, n)) // num - size
            front = den * top >= num * size
            yield pa.RecordBatch.from_arrays([pa.array(x[front]), b.column(0).take(pa.array(own[front])), pa.array(size[front]), pa.array(top[front])], ["bucket", "id", "n", "top"])

    return run


@lru_cache(8)
def _pairs(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


def _compare(num: int, den: int, last: int):
    """Pairs of different components in each group of rows: g (group), bucket, side, id, n, comp, regs, parity, sorted by g.

    A group is a candidate bucket or, of a large one, one or two of its blocks (side tells which); yields a, b for pairs
    whose sizes, estimates and parities allow a link and that are among the last first by similarity for one of the two, and a row
    with the bucket alone if pairs beyond these are left in a group of it.
    """

    def close(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, comp, regs, parity = rows["n"], rows["comp"], rows["regs"], rows["parity"]
        for s in range(0, len(i), 20_000):
            a, b = i[s : s + 20_000], j[s : s + 20_000]
            keep = (comp[a] != comp[b]) & (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b]))
            a, b = a[keep], b[keep]
            ok, est = plausible((n[a], n[b]), (regs[a], regs[b]), (parity[a], parity[b]), num, den)
            yield a[ok], b[ok], est[ok]

    def ranks(group: np.ndarray, est: np.ndarray, other: np.ndarray) -> np.ndarray:
        order = np.lexsort((other, -est, group))
        g = group[order]
        starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
        r = np.empty(len(g), np.int64)
        r[order] = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
        return r

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        rows = {c: t.column(c).to_numpy() for c in ("bucket", "side", "id", "n", "comp")}
        rows["regs"], rows["parity"] = _unpacked(t.column("regs"), t.column("parity"))
        g = t.column("g").to_numpy()
        starts = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
        left = [np.zeros(0, np.int64)]

        def done(some: list) -> Iterator[pa.RecordBatch]:
            """What whole groups have: their pairs are gone before those of the next ones come."""
            i, j = (np.concatenate(x) for x in zip(*some, strict=True))
            some.clear()
            found = list(close(rows, i, j))
            if not found:
                return
            a, b, est = (np.concatenate(x) for x in zip(*found, strict=True))
            gid = np.searchsorted(starts, a, side="right")
            ia, ib = rows["id"][a], rows["id"][b]
            best = np.minimum(ranks(gid * (1 << 32) + a, est, ib), ranks(gid * (1 << 32) + b, est, ia))
            now = best < last
            left.append(np.unique(rows["bucket"][a[~now]]))
            ia, ib = ia[now], ib[now]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ia, ib)), pa.array(np.maximum(ia, ib)), pa.nulls(len(ia), pa.int64())], ["a", "b", "bucket"])

        some: list = []
        size = 0
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            side = rows["side"][s:e]
            if side.any():  # two blocks of one bucket: only pairs across
                i, j = np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij")
                i, j = i.ravel() + s, j.ravel() + s
            else:
                i, j = (x + s for x in _pairs(int(e - s)))
            some.append((i, j))
            size += len(i)
            if size > 400_000:
                yield from done(some)
                size = 0
        if some:
            yield from done(some)
        again = np.unique(np.concatenate(left))
        if len(again):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(again), pa.int64()), pa.nulls(len(again), pa.int64()), pa.array(again)], ["a", "b", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:  # whole groups go together: the last group of what is held waits for the next batch
            held.append(b)
            if sum(x.num_rows for x in held) >= 20_000:
                t = pa.Table.from_batches(held).combine_chunks()
                g = t.column("g").to_numpy()
                end = int(np.flatnonzero(g == g[-1])[0])
                if end:
                    yield from flush(t.slice(0, end).to_batches())
                held = t.slice(end).to_batches()
        if held:
            yield from flush(held)

    return run


def hyperminhash_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, rows: int = 4, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by the Jaccard similarity of their k-word shingles, num / den or more.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer than k words is one shingle; texts
    that are null or without words have none and link with nothing. Returns doc_id, n_shingles, component_id (smallest id reachable
    by links, its own included), kept (doc_id = component_id), one row per row that has an id; rows without one are left
    out. Rows that repeat an id count as one document that has all their links. An empty table gives an empty result.
    Links are confirmed on full sets (of 64-bit hashes). A link is missed if no band of rows registers agrees, with
    probability (1 - s^rows)^(128 div rows) at similarity s, or if the estimate is 4 deviations too low (about 3 in 100,000
    at the threshold, fewer above), and only where no other links connect the two. Other columns aren't read.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = materialize(shingle_sets(texts, k, "sketch"), "hmh-sketches")
    classes = materialize(sketches.where("n > 0").groupBy("key", "n", "regs", "parity").agg(F.min("id").alias("id")), "hmh-classes")
    buckets = materialize(classes.select("id", "n", "regs").mapInArrow(_bands(rows), "bucket long, id long, n long").select("bucket", "id"), "hmh-bands")

    def shared(buckets: DataFrame) -> DataFrame:
        """bucket, id, low, size of buckets of several documents; of those that hold the same ones only one."""
        prints = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"f{i}") for i in (0, 1)]
        several = buckets.groupBy("bucket").agg(F.min("id").alias("low"), F.count("*").alias("size"), *prints).where("size > 1")
        several = several.groupBy("low", "size", "f0", "f1").agg(F.min("bucket").alias("bucket"))
        return buckets.join(several, "bucket").select("bucket", "id", "low", "size")

    inside = materialize(shared(buckets), "hmh-inside")
    drop_table(buckets)
    members = inside.select(F.xxhash64("id").alias("digest")).distinct()
    bits = filter_bits(inside.agg(F.approx_count_distinct("id")).first()[0])
    wanted = probe_filter(texts.withColumn("digest", F.xxhash64("id")), build_filter(members, bits), bits)
    sets = materialize(shingle_sets(wanted.select("id", "text"), k, "set").where(F.size("members") > 0), "hmh-sets")
    regs = classes.select("id", "n", "regs", "parity")

    def verified(pairs: DataFrame) -> DataFrame:
        with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("sb")), "b")
        with_sets = with_b.join(sets.select(F.col("id").alias("a"), F.col("members").alias("sa")), "a")
        # den * both >= num * union, with both of the union's terms on one side
        linked = F.lit(num + den) * F.size(F.array_intersect("sa", "sb")) >= F.lit(num) * (F.size("sa") + F.size("sb"))
        return materialize(with_sets.where(linked).select(F.col("a").alias("src"), F.col("b").alias("dst")), "hmh-links")

    def hopeful(pairs: DataFrame) -> DataFrame:
        both = pairs.join(regs.selectExpr("id AS a", "n AS na", "regs AS ra", "parity AS pa"), "a").join(regs.selectExpr("id AS b", "n AS nb", "regs AS rb", "parity AS pb"), "b")
        return both.select("a", "b", "na", "ra", "pa", "nb", "rb", "pb").mapInArrow(_hopeful(num, den), "a long, b long")

    def merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
        """comps after more links: these are between components, of which only they are looked at."""
        if comps is None:
            return materialize(components(links), "hmh-comps")
        if links.isEmpty():
            return comps
        own = lambda c: comps.select(F.col("id").alias(c), F.col("component_id").alias(f"{c}_comp"))
        ends = links.join(own("src"), "src", "left").join(own("dst"), "dst", "left")
        joined = components(ends.select(F.coalesce("src_comp", "src").alias("src"), F.coalesce("dst_comp", "dst").alias("dst")))
        moved = comps.join(joined.selectExpr("id AS component_id", "component_id AS to"), "component_id", "left").select("id", F.coalesce("to", "component_id").alias("component_id"))
        # joined has the rows of documents that had no link before.
        return materialize(moved.union(joined).distinct(), "hmh-comps")

    def still_open(members: DataFrame, comps: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component: bucket, id, low, size, comp, c0 (the smallest one's)."""
        labelled = members.select("bucket", "id", "low", "size").join(comps.withColumnRenamed("component_id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket", "c0")
        return materialize(labelled.join(mixed, "bucket"), "hmh-open")

    def narrowed(wide: DataFrame) -> DataFrame:
        """bucket, id, low, size of buckets in which any two members of wide buckets meet that link: of elements at the front of both."""
        held = sets.join(wide.select("id").distinct(), "id").select("id", "members")
        fronts = materialize(held.mapInArrow(_fronts(held_by(held), num, den), "bucket long, id long, n long, top long"), "hmh-fronts")
        least = fronts.groupBy("bucket").agg(F.min("n").alias("least"), F.count("*").alias("size")).where("size > 1").select("bucket", "least")
        return shared(fronts.join(least, "bucket").where("top >= least").select("bucket", "id"))

    centres = inside.where("id <> low").repartition("id").groupBy("id", "low").agg(F.count("*").alias("times"))
    checked = materialize(centres.groupBy("id").agg(F.max_by("low", F.struct("times", -F.col("low"))).alias("a")).select("a", F.col("id").alias("b")), "hmh-pairs")
    comps = merged(None, verified(checked))
    open_ = still_open(inside, comps)
    drop_table(inside)
    low_comp = open_.where("id = low").select("bucket", F.col("comp").alias("low_comp"))
    others = open_.join(low_comp, "bucket").where("id <> low AND comp <> low_comp").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    pairs = materialize(hopeful(others.join(checked, ["a", "b"], "left_anti")), "hmh-pairs")
    if not pairs.isEmpty():
        comps = merged(comps, verified(pairs))
    # A pair that hopeful() leaves out is left out by _compare() too.
    checked = checked.union(pairs)
    open_, last, found = still_open(open_.where("size > 2"), comps), 4, None
    wide = open_.where(F.col("size") > block)
    if not wide.isEmpty():
        open_ = still_open(open_.where(F.col("size") <= block).select("bucket", "id", "low", "size").union(narrowed(wide)), comps)
    while True:
        if found is not None:
            open_ = still_open(open_, comps)
            drop_table(found)
        # A small bucket is one block. In a large one, blocks meet two by two, but members of the smallest component,
        # which have nothing to compare among themselves, have blocks of their own that meet only the others'.
        others = open_.where((F.col("size") > block) & (F.col("comp") != F.col("c0"))).groupBy("bucket").agg(F.count("*").alias("rest"))
        labelled = open_.join(others, "bucket", "left")
        large, in_c0 = F.col("rest").isNotNull(), F.col("comp") == F.col("c0")
        q = F.ceil(F.col("rest") / block).cast("int")
        p = F.ceil((F.col("size") - F.col("rest")) / block).cast("int")
        own = F.when(~large, 0).when(in_c0, F.pmod(F.xxhash64("id"), p)).otherwise(p + F.pmod(F.xxhash64("id"), q)).cast("int")
        low = F.when(large & in_c0, p).otherwise(0)
        high = F.when(large, p + q - 1).otherwise(0)
        spread = labelled.withColumn("own", own).withColumn("other", F.explode(F.sequence(low, high)))
        spread = spread.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "bucket", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "id", "comp")
        groups = spread.join(regs, "id").select("g", "bucket", "side", "id", "n", "comp", "regs", "parity").repartition("g").sortWithinPartitions("g", "id")
        found = materialize(groups.mapInArrow(_compare(num, den, last), "a long, b long, bucket long").distinct(), "hmh-found")
        again = found.where("a is null").select("bucket")
        pairs = materialize(found.where("a is not null").select("a", "b").join(checked, ["a", "b"], "left_anti"), "hmh-pairs")
        checked = checked.union(pairs)
        if not pairs.isEmpty():
            comps = merged(comps, verified(pairs))
        if again.isEmpty():
            break
        # A bucket whose pairs were all in the window is done: each is checked or within a component.
        open_, last = open_.join(again, "bucket"), last * 8
    drop_table(sets)
    drop_table(open_)
    drop_table(found)
    ids = sketches.select("id", "n", "key").join(classes.select("key", F.col("id").alias("rep")), "key", "left")
    ids = ids.join(comps.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    component = F.coalesce("component_id", "rep", "id")
    return ids.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op8_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash_components(table(spark, sf_dir, "documents"), k=3, num=85, den=100, rows=5)


OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)] END) AS shingle
  FROM w
),
n AS (SELECT doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
