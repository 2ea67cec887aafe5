"""Line dedup that can be undone: reference counts of lines, with a cuckoo filter for each shard of them.

An index of lines holds three kinds of tables in the shared folder:

* references: one row for each line of a document (digest of the line's key, document, place). Rows are only added.
* counts: for each key the exact number of references and the smallest and largest document that holds it. Rows are
  added with a version; of a key's rows the last one holds.
* filters: for each shard of the keys a cuckoo filter of those that are referenced. It takes keys out again, which a
  Bloom filter can't, so it stays right when documents are deleted.

Inserted documents are counted by key before anything is shuffled. The filter of its shard tells which keys can have been
seen before; only these are looked up in the exact counts, so a false positive costs a lookup and changes nothing.
Deleted documents give back their references: keys without any left leave counts and filter, and where the smallest
or largest holder goes, the next one comes from the references. A key that a third of all documents hold is one row of
the counts; its references meet it by a broadcast of at most 5,000 such keys, all other keys by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.arrays import raw_bytes
from lumenframe.llm.common import LOWER, UPPER, mix64, table
from lumenframe.session import materialize

#: Fingerprints of a bucket; share of the slots that may be taken before a filter is built anew with more buckets.
SLOTS, LOAD = 4, 0.85
#: Keys with a share of 1 / HOT of all references or more are broadcast: HOT of them at most.
HOT = 5_000
BLANKS = " \t\n\x0b\f\r"
REFS = "key binary, doc_id long, row long, at int"
COUNTS = "key binary, n long, lo long, hi long, version int"
FILTERS = "shard int, used long, buckets binary, stash binary"


class Cuckoo:
    """Cuckoo filters of 64-bit keys over one or more shards: 16-bit fingerprints in buckets of four, by two places each."""

    def __init__(self, tables: list[np.ndarray], stashes: list[np.ndarray] | None = None):
        """tables: for each shard an array (buckets, 4) with a power of two of buckets; stashes: what found no place."""
        self.mask = np.array([len(t) - 1 for t in tables], np.uint64)
        self.base = np.append(0, np.cumsum([len(t) for t in tables]))[:-1].astype(np.uint64)
        self.slots = np.concatenate(tables) if tables else np.zeros((0, SLOTS), np.uint16)
        self.stash = stashes or [np.zeros(0, np.uint64) for _ in tables]

    @staticmethod
    def sized(n: int) -> Cuckoo:
        """An empty filter of one shard with room for n keys."""
        buckets = 1
        while buckets * SLOTS * LOAD < n:
            buckets *= 2
        return Cuckoo([np.zeros((buckets, SLOTS), np.uint16)])

    def room(self) -> int:
        return int(len(self.slots) * SLOTS * LOAD)

    @staticmethod
    def prints(keys: np.ndarray) -> np.ndarray:
        fp = (keys >> np.uint64(48)).astype(np.uint16)
        return np.where(fp == 0, np.uint16(1), fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray, mask: np.ndarray | np.uint64) -> np.ndarray:
        return bucket ^ (mix64(fp.astype(np.uint64)) & mask)

    def find(self, keys: np.ndarray, shard: np.ndarray | None = None) -> np.ndarray:
        """Which keys can be in the filter (of their shard); none that is in it is missed."""
        shard = np.zeros(len(keys), np.int64) if shard is None else shard
        fp, mask, base = self.prints(keys), self.mask[shard], self.base[shard]
        one = keys & mask
        two = self._other(one, fp, mask)
        out = (self.slots[one + base] == fp[:, None]).any(1) | (self.slots[two + base] == fp[:, None]).any(1)
        for s in np.flatnonzero([len(x) for x in self.stash]):
            out |= (shard == s) & np.isin(self._code(fp, one, two), self.stash[s])
        return out

    @staticmethod
    def _code(fp: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (fp.astype(np.uint64) << np.uint64(48)) | np.minimum(one, two)

    def insert(self, keys: np.ndarray) -> None:
        """Add keys to a filter of one shard; each call adds a fingerprint a key. What finds no place in 400 rounds is stashed."""
        mask, rng = self.mask[0], np.random.default_rng(len(keys))
        fp, bucket = self.prints(keys), keys & mask
        used = (self.slots != 0).sum(1)
        for i in range(400):
            if not len(fp):
                return
            order = np.argsort(bucket, kind="stable")
            fp, bucket = fp[order], bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            rank = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
            slot = used[bucket] + rank
            fits = slot < SLOTS
            self.slots[bucket[fits], slot[fits]] = fp[fits]
            used = used + np.bincount(bucket[fits].astype(np.int64), minlength=len(used))
            fp, bucket = fp[~fits], bucket[~fits]
            if i % 2 and len(fp):  # both places are full: one of each bucket takes the place of another
                one = np.unique(bucket, return_index=True)[1]
                s = rng.integers(0, SLOTS, len(one))
                out = self.slots[bucket[one], s]
                self.slots[bucket[one], s] = fp[one]
                fp[one] = out
            bucket = self._other(bucket, fp, mask)
        self.stash[0] = np.append(self.stash[0], self._code(fp, bucket, self._other(bucket, fp, mask)))

    def delete(self, keys: np.ndarray) -> None:
        """Take keys out of a filter of one shard. They must be in it, as the exact counts say."""
        mask = self.mask[0]
        fp, bucket = self.prints(keys), keys & mask
        tried = np.zeros(len(fp), np.int8)
        while len(fp):
            one = np.unique(bucket, return_index=True)[1]
            b, f = bucket[one], fp[one]
            has = self.slots[b] == f[:, None]
            found = has.any(1)
            self.slots[b[found], has[found].argmax(1)] = 0
            self.slots[b] = -np.sort(-self.slots[b].astype(np.int32), axis=1)
            bucket[one] = np.where(found, b, self._other(b, f, mask))
            tried[one] += np.where(found, 3, 1).astype(np.int8)
            for i in one[tried[one] == 2]:  # neither of its places has it
                code = self._code(fp[i : i + 1], bucket[i : i + 1], self._other(bucket[i : i + 1], fp[i : i + 1], mask))
                at = np.flatnonzero(self.stash[0] == code)[:1]
                self.stash[0] = np.delete(self.stash[0], at)
            left = tried < 2
            fp, bucket, tried = fp[left], bucket[left], tried[left]

    def row(self, shard: int, used: int) -> pa.Table:
        return pa.table({"shard": pa.array([shard], pa.int32()), "used": pa.array([used], pa.int64()), "buckets": pa.array([self.slots.astype("<u2").tobytes()], pa.binary()), "stash": pa.array([self.stash[0].astype("<u8").tobytes()], pa.binary())})


def stored(rows: list[tuple[bytes, bytes]]) -> Cuckoo:
    """The filters of rows (buckets, stash), in their order."""
    return Cuckoo([np.frombuffer(b, "<u2").reshape(-1, SLOTS).copy() for b, _ in rows], [np.frombuffer(s, "<u8").copy() for _, s in rows])


def key_numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """64 bits of each digest, for filters."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return raw_bytes(a)[0].reshape(-1, 16)[:, :8].copy().view("<u8")[:, 0] if len(a) else np.zeros(0, np.uint64)


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def row_of(doc_id: Column, text: Column) -> Column:
    """Tells rows that repeat an id with another text apart."""
    return F.xxhash64(doc_id, text)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_refs(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """A reference for each line whose key has `least` code points or more. Documents without an id refer to nothing."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    at = own.select("doc_id", row_of(F.col("doc_id"), F.col("text")).alias("row"), F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    keys = at.select("doc_id", "row", "at", line_key(F.col("line")).alias("norm")).where(F.length("norm") >= least)
    return keys.select(F.substring(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)), 1, 16).alias("key"), "doc_id", "row", "at")


def add_to_filters(filters: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """Filters with these keys (shard, key) added; shards without a filter get one of the size of their keys."""

    def grow(old: pa.Table, new: pa.Table) -> pa.Table:
        numbers = key_numbers(new.column("key"))
        if not old.num_rows and not len(numbers):
            return pa.table({"shard": pa.array([], pa.int32()), "used": pa.array([], pa.int64()), "buckets": pa.array([], pa.binary()), "stash": pa.array([], pa.binary())})
        shard = (old if old.num_rows else new).column("shard")[0].as_py()
        f = stored([(old.column("buckets")[0].as_py(), old.column("stash")[0].as_py())]) if old.num_rows else Cuckoo.sized(2 * len(numbers))
        f.insert(numbers)
        return f.row(shard, len(numbers) + (old.column("used")[0].as_py() if old.num_rows else 0))

    return filters.groupBy("shard").cogroup(keys.select("shard", "key").groupBy("shard")).applyInArrow(grow, FILTERS)


def in_filters(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (shard, key, n, lo, hi) and whether the filter of their shard can hold them, shard by shard."""

    def probe(old: pa.Table, new: pa.Table) -> pa.Table:
        numbers = key_numbers(new.column("key"))
        maybe = stored([(old.column("buckets")[0].as_py(), old.column("stash")[0].as_py())]).find(numbers) if old.num_rows else np.zeros(len(numbers), bool)
        return new.append_column("maybe", pa.array(maybe))

    return filters.groupBy("shard").cogroup(keys.select("shard", "key", "n", "lo", "hi").groupBy("shard")).applyInArrow(probe, "shard int, key binary, n long, lo long, hi long, maybe boolean")


def out_of_filters(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """Filters with these keys (shard, key) taken out."""

    def shrink(old: pa.Table, new: pa.Table) -> pa.Table:
        if not new.num_rows or not old.num_rows:
            return old
        f = stored([(old.column("buckets")[0].as_py(), old.column("stash")[0].as_py())])
        f.delete(key_numbers(new.column("key")))
        return f.row(old.column("shard")[0].as_py(), old.column("used")[0].as_py() - new.num_rows)

    return filters.groupBy("shard").cogroup(keys.select("shard", "key").groupBy("shard")).applyInArrow(shrink, FILTERS)


@dataclass(frozen=True)
class LineIndex:
    """The lines of the documents inserted so far. Each change gives a new index; earlier ones stay as they were.

    shards: parts of the keys with a filter each, of which a task holds one at a time; choose about keys / 250,000.
    least: code points of the shortest key that counts.
    """

    refs: DataFrame
    counts: tuple[DataFrame, ...]
    filters: DataFrame
    shards: int
    least: int
    version: int = 0

    @staticmethod
    def empty(spark: SparkSession, shards: int = 64, least: int = 10) -> LineIndex:
        none = lambda schema: spark.createDataFrame([], schema)
        return LineIndex(none(REFS), (), none(FILTERS), shards, least)

    def current(self) -> DataFrame:
        """key, n, lo, hi of all keys that are referenced."""
        spark = self.refs.sparkSession
        if not self.counts:
            return spark.createDataFrame([], COUNTS).drop("version")
        rows = reduce(DataFrame.unionByName, self.counts)
        if len(self.counts) > 1:
            rows = rows.groupBy("key").agg(F.max_by(F.struct("n", "lo", "hi"), "version").alias("last")).select("key", "last.*")
        return rows.select("key", "n", "lo", "hi").where("n > 0")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """With the lines of more documents. Documents inserted under an id that is there already add lines to that document."""
        refs = materialize(line_refs(docs, self.least, id_col, text_col), "line-refs")
        delta = refs.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        if not self.counts:
            counts = materialize(delta.select("key", "n", "lo", "hi", F.lit(1).alias("version")), "line-counts")
            filters = materialize(add_to_filters(self.filters, counts.select(shard_of(F.col("key"), self.shards).alias("shard"), "key"), self.shards), "line-filters")
            return replace(self, refs=refs, counts=(counts,), filters=filters, version=1)
        probed = materialize(in_filters(self.filters, delta.withColumn("shard", shard_of(F.col("key"), self.shards))), "line-probed")
        before = self.current().select("key", F.col("n").alias("n0"), F.col("lo").alias("lo0"), F.col("hi").alias("hi0"))
        seen = probed.where("maybe").join(before, "key", "left")
        merged = seen.select("key", "shard", (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"), F.least("lo", "lo0").alias("lo"), F.greatest("hi", "hi0").alias("hi"), F.col("n0").isNull().alias("is_new"))
        changed = materialize(merged.unionByName(probed.where("not maybe").select("key", "shard", "n", "lo", "hi", F.lit(True).alias("is_new"))), "line-changed")
        fresh = changed.where("is_new").select("shard", "key")
        room = F.octet_length("buckets") / 2 * LOAD
        full = self.filters.join(fresh.groupBy("shard").agg(F.count("*").alias("more")), "shard").where(F.col("used") + F.col("more") > room).select("shard")
        full = materialize(full, "line-full")
        again = self.current().select(shard_of(F.col("key"), self.shards).alias("shard"), "key").join(full, "shard", "left_semi")  # too small: built anew from the exact counts
        filters = materialize(add_to_filters(self.filters.join(full, "shard", "left_anti"), fresh.unionByName(again), self.shards), "line-filters")
        counts = materialize(changed.select("key", "n", "lo", "hi", F.lit(self.version + 1).alias("version")), "line-counts")
        return replace(self, refs=self.refs.unionByName(refs), counts=(*self.counts, counts), filters=filters, version=self.version + 1)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the lines of these documents; ids that aren't there change nothing."""
        gone = materialize(ids.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "line-gone")
        less = self.refs.join(gone, "doc_id", "left_semi").groupBy("key").agg(F.count("*").alias("dn"), F.min("doc_id").alias("dlo"), F.max("doc_id").alias("dhi"))
        left = materialize(self.current().join(less, "key").select("key", (F.col("n") - F.col("dn")).alias("n"), "lo", "hi", ((F.col("lo") == F.col("dlo")) | (F.col("hi") == F.col("dhi"))).alias("edge")), "line-left")
        refs = self.refs.join(gone, "doc_id", "left_anti").select(*[c.split()[0] for c in REFS.split(", ")])
        moved = refs.join(left.where("n > 0 and edge").select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        changed = moved.unionByName(left.where("n = 0 or not edge").select("key", "n", "lo", "hi"))
        counts = materialize(changed.withColumn("version", F.lit(self.version + 1)), "line-counts")
        filters = materialize(out_of_filters(self.filters, left.where("n = 0").select(shard_of(F.col("key"), self.shards).alias("shard"), "key")), "line-filters")
        return replace(self, refs=refs, counts=(*self.counts, counts), filters=filters, version=self.version + 1)

    def compact(self) -> LineIndex:
        """The same index with one table of references and one of counts."""
        return replace(self, refs=materialize(self.refs, "line-refs"), counts=(materialize(self.current().withColumn("version", F.lit(self.version)), "line-counts"),))

    def dropped(self, budget: int = 32 << 20) -> DataFrame:
        """References that are dropped: those to a key that a smaller document holds too. doc_id, row, at.

        Keys in several documents go to a cuckoo filter for each shard. Filters of up to `budget` bytes, shard by shard, are
        broadcast and rule out references before the shuffle; references of further shards are all joined.
        """
        spark = self.refs.sparkSession
        repeated = materialize(self.current().where("lo < hi").select("key", "n", "lo"), "line-repeated")
        shard = shard_of(F.col("key"), self.shards)
        made = materialize(add_to_filters(spark.createDataFrame([], FILTERS), repeated.select(shard.alias("shard"), "key"), self.shards), "line-repeated-filters")
        sizes = made.agg(F.max(F.octet_length("buckets") + F.octet_length("stash")).alias("most")).first()
        if not sizes["most"]:
            return spark.createDataFrame([], "doc_id long, row long, at int")
        few = {r["shard"]: (r["buckets"], r["stash"]) for r in made.where(F.col("shard") < budget // sizes["most"]).select("shard", "buckets", "stash").collect()}
        sent = spark.sparkContext.broadcast(few)
        upto = min(self.shards, budget // sizes["most"])

        def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            held = stored([own.get(s, (bytes(2 * SLOTS), b"")) for s in range(upto)])
            for batch in batches:
                shard = batch.column("shard").to_numpy()
                inside = shard < upto
                keep = np.ones(len(shard), bool)
                keep[inside] = held.find(key_numbers(batch.column("key"))[inside], shard[inside])
                yield batch.drop_columns(["shard"]).filter(pa.array(keep))

        likely = self.refs.withColumn("shard", shard).mapInArrow(maybe, REFS)
        hot = F.col("n") * HOT >= F.lit(self.current().agg(F.sum("n")).first()[0])
        joined = likely.join(F.broadcast(repeated.where(hot).select("key", F.col("lo").alias("first"))), "key", "left")
        joined = materialize(joined, "line-likely")
        rest = joined.where("first is null").drop("first").join(repeated.where(~hot).select("key", F.col("lo").alias("first")), "key")
        return joined.unionByName(rest).where("doc_id > first").select("doc_id", "row", "at")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per row of docs, which must have been inserted: doc_id, n_lines, n_dropped, kept (the lines that stay).

        A null or empty text is one empty line. Rows that repeat an id are one document: none of its lines is dropped for
        another of its rows. Documents without an id lose nothing. An empty table gives an empty result.
        """
        gone = self.dropped().groupBy("doc_id", "row").agg(F.array_sort(F.array_distinct(F.collect_list("at"))).alias("gone"))
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", row_of(F.col("doc_id"), F.col("text")))
        both = own.join(gone, ["doc_id", "row"], "left").select("doc_id", split_lines(F.col("text")).alias("lines"), F.coalesce(F.col("text"), F.lit("")).alias("text"), "gone")
        edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
        parts = F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.slice("lines", F.element_at("edges", i) + 2, F.element_at("edges", i + 1) - F.element_at("edges", i) - 1))
        both = both.withColumn("edges", edges)
        kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n"))
        return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = LineIndex.empty(spark, shards=max(64, docs.count() // 5_000)).insert(docs)
    return index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
  SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
