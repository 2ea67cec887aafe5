"""Exact dedup by a log-structured merge index over text digests, with DataFrame functions only.

Documents go to memtables by a hash of their id. Each memtable is flushed as a run of (digest, smallest id, largest
id, count), sorted by digest and written to the shared folder, with a bit filter of its own. Each run's digests are
looked up in the filters of all other runs: those that none of them has, and that the run has once, are single and
stay where they are. The others are compacted level by level, a few runs into one of the next level, keeping the smallest
(and largest) identifier of each digest. Digests that more than one row has are hits. A bit filter of the hits decides
which texts are read again, and of these the smallest and largest normalised text of each digest are compared byte by
byte; should they differ, texts are told apart by themselves instead of by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import ascii_lower, table
from lumenframe.session import drop_table, materialize

#: Bits of one bitmap of Spark's bitmap functions.
BITMAP_BITS = 32768


def flush_runs(keyed: DataFrame, memtables: int = 8) -> DataFrame:
    """Runs of (run, digest, lo, hi, n), sorted by digest within each file. keyed: id, digest."""
    run = F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int")
    flushed = keyed.groupBy(run.alias("run"), "digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
    return materialize(flushed.sortWithinPartitions("run", "digest"), "lsm-runs")


def compact(runs: DataFrame, memtables: int = 8, fan_in: int = 4) -> DataFrame:
    """Merge fan_in runs into one of the next level until one is left: digest, lo (smallest id), hi (largest id), n."""
    while memtables > 1:
        merged = runs.groupBy(F.expr(f"cast(run div {fan_in} AS int)").alias("run"), "digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        runs, memtables = materialize(merged.sortWithinPartitions("run", "digest"), "lsm-level"), -(-memtables // fan_in)
    return runs.select("digest", "lo", "hi", "n")


def _bit(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def _has_sql(bitmap: str) -> str:
    return f"cast(conv(hex(substring({bitmap}, cast(bit % {BITMAP_BITS} div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(bit % 8 as int)) != 0"


def filter_bits(n: int, most: int = 1 << 28) -> int:
    """Bits of a filter of n digests: about 16 each, but never more than most (2^28 bits: 32 MB)."""
    bits = BITMAP_BITS
    while bits < min(16 * n, most):
        bits *= 2
    return bits


def build_filter(digests: DataFrame, bits: int) -> DataFrame:
    """Bitmaps of the digests' bits: at most bits / 32768 rows of 4 KB each, whatever the number of digests."""
    b = digests.select(_bit(F.col("digest"), bits).alias("bit"))
    return b.groupBy(F.expr(f"bit div {BITMAP_BITS}").alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % BITMAP_BITS).alias("bitmap"))


def probe_filter(rows: DataFrame, pages: DataFrame, bits: int) -> DataFrame:
    """Rows whose digest may be in the filter; none that is in it is lost."""
    rows = rows.withColumn("bit", _bit(F.col("digest"), bits)).withColumn("page", F.expr(f"bit div {BITMAP_BITS}"))
    return rows.join(F.broadcast(pages), "page").where(_has_sql("bitmap")).drop("page", "bit", "bitmap")


def run_filters(runs: DataFrame, bits: int) -> DataFrame:
    """The runs' filters: page, and the bitmap of each run that has bits there, by run."""
    b = runs.select("run", _bit(F.col("digest"), bits).alias("bit"))
    pages = b.groupBy("run", F.expr(f"bit div {BITMAP_BITS}").alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % BITMAP_BITS).alias("bitmap"))
    return pages.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("run", "bitmap"))).alias("bitmaps"))


def maybe_elsewhere(runs: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """Rows of runs whose digest the run has more than once or the filter of another run may hold; no such row is lost."""
    rows = runs.withColumn("bit", _bit(F.col("digest"), bits)).withColumn("page", F.expr(f"bit div {BITMAP_BITS}"))
    other = F.expr(f"exists(map_entries(map_filter(bitmaps, (k, v) -> k <> run)), x -> {_has_sql('x.value')})")
    return rows.join(F.broadcast(filters), "page").where((F.col("n") > 1) | other).drop("page", "bit", "bitmaps")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", memtables: int = 8, max_filter_bits: int = 1 << 28) -> DataFrame:
    """Class of every row among rows with equal text (A-Z lower-cased; null counts as empty).

    Returns one row per row of docs: id, keep_id (the class's smallest id, or largest with keep='max'), group_size,
    kept, digest (sha256 in hex of the normalised text). Rows without an id never win over others; rows that repeat the
    kept id with the same text are all marked as kept. An empty table gives an empty result. Other columns aren't read.
    max_filter_bits bounds the broadcast filters, of all runs together and of the hits (2^28 bits: 32 MB); a full filter
    prunes less, the result is the same.
    """
    norm = ascii_lower(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", F.sha2(F.col("norm").cast("binary"), 256))
    keyed = materialize(texts.select("id", "digest"), "lsm-keys")
    runs = flush_runs(keyed, memtables)
    bits = filter_bits(-(-runs.count() // memtables), max_filter_bits // memtables)
    merging = maybe_elsewhere(runs, run_filters(runs, bits), bits)
    hits = materialize(compact(merging, memtables).where("n > 1"), "lsm-hits")
    drop_table(runs)
    bits = filter_bits(hits.count(), max_filter_bits)
    again = probe_filter(texts.select("digest", "norm"), build_filter(hits, bits), bits)
    verified = again.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    differ = materialize(verified.where("a <> b").select("digest"), "lsm-differ")
    kept_id = F.col("hi" if keep == "max" else "lo")
    if differ.isEmpty():
        out = keyed.join(hits.select("digest", kept_id.alias("keep_id"), F.col("n").alias("group_size")), "digest", "left")
    else:  # texts of one digest that aren't equal: these few classes go by digest and text
        apart = texts.join(differ, "digest", "left_semi").groupBy("digest", "norm").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
        rest = keyed.join(differ, "digest", "left_anti").join(hits.select("digest", kept_id.alias("keep_id"), F.col("n").alias("group_size")), "digest", "left")
        own = texts.join(differ, "digest", "left_semi").join(apart.select("digest", "norm", kept_id.alias("keep_id"), F.col("n").alias("group_size")), ["digest", "norm"])
        out = rest.select("id", "digest", "keep_id", "group_size").unionByName(own.select("id", "digest", "keep_id", "group_size"))
    single = F.col("group_size").isNull()
    return out.select(
        "id",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "digest",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"), keep="max")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
