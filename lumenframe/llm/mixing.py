"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Each document gets an exponential key, -ln(u) / weight, from a hash of its id. Within a source documents go by key, and
a prefix sum of their sizes fills the source's budget: complete epochs first, then the documents with the smallest keys.
Sources are cut into key ranges of even expected size, so that a source with a third of all rows isn't one task: range
totals are summed before the shuffle, their prefix sums are small, and only within a range are documents sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.common import WORD, table


def exponential_key(id_col: Column, weight: Column) -> Column:
    """-ln(u) / weight, u in (0, 1) from the first 48 bits of the md5 of the id as text."""
    h = F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")
    return -F.log((h.cast("double") + 0.5) / F.lit(float(1 << 48))) / weight


def source_key(source: Column) -> Column:
    """A group key that tells a null source from all others."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), source.cast("string")))


def cyclic_targets(totals: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources by a repeating cycle of weights. totals: skey, source, source_size; one row per source.

    The targets sum to share times all sizes and stop at most times a source's size; the excess goes to the others by
    weight until none is above: target = min(most * size, weight * level), the level found in one pass over the sources
    by size to weight. Sources go by code point, null last. Returns skey, source, source_size, target.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(x)) for x in cycle])
    t = totals.withColumn("w", F.element_at(weights, (F.row_number().over(order) - 1) % len(cycle) + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every, up_to = W.partitionBy(), by_ratio.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))).withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(up_to), F.lit(0.0)))
    t = t.withColumn("level", (F.col("budget") - F.col("full")) / F.col("left_w"))
    # Where the sources before are full, the level is the first that its own source doesn't reach.
    level = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"]
    return t.withColumn("level", level).select("skey", "source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level"))).alias("target"))


def mix(rows: DataFrame, targets: DataFrame, ranges: int = 1024, cut_last: bool = True) -> DataFrame:
    """How much of each row a mix takes.

    rows: skey, id, size (long), weight (double), and any other columns, which are kept; targets: skey, source_size,
    target, one row per source. Adds taken (long, repeats counted): floor(target / source_size) whole epochs, then rows
    by key until the rest of the budget is spent. The last row enters with the words that are left; with
    cut_last=False it enters whole if the source's sum comes nearer its target so. Rows of size 0 take nothing. Ties of
    the key go by id, rows that repeat an id by size. Reruns agree, as keys come from ids. Columns of rows named
    source_size, target or taken give way to the mix's own. An empty table gives an empty result.
    """
    keyed = rows.drop("source_size", "target", "taken").withColumn("_key", exponential_key(F.col("id"), F.col("weight")))
    keyed = keyed.withColumn("_range", F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * ranges).cast("int"))
    sums = keyed.groupBy("skey", "_range").agg(F.sum("size").alias("_sum"))
    before = sums.select("skey", "_range", F.coalesce(F.sum("_sum").over(W.partitionBy("skey").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = before.join(targets.select("skey", "source_size", "target"), "skey").withColumn("_epochs", epochs)
    plan = plan.withColumn("_budget", F.round(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
    in_range = W.partitionBy("skey", "_range").orderBy("_key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    out = keyed.withColumn("_in", F.coalesce(F.sum("size").over(in_range), F.lit(0))).join(plan, ["skey", "_range"])
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_budget") - F.col("_before") - F.col("_in")))
    if not cut_last:
        rest = F.when(rest * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    return out.withColumn("taken", (F.col("_epochs") * F.col("size") + rest).cast("long")).drop("_key", "_range", "_before", "_epochs", "_budget", "_in")


def document_rows(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """skey, id, size, weight of documents: size in words; weight 2 where labels.quality is 1, else 1."""
    quality = labels.groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").alias("id"), source_key(F.col("source")).alias("skey"), "source", size.alias("size"), *columns)
    rows = rows.join(quality.withColumnRenamed("doc_id", "id"), "id", "left")
    return rows.withColumn("weight", F.when(F.col("_quality") == 1, F.lit(2.0)).otherwise(F.lit(1.0))).drop("_quality")


def totals_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.session import materialize

    rows = materialize(document_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "mix-rows")
    targets = materialize(cyclic_targets(totals_of(rows)), "mix-targets")
    return mix(rows, targets).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP1_SQL = """
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN quality = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         (('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents LEFT JOIN q USING (doc_id)
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source
),
f AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
t AS (
  SELECT source, source_size, CASE WHEN l IS NULL THEN cap ELSE least(cap, w * l) END AS target
  FROM f, (SELECT arg_min(level, cap / w) AS l FROM f WHERE level * w < cap)
),
p AS (
  SELECT d.doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM p
"""
