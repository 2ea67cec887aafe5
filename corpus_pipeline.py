"""From raw documents to packed training sequences, as five stages of the operators in lumenframe.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of docs, whatever these are besides doc_id, text and source.
Empty tables pass through; documents without an id are never taken for copies of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import ascii_lower, table
from lumenframe.llm.exact import exact_dedup
from lumenframe.llm.minhash import hyperminhash_components
from lumenframe.llm.mixing import cyclic_targets, document_rows, mix, totals_of
from lumenframe.llm.packing import pack, pieces
from lumenframe.llm.tokens import vocabulary
from lumenframe.llm.toxicity import held_out, tag_documents, train
from lumenframe.session import materialize

#: Documents with this score or more are rejected.
TOXIC = 0.7
#: Units that a packing task keeps the ids of; the executors hold what earlier stages left in their memory as well.
UNITS = 300_000


def rows_of(docs: DataFrame, *columns: Column) -> DataFrame:
    """These columns beside the whole row, so that no column of docs clashes with one of a stage's own."""
    return docs.select(*columns, F.struct("*").alias("row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC, learnt from the labelled ones that aren't held out.

    Null and empty texts score low and stay; without labels of both classes all stay.
    """
    model = train(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    scored = tag_documents(rows_of(docs, F.col("doc_id"), F.col("text")), model, extra=("row",))
    return scored.where(F.col("score") < TOXIC).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (A-Z lower-cased; null is empty) the one with the largest id.

    Of several rows with that id and text, the one that is first as JSON stays, and that once. A null id loses to any other.
    """
    classes = materialize(exact_dedup(docs, keep="max").select("id", "digest", "kept"), "exact-classes")
    digest = F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)
    rows = rows_of(docs, F.col("doc_id").alias("id"), digest.alias("digest")).alias("r")

    def same(other: str) -> Column:
        return F.col("r.id").eqNullSafe(F.col(f"{other}.id")) & (F.col("r.digest") == F.col(f"{other}.digest"))

    kept = rows.join(classes.where(~F.col("kept")).select("id", "digest").distinct().alias("gone"), same("gone"), "left_anti")
    twice = classes.where("kept").groupBy("id", "digest").count().where("count > 1")
    if twice.isEmpty():
        return kept.select("row.*")
    once = kept.alias("r").join(twice.alias("t"), same("t"), "left_anti").select("row")
    first = kept.alias("r").join(twice.alias("t"), same("t"), "left_semi").groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.union(first.select("row")).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles the document with the smallest id.

    Texts that are null or without words have no shingles and all stay, as do documents without an id.
    """
    gone = hyperminhash_components(docs).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    return rows_of(docs, F.col("doc_id").alias("id")).join(gone, "id", "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole epochs of each source, then by key up to the source's target.

    Documents without words aren't taken. Rows that share an id are taken equally often.
    """
    rows = materialize(document_rows(docs, table(spark, sf_dir, "labels")), "mix-rows")
    targets = materialize(cyclic_targets(totals_of(rows)), "mix-targets")
    times = mix(rows, targets, cut_last=False).where("size > 0").groupBy("id").agg(F.max(F.expr("taken div size")).cast("int").alias("times")).where("times > 0").alias("t")
    out = rows_of(docs, F.col("doc_id").alias("id")).alias("r").join(times, F.col("r.id").eqNullSafe(F.col("t.id")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; a null or empty text is its end id alone."""
    return pack(pieces(docs, vocabulary(), max_units=UNITS))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mixed), ("pack_sequences", packed)]

#: SQL can't express the random field, the sketches or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
