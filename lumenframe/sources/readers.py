"""Text files of instruments as the tables that operators work on: spectra (.msa), crystals (.cif), folders of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.crystal import PHASE

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?$"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ds_id (the path), value."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("ds_id"), "value")


def msa_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header lines `#KEY : value` of spectra: ds_id, key (upper case, without what follows a dash), value; the last of a repeated key."""
    lines = _files(spark, path).select("ds_id", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).where(F.trim("line").startswith("#"))
    key = F.upper(F.trim(F.regexp_extract("line", r"#\s*([^:\-]*)", 1)))
    t = lines.select("ds_id", "n", key.alias("key"), F.trim(F.regexp_extract("line", r":(.*)$", 1)).alias("value"))
    return t.groupBy("ds_id", "key").agg(F.max_by("value", "n").alias("value"))


def read_msa(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of a path or pattern, a row per channel: ds_id, ch, e, v.

    Data lines hold counts, or pairs of energy and counts where DATATYPE is XY. Energies follow OFFSET and XPERCHAN; of
    pairs without XPERCHAN the energies of the pairs. Without any, channels count from 0 by 1. Tokens that are no numbers
    are skipped; a file without data has no rows.
    """
    head = msa_headers(spark, path).groupBy("ds_id").pivot("key", ["DATATYPE", "XPERCHAN", "OFFSET"]).agg(F.first("value"))
    body = _files(spark, path).select("ds_id", F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#")).alias("lines"))
    tokens = F.filter(F.split(F.trim(F.array_join("lines", " ")), r"[\s,]+"), lambda x: x.rlike(NUMBER))
    t = body.join(head, "ds_id", "left").select("ds_id", F.transform(tokens, lambda x: F.regexp_replace(x, "[dD]", "e").cast("double")).alias("t"), (F.upper(F.trim("DATATYPE")) == "XY").alias("xy"), F.expr("try_cast(XPERCHAN as double)").alias("step"), F.expr("try_cast(OFFSET as double)").alias("offset"))
    t = t.where(F.size("t") > 0).withColumn("xy", F.coalesce("xy", F.lit(False)))
    xs, ys = F.filter("t", lambda _, i: i % 2 == 0), F.filter("t", lambda _, i: i % 2 == 1)
    pairs = F.slice(F.arrays_zip(xs.alias("x"), ys.alias("y")), F.lit(1), F.greatest(F.lit(0), F.size(ys)))
    rows = F.when(F.col("xy"), F.transform(pairs, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("v")))).otherwise(F.transform("t", lambda v: F.struct(F.lit(None).cast("double").alias("x"), v.alias("v"))))
    t = t.select("ds_id", "step", "offset", F.posexplode(rows).alias("ch", "p"))
    step = F.when(F.col("step") != 0, F.col("step"))
    by_step = F.coalesce("offset", F.lit(0.0)) + F.col("ch") * step
    return t.select("ds_id", "ch", F.coalesce(by_step, F.col("p.x"), F.coalesce("offset", F.lit(0.0)) + F.col("ch")).alias("e"), F.col("p.v").alias("v"))


def cif_value(text: Column, tag: str) -> Column:
    """The value of a tag of one line, quotes off; null without it."""
    v = F.regexp_extract(text, rf"(?im)^\s*{tag}\s+('[^'\n]*'|\"[^\"\n]*\"|\S+)", 1)
    return F.nullif(F.trim(F.regexp_replace(v, "^['\"]|['\"]$", "")), F.lit(""))


def read_cif(spark: SparkSession, path: str) -> DataFrame:
    """Crystals as phases: name, a, b, c, alpha, beta, gamma, centering; a file without a cell has no row.

    Numbers lose their errors in brackets; missing axes equal a, missing angles are 90, a missing space group is P.
    """
    t = _files(spark, path)
    num = lambda tag: F.expr("try_cast(_n as double)") if tag is None else F.regexp_replace(cif_value(F.col("value"), tag), r"\(\d+\)", "").try_cast("double")
    group = F.coalesce(cif_value(F.col("value"), r"_(?:symmetry_space_group_name_H-M|space_group_name_H-M_alt)"), F.lit("P"))
    name = F.coalesce(cif_value(F.col("value"), "_chemical_name_mineral"), cif_value(F.col("value"), "_chemical_name_common"), cif_value(F.col("value"), "_chemical_formula_sum"), F.regexp_extract("value", r"(?im)^\s*data_(\S+)", 1))
    a = num("_cell_length_a")
    cell = [a.alias("a"), F.coalesce(num("_cell_length_b"), a).alias("b"), F.coalesce(num("_cell_length_c"), a).alias("c")]
    angles = [F.coalesce(num(f"_cell_angle_{x}"), F.lit(90.0)).alias(x) for x in ("alpha", "beta", "gamma")]
    out = t.select(name.alias("name"), *cell, *angles, F.upper(F.substring(group, 1, 1)).alias("centering")).where("a is not null")
    return out.to(spark.createDataFrame([], PHASE).schema)


def scan_folder(spark: SparkSession, path: str, suffixes: list[str], most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Files below a folder by name, the first `most` of the wanted kinds: (path, size, modified) and how many were left out and why.

    Only names are listed, no contents are read. The limit is the feature: a folder view shows that many.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    wanted = files.where(kind.isin([s.lower() for s in suffixes]))
    shown = wanted.orderBy("path").limit(most)
    left = files.select(F.when(kind.isin([s.lower() for s in suffixes]), "limit").otherwise("kind").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    left = left.select("reason", F.when(F.col("reason") == "limit", F.greatest(F.lit(0), F.col("n") - most)).otherwise(F.col("n")).alias("n")).where("n > 0")
    return shown, left


def template_fields(names: DataFrame, pattern: str, fields: list[str]) -> DataFrame:
    """Fields of file names (name) by a pattern with one group each: adds the fields, null where the pattern doesn't match."""
    got = [F.nullif(F.regexp_extract("name", pattern, i + 1), F.lit("")).alias(f) for i, f in enumerate(fields)]
    return names.select("*", *got)


