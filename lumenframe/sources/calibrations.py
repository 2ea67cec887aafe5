"""Pixel sizes by instrument and magnification: a small dimension table of which the last entry of a key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "key string, pixel_size double, unit string, note string, at timestamp"


def calibration_key(instrument: Column, magnification: Column) -> Column:
    """instrument|magnification, both trimmed, the magnification rounded to a whole number; null where one is missing or not above 0."""
    name = F.trim(instrument)
    ok = (F.length(name) > 0) & (magnification > 0)
    return F.when(ok, F.concat_ws("|", name, F.round(magnification, 0).cast("long").cast("string")))


def upsert(table: DataFrame, new: DataFrame) -> DataFrame:
    """table with the rows of new: of a key the latest row by `at` stays, of equal times the new one. Rows without a key or a size above 0 are refused."""
    ok = new.where("key is not null AND pixel_size > 0")
    both = table.withColumn("_new", F.lit(0)).unionByName(ok.withColumn("_new", F.lit(1)))
    columns = [c for c in table.columns if c != "key"]
    return both.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("at", "_new", *columns)).alias("r")).select("key", "r.*")


def without(table: DataFrame, keys: DataFrame) -> DataFrame:
    """table without some keys."""
    return table.join(keys.select("key"), "key", "left_anti")


def calibrated(rows: DataFrame, table: DataFrame, instrument: str = "instrument", magnification: str = "magnification") -> DataFrame:
    """Adds pixel_size and unit of the rows' keys; null where none is known. The table holds a row for each instrument and magnification, so Catalyst may broadcast it."""
    keyed = rows.withColumn("_key", calibration_key(F.col(instrument), F.col(magnification)))
    known = table.select(F.col("key").alias("_key"), "pixel_size", "unit")
    return keyed.join(known, "_key", "left").drop("_key")
