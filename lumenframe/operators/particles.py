"""Particles and grains from rasters alone: threshold, connected regions, measurements, pieces of the boundary network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.graph import connected_labels, label_components
from lumenframe.operators.raster import DS
from lumenframe.operators.regions import boundary_network, region_stats
from lumenframe.operators.texture import multi_otsu
from lumenframe.session import materialize


def particle_mask(img: DataFrame, threshold: float | None = None, bright: bool = True) -> DataFrame:
    """v: 1 at or above the threshold (below it for dark particles), else 0; Otsu's of each raster where none is given."""
    t = img if threshold is not None else img.join(multi_otsu(img, 2), DS)
    level = F.lit(float(threshold)) if threshold is not None else F.col("t1")
    inside = F.col("v") >= level if bright else F.col("v") < level
    return t.select(DS, "y", "x", F.coalesce(inside.cast("double"), F.lit(0.0)).alias("v"))


def particle_analysis(img: DataFrame, threshold: float | None = None, bright: bool = True, connectivity: int = 8, min_area: int = 1, pixel_size: float | None = None) -> DataFrame:
    """region_stats() of the connected regions of particle_mask(). Rasters without a particle have no row."""
    labels = materialize(label_components(particle_mask(img, threshold, bright), connectivity), "particles")
    return region_stats(labels, img, min_area, pixel_size)


def boundary_pixels(labels: DataFrame) -> DataFrame:
    """v: 1 for pixels of a region that share an edge with another region, else 0. Background parts nothing."""
    row, col = W.partitionBy(DS, "y").orderBy("x"), W.partitionBy(DS, "x").orderBy("y")
    unlike = F.lit(False)
    for f, w in ((F.lag, row), (F.lead, row), (F.lag, col), (F.lead, col)):
        other = f("label").over(w)
        unlike = unlike | F.coalesce((other > 0) & (other != F.col("label")), F.lit(False))
    return labels.select(DS, "y", "x", (unlike & (F.col("label") > 0)).cast("double").alias("v"))


def boundary_segments(labels: DataFrame, connectivity: int = 8) -> DataFrame:
    """Number of connected pieces of the boundary between regions: ds_id, segments (0 without any)."""
    pieces = label_components(boundary_pixels(labels), connectivity)
    return pieces.groupBy(DS).agg(F.max("label").cast("long").alias("segments"))


def grain_network(labels: DataFrame, pixel_size: float | None = None, min_area: int = 1) -> DataFrame:
    """boundary_network() with segments, of labels made connected first."""
    whole = materialize(connected_labels(labels, min_area), "grains")
    return boundary_network(whole, pixel_size).join(boundary_segments(whole), DS)
