"""Connected regions of rasters and other graphs, in steps that hold no raster and no region in one task.

A region grows from the runs of its rows. Links between the runs of neighbouring rows come from one window per row.
Bands of rows are contracted in a task each (a band is bounded by the raster's width); what is linked across bands is
contracted by alternating stars: each node of a link asks for the smallest neighbour, which is a minimum per node and a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.operators.raster import DS
from lumenframe.session import drop_table, materialize

#: A run's number: its row times this, plus its first column. So numbers go in the order in which a raster is read.
ROW = 1 << 32


def star_roots(links: DataFrame, name: str = "stars") -> DataFrame:
    """Smallest node reachable from each node of links (g, u, v): g, node, root. g keeps graphs apart.

    Links count in both directions; repeats and self-links are allowed. Large stars hang the larger neighbours of a node on
    its smallest one, small stars the node and its smaller neighbours. The rounds end when the links no longer change. They
    merge sorted links, as tables broadcast in each round would add up in the driver.
    """

    def state(t: DataFrame) -> tuple:
        r = t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("g", "u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    e = materialize(links.where("u <> v").select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("g", "u").agg(F.min("v").alias("m"))
        large = both.hint("merge").join(smallest, ["g", "u"]).where("v > u").select("g", F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        smallest = large.groupBy("g", "u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(smallest, ["g", "u"]).select("g", F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        after = materialize(small.select("g", "x.u", "x.v").where("u <> v").distinct(), name)
        now = state(after)
        drop_table(e)
        e = after
        if now == before:
            break
        before = now
    return e.select("g", F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select("g", F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def row_runs(pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pixels (ds_id, y, x, ...) with run: the number of the run of neighbouring columns, of equal `by`, that each is in."""
    row = W.partitionBy(DS, "y").orderBy("x")
    same = F.lag("x").over(row) == F.col("x") - 1
    for c in by or []:
        same = same & F.lag(c).over(row).eqNullSafe(F.col(c))
    start = F.when(~F.coalesce(same, F.lit(False)), F.col("x"))
    return pixels.withColumn("_start", start).withColumn("run", F.col("y").cast("long") * ROW + F.last("_start", ignorenulls=True).over(row)).drop("_start")


def run_links(runs: DataFrame, connectivity: int = 8, by: list[str] | None = None) -> DataFrame:
    """Links (g, u, v, y) between runs (ds_id, y, a, b, run) of neighbouring rows that touch (and agree in `by`).

    Of two such runs the one that begins later sees the other as the last of the other row that began before it, so one
    window per row and its predecessor finds them all; no rows are joined.
    """
    by = by or []
    reach = 1 if connectivity == 8 else 0
    here = runs.select(DS, F.col("y").alias("pair"), F.lit(1).alias("side"), "a", "b", "run", *by)
    above = runs.select(DS, (F.col("y") + 1).alias("pair"), F.lit(0).alias("side"), "a", "b", "run", *by)
    both = here.unionByName(above)
    order = W.partitionBy(DS, "pair", *by).orderBy("a", "side")
    back = W.partitionBy(DS, "pair", *by).orderBy("a", F.desc("side"))
    of = lambda side, w: F.last(F.when(F.col("side") == side, F.struct("a", "b", "run")), ignorenulls=True).over(w)
    seen = both.select(DS, "pair", "run", "a", F.when(F.col("side") == 1, of(0, order)).otherwise(of(1, back)).alias("other"))
    return seen.where(F.col("other.b") + reach >= F.col("a")).select(F.col(DS).alias("g"), F.greatest("run", "other.run").alias("u"), F.least("run", "other.run").alias("v"), F.col("pair").alias("y")).distinct()


def contract_links(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links and the smallest node reachable from each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != (up := new[new])).any():
            new = up
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def run_roots(links: DataFrame, band: int = 256) -> DataFrame:
    """Smallest run reachable from each linked run: g, node, root. links: g, u, v, y as run_links() gives them."""

    def within(t: pa.Table) -> pa.Table:
        nodes, root = contract_links(t.column("u").to_numpy(), t.column("v").to_numpy())
        keep = ["g", "band"]
        return pa.table({**{c: pa.array([t.column(c)[0].as_py()] * len(nodes), t.schema.field(c).type) for c in keep}, "node": nodes, "low": root})

    kind = links.schema["g"].dataType.simpleString()
    banded = links.withColumn("band", F.floor(F.col("y") / band)).select("g", "band", "u", "v")
    local = materialize(banded.groupBy("g", "band").applyInArrow(within, f"g {kind}, band long, node long, low long"), "band-roots")
    # A run of a band's last row is a node of the next band too: its roots in both are linked.
    shared = local.groupBy("g", "node").agg(F.min("low").alias("u"), F.max("low").alias("v")).where("u <> v")
    across = star_roots(shared.select("g", "u", "v"), "band-stars").select("g", F.col("node").alias("low"), "root")
    out = local.join(across, ["g", "low"], "left").select("g", "node", F.coalesce("root", "low").alias("root"))
    return out.groupBy("g", "node").agg(F.min("root").alias("root"))


def number_roots(roots: DataFrame) -> DataFrame:
    """roots (ds_id, root) with label: their place, from 1, in the order in which a raster is read. No raster is one task."""
    rows = roots.distinct().withColumn("y", F.floor(F.col("root") / ROW))
    n = rows.groupBy(DS, "y").agg(F.count("*").alias("n"))
    before = n.select(DS, "y", (F.sum("n").over(W.partitionBy(DS).orderBy("y")) - F.col("n")).alias("before"))
    return rows.join(before, [DS, "y"]).select(DS, "root", (F.col("before") + F.row_number().over(W.partitionBy(DS, "y").orderBy("root"))).cast("int").alias("label"))


def _labelled(pixels: DataFrame, connectivity: int, by: list[str], min_area: int, band: int) -> DataFrame:
    """ds_id, y, x, label of pixels in regions of min_area or more."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    px = materialize(row_runs(pixels.select(DS, "y", "x", *by), by), "pixel-runs")
    runs = px.groupBy(DS, "run").agg(F.min("y").alias("y"), F.min("x").alias("a"), F.max("x").alias("b"), *[F.first(c).alias(c) for c in by])
    roots = run_roots(run_links(runs, connectivity, by), band).select(F.col("g").alias(DS), F.col("node").alias("run"), "root")
    whole = runs.join(roots, [DS, "run"], "left").select(DS, "run", F.coalesce("root", "run").alias("root"), (F.col("b") - F.col("a") + 1).alias("n"))
    area = whole.groupBy(DS, "root").agg(F.sum("n").alias("area")).where(F.col("area") >= min_area)
    numbered = whole.join(number_roots(area.select(DS, "root")), [DS, "root"]).select(DS, "run", "label")
    return px.join(numbered, [DS, "run"]).select(DS, "y", "x", "label")


def label_components(mask: DataFrame, connectivity: int = 8, min_area: int = 1, band: int = 256) -> DataFrame:
    """Connected regions of v > 0, numbered in the order in which a raster is read: mask's pixels with label, 0 elsewhere.

    connectivity 4 joins pixels that share an edge, 8 also those that share a corner. Regions below min_area become background
    and take no number. Null values count as background; a mask without pixels gives an empty result.
    """
    labels = _labelled(mask.where("v > 0"), connectivity, [], min_area, band)
    return mask.select(DS, "y", "x").join(labels, [DS, "y", "x"], "left").select(DS, "y", "x", F.coalesce("label", F.lit(0)).alias("label"))


def connected_labels(labels: DataFrame, min_area: int = 1, connectivity: int = 4, band: int = 256) -> DataFrame:
    """A label map whose labels are each one connected region: pieces of a label get numbers of their own.

    Numbers go by the old label, then by the order in which a raster is read; pieces below min_area become background.
    """
    pieces = _labelled(labels.where("label > 0").withColumnRenamed("label", "was"), connectivity, ["was"], min_area, band)
    firsts = pieces.join(labels.where("label > 0").withColumnRenamed("label", "was"), [DS, "y", "x"]).groupBy(DS, "label").agg(F.min("was").alias("was"))
    # Places by old label: pieces of a label, after all those of smaller labels.
    n = firsts.groupBy(DS, "was").agg(F.count("*").alias("n"))
    n = n.select(DS, "was", (F.sum("n").over(W.partitionBy(DS).orderBy("was")) - F.col("n")).alias("before"))
    number = firsts.join(n, [DS, "was"]).select(DS, "label", (F.col("before") + F.row_number().over(W.partitionBy(DS, "was").orderBy("label"))).cast("int").alias("number"))
    new = pieces.join(number, [DS, "label"]).select(DS, "y", "x", "number")
    return labels.select(DS, "y", "x").join(new, [DS, "y", "x"], "left").select(DS, "y", "x", F.coalesce("number", F.lit(0)).alias("label"))
