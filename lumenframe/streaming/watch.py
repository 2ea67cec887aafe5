"""Folder-driven recipes: rasters that arrive as Parquet files run through a recipe, each file once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenframe.plans import recipes

RASTER = "ds_id string, y int, x int, v double"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, steps: list[dict], seconds: int | None = None) -> StreamingQuery:
    """Write the resulting image of every new file's rasters below out; without seconds, what is there now and no more.

    A batch's output folder is named by its number and overwritten on a retry, so each file counts once. A batch that a
    recipe refuses or fails on doesn't stop the watch: its number and error go to out/_errors, and its files are done.
    """
    for s in steps:
        recipes.resolve(s)

    def one(batch: DataFrame, number: int) -> None:
        try:
            img, _ = recipes.run(batch, steps)
            img.write.mode("overwrite").parquet(f"{out}/batch={number}")
        except (ValueError, PySparkException) as e:
            spark.createDataFrame([(number, str(e)[:1000])], "batch long, error string").coalesce(1).write.mode("overwrite").json(f"{out}/_errors/batch={number}")

    w = spark.readStream.schema(RASTER).parquet(folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


class ListingReader(SimpleDataSourceStreamReader):
    """Each poll is what a folder holds then; its number is the offset."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def listed(self, poll: int) -> Iterator[tuple]:
        out = []
        with os.scandir(self.folder) as entries:
            for e in entries:
                try:
                    if e.is_file() and not e.name.startswith((".", "_")):
                        s = e.stat()
                        out.append((e.path, s.st_size, s.st_mtime_ns, poll))
                except OSError:  # gone between the listing and the look at it
                    continue
        return iter(out)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return self.listed(start["poll"]), {"poll": start["poll"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.listed(start["poll"])  # a repeated poll sees the folder as it is now

    def commit(self, end: dict) -> None:
        pass


class Listing(DataSource):
    """A stream of the files of a folder (option path), listed anew in each micro-batch: path, size, modified (ns), poll."""

    @classmethod
    def name(cls) -> str:
        return "folderlisting"

    def schema(self) -> str:
        return "path string, size long, modified long, poll long"

    def simpleStreamReader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"])


def settled(listings: DataFrame, forget: str = "1 hour") -> DataFrame:
    """Files that two polls in a row saw with the same size and time, each once: path, size.

    State by path: what was seen last, or that it has fired. A file that disappears before it settles is forgotten after a while.
    """
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)

    def look(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            if not state.get[2]:
                state.remove()
            return
        size, modified, fired = state.get if state.exists else (-1, -1, False)
        for p in pd.concat(parts).sort_values("poll").itertuples():
            if not fired and (p.size_, p.modified) == (size, modified):
                fired = True
                yield pd.DataFrame({"path": [key[0]], "size": [p.size_]})
            size, modified = p.size_, p.modified
        state.update((int(size), int(modified), bool(fired)))
        if not fired:
            state.setTimeoutDuration(wait)

    by = listings.select("path", F.col("size").alias("size_"), "modified", "poll").groupBy("path")
    return by.applyInPandasWithState(look, "path string, size long", "size long, modified long, fired boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch_settled(spark: SparkSession, folder: str, out: str, checkpoint: str, steps: list[dict], seconds: float = 1.0) -> StreamingQuery:
    """watch() of a folder whose files may still grow: a Parquet file runs through the recipe once, after two polls that saw it unchanged."""
    for s in steps:
        recipes.resolve(s, spark)
    spark.dataSource.register(Listing)

    def one(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # the files of one poll
        if not paths:
            return
        try:
            img, _ = recipes.run(spark.read.schema(RASTER).parquet(*[f"file://{p}" for p in paths]), steps)
            img.write.mode("overwrite").parquet(f"{out}/batch={number}")
        except (ValueError, PySparkException) as e:
            spark.createDataFrame([(number, str(e)[:1000])], "batch long, error string").coalesce(1).write.mode("overwrite").json(f"{out}/_errors/batch={number}")

    files = settled(spark.readStream.format("folderlisting").option("path", folder).load())
    return files.writeStream.outputMode("append").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def windowed_events(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type and tumbling window; a stream forgets windows that its watermark has passed."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
