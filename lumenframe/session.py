"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def build_session(master: str = "local[*]", app: str = "lumenframe", partitions: int = 8) -> SparkSession:
    """A session with AQE on and UTC time, for tests and local runs."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LUMENFRAME_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "lumenframe_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one of a local session where it is unset (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d if "://" in d else "file://" + d if d.startswith("/") else d


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/lumenframe/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    ship_package(spark)
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def beside(groups: DataFrame, most: int = 50_000) -> Callable[[DataFrame], DataFrame]:
    """How tables of a row for each of these groups go to the groups' rows: broadcast if there are at most `most` groups, else joined by key.

    A few large groups then don't become a few large tasks. groups should be cheap to count, such as a table of materialize().
    """
    return F.broadcast if groups.limit(most + 1).count() <= most else lambda df: df


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by materialize()."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in df.inputFiles():
        p = jvm.org.apache.hadoop.fs.Path(f).getParent()
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        return
