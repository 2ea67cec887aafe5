"""Where queries and the SQL that states their results are kept. Reals are rounded to 5 digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import adapters as A

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """Reals rounded (and -0 made 0), ds_id left out."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c != "ds_id"])


def query(name: str, plan: Callable[[SparkSession, str], DataFrame], sql: str | None = None, *views: str) -> None:
    Q[name] = lambda spark, sf_dir: rounded(plan(spark, sf_dir))
    if sql:
        SQL[name] = A.with_views(sql, *views) if views else sql


def r(c: str, name: str | None = None) -> str:
    return f"round({c}, 5) + 0.0 AS {name or c}"
