"""Result tables as CSV and JSON files: 7 significant digits, numbers that aren't finite are blank or null."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.raster import finite

DIGITS = 7


def cell(df: DataFrame, name: str) -> Column:
    """A column as text: reals by 7 significant digits, null where they aren't finite; lists and structs as JSON."""
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind in ("double", "float"):
        return F.when(finite(c), significant(c))
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(c)
    return c.cast("string")


def significant(c: Column, digits: int = DIGITS) -> Column:
    """A real by its significant digits, without zeros at the end; exponents from 1e-5 down and from 1e7 up."""
    c = c.cast("double")
    power = F.floor(F.log10(F.abs(c)))
    plain = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits + 4}f", F.round(c * F.pow(F.lit(10.0), digits - 1 - power)) / F.pow(F.lit(10.0), digits - 1 - power)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    science = F.regexp_replace(F.format_string(f"%.{digits - 1}e", c), r"\.?0+e", "e")
    return F.when(c == 0, "0").when((power < -4) | (power >= digits), science).otherwise(plain)


def write_csv(df: DataFrame, path: str, units: dict[str, str] | None = None) -> None:
    """CSV files with a header each; with units, these follow the header as a row of the table's first file.

    A file per partition: the table is not gathered. Sort or coalesce it first if one file is wanted.
    """
    out = df.select(*[cell(df, c).alias(c) for c in df.columns])
    if units:
        row = df.sparkSession.createDataFrame([tuple(units.get(c) or "" for c in df.columns)], ", ".join(f"`{c}` string" for c in df.columns))
        out = row.coalesce(1).union(out)
    out.write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, units: dict[str, str] | None = None) -> None:
    """JSON lines, and the columns and units as one object beside them in `_columns.json`'s folder."""
    out = df.select(*[F.when(finite(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
    out.write.option("ignoreNullFields", False).json(f"{path}/rows")
    about = json.dumps({"columns": df.columns, "units": [(units or {}).get(c) for c in df.columns]})
    df.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/columns")
