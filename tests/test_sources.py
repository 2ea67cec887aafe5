"""Readers and table files on small files."""

import json
import math

import pytest

from lumenframe.sources import readers, tables


def test_msa_counts_and_pairs(spark, tmp_path):
    (tmp_path / "a.msa").write_text("#FORMAT : EMSA\n#XPERCHAN : 0.5\n#OFFSET : 10.0\n#DATATYPE : Y\n#SPECTRUM : data\n1, 2., 3e1\nx 4\n#ENDOFDATA :\n")
    (tmp_path / "b.msa").write_text("#DATATYPE : XY\n1.5, 7\n2.5, 8\n3.5\n")
    (tmp_path / "c.msa").write_text("#FORMAT : EMSA\n")
    (tmp_path / "d.msa").write_text("5 6\r\n7\r\n")
    got = {}
    for r in readers.read_msa(spark, f"file://{tmp_path}/*.msa").orderBy("ch").collect():
        got.setdefault(r["ds_id"].rsplit("/", 1)[1], []).append((r["ch"], r["e"], r["v"]))
    assert got == {"a.msa": [(0, 10.0, 1.0), (1, 10.5, 2.0), (2, 11.0, 30.0), (3, 11.5, 4.0)], "b.msa": [(0, 1.5, 7.0), (1, 2.5, 8.0)], "d.msa": [(0, 0.0, 5.0), (1, 1.0, 6.0), (2, 2.0, 7.0)]}


def test_cif(spark, tmp_path):
    (tmp_path / "s.cif").write_text("data_x\n_chemical_name_mineral 'Rock salt'\n_cell_length_a 5.6402(3)\n_cell_angle_gamma 90\n_symmetry_space_group_name_H-M 'F m -3 m'\n")
    (tmp_path / "t.cif").write_text("data_none\n_cell_volume 3\n")
    assert [tuple(r) for r in readers.read_cif(spark, f"file://{tmp_path}/*.cif").collect()] == [("Rock salt", 5.6402, 5.6402, 5.6402, 90.0, 90.0, 90.0, "F")]


def test_folder_and_names(spark, tmp_path):
    for n in ("a.msa", "b.msa", "c.txt", "d.MSA"):
        (tmp_path / n).write_text("1")
    shown, left = readers.scan_folder(spark, f"file://{tmp_path}", [".msa"], 2)
    assert [r["path"].rsplit("/", 1)[1] for r in shown.orderBy("path").collect()] == ["a.msa", "b.msa"]
    assert {r["reason"]: r["n"] for r in left.collect()} == {"kind": 1, "limit": 1}
    names = spark.createDataFrame([("s12_300K.tif",), ("other",)], "name string")
    assert [(r["sample"], r["temp"]) for r in readers.template_fields(names, r"^s(\d+)_(\d+)K", ["sample", "temp"]).collect()] == [("12", "300"), (None, None)]


@pytest.mark.parametrize("v,want", [(0.0, "0"), (1.5, "1.5"), (123456.789, "123456.8"), (12345678.0, "1.234568e+07"), (0.00001, "1e-05"), (-2.0, "-2"), (1000.0, "1000")])
def test_digits(spark, v, want):
    df = spark.createDataFrame([(v,)], "v double")
    assert df.select(tables.cell(df, "v").alias("v")).first()["v"] == want


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, math.nan, [1.0, 2.0]), (2, 0.25, None)], "id int, v double, l array<double>").coalesce(1)
    tables.write_csv(df, f"file://{tmp_path}/csv", {"v": "nm"})
    rows = spark.read.option("header", True).csv(f"file://{tmp_path}/csv").collect()
    assert sorted((r["id"] or "", r["v"] or "", r["l"] or "") for r in rows) == [("", "nm", ""), ("1", "", "[1.0,2.0]"), ("2", "0.25", "")]
    tables.write_json(df, f"file://{tmp_path}/json", {"v": "nm"})
    assert sorted((r["id"], r["v"]) for r in spark.read.json(f"file://{tmp_path}/json/rows").collect()) == [(1, None), (2, 0.25)]
    assert json.loads(spark.read.text(f"file://{tmp_path}/json/columns").first()["value"]) == {"columns": ["id", "v", "l"], "units": [None, "nm", None]}
