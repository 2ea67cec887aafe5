"""Recipes, the folder watch, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from lumenframe.operators import raster
from lumenframe.plans import catalogue, recipes
from lumenframe.streaming.watch import watch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def image(spark):
    return spark.createDataFrame([("a", y, x, float(y * x)) for y in range(1, 9) for x in range(1, 11)], "ds_id string, y int, x int, v double")


def test_steps_chain_and_values_look_on(spark):
    img, values = recipes.run(image(spark), recipes.load('{"steps": [{"op": "bin", "params": {"bin_size": "2"}}, {"op": "image_stats"}, {"op": "rotate90"}]}'))
    assert img.count() == 20 and values[0][0] == "image_stats" and values[0][1].first()["n"] == 20


@pytest.mark.parametrize("step", [{"op": "nothing"}, {"op": "bin", "params": {"size": 2}}, {"op": "bin", "params": {"bin_size": 0}}, {"op": "median", "params": {"window_size": 4}}, {"op": "gaussian", "params": {"sigma": "wide"}}])
def test_wrong_steps_are_refused(step):
    with pytest.raises(ValueError):
        recipes.resolve(step)


def test_watch_runs_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    image(spark).coalesce(1).write.parquet(src)
    steps = [{"op": "fliph"}]
    for _ in range(2):
        watch(spark, src, out, ck, steps).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 80
    assert got.drop("batch").exceptAll(raster.flip(image(spark), True)).count() == 0


def test_catalogue_against_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    for name in ("image_stats", "cliff_lorimer", "radial_profile", "com_shift", "distribution_summary", "histogram"):
        got = catalogue.queries()[name](spark, SF)
        cols = sorted(got.columns)
        want = con.execute(catalogue.oracle_sql()[name])
        at = [[d[0] for d in want.description].index(c) for c in cols]
        rows = sorted(tuple(r[i] for i in at) for r in want.fetchall())
        for a, b in zip(sorted(tuple(r[c] for c in cols) for r in got.collect()), rows, strict=True):
            assert a == pytest.approx(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
