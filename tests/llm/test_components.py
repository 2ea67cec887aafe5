"""Connected components: the smallest ids, and how many jobs the driver runs for them."""

import numpy as np

from lumenframe.llm.common import components


def jobs_of(spark, name, f):
    spark.sparkContext.setJobGroup(name, name)
    out = f()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_links_that_are_stars_take_no_round(spark):
    edges = spark.range(1000).selectExpr("id AS src", "id - id % 100 AS dst")
    out, jobs = jobs_of(spark, "stars", lambda: components(edges))
    assert jobs <= 6  # of the links' table and of one look at it; each round and what compared it with the one before were more
    assert {(r["id"], r["component_id"]) for r in out.collect()} == {(i, i - i % 100) for i in range(1000)}


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(3000, 3060)]
    shuffled = rng.permutation(np.arange(4000, 4050)).tolist()
    pairs = rng.integers(0, 400, (300, 2)).tolist() + chain + list(zip(shuffled, shuffled[1:], strict=False)) + [[5000, 5000], [6001, 6000], [6000, 6001], [6002, 6000], [6002, 6001]]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")).collect()
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert len(got) == len(linked) and {(r["id"], r["component_id"]) for r in got} == {(x, find(x)) for x in linked}
    assert components(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0
