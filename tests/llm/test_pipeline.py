"""Each stage of the pipeline on small tables with odd rows, against plain Python."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline

RNG = np.random.default_rng(21)
VOCAB = ["".join(RNG.choice(list("abcdefghij"), 6)) for _ in range(2000)]
#: Names that the stages use themselves.
CLASHES = ["id", "row", "digest", "kept", "times", "size", "weight", "skey", "target", "taken", "component_id", "score", "top", "_id", "_times", "_digest", "count", "n"]


def words(n):
    return " ".join(RNG.choice(VOCAB, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    bad = ["grumble", "snarky", "vileness"]
    rows, labels = [], []
    for i in range(300):
        w = words(40).split()
        if i % 2:
            for k in RNG.choice(40, 5, replace=False):
                w[k] = bad[int(RNG.integers(3))]
        rows.append((i, " ".join(w), "en", "ab"[i % 3 > 0]))
        labels.append((i, 1, i % 2))
    base = words(100)
    rows += [(1000, base, "en", "a"), (1001, base.upper(), "en", "b"), (1001, base.upper(), "de", "b"), (1002, base + " tail", None, None), (1003, None, "en", "a"), (1004, "", "en", "a"), (None, base, "en", "a"), (1005, words(3000), "en", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(d / "labels.parquet"))
    return str(d)


def clashing(docs):
    return docs.selectExpr("*", *[f"cast({i} AS int) AS `{c}`" for i, c in enumerate(CLASHES)])


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def docs_of(spark, folder):
    return clashing(spark.read.parquet(f"{folder}/documents.parquet"))


def test_toxicity_stage(spark, folder):
    docs = docs_of(spark, folder)
    out = pipeline.toxicity(spark, docs, folder)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert {1000, 1001, 1002, 1003, 1004, 1005, None} <= kept
    assert sum(i in kept for i in range(0, 300, 2)) >= 148 and sum(i in kept for i in range(1, 300, 2)) <= 6


def test_exact_stage(spark, folder):
    docs = docs_of(spark, folder)
    got = rows_of(pipeline.exact(spark, docs, folder))
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    best = {}
    for r in docs.collect():
        k = low(r["text"])
        rank = (r["doc_id"] is not None, r["doc_id"] or 0, -ord(r["lang"][0]) if r["lang"] else 0)
        if k not in best or rank > best[k][0]:
            best[k] = (rank, tuple(r))
    assert got == Counter(v for _, v in best.values())


def test_near_stage(spark, folder):
    docs = docs_of(spark, folder)
    got = {(r["doc_id"], r["lang"]) for r in pipeline.near(spark, docs, folder).collect()}
    want = {(r["doc_id"], r["lang"]) for r in docs.collect()} - {(1001, "en"), (1001, "de"), (1002, None)}
    assert got == want


def test_mixed_stage(spark, folder):
    docs = docs_of(spark, folder)
    out = pipeline.mixed(spark, docs, folder)
    assert out.columns == docs.columns
    size, taken = Counter(), Counter()
    for r in docs.collect():
        size[r["source"]] += len((r["text"] or "").split())
    for r in out.collect():
        taken[r["source"]] += len(r["text"].split())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 0.05 * sum(size.values()) + 3000
    assert all(taken[s] <= 2 * size[s] for s in size)


def test_run_and_empty_tables(spark, folder, tmp_path):
    out = pipeline.run(spark, folder).collect()
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert out and max(fill.values()) <= 2048 and not {r["doc_id"] for r in out} & {1, 3, 5}
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
