"""Language identification: planted languages, edge cases, and the parts against plain versions."""

import numpy as np
import pytest

from lumenframe.llm.language import FEATURES, features, ftrl, identify, temperature, train

WORDS = {"en": "the of and house water thing with".split(), "de": "der und haus wasser über schön nicht".split(), "fr": "le été maison eau très où garçon".split()}


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[lang], 12)), lang) for i, lang in enumerate(rng.choice(list(WORDS), n))]


def test_held_out_accuracy_and_edge_cases(spark):
    schema = "doc_id long, text string, lang string"
    learn = spark.createDataFrame([*texts(300, 1), (1000, "the", None), (1001, None, "en"), (1002, "123", "fr")], schema)
    model = train(learn, per_language=100)
    assert model.languages == ["de", "en", "fr"] and 0.1 < model.temperature < 9
    rows = [*texts(100, 2), (None, "the house", None), (7, None, "en"), (7, None, "en"), (8, "", None), (9, "123 !!", None), (10, "the of and " * 20_000, None)]
    got = identify(spark.createDataFrame(rows, schema), model).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows[:100]}
    first = [r for r in got if r["doc_id"] in truth and r["doc_id"] not in (7, 8, 9, 10)]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in first]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [r["lang_pred"] for r in got if r["doc_id"] is None] == ["en"]
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (8, 9)} >= {("und", 0.0)}
    assert [r["lang_pred"] for r in got if r["doc_id"] == 10][-1] == "en"


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, score int")
    assert train(empty) is None
    assert identify(empty, None).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in identify(one, train(one)).collect()] == [("und", 0.0)]


def test_features_do_not_depend_on_neighbours():
    alone, *_ = features(["Été 12 abc"])
    both, starts, has = features(["x", "Été 12 abc", None, "99"])
    for a, b in zip(alone, both, strict=True):
        assert (a == b[starts[1] : starts[2]]).all()
    assert has.tolist() == [True, True, False, False]
    assert (features(["été"])[0][2] == features(["ÉTÉ"])[0][2]).all()


def test_ftrl_is_sparse_and_temperature_finds_scale():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        y = int(rng.integers(2))
        rows.append((np.array([y, 10 + int(rng.integers(50))]), np.array([1.0, 1.0]), y))
    w = ftrl(rows, 2, l1=2.0)
    assert w[0, 0] > 0 > w[0, 1] and (w[10:60] == 0).mean() > 0.5 and not w[100:FEATURES].any()
    z = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=np.exp(r) / np.exp(r).sum()) for r in z])
    assert temperature(z * 3, y) == pytest.approx(3, rel=0.25)
    assert temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0
