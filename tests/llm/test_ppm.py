"""PPM scores against a per-symbol trie in plain Python."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.llm.ppm import ppm_scores

TEXTS = ["abracadabra abracadabra", "The cat sat on the mat.", "the CAT sat", None, "", " \t\n", "été à la plage été", "zzzz qqqq", "abracadabra the", "a" * 300, "the cat sat on the mat. " * 40, "\x00\x01 odd bytes", "the cat sat"]
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def sym(t):
    return [*(t or "").translate(LOWER).encode(), 256]


class Brute:
    def __init__(self, texts, order):
        self.order, self.tables = order, defaultdict(Counter)
        for t in texts:
            s = [257] * order + sym(t)
            for i in range(order, len(s)):
                for j in range(order + 1):
                    self.tables[tuple(s[i - j : i])][s[i]] += 1

    def p(self, ctx, x):
        p, out = 1.0, set()
        for j in range(self.order, -1, -1):
            c = self.tables.get(tuple(ctx[len(ctx) - j :]))
            if not c:
                continue
            left = {k: v for k, v in c.items() if k not in out}
            total, d = sum(left.values()), len(left)
            if x in left:
                return p * left[x] / (total + d)
            if d:
                p *= d / (total + d)
            out |= set(c)
        return p / (257 - len(out))

    def score(self, t):
        s = [257] * self.order + sym(t)
        return sum(math.log10(self.p(tuple(s[i - self.order : i]), s[i])) for i in range(self.order, len(s)))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize(("order", "frequent"), [(4, 1 << 19), (3, 40), (2, 1)])
def test_against_brute_force(spark, order, frequent):
    texts = TEXTS * 2
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {r["doc_id"]: r for r in ppm_scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, order, frequent_words=min(frequent, 1 << 17), frequent_grams=frequent).collect()}
    assert len(got) == len(texts)
    train = [t for i, t in enumerate(texts) if not held(i)]
    brute = Brute(train, order)
    tokens = lambda t: [*((t or "").translate(LOWER).split()), None]
    c = Counter(x for t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        r = got[i]
        assert r["held_out"] == held(i)
        assert r["n_tokens"] == len(tokens(t)) and r["n_known"] == sum(x in c for x in tokens(t)) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)), abs=1e-7)
        assert r["score"] == pytest.approx(brute.score(t), abs=1e-7)
    ctx = (104, 101, 32, 99)[-order:]
    assert sum(brute.p(ctx, x) for x in range(257)) == pytest.approx(1)


def test_empty_table_and_no_training_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ppm_scores(empty, F.lit(False)).count() == 0
    only = spark.createDataFrame([(1, "ab"), (None, None), (1, "ab")], "doc_id long, text string")
    rows = ppm_scores(only, F.lit(True)).collect()
    assert sorted(round(r["score"] / math.log10(257), 6) for r in rows) == [-3, -3, -1]
    assert {r["n_known"] for r in rows} == {0}
