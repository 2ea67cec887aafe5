"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-case letters with everything else as a space; n-grams of 1 to 3 characters are hashed into 2^16
features. Document frequencies are counted over all learnable texts by Spark. The weights are learnt from a bounded
sample by follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties; a part of the sample that isn't learnt
from sets the temperature of the softmax. Predictions are sums of looked-up weights, so they cost a few array
operations per character, whatever the text's length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import fold, table
from lumenframe.llm.tokens import slices

BITS, MAX_N = 16, 3
FEATURES = 1 << BITS
#: TF-IDF values are shares of a text's n-grams; this factor brings them near 1.
SCALE = 50.0
_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point the lower-case letter, or a space where it isn't a letter."""
    if not _LETTERS:
        t = np.full(0x110000, 32, np.uint32)
        for i in [*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000)]:
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        for a, b in ((0x3400, 0xA000), (0x20000, 0x32000)):  # blocks of ideographs, and no others
            t[a:b] = [i if unicodedata.category(chr(i))[0] == "L" else 32 for i in range(a, b)]
        _LETTERS.append(t)
    return _LETTERS[0]


def features(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature numbers by n-gram length at each place, the place where each text starts, and whether it has a letter.

    Two places after each text belong to no n-gram; they have the feature number FEATURES.
    """
    cp = np.frombuffer("".join(f"{t or ''}\n\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    c = _letters()[cp]
    lengths = np.array([len(t or "") for t in texts], np.int64) + 2
    ends = np.cumsum(lengths)
    starts = ends - lengths
    has = np.logical_or.reduceat(c != 32, starts) if len(texts) else np.zeros(0, bool)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(MAX_N):
        if n:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) if len(h) else h
        h = h[: len(c) - n] * np.uint32(0x01000193) + c[n:] * _MULT[n]
        f = np.full(len(c), FEATURES, np.int32)
        f[: len(h)] = ((h ^ (h >> np.uint32(13))) * _MULT[n]) >> np.uint32(32 - BITS)
        f[ends - 1] = f[ends - 2] = FEATURES
        out.append(f)
    return out, starts, has


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, df over all texts of a task; the feature FEATURES counts the texts."""
    df, seen = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES + 1, bool)
    for whole in batches:
        for b in slices(whole, 1 << 20):
            f, starts, has = features(b.column(0).to_pylist())
            ends = np.append(starts[1:], len(f[0]))
            for s, e, ok in zip(starts, ends, has, strict=True):
                if ok:
                    seen[:] = False
                    for x in f:
                        seen[x[s:e]] = True
                    df += seen
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["feature", "df"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, lang, text -> lang, calibrate, and the features of the text with their shares, as bytes."""
    for whole in batches:
        for b in slices(whole, 1 << 20):
            f, starts, has = features(b.column(2).to_pylist())
            ends = np.append(starts[1:], len(f[0]))
            out = []
            for lang, cal, s, e, ok in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), starts, ends, has, strict=True):
                if ok:
                    n = np.bincount(np.concatenate([x[s:e] for x in f]), minlength=FEATURES + 1)[:FEATURES]
                    at = np.flatnonzero(n)
                    out.append((lang, cal, at.astype(np.uint16).tobytes(), (n[at] / n.sum()).astype(np.float32).tobytes()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["lang", "calibrate", "at", "tf"])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (FEATURES + 1) x languages, idf included; the last row is 0
    bias: np.ndarray
    temperature: float


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights (FEATURES + 1, k) of a softmax by FTRL-proximal; rows: features, values, class. The last row is the bias."""
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni, l1)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            new = ni + g * g
            z[at] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / alpha * w
            n[at] = new
    return weights(z, n, l1)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood, between 1/8 and 8."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / t
        m = s.max(axis=1)
        return float((np.log(np.exp(s - m[:, None]).sum(axis=1)) + m - s[np.arange(len(y)), y]).mean())

    grid = 2.0 ** np.linspace(-3, 3, 121)
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000) -> Model | None:
    """Learn from rows with a language. None if there are none with a letter.

    Document frequencies cover all rows. Weights are fitted on about per_language rows of each language, chosen by a
    hash of the id (all rows where a language has fewer); a fifth of these is kept for the temperature.
    """
    d = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df = np.zeros(FEATURES + 1)
    counted = d.select("text").mapInArrow(_document_counts, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    sizes = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.pmod(F.xxhash64(F.lit("language sample"), F.col("id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(per_language / v))])[F.col("lang")]
    calibrate = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("id")), F.lit(5)) == 0
    sample = d.where(share < wanted).select("lang", calibrate.alias("calibrate"), "text").mapInArrow(_sparse, "lang string, calibrate boolean, at binary, tf binary").toArrow()
    rows = sorted(zip(*[c.to_pylist() for c in sample.columns], strict=True)) if sample.num_rows else []
    if not rows:
        return None
    n_docs = df.max()
    idf = np.log((1 + n_docs) / (1 + df[:FEATURES])) + 1
    languages = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    data = []
    for lang, cal, at, tf in rows:
        at = np.frombuffer(at, np.uint16).astype(np.int64)
        data.append((cal, (at, np.frombuffer(tf, np.float32) * idf[at] * SCALE, number[lang])))
    w = ftrl([x for cal, x in data if not cal] or [x for _, x in data], len(languages))
    held = [x for cal, x in data if cal]
    logits = np.array([x @ w[at] + w[FEATURES] for at, x, _ in held]).reshape(-1, len(languages))
    t = temperature(logits, np.array([y for *_, y in held], np.int64))
    weights = np.vstack([w[:FEATURES] * idf[:, None] * SCALE, np.zeros((1, len(languages)))])
    return Model(languages, weights.astype(np.float32), w[FEATURES], t)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for whole in batches:
            for b in slices(whole, 1 << 20):
                n = b.num_rows
                if not n:
                    continue
                f, starts, has = features(b.column(2).to_pylist())
                best, score = np.full(n, "und", object), np.zeros(n)
                if model is not None and has.any():
                    total = np.add.reduceat(sum((x < FEATURES).astype(np.int64) for x in f), starts)
                    logits = np.empty((n, len(model.languages)))
                    for k in range(len(model.languages)):
                        w = np.ascontiguousarray(model.weights[:, k])
                        logits[:, k] = sum(np.add.reduceat(w[x], starts, dtype=np.float64) for x in f) / np.maximum(total, 1) + model.bias[k]
                    s = logits / model.temperature
                    p = np.exp(s - s.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    top = p.argmax(axis=1)
                    best[has] = np.array(model.languages, object)[top[has]]
                    score[has] = p[np.arange(n), top][has]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (the calibrated probability of lang_pred) of every row.

    Texts that are null or have no letter are `und` with score 0, and so is every text without a model (nothing to
    learn from). Ties go to the first language by code point. Repeated rows and null ids have rows of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 features x languages
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("text"))
    return d.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    return identify(docs, train(docs.where(~held_out)), held_out)
