"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals add up to document scores and spans.

Tokens are runs of letters. What describes a token is itself, its first 3 to 6 bytes and its last 3 and 4, hashed.
Document labels become token labels by association: a token of a toxic document is labelled toxic if what describes it
is found in toxic documents far more often than chance and the clean documents allow. The field (two tags, transitions,
hashed weights) is fitted by the exact gradient of the log likelihood over windows of these labelled tokens. Forward-
backward marginals of every token of every whole text give the offending offsets, and by their largest value and sum,
through a logistic regression on documents that the field wasn't fitted on, the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.arrays import Spans, counts, fold_accents, letter_runs, symbols
from lumenframe.llm.common import fold, table
from lumenframe.llm.tokens import slices
from lumenframe.session import materialize

PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)
PARTS = 1 + len(PREFIXES) + len(SUFFIXES)
HASH_BITS = 18
WINDOW, BLOCK = 32, 64
#: Of a log odds ratio and of an expected number of toxic tokens.
CLIP, LEAST = 12.0, 1e-3
TAGGED = 0.5


def parts(w: Spans) -> np.ndarray:
    """Tokens x PARTS hashes of what describes each token. A part longer than the token is the token's own hash."""
    cols = [w.hash(salt=1)]
    for n in PREFIXES:
        cols.append(w.hash(end=np.minimum(w.start + n, w.end), salt=2))
    for n in SUFFIXES:
        cols.append(w.hash(start=np.maximum(w.end - n, w.start), salt=3))
    return np.stack(cols, axis=1)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # of hashed parts, for the tag 1
    transition: np.ndarray  # log potentials of tag pairs
    document: tuple[float, float, float]  # of the largest marginal's log odds, log of their sum, and 1
    labels: dict = field(default_factory=dict)


def _matrices(u: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Potentials laid out in blocks: e (BLOCK x blocks), real (same), the first block of each text, and blocks by text."""
    per = -(-lengths // BLOCK)
    first = np.append(0, np.cumsum(per))
    e = np.zeros((int(first[-1]), BLOCK))
    real = np.zeros(e.shape, bool)
    place = np.arange(len(u)) + np.repeat(first[:-1] * BLOCK - np.append(0, np.cumsum(lengths))[:-1], lengths)
    e.ravel()[place] = np.exp(np.clip(u, -30, 30))
    real.ravel()[place] = True
    return np.ascontiguousarray(e.T), np.ascontiguousarray(real.T), first, place


def marginals(u: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(tag 1) of each token given its text, by forward and backward passes. u: log potential of the tag 1 at each token.

    lengths: tokens of each text, none 0. Texts go as blocks: products of all blocks at once, messages from block to
    block, then messages within all blocks at once; this is exact. The tag before a text is 0.
    """
    if not len(u):
        return np.zeros(0)
    t = np.exp(transition)
    e, real, first, place = _matrices(u, lengths)
    n = e.shape[1]
    p = np.zeros((2, 2, n))
    p[0, 0] = p[1, 1] = 1
    for i in range(BLOCK):
        a = p[:, 0] * t[0, 0] + p[:, 1] * t[1, 0]
        b = (p[:, 0] * t[0, 1] + p[:, 1] * t[1, 1]) * e[i]
        s = a + b
        s = s[0] + s[1]
        p[:, 0] = np.where(real[i], a / s, p[:, 0])
        p[:, 1] = np.where(real[i], b / s, p[:, 1])
    per = np.diff(first)
    order = np.argsort(-per, kind="stable")
    alive = np.searchsorted(-per[order], -np.arange(int(per.max())), side="left")  # texts with more than k blocks
    before, after = np.empty((2, n)), np.empty((2, n))
    f, g = np.zeros((2, len(per))), np.ones((2, len(per)))
    f[0] = 1
    for k in range(int(per.max())):
        at = order[: alive[k]]
        i = first[at] + k
        before[:, i] = f[:, at]
        x = f[0, at] * p[0, :, i].T + f[1, at] * p[1, :, i].T
        f[:, at] = x / x.sum(axis=0)
        i = first[at + 1] - 1 - k
        after[:, i] = g[:, at]
        x = p[:, 0, i] * g[0, at] + p[:, 1, i] * g[1, at]
        g[:, at] = x / x.sum(axis=0)
    ratio = np.empty((BLOCK, n))
    a0, a1 = before
    for i in range(BLOCK):
        x, y = a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * e[i]
        s = x + y
        a0, a1 = np.where(real[i], x / s, a0), np.where(real[i], y / s, a1)
        ratio[i] = a1 / np.maximum(a0, 1e-300)
    b0, b1 = after
    for i in range(BLOCK - 1, -1, -1):
        ratio[i] *= b1 / np.maximum(b0, 1e-300)
        x, y = t[0, 0] * b0 + t[0, 1] * e[i] * b1, t[1, 0] * b0 + t[1, 1] * e[i] * b1
        s = x + y
        b0, b1 = np.where(real[i], x / s, b0), np.where(real[i], y / s, b1)
    r = np.ascontiguousarray(ratio.T).ravel()[place]
    return r / (1 + r)


def fit(x: np.ndarray, y: np.ndarray, real: np.ndarray, updates: int = 200, batch: int = 256, rate: float = 0.25, l2: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of the field by AdaGrad. x: windows x WINDOW x PARTS buckets, y: tags, real: not padding."""
    w, t = np.zeros(1 << HASH_BITS), np.zeros((2, 2))
    gw, gt = np.full(len(w), 1e-4), np.full((2, 2), 1e-2)
    w0 = -1.0  # starts with few tags, learnt like the others as a part that all tokens have
    g0 = 1e-2
    rng = np.random.default_rng(5)
    batch = int(np.clip(len(x) // 4, 1, batch))
    for _ in range(max(3, -(-updates * batch // len(x)))):
        order = rng.permutation(len(x))
        for s in range(0, len(x), batch):
            i = order[s : s + batch]
            xi, yi, ri = x[i], y[i], real[i]
            u = w[xi].sum(axis=2) + w0
            n, length = u.shape
            alpha = np.empty((length, n, 2))
            prev = np.tile([0.0, -np.inf], (n, 1))
            for k in range(length):
                m = prev[:, :, None] + t
                new = np.logaddexp(m[:, 0], m[:, 1])
                new[:, 1] += u[:, k]
                prev = np.where(ri[:, k, None], new, prev)
                alpha[k] = prev
            z = np.logaddexp(prev[:, 0], prev[:, 1])
            beta = np.zeros((n, 2))
            gu, pair = np.zeros((n, length)), np.zeros((2, 2))
            for k in range(length - 1, -1, -1):
                ok = ri[:, k]
                before = alpha[k - 1] if k else np.tile([0.0, -np.inf], (n, 1))
                emit = np.stack([np.zeros(n), u[:, k]], axis=1)
                joint = np.exp(before[:, :, None] + t + emit[:, None] + beta[:, None] - z[:, None, None])
                joint[~ok] = 0
                was = yi[:, k - 1] if k else np.zeros(n, np.int64)
                np.add.at(joint, (np.flatnonzero(ok), was[ok], yi[ok, k]), -1.0)
                pair += joint.sum(axis=0)
                gu[:, k] = joint[:, :, 1].sum(axis=1)
                m = t + (emit + beta)[:, None]
                beta = np.where(ok[:, None], np.logaddexp(m[:, :, 0], m[:, :, 1]), beta)
            grad = np.bincount(xi.ravel(), np.repeat(gu.ravel(), PARTS), minlength=len(w)) / n
            some = np.flatnonzero(grad)
            d = grad[some] + l2 * w[some]
            gw[some] += d * d
            w[some] -= rate * d / np.sqrt(gw[some])
            pair = pair / n + 1e-3 * t
            gt += pair * pair
            t -= rate * pair / np.sqrt(gt)
            d0 = gu.sum() / n
            g0 += d0 * d0
            w0 -= rate * d0 / np.sqrt(g0)
    t[:, 1] += w0  # the part that all tokens have goes with every transition to the tag 1
    return w, t


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last column of x is 1."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + l2 * b
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _tokens(column: pa.Array) -> tuple[Spans, np.ndarray, np.ndarray]:
    """Tokens of all texts, each text's first token, and each text's first symbol."""
    s, at = symbols(column)
    w = letter_runs(fold_accents(s))
    return w, w.per_text(at), at


def _part_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, text -> part, toxic, clean: the number of texts of either kind that have it."""
    for whole in batches:
        for b in slices(whole, 1 << 20):
            w, first, _ = _tokens(b.column(1))
            h, toxic = parts(w), b.column(0).to_numpy(zero_copy_only=False)
            per = [np.unique(h[s:e]) for s, e in zip(first[:-1], first[1:], strict=True)]
            if per:
                k, n = counts(np.concatenate(per), np.repeat(np.where(toxic == 1, 1 << 32, 1), [len(x) for x in per]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n >> 32), pa.array(n & 0xFFFFFFFF)], ["part", "toxic", "clean"])


def _windows(strong: np.ndarray, per_text: int):
    """toxic, text -> windows of buckets and tags: around labelled tokens of toxic texts, and spread over clean ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1 << 20):
                w, first, _ = _tokens(b.column(1))
                h, toxic = parts(w), b.column(0).to_pylist()
                out = []
                for s, e, tox in zip(first[:-1], first[1:], toxic, strict=True):
                    if e == s:
                        continue
                    tag = np.isin(h[s:e], strong).any(axis=1) if tox else np.zeros(e - s, bool)
                    if tox and not tag.any():  # nothing tells where
                        continue
                    at = np.flatnonzero(tag) if tox else np.arange(e - s)
                    at = at[np.linspace(0, len(at) - 1, min(per_text, len(at))).astype(int)]
                    for a in np.unique(np.maximum(0, np.minimum(at - WINDOW // 2, e - s - WINDOW))):
                        n = min(WINDOW, e - s - a)
                        x = np.zeros((WINDOW, PARTS), np.int32)
                        x[:n] = bucket(h[s + a : s + a + n])
                        out.append((x.tobytes(), tag[a : a + n].astype(np.int8).tobytes()))
                cols = list(zip(*out, strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], ["x", "y"])

    return run


def _strong(found: DataFrame, n_toxic: int, n_clean: int, least_g2: float = 16.0, least_ratio: float = 20.0) -> np.ndarray:
    """Parts that go with toxic texts: by the G-squared statistic against independence, and the ratio of the rates."""
    a, c, na, nc = (F.col("toxic").cast("double"), F.col("clean").cast("double"), float(n_toxic), float(n_clean))
    both = (a + c) / (na + nc)
    term = lambda k, n, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    g2 = 2 * (term(a, na, both) + term(c, nc, both) + term(na - a, na, 1 - both) + term(nc - c, nc, 1 - both))
    ratio = ((a + 0.5) / na) / ((c + 0.5) / nc)
    return found.where((g2 >= least_g2) & (ratio >= least_ratio)).select("part").toArrow().column(0).to_numpy().view(np.uint64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 4000, windows_per_text: int = 4) -> Model | None:
    """Fit on documents with a label (the largest where one is repeated). None unless both classes have texts.

    About per_class texts of either class, by a hash of the id, make the bounded sample for the fit (all of a smaller
    class). Of texts that agree in all eight min-hashes of their words (copies do; texts half of whose words differ do by
    a chance of 1 in 256 at most) the one with the smallest id counts, so groups of copies don't pass for evidence. From
    each text come at most windows_per_text windows of 32 tokens around each kind of tag. A fourth
    of the sample is kept from the field for the document regression (none where a class would have under 200 left),
    whose case weights restore the class sizes.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null").join(marked, "doc_id")
    sizes = {r["toxic"]: r["count"] for r in d.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    share = F.pmod(F.xxhash64(F.lit("toxicity sample"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.when(F.col("toxic") == 1, F.lit(per_class / sizes[1])).otherwise(F.lit(per_class / sizes[0]))
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    copies = F.xxhash64(*[F.array_min(F.transform(words, lambda x, i=i: F.xxhash64(x, F.lit(i)))) for i in range(8)])
    sample = d.where(share < wanted).withColumn("_copy", copies)
    one = sample.groupBy("toxic", "_copy").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    sample = materialize(sample.join(one, "doc_id", "left_semi").select("doc_id", "toxic", "text"), "toxicity-sample")
    for_document = F.pmod(F.xxhash64(F.lit("document"), F.col("doc_id")), F.lit(4)) == 0
    fitted = sample.where(~for_document)
    taken = {r["toxic"]: r["count"] for r in fitted.groupBy("toxic").count().collect()}
    if min(taken.get(0, 0), taken.get(1, 0)) < 200:  # too few to keep some apart
        fitted, for_document = sample, F.lit(True)
        taken = {r["toxic"]: r["count"] for r in fitted.groupBy("toxic").count().collect()}
    by_part = fitted.select("toxic", "text").mapInArrow(_part_counts, "part long, toxic long, clean long").groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = np.sort(_strong(by_part, taken[1], taken[0]))
    w = fitted.select("toxic", "text").mapInArrow(_windows(strong, windows_per_text), "x binary, y binary").toArrow()
    rows = sorted(zip(w.column(0).to_pylist(), w.column(1).to_pylist(), strict=True))
    if not rows:
        return None
    x = np.frombuffer(b"".join(r[0] for r in rows), np.int32).reshape(-1, WINDOW, PARTS)
    y, real = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], bool)
    for i, (_, tags) in enumerate(rows):
        y[i, : len(tags)] = np.frombuffer(tags, np.int8)
        real[i, : len(tags)] = True
    weights, transition = fit(x, y, real)
    model = Model(weights.astype(np.float32), transition, (0.0, 0.0, 0.0), sizes)
    scored = tag_documents(sample.where(for_document), model, extra=("toxic",)).select("toxic", "top", "expected").toArrow()
    tox, top, expected = (scored.column(i).to_numpy().astype(np.float64) for i in range(3))
    by = np.lexsort((expected, top, tox))
    tox, top, expected = tox[by], top[by], expected[by]
    weight = np.where(tox == 1, sizes[1] / max(1, tox.sum()), sizes[0] / max(1, (1 - tox).sum()))
    b = logistic(np.stack([top, np.log(expected + LEAST), np.ones(len(top))], axis=1), tox, weight / weight.mean())
    model.document = tuple(float(v) for v in b)
    return model


def _tag(shared):
    """id, text, others -> id, others, top, expected, score, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for whole in batches:
            for b in slices(whole, 1 << 20):
                n = b.num_rows
                if not n:
                    continue
                top, expected, score, spans = np.full(n, -CLIP), np.zeros(n), np.zeros(n), [[] for _ in range(n)]
                if model is not None:
                    s, at = symbols(b.column(1))
                    w = letter_runs(fold_accents(s))
                    first = w.per_text(at)
                    lengths = np.diff(first)
                    some = np.flatnonzero(lengths)
                    u = model.weights[bucket(parts(w))].sum(axis=1, dtype=np.float64)
                    p = marginals(u, lengths[some], model.transition)
                    if len(some):
                        starts = first[:-1][some]
                        most = np.clip(np.maximum.reduceat(p, starts), 1e-12, 1 - 1e-12)
                        top[some] = np.clip(np.log(most / (1 - most)), -CLIP, CLIP)
                        expected[some] = np.add.reduceat(p, starts)
                    a, c, d = model.document
                    score = 1 / (1 + np.exp(-np.clip(a * top + c * np.log(expected + LEAST) + d, -30, 30)))
                    hit = np.flatnonzero(p >= TAGGED)
                    if len(hit):
                        char = np.cumsum((s & 0xC0) != 0x80)  # 0x100 and 0x101, END and START, count as one each
                        own = np.searchsorted(first, hit, side="right") - 1
                        run_of = np.cumsum(np.append(True, (hit[1:] != hit[:-1] + 1) | (own[1:] != own[:-1]))) - 1
                        edge = np.append(np.flatnonzero(np.append(True, run_of[1:] != run_of[:-1])), len(hit))
                        for i, j in zip(edge[:-1], edge[1:], strict=True):
                            doc, a0, b0 = own[i], w.start[hit[i]], w.end[hit[j - 1]]
                            base = char[at[doc]]
                            spans[doc].append({"start": int(char[a0] - base - 1), "end": int(char[b0 - 1] - base), "probability": float(p[hit[i:j]].max())})
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(top), pa.array(expected), pa.array(score), pa.array(spans, SPANS)], [b.schema.names[0], *b.schema.names[2:], "top", "expected", "score", "spans"])

    return run


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def tag_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Toxicity of every row: doc_id, the extra columns, top (log odds of the largest marginal), expected (their sum),
    score (0 to 1), spans (start and end in characters, probability) of runs of tokens with a marginal of 0.5 or more.

    Texts that are null or without letters have no spans, top -12 and expected 0; their score is what the regression
    gives for that. Without a model all scores are 0. Repeated rows and null ids have rows of their own; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 weights: 1 MB
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *extra)
    kept = "".join(f", `{c}` {t}" for c, t in d.dtypes[2:])
    return d.mapInArrow(_tag(shared), f"doc_id long{kept}, top double, expected double, score double, spans array<struct<start:int,end:int,probability:double>>")


def held_out(id_col: str = "doc_id") -> Column:
    return fold(F.col(id_col), 3) == 1


def op9_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    out = tag_documents(docs.withColumn("held_out", held_out()), model, extra=("held_out",))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
