"""Language-model scoring by prediction by partial matching (PPM) over bytes, with a unigram word model beside it.

The trie of byte contexts is a set of tables, one per order: context and symbol with a count, context with its total,
its number of symbols, and the counts that its symbols have one order lower. Escapes are estimated by method C (symbols
to symbols plus occurrences), and symbols of a longer context are excluded from the shorter ones, so probabilities of
all symbols, the end of the text among them, sum to 1. The model is pretrained on the training documents.

Counting is a map-side sum per task, then one sum per key in Spark. Scoring looks up what is frequent in broadcast
tables whose size the parameters bound (a key with at least a share 1/n of all occurrences is one of at most n), and
sends the rest, as (row, key, count), through a join; what no training text has goes down the orders by joins too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.arrays import END, END_TOKEN, START, Table, counts, symbols, words
from lumenframe.llm.common import fold, table
from lumenframe.llm.tokens import slices
from lumenframe.session import materialize

#: Bits of a symbol; symbols that can follow a context.
BITS, SYMBOLS = 9, 257
WORD, GRAM = 0, 1


def grams(s: np.ndarray, order: int) -> np.ndarray:
    """The symbol at each place from `order` on with the `order` symbols before it, the oldest in the highest bits."""
    g = s[: len(s) - order].astype(np.uint64)
    for i in range(1, order + 1):
        g <<= np.uint64(BITS)
        g |= s[i : len(s) - order + i]
    return g


def _split(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with each text's first, and grams with each text's first. An end token is the last word of each text."""
    s, at = symbols(column, order)
    w = words(s)
    first = w.per_text(at)
    n = len(at) - 1
    tokens = np.full(len(w.start) + n, np.uint64(END_TOKEN))
    place = np.ones(len(tokens), bool)
    place[first[1:] + np.arange(n)] = False
    tokens[place] = w.hash()
    g = grams(s, order)
    real = s[order:] != START
    return tokens, first[:-1] + np.arange(n), g[real], at[:-1] - np.arange(n) * order


def _count(order: int, most: int):
    """Counts of tokens and grams of all texts of a task; what is held is emitted when it has `most` keys."""

    def emit(kind: int, held: list) -> Iterator[pa.RecordBatch]:
        if held:
            k, n = counts(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            for i in range(0, len(k), 100_000):
                part = k[i : i + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(n[i : i + 100_000])], ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]
        size = [0, 0]
        for whole in batches:
            for b in slices(whole, 1 << 20):
                tokens, _, g, _ = _split(b.column(0), order)
                for kind, keys in ((WORD, tokens), (GRAM, g)):
                    part = counts(keys)
                    held[kind].append(part)
                    size[kind] += len(part[0])
                    if size[kind] > most:
                        merged = counts(np.concatenate([x for x, _ in held[kind]]), np.concatenate([x for _, x in held[kind]]))
                        if len(merged[0]) > most // 2:
                            yield from emit(kind, [merged])
                            held[kind], size[kind] = [], 0
                        else:
                            held[kind], size[kind] = [merged], len(merged[0])
        for kind in (WORD, GRAM):
            yield from emit(kind, held[kind])

    return run


def count_corpus(docs: DataFrame, order: int, text_col: str = "text", most: int = 1_500_000) -> DataFrame:
    """kind (0: word, 1: gram), key, n of all texts."""
    part = docs.select(text_col).mapInArrow(_count(order, most), "kind byte, key long, n long")
    return materialize(part.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts")


class Trie:
    """Tables of each order: grams[j] (g, c) and contexts[j] (ctx, t, d, e); j symbols, of which j - 1 are the context.

    t: occurrences, d: distinct symbols, e: occurrences of these symbols in the next shorter context.
    """

    def __init__(self, top: DataFrame, order: int):
        """top: key, n of grams of order + 1 symbols."""
        self.order = order
        self.grams = {order + 1: top.select(F.col("key").alias("g"), F.col("n").alias("c"))}
        self.contexts: dict[int, DataFrame] = {}
        for j in range(order, 0, -1):
            shorter = self.grams[j + 1].groupBy(F.col("g").bitwiseAND((1 << BITS * j) - 1).alias("g")).agg(F.sum("c").alias("c"))
            self.grams[j] = materialize(shorter, "ppm-grams")
        for j in range(order + 1, 0, -1):
            g = self.grams[j].withColumn("ctx", F.shiftrightunsigned("g", BITS))
            if j > 1:
                low = self.grams[j - 1].select(F.col("g").alias("low"), F.col("c").alias("cl"))
                g = g.withColumn("low", F.col("g").bitwiseAND((1 << BITS * (j - 1)) - 1)).join(self._small(low, j - 1), "low")
            else:
                g = g.withColumn("cl", F.lit(0).cast("long"))
            self.contexts[j] = materialize(g.groupBy("ctx").agg(F.sum("c").alias("t"), F.count("*").alias("d"), F.sum("cl").alias("e")), "ppm-contexts")

    @staticmethod
    def _small(df: DataFrame, j: int) -> DataFrame:
        """Broadcast tables of up to two symbols: at most 257 * 258 rows."""
        return F.broadcast(df) if j <= 2 else df

    def seen(self, g: DataFrame) -> DataFrame:
        """lp of grams of the highest order that training texts have. g: g, c."""
        top = self.contexts[self.order + 1].select("ctx", "t", "d")
        return g.withColumn("ctx", F.shiftrightunsigned("g", BITS)).join(top, "ctx").select("g", F.log10(F.col("c") / (F.col("t") + F.col("d"))).alias("lp"))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """lp of grams of the highest order that no training text has. keys: g, distinct. Returns g, lp."""
        zero = F.lit(0).cast("long")
        u = keys.select("g", F.lit(0.0).alias("lp"), zero.alias("he"), zero.alias("hd"), F.lit(False).alias("done"))
        for j in range(self.order + 1, 0, -1):
            u = u.withColumn("part", F.col("g").bitwiseAND((1 << BITS * j) - 1)).withColumn("ctx", F.shiftrightunsigned("part", BITS))
            u = u.join(self._small(self.contexts[j], j), "ctx", "left").join(self._small(self.grams[j].withColumnRenamed("g", "part"), j), "part", "left")
            left_t, left_d = F.col("t") - F.col("he"), F.col("d") - F.col("hd")
            all_left = left_t + left_d
            open_ = ~F.col("done") & F.col("t").isNotNull()
            hit = open_ & F.col("c").isNotNull()
            step = F.when(hit, F.log10(F.col("c") / all_left)).when(open_ & (left_d > 0), F.log10(left_d / all_left)).otherwise(0.0)
            u = u.select("g", (F.col("lp") + step).alias("lp"), F.when(open_, F.col("e")).otherwise(F.col("he")).alias("he"), F.when(open_, F.col("d")).otherwise(F.col("hd")).alias("hd"), (F.col("done") | hit).alias("done"))
        # Beyond all orders: one of the symbols that no training text has.
        rest = F.log10(F.greatest(F.lit(SYMBOLS) - F.col("hd"), F.lit(1)).cast("double"))
        return u.select("g", F.when(F.col("done"), F.col("lp")).otherwise(F.col("lp") - rest).alias("lp"))


def _frequent(df: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a table of bounded size."""
    t = df.select(key, value).toArrow()
    return t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy().astype(np.float64)


def _score(order: int, tables):
    """Scores of what the broadcast tables have, one row per text (kind -1), and rows (row, kind, key, n) of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (wk, wv), (gk, gv) = tables.value
        find = {WORD: Table(wk), GRAM: Table(gk)}
        values = {WORD: np.append(wv, 0.0), GRAM: np.append(gv, 0.0)}
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for b in slices(whole, 1 << 20):
                if not b.num_rows:
                    continue
                tokens, t0, g, g0 = _split(b.column(2), order)
                rows = np.arange(row, row + b.num_rows)
                row += b.num_rows
                score, known, rest = {}, None, []
                for kind, keys, first in ((WORD, tokens, t0), (GRAM, g, g0)):
                    found = find[kind].find(keys)
                    score[kind] = np.add.reduceat(values[kind][found], first)
                    if kind == WORD:
                        known = np.add.reduceat((found >= 0).astype(np.int64), first)
                    miss = np.flatnonzero(found < 0)
                    if len(miss):
                        own = np.searchsorted(first, miss, side="right") - 1
                        k = keys[miss]
                        by = np.lexsort((k, own))
                        own, k = own[by], k[by]
                        new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (k[1:] != k[:-1])))
                        rest.append((kind, rows[own[new]], k[new].view(np.int64), np.diff(np.append(new, len(k)))))
                n = b.num_rows
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(n, -1, np.int8)), none, pa.array(np.diff(np.append(t0, len(tokens)))), b.column(0), b.column(1), pa.array(known), pa.array(score[WORD]), pa.array(score[GRAM])], NAMES)
                for kind, r, k, c in rest:
                    n = len(r)
                    none = pa.nulls(n, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(np.full(n, kind, np.int8)), pa.array(k), pa.array(c), none, pa.nulls(n, pa.bool_()), none, pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())], NAMES)

    return run


NAMES = ["row", "kind", "key", "n", "id", "held_out", "known", "base", "score"]


def ppm_scores(docs: DataFrame, held_out: Column, order: int = 4, id_col: str = "doc_id", text_col: str = "text", frequent_words: int = 1 << 17, frequent_grams: int = 1 << 19) -> DataFrame:
    """log10 probability of every text (null: empty) under PPM and under a unigram model, both learnt where not held_out.

    Texts are lower-cased (A-Z). Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens that training
    texts have), train_tokens, base_score (unigram, counts plus 0.5, unseen tokens sharing one more), score (PPM, order
    `order`). One row per row of docs, whatever its id; without training texts every symbol has probability 1 / 257.
    An empty table gives an empty result; other columns aren't read. order is at most 6 (63 bits).
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    found = count_corpus(d.where(~F.col("held_out")), order)
    totals = {r["kind"]: (r["n"], r["d"]) for r in found.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()}
    (n_words, distinct), (n_grams, _) = totals.get(WORD, (0, 0)), totals.get(GRAM, (0, 0))
    word_counts = found.where(f"kind = {WORD}").select("key", F.col("n").alias("c"))
    trie = Trie(found.where(f"kind = {GRAM}"), order)
    often = word_counts.where(F.col("c") >= max(1, n_words / frequent_words)).withColumn("lp", F.log10(F.col("c") + 0.5))
    often_grams = trie.seen(trie.grams[order + 1].where(F.col("c") >= max(1, n_grams / frequent_grams)))
    tables = spark.sparkContext.broadcast((_frequent(often, "key", "lp"), _frequent(often_grams, "g", "lp")))
    schema = "row long, kind byte, key long, n long, id long, held_out boolean, known long, base double, score double"
    scored = materialize(d.mapInArrow(_score(order, tables), schema), "ppm-scored")
    rare = scored.where("kind >= 0").select("row", "kind", "key", "n")
    w = rare.where(f"kind = {WORD}").join(word_counts, "key", "left")
    w = w.select("row", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("base"), F.lit(0.0).alias("score"))
    rare_grams = rare.where(f"kind = {GRAM}").select("row", F.col("key").alias("g"), "n")
    keys = rare_grams.select("g").distinct().join(trie.grams[order + 1], "g", "left")
    keys = materialize(keys, "ppm-rare")
    lp = materialize(trie.seen(keys.where("c is not null")).unionByName(trie.unseen(keys.where("c is null").select("g"))), "ppm-rare-scores")
    g = rare_grams.join(lp, "g").select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("n") * F.col("lp")).alias("score"))
    sums = w.unionByName(g).groupBy("row").agg(*[F.sum(c).alias(f"{c}_rare") for c in ("known", "base", "score")])
    whole = float(np.log10(n_words + 0.5 * (distinct + 1)))
    out = scored.where("kind < 0").join(sums, "row", "left")
    add = lambda c: F.col(c) + F.coalesce(f"{c}_rare", F.lit(0))
    return out.select(
        F.col("id").alias("doc_id"), "held_out", F.col("n").alias("n_tokens"), add("known").cast("long").alias("n_known"), F.lit(n_words).cast("long").alias("train_tokens"),
        (add("base") - F.col("n") * whole).alias("base_score"), add("score").alias("score"),
    )


def op5_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1)


assert START < 1 << BITS and END == SYMBOLS - 1
