"""Line dedup, periodic runs and fill-in-middle against brute force, with odd rows, changes of the index and clashing columns."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import lines as L
from lumenframe.llm import middle as M
from lumenframe.llm import periods as P
from lumenframe.llm.lines import OP11_SQL, Cuckoo, LineIndex
from lumenframe.llm.middle import OP13_SQL, Checkpoints, fill_in_middle, op13_fill_in_middle, restored
from lumenframe.llm.periods import OP12_SQL, kept_parts, op12_periodic_runs, periodic_runs, repeated_tail, word_runs

RNG = np.random.default_rng(21)
SCHEMA = "doc_id long, text string"


# Lines


def keyed(line):
    bare = line.strip(" \t\n\x0b\f\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)


def plain_lines(docs, least=10):
    """Kept texts by row: (doc_id, n_lines, n_dropped, kept)."""
    holders = defaultdict(set)
    for i, t in docs:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(keyed(line)) >= least:
                    holders[keyed(line)].add(i)
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or len(keyed(x)) < least or len(holders[keyed(x)]) < 2 or min(holders[keyed(x)]) == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=str)


LINES = [f"Line number {k} {'é' * (k % 3)}" for k in range(12)] + ["short", "", "  Padded LINE one \t", "padded line ONE", "ÄÖÜ äöü ÄÖÜ äöü"]
DOCS = [(i, "\n".join(RNG.choice(LINES, RNG.integers(0, 9)))) for i in range(3, 60)] + [(1, None), (2, ""), (60, "\n\n"), (61, "\n".join(["the same line"] * 5)), (62, "The Same Line"), (70, "row of an id\nanother row here"), (70, "row of an id\nthe same line"), (None, "Line number 3 \nthe same line"), (90, "one long line " * 20_000 + "\n" + "Line number 1 é")]


def test_lines_against_brute_force_and_odd_rows(spark):
    df = spark.createDataFrame(DOCS, SCHEMA).selectExpr("*", "1 AS key", "2 AS row", "3 AS at", "4 AS lo")
    index = LineIndex.empty(spark, shards=5).insert(df)
    assert rows_of(index.apply(df)) == plain_lines(DOCS)
    none = index.dropped(budget=0)  # no filter is broadcast: the same references
    assert none.exceptAll(index.dropped()).count() == 0 and none.count() == index.dropped().count()
    empty = spark.createDataFrame([], SCHEMA)
    assert LineIndex.empty(spark).insert(empty).apply(empty).count() == 0


def test_lines_come_and_go(spark):
    """After inserts and deletions the index is that of the documents that are left, counts and filters too."""
    docs = [d for d in DOCS if d[0] is not None]
    parts = [docs[:20], docs[20:45], docs[45:]]
    index = LineIndex.empty(spark, shards=3)
    for p in parts:
        index = index.insert(spark.createDataFrame(p, SCHEMA))
    df = spark.createDataFrame(docs, SCHEMA)
    assert rows_of(index.apply(df)) == plain_lines(docs)
    gone = {3, 7, 61, 8, 20, 33, 90, 1234}
    less = index.delete(spark.createDataFrame([(i,) for i in gone] + [(None,)], "doc_id long"))
    left = [d for d in docs if d[0] not in gone]
    left_df = spark.createDataFrame(left, SCHEMA)
    assert rows_of(less.apply(left_df)) == plain_lines(left)
    assert rows_of(index.apply(df)) == plain_lines(docs)  # the earlier index stays
    want = LineIndex.empty(spark, shards=3).insert(left_df)
    for got in (less, less.compact()):
        assert got.current().exceptAll(want.current()).count() == 0 == want.current().exceptAll(got.current()).count()
    used = {r["shard"]: r["used"] for r in less.filters.collect()}
    assert sum(used.values()) == want.current().count()
    keys = less.current().withColumn("shard", L.shard_of(F.col("key"), 3)).select("shard", "key", "n", "lo", "hi")
    assert L.in_filters(less.filters, keys).where("not maybe").count() == 0
    back = less.insert(spark.createDataFrame([d for d in docs if d[0] in gone], SCHEMA))
    assert rows_of(back.apply(df)) == plain_lines(docs)
    everything = back.delete(df)
    assert everything.current().count() == 0 and sum(r["used"] for r in everything.filters.collect()) == 0


def test_cuckoo_filter():
    keys = RNG.integers(0, 1 << 63, 60_000).astype(np.uint64)
    f = Cuckoo.sized(len(keys))
    f.insert(keys)
    others = RNG.integers(0, 1 << 63, 60_000).astype(np.uint64)
    assert f.find(keys).all() and f.find(others).mean() < 0.002 and not len(f.stash[0])
    f.delete(keys[:30_000])
    assert f.find(keys[30_000:]).all() and f.find(keys[:30_000]).mean() < 0.002
    assert (f.slots != 0).sum() == 30_000
    tiny = Cuckoo([np.zeros((2, 4), np.uint16)])  # too small: the rest is stashed and found, and goes again
    tiny.insert(keys[:20])
    assert tiny.find(keys[:20]).all() and len(tiny.stash[0])
    tiny.delete(keys[:20])
    assert not (tiny.slots != 0).any() and not len(tiny.stash[0])
    same = np.repeat(keys[:1], 5)
    tiny.insert(same)
    tiny.delete(same[:4])
    assert tiny.find(same[:1]).all()


# Runs


def plain_runs(w, least=6, times=4):
    """All runs by trying every start and period."""
    out, n = [], len(w)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j + p - i
            if size >= max(least, times * p) and not any(p % q == 0 and all(w[k] == w[k + q] for k in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_brute_force(letters, monkeypatch):
    for k in range(150):
        n = int(RNG.integers(0, 90))
        w = RNG.integers(0, letters, n)
        if k % 2 and n > 12:
            p = int(RNG.integers(1, n // 5 + 1))
            a = int(RNG.integers(0, n // 3))
            w[a:] = w[a + np.arange(n - a) % p]
        want = plain_runs(w.tolist())
        assert periodic_runs(w) == want
        with monkeypatch.context() as m:  # the way that longer texts go
            m.setattr(P, "TABLE", 0)
            assert periodic_runs(w) == want
        dropped = set()
        for s, size, p in want:
            dropped |= set(range(s + p, s + size))
        assert [i for a, b in kept_parts(n, want) for i in range(a, b)] == [i for i in range(n) if i not in dropped]
    assert periodic_runs(np.tile(np.arange(3), 4), 6, 3) == [(0, 12, 3)]


def test_word_runs_of_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 4), (5, "é ü\x0bé ü\té ü\né ü x"), (5, "a"), (None, "b " * 9), (6, "tick " * 50_000), (7, " ".join(f"w{k % 7000}" for k in range(30_000)))]
    df = spark.createDataFrame(texts, SCHEMA).selectExpr("*", "1 AS runs", "2 AS id", "3 AS n_words")
    got = {(r["id"], r["n_words"]): r for r in word_runs(df).collect()}
    assert len(got) == len(texts)
    assert [tuple(r) for r in got[4, 8]["runs"]] == [(0, 8, 2)] and got[4, 8]["collapsed"] == "a b"
    assert got[5, 9]["collapsed"] == "é ü x" and got[5, 1]["collapsed"] == "a" and got[1, 0]["collapsed"] == "" == got[3, 0]["collapsed"]
    assert got[6, 50_000]["collapsed"] == "tick" and [tuple(r) for r in got[7, 30_000]["runs"]] == [(0, 30_000, 7000)]
    assert word_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repeated_tail(None, 0) is None


# Fill-in-middle


def plain_units(text, unit):
    return re.findall({"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "char": r"(?s)."}[unit], text)


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_checkpoints(unit, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 37)
    for _ in range(60):
        text = "".join(RNG.choice(list("ab é😀\n\n \t"), int(RNG.integers(0, 200))))
        index = Checkpoints(np.frombuffer(text.encode(), np.uint8), unit, 5)
        parts = plain_units(text, unit)
        if unit == "word" and parts:  # white space goes with the word before it, the first with the one after it
            starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            cuts = [0, *starts[1:], len(text)]
            parts = [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert index.n == len(parts)
        for k in range(len(parts) + 1):
            before = "".join(parts[:k])
            assert index.cut(k) == (len(before.encode()), len(before))


def test_middle_against_brute_force(spark):
    texts = [(1, None), (2, ""), (3, "one line"), (4, "has <S> in it\nand more"), (None, "no id\nat all\n"), (5, "x\n" * 70_000 + "é"), (6, "a\nb"), (6, "c\nd\n"), (7, "tail <\nS>\n<P"), (8, "\n\n\n")]
    texts += [(100 + k, "".join(RNG.choice(list("ab é\n😀"), 80))) for k in range(60)]
    df = spark.createDataFrame(texts, SCHEMA).selectExpr("*", "1 AS id", "2 AS form", "3 AS n")
    out = fill_in_middle(df, rate=70)
    got = defaultdict(list)
    for r in out.withColumn("back", restored(F.col("output"), F.col("form"))).collect():
        got[r["id"]].append(tuple(r)[1:])
    forms = set()
    for i, t in texts:
        t = t or ""
        units = plain_units(t, "line")
        d = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = [int(d[k : k + 8], 16) for k in range(0, 32, 8)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 70 else "spm" if h[3] % 100 < 50 else "psm"
        forms.add(form)
        want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sizes = (None, None) if form == "plain" else (len(p), len(m))
        assert (len(units), form, *sizes, want, t) in got[i]
    assert forms == {"plain", "psm", "spm"}
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aba", "q", "r"), ("", "a", "b"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fill_in_middle(df, marks=marks)
    words = fill_in_middle(df, unit="word", spm=0, marks=("[p]", "[s]", "[m]"))
    assert words.where(restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]")) != F.col("output")).count() > 0
    texts_of = {(i, t or "") for i, t in texts}
    assert {(r[0], r[1]) for r in words.select("id", restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]"))).collect()} == texts_of


# Queries


@pytest.mark.parametrize(("query", "sql"), [(op12_periodic_runs, OP12_SQL), (op13_fill_in_middle, OP13_SQL), (L.op11_line_dedup, OP11_SQL)])
def test_queries_equal_their_sql(spark, query, sql):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    got = query(spark, sf)
    cols = sorted(got.columns)
    rel = con.execute(sql)
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
