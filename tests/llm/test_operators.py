"""The other operators against brute force, planted cases and odd rows (nulls, empty, repeated, clashing columns)."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenframe.llm.exact import exact_dedup
from lumenframe.llm.minhash import hyperminhash_components
from lumenframe.llm.mixing import cyclic_targets, document_rows, mix, totals_of
from lumenframe.llm.packing import pack, pieces
from lumenframe.llm.passages import chained, common_words, fuzzy_passages, grow, minimizers
from lumenframe.llm.pivots import pivot_links
from lumenframe.llm.tokens import frame, read_frame, read_records, tokenizer, vocabulary, write_records
from lumenframe.llm.toxicity import PARTS, WINDOW, fit, marginals, tag_documents, train
from lumenframe.session import new_path

RNG = np.random.default_rng(11)
VOCAB = ["".join(RNG.choice(list("abcdefghij"), 6)) for _ in range(3000)]


def words(n):
    return " ".join(RNG.choice(VOCAB, n))


BASE = words(200)
DOCS = [(0, BASE, "a"), (1, BASE.upper(), "a"), (2, BASE + " tail", "b"), (3, None, None), (4, "", "b"), (5, " \n", "a"), (6, words(30), "c"), (7, words(400), "a"), (8, "two words", "a"), (9, "Two Words", None), (6, words(30), "c"), (10, "é" * 50 + " " + words(5000), "a"), (11, "a<|endoftext|>b  <|endoftext|>\n c<|endof", "a")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, 1, 2) for d in DOCS], SCHEMA + ", kept int, component_id int").cache()


def union_find(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_exact(docs, spark):
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t, _ in DOCS:
        groups[norm(t)].append(i)
    want = sorted((i, max(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in DOCS)
    assert sorted((r["id"], r["keep_id"], r["group_size"], r["digest"]) for r in exact_dedup(docs, keep="max").collect()) == want
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates(docs, spark):
    import re

    sets = defaultdict(set)
    for i, t, _ in DOCS:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] |= {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union_find(ids, links)
    got = hyperminhash_components(docs).collect()
    assert len(got) == len(DOCS) and all(r["component_id"] == want[r["doc_id"]] for r in got)
    assert hyperminhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates_of_a_large_bucket_in_blocks(spark):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):  # copies with 0 to 14 words changed: some link, some don't
        w = list(base)
        for k in rng.sample(range(150), i % 15):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w), "s"))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union_find(sorted(sets), links)
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash_components(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=4).collect()}
    assert got == {i: want[i] for i in sets} and len(set(got.values())) > 10


def test_near_duplicates_linked_by_one_pair_of_many(spark):
    """Two groups with one link between them, which is the 7th of its members until the groups themselves are merged; 60
    documents of smaller ids share their buckets and link with nothing, so the first links don't merge the groups."""

    def changed(w, name, places):
        w = list(w)
        for p in places:
            w[p] = f"{name}_{p}"
        return w

    rows, want = [], {}
    for salt in range(6):
        x = [f"s{salt}w{i}" for i in range(300)]
        y = changed(x, f"s{salt}y", range(5, 300, 37))  # 8 words: 274 of 322 shingles
        two = list(enumerate((x, y)))
        texts = [changed(v, f"s{salt}d{s}{i}", [(7 * i + 20 * j + s) % 75 * 4 + 2 for j in range(12)]) for s, v in two for i in range(30)]
        for s, v in two:
            near = [changed(v, f"s{salt}n{s}{i}", [50 * i + 31]) for i in range(6)]
            texts += [*near, v] if s else [v, *near]
        sets = [{tuple(w[k : k + 3]) for k in range(298)} for w in texts]
        links = [(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
        want |= {100 * salt + i: 100 * salt + r for i, r in union_find(range(len(texts)), links).items()}
        rows += [(100 * salt + i, " ".join(w)) for i, w in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=85, rows=5).collect()}
    assert got == want and len(set(want.values())) == 6 * 61


def test_rows_compared_of_a_large_bucket_grow_as_its_members(spark, monkeypatch):
    """Copies of one text with 1 to 9 of 150 words changed, of which most don't link: rows compared grow in proportion to the members,
    where members that all meet block by block made them grow with the square."""
    import random

    from lumenframe.llm import minhash

    compare, dealt = minhash._compare, []

    def counted(*args):
        run, n = compare(*args), spark.sparkContext.accumulator(0)
        dealt.append(n)

        def count(batches):
            for b in batches:
                n.add(b.num_rows)
                yield b

        return lambda batches: run(count(batches))

    monkeypatch.setattr(minhash, "_compare", counted)
    rows = {}
    for m in (80, 320):
        rng = random.Random(m)
        texts = []
        for i in range(m):
            w = [f"w{k}" for k in range(150)]
            for k in rng.sample(range(150), 1 + i % 9):
                w[k] = f"x{i}_{k}"
            texts.append(w)
        for i in (7, 8):  # far from the others, but not from this one
            texts.append([*texts[i][:75], "y", *texts[i][76:]])
        sets = [{tuple(w[k : k + 5]) for k in range(146)} for w in texts]
        links = [(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = union_find(range(len(texts)), links)
        dealt.clear()
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in hyperminhash_components(docs, block=8).collect()} == want
        assert want[m] == 7 and want[m + 1] == 8
        rows[m] = sum(n.value for n in dealt)
    assert 0 < rows[320] <= 5 * rows[80], rows


def test_vectors(spark):
    base = RNG.normal(size=(40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + 0.04 * RNG.normal(size=16)], i % 2) for i in range(240)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, rows[0][1], 0)]
    got = {r["vec_id"]: r for r in pivot_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    ok = [(i, np.array(v), k) for i, v, k in rows if k is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for a, u, k in ok for b, v, m in ok if a < b and k == m and u @ v / np.sqrt(u @ u * (v @ v)) >= 0.98]
    n = Counter(x for p in links for x in p)
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(rows) and all(r["n_links"] <= n[i] for i, r in got.items()) and found >= 0.9 * 2 * len(links) > 0
    assert all(got[i]["n_links"] == 0 for i in (900, 901, 902, 903, 904))


def test_buckets_with_all_pairs_in_the_window_are_done():
    import tracemalloc

    import pyarrow as pa

    from lumenframe.llm.minhash import BUCKETS, PARITY, _compare

    def batch(bucket, side, alike):
        n = len(side)
        regs = np.ones((n, BUCKETS), np.uint16) if alike else np.random.default_rng(n).integers(1, 1 << 16, (n, BUCKETS)).astype(np.uint16)
        cols = [np.full(n, bucket), np.full(n, bucket), side, np.arange(n), np.full(n, 100), np.arange(n)]
        binary = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (regs, np.zeros((n, PARITY // 8), np.uint8))]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), *binary], ["g", "bucket", "side", "id", "n", "comp", "regs", "parity"])

    run, found = _compare(80, 100, 2), {}
    for b in run(iter([batch(7, np.zeros(2, int), True), batch(8, np.zeros(9, int), True)])):
        for r in b.to_pylist():
            found.setdefault(r["bucket"], []).append((r["a"], r["b"]))
    assert found[8] == [(None, None)] and 7 not in found and (0, 1) in found[None]
    wide = [batch(9, np.arange(2048) % 2, False)]
    list(run(iter(wide)))
    tracemalloc.start()
    list(run(iter(wide)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6


def test_vectors_of_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    copies = unit(np.sqrt(0.985) * unit(rng.normal(size=(1, 64))) + np.sqrt(0.015) * unit(rng.normal(size=(2000, 64))))
    v = np.concatenate([copies, rng.normal(size=(4000, 64))])
    want = (copies @ copies.T >= 0.98).sum(axis=1) - 1
    got = {r["vec_id"]: r for r in pivot_links(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>").selectExpr("*", "1 AS label")).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (links[:2000] <= want).all() and (links[2000:] == 0).all()
    assert links[:2000].sum() >= 0.9 * want.sum(), links[:2000].sum() / want.sum()
    assert {got[i]["component_id"] for i in range(2000) if want[i]} == {0}


def test_mixing(docs, spark):
    rows = document_rows(docs, spark.createDataFrame([(7, 1)], "doc_id long, quality int")).cache()
    targets = {r["source"]: r for r in cyclic_targets(totals_of(rows)).collect()}
    size = Counter()
    for _, t, s in DOCS:
        size[s] += len((t or "").split())
    assert {s: r["source_size"] for s, r in targets.items()} == dict(size)
    assert all(r["target"] <= 2 * r["source_size"] + 1e-6 for r in targets.values())
    assert sum(r["target"] for r in targets.values()) == pytest.approx(1.5 * sum(size.values()))
    out = mix(rows, cyclic_targets(totals_of(rows))).collect()
    taken = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - r["target"]) <= 1 for s, r in targets.items())


def test_mixing_of_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    empty = document_rows(spark.createDataFrame([], SCHEMA), labels)
    assert mix(empty, cyclic_targets(totals_of(empty))).count() == 0
    rows = [(1, words(9), "a"), (1, words(4), "a"), (None, words(5), None), (2, words(7), None)]
    d = document_rows(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0 AS target"), labels, columns=("target",))
    out = mix(d, cyclic_targets(totals_of(d)))
    assert out.columns.count("target") == 1
    first, again = ({(r["id"], r["size"]): r["taken"] for r in mix(d.repartition(n), cyclic_targets(totals_of(d))).collect()} for n in (1, 4))
    assert first == again and sum(first.values()) == pytest.approx(1.5 * 25, abs=2)


def test_vectors_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, id int, label2 int, v int, n int"
    assert pivot_links(spark.createDataFrame([], schema)).count() == 0
    v = [float(x) for x in RNG.normal(size=8)]
    rows = [(1, v, 0), (1, v, 0), (2, v, 0), (3, v[:5], 0), (4, v[:5], 0), (None, v, 0), (5, v, 1)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in pivot_links(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema)).where("vec_id is not null").collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5)]


def test_exact_where_digests_collide(spark, monkeypatch):
    """With one digest for all texts, texts are told apart by themselves."""
    from pyspark.sql import functions as F

    from lumenframe.llm import exact

    monkeypatch.setattr(exact.F, "sha2", lambda c, bits: F.when(c.isNotNull(), F.lit("same")))
    rows = [(1, "a"), (2, "A"), (3, "b"), (4, "x" * 300_000), (5, "X" * 300_000), (6, None), (7, "")]
    got = sorted((r["id"], r["keep_id"], r["group_size"]) for r in exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (5, 4, 2), (6, 6, 2), (7, 6, 2)]


def test_records_and_packing(docs, spark):
    tok = Tokenizer.from_file(vocabulary())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t, _ in DOCS if i != 6}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = sorted(read_records(write_records(docs, new_path(spark, "t"), vocabulary(), shards=3)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(i for i, *_ in DOCS)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert all(r["ids_crc32"] == crc([*ids[r["doc_id"]], 2]) for r in got if r["doc_id"] != 6)
    shuffled = read_records(write_records(docs, new_path(spark, "t"), vocabulary(), shards=2), block=3, shuffle_seed=5).collect()
    assert sorted(shuffled) == sorted(got)
    empty = spark.createDataFrame([], SCHEMA)
    assert read_records(write_records(empty, new_path(spark, "t"), vocabulary())).count() == pack(pieces(empty, vocabulary())).count() == 0
    packed = pack(pieces(docs, vocabulary())).collect()
    by_seq = defaultdict(list)
    for r in packed:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] != 6:
            x = [*ids[r["doc_id"]], 0]
            assert r["ids_crc32"] == crc(x[r["start"] : r["start"] + r["length"]])
    for spans in by_seq.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) <= 2048
    total = sum(r["length"] for r in packed)
    assert len(by_seq) <= -(-total // 2048) + 1
    import io

    data = frame(b"abc")
    assert read_frame(io.BytesIO(data)) == b"abc"
    with pytest.raises(ValueError, match="damaged"):
        read_frame(io.BytesIO(data[:-1] + b"?"))


def test_memory_of_a_task_that_cuts_pieces():
    import random
    import tracemalloc

    import pyarrow as pa

    from lumenframe.llm.packing import _cut

    rng = random.Random(3)
    texts = [" ".join(rng.choices(VOCAB[:500], k=3000)) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tokenizer(vocabulary()).encode(pa.array(texts[:1]))
    tracemalloc.start()
    rows = sum(b.num_rows for b in _cut(vocabulary(), 0, 2048, 400_000)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= 500 and most < 80e6


def test_units_against_the_library():
    import random

    import pyarrow as pa

    tok, rng = tokenizer(vocabulary()), random.Random(1)
    parts = ["a", "b", "The", "'s", "'ll", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2003", "é", "中", "1", "23", ".", ",", "<|endoftext|>", "<|endof", "\x1c", "\x85", "!", "’", "\u0301", "😀", "_", "'", "\r\n", "\x00"]
    for _ in range(1500):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) if rng.random() > 0.05 else None for _ in range(6)]
        ids, at = tok.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tok.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_passages(spark):
    p, q = words(70), words(80).split()
    fuzzy = q[:20] + ["new"] + q[21:45] + q[47:]
    rows = [(1, f"{words(100)} {p} {words(60)}"), (2, f"{p.upper()} {words(90)}"), (3, f"{words(20)} {' '.join(q)}"), (4, f"{' '.join(fuzzy)} {words(50)}"), (5, words(300)), (6, None), (None, p), (7, ""), (8, f"{words(9)} {p}")]
    got = fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {frozenset((r["doc_id"], r["other_id"])) for r in got} == {frozenset(x) for x in ((1, 2), (1, 8), (2, 8), (3, 4))}
    r = next(r for r in got if {r["doc_id"], r["other_id"]} == {1, 2})
    assert (r["end_word"] - r["start_word"], r["other_end"] - r["other_start"]) == (70, 70) and r["similarity"] == 1
    assert all(0.8 <= r["similarity"] <= 1 for r in got)
    assert fuzzy_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_two_passages_of_a_pair(spark):
    rows, want = [], {}
    for n, (size, left, right) in enumerate(((60, 0, 40), (100, 80, 80), (200, 0, 300))):
        p, q = words(size), words(size)
        rows += [(2 * n, f"{p} {words(left)} {q}"), (2 * n + 1, f"{p} {words(right)} {q}")]
        want[2 * n + 1] = {(0, size), (size + right, 2 * size + right)}
    got = defaultdict(set)
    for r in fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["other_id"] == r["doc_id"] - 1 and r["similarity"] >= 0.8
        got[r["doc_id"]].add((r["start_word"], r["end_word"]))
    for i, places in want.items():  # chance growth at an end is a word or two
        assert len(got[i]) == 2 and all(abs(a - c) < 5 and abs(b - d) < 5 for (a, b), (c, d) in zip(sorted(got[i]), sorted(places), strict=True))


def test_passages_between_documents_that_are_never_first_or_last(spark):
    p = words(60).split()
    parts = [" ".join(p[i : i + 45]) for i in (0, 8, 15)]
    quotes = lambda: " ".join(f"{q} {words(30)}" for q in parts)
    rows = [(1, quotes()), (2, f"{words(40)} {' '.join(p)} {words(20)}"), (5, f"{words(10)} {' '.join(p)} {words(50)}"), (9, quotes())]
    got = fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any({r["doc_id"], r["other_id"]} == {2, 5} and r["end_word"] - r["start_word"] >= 60 for r in got)


def test_passages_of_repeated_lines_odd_rows_and_clashes(spark):
    line = words(20)
    long_ = f"{words(30)} {' '.join([line] * 400)} {words(30)}"
    rows = [(1, long_), (2, " ".join([line] * 400)), (2, " ".join([line] * 400)), (3, words(200)), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS seed", "2 AS words", "3 AS id")
    got = fuzzy_passages(df).collect()
    covered = set()
    for r in got:
        assert {r["doc_id"], r["other_id"]} == {1, 2}
        covered |= set(range(r["start_word"], r["end_word"])) if r["doc_id"] == 2 else set(range(r["other_start"], r["other_end"]))
    assert len(covered) >= 0.95 * 8000


@pytest.mark.parametrize("every", [5, 6, 7, 10, "random"])
def test_recall_of_fuzzy_passages(spark, every):
    """Pairs with a passage of 60 words of which every fifth (80 % alike) to tenth differs, or 15 % at random, in longer texts: at least 0.9 are found."""
    rows, alike = [], 0
    rng = np.random.default_rng(5)
    for i in range(60):
        p = words(60).split()
        other = rng.random(60) < 0.15 if every == "random" else np.arange(60) % every == every // 2
        other[[0, 59]] = False
        q = [f"other{i}x{j}" if other[j] else w for j, w in enumerate(p)]
        alike += 60 - other.sum() >= 48
        rows += [(2 * i, f"{words(50)} {' '.join(p)} {words(30)}"), (2 * i + 1, f"{words(20)} {' '.join(q)} {words(60)}")]
    got = {frozenset((r["doc_id"], r["other_id"])) for r in fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {frozenset((2 * i, 2 * i + 1)) for i in range(60)} and len(got) >= 0.9 * alike


def best_chain(a, k, gap=0.2):
    """The score of the best chain of matches by all pairs, as chained() counts it: anchors are runs on one diagonal."""
    anchors = []
    for d in {x - y for x, y in a}:
        xs = sorted(x for x, y in a if x - y == d)
        runs = [[xs[0], xs[0] + k]]
        for x in xs[1:]:
            if x <= runs[-1][1]:
                runs[-1][1] = x + k
            else:
                runs.append([x, x + k])
        anchors += [(s, e, s - d, e - d) for s, e in runs]
    score = {}
    for c in sorted(anchors, key=lambda c: (c[0], c[2])):
        before = [score[b] - gap * (c[0] - b[1] + c[2] - b[3]) for b in score if b[1] <= c[0] and b[3] <= c[2]]
        score[c] = c[1] - c[0] + max([0.0, *before])
    return max(score.values())


def test_passage_parts():
    h = RNG.integers(0, 1 << 60, 500).astype(np.uint64)
    want = sorted({i + int(np.argmin(h[i : i + 12])) for i in range(489)})
    assert minimizers(h, 12).tolist() == want
    x, y = RNG.integers(0, 5, 60).tolist(), RNG.integers(0, 5, 50).tolist()
    best = [[0] * 51 for _ in range(61)]
    for i in range(60):
        for j in range(50):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    assert common_words(x, y) == best[60][50]
    for _ in range(200):  # the best chain's score against all pairs
        a = np.unique(RNG.integers(0, 60, (14, 2)), axis=0)
        got = chained(a[:, 0], a[:, 1], 6)[0]
        gaps = sum(n[0] - m[1] + n[2] - m[3] for m, n in zip(got, got[1:], strict=False))
        assert sum(c[1] - c[0] for c in got) - 0.2 * gaps == pytest.approx(best_chain([tuple(v) for v in a.tolist()], 6))
    assert grow([1, 2, 3, 9, 5, 6, 7, 8], [1, 2, 3, 4, 5, 6, 7, 8]) == (8, 8)


def test_toxicity(spark):
    bad = ["grumble", "snarky", "vileness"]
    rows, labels = [], []
    for i in range(400):
        w = words(40).split()
        if i % 2:
            for k in RNG.choice(40, 4, replace=False):
                w[k] = bad[int(RNG.integers(3))]
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = train(docs.where("doc_id < 300"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = spark.createDataFrame([(1000, None), (1001, ""), (None, "Snarky, snarky!"), (1002, "no " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in tag_documents(docs.where("doc_id >= 300").union(odd), model).collect()}
    assert np.mean([(got[i]["score"] >= 0.7) == bool(i % 2) for i in range(300, 400)]) > 0.97
    text = dict(rows)
    assert {text[i][s["start"] : s["end"]] for i in range(301, 400, 2) for s in got[i]["spans"]} <= {" ".join(x) for n in (1, 2, 3) for x in np.array(np.meshgrid(*[bad] * n)).T.reshape(-1, n)}
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["score"] > 0.7 and got[1001]["score"] < 0.5
    assert train(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r["score"] for r in tag_documents(odd, None).collect()} == {0.0}


def test_marginals_and_gradient():
    t = RNG.normal(size=(2, 2))
    lengths = np.array([1, 9, 150, 64, 3])
    u = RNG.normal(size=lengths.sum()) * 2
    got = marginals(u, lengths, t)
    for i, (a, n) in enumerate(zip(np.append(0, np.cumsum(lengths)[:-1]), lengths, strict=True)):
        m = [np.exp(t) * np.array([1, np.exp(v)]) for v in u[a : a + n]]
        f, b = [np.array([1.0, 0.0])], [np.ones(2)]
        for x in m:
            f.append(f[-1] @ x / (f[-1] @ x).sum())
        for x in m[::-1]:
            b.append(x @ b[-1] / (x @ b[-1]).sum())
        want = [f[k + 1] * b[n - 1 - k] for k in range(n)]
        assert np.allclose(got[a : a + n], [v[1] / v.sum() for v in want]), i
    x = np.full((200, WINDOW, PARTS), 7, np.int32)
    y = (RNG.random((200, WINDOW)) < 0.2).astype(np.int64)
    x[y == 1] = 99
    w, tr = fit(x, y, np.ones(y.shape, bool))
    assert w[99] * PARTS + tr[0, 1] > tr[0, 0] and w[7] * PARTS + tr[0, 1] < tr[0, 0]


def test_passages_at_the_threshold_that_begin_or_end_with_unlike_words():
    from lumenframe.llm.passages import passages

    x = list(range(100))
    y = list(range(500, 600))
    y[25:75] = x[25:75]
    for i in (25, 26, 30, 31, 40, 41, 55, 60, 73, 74):  # 10 of the 50 words from 25 on, two at either end
        y[i] = 700 + i
    ((x0, x1, y0, y1, similarity, _),) = passages(x, y, [[42, 49, 42, 49]], 50, 80)
    assert x0 == y0 <= 27 and 73 <= x1 == y1 == x0 + 50 and similarity == 0.8
    y[50] = 750
    assert not list(passages(x, y, [[42, 49, 42, 49]], 50, 80))
