"""Ranked search, top-k search and periodic runs against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables and columns of clashing names."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pitrank.llm import op11_lexical_search as op11
from pitrank.llm import op12_topk_search as op12
from pitrank.llm import op13_periodic_runs as op13
from pitrank.llm.blocks import written
from pitrank.llm.words import words_of

R = random.Random(5)
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    split = [(i, terms_of(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = collections.Counter(x for _, w in split for x in set(w))
    out = []
    for item, text in sorted({(i, t) for i, t in items if t is not None}, key=str):
        own, found = collections.Counter(terms_of(text)), []
        for i, w in split:
            tf, m = collections.Counter(w), 75 + (25 * len(w) * n // total if total else 0)
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * tf[x] // (1000 * tf[x] + 12 * m)) for x, c in own.items() if tf[x])
            if score > 0:
                found.append((-score, float("inf") if i is None else i))
        out += [(str(item), r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


VOCAB = [f"t{i}" for i in range(60)] + ["Ärger", "日本", "X9", "U.S."]


def prose(n):
    return " ".join(VOCAB[min(int(R.expovariate(0.08)), len(VOCAB) - 1)] for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " .,; ", "one", prose(40), prose(9000)] + [prose(R.randrange(1, 80)) for _ in range(500)]
    copy = prose(30)
    rows = [(i, t, "en", i) for i, t in enumerate(texts + [copy] * 40)]
    rows += [rows[7], (None, copy, None, 1), (None, rows[9][1], None, 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, rank string, score int").repartition(5).cache()


@pytest.mark.parametrize("segment, slice_", [(1 << 20, 1 << 20), (4000, 300)])
def test_lexical_search(spark, docs, segment, slice_):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(i, prose(R.randrange(1, 30))) for i in range(12)] + [(12, "t3 t3 T3 日本"), (13, None), (14, ""), (15, "nowhere"), (None, "t1 ärger"), (3, "x9")]
    items += [items[0], (20, data[5][1]), (21, " ".join(VOCAB))]
    bench = spark.createDataFrame(items, "item_id int, text string").withColumnRenamed("text", "doc_id")
    index = written(op11.build(docs, segment_bytes=segment))
    got = op11.search(index, bench, text="doc_id", query_bytes=slice_).collect()
    assert sorted(((str(r.item_id), r.rank, float("inf") if r.doc_id is None else r.doc_id, r.score) for r in got), key=str) == ranked(data, items, 20)
    assert op11.search(index, bench.limit(0), text="doc_id").count() == 0
    assert op11.search(op11.build(docs.limit(0)), bench, text="doc_id").count() == 0


def test_blocks_without_a_chance_are_not_decompressed():
    texts = ["common " * 3 + prose(20)] * 4000
    for i in range(20):
        texts[200 * i] = "rare word here"
    texts[200] = "rare rare rare"
    row = op11._segment(pa.array(texts, pa.large_string()), np.arange(4000)).to_pylist()[0]
    s = op11.Segment(row, 4000, row["n_terms"])
    hashes = words_of(pa.array(["rare common"], pa.large_string()), op11._BYTES).hashes
    docs, scores = s.search(hashes, np.array([5000, 10]), 5000 * 600_000)
    assert docs.tolist() == [200] and len(s.read) == 2  # the rare list's only block, and one of 63 of the other list
    docs, scores = s.search(hashes, np.array([5000, 10]), 1)
    assert len(docs) == 4000 and len(s.read) > 60


def nearest(rows, queries, k):
    out = []
    for i, v in queries:
        found = []
        for j, w in rows:
            if i is None or j != i:
                n = min(len(v), len(w))
                found.append((-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(v[:n], w[:n], strict=True)), float("inf") if j is None else j))
        out += [(str(i), r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def vectors():
    g = np.random.default_rng(3)
    centres = g.normal(size=(6, 12))
    v = [(int(i), (centres[i % 6] + 0.1 * g.normal(size=12)).tolist()) for i in range(900)]
    v += [(1000 + i, v[0][1]) for i in range(300)] + [(2000, [0.5] * 5), (2001, []), (2002, [0.0] * 12), (2003, [1000.0] * 12), (None, v[3][1]), (7, v[7][1])]
    return v


def test_topk_search(spark, monkeypatch):
    rows = vectors()
    odd = [(3000, None), (3001, [1.0, None]), (3002, [float("nan")] * 12), (3003, [float("inf")] * 12)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, rank string, score int").repartition(4)
    queries = [(i, v) for i, v in rows if i is not None and i % 90 == 7] + [(2000, rows[1200][1]), (2003, rows[1203][1]), (1050, rows[950][1]), (None, rows[5][1])]
    asked = spark.createDataFrame(queries + odd[:2], "vec_id long, embedding array<double>")
    want = nearest(rows, queries, 10)
    for block, size in ((4096, 1 << 15), (200, 5)):
        monkeypatch.setattr(op12, "BLOCK_ROWS", block)
        made, sample = op12.build(table)
        got = op12.search(written(made), sample, asked, query_rows=size).collect()
        assert sorted(((str(r.query_id), r.rank, float("inf") if r.vec_id is None else r.vec_id, r.score) for r in got), key=str) == want
    made, sample = op12.build(table.limit(0))
    assert op12.search(written(made), sample, asked).count() == 0
    few, sample = op12.build(table.filter("vec_id < 3"))
    assert op12.search(written(few), sample, table.filter("vec_id = 1")).count() == 2


def test_large_products_stay_exact():
    a = np.array([[2**31 - 5, 3], [2**20, -7]])
    assert op12.products(a, a).tolist() == [[(2**31 - 5) ** 2 + 9, (2**31 - 5) * 2**20 - 21], [(2**31 - 5) * 2**20 - 21, 2**40 + 49]]


def test_far_node_pairs_are_pruned():
    g = np.random.default_rng(1)
    centres = g.normal(size=(40, 16)) * 3
    rows = np.floor(1024 * (centres[np.arange(4000) % 40] + 0.05 * g.normal(size=(4000, 16)))).astype(np.int64)
    r, q = op12.Tree.make(np.arange(4000), rows), op12.Tree.make(np.arange(0, 4000, 50), rows[::50])
    for t in (r, q):  # covering and separation of the cover tree
        for n in range(len(t.start)):
            own = t.rows[t.start[n] : t.end[n]] - t.at[n]
            assert np.sqrt((own**2).sum(axis=1)).max() <= t.radius[n] + 1e-6
            c = t.at[t.child[n] : t.child[n] + t.children[n]]
            if len(c):
                apart = np.sqrt(((c[:, None] - c) ** 2).sum(axis=2))[~np.eye(len(c), dtype=bool)].min()
                assert apart >= t.radius[t.child[n] : t.child[n] + t.children[n]].max() - 1e-6
    heaps = op12.Heaps(len(q.ids), 10, np.full(len(q.ids), op12.LEAST))
    op12.dual(q, r, heaps)
    leaves = (q.children == 0).sum() * (r.children == 0).sum()
    assert heaps.pairs[1] < leaves / 4
    exact = q.rows @ rows.T
    exact[q.ids[:, None] == np.arange(4000)] = op12.LEAST
    assert (np.sort(exact, axis=1)[:, ::-1][:, :10] == heaps.scores).all()


def brute(words, least):
    out = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if j - i >= q and len(own) >= least and not any(own[z:] == own[:-z] for z in range(1, q)):
                out.add((i, len(own), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating():
    fib = ["a", "b"]
    while len(fib) < 200:
        fib = fib + fib[: len(fib) // 2 + 1]
    a, b = ["a"], ["a", "b"]
    while len(b) < 300:
        a, b = b, b + a
    out = [None, "", " \n", "one", "x " * 11, "x " * 12, "x " * 5000, "x  y\t" * 7, " ".join(b), " ".join(fib)]
    out += [" ".join(R.choice("ab") for _ in range(R.randrange(10, 120))) for _ in range(150)]
    out += [" ".join(R.choice("abc") for _ in range(R.randrange(10, 60)) for _ in range(R.randrange(1, 4))) for _ in range(80)]
    for _ in range(60):
        part = [R.choice(VOCAB) for _ in range(R.randrange(1, 30))]
        body = part * R.randrange(1, 6) + part[: R.randrange(0, len(part) + 1)]
        out.append(" ".join([R.choice(VOCAB) for _ in range(R.randrange(0, 9))] + body + [R.choice(VOCAB) for _ in range(R.randrange(0, 9))]) + "\n")
    return out


@pytest.mark.parametrize("least", [12, 5])
def test_periodic_runs(spark, least):
    data = [(i, t, "k", [1]) for i, t in enumerate(repeating())]
    data += [data[6], (None, data[8][1], None, None), (None, None, None, None)]
    d = spark.createDataFrame(data, "doc_id long, text string, start string, runs array<int>").repartition(3)
    want = []
    for i, t, *_ in data:
        words = SPACE.findall(t or "")
        runs = brute(words, least) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((str(i), len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    got = [(str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.text) for r in op13.periodic_runs(d, least=least).collect()]
    assert sorted(got) == sorted(want) and any(len(w[2]) > 5 for w in want)
    assert op13.periodic_runs(d.limit(0)).count() == 0


def test_periodic_runs_of_very_long_texts(spark):
    part = [f"w{i}" for i in range(90_000)]
    text = " ".join([*part, *part, *part[:500], "end"] + ["z"] * 300_000)
    got = op13.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(0, 180_500, 90_000), (180_501, 300_000, 1)]
    assert got.n_words == 480_501 and got.text == " ".join([*part, "end", "z"])
