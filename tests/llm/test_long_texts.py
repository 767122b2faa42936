"""Texts longer than a block (4 MB): operators take them whole."""

import pytest
from pyspark.sql import functions as F

from pitrank.llm import blocks
from pitrank.llm import op1_substring_dedup as op1
from pitrank.llm import op2_decontamination as op2
from pitrank.llm import op3_lm_scoring as op3
from pitrank.llm import op6_quality_rules as op6
from pitrank.llm import op8_line_dedup as op8
from pitrank.llm import op9_ngram_join as op9

N = 640_000
WORDS = [f"w{i}" for i in range(N)]


def lines(words):
    return "\n".join(" ".join(words[i : i + 10]) for i in range(0, len(words), 10))


@pytest.fixture(scope="module")
def long(spark):
    changed = WORDS.copy()
    changed[N // 3] = "changed"
    rows = [
        (1, lines(WORDS)),
        (2, lines(WORDS[500_000:500_060] + [f"x{i}" for i in range(40)])),  # lines and words of the first one, near its end
        (3, lines([f"y{i}" for i in range(N)] + [f"y{i}" for i in range(600_000, 600_050)])),  # repeats itself
        (4, lines(changed)),
        (5, "short"),
    ]
    assert len(rows[0][1]) > blocks.BLOCK_BYTES
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_substring_dedup(long):
    got = by_id(op1.substring_dedup(long))
    assert {i: (r.n_words, r.n_removed) for i, r in got.items()} == {1: (N, 0), 2: (100, 60), 3: (N + 50, 50), 4: (N, N - 1), 5: (1, 0)}
    assert got[4].kept == "changed"


def test_line_dedup(long):
    got = by_id(op8.line_report(long))
    assert {i: (r.n_lines, r.n_removed) for i, r in got.items()} == {1: (N // 10, 0), 2: (10, 6), 3: (N // 10 + 5, 5), 4: (N // 10, N // 10 - 1), 5: (1, 0)}


def test_decontamination(spark, long):
    bench = spark.createDataFrame([("a", " ".join(WORDS[630_000:630_012])), ("b", "y639999 y600000 y600001"), ("c", "short"), ("d", "w5 w7")], "item_id string, text string")
    for size in (op2.INDEX_BYTES, 0):
        got = {r.row.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in op2.overlaps(long, bench, index_bytes=size).collect()}
        assert got == {1: (N, 12, ["a"]), 2: (100, 0, []), 3: (N + 50, 3, ["b"]), 4: (N, 12, ["a"]), 5: (1, 1, ["c"])}


def test_ngram_join(long):
    got = by_id(op9.ngram_join(long))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {1: (N - 4, 1), 2: (96, 2), 3: (N - 4 + 4, 3), 4: (N - 4, 1), 5: (1, 5)}


def test_quality_and_language_model(long):
    got = by_id(op6.quality_report(long))
    assert {i: r.n_words for i, r in got.items()} == {1: N, 2: 100, 3: N + 50, 4: N, 5: 1}
    scored = by_id(op3.lm_scores(long))
    assert {i: r.n_tokens for i, r in scored.items()} == {1: N + 1, 2: 101, 3: N + 51, 4: N + 1, 5: 2}
    assert all(r.score < 0 for r in scored.values()) and long.agg(F.max(F.length("text"))).first()[0] > 4 << 20
