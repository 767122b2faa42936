"""Words, hashes and sets of whole batches against plain Python."""

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pitrank.llm.words import shingle_sets, table, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t\x00\x1cé日.9", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    w = words_of(pa.array(texts, pa.string()), table())
    got = [bytes(w.raw[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in texts for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    w = words_of(pa.array(texts, pa.string()), table(lower=True, alphanumeric=True))
    want = [x for t in texts for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").replace("B", "b"))]
    assert len(w.starts) == len(want)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_equal_hashes_mean_equal_shingles(texts):
    sets, edge = shingle_sets(pa.array(texts, pa.string()), table(lower=True), 2)
    seen = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").replace("B", "b"))
        want = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
        own = sets[edge[i] : edge[i + 1]].tolist()
        assert len(own) == len(set(own)) == len(want)
        key = frozenset(own)
        assert seen.setdefault(key, want) == want
