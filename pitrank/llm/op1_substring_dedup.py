"""Substring dedup by difference-cover anchors.

The set {0, 1, 3, 9} covers all differences modulo 13, so two equal runs of 20 words, wherever they start, have a
common offset below 13 at which both stand on a cover position. There an anchor of 8 words is hashed. Only 4 of 13
positions are hashed, and only around anchors that occur twice are whole windows of 20 words hashed and compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrank.llm.blocks import answered, blocked, by_bucket, n_blocks, unpacked
from pitrank.llm.repeats import ANSWER_DDL, OFFER, OFFER_DDL, answer, bucket_key, covered, in_order, offer, repeated
from pitrank.llm.words import Words, members, pieces, table, words_of

_BYTES = table()
_COVER, _PERIOD = np.isin(np.arange(13), [0, 1, 3, 9]), 13
_ANCHORS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
_SHARED = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all texts."""
    n = window - _PERIOD + 1
    at = np.arange(max(0, len(w.starts) - n + 1))
    within = (at - w.first[w.text[at]]) % _PERIOD
    at = at[_COVER[within] & (w.text[at] == w.text[at + n - 1])]
    return at, w.runs(at, n)


def _split(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return h % np.uint64(buckets), (h // np.uint64(buckets)).astype(np.uint32)


def _send(docs: pa.Table, window: int, buckets: int) -> pa.Table:
    h = [_anchors(words_of(some, _BYTES), window)[1] for _, some in pieces(docs["text"])]
    found, count = np.unique(np.concatenate(h), return_counts=True) if h else (np.zeros(0, np.uint64), np.zeros(0))
    if not len(found):
        return _ANCHORS.empty_table()
    block, short = docs["block"][0].as_py(), _split(found, buckets)[1]
    a = by_bucket(block, found[count == 1], buckets, pa.schema(list(_ANCHORS)[:3]), once=short[count == 1])
    b = by_bucket(block, found[count > 1], buckets, pa.schema([_ANCHORS.field(i) for i in (0, 1, 3)]), more=short[count > 1])
    return pa.concat_tables([a, b], promote_options="default").select(_ANCHORS.names).cast(_ANCHORS)


def _share(t: pa.Table) -> pa.Table:
    """For each block the bucket's anchors that occur twice or more."""
    once, row1 = unpacked(t["once"], np.uint32)
    more, row2 = unpacked(t["more"], np.uint32)
    key, row = np.concatenate([once, more]), np.concatenate([row1, row2])
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    often = count[at] > 1 if len(key) else np.zeros(0, bool)
    often[len(once) :] = True
    order = np.argsort(row, kind="stable")
    return answered(t, often[order], row[order], _SHARED, found=key[order])


def _candidates(docs: pa.Table, told: pa.Table, window: int, buckets: int) -> pa.Table:
    """Offers of a block's windows that hold a shared anchor."""
    if not docs.num_rows or not told.num_rows:
        return OFFER.empty_table()
    docs, ids = in_order(docs)
    short, row = unpacked(told["found"], np.uint32)
    shared = np.sort((told["bucket"].to_numpy()[row].astype(np.uint64) << np.uint64(32)) | short)
    hs, keys, of = [], [], []
    for base, some in pieces(docs["text"]):
        w = words_of(some, _BYTES)
        at, h = _anchors(w, window)
        bucket, low = _split(h, buckets)
        at = at[members((bucket << np.uint64(32)) | low, shared)]
        total = len(w.starts)
        reach = np.bincount(np.maximum(at - _PERIOD + 1, w.first[w.text[at]]), minlength=total + 1) - np.bincount(at + 1, minlength=total + 1)
        start = np.flatnonzero(np.cumsum(reach)[: max(0, total - window + 1)] > 0)
        start = start[w.text[start] == w.text[start + window - 1]]
        hs.append(w.runs(start, window))
        keys.append(bucket_key(w.hashes, start, window))
        of.append(ids[base + w.text[start]])
    return offer(docs["block"][0].as_py(), np.concatenate(hs), np.concatenate(keys), np.concatenate(of), buckets)


def _kept(w: Words, gone: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space: bytes of kept words, and one byte between two of a text."""
    stay = np.flatnonzero(~gone)
    text = w.text[stay]
    last = np.ones(len(stay), bool)
    last[:-1] = text[1:] != text[:-1]
    edge = np.zeros(len(w.raw) + 2, np.int8)
    edge[w.starts[stay]] += 1
    edge[w.ends[stay] + ~last] -= 1
    mask = np.cumsum(edge, dtype=np.int8)[: len(w.raw)] > 0
    raw = w.raw.copy()
    raw[w.ends[stay][~last]] = 0x20
    offsets = np.concatenate([[0], np.cumsum(mask)])[w.offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[mask]))


def _remove(docs: pa.Table, told: pa.Table, window: int, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return _KEPT.empty_table()
    docs, ids = in_order(docs)
    parts = [(base, words_of(some, _BYTES)) for base, some in pieces(docs["text"])]
    hs, keys, rows, starts = [], [], [], []
    for base, w in parts:
        at, h = w.windows(window)
        hs.append(h)
        keys.append(bucket_key(w.hashes, at, window))
        rows.append(base + w.text[at])
        starts.append(at)
    row = np.concatenate(rows)
    twice = repeated(np.concatenate(hs), np.concatenate(keys), row, ids[row], told, buckets)
    counts, removed, kept, done = [], [], [], 0
    for (_, w), at in zip(parts, starts, strict=True):
        gone = covered(at[twice[done : done + len(at)]], window, len(w.starts))
        done += len(at)
        counts.append(w.counts)
        removed.append(np.bincount(w.text[gone], minlength=len(w.offsets) - 1))
        kept.append(_kept(w, gone))
    return pa.table([docs["doc_id"], pa.array(np.concatenate(counts)), pa.array(np.concatenate(removed)), pa.chunked_array([k.cast(pa.string()) for k in kept], pa.string())], schema=_KEPT)


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and kept, the words that stay joined by one space.

    A word goes if a run of ``window`` words (at least 13) that covers it also starts earlier: in a smaller doc_id, or
    in the same row. Windows are judged on the input. Null and empty texts have no words and keep ''. A null doc_id
    comes after all others; rows that share a doc_id (or null) don't precede one another, so both keep what only they
    share. Very long texts are taken whole, in one block each if need be. Other columns, of any name, are not read."""
    if window < _PERIOD:
        raise ValueError(f"window must be {_PERIOD} or more")
    buckets = n_blocks(docs, text)
    base = blocked(docs, doc_id, text, buckets)
    anchors = base.groupBy("block").applyInArrow(lambda t: _send(t, window, buckets), "bucket int, block int, once binary, more binary")
    shared = anchors.groupBy("bucket").applyInArrow(_share, "block int, bucket int, found binary")
    offers = base.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lambda d, t: _candidates(d, t, window, buckets), OFFER_DDL)
    answers = offers.groupBy("bucket").applyInArrow(answer, ANSWER_DDL)
    return base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, t: _remove(d, t, window, buckets), "doc_id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS v FROM documents),
p AS (SELECT doc_id, i, array_to_string(v[i : i + 19], ' ') AS g FROM w, unnest(range(1, len(v) - 18)) AS t(i) WHERE len(v) >= 20),
e AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM p) WHERE r > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM e),
k AS (SELECT w.doc_id, t.i, w.v[t.i] AS word, x.i IS NOT NULL AS gone FROM w, unnest(range(1, len(v) + 1)) AS t(i) LEFT JOIN x ON x.doc_id = w.doc_id AND x.i = t.i)
SELECT w.doc_id, CAST(len(any_value(v)) AS BIGINT) AS n_words, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) GROUP BY w.doc_id
"""
