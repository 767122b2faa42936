"""Which windows of a sequence occur earlier in the corpus: the exchange shared by substring and line dedup.

Each block offers every distinct window once, with the smallest doc_id that has it there. The window's bucket finds the
smallest doc_id of all, and tells each block which of its windows begin in a smaller document elsewhere. What repeats
inside a block is seen there. A window is known by a 64-bit hash within a bucket, which another hash chooses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pitrank.llm.blocks import answered, by_bucket, unpacked
from pitrank.llm.words import mix

NO_ID = 2**63 - 1
OFFER = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("h", pa.binary()), ("id", pa.binary())])
ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("h", pa.binary())])
OFFER_DDL, ANSWER_DDL = "bucket int, block int, h binary, id binary", "block int, bucket int, h binary"


def in_order(docs: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A block's rows by doc_id, null last, and their ids. Rows of one id don't precede one another."""
    ids = docs["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy()
    order = np.argsort(ids, kind="stable")
    return docs.take(pa.array(order)), ids[order]


def bucket_key(units: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of windows other than their own: of the first, middle and last unit."""
    return mix(units[at] * np.uint64(3) + units[at + n // 2] * np.uint64(5) + units[at + n - 1] * np.uint64(7))


def offer(block: int, h: np.ndarray, key: np.ndarray, ids: np.ndarray, buckets: int) -> pa.Table:
    """The distinct windows of a block, given in the order of ids."""
    if not len(h):
        return OFFER.empty_table()
    found, first = np.unique(h, return_index=True)
    return by_bucket(block, key[first], buckets, OFFER, h=found, id=ids[first])


def answer(t: pa.Table) -> pa.Table:
    """For each block the bucket's windows that a smaller doc_id elsewhere has."""
    h, row = unpacked(t["h"], np.uint64)
    ids, _ = unpacked(t["id"], np.int64)
    order = np.lexsort((ids, h))
    first = np.ones(len(h), bool)
    first[1:] = h[order][1:] != h[order][:-1]
    least = np.empty(len(h), np.int64)
    least[order] = ids[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    return answered(t, least < ids, row, ANSWER, h=h)


def repeated(h: np.ndarray, key: np.ndarray, row: np.ndarray, ids: np.ndarray, told: pa.Table, buckets: int) -> np.ndarray:
    """Of a block's windows (in order of ids, rows and positions), those that start earlier somewhere."""
    out = np.zeros(len(h), bool)
    if not len(h):
        return out
    order = np.argsort(h, kind="stable")
    hs, rows, of = h[order], row[order], ids[order]
    first = np.ones(len(h), bool)
    first[1:] = hs[1:] != hs[:-1]
    least = of[np.flatnonzero(first)][np.cumsum(first) - 1]
    again = np.zeros(len(h), bool)
    again[1:] = ~first[1:] & (rows[1:] == rows[:-1])
    out[order] = again | (least < of)
    if told.num_rows:
        said, at = unpacked(told["h"], np.uint64)
        bucket = told["bucket"].to_numpy()[at]
        by = np.argsort(said)
        said, bucket = said[by], bucket[by]
        at = np.minimum(np.searchsorted(said, h), len(said) - 1)
        out |= (said[at] == h) & (bucket[at] == (key % np.uint64(buckets)).astype(np.int32))
    return out


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Units covered by windows of n units at ``starts``: overlapping windows merge."""
    if not len(starts):
        return np.zeros(total, bool)
    edge = np.bincount(starts, minlength=total + 1) - np.bincount(starts + n, minlength=total + 1)
    return np.cumsum(edge)[:total] > 0
