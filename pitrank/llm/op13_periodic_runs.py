"""Periodic runs of words: suffix classes united by descending LCP, with union-find over ordered position sets.

A run of period q and length m has, for its first word s, suffixes s and s + q that share m - q words, and no other
suffix between them shares q words with s (else q were not the smallest period). So when classes of suffixes are united
along the suffix array by decreasing LCP, s and s + q become neighbours within a class exactly at the LCP m - q. The
reverse holds too: two positions that become neighbours at a distance d within the LCP have d as their smallest period.
Hence every pair of new neighbours whose distance is within the LCP is a seed (p, d, LCP), its run ends at p + d + LCP,
and the run's start is the smallest p of the seeds that share d and that end: no run has to be extended.

A run of at least ``least`` words has an LCP of at least half of that, so unions stop there, and only texts that
repeat a sequence of that many words are indexed at all. Sets are merged smaller into larger.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrank.llm.words import Words, mix, pieces, table, words_of

_BYTES = table()
_RUN = "array<struct<start:long,length:long,period:long>>"


def _ranks(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of the first 1, 2, 4 ... units of every suffix, until all differ; a rank is the place of its group's start."""
    _, inverse, count = np.unique(first, return_inverse=True, return_counts=True)
    levels, k, n = [(np.cumsum(count) - count)[inverse]], 1, len(first)
    while True:
        r = levels[-1]
        tied = np.flatnonzero(np.bincount(r, minlength=n)[r] > 1)
        if not len(tied):
            return levels
        after = np.full(n, -1)
        after[: max(0, n - k)] = r[k:]
        order = tied[np.lexsort((after[tied], r[tied]))]
        rs, at = r[order], np.arange(len(order))
        group = np.append(True, rs[1:] != rs[:-1])
        new = group | np.append(True, after[order][1:] != after[order][:-1])
        out = r.copy()
        out[order] = rs + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(out)
        k *= 2


def _edges(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the suffix array that share ``least`` units or more, and how many, in descending order."""
    n = len(levels[0])
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    low = levels[min(len(levels), least.bit_length()) - 1]  # ranks of a power of two within ``least``
    a, b = (x[low[order[:-1]] == low[order[1:]]] for x in (a, b))
    lcp = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        x, y = a + lcp, b + lcp
        inside = (x < n) & (y < n)
        lcp += (inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])) << k
    at = np.flatnonzero(lcp >= least)
    at = at[np.argsort(-lcp[at], kind="stable")]
    return a[at], b[at], lcp[at]


def _seeds(a: list[int], b: list[int], lcp: list[int]) -> list[tuple[int, int, int]]:
    """Kruskal's unions: (position, distance, LCP) of new neighbours whose distance is within the LCP."""
    sets: dict[int, list[int]] = {}
    out = []
    for x, y, shared in zip(a, b, lcp, strict=True):
        large, small = sets.setdefault(x, [x]), sets.setdefault(y, [y])
        if len(large) < len(small):
            large, small = small, large
        before = -1
        for z, after in zip(small, [*small[1:], 1 << 62], strict=True):
            i = bisect_left(large, z)
            if i and before < large[i - 1] and z - large[i - 1] <= shared:  # else the neighbour is of the same set
                out.append((large[i - 1], z - large[i - 1], shared))
            if i < len(large) and large[i] < after and large[i] - z <= shared:
                out.append((z, large[i] - z, shared))
            large.insert(i, z)
            sets[z], before = large, z
    return out


def runs_of(w: Words, least: int = 12) -> np.ndarray:
    """Rows (first word, length, period) of all runs of at least ``least`` words, in order of start and period; words
    are numbered over the whole batch, and no run leaves its text."""
    least = max(2, least)
    shared = (least + 1) // 2
    at, h = w.windows(shared)
    key = mix(h + w.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    found, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    if len(found) == len(key):
        return np.zeros((0, 3), np.int64)
    full = np.zeros(len(w.offsets) - 1, bool)
    full[w.text[at[count[inverse] > 1]]] = True
    use = np.flatnonzero(full[w.text])
    word = np.unique(w.hashes[use], return_inverse=True)[1].astype(np.int64)
    a, b, lcp = _edges(_ranks(w.text[use] * (word.max() + 1) + word), shared)
    seeds = np.array(_seeds(a.tolist(), b.tolist(), lcp.tolist()), np.int64).reshape(-1, 3)
    p, d, end = seeds[:, 0], seeds[:, 1], seeds.sum(axis=1)
    order = np.lexsort((p, d, end))
    p, d, end = p[order], d[order], end[order]
    first = np.append(True, (d[1:] != d[:-1]) | (end[1:] != end[:-1]))[: len(p)]
    p, d, end = p[first], d[first], end[first]
    long = (end - p >= least) & (end - p >= 2 * d)
    out = np.stack([use[p[long]], (end - p)[long], d[long]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _texts(w: Words, gone: np.ndarray) -> list[str]:
    """Each text's words that are not gone, joined by one space."""
    data, first = w.raw.tobytes(), w.first
    drops = np.unique(w.text[gone]).tolist()
    out = [b" ".join(data[a:b].split()) for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)]
    for i in drops:
        own = data[w.offsets[i] : w.offsets[i + 1]].split()
        out[i] = b" ".join(compress(own, (~gone[first[i] : first[i + 1]]).tolist()))
    return [x.decode() for x in out]


def _found(texts: pa.Array, least: int) -> pa.Table:
    w = words_of(texts, _BYTES)
    runs = runs_of(w, least)
    edge = np.bincount(runs[:, 0] + runs[:, 2], minlength=len(w.starts) + 1) - np.bincount(runs[:, :2].sum(axis=1), minlength=len(w.starts) + 1)
    own = w.text[runs[:, 0]]
    parts = [pa.array(runs[:, 0] - w.first[own]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32)), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
    return pa.table({"n_words": pa.array(w.counts), "runs": lists, "text": pa.array(_texts(w, np.cumsum(edge)[:-1] > 0), pa.string())})


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (array of start, length and period, by start, then period) and text
    (the words that are left, joined by one space).

    Words are separated by ASCII white space and compared by 64-bit hashes. A run is a stretch of words with smallest
    period q, of at least ``least`` words and 2 q, that can't be extended. A word goes if any run holds it after the
    run's first q words. Null and empty texts have no word, no run, and an empty text. Very long texts are taken whole,
    each in one task; a text that is one repeated word has one run. Rows that repeat, null ids and equal texts are
    treated one by one; other columns, of any name, are not read. There is no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, some in pieces(batch["text"]):
                out = _found(some, least)
                yield from out.add_column(0, "doc_id", batch["doc_id"].slice(base, len(some))).to_batches()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {_RUN}, text string")


#: The query's texts: in one of ten, by a hash of doc_id, the words from the a-th on repeat with a period.
TAILED = r"""CASE WHEN crc32(string(doc_id)) % 10 = 0 THEN array_join(transform(array(filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')), w -> transform(w, (x, i) ->
  IF(i < (crc32(string(doc_id)) div 10) % size(w), x, w[int((crc32(string(doc_id)) div 10) % size(w) + (i - (crc32(string(doc_id)) div 10) % size(w))
    % (1 + (size(w) - (crc32(string(doc_id)) div 10) % size(w)) div (3 + (crc32(string(doc_id)) div 10) % 8)))])))[0], ' ') ELSE text END"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = periodic_runs(docs.select("doc_id", F.expr(TAILED).alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    out = out.withColumn("best", best).withColumn("lines", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-1000 * best.n div best.period").alias("exponent_milli"), F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


#: Words q apart that are equal, in islands; an island within one of a smaller period isn't a run of its own. crc32 is
#: made from its polynomial.
ORACLE_SQL = r"""
WITH t AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
c AS (SELECT doc_id, text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM documents, t),
v AS (SELECT doc_id, h, h // 10 AS g, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS v FROM c),
m AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(v) > 0 THEN list_transform(v, lambda x, i: CASE WHEN i - 1 < g % len(v) THEN x ELSE v[1 + g % len(v) + (i - 1 - g % len(v)) % (1 + (len(v) - g % len(v)) // (3 + g % 8))] END) ELSE v END AS v FROM v),
w AS (SELECT doc_id, i - 1 AS i, x FROM m, unnest(v) WITH ORDINALITY AS u(x, i)),
e AS (SELECT a.doc_id, b.i - a.i AS q, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS k FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM e GROUP BY doc_id, q, k HAVING count(*) >= greatest(q, 12 - q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND o.s <= s.s AND o.s + o.n >= s.s + s.n)),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, n := n, q := q), struct_pack(l := -n, s := s, q := q)) AS b, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS l FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM r),
k AS (SELECT w.doc_id, string_agg(w.x, ' ' ORDER BY w.i) AS t FROM w LEFT JOIN x ON x.doc_id = w.doc_id AND x.i = w.i WHERE x.i IS NULL GROUP BY w.doc_id)
SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.q AS period, 1000 * b.n // b.q AS exponent_milli, sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM m LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""
