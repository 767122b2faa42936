"""Ranked lexical search by Block-Max MaxScore over segments of an inverted index.

``build`` makes the index: a row for each segment of about ``SEGMENT_BYTES`` of text. A segment has a dictionary of
terms (64-bit hashes) and their postings in blocks of ``BLOCK``: gaps of document numbers and frequencies, in 1, 2 or 4
bytes as the block needs, with the block's last document, greatest frequency and least document length. These bound a
block's scores whatever the corpus turns out to be, so one pass over the texts makes the index, and frequencies of the
whole corpus are sums over the dictionaries.

``search`` sends queries to all segments. In a segment a query's lists are ordered by the greatest score that each can
add. Lists whose bounds together stay below the k-th best score so far are not essential: a document in none of the
others can't be returned. Documents of the essential lists are scored from these; then, list by list, the maximum of
the block that would hold the document is added, and those whose bound stays below the k-th score are rejected before
any block of these lists is decompressed. Only blocks that a survivor needs are read. A task keeps one heap for each
query over all its segments, and the tasks' heaps are merged.

Queries travel as a broadcast of ``QUERY_BYTES`` of text at most; more queries are sent in several slices, each of which
reads the index once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitrank.llm.blocks import dropped, map_batches, written
from pitrank.llm.words import pieces, table, words_of

SEGMENT_BYTES, BLOCK = 8 << 20, 64
QUERY_BYTES = 8 << 20  #: text of queries that are sent at once
NO_ID = 2**63 - 1
_BYTES = table(lower=True, alphanumeric=True)
_WIDTHS = np.array([1, 1, 2, 4, 4])
_KINDS = {"ids": np.int64, "lens": np.int64, "terms": np.uint64, "df": np.uint32, "last": np.uint32, "most": np.uint32, "short": np.uint32, "wide_d": np.uint8, "wide_f": np.uint8, "gaps": np.uint8, "freqs": np.uint8}
_INDEX = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), *[(k, pa.binary()) for k in _KINDS]])
_INDEX_DDL = "n_docs long, n_terms long, " + ", ".join(f"{k} binary" for k in _KINDS)
_FOUND = "q int, doc_id long, score long"


def _packed(values: np.ndarray, block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Each block's width in bytes, and all values in that many bytes."""
    most = np.zeros(blocks, np.int64)
    np.maximum.at(most, block, values)
    width = _WIDTHS[(most > 0xFF).astype(int) + (most > 0xFFFF) + 1]
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return width.astype(np.uint8), raw[np.arange(4) < width[block][:, None]]


def _segment(texts: pa.Array, ids: np.ndarray) -> pa.RecordBatch:
    docs, terms, freqs, lens = [], [], [], []
    for base, some in pieces(texts):
        w = words_of(some, _BYTES)
        order = np.lexsort((w.hashes, w.text))
        text, term = w.text[order], w.hashes[order]
        new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (term[1:] != term[:-1]))[: len(text)])
        docs.append(base + text[new])
        terms.append(term[new])
        freqs.append(np.diff(np.append(new, len(text))))
        lens.append(w.counts)
    doc, term, freq, size = (np.concatenate(x) for x in (docs, terms, freqs, lens))
    order = np.argsort(term, kind="stable")
    doc, term, freq = doc[order], term[order], freq[order]
    found, begin, df = np.unique(term, return_index=True, return_counts=True)
    place = np.arange(len(term)) - np.repeat(begin, df)
    head = np.flatnonzero(place % BLOCK == 0)
    block = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(term))))
    gap = doc.copy()
    gap[1:] -= np.where(place[1:] > 0, doc[:-1], 0)
    wide_d, gaps = _packed(gap, block, len(head))
    wide_f, packed = _packed(freq, block, len(head))
    most = np.maximum.reduceat(freq, head) if len(head) else head
    short = np.minimum.reduceat(size[doc], head) if len(head) else head
    columns = {"ids": ids, "lens": size, "terms": found, "df": df, "last": doc[np.append(head[1:], len(doc)) - 1] if len(head) else head, "most": most, "short": short, "wide_d": wide_d, "wide_f": wide_f, "gaps": gaps, "freqs": packed}
    data = [pa.array([int((size > 0).sum())]), pa.array([int(size.sum())])] + [pa.array([np.ascontiguousarray(columns[k], kind).tobytes()], pa.binary()) for k, kind in _KINDS.items()]
    return pa.RecordBatch.from_arrays(data, schema=_INDEX)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index: a row for each segment. All rows are in it, each with its own number; null and empty texts hold no term
    and are never found. A very long text is a segment of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].fill_null(NO_ID).to_numpy()
            for base, some in pieces(batch["text"], segment_bytes):
                yield _segment(some, ids[base : base + len(some)])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _INDEX_DDL)


class Segment:
    """A segment's dictionary, block bounds for a corpus of ``total`` terms in ``n`` documents, and postings."""

    def __init__(self, row: dict[str, bytes], n: int, total: int):
        for k, kind in _KINDS.items():
            setattr(self, k, np.frombuffer(row[k], kind))
        self.m = 75 + 25 * self.lens * n // total
        self.edge = np.append(0, np.cumsum(-(-self.df.astype(np.int64) // BLOCK)))
        self.count = np.full(len(self.last), BLOCK, np.int64)
        self.count[self.edge[1:] - 1] = (self.df.astype(np.int64) - 1) % BLOCK + 1
        self.at_d, self.at_f = (np.append(0, np.cumsum(self.count * x)) for x in (self.wide_d, self.wide_f))
        self.bound = gain(self.most.astype(np.int64), 75 + 25 * self.short.astype(np.int64) * n // total)
        self.best = np.maximum.reduceat(self.bound, self.edge[:-1]) if len(self.bound) else self.bound
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}  #: blocks decompressed so far
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block, and what each adds per unit of weight; ``first`` is the list's first block."""
        if b not in self.read:
            gaps, freqs = (x[e[b] : e[b + 1]].view(f"<u{w[b]}").astype(np.int64) for x, e, w in ((self.gaps, self.at_d, self.wide_d), (self.freqs, self.at_f, self.wide_f)))
            docs = np.cumsum(gaps) + (int(self.last[b - 1]) if b > first else 0)
            self.read[b] = docs, gain(freqs, self.m[docs])
        return self.read[b]

    def list(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        if t not in self.lists:
            first = self.edge[t]
            parts = [self.block(b, first) for b in range(first, self.edge[t + 1])]
            self.lists[t] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        return self.lists[t]

    def search(self, terms: np.ndarray, weights: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score may be among the best, that is at least ``floor``, and their scores."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        here = np.flatnonzero((self.terms[at] == terms) & (weights > 0)) if len(self.terms) else at[:0]
        t, w = at[here], weights[here]
        order = np.argsort(-w * self.best[t], kind="stable")
        t, w = t[order], w[order]
        most = w * self.best[t]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)  # what the lists from each on can add
        essential = int((rest[:-1] >= floor).sum())
        if not essential:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        score, seen = np.zeros(len(self.lens), np.int64), np.zeros(len(self.lens), bool)
        for i in range(essential):
            docs, gains = self.list(t[i])
            score[docs] += w[i] * gains
            seen[docs] = True
        docs = np.flatnonzero(seen & (score + rest[essential] >= floor))
        total, held = score[docs], []
        for i in range(essential, len(t)):  # bounds by the blocks that would hold the documents
            first, end = self.edge[t[i]], self.edge[t[i] + 1]
            b = first + np.searchsorted(self.last[first:end], docs)
            up = np.where(b < end, w[i] * self.bound[np.minimum(b, end - 1)], 0)
            held = [(x, y[0], y[1]) for x, *y in held] + [(i, b, up)]
            total = total + up
            stay = total + rest[i + 1] >= floor
            if not stay.all():
                docs, total, held = docs[stay], total[stay], [(x, b[stay], up[stay]) for x, b, up in held]
        while held and len(docs):
            (i, b, up), *held = held
            first, end = self.edge[t[i]], self.edge[t[i] + 1]
            exact = np.zeros(len(docs), np.int64)
            for x in np.unique(b[b < end]).tolist():
                own, gains = self.block(x, first)
                which = np.flatnonzero(b == x)
                near = np.minimum(np.searchsorted(own, docs[which]), len(own) - 1)
                exact[which] = np.where(own[near] == docs[which], w[i] * gains[near], 0)
            total = total - up + exact
            stay = total >= floor
            docs, total, held = docs[stay], total[stay], [(x, b[stay], up[stay]) for x, b, up in held]
        return docs, total


def gain(freq: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence adds per unit of weight: greater for more occurrences, less for longer documents."""
    return 1000000000 * freq // (1000 * freq + 12 * m)


def _queries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All distinct terms; and the terms (by number) and counts of each query, with where each query's begin."""
    w = words_of(pa.array(texts, pa.large_string()), _BYTES)
    terms, of = np.unique(w.hashes, return_inverse=True)
    key, count = np.unique(w.text * len(terms) + of, return_counts=True)
    return terms, key % max(1, len(terms)), count, np.searchsorted(key, np.arange(len(texts) + 1) * len(terms))


def _searched(index: DataFrame, texts: list[str], k: int, n: int, total: int) -> DataFrame:
    """q (number of the query), doc_id and score: the heaps of all tasks."""
    spark = index.sparkSession
    terms, term, count, edge = _queries(texts)
    sent = spark.sparkContext.broadcast(terms)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        df = np.zeros(len(sent.value), np.int64)
        for a, b in zip(batch["terms"].to_pylist(), batch["df"].to_pylist(), strict=True):
            own = np.frombuffer(a, np.uint64)
            at = np.searchsorted(sent.value, own)
            at[at == len(df)] = 0
            hit = sent.value[at] == own if len(df) else np.zeros(len(own), bool)
            df[at[hit]] += np.frombuffer(b, np.uint32)[hit]
        found = np.flatnonzero(df)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], ["t", "df"])

    df = np.zeros(len(terms), np.int64)
    for t, x in map_batches(index.select("terms", "df"), counted, "t long, df long").groupBy("t").agg(F.sum("df")).collect():  # terms of these queries
        df[t] = x
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    shared = spark.sparkContext.broadcast((terms[term], weight[term] * count, edge))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights, edge = shared.value
        heaps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                s = Segment({c: batch[c][i].as_py() for c in _KINDS}, n, total)
                for q in range(len(edge) - 1):
                    ids, scores = heaps.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    docs, new = s.search(hashes[edge[q] : edge[q + 1]], weights[edge[q] : edge[q + 1]], int(scores[-1]) if len(ids) == k else 1)
                    if len(docs):
                        ids, scores = np.append(ids, s.ids[docs]), np.append(scores, new)
                        top = np.lexsort((ids, -scores))[:k]
                        heaps[q] = ids[top], scores[top]
        for q, (ids, scores) in heaps.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids), pa.array(scores)], ["q", "doc_id", "score"])

    return index.mapInArrow(run, _FOUND)


def search(index: DataFrame, queries: DataFrame, query_id: str = "item_id", text: str = "text", k: int = 20, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The query's id (its own name and type), rank, doc_id and score of the ``k`` best documents for each query.

    Score: over the query's terms, repeats included, floor(1000 ln((2 N + 2) / (2 df + 1))) times the gain of the term's
    occurrences. Only scores above 0 count; equal ones go by doc_id, null last, and equal ids in any order. Queries that
    repeat id and text are one query; those that share an id only are ranked each for itself. Null and empty queries, and
    those without a term of the corpus, return nothing. Documents and queries may be of any length. ``index`` should be a
    written table, as it is read twice for each slice of queries."""
    spark, kind = index.sparkSession, queries.schema[query_id].dataType.simpleString()
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    each = queries.select(F.col(query_id).alias("id"), F.col(text).alias("text")).filter("text is not null").distinct()
    size = each.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    slices, done = max(1, math.ceil(size / query_bytes)), spark.createDataFrame([], f"id {kind}, rank int, doc_id long, score long")
    for x in range(slices if n else 0):
        own = each.filter(F.pmod(F.xxhash64("id", "text"), F.lit(slices)) == x).collect()
        if not own:
            continue
        found = _searched(index, [r.text for r in own], k, n, total)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
        best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.id) for i, r in enumerate(own)], f"q int, id {kind}")
        named = best.join(F.broadcast(names), "q").select("id", "rank", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "score")
        done = done.unionByName(written(named))
    return done.withColumnRenamed("id", query_id)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    index = written(build(docs))
    out = search(index, items)
    dropped(index)  # the results are written
    return out


ORACLE_SQL = r"""
WITH f AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS v FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS v FROM benchmark),
g AS (SELECT count(*) AS n, CAST(sum(len(v)) AS BIGINT) AS l FROM f WHERE len(v) > 0),
t AS (SELECT doc_id, x, count(*) AS tf FROM (SELECT doc_id, unnest(v) AS x FROM f) GROUP BY ALL),
q AS (SELECT item_id, x, count(*) AS c FROM (SELECT item_id, unnest(v) AS x FROM i) GROUP BY ALL),
w AS (SELECT x, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, g WHERE x IN (SELECT x FROM q) GROUP BY x, n),
m AS (SELECT doc_id, 75 + (25 * len(v) * n) // l AS m FROM f, g),
s AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (x) JOIN t USING (x) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
