"""Benchmark decontamination: a set join of item windows with documents, by the rarest shingle of each window.

A document contains a window only if it contains all of the window's shingles, so the one that is rarest in the corpus
is enough of a prefix. A first pass counts the benchmark's shingles in all documents; a second one looks up only the
rarest of each window. Where it occurs, the place of the window follows; it must lie inside the document (length and
positional bounds) and its words are then compared, byte by byte.

A benchmark whose index has a bounded size is broadcast. A larger one is joined by shuffles: documents send only those
shingles that a bit map of fixed size doesn't rule out, windows choose their rarest shingle by a join with the counts,
and occurrences of these shingles, with the words around them, meet the windows in a join on the shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrank.llm.blocks import map_batches, written
from pitrank.llm.words import Words, distinct, members, pieces, same_bytes, table, words_of

_BYTES = table(lower=True, alphanumeric=True)
INDEX_BYTES = 48 << 20  #: bytes that a broadcast index may have
_PER_BYTE = 96  #: most bytes of index for a byte of item text: a window (80 bytes of hashes, 72 of shingles, 40 of links) begins at every second byte at most
_SHINGLE = 3
_BITS = 1 << 27  #: bits of the map of shingles that a shuffled join sends to the documents


class _Index:
    """Windows of a bounded set of items: lengths, words, items; the shingles of all, and each window's rarest."""

    def __init__(self, ids: list, texts: list, window: int):
        ids = [str(i) for i in ids]
        self.items = np.array(sorted(set(ids)), object)
        number = {x: i for i, x in enumerate(self.items)}
        w = words_of(pa.array(texts, pa.large_string()), _BYTES)
        length = np.minimum(w.counts, window)
        at = [np.arange(a, b - n + 1) for a, b, n in zip(w.first[:-1], w.first[1:], length, strict=True) if n]
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        of, n = np.array([number[i] for i in ids], np.int64)[w.text[at]], length[w.text[at]]
        rows = np.zeros((len(at), window), np.uint64)
        for k in range(window):
            rows[n > k, k] = w.hashes[at[n > k] + k]
        lower = _BYTES[0][w.raw]
        first, _ = distinct(lower, w.starts, w.ends)
        first = first[np.argsort(w.hashes[first], kind="stable")]
        self.known, size = w.hashes[first], w.ends[first] - w.starts[first]
        self.spelled = np.concatenate([np.zeros(0, np.uint8), *(lower[a:b] for a, b in zip(w.starts[first], w.ends[first], strict=True))])
        self.ends = np.cumsum(size)
        self.begins = self.ends - size
        self.words, which = np.unique(rows, axis=0, return_inverse=True) if len(at) else (rows, np.zeros(0, np.int64))
        self.length = np.zeros(len(self.words), np.int64)
        self.length[which] = n
        pairs = np.unique(np.stack([which.ravel(), of]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        self.item, self.edge = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.words) + 1))
        self.size = np.minimum(self.length, _SHINGLE)
        self.shingles = {}
        for k in np.unique(self.size):
            mine = np.flatnonzero(self.size == k)
            own = Words(None, np.zeros(len(mine) + 1), np.zeros(window * len(mine)), None, np.repeat(np.arange(len(mine)), window), self.words[mine].ravel())
            grid = own.runs(np.arange(window * len(mine) - k + 1), k)
            grid = np.concatenate([grid, np.zeros(k - 1, np.uint64)]).reshape(len(mine), window)
            valid = np.arange(window) <= (self.length[mine] - k)[:, None]
            self.shingles[int(k)] = mine, grid, valid, np.unique(grid[valid])

    @classmethod
    def of(cls, shared):
        """The index from a broadcast of its arrays."""
        self = cls.__new__(cls)
        vars(self).update(shared.value)
        return self

    def look_up(self, counts: dict[int, np.ndarray]) -> None:
        """Takes each window's rarest shingle: for each shingle length the sorted shingles, offset and window."""
        self.prefix = {}
        for k, (mine, grid, valid, known) in self.shingles.items():
            rank = np.where(valid, counts[k][np.minimum(np.searchsorted(known, grid), len(known) - 1)], np.iinfo(np.int64).max)
            offset = np.argmin(rank, axis=1)
            key = grid[np.arange(len(mine)), offset]
            order = np.argsort(key, kind="stable")
            self.prefix[k] = key[order], offset[order], mine[order]
        del self.shingles

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Start and window of every occurrence."""
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (key, offset, window) in self.prefix.items():
            at, h = w.windows(k)
            hit = members(h, key)
            at, h = at[hit], h[hit]
            low, high = np.searchsorted(key, h), np.searchsorted(key, h, side="right")
            many = high - low
            entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            start, which = np.repeat(at, many) - offset[entry], window[entry]
            text, n = w.text[np.repeat(at, many)], self.length[which]
            fits = (start >= w.first[text]) & (start + n <= w.first[text + 1])
            start, which, n = start[fits], which[fits], n[fits]
            same = np.ones(len(start), bool)
            for j in range(self.words.shape[1]):
                live = same & (n > j)
                same[live] = w.hashes[start[live] + j] == self.words[which[live], j]
            starts.append(start[same])
            found.append(which[same])
        start, which = np.concatenate(starts), np.concatenate(found)
        if not len(start):
            return start, which
        n = self.length[which]
        word = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.searchsorted(self.known, w.hashes[word])
        same = same_bytes(_BYTES[0][w.raw], w.starts[word], w.ends[word], self.spelled, self.begins[at], self.ends[at])
        same = np.logical_and.reduceat(same, np.cumsum(n) - n)
        return start[same], which[same]


def _counted(docs: DataFrame, index, text: str) -> DataFrame:
    """How often each shingle of the benchmark occurs in the documents: k, i and n."""

    def count(batch: pa.RecordBatch) -> pa.Table:
        shingles = _Index.of(index).shingles
        total = {k: np.zeros(len(s[3]), np.int64) for k, s in shingles.items()}
        for _, some in pieces(batch[0]):
            w = words_of(some, _BYTES)
            for k, (_, _, _, known) in shingles.items():
                h = w.windows(k)[1]
                total[k] += np.bincount(np.searchsorted(known, h[members(h, known)]), minlength=len(known))
        parts = [(k, np.flatnonzero(n), n[n > 0]) for k, n in total.items()]
        none = np.zeros(0, np.int64)
        k = np.concatenate([none, *(np.full(len(i), k) for k, i, _ in parts)])
        return pa.table({"k": k, "i": np.concatenate([none, *(i for _, i, _ in parts)]), "n": np.concatenate([none, *(n for _, _, n in parts)])})

    return map_batches(docs.select(text), count, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n"))


def _searched(rows: DataFrame, index, kinds: str) -> DataFrame:
    """Each row's number of words, of hit words, and its items."""

    def search(batch: pa.RecordBatch) -> pa.Table:
        hits, items, counts, look = [], [], [np.zeros(0, np.int64)], _Index.of(index)
        for _, some in pieces(batch["text"]):
            w = words_of(some, _BYTES)
            start, which = look.find(w)
            counts.append(w.counts)
            by = np.argsort(w.text[start], kind="stable")
            start, which = start[by], which[by]
            edge = np.searchsorted(w.text[start], np.arange(len(some) + 1))
            covered = np.bincount(start, minlength=len(w.starts) + 1) - np.bincount(start + look.length[which], minlength=len(w.starts) + 1)
            hits.append(np.bincount(w.text[np.cumsum(covered)[: len(w.starts)] > 0], minlength=len(some)))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                items.append(sorted({look.items[k] for x in np.unique(which[a:b]) for k in look.item[look.edge[x] : look.edge[x + 1]]}))
        n_hit = np.concatenate([np.zeros(0, np.int64), *hits])
        return pa.table({"row": batch["row"], "n_hit": n_hit, "items": pa.array(items, pa.list_(pa.string())), "n_words": np.concatenate(counts)})

    return map_batches(rows, search, kinds)


def _spelled(w: Words, start: int, end: int, raw: bytes) -> list[str]:
    return [raw[a:b].decode() for a, b in zip(w.starts[start:end].tolist(), w.ends[start:end].tolist(), strict=True)]


def _windows(items: DataFrame, window: int) -> DataFrame:
    """id, words (array) and shingles (array of hashes) of every window of every item."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        ids, words, shingles = [], [], []
        for base, some in pieces(batch["text"]):
            w = words_of(some, _BYTES)
            raw = _BYTES[0][w.raw].tobytes()
            for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                n = min(window, b - a)
                k = min(_SHINGLE, n)
                for at in range(a, b - n + 1) if n else ():
                    ids.append(batch["id"][base + i].as_py())
                    words.append(_spelled(w, at, at + n, raw))
                    shingles.append((w.runs(np.arange(at, at + n - k + 1), k) + np.uint64(k)).view(np.int64))
        return pa.table({"id": pa.array(ids, pa.string()), "words": pa.array(words, pa.list_(pa.string())), "shingles": pa.array(shingles, pa.list_(pa.int64()))})

    return map_batches(items.select("id", "text"), run, "id string, words array<string>, shingles array<long>")


def _joined(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """row, n_words, n_hit and items by shuffled joins."""
    spark = rows.sparkSession
    kept = written(rows.select(F.monotonically_increasing_id().alias("key"), "row", "text"))
    windows = written(_windows(items, window).withColumn("wid", F.xxhash64("words")))
    each = windows.select("wid", "words", "shingles").dropDuplicates(["wid", "words"])

    def sizes(batch: pa.RecordBatch) -> pa.Table:
        return pa.table({"key": batch["key"], "n_words": pa.array(np.concatenate([np.zeros(0, np.int64), *(words_of(some, _BYTES).counts for _, some in pieces(batch["text"]))]))})

    def shingled(allowed, context: bool):
        """Occurrences of shingles that the map allows: their counts, or place and words around."""

        def run(batch: pa.RecordBatch) -> pa.Table:
            bits = np.frombuffer(allowed.value, np.uint64)
            out: dict[str, list] = {"s": [], "n": []} if not context else {"s": [], "key": [], "at": [], "from": [], "words": []}
            for base, some in pieces(batch["text"]):
                w = words_of(some, _BYTES)
                raw = _BYTES[0][w.raw].tobytes()
                for k in range(1, _SHINGLE + 1):
                    at, h = w.windows(k)
                    h = h + np.uint64(k)
                    bit = h.view(np.int64) % _BITS
                    hit = (bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
                    at, h = at[hit], h[hit].view(np.int64)
                    if not context:
                        found, n = np.unique(h, return_counts=True)
                        out["s"].append(found)
                        out["n"].append(n)
                        continue
                    for p, x in zip(at.tolist(), h.tolist(), strict=True):
                        i = int(w.text[p])
                        low, high = max(int(w.first[i]), p - window + 1), min(int(w.first[i + 1]), p + window)
                        for name, v in zip(out, (x, batch["key"][base + i].as_py(), p - int(w.first[i]), low - int(w.first[i]), _spelled(w, low, high, raw)), strict=True):
                            out[name].append(v)
            if context:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
                return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)})
            return pa.table({c: np.concatenate([np.zeros(0, np.int64), *v]) for c, v in out.items()})

        return run

    def sent(shingles: DataFrame):
        """A broadcast bit map of the shingles; its words of 64 bits that hold any are collected, a fixed number at most."""
        slots = shingles.select(F.pmod("s", F.lit(_BITS)).alias("b")).select(F.expr("b div 64").alias("w"), F.expr("cast(b % 64 as int)").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("x"))
        map_ = np.zeros(_BITS // 64, np.uint64)
        for batch in slots.toArrow().to_batches():
            map_[batch["w"].to_numpy()] = batch["x"].to_numpy().view(np.uint64)
        return spark.sparkContext.broadcast(map_.tobytes())

    parts = each.select("wid", "words", F.posexplode("shingles").alias("off", "s"))
    counts = map_batches(kept.select("text"), shingled(sent(parts.select("s").distinct()), False), "s long, n long").groupBy("s").agg(F.sum("n").alias("df"))
    rarest = parts.join(counts, "s", "left").groupBy("wid", "words").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "s")).alias("r")).filter("r.df > 0")
    prefix = written(rarest.select("wid", F.col("words").alias("wanted"), "r.off", "r.s"))
    seen = map_batches(kept.select("key", "text"), shingled(sent(prefix.select("s").distinct()), True), "s long, key long, at int, from int, words array<string>")
    met = seen.join(prefix, "s").filter("at - off >= from and slice(words, at - off - from + 1, size(wanted)) = wanted")
    met = written(met.select("key", F.expr("at - off").alias("start"), F.expr("size(wanted)").alias("n"), "wid", "wanted").distinct())
    hit = met.select("key", F.explode(F.expr("sequence(start, start + n - 1)")).alias("p")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    owners = windows.select("wid", F.col("words").alias("wanted"), "id").distinct()
    of = met.select("key", "wid", "wanted").distinct().join(owners, ["wid", "wanted"]).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("items"))
    out = kept.select("key", "row").join(map_batches(kept.select("key", "text"), sizes, "key long, n_words long"), "key").join(hit, "key", "left").join(of, "key", "left")
    return out.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, carry: list[str] | None = None, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """For every row of ``docs``: row (struct of the columns in ``carry``, all by default), n_words, n_hit and items.

    Words are runs of ASCII letters and digits, A-Z folded, and of all other characters. A window is ``window``
    consecutive words of an item; an item of fewer words is one window. A document's word is hit if any occurrence of
    a window covers it; items are those with such a window, as strings in order. Null and empty texts have no words;
    a null item_id counts as the item 'None', and repeated items count once. Very long texts are read whole.

    An index of at most ``index_bytes`` is broadcast; beyond that, windows and documents meet in shuffled joins."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("None")).alias("id"), F.col(item_text).alias("text")).filter(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")).distinct()
    size = items.agg(F.sum(F.octet_length("text") * _PER_BYTE + F.octet_length("id") + 64)).first()[0] or 0
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = docs.select(row.alias("row"), F.col(text).alias("text"))
    if size > index_bytes:
        return _joined(rows, items, window)
    own = sorted(items.collect())
    index = _Index([x[0] for x in own], [x[1] for x in own], window)
    shared = spark.sparkContext.broadcast(vars(index).copy())
    counts = {k: np.zeros(len(s[3]), np.int64) for k, s in index.shingles.items()}
    for k, j, n in _counted(docs, shared, text).collect():
        counts[k][j] = n
    index.look_up(counts)
    kinds = f"row {rows.schema['row'].dataType.simpleString()}, n_hit long, items array<string>, n_words long"
    return _searched(rows, spark.sparkContext.broadcast(vars(index)), kinds).select("row", "n_words", "n_hit", "items")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = overlaps(docs, items, carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH f AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS v FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS v FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(v), 10) AS n, array_to_string(v[i : i + least(len(v), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(v) - 8, 2))) AS t(i) WHERE len(v) > 0),
d AS (SELECT doc_id, n, i, array_to_string(v[i : i + n - 1], ' ') AS g FROM f, (SELECT DISTINCT n FROM g) AS q, unnest(range(1, len(v) - n + 2)) AS t(i) WHERE len(v) >= n),
m AS (SELECT DISTINCT d.doc_id, d.i, d.n, g.item_id FROM d JOIN g ON d.g = g.g AND d.n = g.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(v) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM f LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
