"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrank.llm.blocks import blocked, n_blocks
from pitrank.llm.repeats import ANSWER_DDL, OFFER_DDL, answer, bucket_key, covered, in_order, offer, repeated
from pitrank.llm.words import Words, pieces, table, words_of

_LINE = (np.arange(256, dtype=np.uint8), np.arange(256) != 0x0A)
_WORD = table()[1]


def _lines(texts: pa.Array) -> Words:
    """The lines of each text that hold more than white space."""
    w = words_of(texts, _LINE)
    if not len(w.starts):
        return w
    full = np.add.reduceat(_WORD[w.raw].astype(np.int32), w.starts) > 0
    return Words(w.raw, w.offsets, w.starts[full], w.ends[full], w.text[full], w.hashes[full])


def _windows(docs: pa.Table, ids: np.ndarray, n: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Parts (first row, lines, window starts), and hash, bucket key and row of every window of a block."""
    parts, h, key, row = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for base, some in pieces(docs["text"]):
        w = _lines(some)
        at, hashes = w.windows(n)
        parts.append((base, w, at))
        h.append(hashes)
        key.append(bucket_key(w.hashes, at, n))
        row.append(base + w.text[at])
    return parts, np.concatenate(h), np.concatenate(key), np.concatenate(row)


def _offers(docs: pa.Table, n: int, buckets: int) -> pa.Table:
    docs, ids = in_order(docs)
    _, h, key, row = _windows(docs, ids, n)
    return offer(docs["block"][0].as_py(), h, key, ids[row], buckets)


def _without(text: str, gone: np.ndarray) -> str:
    """The text without those of its non-blank lines that ``gone`` marks."""
    out, k = [], 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            k += 1
            if gone[k - 1]:
                continue
        out.append(line)
    return "\n".join(out)


def _remove(docs: pa.Table, told: pa.Table, n: int, buckets: int) -> pa.Table:
    docs, ids = in_order(docs)
    parts, h, key, row = _windows(docs, ids, n)
    twice = repeated(h, key, row, ids[row], told, buckets)
    texts, lines, removed, done = docs["text"].to_pylist(), [np.zeros(0, np.int64)], np.zeros(len(ids), np.int64), 0
    for base, w, at in parts:
        gone = covered(at[twice[done : done + len(at)]], n, len(w.starts))
        done += len(at)
        lines.append(w.counts)
        for i in np.unique(w.text[gone]):
            own = gone[w.first[i] : w.first[i + 1]]
            texts[base + i] = _without(texts[base + i], own)
            removed[base + i] = own.sum()
    new = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(np.concatenate(lines)), "n_removed": pa.array(removed)}
    return pa.table({"row": docs["row"]} | new)


def _deduped(docs: DataFrame, doc_id: str, text: str, window: int, carry: list[str]) -> DataFrame:
    buckets = n_blocks(docs, text)
    row = F.struct(F.col(doc_id).alias("id"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    base = blocked(docs, doc_id, text, buckets, row.alias("row"))
    kinds = f"row {base.schema['row'].dataType.simpleString()}, text string, n_lines long, n_removed long"
    offers = base.groupBy("block").applyInArrow(lambda t: _offers(t, window, buckets), OFFER_DDL)
    answers = offers.groupBy("bucket").applyInArrow(answer, ANSWER_DDL)

    def remove(d: pa.Table, told: pa.Table) -> pa.Table:
        return _remove(d, told, window, buckets)

    return base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, kinds)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """The rows and columns of ``docs``, each text without the lines that repeat.

    Lines are those between newlines that hold more than white space; blank ones stay and are not counted. A line goes
    if ``window`` consecutive lines that cover it also start earlier: in a smaller doc_id, or in the same row. So the
    first occurrence stays, and lines in shorter passages stay. Null texts stay null; a null doc_id comes after all
    others, and rows that share a doc_id don't precede one another. Very long texts and lines are taken whole. Columns of any
    name pass through."""
    carry = [c for c in docs.columns if c != text]
    out = _deduped(docs, doc_id, text, window, carry)
    of = {c: F.col(f"row.c{i}") for i, c in enumerate(carry)} | {text: F.col("text")}
    return out.select(*[of[c].alias(c) for c in docs.columns])


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed and text (what line_dedup leaves) of every row."""
    out = _deduped(docs, doc_id, text, window, [])
    return out.select(F.col("row.id").alias("doc_id"), "n_lines", "n_removed", "text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, i, line, CASE WHEN regexp_matches(line, '[^ \x09-\x0D]') THEN row_number() OVER (PARTITION BY doc_id, regexp_matches(line, '[^ \x09-\x0D]') ORDER BY i) END AS k
  FROM (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents) d, unnest(v) WITH ORDINALITY AS t(line, i)),
f AS (SELECT doc_id, k, line, lead(line) OVER w AS l2, lead(line, 2) OVER w AS l3 FROM l WHERE k IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
e AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, k) AS r FROM f WHERE l3 IS NOT NULL) WHERE r > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(k, k + 3)) AS k FROM e)
SELECT l.doc_id, count(l.k) AS n_lines, count(x.k) AS n_removed, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (x.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.k = l.k GROUP BY l.doc_id
"""
