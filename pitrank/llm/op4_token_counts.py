"""Token counts: lengths only, of batches balanced by bytes, with long texts split at safe boundaries.

The tokenizer's own pattern has white space only at the start of a token, or alone. So a token always begins where
white space follows a character that is none, in every script, and what lies before does not depend on what lies after
there. Texts are cut at these places; long units, of scripts or tables without white space, are cut again where a
letter or digit is followed by a character of another sort, which no token spans either. Special strings that the file
adds are found first, as the library does: each is a unit of its own and is never cut. The sum of the units' lengths is the
text's length. Units repeat, so each distinct unit of a batch is encoded once.

All this holds for the byte-level pattern and for special strings that are taken literally. Where the file asks for anything
else (a normaliser, another pattern, special strings that take white space along), texts go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrank.llm.words import buffers, distinct, pieces

UNIT_BYTES = 1 << 20  #: text that is split and encoded together
KNOWN_UNITS = 1 << 19  #: units whose length a task remembers; longer ones than LONG_UNIT are not kept
LONG_UNIT = 1 << 9  #: bytes of a unit beyond which it is cut again
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SORT = np.zeros(256, np.uint8)  # 1 ASCII letter, 2 ASCII digit, 3 other printable ASCII
_SORT[0x21:0x7F] = 3
_SORT[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_SORT[0x30:0x3A] = 2


def _three(raw: np.ndarray) -> np.ndarray:
    """The 24 bits that end at each byte, 0 in the first ones."""
    out = raw.astype(np.uint32)
    out[1:] |= raw[:-1].astype(np.uint32) << 8
    out[2:] |= raw[:-2].astype(np.uint32) << 16
    return out


def special_strings(settings: dict) -> re.Pattern | None:
    """What finds the file's special strings, the longest first; None if texts of this file must not be cut."""
    pattern, added = settings.get("pre_tokenizer") or {}, settings.get("added_tokens") or []
    plain = settings.get("normalizer") is None and pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space")
    if not plain or (settings.get("model") or {}).get("type") != "BPE" or any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    names = sorted((a["content"].encode() for a in added), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, names)) if names else b"(?!)")


def special_spans(data: bytes, offsets: np.ndarray, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Where special strings are, leftmost and longest, within each text."""
    out, at = [], 0
    while (m := pattern.search(data, at)) is not None:
        end = int(offsets[np.searchsorted(offsets, m.start(), side="right")])
        m = pattern.search(data, m.start(), end)  # not beyond the text
        at = m.end() if m else end
        if m:
            out.append(m.span())
    return out


def unit_edges(raw: np.ndarray, offsets: np.ndarray, whole: list[tuple[int, int]] | None = None) -> np.ndarray:
    """Byte positions at which units begin (texts begin one too), with the end; spans in ``whole`` are units."""
    edge = _edges(raw, offsets)
    if not whole:
        return edge
    a, b = np.array(whole).T
    at = np.searchsorted(a, edge, side="right") - 1
    return np.unique(np.concatenate([edge[(at < 0) | (edge >= b[at])], a, b]))


def _edges(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    solid = _SORT[raw] > 0  # bytes that end a character which surely is no white space
    high = np.flatnonzero(raw >= 0x80)
    if len(high):
        three = _three(raw)[high]
        two = three & 0xFFFF
        # U+0085, U+00A0; U+1680, U+180E; U+2000 to U+206F; U+3000; U+FEFF: white space, or taken for it by some
        blank = (two == 0xC285) | (two == 0xC2A0) | (three == 0xE19A80) | (three == 0xE1A08E) | ((three >= 0xE28080) & (three <= 0xE281AF)) | (three == 0xE38080) | (three == 0xEFBBBF)
        solid[high] = ~blank
    cut = np.zeros(len(raw), bool)
    cut[1:] = _SPACE[raw[1:]] & solid[:-1]
    cut[offsets[offsets < len(raw)]] = True
    edge = np.append(np.flatnonzero(cut), len(raw))
    if not (np.diff(edge) > LONG_UNIT).any():
        return edge
    inner = _inner(raw)
    return np.union1d(edge, inner[np.repeat(np.diff(edge), np.diff(edge))[inner] > LONG_UNIT])


def _inner(raw: np.ndarray) -> np.ndarray:
    """Where characters of a sort that no token joins begin: after an ASCII letter or digit, or a letter of Japanese,
    Chinese or Korean, one of another sort."""
    sort = _SORT[raw].copy()
    three = _three(raw)
    cjk = ((three >= 0xE38181) & (three <= 0xE38296)) | ((three >= 0xE382A1) & (three <= 0xE383BA)) | ((three >= 0xE4B880) & (three <= 0xE9BE9F)) | ((three >= 0xEAB080) & (three <= 0xED9EA3))
    cjk &= (raw >= 0x80) & (raw < 0xC0)
    sort[cjk & (raw >= 0x80)] = 1  # the last byte of such a letter
    mark = (three == 0xE38081) | (three == 0xE38082)  # ideographic comma and full stop
    begins = np.zeros(len(raw) + 1, np.uint8)
    begins[: len(raw)][_SORT[raw] > 0] = _SORT[raw][_SORT[raw] > 0]
    begins[np.flatnonzero(cjk) - 2] = 1
    begins[np.flatnonzero(mark) - 2] = 3
    at = np.arange(1, len(raw))
    left, right = sort[:-1], begins[1 : len(raw)]
    return at[((left == 1) & (right > 1)) | ((left == 2) & ((right == 1) | (right == 3)))]


def _encoder(path: str):
    """The library's encoder, and what finds special strings."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    with open(path, encoding="utf-8") as f:
        return made, special_strings(json.load(f))


def _lengths(texts: pa.Array, encoder, pattern: re.Pattern | None, known: dict[bytes, int]) -> np.ndarray:
    """Tokens of each text."""
    raw, offsets = buffers(texts)
    if not len(raw):
        return np.zeros(len(texts), np.int64)
    data = raw.tobytes()
    edge = np.unique(offsets) if pattern is None else unit_edges(raw, offsets, special_spans(data, offsets, pattern))
    starts, ends = edge[:-1], edge[1:]
    first, of = distinct(raw, starts, ends)
    units = [data[a:b] for a, b in zip(starts[first], ends[first], strict=True)]
    new = [i for i, u in enumerate(units) if u not in known]
    fresh = np.zeros(len(units), np.int64)
    for i in range(0, len(new), 4096):
        some = new[i : i + 4096]
        fresh[some] = [len(e.ids) for e in encoder.encode_batch_fast([units[k].decode() for k in some], add_special_tokens=False)]
    size = np.array([known.get(u, 0) for u in units], np.int64) + fresh
    if len(known) + len(new) > KNOWN_UNITS:
        known.clear()
    known.update((units[k], int(fresh[k])) for k in new[:KNOWN_UNITS] if len(units[k]) <= LONG_UNIT)
    total = np.concatenate([[0], np.cumsum(size[of])])
    return total[np.searchsorted(starts, offsets[1:])] - total[np.searchsorted(starts, offsets[:-1])]


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    ``path`` is a file of the tokenizers library, readable on every executor; begin, end and added
    special tokens don't count, special strings inside texts are handled as the library does by default. Null and
    empty texts have 0. Very long texts are cut into units, except a single word of any length and all texts of files that
    aren't plain byte-level BPE, which the library gets whole. Repeated rows and null ids are counted like others; other columns are not read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encoder, pattern), known = _encoder(path), {}
        for batch in batches:
            n = [np.zeros(0, np.int64)] + [_lengths(some, encoder, pattern, known) for _, some in pieces(batch["text"], UNIT_BYTES)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(np.concatenate(n))], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
