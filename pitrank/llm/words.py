"""Words of whole text batches as numpy arrays, and hashes of words and of runs of words.

A batch is an Arrow string array. A 256-entry table says which bytes separate words, so that one pass over the bytes
finds every word. All separators are ASCII, hence no code point is ever cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.array([0x20, *range(0x09, 0x0E)], np.uint8)
_ODD, _PAIR, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)  # masks of the first k bytes


def table(lower: bool = False, alphanumeric: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """What each byte maps to (``lower`` folds A-Z), and which bytes are in words.

    White space separates or, for ``alphanumeric``, every ASCII character but letters and digits."""
    to, inside = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    if lower:
        to[ord("A") : ord("Z") + 1] += 32
    if alphanumeric:
        inside[:128] = [chr(c).isalnum() for c in range(128)]
    inside[_SPACE] = False
    return to, inside


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _eights(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans in parts of eight bytes, the last one filled with zeros: values, number within the span, and where
    each span's parts begin (with the end)."""
    size = ends - starts
    many = (size + 7) >> 3
    edge = np.concatenate([[0], np.cumsum(many)])
    if len(many) and many.max() <= 1 and many.min() == 1:
        at, k, left = starts, np.zeros(len(starts), np.int64), size
    else:
        k = np.arange(edge[-1]) - np.repeat(edge[:-1], many)
        at = np.repeat(starts, many) + 8 * k
        left = np.repeat(size, many) - 8 * k
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    value = np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))[at] & _LOW[np.minimum(left, 8)]
    return value, k, edge


def unit_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a sum of mixed parts of eight bytes, each mixed with its place.

    The mixing isn't linear, so no family of texts collides by algebra, as it does for polynomials modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    value, k, edge = _eights(raw, starts, ends)
    part = mix(mix(value + _ODD) + k.astype(np.uint64) * _PAIR)
    if len(part) != len(starts):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
        part = total[edge[1:]] - total[edge[:-1]]
    return mix(part + (ends - starts).astype(np.uint64) * _LAST)


def same_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw2: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
    """Which pairs of spans hold the same bytes."""
    out = ends - starts == ends2 - starts2
    at = np.flatnonzero(out & (ends > starts))
    if len(at):
        value, _, edge = _eights(raw, starts[at], ends[at])
        other, _, _ = _eights(raw2, starts2[at], ends2[at])
        out[at] = np.add.reduceat((value != other).astype(np.int64), edge[:-1]) == 0
    return out


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First span of each distinct one, and for every span the number of its like. Bytes decide, and ``mark`` (small
    numbers) if given: spans are sorted by hash, then compared; should two hashes collide, by a dictionary."""
    h = unit_hashes(raw, starts, ends)
    if mark is not None:
        h = h + mark.astype(np.uint64)
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    like = first[of]
    same = same_bytes(raw, starts, ends, raw, starts[like], ends[like])
    if mark is not None:
        same &= mark == mark[like]
    if same.all():
        return first, of
    seen: dict[tuple[bytes, int], int] = {}
    data, marks = raw.tobytes(), (mark if mark is not None else np.zeros(len(starts), np.int64)).tolist()
    of = np.array([seen.setdefault((data[a:b], m), len(seen)) for a, b, m in zip(starts.tolist(), ends.tolist(), marks, strict=True)], np.int64)
    return np.unique(of, return_index=True)[1], of


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring runs from theirs."""
    x = a * _ODD
    x ^= x >> np.uint64(32)
    x += b
    x *= _PAIR
    x ^= x >> np.uint64(29)
    x *= _LAST
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of a batch: byte spans, the text each belongs to, and its 64-bit hash."""

    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray

    def __post_init__(self) -> None:
        self._runs = {1: self.hashes}

    def _of(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, across texts too: runs of half the length are joined."""
        if n not in self._runs:
            a = 1 << ((int(n) - 1).bit_length() - 1)
            size = max(0, len(self.hashes) - n + 1)
            self._runs[n] = _joined(self._of(a)[:size], self._of(n - a)[a : a + size])
        return self._runs[n]

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.offsets) - 1)

    @property
    def first(self) -> np.ndarray:
        """Index of each text's first word."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of n words inside one text."""
        m = len(self.starts) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[:m] == self.text[n - 1 :])
        return at, self._of(n)[at]

    def runs(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each of the given ones."""
        return self._of(n)[at]


def strings(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array | pa.ChunkedArray, bytes_to: tuple[np.ndarray, np.ndarray]) -> Words:
    """All words of all texts; a null text has none."""
    raw, offsets = buffers(strings(texts))
    mapped, inside = bytes_to
    mapped = mapped[raw]
    on = np.zeros(len(raw) + 2, bool)
    on[1:-1] = inside[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(on[1:] & (~on[:-1] | cut))
    ends = np.flatnonzero(on[:-1] & (~on[1:] | cut))
    text = np.searchsorted(offsets, starts, side="right") - 1
    return Words(raw, offsets, starts, ends, text, unit_hashes(mapped, starts, ends))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, the distinct keys, and where each begins in that order (with the end)."""
    order = np.argsort(keys, kind="stable")
    found, begin = np.unique(keys[order], return_index=True)
    return order, found, np.append(begin, len(keys))


def members(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


def pieces(texts: pa.Array | pa.ChunkedArray, size: int = 1 << 19) -> list[tuple[int, pa.Array]]:
    """Slices of about ``size`` bytes, with the number of their first text: these fit in a CPU's cache."""
    texts = strings(texts)
    offsets = buffers(texts)[1]
    out, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        out.append((at, texts.slice(at, to - at)))
        at = to
    return out


def shingle_sets(texts: pa.Array | pa.ChunkedArray, bytes_to: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, ascending, and where each text's begin; fewer words are one shingle."""
    parts, edges, total = [], [np.zeros(1, np.int64)], 0
    for _, some in pieces(texts):
        w = words_of(some, bytes_to)
        at, h = w.windows(n)
        doc = w.text[at]
        short = [(k, np.flatnonzero(w.counts == k)) for k in range(1, n)]
        if any(len(of) for _, of in short):
            h = np.concatenate([h, *(w.runs(w.first[of], k) for k, of in short if len(of))])
            doc = np.concatenate([doc, *(of for _, of in short)])
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
        edge = np.searchsorted(doc, np.arange(len(some) + 1))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        parts.append(h[new])
        edges.append(np.searchsorted(doc[new], np.arange(1, len(some) + 1)) + total)
        total += len(parts[-1])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(edges)
