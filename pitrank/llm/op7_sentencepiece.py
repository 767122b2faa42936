"""SentencePiece encoding and decoding by suffix-array matching.

Pieces of the model never hold a space mark after another character, so texts fall into units: spaces and what follows.
The distinct units of a batch are concatenated and their suffixes sorted; a binary search of every piece in that array
gives the ranges of its occurrences. These edges are laid out by position, and relaxed into a segmentation.

The model given is a BPE model. A shortest path over the edges (the relaxation of a unigram model) does not give its
encoding, so the edges are relaxed in merge order: of the edges that join two neighbouring symbols of a unit, the best
ranked and leftmost one is taken, in all units at once, until none is left. Characters without a piece become bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrank.llm.words import buffers, distinct, pieces

TEXT_BYTES = 1 << 20  #: text that is split and encoded together
INDEX_CHARS = 1 << 18  #: characters of one suffix array
KNOWN_UNITS = 1 << 18  #: units whose pieces a task remembers
_LONG_UNIT = 96  #: characters beyond which a unit is relaxed by itself, with a heap
_NONE = np.iinfo(np.int32).max
_MARK = "▁"


class Model:
    """Pieces of a SentencePiece BPE model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = np.array(plain, np.int32)
        text = [sp.id_to_piece(i) for i in plain]
        self.longest = max(map(len, text))
        self.length = np.array([len(x) for x in text])
        self.low = np.array(text)
        self.high = np.array([x[:-1] + chr(ord(x[-1]) + 1) for x in text])
        self.codes = np.zeros((len(text), max(16, self.longest)), np.uint32)
        for i, x in enumerate(text):
            self.codes[i, : len(x)] = [ord(c) for c in x]
        score = np.array([sp.get_score(i) for i in plain])
        self.rank = np.empty(len(plain), np.int32)
        self.rank[np.argsort(-score, kind="stable")] = np.arange(len(plain))
        self.of_rank = np.append(self.ids[np.argsort(-score, kind="stable")], np.int32(-1))
        self.byte = np.zeros(256, np.int32)
        self.out: list[bytes] = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[1:-1], 16)] = i
                self.out[i] = bytes([int(sp.id_to_piece(i)[1:-1], 16)])
        for i, x in zip(plain, text, strict=True):
            self.out[i] = x.replace(_MARK, " ").encode()

    def edges(self, codes: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rank of the piece at each position and length (column), from the suffix array of ``codes``."""
        width, letters = self.longest, np.unique(codes)
        narrow = len(letters) < 255 and width <= 16
        if narrow:  # letters of the batch as bytes in the same order, pieces with other letters don't occur
            text = np.append((np.searchsorted(letters, codes) + 1).astype(np.uint8), np.zeros(16, np.uint8))
            rows = np.flatnonzero(np.isin(self.codes, np.append(letters, 0)).all(1))
            low = np.where(self.codes[rows] > 0, np.searchsorted(letters, self.codes[rows]) + 1, 0).astype(np.uint8)
            high = low.copy()
            high[np.arange(len(rows)), self.length[rows] - 1] += 1
            low, high = (np.ascontiguousarray(x).view("S16").ravel() for x in (low, high))
        else:
            text, rows, low, high = np.append(codes, np.zeros(width, np.uint32)), np.arange(len(self.low)), self.low, self.high
        span = 16 if narrow else width
        grid = np.lib.stride_tricks.sliding_window_view(text, span)[: len(codes)].copy()
        grid[np.arange(span) >= (end - np.arange(len(codes)))[:, None]] = 0
        suffix = grid.view("S16" if narrow else f"<U{width}").ravel()
        if narrow:
            halves = grid.view(">u8").astype(np.uint64)
            order = np.lexsort((halves[:, 1], halves[:, 0]))
        else:
            order = np.argsort(suffix)
        ranked = suffix[order]
        low, high = np.searchsorted(ranked, low), np.searchsorted(ranked, high)
        many = high - low
        piece = np.repeat(rows, many)
        at = order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
        rank = np.full((len(codes), width + 1), _NONE, np.int32)
        rank[at, self.length[piece]] = self.rank[piece]
        return rank

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Piece ids of each unit (spaces as marks)."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(units):
            to, size = at, 0
            while to < len(units) and (to == at or size + len(units[to]) <= INDEX_CHARS):
                size += len(units[to])
                to += 1
            out += self._encode_some(units[at:to])
            at = to
        return out

    def _encode_some(self, units: list[str]) -> list[np.ndarray]:
        sizes = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum(sizes)])
        shown = np.where(codes == 0, np.uint32(0x10FFFF), codes)
        rank = self.edges(shown, np.repeat(first[1:], sizes))
        unit = np.repeat(np.arange(len(units)), sizes)
        short = sizes[unit] <= _LONG_UNIT
        starts, lengths = self._relax(np.flatnonzero(short), unit[short], rank)
        done = [(starts, lengths, unit[starts])]
        for u in np.flatnonzero(sizes > _LONG_UNIT):
            s, n = self._relax_long(int(first[u]), int(first[u + 1]), rank)
            done.append((s, n, np.full(len(s), u)))
        starts, lengths, unit = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(starts)
        starts, lengths, unit = starts[order], lengths[order], unit[order]
        found = self.of_rank[np.minimum(rank[starts, lengths], len(self.ids))]
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes[starts[unknown]].tolist()]
            many = np.ones(len(found), np.int64)
            many[unknown] = [len(b) for b in spelled]
            to = np.cumsum(many) - many
            wide = np.repeat(found, many)
            for k, b in zip(to[unknown].tolist(), spelled, strict=True):
                wide[k : k + len(b)] = self.byte[list(b)]
            found, unit = wide, np.repeat(unit, many)
        edge = np.searchsorted(unit, np.arange(len(units) + 1))
        return [found[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def _relax(self, start: np.ndarray, unit: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One merge in every unit a round; units without one leave."""
        length = np.ones(len(start), np.int64)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(start):
            both = length[:-1] + length[1:]
            best = np.full(len(start), _NONE, np.int32)
            fits = np.flatnonzero((unit[:-1] == unit[1:]) & (both <= self.longest))
            best[fits] = rank[start[fits], both[fits]]
            edge = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            least = np.minimum.reduceat(best, edge)
            size = np.diff(np.append(edge, len(start)))
            live = np.repeat(least < _NONE, size)
            if not live.all():
                ended.append((start[~live], length[~live]))
                start, length, unit, best = start[live], length[live], unit[live], best[live]
                least, size = least[least < _NONE], size[least < _NONE]
                edge = np.cumsum(size) - size
                if not len(start):
                    break
            hit = np.flatnonzero(best == np.repeat(least, size))
            hit = hit[np.concatenate([[True], unit[hit][1:] != unit[hit][:-1]])]
            length[hit] += length[hit + 1]
            stay = np.ones(len(start), bool)
            stay[hit + 1] = False
            start, length, unit = start[stay], length[stay], unit[stay]
        if not ended:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*ended, strict=True))

    def _relax_long(self, a: int, b: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one unit, by a heap of possible merges."""
        after, before, size = {i: i + 1 for i in range(a, b)}, {i: i - 1 for i in range(a, b)}, dict.fromkeys(range(a, b), 1)
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= a and j < b and size[i] + size[j] <= self.longest and rank[i, size[i] + size[j]] < _NONE:
                heapq.heappush(heap, (int(rank[i, size[i] + size[j]]), i, size[i] + size[j]))

        for i in range(a, b - 1):
            offer(i)
        while heap:
            _, i, n = heapq.heappop(heap)
            if i not in size or after[i] >= b or size[i] + size[after[i]] != n:
                continue
            j = after[i]
            size[i], after[i] = n, after[j]
            if after[j] < b:
                before[after[j]] = i
            del size[j]
            offer(i)
            if before[i] >= a:
                offer(before[i])
        starts = np.array(sorted(size))
        return starts, np.array([size[i] for i in starts.tolist()])

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids, without the space that encoding puts first."""
        text = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _unit_edges(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin, with the end: at texts, and at spaces after anything but a space or a space mark."""
    cut = np.zeros(len(raw), bool)
    cut[1:] = (raw[1:] == 0x20) & (raw[:-1] != 0x20)
    cut[3:] &= ~((raw[2:-1] == 0x81) & (raw[1:-2] == 0x96) & (raw[:-3] == 0xE2))
    cut[offsets[offsets < len(raw)]] = True
    return np.append(np.flatnonzero(cut), len(raw))


def encoded(texts: pa.Array, model: Model, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and where each text's begin."""
    raw, offsets = buffers(texts)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    edge = _unit_edges(raw, offsets)
    starts, ends = edge[:-1], edge[1:]
    head = np.zeros(len(starts), bool)
    head[np.searchsorted(starts, offsets[:-1][offsets[1:] > offsets[:-1]])] = True
    first, of = distinct(raw, starts, ends, head.astype(np.int64))
    data = raw.tobytes()
    units = [(b" " if p else b"") + data[a:b] for a, b, p in zip(starts[first], ends[first], head[first], strict=True)]
    new = [u for u in units if u not in known]
    if len(known) + len(new) > KNOWN_UNITS:
        known.clear()
        new = units
    known.update(zip(new, (x.tobytes() for x in model.encode_units([u.decode().replace(" ", _MARK) for u in new])), strict=True))
    lists = [known[u] for u in units]
    size = np.array([len(x) for x in lists]) // 4
    flat, begin = np.frombuffer(b"".join(lists), np.int32), np.cumsum(size) - size
    many = size[of]
    ids = flat[np.repeat(begin[of] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    total = np.concatenate([[0], np.cumsum(many)])
    return ids, total[np.searchsorted(starts, offsets)]


def encode(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """For every row: row (struct of the columns in ``carry``, all by default), ids (array<int>) and decoded (string).

    ``path`` is a SentencePiece BPE model, readable on every executor. ids are those of the library's encode(); decoded
    is the text that they stand for. It equals the text, except that a space mark U+2581 in a text reads as a space.
    Null texts have null ids and text, empty ones no ids. Repeated rows are encoded alike, columns of any name may be
    carried, and very long texts are encoded whole, unit by unit. Nothing else of a row is read."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    rows = docs.select(row.alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Model(path), {}
        for batch in batches:
            for base, some in pieces(batch["text"], TEXT_BYTES):
                ids, edge = encoded(some, model, known)
                own = batch.slice(base, len(some))
                mask = own["text"].is_null()
                flat = ids.tolist()
                decoded = [model.decode(flat[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids), mask=mask)
                yield pa.RecordBatch.from_arrays([own["row"], lists, pa.array(decoded, pa.string(), mask=mask.to_numpy(zero_copy_only=False))], ["row", "ids", "decoded"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, decoded string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, a 64-bit hash of the ids, the decoded text's SHA-256, and whether it is the text again."""
    import public_tokenizers

    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id", "text"])
    return out.select("row.doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("row.text")).alias("round_trip"))
