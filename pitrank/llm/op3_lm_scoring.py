"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) is proportional to P(class | history) * q(word | class) * exp(weight of (word before, word)). Classes are
the end of a text and hashed groups of words; q is the add-one unigram within a class, with room for one unseen word.

* P(class | history) is a softmax over sums of weight rows, one for each feature of the history: the word before, the
  one before that (a skip), and the pair of both, hashed to ``ROWS`` rows each. It is trained by distributed gradient
  updates: every block of texts takes adaptive steps over its training texts, in the order of their ids, and rows are
  averaged over blocks, each weighted by the squared gradients it saw. A block is a hash of id and text, so that the
  model does not depend on how the input is laid out.
* Every pair of neighbouring words in training texts has a weight of its own, so that their number grows with the corpus
  and history tells words of a class apart. These features exclude one another once the word before is known; with the
  class-factored model p as the centre of a conjugate prior of strength a, the gradient is zero in closed form:
  P(word | history) = (n(before, word) + a p(word | history)) / (n(before) + a), where a = 1 + n(before).

Every training word is followed by exactly one token, so the model is a proper distribution over all texts. A training
text's own counts are left out of its score, so that scores of training and held-out texts compare. Counts go
through one exchange: each block sends its distinct words and pairs to the buckets that own them and gets their totals
back. Blocks' weights ride along, cut into as many parts as there are buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrank.llm.blocks import block_of, written
from pitrank.llm.words import Words, grouped, mix, pieces, table, words_of

CLASSES, ROWS = 16, 1 << 13
STEP_TOKENS, BLOCK = 1 << 13, 8 << 20
_BYTES = table(lower=True)
_END, _START = np.uint64(1), np.uint64(2)
_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("h", pa.binary()), ("n", pa.binary()), ("none", pa.binary()), ("once", pa.binary()), ("many", pa.binary()), ("many_n", pa.binary()), ("w", pa.binary()), ("seen", pa.binary())])
_TOLD = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.binary()), ("pairs", pa.binary()), ("w", pa.binary()), ("classes", pa.list_(pa.int64()))])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _class_of(h: np.ndarray) -> np.ndarray:
    """0 for the end, hashed groups for words."""
    return np.where(h == _END, 0, 1 + (h >> np.uint64(20)) % np.uint64(CLASSES - 1)).astype(np.int64)


def _sequences(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with an end after each text, the word before each, its text, and its feature rows."""
    n = len(w.offsets) - 1
    text = np.concatenate([w.text, np.arange(n)])
    order = np.argsort(text, kind="stable")
    h, text = np.concatenate([w.hashes, np.full(n, _END)])[order], text[order]
    one, two = np.full(len(h), _START), np.full(len(h), _START)
    one[1:] = np.where(text[1:] == text[:-1], h[:-1], _START)
    two[2:] = np.where(text[2:] == text[:-2], h[:-2], _START)
    rows = np.stack([mix(one) % np.uint64(ROWS), mix(two + np.uint64(7)) % np.uint64(ROWS) + np.uint64(ROWS), mix(one * np.uint64(3) + two) % np.uint64(ROWS) + np.uint64(2 * ROWS)])
    return h, one, text, rows.astype(np.int32)


def _pair_keys(one: np.ndarray, h: np.ndarray) -> np.ndarray:
    """64-bit keys of (word before, word)."""
    return mix(mix(one) * np.uint64(3) + h)


def _probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """P(class) of each token."""
    x = weights[rows[0]]
    x += weights[rows[1]]
    x += weights[rows[2]]
    x += bias
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def trained(tokens: list[tuple[np.ndarray, np.ndarray]], rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the last row is the bias) after one pass of adaptive steps over (classes, feature rows), and the squared
    gradient that each row saw."""
    w, seen = np.zeros((3 * ROWS + 1, CLASSES), np.float32), np.zeros(3 * ROWS + 1, np.float32)
    for kind, rows in tokens:
        for a in range(0, len(kind), STEP_TOKENS):
            own = rows[:, a : a + STEP_TOKENS]
            g = _probabilities(w, w[-1], own)
            g[np.arange(len(g)), kind[a : a + STEP_TOKENS]] -= 1
            for f in own:
                order, found, edge = grouped(f)
                total = np.add.reduceat(g[order], edge[:-1], axis=0)
                seen[found] += np.einsum("ij,ij->i", total, total) / CLASSES
                w[found] -= rate * total / np.sqrt(1 + seen[found])[:, None]
            total = g.sum(axis=0)
            seen[-1] += (total**2).mean()
            w[-1] -= rate * total / np.sqrt(1 + seen[-1])
    return w, seen


def _in_order(docs: pa.Table) -> pa.Table:
    """A block's rows by id and text, so that steps have one order."""
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _ask(docs: pa.Table, buckets: int, rate: float) -> pa.Table:
    """For each bucket a block's distinct words with their number in training texts, its pair keys by that number, and
    a part of the weights learned from the block."""
    if not docs.num_rows:
        return _ASK.empty_table()
    docs = _in_order(docs)
    train = ~docs["held_out"].to_numpy()
    words, pairs, steps = [], [], []
    for base, some in pieces(docs["text"]):
        h, one, text, rows = _sequences(words_of(some, _BYTES))
        kind, use = _class_of(h), train[base + text]
        words.append((h, use))
        pairs.append((_pair_keys(one, h), use))
        steps.append((kind[use], rows[:, use]))
    block = docs["block"][0].as_py()
    found, n = _counted(words)
    keys, m = _counted(pairs)
    w, seen = trained(steps, rate)
    touched = [np.flatnonzero(seen[part::buckets]) for part in range(buckets)]
    order, edge = _dealt(found, buckets)
    order2, edge2 = _dealt(keys, buckets)
    out = {name: [] for name in _ASK.names}
    for b in range(buckets):
        own, mine = order[edge[b] : edge[b + 1]], order2[edge2[b] : edge2[b + 1]]
        short, many = (keys[mine] // np.uint64(buckets)).astype(np.uint32), m[mine]
        values = [b, block, found[own], _pack(n[own]), short[many == 0], short[many == 1], short[many > 1], _pack(many[many > 1]), w[b::buckets][touched[b]].astype(np.float16), seen[b::buckets]]
        for name, v in zip(_ASK.names, values, strict=True):
            out[name].append(v if isinstance(v, int | bytes) else np.ascontiguousarray(v).tobytes())
    return pa.table(out, schema=_ASK)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs where its mark is set."""
    keys, use = (np.concatenate(x) for x in zip(*parts, strict=True))
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, use, len(found)).astype(np.int64)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys by bucket, and where each bucket begins."""
    bucket = keys % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def _unpack(column: list[bytes | None], kind: type) -> tuple[np.ndarray, np.ndarray]:
    rows = [np.frombuffer(x or b"", kind) for x in column]
    return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def _pack(values: np.ndarray) -> bytes:
    most = values.max(initial=0)
    return values.astype(np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.uint64).tobytes()


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, {n: np.uint8, 2 * n: np.uint16, 8 * n: np.uint64}[len(blob)])


def _tell(t: pa.Table) -> pa.Table:
    """Totals of a bucket's words and pairs for each block, in the order asked; on the first row the average of this part
    of the weights, and tokens and distinct words by class."""
    t = t.sort_by([("block", "ascending")])
    col = {name: t[name].to_pylist() for name in t.column_names}
    h, row = _unpack(col["h"], np.uint64)
    sizes = np.bincount(row, minlength=t.num_rows).tolist()
    n = np.concatenate([_unpacked(blob, k) for blob, k in zip(col["n"], sizes, strict=True)])
    found, at = np.unique(h, return_inverse=True)
    total = np.bincount(at, n, len(found)).astype(np.int64)
    kind = _class_of(found)
    classes = np.concatenate([np.bincount(kind, total, CLASSES), np.bincount(kind[total > 0], minlength=CLASSES)]).astype(np.int64)
    edge = np.searchsorted(row, np.arange(t.num_rows + 1))
    words = [_pack(total[at[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    parts = [_unpack(col[name], np.uint32) for name in ("none", "once", "many")]
    key, row = np.concatenate([k for k, _ in parts]), np.concatenate([r for _, r in parts])
    each = np.concatenate([np.zeros(len(parts[0][0])), np.ones(len(parts[1][0])), *(_unpacked(blob, len(keys) // 4) for blob, keys in zip(col["many_n"], col["many"], strict=True))])
    found, at = np.unique(key, return_inverse=True)
    total = np.bincount(at, each, len(found)).astype(np.int64)[at] if len(key) else np.zeros(0, np.int64)
    order = np.argsort(row, kind="stable")
    edge = np.searchsorted(row[order], np.arange(t.num_rows + 1))
    pairs = [_pack(total[order[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    mass, mean = 0.0, 0.0
    for w, s in zip(col["w"], col["seen"], strict=True):
        s = np.frombuffer(s, np.float32).astype(np.float64)
        full = np.zeros((len(s), CLASSES))
        full[s > 0] = np.frombuffer(w, np.float16).reshape(-1, CLASSES)
        mass, mean = mass + s, mean + s[:, None] * full
    mean = (mean / np.maximum(mass, 1e-9)[:, None]).astype(np.float32)
    last = [None] * (t.num_rows - 1)
    return pa.table([t["block"], t["bucket"], pa.array(words, pa.binary()), pa.array(pairs, pa.binary()), pa.array([mean.tobytes(), *last], pa.binary()), pa.array([classes.tolist(), *last], pa.list_(pa.int64()))], schema=_TOLD)


def _own(text: np.ndarray, keys: np.ndarray, use: np.ndarray) -> np.ndarray:
    """How often each token's key occurs in its own text, 0 outside ``use``."""
    _, at, count = np.unique(mix(keys + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    return np.where(use, count[at], 0)


def _answers(blobs: dict[int, bytes], bucket_of: np.ndarray, order: np.ndarray, edge: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bucket_of), np.float64)
    for b in np.flatnonzero(np.diff(edge)).tolist():
        own = order[edge[b] : edge[b + 1]]
        out[own] = _unpacked(blobs[b], len(own))
    return out


def _scored(docs: pa.Table, told: pa.Table, model: dict, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return _SCORED.empty_table()
    docs = _in_order(docs)
    train = ~docs["held_out"].to_numpy()
    parts = [(base, *_sequences(words_of(some, _BYTES))) for base, some in pieces(docs["text"])]
    kinds = [_class_of(h) for _, h, _, _, _ in parts]
    both = [_pair_keys(one, h) for _, h, one, _, _ in parts]
    names = told["bucket"].to_pylist()
    found = np.unique(np.concatenate([h for _, h, _, _, _ in parts]))
    count = _answers(dict(zip(names, told["n"].to_pylist(), strict=True)), found, *_dealt(found, buckets))
    use = [train[base + text] for base, _, _, text, _ in parts]
    keys, m = _counted(list(zip(both, use, strict=True)))
    order, edge = _dealt(keys, buckets)
    order = np.concatenate([np.zeros(0, np.int64), *(o[np.argsort(np.minimum(m[o], 2), kind="stable")] for o in np.split(order, edge[1:-1]))])  # none, once, many: as asked
    pair = _answers(dict(zip(names, told["pairs"].to_pylist(), strict=True)), keys, order, edge)
    n, v, tokens, words = model["n"], model["v"], model["class_tokens"], model["class_words"]
    out = [[], [], [], []]
    for (base, h, one, text, rows), kind, key in zip(parts, kinds, both, strict=True):
        c = count[np.searchsorted(found, h)]
        p = np.empty(len(h))
        for a in range(0, len(h), STEP_TOKENS):
            some = _probabilities(model["weights"], model["bias"], rows[:, a : a + STEP_TOKENS]).astype(np.float64)
            p[a : a + STEP_TOKENS] = some[np.arange(len(some)), kind[a : a + STEP_TOKENS]] / some.sum(axis=1)
        mine = train[base + text]  # a training text is not scored by its own counts
        q = np.where(kind > 0, (c - _own(text, h, mine) + 1) / (tokens[kind] - _own(text, kind.astype(np.uint64), mine) + words[kind] + 1), 1.0)
        met = pair[np.searchsorted(keys, key)] - _own(text, key, mine)
        before = np.where(one == _START, tokens[0], count[np.minimum(np.searchsorted(found, one), len(found) - 1)]) - _own(text, one, mine)
        strength = 1 + before
        p = (met + strength * p * q) / (before + strength)
        size = int(text[-1]) + 1
        out[0].append(np.bincount(text, minlength=size))
        out[1].append(np.bincount(text[c > 0], minlength=size))
        out[2].append(np.bincount(text, np.log10((c + 1) / (n + (v + 1))), minlength=size))
        out[3].append(np.bincount(text, np.log10(np.maximum(p, np.finfo(np.float64).tiny)), minlength=size))
    columns = [np.concatenate(x) for x in out]
    return pa.table([docs["doc_id"], docs["held_out"], *(pa.array(x) for x in columns)], schema=_SCORED)


_DDL = {_ASK: "bucket int, block int, h binary, n binary, none binary, once binary, many binary, many_n binary, w binary, seen binary", _TOLD: "block int, bucket int, n binary, pairs binary, w binary, classes array<long>", _SCORED: "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"}


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, rate: float = 0.1, block_bytes: int = BLOCK) -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id's text modulo ``folds`` is ``held``), n_tokens, n_known, train_tokens,
    base_score (add-one unigram) and score (the model), both log10 probabilities of the whole text.

    A-Z fold; tokens are words between white space and one end per text. Counts and weights come from all rows that are
    not held out; a training text's score leaves out its own counts. Null texts count as empty (one token, the end); a null id counts as the id ''; repeated rows count as
    often as they occur; very long texts are read whole, a block may then exceed ``block_bytes``. Without training rows
    counts are 0. Other columns are not read."""
    spark = docs.sparkSession
    number = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(folds))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (number == held).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, math.ceil(size / block_bytes))
    base = rows.withColumn("block", block_of("doc_id", "text", buckets))
    asked = base.groupBy("block").applyInArrow(lambda t: _ask(t, buckets, rate), _DDL[_ASK])
    told = written(asked.groupBy("bucket").applyInArrow(_tell, _DDL[_TOLD]))
    first = told.filter("w is not null").select("bucket", "w", "classes")  # one row a bucket, together one set of weights
    weights, both = np.zeros((3 * ROWS + 1, CLASSES), np.float32), np.zeros(2 * CLASSES)
    for r in first.toLocalIterator():
        weights[r.bucket :: buckets] = np.frombuffer(r.w, np.float32).reshape(-1, CLASSES)
        both += r.classes
    n, v = both[:CLASSES].sum(), both[CLASSES:].sum()
    model = spark.sparkContext.broadcast({"weights": weights[:-1], "bias": weights[-1], "n": n, "v": v, "class_tokens": both[:CLASSES], "class_words": both[CLASSES:]})
    answers = told.select("block", "bucket", "n", "pairs")
    out = base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, t: _scored(d, t, model.value, buckets), _DDL[_SCORED])
    return out.withColumn("train_tokens", F.lit(int(n)).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
