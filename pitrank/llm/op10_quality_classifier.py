"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features of a text are the distinct byte trigrams, words, and pairs of neighbouring word shapes (with a mark where the
two words are equal), hashed to ``DIMENSIONS``. Each indicator is scaled by its class log-count ratio, then a linear
hinge-loss model is fitted by dual coordinate descent, and its margin is turned into a probability by a logistic fit
on rows that the model did not see. Fitting takes a bounded sample of labelled rows; scoring takes every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitrank.llm.blocks import cut, map_batches
from pitrank.llm.words import mix, pieces, table, unit_hashes, words_of

DIMENSIONS = 1 << 18
MAX_TRAINING_ROWS = 8000  #: labelled rows that fitting takes at most: those whose doc_id has the smallest hash
MAX_TRAINING_BYTES = 96 << 20  #: bytes of their features that fitting takes at most, by the same order
_EXACT, _FOLDED = table(), table(lower=True)
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = _SHAPE[0x80:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's classes of characters, runs of one class taken as one."""
    kind = _SHAPE[raw]
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    at = np.concatenate([[0], np.cumsum(new)])
    return unit_hashes(kind[new], at[starts], at[ends])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, and where each text's begin."""
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for _, some in pieces(texts):
        w = words_of(some, _FOLDED)
        raw, n = w.raw, len(some)
        own = np.repeat(np.arange(n), np.diff(w.offsets))
        grams = raw[:-2].astype(np.uint64) | raw[1:-1].astype(np.uint64) << np.uint64(8) | raw[2:].astype(np.uint64) << np.uint64(16)
        inside = own[:-2] == own[2:] if len(raw) > 2 else np.zeros(0, bool)
        shape = _shapes(raw, w.starts, w.ends)
        pair = np.flatnonzero(w.text[:-1] == w.text[1:]) if len(w.text) > 1 else np.zeros(0, np.int64)
        same = (w.hashes[pair] == w.hashes[pair + 1]).astype(np.uint64)
        value = np.concatenate([mix(grams[inside] + np.uint64(1 << 40)), mix(w.hashes), mix(shape[pair] * np.uint64(3) + shape[pair + 1] * np.uint64(5) + same)])
        of = np.concatenate([own[:-2][inside], w.text, w.text[pair]])
        key = np.unique((of.astype(np.uint64) << np.uint64(18)) | (value % np.uint64(DIMENSIONS)))
        parts.append((key % np.uint64(DIMENSIONS)).astype(np.int32))
        sizes.append(np.bincount((key >> np.uint64(18)).astype(np.int64), minlength=n))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def fit(rows: list[np.ndarray], labels: np.ndarray, passes: int = 12, c: float = 1.0) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights (ratios included), squared ratios, and slope and offset of the probability of label 1."""
    good = labels == 1
    if not len(rows) or good.all() or not good.any():
        share = (good.sum() + 1) / (len(rows) + 2)
        return np.zeros(DIMENSIONS, np.float32), np.zeros(DIMENSIONS, np.float32), 1.0, float(np.log(share / (1 - share)))
    count = [np.full(DIMENSIONS, 1.0), np.full(DIMENSIONS, 1.0)]
    for x, y in zip(rows, good, strict=True):
        count[int(y)][x] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    random = np.random.default_rng(0)
    order = random.permutation(len(rows))
    checked, used = np.split(order, [max(1, len(rows) // 5)]) if len(rows) >= 50 else (order, order)
    sign, w = np.where(good, 1.0, -1.0), np.zeros(DIMENSIONS)
    norm = np.array([1 / np.sqrt(max(1e-9, float((ratio[x] ** 2).sum()))) for x in rows])
    alpha = np.zeros(len(rows))
    most = np.where(good, c, c * good.sum() / (~good).sum())
    for _ in range(passes):
        for i in random.permutation(used):
            x = ratio[rows[i]] * norm[i]
            gradient = sign[i] * (x @ w[rows[i]]) - 1
            old = alpha[i]
            alpha[i] = min(max(old - gradient, 0.0), most[i])
            if alpha[i] != old:
                w[rows[i]] += (alpha[i] - old) * sign[i] * x
    margin = np.array([(ratio[rows[i]] @ w[rows[i]]) * norm[i] for i in checked])
    slope, offset = _logistic(margin, good[checked])
    return (ratio * w).astype(np.float32), (ratio**2).astype(np.float32), slope, offset


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset, by Newton's method with a small penalty; targets are drawn in from 0 and 1."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return float(a), float(b)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", label_id: str = "doc_id", folds: int = 5, threshold: float = 0.3, max_rows: int = MAX_TRAINING_ROWS, max_bytes: int = MAX_TRAINING_BYTES) -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id's text modulo ``folds`` is 0), score (probability of label 1) and
    predicted (1 from ``threshold`` on).

    Only labels of rows that are not held out are learned from, and of these at most ``max_rows`` with
    features of at most ``max_bytes``, each text whole. Very long texts are scored whole. Scores depend on the
    text alone: null and empty texts share one score, repeated rows have equal ones. A null id counts as the id ''.
    Null labels are left out, an id with several labels has their majority (1 if even). Without labels of both
    classes every score is the share of label 1, smoothed."""
    spark = docs.sparkSession
    held = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(folds)) == 0
    own = labels.filter(F.col(label).isNotNull() & F.col(label_id).isNotNull() & ~held(label_id)).groupBy(F.col(label_id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(own), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def extract(batch: pa.RecordBatch) -> pa.Table:
        found, edge = features(batch["text"])
        return pa.table({"id": batch["id"], "y": batch["y"], "x": pa.array([found[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    drawn = cut(map_batches(sample.select(F.col("id").cast("long"), "y", "text"), extract, "id long, y int, x binary"))
    sizes = drawn.select("id", F.octet_length("x").alias("size"))  # max_rows small rows
    fits = sizes.withColumn("sum", F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id"))).filter(F.col("sum") <= max_bytes).select("id")
    got = sorted(drawn.join(F.broadcast(fits), "id").select("id", "y", "x").collect())
    model = spark.sparkContext.broadcast(fit([np.frombuffer(r.x, np.int32) for r in got], np.array([r.y for r in got], np.int64)))

    def score(batch: pa.RecordBatch) -> pa.Table:
        weight, scale, slope, offset = model.value
        found, edge = features(batch["text"])
        total = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v[found], dtype=np.float64)])[edge])
        margin = total(weight) / np.sqrt(np.maximum(total(scale), 1e-9))
        return pa.table({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500))))})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held(doc_id).alias("held_out"), F.col(text).alias("text"))
    return map_batches(rows, score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
