"""boosted trees of many folds and labels, grown side by side from histograms.

Trees see bins of the features only, so rows of equal bins are one cell with its number of labels and their sum, for
each fold and label kind. Each level of all trees is one aggregate over the cells: sums of gradients and curvatures by
(fold, kind, node, feature, bin). Only these come back, and their number does not depend on the rows. Scores are part of
the cells; they are brought up to date, and the cells written again, every ``REFRESH`` trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pitrank.sources.store import settled

REFRESH = 10
CELLS, ADDED = 1 << 15, 32  #: cells of a task; tasks up to which the driver adds their sums


def bin_of(value: str, edges: list[float]) -> Column:
    """Number of edges below the value; nulls are in the first bin."""
    return F.coalesce(F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda n, e: n + (F.col(value) > e).cast("int")), F.lit(0)).cast("int")


def binned(rows: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """``rows`` with their bins of the features, in the order of ``edges``."""
    return rows.withColumn("bins", F.array(*[bin_of(f, e) for f, e in edges.items()]))


def numbered(rows: DataFrame, folds: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the number of their set of folds (``set``) in place of the array, and the sets by number. There are
    few sets, as they depend on what was known when. Rows without folds are left out."""
    sets = settled(rows.filter(F.size(folds) > 0).select(folds).distinct().withColumn("set", F.monotonically_increasing_id()))
    return rows.join(sets, folds).drop(folds), sets


def cells(rows: DataFrame, folds: str, kinds: dict[str, tuple[str, str | None]], sets: DataFrame | None = None) -> DataFrame:
    """fold, kind, bins, n and y (sum of labels) of the known labels that each fold may learn from.

    ``folds`` is an array of structs (fold, at) on each row, or in ``sets``, if rows have the ``set`` of ``numbered``; a kind
    names its label and the label's own clock, which has to be within ``at`` (None: the label is as old as the row). Rows
    of equal bins, sets and clocks are summed before they are dealt to the folds, and never repeated themselves."""
    if sets is None:
        rows, sets = numbered(rows, folds)
    clocks = {clock: f"clock{i}" for i, clock in enumerate(sorted({c for _, c in kinds.values() if c is not None}))}
    labels = [F.col(y).cast("double").alias(f"y{i}") for i, (y, _) in enumerate(kinds.values())]
    d = rows.select("set", "bins", *[F.col(c).alias(a) for c, a in clocks.items()], *labels)
    d = d.groupBy("set", "bins", *clocks.values()).agg(*[x for i in range(len(kinds)) for x in (F.count(f"y{i}").alias(f"n{i}"), F.sum(f"y{i}").alias(f"y{i}"))])
    own = [F.struct(F.lit(k).alias("kind"), F.col(f"n{i}").alias("n"), F.col(f"y{i}").alias("y"), (F.lit(None).cast("timestamp_ntz") if c is None else F.col(clocks[c])).alias("clock")) for i, (k, (_, c)) in enumerate(kinds.items())]
    d = d.join(sets, "set").select("bins", F.explode(folds).alias("f"), F.array(*own).alias("own")).select("bins", "f.*", F.explode("own").alias("o"))
    d = d.filter((F.col("o.n") > 0) & (F.col("o.clock").isNull() | (F.col("o.clock") <= F.col("at"))))
    return d.groupBy("fold", F.col("o.kind").alias("kind"), "bins").agg(F.sum("o.n").cast("double").alias("n"), F.sum("o.y").alias("y"))


@dataclass
class Forest:
    """Trees of all (fold, kind) pairs: per pair the first score, and per tree, pair and inner node the feature and the
    last bin that goes left; per tree, pair and leaf the value. Unsplit nodes send all rows left."""

    pairs: list[tuple]
    logistic: np.ndarray
    base: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    depth: int

    def nodes(self, bins: np.ndarray, pair: np.ndarray, tree: int, levels: int) -> np.ndarray:
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            right = bins[rows, self.feature[tree, pair, node]] > self.bin[tree, pair, node]
            node = 2 * node + 1 + right
        return node

    def part(self, since: int, until: int) -> Forest:
        """The trees from ``since`` on, small enough to go with a task; without what a sum doesn't need."""
        return Forest([], self.logistic, self.base, *(x[since:until] for x in (self.feature, self.bin, self.value)), self.depth)

    def added(self, bins: np.ndarray, pair: np.ndarray, since: int, until: int) -> np.ndarray:
        """What the trees from ``since`` on add to the scores."""
        out = np.zeros(len(bins))
        for t in range(since, until):
            out += self.value[t, pair, self.nodes(bins, pair, t, self.depth) - (2**self.depth - 1)]
        return out


def _columns(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, ...]:
    return np.asarray(batch["bins"].flatten()).reshape(-1, features), np.asarray(batch["pair"]), np.asarray(batch["n"]), np.asarray(batch["y"]), np.asarray(batch["score"])


def _histogram(d: DataFrame, forest: Forest, since: int, tree: int, level: int, bins: int, features: int, tasks: int) -> np.ndarray:
    """Sums (gradient, curvature, rows) by pair, node of the level, feature and bin. Those of a few tasks are added where
    they arrive, as a shuffle of so little takes longer than the sums."""
    f = forest.part(since, tree + 1)
    shape = (len(f.logistic), 2**level, features, bins)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, int(np.prod(shape))))
        for batch in batches:
            b, pair, n, y, score = _columns(batch, features)
            score = score + f.added(b, pair, 0, tree - since)
            p = np.where(f.logistic[pair], 1 / (1 + np.exp(-score)), score)
            parts = n * p - y, np.where(f.logistic[pair], n * p * (1 - p), n), n
            node = f.nodes(b, pair, tree - since, level) - (2**level - 1)
            for j in range(features):
                key = ((pair * 2**level + node) * features + j) * bins + b[:, j]
                for i, x in enumerate(parts):
                    total[i] += np.bincount(key, x, total.shape[1])
        at = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, total[:, at])], ["key", "g", "h", "n"])

    parts = d.mapInArrow(sums, "key long, g double, h double, n double")
    if tasks > ADDED:
        parts = parts.groupBy("key").agg(*[F.sum(x).alias(x) for x in "ghn"])
    got = parts.toArrow()
    return np.stack([np.bincount(np.asarray(got["key"]), np.asarray(got[x]), int(np.prod(shape))) for x in "ghn"]).reshape(3, *shape)


def _split(hist: np.ndarray, penalty: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and bin of the best split of each (pair, node), the first of equals; feature 0 and the last bin if none."""
    left = hist.cumsum(axis=-1)
    whole = left[..., -1:]
    right = whole - left
    gain = left[0] ** 2 / (left[1] + penalty) + right[0] ** 2 / (right[1] + penalty) - whole[0] ** 2 / (whole[1] + penalty)
    gain = np.where((left[2] >= least) & (right[2] >= least), np.round(gain, 9), 0.0)
    flat = gain.reshape(*gain.shape[:2], -1)
    best, bins = flat.argmax(axis=-1), gain.shape[-1]
    none = flat.max(axis=-1) <= 0
    return np.where(none, 0, best // bins), np.where(none, bins - 1, best % bins)


def grow(table: DataFrame, logistic: set[str], bins: int, trees: int = 80, depth: int = 3, rate: float = 0.05, penalty: float = 1.0, least: int = 5) -> Forest:
    """Trees for every (fold, kind) of the cells. Kinds in ``logistic`` have labels 0 and 1 and scores in logits; the
    others are means. A split leaves ``least`` rows on both sides; a leaf's step is -rate * G / (H + penalty)."""
    sums = table.groupBy("fold", "kind").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.count("*").alias("cells")).collect()
    totals, tasks = {(r.fold, r.kind): (r.n, r.y) for r in sums}, -(-sum(r.cells for r in sums) // CELLS)
    totals = {k: v for k, v in totals.items() if k[1] not in logistic or 0 < v[1] < v[0]}  # both classes are needed
    pairs = sorted(totals)
    mean = np.array([totals[p][1] / totals[p][0] for p in pairs])
    kind = np.array([p[1] in logistic for p in pairs], bool)
    base = np.where(kind, np.log(np.where(kind, mean, 0.5) / (1 - np.where(kind, mean, 0.5))), mean)
    n, inner = len(pairs), 2**depth - 1
    forest = Forest(pairs, kind, base, np.zeros((trees, n, inner), np.int64), np.full((trees, n, inner), bins - 1), np.zeros((trees, n, inner + 1)), depth)
    if not pairs:
        return forest
    spark = table.sparkSession
    names = spark.createDataFrame([(*p, i, float(b)) for i, (p, b) in enumerate(zip(pairs, base, strict=True))], "fold long, kind string, pair long, score double")
    d = settled(table.withColumn("fold", F.col("fold").cast("long")).join(F.broadcast(names), ["fold", "kind"]).select("pair", "bins", "n", "y", "score").repartition(tasks))
    features, since = len(d.select("bins").first().bins), 0
    for t in range(trees):
        for level in range(depth):
            hist = _histogram(d, forest, since, t, level, bins, features, tasks)
            first = 2**level - 1
            forest.feature[t, :, first : 2 * first + 1], forest.bin[t, :, first : 2 * first + 1] = _split(hist, penalty, least)
        node = np.arange(2 ** (depth - 1))
        last = np.arange(n)[:, None], node[None, :]
        f, b = forest.feature[t, :, inner // 2 :], forest.bin[t, :, inner // 2 :]
        cum = hist.cumsum(axis=-1)
        whole, left = cum[:, :, :, 0, -1], cum[:, last[0], last[1], f, b]
        for side, s in ((0, left), (1, whole - left)):
            forest.value[t, :, side::2] = -rate * s[0] / (s[1] + penalty)
        if (t + 1) % REFRESH == 0 and t + 1 < trees:
            d, since = settled(_moved(d, forest, since, t + 1, features)), t + 1
    return forest


def _moved(d: DataFrame, forest: Forest, since: int, until: int, features: int) -> DataFrame:
    f = forest.part(since, until)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, pair, _, _, score = _columns(batch, features)
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(score + f.added(b, pair, 0, until - since)))

    return d.mapInArrow(run, d.schema)


def predicted(rows: DataFrame, forest: Forest, fold: str, kinds: list[str]) -> DataFrame:
    """``rows`` (with their bins and fold) with each kind's prediction: a mean, or a probability; null without a fit.

    Rows of equal bins and fold have equal predictions, so trees are walked once for each such cell."""
    sent = rows.sparkSession.sparkContext.broadcast(forest)
    number = {p: i for i, p in enumerate(forest.pairs)}
    cells = rows.select(fold, "bins").distinct()
    schema = StructType([*cells.schema.fields, *(StructField(k, DoubleType()) for k in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for batch in batches:
            out = batch
            b = np.asarray(batch["bins"].flatten()).reshape(batch.num_rows, -1)
            for k in kinds:
                pair = np.array([number.get((x, k), -1) for x in batch[fold].to_pylist()], np.int64)
                has = pair >= 0
                p = np.zeros(batch.num_rows)
                if has.any():
                    score = f.base[pair[has]] + f.added(b[has], pair[has], 0, len(f.value))
                    p[has] = np.where(f.logistic[pair[has]], 1 / (1 + np.exp(-score)), score)
                out = out.append_column(k, pa.array(p, mask=~has))
            yield out

    return rows.join(cells.mapInArrow(run, schema), [fold, "bins"], "left").select(*rows.columns, *kinds)


def leaves(table: DataFrame, forest: Forest) -> DataFrame:
    """fold, kind, leaf, n and residual (sum of labels less first scores) of the first tree's leaves."""
    sent, features = table.sparkSession.sparkContext.broadcast(forest), len(table.select("bins").first().bins)
    number = {p: i for i, p in enumerate(forest.pairs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for batch in batches:
            pair = np.array([number.get(x, -1) for x in zip(batch["fold"].to_pylist(), batch["kind"].to_pylist(), strict=True)], np.int64)
            has = pair >= 0
            if has.any():
                own = batch.filter(pa.array(has))
                b, pair = np.asarray(own["bins"].flatten()).reshape(-1, features), pair[has]
                leaf = f.nodes(b, pair, 0, f.depth) - (2**f.depth - 1)
                mean = np.where(f.logistic[pair], 1 / (1 + np.exp(-f.base[pair])), f.base[pair])
                yield pa.RecordBatch.from_arrays([own["fold"].cast(pa.int64()), own["kind"], pa.array(leaf), own["n"], pa.array(np.asarray(own["y"]) - np.asarray(own["n"]) * mean)], ["fold", "kind", "leaf", "n", "residual"])

    return table.mapInArrow(run, "fold long, kind string, leaf long, n double, residual double").groupBy("fold", "kind", "leaf").agg(F.sum("n").cast("long").alias("n"), F.sum("residual").alias("residual"))
