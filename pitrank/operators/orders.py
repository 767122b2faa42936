"""order models (rank-ordered logits) of all folds at once, by Newton's method with exact curvatures.

Events are packed once, entrants in the order of their places. For each event and each fold that learns from it, loss,
gradient and curvature come from sums over the field that is left at every stage, from the last place on; they are added up
within a task before they are sent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitrank.sources.store import settled


def packed(rows: DataFrame, event: list[str], place: str, ident: str, features: list[str], folds: str) -> DataFrame:
    """One row for each event: x (features of all entrants: known places first, in order, then the others), stages, n, the
    folds that may learn from it, and sums of the features and of their squares. The last stage of a field whose places are all known says nothing."""
    one = F.struct(F.col(place).isNull().alias("a"), F.col(place).alias("b"), F.col(ident).alias("c"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    d = rows.groupBy(*event).agg(F.array_sort(F.collect_list(one)).alias("o"), F.count(place).alias("known"), F.count("*").alias("n"), F.first(folds).alias("folds"), F.array(*[F.sum(x) for f in features for x in (F.col(f).cast("double"), F.col(f).cast("double") ** 2)]).alias("sums"))
    return d.select(*event, F.flatten("o.x").alias("x"), F.least("known", F.col("n") - 1).alias("stages"), "n", "folds", "sums").filter("stages > 0")


def _stages(x: np.ndarray, stages: int, w: np.ndarray) -> np.ndarray:
    """For each column of weights: loss, gradient and curvature (flat) of one event."""
    u = x @ w
    shift = u.max(axis=0)
    e = np.exp(u - shift)
    back = lambda a: a[::-1].cumsum(axis=0)[::-1][:stages]
    field = back(e)
    mean = back(e[:, None, :] * x[:, :, None]) / field[:, None, :]
    second = back(e[:, None, None, :] * (x[:, :, None] * x[:, None, :])[..., None]) / field[:, None, None, :]
    loss = (np.log(field) + shift - u[:stages]).sum(axis=0)
    gradient = (mean - x[:stages, :, None]).sum(axis=0)
    curvature = (second - mean[:, :, None] * mean[:, None, :]).sum(axis=0)
    return np.concatenate([loss[None], gradient, curvature.reshape(-1, w.shape[1])])


def _sums(events: DataFrame, keys: list, weights: np.ndarray) -> np.ndarray:
    """Sums over events of what ``_stages`` gives, by fold."""
    k = weights.shape[0]
    sent = events.sparkSession.sparkContext.broadcast(weights)
    number = {key: i for i, key in enumerate(keys)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + k + k * k, len(keys)))
        for batch in batches:
            for x, stages, own in zip(batch["x"], batch["stages"].to_pylist(), batch["folds"].to_pylist(), strict=True):
                at = [number[f] for f in own if f in number]
                if at:
                    total[:, at] += _stages(np.asarray(x.values).reshape(-1, k), stages, sent.value[:, at])
        i, f = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(i), pa.array(total[i, f])], ["f", "i", "v"])

    out = np.zeros((1 + k + k * k, len(keys)))
    for f, i, v in events.select("x", "stages", "folds").mapInArrow(run, "f long, i long, v double").groupBy("f", "i").agg(F.sum("v")).collect():
        out[i, f] = v
    return out


def fit_orders(events: DataFrame, features: list[str], penalty: float = 1.0, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """fold, feature, weight (of the standardised feature), scale (deviation among the fold's rows) and gradient norm.

    ``events`` as ``packed`` makes them. Every round is one pass over the events for all folds that are not done; a step
    that raises a fold's loss is halved. A fold is done once no component of its gradient exceeds the tolerance."""
    spark, k = events.sparkSession, len(features)
    events = settled(events)
    sums = events.select(F.explode("folds").alias("fold"), "n", "sums").groupBy("fold").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[2 * j + i]).alias(f"{c}{j}") for j in range(k) for i, c in enumerate("ab")]).collect()
    keys = sorted(r.fold for r in sums)
    by = {r.fold: r for r in sums}
    variance = np.array([[max(0.0, by[f][f"b{j}"] / by[f].n - (by[f][f"a{j}"] / by[f].n) ** 2) for f in keys] for j in range(k)]).reshape(k, len(keys))
    scale = np.where(variance > 1e-18, np.sqrt(variance), 1.0)
    beta, step = np.zeros((k, len(keys))), np.zeros((k, len(keys)))
    least, norm, todo = np.full(len(keys), np.inf), np.full(len(keys), np.inf), np.arange(len(keys))
    for _ in range(rounds):
        if not len(todo):
            break
        got = _sums(events, [keys[i] for i in todo], (beta / scale)[:, todo])
        for col, i in enumerate(todo):
            loss = got[0, col] + penalty / 2 * beta[:, i] @ beta[:, i]
            if loss > least[i] + 1e-12 * abs(least[i]):
                step[:, i] /= 2
                beta[:, i] -= step[:, i]
                continue
            g = got[1 : 1 + k, col] / scale[:, i] + penalty * beta[:, i]
            h = got[1 + k :, col].reshape(k, k) / np.outer(scale[:, i], scale[:, i]) + penalty * np.eye(k)
            least[i], norm[i] = loss, np.abs(g).max()
            if norm[i] > tolerance:
                step[:, i] = -np.linalg.solve(h, g)
                beta[:, i] += step[:, i]
        todo = np.array([i for i in todo if norm[i] > tolerance and np.abs(step[:, i]).max() > 1e-15], np.int64)
    table = [(f, name, float(beta[j, i]), float(scale[j, i]), float(norm[i])) for i, f in enumerate(keys) for j, name in enumerate(features)]
    return spark.createDataFrame(table, f"fold {events.schema['folds'].dataType.elementType.simpleString()}, feature string, weight double, scale double, norm double")


def gradients(rows: DataFrame, event: list[str], place: str, ident: str, features: list[str], folds: str, fits: DataFrame, penalty: float = 1.0) -> DataFrame:
    """fold, events, rows and the largest component of the gradient at the given weights: what a fit has to bring to
    zero, found without its sums.

    Rows are sorted once, into a field for each event, and never repeated: each fold that learns from an event walks its
    field from the last place on, keeping the sum of exp(u) and of exp(u) x of those still left."""
    k, size = len(features), F.col("n").cast("int")
    wide = fits.groupBy("fold").agg(*[F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"_{c}{j}") for j, f in enumerate(features) for c in ("weight", "scale")])
    d = packed(rows, event, place, ident, features, folds).select("x", "stages", "n", F.explode("folds").alias("fold")).join(F.broadcast(wide), "fold")
    at = lambda i, j: F.col("x")[i * k + j]
    d = d.withColumn("_e", F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.exp(sum((at(i, j) / F.col(f"_scale{j}") * F.col(f"_weight{j}") for j in range(k)), F.lit(0.0)))))

    def stage(left, i):
        e = F.col("_e")[i]
        field, sums = left["e"] + e, [left[f"s{j}"] + e * at(i, j) for j in range(k)]
        g = [left[f"g{j}"] + F.when(i < F.col("stages"), sums[j] / field - at(i, j)).otherwise(0.0) for j in range(k)]
        return F.struct(field.alias("e"), *[x.alias(f"{c}{j}") for c, own in (("s", sums), ("g", g)) for j, x in enumerate(own)])

    none = F.struct(F.lit(0.0).alias("e"), *[F.lit(0.0).alias(f"{c}{j}") for c in "sg" for j in range(k)])
    d = d.withColumn("_g", F.aggregate(F.sequence(size - 1, F.lit(0)), none, stage))
    g = d.groupBy("fold").agg(F.count("*").alias("events"), F.sum("n").alias("rows"), *[(F.sum(F.col(f"_g.g{j}") / F.col(f"_scale{j}")) + penalty * F.max(f"_weight{j}")).alias(f"_g{j}") for j in range(k)])
    return g.select("fold", "events", "rows", F.greatest(F.lit(0.0), *[F.abs(f"_g{j}") for j in range(k)]).alias("largest"))
