"""Exact nearest rows by pivots: blocks that the triangle inequality rules out are never compared.

Rows go to the nearest of a few pivots, found by a farthest-first traversal of a bounded sample, and each pivot's rows are
dealt into blocks. A row's distance to the nearest training row of its own block bounds its answer; a pivot whose
training rows all lie farther than that, by the triangle inequality, is skipped. Only pairs of blocks that some row needs
meet in a task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitrank.sources.store import settled

PIVOTS, SAMPLE = 64, 2048


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1 if len(lists) else 0)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all pairs of rows."""
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1), 0))


def pivots(sample: np.ndarray) -> np.ndarray:
    near, at = np.full(len(sample), np.inf), []
    while len(at) < PIVOTS and len(sample) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((sample - sample[at[-1]]) ** 2).sum(axis=1)))
    return sample[at]


def dealt(rows: DataFrame, ident: str, vector: str, event: str, train: str, block: int, ask: str | None) -> tuple[DataFrame, np.ndarray, dict[int, tuple[int, float]]]:
    """id, v, e, t (training row), q (asks), k (pivot), part; the pivots; and for each pivot the number of its blocks and
    how far its training rows lie."""
    d = rows.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(event).cast("string").alias("e"), F.col(train).alias("t"), (F.lit(True) if ask is None else F.col(ask)).alias("q")).filter("t or q")
    at = pivots(_matrix(d.filter("t").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["v"]))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gap = _gaps(_matrix(b["v"]), at) if len(at) and b.num_rows else np.zeros((b.num_rows, 1))
            k = gap.argmin(axis=1)
            yield b.append_column("k", pa.array(k.astype(np.int32))).append_column("far", pa.array(gap[np.arange(len(k)), k]))

    d = settled(d.mapInArrow(near, f"id {dict(rows.dtypes)[ident]}, v array<double>, e string, t boolean, q boolean, k int, far double"))
    seen = {r.k: (max(1, math.ceil(r.n / block)), r.far if r.far is not None else -1.0) for r in d.groupBy("k").agg(F.count("*").alias("n"), F.max(F.when(F.col("t"), F.col("far"))).alias("far")).collect()}
    parts = F.create_map(*[F.lit(x) for k, (n, _) in seen.items() for x in (k, n)])[F.col("k")] if seen else F.lit(1)
    return d.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("far"), at, seen


def _least(own: pa.Table, others: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each row the distance to the nearest of the others of another event, infinite without any; 512 rows at a time."""
    out = np.full(own.num_rows, np.inf)
    if own.num_rows and others.num_rows:
        a, b = _matrix(own["v"]), _matrix(others["v"])
        e = np.unique(np.array(own["e"].to_pylist() + others["e"].to_pylist(), str), return_inverse=True)[1]
        for i in range(0, len(a), 512):
            gap = _gaps(a[i : i + 512], b)
            gap[e[i : i + 512][: len(gap), None] == e[len(a) :]] = np.inf
            best = gap.argmin(axis=1)
            ok = np.isfinite(gap[np.arange(len(gap)), best])
            out[i : i + 512][ok] = np.sqrt(((a[i : i + 512][ok] - b[best[ok]]) ** 2).sum(axis=1))
    return out


def asking(d: DataFrame, at: np.ndarray, seen: dict[int, tuple[int, float]]) -> DataFrame:
    """Asking rows, each once, with their bound from the own block and the pivots (``to``) whose training rows may be nearer;
    -1 stands for the bound itself."""
    radius = np.array([seen[k][1] if k in seen else -1.0 for k in range(max(1, len(at)))])

    def within(t: pa.Table) -> pa.Table:
        own = t.filter(t["q"])
        first = _least(own, t.filter(t["t"]))
        gap = _gaps(_matrix(own["v"]), at) if len(at) and own.num_rows else np.zeros((own.num_rows, 1))
        wanted = (gap - radius <= first[:, None] * (1 + 1e-9) + 1e-6) & (radius >= 0)
        wanted = np.concatenate([np.ones((own.num_rows, 1), bool), wanted], axis=1)
        ends = np.concatenate([[0], wanted.sum(axis=1).cumsum()])
        to = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((np.nonzero(wanted)[1] - 1).astype(np.int32)))
        return own.select(["id", "v", "e", "k", "part"]).append_column("bound", pa.array(first)).append_column("to", to)

    kind = dict(d.dtypes)["id"]
    return d.groupBy("k", "part").applyInArrow(within, f"id {kind}, v array<double>, e string, k int, part int, bound double, to array<int>")


def needed(d: DataFrame, at: np.ndarray, seen: dict[int, tuple[int, float]]) -> DataFrame:
    """Asking rows with the block to compare them with (tk, tp) and their bound; the own block is done already. Rows are
    repeated for their blocks only where they are read, one at a time, and neither in Python nor in the checkpoint."""
    parts = F.array(*[F.lit(seen[k][0] if k in seen else 1) for k in range(max(1, len(at)))])
    asks = settled(asking(d, at, seen)).withColumn("tk", F.explode("to")).drop("to")
    there = F.when(F.col("tk") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.get(parts, F.col("tk")) - 1))
    return asks.withColumn("tp", F.explode(there)).filter((F.col("tk") != F.col("k")) | (F.col("tp") != F.col("part")))


def nearest(rows: DataFrame, ident: str, vector: str, event: str, train: str, block: int = 1 << 12, ask: str | None = None) -> DataFrame:
    """The distance of every row (of those that ``ask`` marks) to the nearest training row of another event; rows
    without one are left out. A task holds two blocks of about ``block`` rows."""
    d, at, seen = dealt(rows, ident, vector, event, train, block, ask)
    asks = needed(d, at, seen)
    pairs = asks.filter("tk >= 0").select(F.col("k").alias("ak"), F.col("part").alias("ap"), "tk", "tp").distinct()
    there = d.filter("t").select("v", "e", F.col("k").alias("tk"), F.col("part").alias("tp")).join(pairs, ["tk", "tp"])

    def across(own: pa.Table, others: pa.Table) -> pa.Table:
        return pa.table({"id": own["id"], "nearest": pa.array(_least(own, others))})

    key = ["ak", "ap", "tk", "tp"]
    own = asks.filter("tk >= 0").select("id", "v", "e", *[F.col(a).alias(b) for a, b in zip(("k", "part", "tk", "tp"), key, strict=True)])
    found = own.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(across, f"id {dict(rows.dtypes)[ident]}, nearest double")
    out = asks.filter("tk < 0").select("id", F.col("bound").alias("nearest")).union(found).groupBy("id").agg(F.min("nearest").alias("nearest"))
    return out.filter(F.col("nearest") < float("inf")).withColumnRenamed("id", ident)
