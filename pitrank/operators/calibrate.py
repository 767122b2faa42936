"""calibration of probabilities by a sigmoid of the logit or by an isotonic step function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pitrank.operators.models import logistic_by_fold

_BLOCK = "lo double, hi double, w double, s double"
FAN = 8  #: neighbouring parts that are merged at once


def inside(p: str | Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def enough(rows: DataFrame, p: str, label: str, kind: str) -> str | None:
    """Why known labels don't suffice for a calibration, if they don't: sigmoid: 10, with 2 of each class; isotonic:
    100, with 10 of each class, and 3 distinct scores."""
    d = rows.filter(F.col(label).isNotNull())
    n, k, scores = d.agg(F.count("*"), F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)), F.approx_count_distinct(p, 0.01)).first()
    least, by_class = (10, 2) if kind == "sigmoid" else (100, 10)
    return "insufficient_labels" if n < least or min(k, n - k) < by_class or (kind == "isotonic" and scores < 3) else None


def fit_sigmoid(rows: DataFrame, p: str, label: str, penalty: float = 1.0) -> tuple[list[float] | None, str | None]:
    """intercept and slope of the logit, the slope penalised; None and the reason if labels don't suffice."""
    if reason := enough(rows, p, label, "sigmoid"):
        return None, reason
    d = rows.select(F.array(F.lit(0)).alias("folds"), logit(inside(p)).alias("x"), F.col(label).cast("double").alias("y"))
    return logistic_by_fold(d, ["x"], {"y": "folds"}, penalty)[0, "y"], None


def pool(blocks: list[tuple], stack: list[list]) -> list[list]:
    """Adds blocks (lo, hi, weight, sum), in order, to blocks of rising means; those that don't rise are pooled."""
    for lo, hi, w, s in blocks:
        stack.append([lo, hi, w, s])
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, top, w, s = stack.pop()
            stack[-1][1:] = top, stack[-1][2] + w, stack[-1][3] + s
    return stack


def _arrow(stack: list[list], more: list[pa.Array]) -> pa.RecordBatch:
    columns = [pa.array(c, pa.float64()) for c in zip(*stack, strict=True)] if stack else [pa.array([], pa.float64())] * 4
    return pa.RecordBatch.from_arrays([*columns, *more], ["lo", "hi", "w", "s", "part"][: 4 + len(more)])


def fit_isotonic(rows: DataFrame, p: str, label: str) -> tuple[list[list] | None, str | None]:
    """blocks (lo, hi, weight, sum) of rising means, in order; None and the reason if labels don't suffice.

    Scores are dealt by ranges, each part pools its own adjacent violators, and neighbouring parts are merged ``FAN`` at a
    time until one is left: pooling parts and then the pools gives what pooling all rows gives. Blocks of rising means of
    0-1 labels number at most the order of n ** (2 / 3), whatever the data, so only that many meet at the end."""
    if reason := enough(rows, p, label, "isotonic"):
        return None, reason
    d = rows.filter(F.col(label).isNotNull()).groupBy(inside(p).alias("p")).agg(F.count("*").cast("double").alias("w"), F.sum(F.col(label).cast("double")).alias("s"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []
        for b in batches:
            x = b["p"].to_pylist()
            stack = pool(zip(x, x, b["w"].to_pylist(), b["s"].to_pylist(), strict=True), stack)
        yield _arrow(stack, [])

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("lo")
        stack = pool(zip(*(t[c].to_pylist() for c in ("lo", "hi", "w", "s")), strict=True), [])
        return pa.Table.from_batches([_arrow(stack, [pa.array([t["part"][0].as_py() // FAN] * len(stack), pa.int32())])])

    d = d.repartitionByRange("p").sortWithinPartitions("p").mapInArrow(first, _BLOCK).withColumn("part", F.spark_partition_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        d = d.groupBy((F.col("part") / FAN).cast("int").alias("g")).applyInArrow(merge, f"{_BLOCK}, part int")
        parts = -(-parts // FAN)
    return [list(r) for r in d.select("lo", "hi", "w", "s").orderBy("lo").collect()], None


def apply_sigmoid(rows: DataFrame, fit: list[float] | None, p: str, out: str) -> DataFrame:
    """Calibrated probabilities; without a fit the given ones."""
    return rows.withColumn(out, F.col(p) if fit is None else 1 / (1 + F.exp(-(F.lit(fit[0]) + F.lit(fit[1]) * logit(inside(p))))))


def apply_isotonic(rows: DataFrame, fit: list[list] | None, p: str, out: str) -> DataFrame:
    """Calibrated probabilities, linear between blocks and clipped; without a fit the given ones."""
    if fit is None:
        return rows.withColumn(out, F.col(p))
    ends = sorted({(x, s / w) for lo, hi, w, s in fit for x in (lo, hi)})
    sent = rows.sparkSession.sparkContext.broadcast(tuple(np.array(c) for c in zip(*ends, strict=True)))
    schema = StructType([*rows.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b[p].to_numpy(zero_copy_only=False).astype(float)
            q = np.clip(np.interp(np.clip(x, 1e-6, 1 - 1e-6), *sent.value), 1e-6, 1 - 1e-6)
            yield b.append_column(out, pa.array(q, mask=np.isnan(x)))

    return rows.mapInArrow(run, schema)
