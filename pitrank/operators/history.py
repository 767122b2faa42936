"""History as of a cutoff in one pass: facts and cutoffs in the order of their clocks, with running sums and bounded
buffers of the latest facts.

Work is linear in the facts of a key (times the logarithm of a buffer): no fact is paired with the cutoffs that come after
it. A fact counts from its clock on; labels are known after their own event's cutoff only, and cutoffs rise with the
ordinals, so that what is known at a cutoff is earlier than its event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def known(facts: DataFrame, targets: DataFrame, keys: list[str], clock: str, at: str, sums: dict[str, Column] | None = None, latest: dict[str, tuple[int, list[str]]] | None = None, strict: bool = True) -> DataFrame:
    """The rows of ``targets`` with what was known of their key before ``at`` (``strict``; else at it, too).

    ``sums`` are running sums of columns of the facts, 0 if there is none; ``latest`` are arrays of at most n structs of
    columns, descending by the first of them. Facts with a null clock never count."""
    sums, latest = sums or {}, latest or {}
    kept = [F.struct(*columns).alias(f"_{name}") for name, (_, columns) in latest.items()]
    f = facts.select(*keys, F.col(clock).alias("_t"), F.lit(1).alias("_k"), *[x.alias(f"_{name}") for name, x in sums.items()], *kept).filter("_t is not null")
    t = targets.select(*keys, F.col(at).alias("_t"), F.lit(0 if strict else 2).alias("_k"), F.struct(*targets.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = f.unionByName(t, allowMissingColumns=True)
    out = [F.coalesce(F.sum(f"_{name}").over(w), F.lit(0)).alias(name) for name in sums]
    out += [InternalFunction.collect_top_k(F.col(f"_{name}"), n, False).over(w).alias(name) for name, (n, _) in latest.items()]
    return d.select("_k", "_row", *out).filter(F.col("_k") != 1).select("_row.*", *sums, *latest)


def mean(total: str, count: str) -> Column:
    """A mean from running sums, null without any."""
    return F.col(total) / F.when(F.col(count) > 0, F.col(count))


def mean_of(items: Column, value) -> Column:
    """The mean of a value over the structs of an array; null values and empty arrays give null."""
    values = F.array_compact(F.transform(items, lambda x: value(x).cast("double")))
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(values) > 0, F.size(values))


def last_appearances(facts: DataFrame, targets: DataFrame, keys: list[str], clock: str, at: str, ordinal: str, value: str, count: int, first: int) -> DataFrame:
    """Of the latest ``count`` facts those with a value: the mean of all of them and of the first ``first``."""
    d = known(facts, targets, keys, clock, at, latest={"h": (count, [ordinal, value])}).withColumn("h", F.filter("h", lambda x: x[value].isNotNull()))
    own = lambda x: x[value]
    return d.filter(F.size("h") > 0).withColumns({"mean_all": F.round(mean_of(F.col("h"), own), 6), "mean_first": F.round(mean_of(F.slice("h", 1, first), own), 6), "observations": F.size("h").cast("long")}).drop("h")


def rate_of_latest(facts: DataFrame, targets: DataFrame, keys: list[str], clock: str, at: str, ordinal: str, value: str, count: int) -> DataFrame:
    """A rate over the latest ``count`` facts whose value was known by then."""
    d = known(facts.filter(F.col(value).isNotNull()), targets, keys, clock, at, latest={"h": (count, [ordinal, value])})
    return d.filter(F.size("h") > 0).withColumns({"rate": F.round(mean_of(F.col("h"), lambda x: x[value].cast("int")), 6), "observations": F.size("h").cast("long")}).drop("h")


def rate_of_latest_events(facts: DataFrame, targets: DataFrame, keys: list[str], clock: str, own: str, at: str, ordinal: str, value: str, count: int) -> DataFrame:
    """A rate over the rows of the latest ``count`` events, of values whose own clock is in time; events are counted
    before values are looked at."""
    per = facts.groupBy(*keys, ordinal, clock).agg(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(own).alias("c"), F.col(value).cast("int").alias("v")))).alias("rows"))
    d = known(per, targets, keys, clock, at, latest={"h": (count, [ordinal, "rows"])})
    d = d.withColumn("h", F.filter(F.flatten(F.transform("h", lambda x: x["rows"])), lambda r: r["c"] < F.col(at)))
    return d.filter(F.size("h") > 0).withColumns({"rate": F.round(mean_of(F.col("h"), lambda r: r["v"]), 6), "observations": F.size("h").cast("long")}).drop("h")


def head_to_head(facts: DataFrame, targets: DataFrame, keys: list[str], clock: str, at: str, ordinal: str, value: str, mate: str, count: int) -> DataFrame:
    """Share of the latest ``count`` comparable appearances ahead of the best team mate; a tie counts half."""
    d = known(facts.filter(F.col(value).isNotNull() & F.col(mate).isNotNull()), targets, keys, clock, at, latest={"h": (count, [ordinal, value, mate])})
    won = lambda x: F.when(x[value] < x[mate], 1.0).when(x[value] == x[mate], 0.5).otherwise(0.0)
    return d.filter(F.size("h") > 0).withColumns({"share": F.round(mean_of(F.col("h"), won), 6), "comparable": F.size("h").cast("long")}).drop("h")


def kernel_delta(facts: DataFrame, targets: DataFrame, kernel: DataFrame, keys: list[str], clock: str, at: str, ordinal: str, place: str, target: str, value: str, count: int, by: list[str]) -> DataFrame:
    """Kernel-weighted value at similar places minus the own mean over the latest ``count`` known values."""
    d = known(facts.filter(F.col(value).isNotNull()), targets, keys, clock, at, latest={"h": (count, [ordinal, place, value])})
    d = d.withColumn("base", mean_of(F.col("h"), lambda x: x[value])).select(*by, target, "base", F.explode("h").alias("x")).select(*by, target, "base", F.col(f"x.{place}").alias("other"), F.col(f"x.{value}").alias("v"))
    j = d.join(F.broadcast(kernel), [target, "other"])
    return j.groupBy(*by).agg(F.round(F.sum(F.col("weight") * (F.col("v") - F.col("base"))) / F.sum("weight"), 6).alias("delta"))
