"""Rolling-origin folds, training gates, matrices and the quantities that fits need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_folds(events: DataFrame, keys: list[str], ordinal: str, cutoff: str, label: str, least: int) -> DataFrame:
    """the training events of every test event: earlier ones whose labels were known by its cutoff; too few skip it."""
    t = events.select(*keys, F.col(ordinal).alias("test"), F.col(cutoff).alias("at"))
    e = events.select(*keys, F.col(ordinal).alias("train"), F.col(cutoff).alias("own"), label)
    n = F.count("*").over(Window.partitionBy(*keys, "test"))
    j = t.join(e, keys).filter((F.col("own") < F.col("at")) & (F.col(label) <= F.col("at"))).withColumn("n", n)
    return j.filter(F.col("n") >= least).select(*keys, "test", "train")


def skipped(events: DataFrame, folds: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """test events without a fold, with the reason."""
    got = folds.select(*keys, F.col("test").alias(ordinal)).distinct()
    return events.select(*keys, ordinal).join(got, [*keys, ordinal], "left_anti").withColumn("reason", F.lit("insufficient_prior_events"))


def training_rows(rows: DataFrame, folds: DataFrame, keys: list[str], ordinal: str, cutoffs: DataFrame, dnf: str, dnf_at: str) -> DataFrame:
    """rows of a fold's training events; a retirement label published after the fold's cutoff is null."""
    at = cutoffs.select(*keys, F.col(ordinal).alias("test"), F.col("cutoff").alias("at"))
    j = folds.join(at, [*keys, "test"]).join(rows.withColumnRenamed(ordinal, "train"), [*keys, "train"])
    return j.withColumn(dnf, F.when(F.col(dnf_at) <= F.col("at"), F.col(dnf)))


def calibration_split(folds: DataFrame, events: DataFrame, keys: list[str], ordinal: str, cutoff: str, label: str, k: int) -> DataFrame:
    """the latest k training events calibrate; fit events need labels known by the earliest of their cutoffs."""
    e = events.select(*keys, F.col(ordinal).alias("train"), F.col(cutoff).alias("own"), label)
    j = folds.join(e, [*keys, "train"])
    w = Window.partitionBy(*keys, "test")
    j = j.withColumn("r", F.row_number().over(w.orderBy(F.desc("train")))).withColumn("first", F.min(F.when(F.col("r") <= k, F.col("own"))).over(w))
    role = F.when(F.col("r") <= k, "calibrate").when(F.col(label) <= F.col("first"), "fit")
    return j.select(*keys, "test", "train", role.alias("role")).filter("role is not null")


def imputed(rows: DataFrame, fold: list[str], features: list[str], fit: Column) -> DataFrame:
    """nulls become the fold's exact training median, then features are standardised by the training rows'
    mean and population deviation."""
    train = rows.filter(fit)
    middle = train.groupBy(*fold).agg(*[F.median(f).alias(f"{f}_m") for f in features])
    filled = rows.join(F.broadcast(middle), fold).withColumns({f: F.coalesce(F.col(f).cast("double"), F.coalesce(f"{f}_m", F.lit(0.0))) for f in features}).drop(*[f"{f}_m" for f in features])
    scale = filled.filter(fit).groupBy(*fold).agg(*[F.avg(f).alias(f"{f}_a") for f in features], *[F.stddev_pop(f).alias(f"{f}_s") for f in features])
    out = filled.join(F.broadcast(scale), fold)
    return out.withColumns({f: (F.col(f) - F.col(f"{f}_a")) / F.when(F.col(f"{f}_s") == 0, 1.0).otherwise(F.col(f"{f}_s")) for f in features}).drop(*[f"{f}_{x}" for f in features for x in "as"])


def order_likelihood(rows: DataFrame, event: list[str], utility: str, place: str) -> DataFrame:
    """log-likelihood of each event's order: over places, utility minus log-sum-exp of the field still left."""
    known = rows.filter(F.col(place).isNotNull())
    left = Window.partitionBy(*event).orderBy(place).rowsBetween(0, Window.unboundedFollowing)
    d = known.withColumn("stage", F.col(utility) - F.log(F.sum(F.exp(utility)).over(left)))
    return d.groupBy(*event).agg(F.round(F.sum("stage"), 6).alias("log_likelihood"), F.count("*").alias("stages"))


def order_gradient(rows: DataFrame, event: list[str], utility: str, place: str, features: list[str]) -> Column:
    """gradient of the negative log-likelihood by feature weights, as one aggregate row.

    d/du_i = (sum over stages up to i's own of exp(u_i) / field) - 1, by two window sums."""
    known = rows.filter(F.col(place).isNotNull())
    left = Window.partitionBy(*event).orderBy(place).rowsBetween(0, Window.unboundedFollowing)
    before = Window.partitionBy(*event).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    d = known.withColumn("field", F.sum(F.exp(utility)).over(left))
    d = d.withColumn("g", F.exp(utility) * F.sum(1 / F.col("field")).over(before) - 1).withColumn("ll", F.col(utility) - F.log("field"))
    return d.agg(F.sum("ll").alias("ll"), *[F.sum(F.col("g") * F.col(f)).alias(f) for f in features])


def smoothed_rate(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(1 + events) / (2 + known)."""
    return rows.groupBy(*keys).agg(F.round((1 + F.coalesce(F.sum(F.col(value).cast("int")), F.lit(0))) / (2 + F.count(value)), 6).alias("rate"))


def heuristic(rows: DataFrame, event: list[str], values: list[str], entrant: str) -> DataFrame:
    """the first positive of the values, else n + 1; win probability inverse to it; rank and podium by it."""
    w = Window.partitionBy(*event)
    value = F.coalesce(*[F.when(F.col(v) > 0, F.col(v).cast("double")) for v in values], (F.count("*").over(w) + 1).cast("double"))
    d = rows.withColumn("value", value).withColumn("inverse", 1 / F.col("value"))
    return d.withColumn("p_win", normalised("inverse", event)).withColumn("rank", F.row_number().over(w.orderBy("value", entrant)).cast("long")).withColumn("podium", F.col("rank") <= 3).drop("inverse")


def baseline(rows: DataFrame, event: list[str], values: list[str], entrant: str, rate: str) -> DataFrame:
    """the heuristic model's predictions: win share, podium flag, place, and the recent retirement rate within 0..1
    (0 if unknown)."""
    d = heuristic(rows, event, values, entrant)
    dnf = F.least(F.greatest(F.coalesce(F.col(rate).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return d.select(*event, entrant, "p_win", F.col("podium").cast("double").alias("p_podium"), dnf.alias("p_dnf"), F.col("rank").cast("double").alias("expected"))


def predicted(rows: DataFrame, event: list[str], entrant: str, model: str) -> DataFrame:
    """a model's rows with the expected place held within 1..n and ranked within the event."""
    w = Window.partitionBy(*event)
    d = rows.withColumn("expected", F.least(F.greatest("expected", F.lit(1.0)), F.count("*").over(w).cast("double")))
    return d.withColumn("place", F.row_number().over(w.orderBy("expected", entrant)).cast("long")).withColumn("model", F.lit(model))


def observations(rows: DataFrame, folds: DataFrame, keys: list[str], ordinal: str, labels: list[str]) -> DataFrame:
    """per test event its rows, how many know each label, and the training events behind it."""
    train = folds.groupBy(*keys, F.col("test").alias(ordinal)).agg(F.count("*").alias("train_events"))
    return rows.groupBy(*keys, ordinal).agg(F.count("*").alias("n"), *[F.count(x).alias(f"n_{x}") for x in labels]).join(train, [*keys, ordinal])


def normalised(value: str, keys: list[str]) -> Column:
    """shares of a group; equal ones if the total is not positive."""
    w = Window.partitionBy(*keys)
    total = F.sum(value).over(w)
    return F.when(total > 0, F.col(value) / F.when(total > 0, total)).otherwise(1 / F.count("*").over(w))


def utility(kind: str, output: str, field: str) -> Column:
    """utilities from a model's output: a probability, a position or a share of the field."""
    if kind == "probability":
        return F.log(F.least(F.greatest(F.col(output), F.lit(1e-9)), F.lit(1.0)))
    return -F.col(output) * (F.col(field) if kind == "fraction" else 1)


def guard(rows: DataFrame, fit: DataFrame, calibrate: DataFrame, event: list[str], entrant: str, cutoff: str) -> DataFrame:
    """problems of a prediction cohort: repeated entrants, event used in fitting, label later than the cutoff."""
    used = fit.select(*event).union(calibrate.select(*event)).distinct().withColumn("used", F.lit(True))
    last = fit.agg(F.max("label_available_at").alias("last"))
    d = rows.groupBy(*event).agg(F.count("*").alias("n"), F.countDistinct(entrant).alias("k"), F.min(cutoff).alias("at"))
    d = d.join(used, event, "left").crossJoin(F.broadcast(last))
    return d.select(*event, (F.col("n") != F.col("k")).alias("repeated"), F.coalesce("used", F.lit(False)).alias("leaked"), (F.col("last") > F.col("at")).alias("late_label"))
