"""Evaluation of ranking probabilities, paired comparisons, calibration and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitrank.operators.near import nearest
from pitrank.sources.store import settled


def clipped(p: str, low: float = 1e-15) -> Column:
    return F.least(F.greatest(F.col(p), F.lit(low)), F.lit(1 - low))


def log_loss(p: str, y: Column) -> Column:
    return -F.when(y, F.log(clipped(p))).otherwise(F.log(1 - clipped(p)))


def binary_metrics(rows: DataFrame, keys: list[str], p: str, y: Column) -> DataFrame:
    """Log loss, Brier score and n over known labels; insufficient where only one class occurs."""
    known = rows.filter(y.isNotNull())
    n = F.count("*")
    out = known.groupBy(*keys).agg(F.round(F.avg(log_loss(p, y)), 6).alias("log_loss"), F.round(F.avg((F.col(p) - y.cast("int")) ** 2), 6).alias("brier"), n.alias("n"), F.count_if(y).alias("k"))
    return out.withColumn("insufficient", (F.col("k") == 0) | (F.col("k") == F.col("n"))).drop("k")


def winner_metrics(rows: DataFrame, keys: list[str], event: list[str], p: str, won: Column, ident: str) -> DataFrame:
    """Per event -ln p(winner), multiclass Brier, and whether the winner is first or in the first three."""
    w = Window.partitionBy(*keys, *event).orderBy(F.desc(p), ident)
    r = rows.withColumn("r", F.row_number().over(w)).withColumn("won", won)
    per = r.groupBy(*keys, *event).agg(
        F.sum(F.when(F.col("won"), -F.log(clipped(p)))).alias("loss"),
        F.sum((F.col(p) - F.col("won").cast("int")) ** 2).alias("brier"),
        F.max(F.when(F.col("won"), (F.col("r") == 1).cast("int"))).alias("top1"),
        F.max(F.when(F.col("won"), (F.col("r") <= 3).cast("int"))).alias("top3"),
    )
    return per


def ranked_probability(rows: DataFrame, keys: list[str], place: str, p: str, actual: str) -> DataFrame:
    """Mean over places but the last of the squared gap between cumulative forecast and outcome."""
    w = Window.partitionBy(*keys).orderBy(place)
    d = rows.withColumn("gap", (F.sum(p).over(w) - (F.col(actual) <= F.col(place)).cast("int")) ** 2).withColumn("last", F.max(place).over(Window.partitionBy(*keys)))
    return d.filter(F.col(place) < F.col("last")).groupBy(*keys).agg(F.round(F.avg("gap"), 6).alias("rps"))


def pairwise(rows: DataFrame, event: list[str], ident: str, score: str, place: str) -> DataFrame:
    """Share of entrant pairs that the score orders as they finished; an equal score counts half."""
    a = rows.filter(F.col(place).isNotNull()).select(*event, F.col(ident).alias("a"), F.col(score).alias("sa"), F.col(place).alias("pa"))
    b = a.select(*event, F.col("a").alias("b"), F.col("sa").alias("sb"), F.col("pa").alias("pb"))
    right = F.when(F.col("sa") == F.col("sb"), 0.5).otherwise(((F.col("sa") > F.col("sb")) == (F.col("pa") < F.col("pb"))).cast("double"))
    return a.join(b, event).filter("a < b").groupBy(*event).agg(F.round(F.avg(right), 6).alias("accuracy"), F.count("*").alias("pairs"))


def reliability(rows: DataFrame, keys: list[str], p: str, y: Column, edges: Column | None = None) -> DataFrame:
    """Per bin of the probability its mean, the observed share and the count."""
    bins = F.least(F.floor(F.col(p) * 10), F.lit(9)) if edges is None else edges
    return rows.filter(y.isNotNull()).groupBy(*keys, bins.cast("long").alias("bin")).agg(F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y.cast("int")), 6).alias("share"), F.count("*").alias("n"))


def calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Count-weighted mean gap between a bin's mean probability and its share."""
    return bins.groupBy(*keys).agg(F.round(F.sum(F.abs(F.col("mean_p") - F.col("share")) * F.col("n")) / F.sum("n"), 6).alias("ece"))


def sharpness(rows: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Entropy, effective contenders, largest probability and share of small ones."""
    q = clipped(p)
    h = F.sum(-q * F.log(q))
    return rows.groupBy(*keys).agg(F.round(h, 6).alias("entropy"), F.round(F.exp(h), 6).alias("contenders"), F.round(F.max(p), 6).alias("largest"), F.round(F.avg((F.col(p) < 0.02).cast("int")), 6).alias("small"))


def paired(losses: DataFrame, event: list[str], model: str, loss: str, left: str, right: str) -> DataFrame:
    """Per event the first model's loss less the second's; only events that both have."""
    pick = lambda m, name: losses.filter(F.col(model) == m).groupBy(*event).agg(F.avg(loss).alias(name))
    return pick(left, "a").join(pick(right, "b"), event).withColumn("delta", F.col("a") - F.col("b"))


def hashed(*parts: Column | str) -> Column:
    """A uniform integer of 32 bits that every engine can compute: the first eight hex digits of an MD5."""
    text = F.concat_ws("|", *[F.col(x) if isinstance(x, str) else x for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``i``, from 0 on in that order: ranges are numbered by themselves, after an offset for each."""
    d = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).persist()
    start, table = 0, []
    for p, n in sorted(d.groupBy("_p").count().collect()):  # one row for each partition
        table.append((p, start))
        start += n
    starts = d.sparkSession.createDataFrame(table, "_p int, _s long")
    w = Window.partitionBy("_p").orderBy(*order)
    return d.withColumn("i", F.row_number().over(w)).join(F.broadcast(starts), "_p").withColumn("i", F.col("i") - 1 + F.col("_s")).drop("_p", "_s")


def resampled(events: DataFrame, keys: list[str], resamples: int, seed: int, fold: str | None = None) -> DataFrame:
    """how often each resample of all events (with replacement, hashed) took an event; those never taken are out.
    With a ``fold`` column each fold's events are resampled by themselves."""
    by = [fold] if fold else []
    d = numbered(events.distinct(), [*by, *keys])
    size = d.groupBy(*by).agg(F.count("*").alias("_n"), F.min("i").alias("_least"))
    d = (d.join(F.broadcast(size), by) if by else d.crossJoin(F.broadcast(size))).withColumn("i", F.col("i") - F.col("_least"))  # a row for each fold
    slots = d.select(*by, "i", "_n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    name = [F.col(c).cast("string") for c in (*by, "b", "i")]
    picks = slots.select(*by, "b", F.pmod(hashed(F.lit(str(seed)), *name), F.col("_n")).alias("i"))
    return picks.groupBy(*by, "b", "i").agg(F.count("*").alias("often")).join(d, [*by, "i"]).select(*by, *keys, "b", "often")


def bootstrap(deltas: DataFrame, ident: str, value: str, resamples: int, seed: int) -> DataFrame:
    """The 95 % interval of the mean over resampled events.

    Draws come from a hash of (seed, resample, slot), so they don't depend on partitions. Events are numbered by ranges
    and joined to the draws by number; only sums per resample are kept."""
    d = numbered(deltas.select(ident, value), [ident]).persist()
    n = d.count()
    slots = d.select(F.col("i").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    picks = slots.select("b", F.pmod(hashed(F.lit(str(seed)), F.col("b").cast("string"), F.col("slot").cast("string")), F.lit(max(1, n))).alias("i"))
    means = picks.join(d.select("i", value), "i").groupBy("b").agg(F.avg(value).alias("m"))
    return means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"), F.round(F.avg("m"), 6).alias("middle"))


def objective(shares: DataFrame, keys: list[str], event: str, won: Column, podium: Column) -> DataFrame:
    """Mean over events of -ln p(winner) plus a third of the podium log loss; shares are win and podium."""
    p, q = clipped("win"), clipped("podium")
    each = F.when(podium, -F.log(q)).otherwise(-F.log(1 - q))
    e = shares.groupBy(*keys, event).agg((F.sum(F.when(won, -F.log(p))) + F.avg(each) / 3).alias("loss"))
    return e.groupBy(*keys).agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("loss").alias("events"))


def two_runs(old: DataFrame, new: DataFrame, keys: list[str], event: list[str], p: str) -> DataFrame:
    """Mean log loss of the new run less the old one's over the events that both have, and events of one only."""
    j = old.select(*keys, *event, F.col(p).alias("a")).join(new.select(*keys, *event, F.col(p).alias("b")), [*keys, *event], "full")
    lost = lambda c: -F.log(F.greatest(F.col(c), F.lit(1e-15)))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.groupBy(*keys).agg(F.count_if(F.col("a").isNull()).alias("only_new"), F.count_if(F.col("b").isNull()).alias("only_old"), F.count_if(both).alias("events"), F.round(F.avg(F.when(both, lost("b") - lost("a"))), 6).alias("delta"))


def common(rows: DataFrame, event: list[str], model: str, models: int) -> DataFrame:
    """Events that every model has."""
    return rows.groupBy(*event).agg(F.countDistinct(model).alias("k")).filter(F.col("k") == models).select(*event)


def best_earlier(losses: DataFrame, keys: list[str], ordinal: str, cell: str, loss: str, least: int) -> DataFrame:
    """For every event the grid cell with the smallest mean loss over the earlier ones; the first cell wins ties,
    and with fewer than ``least`` earlier events cell 0 is used."""
    w = Window.partitionBy(*keys, cell).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    d = losses.withColumn("mean", F.avg(loss).over(w)).withColumn("k", F.count(loss).over(w))
    got = d.groupBy(*keys, ordinal).agg(F.min(F.struct(F.round("mean", 9), cell)).alias("m"), F.max("k").alias("earlier"))
    return got.select(*keys, ordinal, F.when(F.col("earlier") >= least, F.col(f"m.{cell}")).otherwise(0).alias("cell"), "earlier")


def intraclass(rows: DataFrame, group: list[str], value: str, least: int = 3) -> DataFrame:
    """Intraclass correlation from the variances between and within groups of ``least`` rows or more."""
    g = rows.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).filter(F.col("n") >= least)
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") ** 2).alias("nmm"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"), F.sum(F.col("n") ** 2).alias("nn"))
    between = (F.col("nmm") - F.col("nm") ** 2 / F.col("n")) / (F.col("k") - 1)
    within = F.col("ssw") / (F.col("n") - F.col("k"))
    size = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)
    return s.select("k", "n", F.round((between - within) / (between + (size - 1) * within), 6).alias("icc"))


def outside_range(live: DataFrame, train: DataFrame, values: list[str], ident: str) -> DataFrame:
    """Live values outside the training range: one row each, by feature."""
    span = train.agg(*[F.min(v).alias(f"{v}_low") for v in values], *[F.max(v).alias(f"{v}_high") for v in values])
    j = live.crossJoin(F.broadcast(span))
    found = [F.when(~F.col(v).between(F.col(f"{v}_low"), F.col(f"{v}_high")), F.lit(v)) for v in values]
    return j.select(ident, F.explode(F.array_compact(F.array(*found))).alias("feature"))


def unseen_patterns(live: DataFrame, train: DataFrame, values: list[str], ident: str) -> DataFrame:
    """Live rows whose pattern of missing values training never had."""
    flags = F.concat_ws("", *[F.col(v).isNull().cast("int") for v in values]).alias("pattern")
    return live.select(ident, flags).join(train.select(flags).distinct(), "pattern", "left_anti")


def mean_rank(losses: DataFrame, task: str, model: str, loss: str) -> DataFrame:
    """Mean rank of each model over tasks, and whether it is chosen (smallest, then by name)."""
    r = losses.withColumn("r", F.row_number().over(Window.partitionBy(task).orderBy(loss, model)))
    m = r.groupBy(model).agg(F.round(F.avg("r"), 6).alias("mean_rank"))
    return m.withColumn("chosen", F.row_number().over(Window.orderBy("mean_rank", model)) == 1)


def out_of_distribution(rows: DataFrame, ident: str, vector: str, event: str, train: str, share: float = 0.99) -> DataFrame:
    """Live rows with their nearest training distance, and whether it is beyond the ``share`` quantile of the
    distances from training rows to the nearest one of another event."""
    d = settled(rows.select(ident, train).join(nearest(rows, ident, vector, event, train), ident))
    limit = d.filter(train).agg(F.percentile("nearest", F.lit(share)).alias("threshold"))
    out = d.filter(~F.col(train)).crossJoin(F.broadcast(limit))
    return out.select(ident, F.round("nearest", 6).alias("nearest"), F.round("threshold", 6).alias("threshold"), (F.col("nearest") > F.col("threshold")).alias("far"))
