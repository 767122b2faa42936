"""Laps, stints, stops and weather: range joins inside an equality key, then summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_stint(laps: DataFrame, stints: DataFrame, keys: list[str], carry: list[str], lap: str = "lap") -> DataFrame:
    """Each lap with its stint: equality on the entrant's session, then the range; laps in two stints are an error."""
    return laps.join(stints.select(*keys, "lap_start", "lap_end", *carry), keys).filter(F.col(lap).between(F.col("lap_start"), F.col("lap_end")))


def lap_summary(laps: DataFrame, stints: DataFrame, keys: list[str], usable: Column, slack: float = 1.07) -> DataFrame:
    """C17: usable laps within ``slack`` of the entrant's best, by compound: count, median, best, median tyre age."""
    good = laps.filter(usable).withColumn("best", F.min("duration").over(Window.partitionBy(*keys))).filter(F.col("duration") <= slack * F.col("best"))
    j = in_stint(good, stints, keys, ["compound", "age_at_start"]).withColumn("age", F.col("age_at_start") + F.col("lap") - F.col("lap_start"))
    return j.groupBy(*keys, "compound").agg(F.count("*").alias("laps"), F.round(F.median("duration"), 6).alias("median"), F.min("duration").alias("fastest"), F.median(F.col("age").cast("double")).alias("median_age"))


def clean_laps(laps: DataFrame, stints: DataFrame, keys: list[str], usable: Column, slack: float = 1.05) -> DataFrame:
    """Laps of a stint but its first, within ``slack`` of the stint's median."""
    j = in_stint(laps.filter(usable), stints, keys, ["stint", "compound", "age_at_start"]).filter(F.col("lap") > F.col("lap_start"))
    j = j.withColumn("middle", F.median("duration").over(Window.partitionBy(*keys, "stint")))
    return j.filter(F.col("duration") <= slack * F.col("middle")).withColumn("age", F.col("age_at_start") + F.col("lap") - F.col("lap_start"))


def degradation(clean: DataFrame, keys: list[str], field: list[str], least: int = 6, slopes: int = 3) -> DataFrame:
    """Slope of lap time on tyre age per stint, less the field's median slope of the compound."""
    s = clean.groupBy(*keys, "stint", "compound").agg(F.count("*").alias("n"), F.regr_slope("duration", F.col("age").cast("double")).alias("slope")).filter(F.col("n") >= least)
    w = Window.partitionBy(*field, "compound")
    return s.withColumn("k", F.count("slope").over(w)).withColumn("middle", F.median("slope").over(w)).filter(F.col("k") >= slopes).select(*keys, "stint", "compound", "n", F.round(F.col("slope") - F.col("middle"), 6).alias("relative"))


def typical_stop(stops: DataFrame, group: list[str], keys: list[str], value: str, spread: float, drop_over: float, floor: float, cap: float) -> DataFrame:
    """Each stop less the group's normal one: the median of those within ``spread`` of the fastest."""
    w = Window.partitionBy(*group)
    known = stops.filter(F.col(value).isNotNull()).withColumn("low", F.min(value).over(w))
    normal = known.filter(F.col(value) <= spread * F.col("low")).groupBy(*group).agg(F.median(value).alias("normal"))
    d = known.join(normal, group).withColumn("delta", F.col(value) - F.col("normal")).filter(F.col("delta") <= drop_over)
    return d.groupBy(*keys).agg(F.round(F.avg(F.least(F.greatest("delta", F.lit(floor)), F.lit(cap))), 6).alias("delta"), F.count("*").alias("stops"))


def complete_window(targets: DataFrame, hourly: DataFrame, keys: list[str], start: str, valid: str, value: str, before: int, after: int, name: str) -> DataFrame:
    """The sum over hours in (start - before, start + after]; null unless every hour is there and known."""
    t = targets.select(*keys, F.explode(F.expr(f"sequence(date_trunc('hour', {start}) - INTERVAL {before - 1} HOUR, date_trunc('hour', {start}) + INTERVAL {after} HOUR, INTERVAL 1 HOUR)")).alias("hour"))
    j = t.join(hourly.select(F.col(valid).alias("hour"), value), "hour", "left")
    return j.groupBy(*keys).agg(F.when(F.count(value) == before + after, F.round(F.sum(value), 6)).alias(name))


def wet_gain(rows: DataFrame, keys: list[str], ordinal: str, gain: str, wet: str, weight: int = 5) -> DataFrame:
    """Mean gain in the wet less in the dry over earlier events, shrunk by n / (n + weight) of the wet ones."""
    w = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    own = lambda flag: F.avg(F.when(F.col(wet) == flag, F.col(gain))).over(w)
    n = F.count_if(F.col(wet)).over(w)
    return rows.withColumn("skill", F.round((own(True) - own(False)) * n / (n + weight), 6))
