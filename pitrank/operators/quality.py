"""Evidence tiers, dataset builds, coverage and validation. Problems come back as rows, never as silent drops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tier(evidence: str, audited: str) -> Column:
    """1 gold, 2 silver, 3 development."""
    return F.when(F.col(audited) & F.col(evidence).isin("captured", "published"), 1).when(F.col(evidence).isin("captured", "published", "archived"), 2).otherwise(3)


def weakest(inputs: DataFrame, keys: list[str], tier_: str, problem: Column) -> DataFrame:
    """The weakest tier of a row's inputs; any problem lowers it to development."""
    return inputs.groupBy(*keys).agg(F.when(F.bool_or(problem), 3).otherwise(F.max(tier_)).alias("tier"))


def tier_from_json(rows: DataFrame, keys: list[str], evidence: str, cutoff: str, claimed: str) -> DataFrame:
    """Tier derived from per-feature evidence ``{feature: [{tier, at}]}``, and the rows' problems."""
    x = F.from_json(evidence, "map<string, array<struct<tier: int, at: long>>>")
    d = rows.select(*keys, cutoff, claimed, F.explode(x).alias("feature", "inputs"))
    per = d.select(*keys, cutoff, claimed, "feature", F.size("inputs").alias("_size"), F.explode_outer("inputs").alias("i"))
    g = per.groupBy(*keys, claimed).agg(F.max("i.tier").alias("derived"), F.bool_or(F.col("_size") == 0).alias("no_input"), F.bool_or(F.col("i.at") > F.col(cutoff)).alias("late"))
    return g.withColumn("overclaimed", F.col(claimed) < F.col("derived"))


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per row and rule that fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*keys, F.explode(failed).alias("problem"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side; repeated rows count."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def outcome_problems(rows: DataFrame, event: list[str], entrant: str, position: str, winner: Column, podium: Column) -> DataFrame:
    """Events with repeated entrants or positions, not exactly one winner, or flags unlike the position."""
    return rows.groupBy(*event).agg(
        (F.count("*") != F.countDistinct(entrant)).alias("repeated_entrant"),
        (F.count(position) != F.countDistinct(position)).alias("repeated_position"),
        (F.count_if(winner) != 1).alias("winners"),
        F.bool_or(podium != F.coalesce(F.col(position) <= 3, F.lit(False))).alias("podium_differs"),
        (F.max(position) > F.count("*")).alias("out_of_range"),
    )


def row_problems(rows: DataFrame, cohort: list[str], position: str, winner: Column, podium: Column, values: list[str]) -> DataFrame:
    """Per cohort whether it has not one winner, positions that repeat or leave 1..n, a podium flag unlike the
    position, or a value that is infinite."""
    infinite = F.lit(False)
    for v in values:
        infinite = infinite | F.coalesce(F.abs(F.col(v)) == float("inf"), F.lit(False))
    outside = F.coalesce((F.min(position) < 1) | (F.max(position) > F.count("*")), F.lit(False))
    return rows.groupBy(*cohort).agg(
        (F.count_if(winner) != 1).alias("winners"),
        ((F.count(position) != F.countDistinct(position)) | outside).alias("positions"),
        F.bool_or(podium != F.coalesce(F.col(position) <= 3, F.lit(False))).alias("podium"),
        F.bool_or(infinite).alias("infinite"),
    )


def coherent(places: DataFrame, marginals: DataFrame, event: list[str], entrant: str, tolerance: float = 1e-6) -> DataFrame:
    """Per event the sums of win and podium shares, and whether rows and columns of the finish distribution sum to
    1, podiums to 3 (or to the field), and the marginals agree with the distribution."""
    row = places.groupBy(*event, entrant).agg(F.sum("p").alias("s"), F.sum(F.when(F.col("place") == 1, F.col("p")).otherwise(0.0)).alias("w"), F.sum(F.when(F.col("place") <= 3, F.col("p")).otherwise(0.0)).alias("q"))
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) > tolerance
    row = row.withColumn("one", F.lit(1.0)).join(marginals, [*event, entrant], "full")
    rows = row.groupBy(*event).agg(F.round(F.sum("win"), 6).alias("wins"), F.round(F.sum("podium"), 6).alias("podiums"), F.count("*").alias("n"), F.bool_and(F.coalesce(~(off("s", "one") | off("w", "win") | off("q", "podium")), F.lit(False))).alias("rows_fit"))
    columns = places.groupBy(*event, "place").agg(F.sum("p").alias("s")).groupBy(*event).agg(F.max(F.abs(F.col("s") - 1)).alias("columns_off"))
    fits = F.col("rows_fit") & (F.col("columns_off") <= tolerance) & (F.abs(F.col("podiums") - F.least(F.lit(3), "n")) <= tolerance)
    return rows.join(columns, event).select(*event, "wins", "podiums", fits.alias("coherent"))


def assembled(features: DataFrame, labels: DataFrame, event: list[str], entrant: str, cutoff: str, label: str) -> DataFrame:
    """Features joined to labels; events whose rosters differ or with a label not after its cutoff are left out."""
    both = features.select(*event, entrant, F.lit(1).alias("a")).join(labels.select(*event, entrant, F.lit(1).alias("b")), [*event, entrant], "full")
    bad = both.filter("a is null or b is null").select(*event).distinct()
    late = features.join(labels, [*event, entrant]).filter(F.col(label) <= F.col(cutoff)).select(*event).distinct()
    return features.join(bad.union(late), event, "left_anti").join(labels, [*event, entrant])


def tiered(candidates: DataFrame, keys: list[str], order: str, reasons: dict[str, Column], tier_: str) -> DataFrame:
    """Every candidate is in one tier, or excluded with reasons; of repeated keys the first stays."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in reasons.items()]))
    d = candidates.withColumn("reasons", found).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    d = d.withColumn("reasons", F.when(F.col("_rank") > 1, F.array_append("reasons", F.lit("duplicate"))).otherwise(F.col("reasons"))).drop("_rank")
    return d.withColumn("tier", F.when(F.size("reasons") == 0, F.col(tier_)))


def coverage(rows: DataFrame, keys: list[str], event: list[str], features: list[str]) -> DataFrame:
    """Events, rows and known values of each feature by key."""
    return rows.groupBy(*keys).agg(F.countDistinct(F.struct(*event)).alias("events"), F.count("*").alias("n"), *[F.count(f).alias(f) for f in features])


def reason_counts(rows: DataFrame, reasons: str) -> DataFrame:
    """How often each feature has each reason, from a map column."""
    return rows.select(F.explode(reasons).alias("feature", "reason")).groupBy("feature", "reason").agg(F.count("*").alias("n"))


def summarised(rows: DataFrame, event: list[str], value: str) -> DataFrame:
    """Rows and mean of each event. Values are added up in their own order, not in that of a shuffle, so that the
    same rows give the same mean every time."""
    total = F.aggregate(F.array_sort(F.collect_list(value)), F.lit(0.0), lambda a, b: a + b)
    return rows.groupBy(*event).agg(F.count("*").alias("n"), F.round(F.try_divide(total, F.count(value)), 6).alias(value))


def replayed(frozen: DataFrame, again: DataFrame, keys: list[str], values: list[str], end: str, available: str, margin: Column) -> DataFrame:
    """Keys whose frozen values differ from recomputed ones, that only one side has, or whose clock isn't the end of
    the source plus the margin."""
    a = frozen.select(*keys, F.struct(*values).alias("a"), (F.col(available) != F.col(end) + margin).alias("late"))
    j = a.join(again.select(*keys, F.struct(*values).alias("b")), keys, "full")
    d = j.select(*keys, (~F.col("a").eqNullSafe(F.col("b"))).alias("values_differ"), F.coalesce("late", F.lit(False)).alias("clock_differs"))
    return d.filter("values_differ or clock_differs")


def one_schema(parts: list[DataFrame]) -> DataFrame:
    """The union of contracts, which must have the same columns of the same types."""
    want = [(f.name, f.dataType) for f in parts[0].schema]
    for d in parts[1:]:
        have = [(f.name, f.dataType) for f in d.schema]
        if have != want:
            raise ValueError(f"contracts differ: {sorted(set(map(str, have)) ^ set(map(str, want)))}")
    return reduce(DataFrame.unionByName, parts)


def missing_reasons(cases: dict[str, list[tuple[Column, str]]]) -> Column:
    """A map from each feature that is null to its first reason that holds, in order of priority."""
    entries = []
    for feature, ordered in cases.items():
        reason = F.coalesce(*[F.when(holds, F.lit(name)) for holds, name in ordered], F.lit("unknown"))
        entries.append(F.when(F.col(feature).isNull(), F.struct(F.lit(feature).alias("key"), reason.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def shortlist(rows: DataFrame, eligible: Column, score: Column, ident: str, limit: int) -> DataFrame:
    """Eligible candidates by score; those beyond the limit and the others have a reason."""
    d = rows.withColumn("_ok", eligible).withColumn("score", score)
    d = d.withColumn("_rank", F.row_number().over(Window.partitionBy("_ok").orderBy(F.desc("score"), ident)))
    return d.withColumn("reason", F.when(~F.col("_ok"), "not_eligible").when(F.col("_rank") > limit, "bounded_pool_limit")).drop("_rank", "_ok")


def version_diff(old: DataFrame, new: DataFrame, key: list[str], state: str, hash_: str) -> DataFrame:
    """What became of each key between two versions of a dataset."""
    j = old.select(*key, F.col(state).alias("s0"), F.col(hash_).alias("h0")).join(new.select(*key, F.col(state).alias("s1"), F.col(hash_).alias("h1")), key, "full")
    change = F.when(F.col("s0").isNull(), "first_observed").when(F.col("s1").isNull(), "removed")
    change = change.when((F.col("s0") == "excluded") & (F.col("s1") == "gold"), "excluded_to_gold").when((F.col("s0") == "gold") & (F.col("s1") == "excluded"), "gold_to_excluded")
    return j.select(*key, change.when(F.col("h0") != F.col("h1"), "changed").otherwise("unchanged").alias("change"))


def agreed_status(rows: DataFrame, first: str, second: str, flags: str) -> DataFrame:
    """The retirement label on which three sources agree, or the reason why there is none."""
    a, b = F.col(first), F.col(second)
    third = F.col(flags) % 3
    reason = F.when(a.isin("dns", "dsq") | b.isin("dns", "dsq"), "outside_label").when(a.isNull() | b.isNull(), "source_absent").when(a != b, "sources_differ").when((third == 0) != (a == "finished"), "flags_differ")
    return rows.withColumn("reason", reason).withColumn("label", F.when(F.col("reason").isNull(), a == "retired"))


def source_patterns(rows: DataFrame, keys: list[str], ident: str, examples: int = 2) -> DataFrame:
    """How often each combination of sources occurs, with its first examples."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(ident)))
    g = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_rank") <= examples, F.col(ident)))).alias("examples"))
    return g.withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


def masked(rows: DataFrame, features: list[str]) -> DataFrame:
    """The features null and flagged as missing."""
    return rows.withColumns({f: F.lit(None).cast(rows.schema[f].dataType) for f in features} | {f"{f}_missing": F.lit(True) for f in features})


def absent_features(live: DataFrame, train: DataFrame, features: list[str]) -> DataFrame:
    """Features null in every live row but known in training."""
    count = lambda d, side: d.agg(*[F.count(f).alias(f) for f in features]).unpivot([], features, "feature", side)
    return count(live, "live").join(count(train, "train"), "feature").filter("live = 0 and train > 0")


def ablations(rows: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """The rows once per stage, each with the features of all groups after the stage masked."""
    names, parts = list(groups), []
    for i, name in enumerate(names):
        hidden = [f for g in names[i + 1 :] for f in groups[g]]
        part = masked(rows, hidden)
        shown = {f"{f}_missing": F.col(f).isNull() for g in names[: i + 1] for f in groups[g]}
        parts.append(part.withColumns(shown).withColumn("stage", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def incoherent(rows: DataFrame, event: list[str], entrant: str, place: str, p: str, tolerance: float = 1e-6) -> DataFrame:
    """Entrants or places of an event whose probabilities do not sum to 1."""
    by = lambda c, kind: rows.groupBy(*event, F.col(c).cast("string").alias("of")).agg(F.sum(p).alias("total")).filter(F.abs(F.col("total") - 1) > tolerance).select(*event, F.lit(kind).alias("kind"), "of")
    return by(entrant, "entrant").union(by(place, "place"))


def attached(frozen: DataFrame, outcomes: DataFrame, event: list[str], version: str, values: list[str]) -> DataFrame:
    """Each frozen row with the newest outcome version; events without one keep null."""
    top = outcomes.groupBy(*event).agg(F.max(F.struct(version, *values)).alias("o"))
    return frozen.join(top, event, "left").select(frozen["*"], *[F.col(f"o.{c}").alias(c) for c in (version, *values)])


def extended(reviewed: DataFrame, found: DataFrame, key: list[str], clock: str, values: list[str]) -> DataFrame:
    """Reviewed rows win; other keys take their latest document."""
    top = found.join(reviewed, key, "left_anti").groupBy(*key).agg(F.max(F.struct(clock, *values)).alias("d"))
    return reviewed.select(*key, *values).withColumn("origin", F.lit("reviewed")).unionByName(top.select(*key, *[F.col(f"d.{v}").alias(v) for v in values], F.lit("latest").alias("origin")))


def standings_coherent(places: DataFrame, means: DataFrame, now: DataFrame, keys: list[str], ident: str, tolerance: float = 1e-6) -> DataFrame:
    """Per entrant whether its shares of places (``p``) sum to 1, none is beyond the field, and its mean points
    are not below those it has (``points_now``)."""
    size = means.groupBy(*keys).agg(F.count("*").alias("_n"))
    d = places.groupBy(*keys, ident).agg(F.sum("p").alias("_p"), F.max("position").alias("_deepest")).join(size, keys).join(means, [*keys, ident]).join(now, [*keys, ident])
    return d.select(*keys, ident, (F.abs(F.col("_p") - 1) < 1e-5).alias("positions_sum"), (F.col("_deepest") <= F.col("_n")).alias("positions_in_field"), (F.col("mean_points") >= F.col("points_now") - tolerance).alias("keeps_points"))
