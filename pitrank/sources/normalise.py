"""Publications as JSON envelopes, flattened to rows with declared schemas and strict scalar rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEDULE = "struct<season: string, races: array<struct<round: string, raceName: string, Circuit: struct<circuitId: string>, date: string, time: string>>>"
RESULTS = "struct<season: string, round: string, Results: array<struct<Driver: struct<driverId: string>, Constructor: struct<constructorId: string>, position: string, positionText: string, grid: string, laps: string, points: string, status: string>>>"
QUALIFYING = "struct<season: string, round: string, QualifyingResults: array<struct<Driver: struct<driverId: string>, Constructor: struct<constructorId: string>, position: string, Q1: string, Q2: string, Q3: string>>>"
WEEKEND = "struct<season: string, round: string, FirstPractice: struct<date: string, time: string>, Qualifying: struct<date: string, time: string>, SprintQualifying: struct<date: string, time: string>, SprintShootout: struct<date: string, time: string>, date: string, time: string>"


def parsed(payloads: DataFrame, schema: str, payload: str = "payload", strict: bool = True) -> DataFrame:
    """The payload as ``x``; malformed JSON fails, or with ``strict`` off becomes null."""
    return payloads.withColumn("x", F.from_json(payload, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))


def clock(date: Column, time: Column) -> Column:
    """Zone-less UTC time of a date and a time with Z; null if either is."""
    return F.to_timestamp_ntz(F.concat(date, F.lit(" "), F.rtrim(time, F.lit("Z"))), F.lit("yyyy-MM-dd HH:mm:ss"))


def strict_int(text: Column) -> Column:
    """An int from decimal digits only, else null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def strict_float(text: Column) -> Column:
    """A finite, non-negative double, else null."""
    value = text.try_cast("double")
    return F.when((value >= 0) & ~F.isnan(value) & (value < float("inf")), value)


def place(text: Column) -> tuple[Column, Column]:
    """Place tokens: NC and DQ are null, digits may end in F; and whether the token is none of these."""
    digits = F.regexp_extract(text, "^([0-9]+)F?$", 1)
    return F.when(digits != "", digits.try_cast("long")), (digits == "") & ~text.isin("NC", "DQ")


def lap_seconds(text: Column) -> tuple[Column, Column]:
    """Seconds of m:ss.sss; an empty text is null; and whether the form is bad (seconds of 60 or more too)."""
    m, s = F.regexp_extract(text, r"^(?:([0-9]+):)?([0-9]{1,2}(?:\.[0-9]+)?)$", 1), F.regexp_extract(text, r"^(?:([0-9]+):)?([0-9]{1,2}(?:\.[0-9]+)?)$", 2)
    seconds = s.try_cast("double")
    good = (s != "") & (seconds < 60)
    return F.when(good, F.coalesce(m.try_cast("double"), F.lit(0.0)) * 60 + seconds), (F.coalesce(text, F.lit("")) != "") & ~F.coalesce(good, F.lit(False))


def schedule(payloads: DataFrame, season: str) -> DataFrame:
    """One row per event; other seasons and repeated rounds are left out."""
    d = parsed(payloads, SCHEDULE).filter(F.col("x.season") == F.col(season)).select("*", F.explode("x.races").alias("r"))
    d = d.select(*[c for c in payloads.columns if c != "payload"], F.col("r.round").try_cast("long").alias("round"), F.col("r.raceName").alias("name"), F.col("r.Circuit.circuitId").alias("circuit_id"), clock(F.col("r.date"), F.col("r.time")).alias("start"))
    keys = [c for c in payloads.columns if c != "payload"] + ["round"]
    from pyspark.sql import Window

    return d.withColumn("k", F.count("*").over(Window.partitionBy(*keys))).filter("k = 1").drop("k")


def weekend(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Each session of a weekend with its time; a shootout stands in for sprint qualifying."""
    d = parsed(payloads, WEEKEND)
    at = lambda s: clock(F.col(f"{s}.date"), F.col(f"{s}.time"))
    wide = d.select(*keys, at("x.FirstPractice").alias("practice"), at("x.Qualifying").alias("qualifying"), F.coalesce(at("x.SprintQualifying"), at("x.SprintShootout")).alias("sprint_qualifying"), at("x").alias("race"))
    return wide.unpivot(keys, ["practice", "qualifying", "sprint_qualifying", "race"], "session", "start").filter("start is not null")


def qualifying(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Position and three session times per entrant."""
    d = parsed(payloads, QUALIFYING).select(*keys, F.explode("x.QualifyingResults").alias("r"))
    return d.select(*keys, F.col("r.Driver.driverId").alias("driver_id"), F.col("r.Constructor.constructorId").alias("constructor_id"), strict_int(F.col("r.position")).alias("position"), *[F.round(lap_seconds(F.col(f"r.Q{i}"))[0], 6).alias(f"q{i}") for i in (1, 2, 3)])


def results(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Classification rows; the text of the position is kept beside its number."""
    d = parsed(payloads, RESULTS).select(*keys, F.explode("x.Results").alias("r"))
    return d.select(
        *keys, F.col("r.Driver.driverId").alias("driver_id"), F.col("r.Constructor.constructorId").alias("constructor_id"),
        strict_int(F.col("r.position")).alias("position"), F.col("r.positionText").alias("position_text"),
        strict_int(F.col("r.grid")).alias("grid"), strict_int(F.col("r.laps")).alias("laps"), strict_float(F.col("r.points")).alias("points"), F.col("r.status").alias("status"),
    )


def entries(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Entrants of two sources; the first known team wins, different known teams are a conflict."""
    j = first.select(*keys, F.col(value).alias("a")).join(second.select(*keys, F.col(value).alias("b")), keys, "full")
    return j.select(*keys, F.coalesce("a", "b").alias(value), F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("conflict"))


def parallel_hours(payloads: DataFrame, keys: list[str], hours: str, values: list[str]) -> DataFrame:
    """A10: parallel arrays to rows; arrays of other lengths or repeated hours exclude the payload."""
    same = F.lit(True)
    for v in values:
        same = same & (F.size(v) == F.size(hours))
    good = payloads.filter(same & (F.size(F.array_distinct(hours)) == F.size(hours)))
    d = good.select(*keys, F.explode(F.arrays_zip(hours, *values)).alias("z"))
    return d.select(*keys, F.col(f"z.{hours}").alias("hour"), *[F.col(f"z.{v}").alias(v) for v in values])


def documents(pages: DataFrame, html: str, ident: str) -> DataFrame:
    """Registry rows of a page: each link's number, target and title."""
    found = F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    d = pages.select(ident, F.posexplode(found).alias("i", "a"))
    return d.select(ident, (F.col("i") + 1).cast("long").alias("link_no"), F.regexp_extract("a", 'href="([^"]*)"', 1).alias("link"), F.regexp_extract("a", ">([^<]*)<", 1).alias("title"))


def publication_clock(local: Column) -> tuple[Column, Column]:
    """Upper bound of a time labelled CET: read as UTC+1, plus a minute; and whether Paris was at UTC+1 then."""
    utc = local - F.expr("INTERVAL 1 HOUR")
    paris = F.from_utc_timestamp(utc.cast("timestamp"), "Europe/Paris")
    return utc + F.expr("INTERVAL 1 MINUTE"), paris == local.cast("timestamp")


def session_match(events: DataFrame, sessions: DataFrame, keys: list[str], start: str, at: str, ident: str, seconds: int = 10800) -> DataFrame:
    """The session that starts within ``seconds`` of the event; none or several leave it unmatched."""
    j = events.join(sessions, keys, "left").withColumn("near", F.abs(F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.col(start).cast("timestamp"))) <= seconds)
    g = j.groupBy(*events.columns).agg(F.count_if("near").alias("matches"), F.max(F.when(F.col("near"), F.col(ident))).alias(ident))
    return g.withColumn(ident, F.when(F.col("matches") == 1, F.col(ident)))


def crosswalk(sources: DataFrame, keys: list[str], number: str, ident: str) -> DataFrame:
    """Number to entrant; a number with several entrants is a conflict and maps to null."""
    g = sources.groupBy(*keys, number).agg(F.countDistinct(ident).alias("k"), F.min(ident).alias(ident))
    return g.select(*keys, number, F.when(F.col("k") == 1, F.col(ident)).alias(ident), (F.col("k") > 1).alias("conflict"))


def name_map(names: DataFrame, aliases: DataFrame, roster: DataFrame) -> DataFrame:
    """An exact alias wins; else a surname that ends one roster id alone, is no other name's, and is unclaimed."""
    exact = names.join(aliases, "name").select("name", "ident")
    left = names.join(exact, "name", "left_anti").withColumn("surname", F.lower(F.element_at(F.split("name", " "), -1)))
    free = roster.join(exact, "ident", "left_anti").withColumn("surname", F.element_at(F.split("ident", "_"), -1))
    alone = lambda d, c: d.join(d.groupBy("surname").count().filter("count = 1").select("surname"), "surname", "left_semi").select("surname", c)
    return exact.union(alone(left, "name").join(alone(free, "ident"), "surname").select("name", "ident"))


def row_hash(rows: DataFrame) -> Column:
    """MD5 of a row's canonical JSON, columns in order of names."""
    return F.md5(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}))


def table_hash(rows: DataFrame) -> DataFrame:
    """A hash of a table that doesn't depend on the order of rows: count and sum of row hashes, mergeable."""
    return rows.select(F.conv(F.substring(row_hash(rows), 1, 8), 16, 10).cast("long").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("checksum"))


def display_names(ids: DataFrame, names: DataFrame, ident: str) -> DataFrame:
    """The last non-empty name of each id, else the id in title case."""
    last = names.filter("name is not null and trim(name) <> ''").groupBy(ident).agg(F.max_by("name", "at").alias("name"))
    return ids.join(last, ident, "left").select(ident, F.coalesce("name", F.initcap(F.replace(F.col(ident), F.lit("_"), F.lit(" ")))).alias("name"))


def points_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """An ordered array of points per key; positions must be 1..n."""
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "points"))).alias("t"), F.max("place").alias("top"), F.count_distinct("place").alias("k"))
    return g.filter("top = size(t) and k = size(t)").select(*keys, F.transform("t", lambda x: x["points"]).alias("points"))
