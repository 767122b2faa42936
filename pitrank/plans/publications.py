"""Queries of sources, normalisation and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitrank.operators.asof import known_by
from pitrank.plans.pointintime import EVENT
from pitrank.plans.registry import query
from pitrank.sources import normalise, store

TEXT = "yyyy-MM-dd"


def result_payloads(t):
    r = t("results")
    row = F.struct(
        F.struct(F.col("driver_id").alias("driverId")).alias("Driver"), F.struct(F.col("constructor_id").alias("constructorId")).alias("Constructor"),
        F.col("label_position").cast("string").alias("position"), F.coalesce(F.col("label_position").cast("string"), F.lit("R")).alias("positionText"),
        F.when(F.expr("user_id % 10 <> 0"), F.col("qualifying_position").cast("string")).otherwise("pit").alias("grid"), F.col("n").cast("string").alias("laps"), F.col("score").cast("string").alias("points"),
        F.when(F.col("retired"), "Retired").otherwise("Finished").alias("status"),
    )
    return r.groupBy(*EVENT).agg(F.to_json(F.struct(F.max("season").cast("string").alias("season"), F.max("round").cast("string").alias("round"), F.collect_list(row).alias("Results"))).alias("payload"))


@query("A01_discover_partitions", "SELECT DISTINCT season, round FROM {starts}")
def _(t):
    s = t("starts")
    folder = store.scratch(s.sparkSession, "partitions")
    s.select("league", "day", "season", "round").write.partitionBy("season", "round").parquet(folder)
    return store.discover(s.sparkSession, folder)


@query("A02_catalog_read", "SELECT part AS item, CASE WHEN part % 4 = 1 THEN 'mismatch' WHEN part % 4 = 2 THEN 'absent' WHEN part % 4 = 3 THEN 'outside' ELSE 'verified' END AS status FROM (SELECT DISTINCT league AS part FROM {starts})")
def _(t):
    s = t("starts")
    spark, folder = s.sparkSession, store.scratch(s.sparkSession, "catalog")
    s.groupBy("league").agg(F.to_json(F.array_sort(F.collect_list("day"))).alias("value")).withColumn("part", F.col("league")).select("value", "part").repartition("part").write.partitionBy("part").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    item = F.regexp_extract("path", "part=([0-9]+)/", 1).cast("long")
    path = F.regexp_extract("path", "(part=[0-9]+/.*)$", 1)
    c = files.select(item.alias("item"), F.when(item % 4 == 2, F.concat(path, F.lit("x"))).when(item % 4 == 3, F.concat(F.lit("../"), path)).otherwise(path).alias("path"), F.when(item % 4 == 1, "00").otherwise(F.sha2("content", 256)).alias("sha256"))
    return c.select("item", "path").join(store.catalog_read(spark, folder, c.select("path", "sha256")), "path").select("item", "status")


@query("A03_schedule", "SELECT league, season, round, 'Round ' || round AS name, circuit_id, CAST(cutoff AS VARCHAR) AS start FROM {starts} WHERE day % 13 <> 0 UNION ALL SELECT league, season, round, 'Round ' || round, circuit_id, NULL FROM {starts} WHERE day % 13 = 0")
def _(t):
    s = t("starts")
    race = F.struct(F.col("round").cast("string").alias("round"), F.concat(F.lit("Round "), "round").alias("raceName"), F.struct(F.col("circuit_id").alias("circuitId")).alias("Circuit"), F.date_format("cutoff", TEXT).alias("date"), F.when(F.expr("day % 13 <> 0"), F.date_format("cutoff", "HH:mm:ss'Z'")).alias("time"))
    p = s.groupBy("league", "season").agg(F.to_json(F.struct(F.max("season").cast("string").alias("season"), F.collect_list(race).alias("races"))).alias("payload"))
    return normalise.schedule(p, "season").withColumn("start", F.col("start").cast("string"))


@query("A04_weekend_sessions", """SELECT league, day, session, CAST(cutoff - INTERVAL 1 HOUR * back AS VARCHAR) AS start FROM {starts} CROSS JOIN (VALUES ('practice', 48), ('qualifying', 9), ('sprint_qualifying', 20), ('race', 0)) v(session, back) WHERE session <> 'sprint_qualifying' OR round % 4 = 0""")
def _(t):
    s = t("starts")
    at = lambda hours: F.struct(F.date_format(F.col("cutoff") - F.make_interval(hours=F.lit(hours)), TEXT).alias("date"), F.date_format(F.col("cutoff") - F.make_interval(hours=F.lit(hours)), "HH:mm:ss'Z'").alias("time"))
    p = s.select(*EVENT, F.to_json(F.struct(F.col("season").cast("string"), F.col("round").cast("string"), at(48).alias("FirstPractice"), at(9).alias("Qualifying"), F.when(F.expr("round % 4 = 0 and league % 2 = 0"), at(20)).alias("SprintQualifying"), F.when(F.expr("round % 4 = 0 and league % 2 = 1"), at(20)).alias("SprintShootout"), at(0)["date"].alias("date"), at(0)["time"].alias("time"))).alias("payload"))
    return normalise.weekend(p, EVENT).withColumn("start", F.col("start").cast("string"))


@query("A05_qualifying", "SELECT league, day, driver_id, constructor_id, qualifying_position AS position, round(60 + n, 6) AS q1, CASE WHEN qualifying_position <= 6 THEN round(60 + n / 2, 6) END AS q2, CASE WHEN qualifying_position <= 3 THEN CAST(59 AS DOUBLE) END AS q3 FROM (SELECT *, CAST(n % 50 AS DOUBLE) AS m FROM {results}) x".replace("60 + n,", "60 + m,").replace("60 + n / 2", "60 + m / 2"))
def _(t):
    r = t("results").withColumn("m", F.expr("n % 50"))
    lap = lambda seconds: F.concat(F.lit("1:"), F.lpad(F.format_string("%.3f", seconds), 6, "0"))
    row = F.struct(F.struct(F.col("driver_id").alias("driverId")).alias("Driver"), F.struct(F.col("constructor_id").alias("constructorId")).alias("Constructor"), F.col("qualifying_position").cast("string").alias("position"), lap(F.col("m").cast("double")).alias("Q1"), F.when(F.col("qualifying_position") <= 6, lap(F.col("m") / 2)).otherwise("").alias("Q2"), F.when(F.col("qualifying_position") <= 3, F.lit("59.000")).alias("Q3"))
    p = r.groupBy(*EVENT).agg(F.to_json(F.struct(F.collect_list(row).alias("QualifyingResults"))).alias("payload"))
    return normalise.qualifying(p, EVENT)


@query("A06_results", "SELECT league, day, driver_id, constructor_id, label_position AS position, coalesce(CAST(label_position AS VARCHAR), 'R') AS position_text, CASE WHEN user_id % 10 <> 0 THEN qualifying_position END AS grid, n AS laps, score AS points, CASE WHEN retired THEN 'Retired' ELSE 'Finished' END AS status FROM {results}")
def _(t):
    return normalise.results(result_payloads(t), EVENT)


@query("A07_lap_seconds", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN round(60 + p_size * 1.0, 6) WHEN 1 THEN CAST(p_size AS DOUBLE) END AS seconds, p_partkey % 4 = 2 AS bad FROM {part}")
def _(t):
    size = F.lpad(F.col("p_size").cast("string"), 2, "0")
    text = F.expr("case p_partkey % 4 when 0 then concat('1:', lpad(p_size, 2, '0'), '.000') when 1 then lpad(p_size, 2, '0') when 2 then concat('x', p_size) else '' end")
    d = t("part").withColumn("size", size).withColumn("text", text)
    seconds, bad = normalise.lap_seconds(F.col("text"))
    return d.select("p_partkey", F.round(seconds, 6).alias("seconds"), bad.alias("bad"))


@query("A08_strict_casts", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) END AS whole, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 4 < 2 THEN CAST(p_size AS BIGINT) END AS place, p_partkey % 4 = 3 AS bad FROM {part}")
def _(t):
    d = t("part").withColumns({"a": F.expr("case when p_partkey % 3 = 0 then cast(p_size as string) else concat('+', p_size) end"), "b": F.expr("cast(case when p_partkey % 5 = 0 then -p_retailprice else p_retailprice end as string)"), "c": F.expr("case p_partkey % 4 when 0 then cast(p_size as string) when 1 then concat(p_size, 'F') when 2 then 'NC' else 'P1' end")})
    place, bad = normalise.place(F.col("c"))
    return d.select("p_partkey", normalise.strict_int(F.col("a")).alias("whole"), normalise.strict_float(F.col("b")).alias("price"), place.alias("place"), bad.alias("bad"))


@query("A09_merge_entries", "SELECT league, day, driver_id, CASE WHEN user_id % 6 = 0 THEN 'other' WHEN user_id % 7 = 1 AND user_id % 5 = 0 THEN NULL ELSE constructor_id END AS constructor_id, user_id % 6 = 0 AND user_id % 5 <> 0 AS conflict FROM {results}")
def _(t):
    r, key = t("results"), [*EVENT, "driver_id"]
    first = r.filter("user_id % 7 <> 1 or user_id % 6 = 0").select(*key, F.expr("case when user_id % 6 = 0 then 'other' else constructor_id end").alias("constructor_id"))
    second = r.select(*key, F.expr("case when user_id % 5 <> 0 then constructor_id end").alias("constructor_id"))
    second = second.filter("constructor_id is not null").union(r.filter("user_id % 5 = 0").select(*key, F.lit(None).cast("string")))
    return normalise.entries(first, second, key, "constructor_id")


@query("A10_hourly_arrays", "SELECT CAST(day(valid_at) AS BIGINT) AS day, CAST(valid_at AS VARCHAR) AS hour, precipitation, temperature FROM {forecast} WHERE day(valid_at) % 5 <> 0")
def _(t):
    f = t("forecast").withColumn("day", F.dayofmonth("valid_at").cast("long"))
    sorted_ = F.array_sort(F.collect_list(F.struct("valid_at", "precipitation", "temperature")))
    p = f.groupBy("day").agg(sorted_.alias("s")).select("day", F.col("s.valid_at").alias("hours"), F.expr("case when day % 5 = 0 then slice(s.precipitation, 1, 3) else s.precipitation end").alias("precipitation"), F.col("s.temperature").alias("temperature"))
    return normalise.parallel_hours(p, ["day"], "hours", ["precipitation", "temperature"]).withColumn("hour", F.col("hour").cast("string"))


@query("A11_registry_rows", """SELECT page_id, i AS link_no, regexp_extract(a, 'href="([^"]*)"', 1) AS link, regexp_extract(a, '>([^<]*)<', 1) AS title FROM (SELECT page_id, unnest(x) AS a, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS x FROM {pages}))""")
def _(t):
    return normalise.documents(t("pages"), "html", "page_id")


@query("A12_publication_clock", "SELECT league, day, CAST(cutoff - INTERVAL 1 HOUR + INTERVAL 1 MINUTE AS VARCHAR) AS bound, true AS winter FROM {starts}")
def _(t):
    bound, winter = normalise.publication_clock(F.col("cutoff"))
    return t("starts").select(*EVENT, bound.cast("string").alias("bound"), winter.alias("winter"))


@query("A13_session_match", "SELECT a.league, a.day, count(b.day) AS matches, CASE WHEN count(b.day) = 1 THEN max(b.day) END AS session FROM {starts} a LEFT JOIN {starts} b ON a.league = b.league AND abs(epoch(b.cutoff) + b.day % 5 * 3000 - epoch(a.cutoff)) <= 10800 GROUP BY a.league, a.day")
def _(t):
    s = t("starts").select("league", "day", "cutoff")
    sessions = s.select("league", F.col("day").alias("session"), (F.col("cutoff") + F.make_interval(secs=(F.col("day") % 5 * 3000).cast("decimal(18,6)"))).alias("at"))
    return normalise.session_match(s, sessions, ["league"], "cutoff", "at", "session").drop("cutoff")


@query("A14_number_crosswalk", "SELECT league, day, n % 20 AS number, CASE WHEN count(DISTINCT driver_id) = 1 THEN min(driver_id) END AS driver_id, count(DISTINCT driver_id) > 1 AS conflict FROM {results} GROUP BY league, day, n % 20")
def _(t):
    return normalise.crosswalk(t("results").withColumn("number", F.expr("n % 20")), ["league", "day"], "number", "driver_id")


@query("A15_code_crosswalk", "SELECT s_nationkey AS code, CASE WHEN count(*) = 1 THEN min(s_name) END AS name, count(*) > 1 AS conflict FROM {supplier} GROUP BY s_nationkey")
def _(t):
    d = t("supplier").select(F.col("s_nationkey").alias("code"), F.col("s_name").alias("name"))
    return normalise.crosswalk(d, [], "code", "name")


@query("A16_name_map", "SELECT 'Sup ' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'alias_' ELSE 'x_' END || s_suppkey AS ident FROM {supplier} WHERE s_suppkey % 7 <> 5 OR s_suppkey % 3 = 0")
def _(t):
    s = t("supplier").select("s_suppkey")
    names = s.select(F.concat(F.lit("Sup "), "s_suppkey").alias("name"))
    aliases = s.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("Sup "), "s_suppkey").alias("name"), F.concat(F.lit("alias_"), "s_suppkey").alias("ident"))
    roster = s.select(F.concat(F.lit("x_"), "s_suppkey").alias("ident")).union(s.filter("s_suppkey % 7 = 5").select(F.concat(F.lit("y_"), "s_suppkey")))
    return normalise.name_map(names, aliases, roster)


@query("A18_write_changed", "SELECT season, round FROM {starts} WHERE season = 2025 GROUP BY season, round")
def _(t):
    s = t("starts").select("league", "day", "season", "round", "entrants")
    folder = store.scratch(s.sparkSession, "changed")
    store.write_changed(s, folder, ["season", "round"], 1)
    second = s.withColumn("entrants", F.expr("entrants + case when season = 2025 then 1 else 0 end"))
    return store.write_changed(second, folder, ["season", "round"], 1).select("season", "round")


@query("A19_version_store", "SELECT user_id % 50 AS k, count(DISTINCT props) AS versions FROM {events} GROUP BY 1")
def _(t):
    e = t("events").select(F.expr("user_id % 50").alias("k"), "props", "event_id")
    first = store.append_versions(None, e.filter("event_id % 2 = 0"), ["k"], "props", "event_id")
    more = store.append_versions(first, e, ["k"], "props", "event_id")
    return first.unionByName(more).groupBy("k").agg(F.count("*").alias("versions"))


@query("A20_season_ingest", "SELECT season, count(*) AS written, CAST(sum(entrants) AS BIGINT) AS n, CAST(0 AS BIGINT) AS skipped FROM {starts} GROUP BY season")
def _(t):
    s = t("starts").select("league", "day", "season", "round", "entrants")
    folder = store.scratch(s.sparkSession, "ingest")
    keys = ["season", "round", "league"]
    done = store.write_changed(s, folder, keys, 2, ["season", "round"])
    left = s.select(*keys).join(done, keys, "left_anti").groupBy("season").agg(F.count("*").alias("skipped"))
    rows = s.sparkSession.read.parquet(f"{folder}/rows").groupBy(F.col("season").cast("long").alias("season")).agg(F.count("*").alias("written"), F.sum("entrants").alias("n"))
    return rows.join(left, "season", "left").na.fill(0, ["skipped"])


@query("A21_table_hash", """SELECT count(*) AS n, CAST(sum(('0x' || substr(md5('{{"c_acctbal":' || c || ',"c_custkey":' || c_custkey || '}}'), 1, 8))::BIGINT) AS BIGINT) AS checksum FROM (SELECT CAST(round(c_acctbal) AS BIGINT) AS c, c_custkey FROM {customer})""".replace("{{", "{").replace("}}", "}"))
def _(t):
    return normalise.table_hash(t("customer").select(F.round("c_acctbal").cast("long").alias("c_acctbal"), "c_custkey"))


@query("A22_export_documents", """SELECT league, season, md5('{"league":' || league || ',"season":' || season || ',"rounds":[' || string_agg('{"round":' || round || ',"entrants":' || entrants || '}', ',' ORDER BY round) || ']}') AS digest FROM {starts} GROUP BY league, season""")
def _(t):
    return store.export(t("starts"), ["league", "season"], "round", ["entrants"], "rounds").select("league", "season", F.md5("document").alias("digest"))


@query("A23_display_names", "SELECT 'nation_' || n_nationkey AS ident, CASE WHEN n_nationkey % 3 = 0 THEN 'Nation ' || n_nationkey ELSE n_name || '!' END AS name FROM {nation}")
def _(t):
    n = t("nation").select(F.concat(F.lit("nation_"), "n_nationkey").alias("ident"), "n_nationkey", "n_name")
    names = n.filter("n_nationkey % 3 <> 0").select("ident", F.concat("n_name", F.lit("!")).alias("name"), F.lit(2).alias("at")).union(n.select("ident", F.lit(""), F.lit(3))).union(n.filter("n_nationkey % 3 <> 0").select("ident", F.lit("old"), F.lit(1)))
    return normalise.display_names(n.select("ident"), names, "ident")


@query("A25_points_arrays", "SELECT league, season, string_agg(CAST(CAST(points AS BIGINT) AS VARCHAR), ',' ORDER BY place) AS points FROM (SELECT league, season, position AS place, max(points) AS points FROM {points} WHERE version = 1 AND position IS NOT NULL GROUP BY ALL) GROUP BY league, season HAVING max(place) = count(*)")
def _(t):
    """The schedule that the awards of a league's season imply."""
    awarded = t("points").filter("version = 1 and position is not null").groupBy("league", "season", F.col("position").alias("place")).agg(F.max("points").alias("points"))
    d = normalise.points_table(awarded, ["league", "season"])
    return d.select("league", "season", F.array_join(F.transform("points", lambda x: x.cast("long").cast("string")), ",").alias("points"))


@query("A24_session_enrichment", "SELECT r.league, r.day, count(*) AS kept, CAST(max(available_at) AS VARCHAR) AS available_at FROM {sessions} s JOIN {results} r USING (league, day, driver_id) WHERE r.user_id % 9 <> 0 AND s.available_at <= s.cutoff GROUP BY r.league, r.day")
def _(t):
    mapped = t("results").filter("user_id % 9 <> 0").select(*EVENT, "driver_id")
    s = t("sessions").filter(known_by("available_at", "cutoff")).join(mapped, [*EVENT, "driver_id"])
    return s.groupBy(*EVENT).agg(F.count("*").alias("kept"), F.max("available_at").cast("string").alias("available_at"))
