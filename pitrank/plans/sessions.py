"""Queries over laps, stints, stops and weather."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitrank.operators import asof, history, laps
from pitrank.plans.pointintime import BOTH, EVENT, PRIOR, asked, facts
from pitrank.plans.registry import query

KEY = ["session", "user_id"]
CLEAN = """c AS (SELECT l.session, l.user_id, s.season, s.stint, s.compound, l.lap, l.duration, s.age_at_start + l.lap - s.lap_start AS age, median(l.duration) OVER (PARTITION BY l.session, l.user_id, s.stint) AS middle
FROM {laps} l JOIN {stints} s ON s.session = l.session AND s.user_id = l.user_id AND l.lap BETWEEN s.lap_start AND s.lap_end WHERE NOT l.out_lap AND NOT l.in_lap AND l.lap > s.lap_start),
k AS (SELECT * FROM c WHERE duration <= 1.05 * middle)"""


def usable():
    return ~F.col("out_lap") & ~F.col("in_lap")


@query("C17_lap_summary", """WITH g AS (SELECT *, min(duration) OVER (PARTITION BY session, user_id) AS best FROM {laps} WHERE NOT out_lap AND lap NOT IN (SELECT lap FROM {pits} p WHERE p.session = session AND p.user_id = user_id))
SELECT g.session, g.user_id, s.compound, count(*) AS laps, round(median(g.duration), 6) AS median, min(g.duration) AS fastest, median(CAST(s.age_at_start + g.lap - s.lap_start AS DOUBLE)) AS median_age FROM g JOIN {stints} s ON s.session = g.session AND s.user_id = g.user_id AND g.lap BETWEEN s.lap_start AND s.lap_end WHERE g.duration <= 1.07 * g.best GROUP BY g.session, g.user_id, s.compound""")
def _(t):
    driven = t("laps").join(t("pits").select(*KEY, "lap"), [*KEY, "lap"], "left_anti")
    return laps.lap_summary(driven, t("stints"), KEY, ~F.col("out_lap"))


@query("C18_lap_summary_second_source", """SELECT session, user_id, lap % 3 AS compound, count(*) AS laps, round(median(duration), 6) AS median, min(duration) AS fastest FROM {laps} WHERE NOT out_lap AND NOT in_lap AND user_id % 5 <> 0 GROUP BY ALL""")
def _(t):
    good = t("laps").filter(usable() & F.expr("user_id % 5 <> 0"))
    return good.groupBy(*KEY, F.expr("lap % 3").alias("compound")).agg(F.count("*").alias("laps"), F.round(F.median("duration"), 6).alias("median"), F.min("duration").alias("fastest"))


@query("C19_summary_checks", """WITH s AS (SELECT session, user_id, count(*) AS n, min(duration) AS best, median(duration) AS middle, min(lap) AS age FROM {laps} GROUP BY ALL) SELECT 'best_over_median' AS problem, count(*) FILTER (WHERE best > middle) AS n FROM s UNION ALL SELECT 'few_laps', count(*) FILTER (WHERE n < 30) FROM s UNION ALL SELECT 'negative_age', count(*) FILTER (WHERE age < 0) FROM s""")
def _(t):
    s = t("laps").groupBy(*KEY).agg(F.count("*").alias("n"), F.min("duration").alias("best"), F.median("duration").alias("middle"), F.min("lap").alias("age"))
    d = s.agg(F.count_if(F.expr("best > middle")).alias("best_over_median"), F.count_if(F.expr("n < 30")).alias("few_laps"), F.count_if(F.expr("age < 0")).alias("negative_age"))
    return d.unpivot([], ["best_over_median", "few_laps", "negative_age"], "problem", "n")


@query("C20_practice_aggregates", """WITH s AS (SELECT l.session, l.user_id, s.compound, min(l.duration) AS best, median(l.duration) AS middle, avg(s.age_at_start) AS age FROM {laps} l JOIN {stints} s ON s.session = l.session AND s.user_id = l.user_id AND l.lap BETWEEN s.lap_start AND s.lap_end GROUP BY ALL) SELECT session, user_id, min(best) AS best, round(avg(middle), 8) AS mean_median, round(avg(age), 6) AS mean_age, count(DISTINCT compound) AS compounds FROM s GROUP BY ALL""")
def _(t):
    j = laps.in_stint(t("laps"), t("stints"), KEY, ["compound", "age_at_start"])
    s = j.groupBy(*KEY, "compound").agg(F.min("duration").alias("best"), F.median("duration").alias("middle"), F.avg("age_at_start").alias("age"))
    return s.groupBy(*KEY).agg(F.min("best").alias("best"), F.round(F.avg("middle"), 8).alias("mean_median"), F.round(F.avg("age"), 6).alias("mean_age"), F.count_distinct("compound").alias("compounds"))


@query("C21_clean_laps", f"WITH {CLEAN} SELECT session, user_id, stint, lap, duration, age FROM k")
def _(t):
    return laps.clean_laps(t("laps"), t("stints"), KEY, usable()).select(*KEY, "stint", "lap", "duration", "age")


@query("C22_degradation", f"""WITH {CLEAN}, s AS (SELECT session, user_id, stint, compound, count(*) AS n, regr_slope(duration, CAST(age AS DOUBLE)) AS slope FROM k GROUP BY ALL HAVING count(*) >= 5),
m AS (SELECT session, compound, median(slope) AS middle FROM s GROUP BY ALL HAVING count(slope) >= 3) SELECT s.session, s.user_id, s.stint, s.compound, s.n, round(s.slope - m.middle, 6) AS relative FROM s JOIN m USING (session, compound)""")
def _(t):
    return laps.degradation(laps.clean_laps(t("laps"), t("stints"), KEY, usable()), KEY, ["session"], least=5)


@query("C23_typical_stop", """WITH n AS (SELECT session, median(lane) AS normal FROM (SELECT *, min(lane) OVER (PARTITION BY session) AS low FROM {pits}) WHERE lane <= 1.3 * low GROUP BY session)
SELECT session, user_id, round(avg(least(greatest(lane - normal, -5), 10)), 6) AS delta, count(*) AS stops FROM {pits} JOIN n USING (session) WHERE lane - normal <= 10 GROUP BY session, user_id""")
def _(t):
    return laps.typical_stop(t("pits"), ["session"], KEY, "lane", 1.3, 10.0, -5.0, 10.0)


@query("C24_wet_share", """SELECT session, user_id, round(sum(CASE WHEN compound = 'INTERMEDIATE' THEN lap_end - lap_start + 1 ELSE 0 END) / sum(lap_end - lap_start + 1), 6) AS wet_share, sum(CASE WHEN compound = 'INTERMEDIATE' THEN lap_end - lap_start + 1 ELSE 0 END) >= 0.2 * sum(lap_end - lap_start + 1) AS wet, count(*) - 1 AS stops FROM {stints} GROUP BY ALL""")
def _(t):
    n = F.expr("lap_end - lap_start + 1")
    share = F.sum(F.when(F.col("compound") == "INTERMEDIATE", n).otherwise(0)) / F.sum(n)
    return t("stints").groupBy(*KEY).agg(F.round(share, 6).alias("wet_share"), (share >= 0.2).alias("wet"), (F.count("*") - 1).alias("stops"))


@query("C25_station_weather", """SELECT date_part('day', valid_at) AS day, round(avg(CASE WHEN precipitation > 0.3 THEN 1.0 ELSE 0.0 END), 6) AS rain_share, round(median(temperature), 8) AS temperature, round(median(wind), 8) AS wind FROM {forecast} GROUP BY ALL""")
def _(t):
    f = t("forecast").groupBy(F.dayofmonth("valid_at").cast("long").alias("day"))
    return f.agg(F.round(F.avg(F.when(F.col("precipitation") > 0.3, 1.0).otherwise(0.0)), 6).alias("rain_share"), F.round(F.median("temperature"), 8).alias("temperature"), F.round(F.median("wind"), 8).alias("wind"))


@query("C26_long_runs", f"""WITH {CLEAN}, r AS (SELECT session, user_id, compound, median(duration) AS pace FROM k GROUP BY ALL HAVING count(*) >= 5), m AS (SELECT session, compound, median(pace) AS field FROM r GROUP BY ALL HAVING count(*) >= 3) SELECT session, user_id, round(avg(pace - field), 6) AS gap, count(*) AS compounds FROM r JOIN m USING (session, compound) GROUP BY ALL""")
def _(t):
    c = laps.clean_laps(t("laps"), t("stints"), KEY, usable())
    r = c.groupBy(*KEY, "compound").agg(F.median("duration").alias("pace"), F.count("*").alias("n")).filter("n >= 5")
    m = r.groupBy("session", "compound").agg(F.median("pace").alias("field"), F.count("*").alias("k")).filter("k >= 3")
    return r.join(m, ["session", "compound"]).groupBy(*KEY).agg(F.round(F.avg(F.col("pace") - F.col("field")), 6).alias("gap"), F.count("*").alias("compounds"))


@query("C27_strategy_features", f"""WITH {PRIOR}, k AS (SELECT *, row_number() OVER (PARTITION BY league, day, driver_id ORDER BY prior DESC) AS i FROM p WHERE label_position IS NOT NULL), q AS (SELECT *, row_number() OVER (PARTITION BY league, day, driver_id ORDER BY prior DESC) AS i FROM p WHERE label_dnf IS NOT NULL)
SELECT a.league, a.day, a.driver_id, a.m AS mean_finish, b.m AS mean_dnf FROM (SELECT league, day, driver_id, round(avg(label_position), 6) AS m FROM k WHERE i <= 10 GROUP BY ALL) a FULL JOIN (SELECT league, day, driver_id, round(avg(CAST(label_dnf AS INT)), 6) AS m FROM q WHERE i <= 10 GROUP BY ALL) b USING (league, day, driver_id)""".replace("SELECT a.league, a.day, a.driver_id, a.m", "SELECT league, day, driver_id, a.m"))
def _(t):
    def latest(value: str, name: str):
        d = history.known(facts(t).filter(F.col(value).isNotNull()), asked(t), ["league", "driver_id"], "label_available_at", "target_cutoff", latest={"h": (10, ["prior", value])})
        return d.filter(F.size("h") > 0).select(*EVENT, "driver_id", F.round(history.mean_of(F.col("h"), lambda x: x[value]), 6).alias(name))

    return latest("label_position", "mean_finish").join(latest("label_dnf", "mean_dnf"), [*EVENT, "driver_id"], "full")


@query("C28_forecast_run", "SELECT league, day, CAST(CASE WHEN date_part('hour', cutoff - INTERVAL 12 HOUR) >= 12 THEN date_trunc('day', cutoff - INTERVAL 12 HOUR) + INTERVAL 12 HOUR ELSE date_trunc('day', cutoff - INTERVAL 12 HOUR) END AS VARCHAR) AS run FROM {starts}")
def _(t):
    known = F.col("cutoff") - F.expr("INTERVAL 12 HOUR")
    run = F.date_trunc("day", known) + F.make_interval(hours=F.floor(F.hour(known) / 12).cast("int") * 12)
    return t("starts").select(*EVENT, run.cast("timestamp_ntz").cast("string").alias("run"))


@query("C29_race_weather", """SELECT s.league, s.day, CASE WHEN count(f.precipitation) FILTER (WHERE f.valid_at <= date_trunc('hour', s.cutoff)) = 6 THEN round(sum(f.precipitation) FILTER (WHERE f.valid_at <= date_trunc('hour', s.cutoff)), 6) END AS before, CASE WHEN count(f.precipitation) FILTER (WHERE f.valid_at > date_trunc('hour', s.cutoff)) = 2 THEN round(sum(f.precipitation) FILTER (WHERE f.valid_at > date_trunc('hour', s.cutoff)), 6) END AS during
FROM {starts} s LEFT JOIN {forecast} f ON f.valid_at > date_trunc('hour', s.cutoff) - INTERVAL 6 HOUR AND f.valid_at <= date_trunc('hour', s.cutoff) + INTERVAL 2 HOUR GROUP BY s.league, s.day""")
def _(t):
    args = (t("starts"), t("forecast"), EVENT, "cutoff", "valid_at", "precipitation")
    before = laps.complete_window(*args, 6, 0, "before")
    during = laps.complete_window(*args, 0, 2, "during")
    return before.join(during, EVENT)


@query("C30_wet_flag", """SELECT s.league, s.day, CASE WHEN count(f.precipitation) = 8 THEN round(sum(f.precipitation), 6) >= 2.5 END AS wet FROM {starts} s LEFT JOIN {forecast} f ON f.valid_at > date_trunc('hour', s.cutoff) - INTERVAL 6 HOUR AND f.valid_at <= date_trunc('hour', s.cutoff) + INTERVAL 2 HOUR GROUP BY s.league, s.day""")
def _(t):
    rain = laps.complete_window(t("starts"), t("forecast"), EVENT, "cutoff", "valid_at", "precipitation", 6, 2, "rain")
    return rain.select(*EVENT, (F.col("rain") >= 2.5).alias("wet"))


@query("C31_wet_skill", """WITH g AS (SELECT league, day, driver_id, qualifying_position - label_position AS gain, day % 3 = 0 AS wet FROM {results})
SELECT a.league, a.day, a.driver_id, round((avg(b.gain) FILTER (WHERE b.wet) - avg(b.gain) FILTER (WHERE NOT b.wet)) * count(b.day) FILTER (WHERE b.wet) / (count(b.day) FILTER (WHERE b.wet) + 5), 6) AS skill FROM g a LEFT JOIN g b ON a.league = b.league AND a.driver_id = b.driver_id AND b.day < a.day GROUP BY ALL""")
def _(t):
    g = t("results").select(*EVENT, "driver_id", F.expr("qualifying_position - label_position").alias("gain"), F.expr("day % 3 = 0").alias("wet"))
    return laps.wet_gain(g, ["league", "driver_id"], "day", "gain", "wet").select(*EVENT, "driver_id", "skill")


@query("C32_sprint_labels", """SELECT k, first <> 'dns' AND flags < 5 AS classified, CASE WHEN first = 'dns' THEN NULL WHEN first = 'finished' THEN false ELSE true END AS dnf FROM {statuses}""")
def _(t):
    text = F.when((F.col("first") != "dns") & (F.col("flags") < 5), F.col("flags").cast("string")).otherwise("NC")
    dnf = F.when(F.col("first").isin("dns", "dsq", "withdrew"), None).when(F.col("first").isin("finished", "lapped"), False).otherwise(True)
    return t("statuses").select("k", text.rlike("^[0-9]+$").alias("classified"), dnf.alias("dnf"))


@query("C33_positions_after_numeric", """SELECT league, day, driver_id, coalesce(label_position, coalesce(max(label_position) OVER (PARTITION BY league, day), 0) + row_number() OVER (PARTITION BY league, day, label_position IS NULL ORDER BY user_id)) AS place FROM {results}""")
def _(t):
    last = F.coalesce(F.max("label_position").over(Window.partitionBy(*EVENT)), F.lit(0))
    n = F.row_number().over(Window.partitionBy(*EVENT, F.col("label_position").isNull()).orderBy("user_id"))
    return t("results").select(*EVENT, "driver_id", F.coalesce("label_position", last + n).alias("place"))


@query("C34_wet_label_precedence", """SELECT s.league, s.day, coalesce(CASE WHEN s.day % 4 = 0 THEN s.day % 8 = 0 END, CASE WHEN s.day % 5 = 0 THEN true END, s.league % 2 = 0) AS wet FROM {starts} s""")
def _(t):
    s = t("starts")
    tyres = s.filter("day % 4 = 0").select(*EVENT, F.expr("day % 8 = 0").alias("tyres"))
    review = s.filter("day % 5 = 0").select(*EVENT, F.lit(True).alias("review"))
    return s.join(tyres, EVENT, "left").join(review, EVENT, "left").select(*EVENT, F.coalesce("tyres", "review", F.expr("league % 2 = 0")).alias("wet"))


@query("C35_retirement_prior", f"WITH {PRIOR} SELECT league, day, round((1 + sum(CAST(label_dnf AS INT))) / (2 + count(label_dnf)), 6) AS prior FROM p WHERE label_dnf_available_at < target_cutoff AND label_dnf IS NOT NULL GROUP BY ALL")
def _(t):
    f = facts(t).filter("label_dnf is not null")
    d = history.known(f, asked(t, None), ["league"], BOTH, "target_cutoff", {"out": F.col("label_dnf"), "judged": F.lit(1)})
    return d.filter("judged > 0").select(*EVENT, F.round((1 + F.col("out")) / (2 + F.col("judged")), 6).alias("prior"))


@query("C36_forecast_status", """WITH w AS (SELECT s.league, s.day, count(f.precipitation) AS n FROM {starts} s LEFT JOIN {forecast} f ON f.valid_at > date_trunc('hour', s.cutoff) - INTERVAL 6 HOUR AND f.valid_at <= date_trunc('hour', s.cutoff) + INTERVAL 2 HOUR GROUP BY s.league, s.day) SELECT CASE WHEN day <= 1 THEN 'before_archive' WHEN n = 8 THEN 'audited' ELSE 'incomplete' END AS status, count(*) AS events FROM w GROUP BY 1""")
def _(t):
    rain = laps.complete_window(t("starts"), t("forecast"), EVENT, "cutoff", "valid_at", "precipitation", 6, 2, "rain")
    status = F.when(F.col("day") <= 1, "before_archive").when(F.col("rain").isNotNull(), "audited").otherwise("incomplete")
    return rain.groupBy(status.alias("status")).agg(F.count("*").alias("events"))
