"""Queries of the as-of and form operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitrank.operators import asof, form, history
from pitrank.plans.fixtures import Tables
from pitrank.plans.registry import query

EVENT = ["league", "day"]


def facts(t: Tables) -> DataFrame:
    """Entrant rows of all events with the clock at which their event's labels are known."""
    r = t("results").select(*EVENT, F.col("day").alias("prior"), "driver_id", "constructor_id", "circuit_id", "label_position", F.col("label_dnf").cast("int").alias("label_dnf"), "label_dnf_available_at", "qualifying_position")
    both = F.when(F.col("label_dnf_available_at").isNotNull(), F.greatest("label_available_at", "label_dnf_available_at"))
    return r.join(t("starts").select(*EVENT, "label_available_at"), EVENT).withColumn("both_at", both)


def asked(t: Tables, who: str | None = "driver_id", events: DataFrame | None = None) -> DataFrame:
    """Every event as a target, for everyone (or every team) of its league."""
    e = (t("starts") if events is None else events).select(*EVENT, F.col("cutoff").alias("target_cutoff"), F.col("circuit_id").alias("target_circuit"))
    return e if who is None else e.join(t("results").select("league", who).distinct(), "league")


BOTH = "both_at"  #: clock at which both the event's labels and the row's own are known


def running(t: Tables, targets: DataFrame | None = None) -> DataFrame:
    """Targets with sums over what was known of each entrant: rows, places, retirements, qualifying, and places at the
    target's venue. Targets without any known row are left out."""
    f, who = facts(t), ["league", "driver_id"]
    d = asked(t) if targets is None else targets
    place = F.col("label_position")
    d = history.known(f, d, who, "label_available_at", "target_cutoff", {"rows": F.lit(1), "places": place, "finishes": place.isNotNull().cast("int"), "grids": F.col("qualifying_position"), "all_out": F.col("label_dnf"), "all_judged": F.col("label_dnf").isNotNull().cast("int")})
    d = history.known(f.filter("label_dnf is not null"), d, who, BOTH, "target_cutoff", {"out": F.col("label_dnf"), "judged": F.lit(1)})
    f = f.withColumnRenamed("circuit_id", "target_circuit")
    d = history.known(f, d, [*who, "target_circuit"], "label_available_at", "target_cutoff", {"here": F.lit(1), "venue_places": place, "venue_finishes": place.isNotNull().cast("int")})
    return d.filter("rows > 0")


PRIOR = """p AS (SELECT t.league, t.day, t.cutoff AS target_cutoff, t.circuit_id AS target_circuit, e.circuit_id, e.day AS prior, r.driver_id, r.constructor_id, r.label_position, r.label_dnf, r.label_dnf_available_at, r.qualifying_position
FROM {starts} t JOIN {starts} e ON e.league = t.league AND e.day < t.day AND e.label_available_at < t.cutoff JOIN {results} r ON r.league = e.league AND r.day = e.day)"""


@query("B01_known_by", "SELECT league, day, driver_id, version, available_at <= cutoff AS known, available_at < cutoff AS known_strict FROM {publications}")
def _(t):
    return t("publications").select(*EVENT, "driver_id", "version", asof.known_by("available_at", "cutoff").alias("known"), asof.known_by("available_at", "cutoff", True).alias("known_strict"))


@query("B02_asof_latest", "SELECT league, day, driver_id, version, position, false AS ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY league, day, driver_id ORDER BY available_at DESC) AS k FROM {publications} WHERE available_at <= cutoff) WHERE k = 1")
def _(t):
    out = asof.latest(t("publications"), [*EVENT, "driver_id"], "available_at", ["version", "position"], "cutoff")
    return out.select(*EVENT, "driver_id", "version", "position", "ambiguous")


@query("B02_ambiguous_versions", """SELECT league, day, count(*) > 1 AS ambiguous, CASE WHEN count(*) = 1 THEN max(position) END AS position FROM (SELECT DISTINCT league, day, driver_id, position, rank() OVER (PARTITION BY league, day ORDER BY available_at DESC) AS k FROM {publications} WHERE available_at <= cutoff AND position <= 2) WHERE k = 1 GROUP BY league, day""")
def _(t):
    out = asof.latest(t("publications").filter("position <= 2"), EVENT, "available_at", ["driver_id", "position"], "cutoff")
    return out.select(*EVENT, "ambiguous", "position")


@query("B03_asof_history", """SELECT t.league, t.day, e.day AS prior, max(p.version) AS version, count(DISTINCT p.driver_id) AS entrants FROM {starts} t JOIN {starts} e ON e.league = t.league AND e.day < t.day AND e.label_available_at < t.cutoff
JOIN {publications} p ON p.league = e.league AND p.day = e.day AND p.available_at <= t.cutoff GROUP BY t.league, t.day, e.day""")
def _(t):
    pairs = asof.earlier_events(t("starts"), t("starts"), ["league"], "day", "cutoff", "label_available_at", [])
    versions = t("publications").groupBy("league", F.col("day").alias("prior"), "version", "available_at").agg(F.countDistinct("driver_id").alias("entrants"))
    known = pairs.join(versions, ["league", "prior"]).filter("available_at <= target_cutoff")
    return asof.latest(known, ["league", "day", "prior"], "available_at", ["version", "entrants"]).select("league", "day", "prior", "version", "entrants")


@query("B05_two_clocks", """SELECT league, day, driver_id, version, position FROM (SELECT *, row_number() OVER (PARTITION BY league, day, driver_id ORDER BY available_at DESC, captured_at DESC) AS k FROM {publications} WHERE captured_at <= cutoff - INTERVAL 90 MINUTE AND available_at <= cutoff) WHERE k = 1""")
def _(t):
    p = t("publications").withColumn("clock", F.expr("cutoff - INTERVAL 90 MINUTE"))
    return asof.two_clocks(p, [*EVENT, "driver_id"], ["version", "position"], "captured_at", "clock", "available_at", "cutoff").select(*EVENT, "driver_id", "version", "position")


@query("B06_recalled_after_ranking", """SELECT league, day, driver_id, version, position FROM (SELECT *, row_number() OVER (PARTITION BY league, day, driver_id ORDER BY available_at DESC, version DESC) AS k FROM {publications} WHERE available_at <= cutoff) WHERE k = 1 AND NOT recalled""")
def _(t):
    known = t("publications").filter(asof.known_by("available_at", "cutoff"))
    return asof.not_recalled(known, [*EVENT, "driver_id"], ["available_at", "version"]).select(*EVENT, "driver_id", "version", "position")


@query("B07_final_covers_later", """WITH f AS (SELECT event, max(clock) AS final_clock FROM {registry} WHERE link_no = 1 GROUP BY event)
SELECT f.event, f.final_clock, count(r.page_id) AS blocking, CASE WHEN count(r.page_id) > 0 THEN 'later_document_unreviewed' END AS reason FROM f LEFT JOIN {registry} r ON r.event = f.event AND r.clock > f.final_clock AND NOT r.recalled AND r.page_id % 3 <> 0 GROUP BY f.event, f.final_clock""")
def _(t):
    r = t("registry")
    final = r.filter("link_no = 1").groupBy("event").agg(F.max("clock").alias("final_clock"))
    reviewed = r.filter("page_id % 3 = 0").select("page_id", "link_no")
    later = r.filter("not recalled").join(reviewed, ["page_id", "link_no"], "left_anti").join(final, "event").filter("clock > final_clock").groupBy("event").agg(F.count("*").alias("blocking"))
    return final.join(later, "event", "left").select("event", "final_clock", F.coalesce("blocking", F.lit(0)).alias("blocking"), F.when(F.col("blocking") > 0, "later_document_unreviewed").alias("reason"))


@query("B08_first_and_last_documents", """SELECT event, min(clock) FILTER (WHERE link_no = 2) AS first_grid, max(clock) FILTER (WHERE link_no = 1) AS last_final,
CASE WHEN min(clock) FILTER (WHERE link_no = 2) IS NULL THEN 'grid_absent' WHEN max(clock) FILTER (WHERE link_no = 1) IS NULL THEN 'final_absent' WHEN min(clock) FILTER (WHERE link_no = 2) >= max(clock) FILTER (WHERE link_no = 1) THEN 'out_of_order' END AS reason FROM {registry} GROUP BY event""")
def _(t):
    d = t("registry").groupBy("event").agg(F.min(F.when(F.col("link_no") == 2, F.col("clock"))).alias("first_grid"), F.max(F.when(F.col("link_no") == 1, F.col("clock"))).alias("last_final"))
    reason = F.when(F.col("first_grid").isNull(), "grid_absent").when(F.col("last_final").isNull(), "final_absent").when(F.col("first_grid") >= F.col("last_final"), "out_of_order")
    return d.withColumn("reason", reason)


@query("B09_derived_cutoff", """SELECT league, day, CAST(greatest(max(cutoff) - INTERVAL 9 HOUR, min(available_at) + INTERVAL 1 MINUTE) AS VARCHAR) AS derived, greatest(max(cutoff) - INTERVAL 9 HOUR, min(available_at) + INTERVAL 1 MINUTE) >= max(cutoff) AS excluded FROM {publications} GROUP BY league, day""")
def _(t):
    d = t("publications").groupBy(*EVENT).agg(F.greatest(F.max("cutoff") - F.expr("INTERVAL 9 HOUR"), F.min("available_at") + F.expr("INTERVAL 1 MINUTE")).alias("at"), F.max("cutoff").alias("start"))
    return d.select(*EVENT, F.col("at").cast("string").alias("derived"), (F.col("at") >= F.col("start")).alias("excluded"))


@query("B10_cutoff_placement", """SELECT league, day, contract, CAST(CASE contract WHEN 'weekend' THEN cutoff - INTERVAL 48 HOUR WHEN 'qualifying' THEN cutoff - INTERVAL 9 HOUR ELSE cutoff - INTERVAL 1 HOUR END AS VARCHAR) AS placed FROM {starts} CROSS JOIN (SELECT unnest(['weekend', 'qualifying', 'grid']) AS contract) c""")
def _(t):
    contracts = t("starts").sparkSession.createDataFrame([("weekend", 48), ("qualifying", 9), ("grid", 1)], "contract string, hours int")
    d = t("starts").crossJoin(F.broadcast(contracts))
    return d.select(*EVENT, "contract", (F.col("cutoff") - F.make_interval(hours=F.col("hours"))).cast("string").alias("placed"))


@query("B11_cutoff_validity", """SELECT league, day, driver_id, version, available_at >= cutoff - INTERVAL 8 HOUR AND available_at < cutoff AS valid, available_at < cutoff AND available_at >= cutoff - INTERVAL 120 MINUTE AS pre_race FROM {publications}""")
def _(t):
    at, start = F.col("available_at"), F.col("cutoff")
    back = lambda x: start - F.expr(f"INTERVAL {x}")
    return t("publications").select(*EVENT, "driver_id", "version", ((at >= back("8 HOUR")) & (at < start)).alias("valid"), ((at < start) & (at >= back("120 MINUTE"))).alias("pre_race"))


@query("B12_value_clock_gate", """SELECT league, day, driver_id, version, CASE WHEN available_at <= cutoff THEN position END AS position, CASE WHEN available_at > cutoff THEN 'published_after_cutoff' END AS position_reason, CAST(least(available_at, cutoff) AS VARCHAR) AS feature_timestamp FROM {publications}""")
def _(t):
    p = t("publications")
    return p.select(*EVENT, "driver_id", "version", *asof.gated("position", "available_at", "cutoff"), F.least("available_at", "cutoff").cast("string").alias("feature_timestamp"))


@query("B13_provider_arbitration", """SELECT league, day, 'a' AS provider, coalesce(max((b - a) / a), 0) > 0.02 AS disagrees FROM (SELECT league, day, driver_id, max(best) FILTER (WHERE provider = 'a') AS a, max(best) FILTER (WHERE provider = 'b') AS b FROM {sessions} WHERE available_at <= cutoff GROUP BY ALL) GROUP BY league, day""")
def _(t):
    return asof.arbitrated(t("sessions"), EVENT, "driver_id", "provider", "tier", "available_at", "cutoff", "best")


@query("B14_certified_only", """SELECT s.league, s.day, s.driver_id, s.provider FROM {sessions} s WHERE s.provider = 'b' AND s.tier <= 2 AND (s.league, s.day) NOT IN (SELECT (league, day) FROM {sessions} GROUP BY league, day, driver_id HAVING max(best) / min(best) - 1 > 0.02)""")
def _(t):
    flags = asof.arbitrated(t("sessions"), EVENT, "driver_id", "provider", "tier", "available_at", "cutoff", "best")
    return asof.certified_only(t("sessions"), EVENT, "tier", "available_at", "cutoff", 2, flags).select(*EVENT, "driver_id", "provider")


@query("B15_forecast_hour", """SELECT s.league, s.day, count(f.valid_at) AS candidates, max(f.precipitation) AS precipitation, max(f.temperature) AS temperature FROM {starts} s LEFT JOIN {forecast} f ON f.valid_at <= s.cutoff AND s.cutoff < f.valid_at + INTERVAL 1 HOUR GROUP BY s.league, s.day""")
def _(t):
    return asof.in_hour(t("starts"), t("forecast"), "cutoff", "valid_at", EVENT, ["precipitation", "temperature"]).select(*EVENT, "candidates", "precipitation", "temperature")


@query("B16_snapshot", """WITH q AS (SELECT league, day, driver_id, max_by(position, available_at) AS position FROM {publications} WHERE available_at <= cutoff GROUP BY ALL),
s AS (SELECT league, day, driver_id, min(best) AS best FROM {sessions} WHERE available_at <= cutoff AND provider = 'a' GROUP BY ALL), f AS (SELECT valid_at, precipitation FROM {forecast}),
h AS (SELECT t.league, t.day, r.driver_id, count(*) AS n, round(avg(r.label_position), 6) AS m FROM {starts} t JOIN {starts} e ON e.league = t.league AND e.day < t.day AND e.label_available_at < t.cutoff JOIN {results} r ON r.league = e.league AND r.day = e.day GROUP BY ALL)
SELECT r.league, r.day, r.driver_id, q.position, round(s.best, 6) AS best, h.m AS history_mean, coalesce(h.n, 0) AS history_count, f.precipitation, h.m IS NULL AS history_mean_missing, f.precipitation IS NULL AS precipitation_missing
FROM {results} r LEFT JOIN q USING (league, day, driver_id) LEFT JOIN s USING (league, day, driver_id) LEFT JOIN h USING (league, day, driver_id) LEFT JOIN f ON f.valid_at = date_trunc('hour', r.cutoff)""")
def _(t):
    key = [*EVENT, "driver_id"]
    q = asof.latest(t("publications"), key, "available_at", ["position"], "cutoff").select(*key, "position")
    s = t("sessions").filter(asof.known_by("available_at", "cutoff") & (F.col("provider") == "a")).groupBy(*key).agg(F.round(F.min("best"), 6).alias("best"))
    h = running(t).select(*key, F.col("rows").alias("n"), F.round(history.mean("places", "finishes"), 6).alias("history_mean"))
    f = asof.in_hour(t("starts"), t("forecast"), "cutoff", "valid_at", EVENT, ["precipitation"])
    d = t("results").select(*key).join(q, key, "left").join(s, key, "left").join(h, key, "left").join(f, EVENT, "left")
    d = d.select(*key, "position", "best", "history_mean", F.coalesce("n", F.lit(0)).alias("history_count"), "precipitation")
    return d.withColumns({f"{c}_missing": F.col(c).isNull() for c in ("history_mean", "precipitation")})


@query("B17_last_non_null", """SELECT league, day, driver_id, coalesce(CASE WHEN qualifying_position <= 3 THEN score END, CASE WHEN qualifying_position <= 6 THEN score + 1 END, CASE WHEN retired THEN NULL ELSE score + 2 END) AS seconds, CASE WHEN user_id % 10 = 0 THEN NULL ELSE qualifying_position END AS grid FROM {results}""")
def _(t):
    c = F.expr
    chain = F.coalesce(c("case when qualifying_position <= 3 then score end"), c("case when qualifying_position <= 6 then score + 1 end"), c("case when not retired then score + 2 end"))
    return t("results").select(*EVENT, "driver_id", chain.alias("seconds"), F.when(c("user_id % 10 <> 0"), F.col("qualifying_position")).alias("grid"))


@query("B18_missing_flags", "SELECT league, day, driver_id, label_position IS NULL AS label_position_missing, label_dnf IS NULL AS label_dnf_missing, label_position AS finish FROM {results}")
def _(t):
    d = t("results").select(*EVENT, "driver_id", "label_position", "label_dnf", F.col("label_position").alias("finish"))
    return d.withColumns({f"{c}_missing": F.col(c).isNull() for c in ("label_position", "label_dnf")}).drop("label_position", "label_dnf")


@query("B22_lagged_cutoffs", "SELECT a.league, a.season, a.day AS cutoff_event, b.day AS target_event, b.day - a.day AS lag FROM {starts} a JOIN {starts} b ON a.league = b.league AND a.season = b.season AND b.day - a.day BETWEEN 0 AND 8")
def _(t):
    return asof.lagged(t("starts"), ["league", "season"], "day", 8)


@query("B22_lagged_features", f"""WITH {PRIOR}, k AS (SELECT a.league, a.day AS cutoff_event, b.day AS target_event FROM {{starts}} a JOIN {{starts}} b ON a.league = b.league AND a.season = b.season AND b.day - a.day BETWEEN 0 AND 8),
f AS (SELECT league, day, driver_id, round(avg(label_position), 6) AS form, count(label_position) AS known, round(avg(CAST(label_dnf AS INT)), 6) AS dnf_rate FROM p GROUP BY ALL)
SELECT k.league, k.cutoff_event, k.target_event, r.driver_id, f.form, f.dnf_rate, coalesce(f.known, 0) AS known FROM k JOIN {{results}} r ON r.league = k.league AND r.day = k.target_event LEFT JOIN f ON f.league = k.league AND f.day = k.cutoff_event AND f.driver_id = r.driver_id""")
def _(t):
    """History features of each target's roster as of the earlier cutoff event: never as of the target's own."""
    pairs = asof.lagged(t("starts"), ["league", "season"], "day", 8).select("league", "cutoff_event", "target_event")
    f = running(t).select("league", F.col("day").alias("cutoff_event"), "driver_id", F.round(history.mean("places", "finishes"), 6).alias("form"), F.col("finishes").alias("known"), F.round(history.mean("all_out", "all_judged"), 6).alias("dnf_rate"))
    roster = t("results").select("league", F.col("day").alias("target_event"), "driver_id")
    d = pairs.join(roster, ["league", "target_event"]).join(f, ["league", "cutoff_event", "driver_id"], "left")
    return d.select("league", "cutoff_event", "target_event", "driver_id", "form", "dnf_rate", F.coalesce("known", F.lit(0)).alias("known"))


@query("B24_label_merge", "SELECT r.league, r.day, r.driver_id, CASE WHEN r.label_dnf_available_at <= r.cutoff + INTERVAL 30 HOUR THEN r.label_dnf END AS label_dnf FROM {results} r")
def _(t):
    r = t("results")
    labels = r.filter("label_dnf_available_at <= cutoff + INTERVAL 30 HOUR").select(*EVENT, "driver_id", "label_dnf")
    return r.select(*EVENT, "driver_id").join(labels, [*EVENT, "driver_id"], "left")


@query("B27_provenance", """SELECT s.league, s.day, string_agg(CAST(p.day AS VARCHAR), ',' ORDER BY p.round) AS proof FROM {starts} s JOIN {starts} p ON p.league = s.league AND p.season = s.season AND p.round < s.round
WHERE (SELECT count(*) FROM {starts} q WHERE q.league = p.league AND q.season = p.season AND q.round <= p.round AND q.label_available_at < s.cutoff) = p.round AND p.label_available_at < s.cutoff GROUP BY s.league, s.day""")
def _(t):
    pairs = asof.earlier_events(t("starts"), t("starts"), ["league", "season"], "day", "cutoff", "label_available_at", ["round"])
    return asof.provenance(pairs.select("league", "day", "round", "prior"), EVENT, "round", "prior").filter("proof <> ''")


for _w in (3, 5, 10):
    _name = "C01_contiguous_windows" if _w == 3 else f"C01_contiguous_windows_{_w}"

    @query(_name, f"""WITH g AS (SELECT t.league, t.day, t.season, t.round, t.cutoff, count(e.day) = {_w} AND max(e.label_available_at) < t.cutoff AS complete FROM {{starts}} t LEFT JOIN {{starts}} e ON e.league = t.league AND e.season = t.season AND e.round BETWEEN t.round - {_w} AND t.round - 1 GROUP BY t.league, t.day, t.season, t.round, t.cutoff)
SELECT r.league, r.season, r.driver_id, r.round, coalesce(g.complete, false) AS complete, CASE WHEN g.complete THEN round(avg(h.label_position), 6) END AS finish_mean,
  CASE WHEN g.complete AND count(h.driver_id) > 0 AND count(h.driver_id) = count(h.label_dnf) THEN round(avg(CAST(h.label_dnf AS INT)), 6) END AS dnf_rate, CASE WHEN g.complete THEN count(h.driver_id) ELSE 0 END AS history_count
FROM {{results}} r JOIN g USING (league, day) LEFT JOIN {{results}} h ON h.league = r.league AND h.season = r.season AND h.driver_id = r.driver_id AND h.round BETWEEN r.round - {_w} AND r.round - 1 GROUP BY r.league, r.season, r.driver_id, r.round, g.complete""")
    def _(t, w=_w):
        return form.contiguous_window(t("results"), t("starts"), ["league", "season"], "driver_id", "round", "cutoff", "label_available_at", w)


@query("C02_team_window", """WITH g AS (SELECT t.league, t.season, t.round FROM {starts} t JOIN {starts} e ON e.league = t.league AND e.season = t.season AND e.round BETWEEN t.round - 3 AND t.round - 1 GROUP BY t.league, t.season, t.round, t.cutoff HAVING count(*) = 3 AND max(e.label_available_at) < t.cutoff),
k AS (SELECT DISTINCT league, season, round, constructor_id FROM {results})
SELECT k.league, k.season, k.constructor_id, k.round, CASE WHEN g.round IS NOT NULL THEN round(avg(h.label_position), 6) END AS team_finish, CASE WHEN g.round IS NOT NULL THEN round(avg(CAST(h.label_dnf AS INT)), 6) END AS team_dnf
FROM k LEFT JOIN g USING (league, season, round) LEFT JOIN {results} h ON h.league = k.league AND h.season = k.season AND h.constructor_id = k.constructor_id AND h.round BETWEEN k.round - 3 AND k.round - 1 GROUP BY k.league, k.season, k.constructor_id, k.round, g.round""")
def _(t):
    return form.team_window(t("results"), t("starts"), ["league", "season"], "constructor_id", "round", "cutoff", "label_available_at", 3)


@query("C03_last_appearances", f"WITH {PRIOR}, k AS (SELECT *, row_number() OVER (PARTITION BY league, day, driver_id ORDER BY prior DESC) AS k FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY league, day, driver_id ORDER BY prior DESC) AS j FROM k WHERE k <= 10 AND label_position IS NOT NULL) SELECT league, day, driver_id, round(avg(label_position), 6) AS mean_all, round(avg(label_position) FILTER (WHERE j <= 5), 6) AS mean_first, count(*) AS observations FROM f GROUP BY ALL")
def _(t):
    d = history.last_appearances(facts(t), asked(t), ["league", "driver_id"], "label_available_at", "target_cutoff", "prior", "label_position", 10, 5)
    return d.select(*EVENT, "driver_id", "mean_all", "mean_first", "observations")


@query("C04_entrant_dnf_rate", f"WITH {PRIOR}, k AS (SELECT *, row_number() OVER (PARTITION BY league, day, driver_id ORDER BY prior DESC) AS k FROM p WHERE label_dnf IS NOT NULL AND label_dnf_available_at < target_cutoff) SELECT league, day, driver_id, round(avg(CAST(label_dnf AS INT)), 6) AS rate, count(*) AS observations FROM k WHERE k <= 10 GROUP BY ALL")
def _(t):
    d = history.rate_of_latest(facts(t), asked(t), ["league", "driver_id"], BOTH, "target_cutoff", "prior", "label_dnf", 10)
    return d.select(*EVENT, "driver_id", "rate", "observations")


@query("C05_team_dnf_rate", f"WITH {PRIOR}, k AS (SELECT *, dense_rank() OVER (PARTITION BY league, day, constructor_id ORDER BY prior DESC) AS k FROM p) SELECT league, day, constructor_id, round(avg(CAST(label_dnf AS INT)), 6) AS rate, count(*) AS observations FROM k WHERE k <= 10 AND label_dnf IS NOT NULL AND label_dnf_available_at < target_cutoff GROUP BY ALL")
def _(t):
    d = history.rate_of_latest_events(facts(t), asked(t, "constructor_id"), ["league", "constructor_id"], "label_available_at", "label_dnf_available_at", "target_cutoff", "prior", "label_dnf", 10)
    return d.select(*EVENT, "constructor_id", "rate", "observations")


def _venue(t):
    """Each entrant's places at the target's venue; each event's retirement rate there and whether the venue was seen."""
    own = running(t).filter("here > 0").select(*EVENT, "driver_id", F.round(history.mean("venue_places", "venue_finishes"), 6).alias("venue_finish"), F.col("venue_finishes").alias("venue_count"))
    f = facts(t).withColumnRenamed("circuit_id", "target_circuit")
    e = f.select(*EVENT, "target_circuit", "label_available_at").distinct()
    d = history.known(e, asked(t, None), ["league"], "label_available_at", "target_cutoff", {"events": F.lit(1)}).filter("events > 0")
    d = history.known(e, d, ["league", "target_circuit"], "label_available_at", "target_cutoff", {"here": F.lit(1)})
    d = history.known(f.filter("label_dnf is not null"), d, ["league", "target_circuit"], BOTH, "target_cutoff", {"out": F.col("label_dnf"), "judged": F.lit(1)})
    return own, d.select(*EVENT, F.round(history.mean("out", "judged"), 6).alias("venue_dnf"), (F.col("here") > 0).cast("long").alias("seen"))


@query("C06_entrant_at_venue", f"WITH {PRIOR} SELECT league, day, driver_id, round(avg(label_position), 6) AS venue_finish, count(label_position) AS venue_count FROM p WHERE circuit_id = target_circuit GROUP BY ALL")
def _(t):
    return _venue(t)[0]


@query("C06_venue_dnf_rate", f"WITH {PRIOR} SELECT league, day, round(avg(CAST(label_dnf AS INT)) FILTER (WHERE circuit_id = target_circuit AND label_dnf_available_at < target_cutoff), 6) AS venue_dnf, max(CAST(circuit_id = target_circuit AS BIGINT)) AS seen FROM p GROUP BY league, day")
def _(t):
    return _venue(t)[1]


@query("C07_recent_form", f"WITH {PRIOR}, d AS (SELECT *, row_number() OVER (PARTITION BY league, day, driver_id ORDER BY prior DESC) AS k FROM p), c AS (SELECT *, dense_rank() OVER (PARTITION BY league, day, constructor_id ORDER BY prior DESC) AS k FROM p) SELECT x.league, x.day, x.driver_id, x.m AS driver_form, y.m AS team_form FROM (SELECT league, day, driver_id, any_value(constructor_id) AS constructor_id, round(avg(label_position), 6) AS m FROM d WHERE k <= 5 GROUP BY league, day, driver_id) x JOIN (SELECT league, day, constructor_id, round(avg(label_position), 6) AS m FROM c WHERE k <= 5 GROUP BY ALL) y USING (league, day, constructor_id)")
def _(t):
    f = facts(t)
    own = history.known(f, asked(t), ["league", "driver_id"], "label_available_at", "target_cutoff", latest={"h": (5, ["prior", "constructor_id", "label_position"])})
    own = own.select(*EVENT, "driver_id", F.explode("h").alias("h")).groupBy(*EVENT, "driver_id", "h.constructor_id").agg(F.round(F.avg("h.label_position"), 6).alias("driver_form"))
    per = f.groupBy("league", "constructor_id", "prior", "label_available_at").agg(F.sum("label_position").alias("s"), F.count("label_position").alias("c"))
    team = history.known(per, asked(t, "constructor_id"), ["league", "constructor_id"], "label_available_at", "target_cutoff", latest={"h": (5, ["prior", "s", "c"])})
    total = lambda c: F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[c], F.lit(0)))
    team = team.filter(F.size("h") > 0).select(*EVENT, "constructor_id", F.round(total("s") / F.when(total("c") > 0, total("c")), 6).alias("team_form"))
    return own.join(team, [*EVENT, "constructor_id"]).drop("constructor_id")


@query("C08_teammate_delta", "SELECT a.league, a.day, a.driver_id, round(a.label_position - avg(b.label_position), 6) AS delta FROM {results} a LEFT JOIN {results} b ON a.league = b.league AND a.day = b.day AND a.constructor_id = b.constructor_id AND a.driver_id <> b.driver_id GROUP BY a.league, a.day, a.driver_id, a.label_position")
def _(t):
    r = t("results")
    return r.select(*EVENT, "driver_id", F.round(form.mate_delta(r, EVENT, "constructor_id", "label_position"), 6).alias("delta"))


@query("C09_head_to_head", f"WITH {PRIOR}, m AS (SELECT a.*, (SELECT min(b.qualifying_position) FROM p b WHERE b.league = a.league AND b.day = a.day AND b.prior = a.prior AND b.constructor_id = a.constructor_id AND b.driver_id <> a.driver_id) AS mate FROM p a), k AS (SELECT *, row_number() OVER (PARTITION BY league, day, driver_id ORDER BY prior DESC) AS k FROM m WHERE mate IS NOT NULL) SELECT league, day, driver_id, round(avg(CASE WHEN qualifying_position < mate THEN 1.0 WHEN qualifying_position = mate THEN 0.5 ELSE 0.0 END), 6) AS share, count(*) AS comparable FROM k WHERE k <= 10 GROUP BY ALL")
def _(t):
    mates = form.best_mate(t("results"), EVENT, "constructor_id", "driver_id", "qualifying_position").select(*EVENT, "driver_id", "mate")
    d = history.head_to_head(facts(t).join(mates, [*EVENT, "driver_id"]), asked(t), ["league", "driver_id"], "label_available_at", "target_cutoff", "prior", "qualifying_position", "mate", 10)
    return d.select(*EVENT, "driver_id", "share", "comparable")


@query("C10_elo_step", """WITH r AS (SELECT *, 1500 + user_id % 7 * 20 AS rating FROM {results} WHERE label_position IS NOT NULL)
SELECT a.league, a.day, a.driver_id, round(24 * sum(w * (CASE WHEN a.label_position < b.label_position THEN 1 ELSE 0 END - 1 / (1 + pow(10, (b.rating - a.rating) / 400.0)))) / sum(w), 6) AS delta FROM r a JOIN r b ON a.league = b.league AND a.day = b.day AND a.driver_id <> b.driver_id, LATERAL (SELECT CASE WHEN a.constructor_id = b.constructor_id THEN 2.0 ELSE 1.0 END AS w) GROUP BY a.league, a.day, a.driver_id""")
def _(t):
    return form.elo_step(t("results").withColumn("rating", F.expr("1500 + user_id % 7 * 20")), EVENT, "driver_id", "constructor_id", "label_position", "rating")


KERNEL = """z AS (SELECT circuit_id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM {profiles}),
s AS (SELECT x.circuit_id, y.circuit_id AS other, round(exp(-((x.a - y.a) ** 2 + (x.b - y.b) ** 2) / 2), 9) AS weight FROM z x JOIN z y ON x.circuit_id <> y.circuit_id),
n AS (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY weight DESC, other) AS k FROM s)"""


@query("C12_venue_similarity", f"WITH {KERNEL} SELECT circuit_id, other, k, round(weight, 6) AS weight FROM n WHERE k <= 5")
def _(t):
    return form.similar(t("profiles"), "circuit_id", ["a", "b"], 1.0, 5).withColumn("k", F.col("k").cast("long"))


@query("C13_similar_venue_delta", f"WITH {PRIOR}, {KERNEL}, w AS (SELECT circuit_id AS target_circuit, other, round(weight, 6) AS weight FROM n WHERE k <= 5), c AS (SELECT *, row_number() OVER (PARTITION BY league, day, driver_id ORDER BY prior DESC) AS k FROM p WHERE label_position IS NOT NULL), b AS (SELECT *, avg(label_position) OVER (PARTITION BY league, day, driver_id) AS base FROM c WHERE k <= 40) SELECT league, day, driver_id, round(sum(weight * (label_position - base)) / sum(weight), 6) AS delta FROM b JOIN w ON w.target_circuit = b.target_circuit AND w.other = b.circuit_id GROUP BY ALL")
def _(t):
    kernel = form.similar(t("profiles"), "circuit_id", ["a", "b"], 1.0, 5).select(F.col("circuit_id").alias("target_circuit"), "other", "weight")
    return history.kernel_delta(facts(t), asked(t), kernel, ["league", "driver_id"], "label_available_at", "target_cutoff", "prior", "circuit_id", "target_circuit", "label_position", 40, [*EVENT, "driver_id"])


@query("C14_practice_relative", "SELECT s.league, s.day, s.driver_id, rank() OVER w AS place, round(best / min(best) OVER (PARTITION BY league, day) - 1, 6) AS gap, round(best - (SELECT avg(m.best) FROM {sessions} m WHERE m.provider = 'a' AND m.league = s.league AND m.day = s.day AND m.constructor_id = s.constructor_id AND m.driver_id <> s.driver_id), 6) AS mate_gap, round((rank() OVER w - 1) / nullif(count(*) OVER (PARTITION BY league, day) - 1, 0), 6) AS share FROM {sessions} s WHERE provider = 'a' WINDOW w AS (PARTITION BY league, day ORDER BY best)")
def _(t):
    return form.practice(t("sessions").filter("provider = 'a'"), EVENT, "constructor_id", "best").select(*EVENT, "driver_id", "place", "gap", "mate_gap", "share")


@query("C15_places_lost", "SELECT r.league, r.day, r.driver_id, CASE WHEN r.user_id % 10 = 0 THEN s.entrants + 1 ELSE r.qualifying_position + r.user_id % 3 END - r.qualifying_position AS lost FROM {results} r JOIN {starts} s USING (league, day)")
def _(t):
    d = t("results").join(t("starts").select(*EVENT, "entrants"), EVENT).withColumn("grid", F.expr("qualifying_position + user_id % 3"))
    return d.select(*EVENT, "driver_id", form.places_lost("grid", "qualifying_position", F.expr("user_id % 10 = 0"), "entrants").alias("lost"))


@query("C16_dnf_taxonomy", "SELECT k, CASE WHEN first = 'retired' THEN true WHEN first IN ('finished', 'lapped') THEN false END AS label FROM {statuses}")
def _(t):
    return t("statuses").select("k", form.retired("first").alias("label"))
