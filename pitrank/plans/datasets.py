"""Queries of evidence, dataset builds, folds and baselines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitrank.operators import asof, draws, folds, history, ledger, quality
from pitrank.plans.evaluation import FINALS, RANKED, ranked, remaining
from pitrank.plans.pointintime import EVENT, PRIOR, _venue, asked, facts, running
from pitrank.plans.points import LATEST
from pitrank.plans.registry import query
from pitrank.sources.store import settled

KEY = [*EVENT, "driver_id"]
TIER = "CASE WHEN first = 'finished' AND flags < 4 THEN 1 WHEN first IN ('finished', 'retired') THEN 2 ELSE 3 END"


def evidence(t):
    return t("statuses").withColumn("class", F.expr("case first when 'finished' then 'captured' when 'retired' then 'archived' else 'other' end")).withColumn("audited", F.expr("flags < 4"))


@query("E01_evidence_tier", f"SELECT k, {TIER} AS tier FROM {{statuses}}")
def _(t):
    return evidence(t).select("k", quality.tier("class", "audited").alias("tier"))


@query("E02_weakest_tier", f"SELECT k % 100 AS g, CASE WHEN bool_or(flags = 6 AND second = 'dsq') THEN 3 ELSE max({TIER}) END AS tier FROM {{statuses}} GROUP BY 1")
def _(t):
    d = evidence(t).withColumn("g", F.expr("k % 100")).withColumn("t", quality.tier("class", "audited"))
    return quality.weakest(d, ["g"], "t", F.expr("flags = 6 and second = 'dsq'"))


@query("E03_tier_from_evidence", "SELECT k, 1 + CAST(flags % 2 AS INT) AS claimed, CASE WHEN flags % 3 = 0 THEN greatest(1, 2) ELSE 3 END AS derived, flags = 5 AS no_input, flags = 6 AS late, 1 + flags % 2 < CASE WHEN flags % 3 = 0 THEN 2 ELSE 3 END AS overclaimed FROM {statuses}")
def _(t):
    d = t("statuses").withColumn("claimed", F.expr("1 + cast(flags % 2 as int)")).withColumn("cutoff", F.lit(100))
    text = F.expr("concat('{\"a\":[{\"tier\":1,\"at\":', case when flags = 6 then 101 else 50 end, '},{\"tier\":', case when flags % 3 = 0 then 2 else 3 end, ',\"at\":60}],\"b\":', case when flags = 5 then '[]' else '[{\"tier\":1,\"at\":10}]' end, '}')")
    return quality.tier_from_json(d.withColumn("evidence", text), ["k"], "evidence", "cutoff", "claimed")


@query("E04_evidence_rules", "SELECT k, 'captured_is_finished' AS problem FROM {statuses} WHERE NOT (first <> 'finished' OR second = 'finished') UNION ALL SELECT k, 'flags_in_range' FROM {statuses} WHERE flags >= 5 UNION ALL SELECT k, 'season_known' FROM {statuses} WHERE season < 1993")
def _(t):
    rules = {"captured_is_finished": F.expr("first <> 'finished' or second = 'finished'"), "flags_in_range": F.expr("flags < 5"), "season_known": F.expr("season >= 1993")}
    return quality.violations(t("statuses"), ["k"], rules)


@query("E05_context_difference", "SELECT k, 'left' AS side FROM (SELECT k FROM {coverage_old} EXCEPT ALL SELECT k FROM {coverage_new}) UNION ALL SELECT k, 'right' FROM (SELECT k FROM {coverage_new} EXCEPT ALL SELECT k FROM {coverage_old})")
def _(t):
    return quality.set_difference(t("coverage_old").select("k"), t("coverage_new").select("k"))


@query("E06_outcome_validation", "SELECT league, day, count(*) <> count(DISTINCT driver_id) AS repeated_entrant, count(label_position) <> count(DISTINCT label_position) AS repeated_position, count(*) FILTER (WHERE label_position = 1) <> 1 AS winners, bool_or(coalesce(label_position <= 3, false) <> coalesce(label_position <= 3 - CAST(user_id % 40 = 0 AS INT), false)) AS podium_differs, max(label_position) > count(*) AS out_of_range FROM {results} GROUP BY league, day")
def _(t):
    podium = F.coalesce(F.expr("label_position <= 3 - cast(user_id % 40 = 0 as int)"), F.lit(False))
    return quality.outcome_problems(t("results"), EVENT, "driver_id", "label_position", F.col("label_position") == 1, podium)


@query("E07_row_validation", """WITH r AS (SELECT *, CASE WHEN league % 3 = 0 AND day % 7 = 0 THEN label_position + 1 ELSE label_position END AS place, CASE WHEN user_id % 29 = 0 THEN 'inf'::DOUBLE ELSE score END AS x FROM {results})
SELECT league, day, count(*) FILTER (WHERE label_position = 1) <> 1 AS winners, count(place) <> count(DISTINCT place) OR coalesce(min(place) < 1 OR max(place) > count(*), false) AS positions,
  bool_or(coalesce(label_position <= 3, false) <> coalesce(place <= 3, false)) AS podium, bool_or(isinf(x)) AS infinite FROM r GROUP BY league, day""")
def _(t):
    r = t("results").withColumns({"place": F.expr("case when league % 3 = 0 and day % 7 = 0 then label_position + 1 else label_position end"), "x": F.expr("case when user_id % 29 = 0 then double('infinity') else cast(score as double) end")})
    return quality.row_problems(r, EVENT, "place", F.col("label_position") == 1, F.coalesce(F.col("label_position") <= 3, F.lit(False)), ["x"])


@query("E08_assembly", "SELECT r.league, r.day, r.driver_id, r.label_position FROM {results} r WHERE (r.league, r.day) NOT IN (SELECT (league, day) FROM {results} WHERE user_id % 37 = 5) AND r.day % 6 <> 0")
def _(t):
    r = t("results").withColumn("label_available_at", F.expr("case when day % 6 = 0 then cutoff else label_available_at end"))
    labels = r.filter("user_id % 37 <> 5").select(*KEY, "label_position", "label_available_at")
    return quality.assembled(r.select(*KEY, "cutoff"), labels, EVENT, "driver_id", "cutoff", "label_available_at").select(*KEY, "label_position")


@query("E09_tiered_build", f"SELECT flags, season, CASE WHEN reasons = '' THEN t END AS tier, reasons, count(*) AS n FROM (SELECT *, {TIER} AS t, concat_ws(',', CASE WHEN first = 'dns' THEN 'not_started' END, CASE WHEN second = 'dsq' THEN 'disqualified' END, CASE WHEN row_number() OVER (PARTITION BY k // 2 ORDER BY k) > 1 THEN 'duplicate' END) AS reasons FROM {{statuses}}) GROUP BY ALL")
def _(t):
    d = evidence(t).withColumn("t", quality.tier("class", "audited")).withColumn("pair", F.expr("k div 2"))
    out = quality.tiered(d, ["pair"], "k", {"not_started": F.col("first") == "dns", "disqualified": F.col("second") == "dsq"}, "t")
    return out.groupBy("flags", "season", "tier", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("E10_coverage", "SELECT season, count(DISTINCT (league, day)) AS events, count(*) AS n, count(label_position) AS label_position, count(label_dnf) AS label_dnf FROM {results} GROUP BY season")
def _(t):
    return quality.coverage(t("results"), ["season"], EVENT, ["label_position", "label_dnf"])


@query("E11_reason_histogram", "SELECT 'position' AS feature, 'retired' AS reason, count(*) AS n FROM {results} WHERE label_position IS NULL UNION ALL SELECT 'dnf', 'unknown', count(*) FROM {results} WHERE label_dnf IS NULL")
def _(t):
    m = F.map_filter(F.create_map(F.lit("position"), F.when(F.col("label_position").isNull(), "retired"), F.lit("dnf"), F.when(F.col("label_dnf").isNull(), "unknown")), lambda k, v: v.isNotNull())
    return quality.reason_counts(t("results").select(m.alias("reasons")), "reasons")


@query("E12_candidate_accounting", "SELECT season, count(*) AS candidates, count(*) FILTER (WHERE state = 'gold') AS gold, count(*) FILTER (WHERE state = 'excluded') AS excluded, count(*) FILTER (WHERE k NOT IN (SELECT k FROM {coverage_old})) AS unseen FROM {coverage_new} GROUP BY season")
def _(t):
    old = t("coverage_old").select("k", F.lit(True).alias("seen"))
    d = t("coverage_new").join(old, "k", "left")
    return d.groupBy("season").agg(F.count("*").alias("candidates"), F.count_if(F.col("state") == "gold").alias("gold"), F.count_if(F.col("state") == "excluded").alias("excluded"), F.count_if(F.col("seen").isNull()).alias("unseen"))


@query("E13_shortlist", "SELECT c_custkey, CAST(c_acctbal * 2 + c_nationkey AS DOUBLE) AS score, CASE WHEN c_mktsegment = 'BUILDING' THEN 'not_eligible' WHEN row_number() OVER (PARTITION BY c_mktsegment <> 'BUILDING' ORDER BY c_acctbal * 2 + c_nationkey DESC, c_custkey) > 25 THEN 'bounded_pool_limit' END AS reason FROM {customer}")
def _(t):
    return quality.shortlist(t("customer"), F.col("c_mktsegment") != "BUILDING", F.expr("c_acctbal * 2 + c_nationkey"), "c_custkey", 25).select("c_custkey", "score", "reason")


@query("E14_version_diff", "SELECT k, CASE WHEN o.state IS NULL THEN 'first_observed' WHEN n.state IS NULL THEN 'removed' WHEN o.state = 'excluded' AND n.state = 'gold' THEN 'excluded_to_gold' WHEN o.state = 'gold' AND n.state = 'excluded' THEN 'gold_to_excluded' WHEN o.hash <> n.hash THEN 'changed' ELSE 'unchanged' END AS change FROM {coverage_old} o FULL JOIN {coverage_new} n USING (k)")
def _(t):
    return quality.version_diff(t("coverage_old"), t("coverage_new"), ["k"], "state", "hash")


STATUS = "s AS (SELECT *, CASE WHEN first IN ('dns', 'dsq') OR second IN ('dns', 'dsq') THEN 'outside_label' WHEN first <> second THEN 'sources_differ' WHEN (flags % 3 = 0) <> (first = 'finished') THEN 'flags_differ' END AS reason FROM {statuses})"


@query("E15_agreed_status", f"WITH {STATUS} SELECT k, reason, CASE WHEN reason IS NULL THEN first = 'retired' END AS label FROM s")
def _(t):
    return quality.agreed_status(t("statuses"), "first", "second", "flags").select("k", "reason", "label")


@query("E16_label_counts", f"WITH {STATUS} SELECT season, coalesce(reason, 'agreed') AS reason, count(*) AS n, count(*) FILTER (WHERE reason IS NULL AND first = 'retired') AS retired FROM s GROUP BY ALL")
def _(t):
    d = quality.agreed_status(t("statuses"), "first", "second", "flags")
    return d.groupBy("season", F.coalesce("reason", F.lit("agreed")).alias("reason")).agg(F.count("*").alias("n"), F.count_if("label").alias("retired"))


@query("E17_source_patterns", "SELECT first, second, count(*) AS n, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (WHERE r <= 2) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY first, second ORDER BY k) AS r FROM {statuses}) GROUP BY ALL")
def _(t):
    return quality.source_patterns(t("statuses"), ["first", "second"], "k")


@query("E18_cross_check", "SELECT r.league, r.day, r.driver_id, CASE WHEN p.driver_id IS NULL THEN 'absent' WHEN p.position IS DISTINCT FROM r.label_position THEN 'position_differs' WHEN p.points > 20 AND r.label_position > 1 THEN 'points_differ' END AS reason FROM {results} r LEFT JOIN {points} p ON p.league = r.league AND p.day = r.day AND p.driver_id = r.driver_id AND p.version = 1 AND r.user_id % 9 <> 0")
def _(t):
    p = t("points").filter("version = 1").select(*KEY, "position", "points", F.lit(True).alias("there"))
    j = t("results").join(p, KEY, "left").withColumn("there", F.expr("there and user_id % 9 <> 0"))
    reason = F.when(~F.coalesce("there", F.lit(False)), "absent").when(~F.col("position").eqNullSafe(F.col("label_position")), "position_differs").when(F.expr("points > 20 and label_position > 1"), "points_differ")
    return j.select(*KEY, reason.alias("reason"))


@query("E19_contingency", "SELECT first = 'retired' AS a, second = 'retired' AS b, count(*) AS n, round(avg(abs(flags - 3)), 6) AS mean_gap FROM {statuses} GROUP BY ALL")
def _(t):
    return t("statuses").groupBy((F.col("first") == "retired").alias("a"), (F.col("second") == "retired").alias("b")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("flags") - 3)), 6).alias("mean_gap"))


@query("E20_availability_mask", "SELECT 'label_position' AS feature, CAST(0 AS BIGINT) AS live, count(label_position) AS train FROM {results} WHERE day < 30")
def _(t):
    r = t("results")
    live = r.filter("day = 30").withColumn("label_position", F.lit(None).cast("long"))
    return quality.absent_features(live, r.filter("day < 30"), ["label_position", "score", "n"])


@query("E21_apply_mask", "SELECT league, day, driver_id, CAST(NULL AS DOUBLE) AS score, n, true AS score_missing FROM {results}")
def _(t):
    return quality.masked(t("results").select(*KEY, "score", "n"), ["score"])


@query("E22_ablations", "SELECT stage, count(*) AS rows_, count(CASE WHEN stage <> 'base' THEN score END) AS score, count(CASE WHEN stage = 'all' THEN label_position END) AS label_position, count(n) AS n FROM {results} CROSS JOIN (SELECT unnest(['base', 'form', 'all']) AS stage) GROUP BY stage")
def _(t):
    d = quality.ablations(t("results").select("n", "score", "label_position"), {"base": ["n"], "form": ["score"], "all": ["label_position"]})
    return d.groupBy("stage").agg(F.count("*").alias("rows_"), F.count("score").alias("score"), F.count("label_position").alias("label_position"), F.count("n").alias("n"))


@query("E23_presence_summary", "SELECT 'label_position' AS feature, count(label_position) FILTER (WHERE day >= 25) AS live, count(label_position) FILTER (WHERE day < 25) AS train FROM {results} UNION ALL SELECT 'label_dnf', count(label_dnf) FILTER (WHERE day >= 25), count(label_dnf) FILTER (WHERE day < 25) FROM {results}")
def _(t):
    r = t("results").select("day", F.col("label_position").cast("string"), F.col("label_dnf").cast("string")).unpivot(["day"], ["label_position", "label_dnf"], "feature", "v")
    return r.groupBy("feature").agg(F.count(F.expr("case when day >= 25 then v end")).alias("live"), F.count(F.expr("case when day < 25 then v end")).alias("train"))


@query("E24_probability_coherence", "SELECT league, day, 'entrant' AS kind, driver_id AS of FROM {predictions} WHERE model = 'grid' AND day % 10 = 0 AND entrants > 1")
def _(t):
    d = t("predictions").filter("model = 'grid'").select(*EVENT, "driver_id", F.expr("explode(sequence(1L, entrants))").alias("place"), "entrants")
    d = d.withColumn("p", F.when((F.col("day") % 10 == 0) & (F.col("place") > 1), 0.0).when((F.col("day") % 10 == 0), 1 / F.col("entrants")).otherwise(1 / F.col("entrants")))
    return quality.incoherent(d, EVENT, "driver_id", "place", "p").filter("kind = 'entrant'")


@query("E24_marginal_coherence", f"""WITH {RANKED}, d AS (SELECT ev, driver_id, place, count(*) / 32.0 AS p FROM r GROUP BY ALL), n AS (SELECT ev, count(DISTINCT driver_id) AS n FROM r GROUP BY ev),
c AS (SELECT ev, max(abs(s - 1)) AS columns_off FROM (SELECT ev, place, sum(p) AS s FROM d GROUP BY ALL) GROUP BY ev), w AS (SELECT ev, max(abs(s - 1)) AS rows_off FROM (SELECT ev, driver_id, sum(p) AS s FROM d GROUP BY ALL) GROUP BY ev)
SELECT d.ev, round(sum(p) FILTER (WHERE place = 1), 6) AS wins, round(sum(p) FILTER (WHERE place <= 3), 6) AS podiums, sum(p) FILTER (WHERE place <= 3) BETWEEN least(3, any_value(n)) - 1e-9 AND least(3, any_value(n)) + 1e-9 AND any_value(rows_off) < 1e-9 AND any_value(columns_off) < 1e-9 AS coherent
FROM d JOIN n USING (ev) JOIN c USING (ev) JOIN w USING (ev) GROUP BY d.ev""")
def _(t):
    """Both from the same counts of places, so that draws are made once."""
    c = settled(ranked(t).groupBy("ev", "driver_id", "place").agg(F.count("*").alias("c")))
    share = lambda here: F.sum(F.when(here, F.col("c")).otherwise(0)) / F.sum("c")
    m = c.groupBy("ev", "driver_id").agg(share(F.col("place") == 1).alias("win"), share(F.col("place") <= 3).alias("podium"))
    return quality.coherent(draws.shares(c, "ev", "driver_id"), m, ["ev"], "driver_id")


@query("E25_standings_coherence", f"""WITH {FINALS}, n AS (SELECT league, count(DISTINCT driver_id) AS entrants FROM z GROUP BY league), s AS (SELECT league, driver_id, unnest(range(place, place + same)) AS position, 1.0 / same AS share FROM z),
q AS (SELECT league, driver_id, sum(share) / 16 AS total, max(position) AS deepest FROM s GROUP BY ALL), m AS (SELECT league, driver_id, avg(total) AS mean_points FROM z GROUP BY ALL)
SELECT league, driver_id, abs(q.total - 1) < 1e-6 AS positions_sum, deepest <= entrants AS positions_in_field, mean_points >= c.now - 1e-6 AS keeps_points FROM q JOIN m USING (league, driver_id) JOIN n USING (league) JOIN c USING (league, driver_id)""")
def _(t):
    """The forecast of the standings: each entrant's places sum to 1 within the field, and nobody loses points."""
    r, now, points = remaining(t)
    d = draws.finals(r, now, points, "league", "ev", "driver_id", 16, 3, 32)
    return quality.standings_coherent(draws.final_places(d, "league", "driver_id", 16), d.groupBy("league", "driver_id").agg(F.avg("total").alias("mean_points")), now, ["league"], "driver_id")


@query("E26_leak_guard", "SELECT league, day, driver_id, 'label_after_cutoff' AS problem FROM {results} WHERE label_available_at > cutoff + INTERVAL 24 HOUR UNION ALL SELECT league, day, driver_id, 'status_uniform' FROM {results} WHERE label_dnf IS NULL")
def _(t):
    return quality.violations(t("results"), KEY, {"label_after_cutoff": F.expr("label_available_at <= cutoff + INTERVAL 24 HOUR"), "status_uniform": F.col("label_dnf").isNotNull()})


@query("E27_late_label_attach", "SELECT s.league, s.day, max(p.version) AS version, max_by(p.status, p.version) AS status FROM {starts} s LEFT JOIN {points} p ON p.league = s.league AND p.day = s.day AND s.day % 4 <> 0 GROUP BY s.league, s.day")
def _(t):
    outcomes = t("points").filter("day % 4 <> 0").select(*EVENT, "version", "status").distinct()
    return quality.attached(t("starts").select(*EVENT), outcomes, EVENT, "version", ["status"])


@query("E29_catalog_extension", "WITH r AS (SELECT event, max_by(page_id, (clock, page_id)) AS page_id FROM {registry} WHERE event % 3 <> 0 GROUP BY event) SELECT event, page_id, 'latest' AS origin FROM r UNION ALL SELECT event, min(page_id), 'reviewed' FROM {registry} WHERE event % 3 = 0 GROUP BY event")
def _(t):
    r = t("registry")
    reviewed = r.filter("event % 3 = 0").groupBy("event").agg(F.min("page_id").alias("page_id"))
    return quality.extended(reviewed, r, ["event"], "clock", ["page_id"])


@query("E30_sprint_gold", "SELECT r.league, r.day, count(*) AS rows_, count(q.position) AS with_grid, count(*) FILTER (WHERE r.label_position IS NULL) AS unclassified FROM {results} r LEFT JOIN (SELECT DISTINCT league, day, driver_id, position FROM {publications} WHERE version = 2 AND NOT recalled) q USING (league, day, driver_id) WHERE r.round % 4 = 0 GROUP BY ALL")
def _(t):
    grid = t("publications").filter("version = 2 and not recalled").select(*KEY, "position")
    d = t("results").filter("round % 4 = 0").join(grid, KEY, "left")
    return d.groupBy(*EVENT).agg(F.count("*").alias("rows_"), F.count("position").alias("with_grid"), F.count_if(F.col("label_position").isNull()).alias("unclassified"))


@query("E31_replay_check", "SELECT CAST(0 AS BIGINT) AS differing, count(*) AS compared FROM {starts}")
def _(t):
    again = t("results").groupBy(*EVENT).agg(F.count("*").alias("entrants"), F.max("label_available_at").alias("at"))
    frozen = t("starts").select(*EVENT, "entrants", F.col("label_available_at").alias("at"))
    bad = quality.set_difference(frozen, again).agg(F.count("*").alias("differing"))
    return bad.crossJoin(frozen.agg(F.count("*").alias("compared")))


@query("E31_margin_replay", """WITH n AS (SELECT league, day, count(*) AS n, round(avg(best), 6) AS best FROM {sessions} WHERE provider = 'a' GROUP BY ALL),
z AS (SELECT league, day, n, CASE WHEN league % 4 = 1 AND day % 5 = 0 THEN round(best + 0.5, 6) ELSE best END AS best FROM n WHERE day % 11 <> 0)
SELECT n.league, n.day, z.n IS DISTINCT FROM n.n OR z.best IS DISTINCT FROM n.best AS values_differ, z.n IS NOT NULL AND s.label_available_at <> s.cutoff + INTERVAL 18 HOUR AS clock_differs FROM n JOIN {starts} s USING (league, day) LEFT JOIN z USING (league, day)
WHERE z.n IS DISTINCT FROM n.n OR z.best IS DISTINCT FROM n.best OR s.label_available_at <> s.cutoff + INTERVAL 18 HOUR""")
def _(t):
    """A frozen copy of session summaries, some changed and some gone, against the retained sessions."""
    again = quality.summarised(t("sessions").filter("provider = 'a'"), EVENT, "best")
    frozen = again.filter("day % 11 <> 0").withColumn("best", F.expr("case when league % 4 = 1 and day % 5 = 0 then round(best + 0.5, 6) else best end"))
    clocks = t("starts").select(*EVENT, "cutoff", "label_available_at")
    return quality.replayed(frozen.join(clocks, EVENT), again, EVENT, ["n", "best"], "cutoff", "label_available_at", F.expr("INTERVAL 18 HOUR"))


FOLDS = "f AS (SELECT t.league, t.day AS test, e.day AS train, e.cutoff, e.label_available_at, count(*) OVER (PARTITION BY t.league, t.day) AS n FROM {starts} t JOIN {starts} e ON e.league = t.league AND e.cutoff < t.cutoff AND e.label_available_at <= t.cutoff)"


def rolling(t):
    return folds.rolling_folds(t("starts"), ["league"], "day", "cutoff", "label_available_at", 5)


@query("F01_rolling_folds", f"WITH {FOLDS} SELECT league, test, train FROM f WHERE n >= 5")
def _(t):
    return rolling(t)


@query("F01_skipped_cohorts", f"WITH {FOLDS} SELECT league, day, 'insufficient_prior_events' AS reason FROM {{starts}} s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.league = s.league AND f.test = s.day AND f.n >= 5)")
def _(t):
    return folds.skipped(t("starts"), rolling(t), ["league"], "day")


@query("F02_training_gate", f"WITH {FOLDS} SELECT f.league, f.test, count(*) AS n, count(CASE WHEN r.label_dnf_available_at <= t.cutoff THEN r.label_dnf END) AS known FROM f JOIN {{results}} r ON r.league = f.league AND r.day = f.train JOIN {{starts}} t ON t.league = f.league AND t.day = f.test WHERE f.n >= 5 GROUP BY f.league, f.test")
def _(t):
    rows = t("results").drop("cutoff")
    d = folds.training_rows(rows, rolling(t), ["league"], "day", t("starts"), "label_dnf", "label_dnf_available_at")
    return d.groupBy("league", "test").agg(F.count("*").alias("n"), F.count("label_dnf").alias("known"))


@query("F03_calibration_split", f"WITH {FOLDS}, k AS (SELECT *, row_number() OVER (PARTITION BY league, test ORDER BY train DESC) AS r FROM f WHERE n >= 5), m AS (SELECT *, min(cutoff) FILTER (WHERE r <= 3) OVER (PARTITION BY league, test) AS first FROM k) SELECT league, test, train, CASE WHEN r <= 3 THEN 'calibrate' ELSE 'fit' END AS role FROM m WHERE r <= 3 OR label_available_at <= first")
def _(t):
    return folds.calibration_split(rolling(t), t("starts"), ["league"], "day", "cutoff", "label_available_at", 3)


@query("F04_matrix", "WITH m AS (SELECT season, median(CAST(label_position AS DOUBLE)) AS md FROM {results} WHERE day % 3 <> 0 GROUP BY season), x AS (SELECT r.*, coalesce(CAST(r.label_position AS DOUBLE), m.md) AS v FROM {results} r JOIN m USING (season)), s AS (SELECT season, avg(v) AS a, stddev_pop(v) AS b FROM x WHERE day % 3 <> 0 GROUP BY season) SELECT x.league, x.day, x.driver_id, round((x.v - s.a) / s.b, 6) AS label_position FROM x JOIN s USING (season)")
def _(t):
    d = folds.imputed(t("results").select(*KEY, "season", F.col("label_position").cast("double").alias("label_position")), ["season"], ["label_position"], F.expr("day % 3 <> 0"))
    return d.select(*KEY, F.round("label_position", 6).alias("label_position"))


@query("F08_order_likelihood", "SELECT league, day, round(sum(u - ln(field)), 6) AS log_likelihood, count(*) AS stages FROM (SELECT a.league, a.day, a.driver_id, ln(a.raw) AS u, sum(b.raw) AS field FROM {predictions} a JOIN {predictions} b ON b.league = a.league AND b.day = a.day AND b.model = a.model AND b.label_position >= a.label_position WHERE a.model = 'form' GROUP BY ALL) GROUP BY league, day")
def _(t):
    return folds.order_likelihood(t("predictions").filter("model = 'form'").withColumn("u", F.log("raw")), EVENT, "u", "label_position")


@query("F10_smoothed_rate", "SELECT league, constructor_id, round((1 + coalesce(sum(CAST(label_dnf AS INT)), 0)) / (2 + count(label_dnf)), 6) AS rate FROM {results} GROUP BY ALL")
def _(t):
    return folds.smoothed_rate(t("results"), ["league", "constructor_id"], "label_dnf")


HEUR = "h AS (SELECT r.league, r.day, r.driver_id, CAST(coalesce(CASE WHEN r.user_id % 10 <> 0 THEN r.qualifying_position END, CASE WHEN r.user_id % 20 <> 0 THEN r.n END, count(*) OVER (PARTITION BY r.league, r.day) + 1) AS DOUBLE) AS value FROM {results} r)"


@query("F11_heuristic", f"WITH {HEUR} SELECT league, day, driver_id, value, round((1 / value) / sum(1 / value) OVER (PARTITION BY league, day), 6) AS p_win, row_number() OVER (PARTITION BY league, day ORDER BY value, driver_id) AS rank, row_number() OVER (PARTITION BY league, day ORDER BY value, driver_id) <= 3 AS podium FROM h")
def _(t):
    r = t("results").withColumn("grid", F.expr("case when user_id % 10 <> 0 then qualifying_position else 0 end")).withColumn("recent", F.expr("case when user_id % 20 <> 0 then n end"))
    return folds.heuristic(r, EVENT, ["grid", "recent"], "driver_id").select(*KEY, "value", F.round("p_win", 6).alias("p_win"), "rank", "podium")


FORM = f"""{PRIOR}, v AS (SELECT league, day, driver_id, avg(label_position) AS recent, avg(CASE WHEN label_dnf_available_at < target_cutoff THEN CAST(label_dnf AS INT) END) AS rate FROM p GROUP BY ALL)"""


def with_form(t):
    """Rows with the mean place and the retirement rate that were known by their cutoff."""
    f = running(t).select(*KEY, history.mean("places", "finishes").alias("recent"), history.mean("out", "judged").alias("rate"))
    return t("results").join(f, KEY, "left").withColumn("grid", F.expr("case when user_id % 10 <> 0 then qualifying_position else 0 end"))


@query("F22_heuristic_baseline", f"""WITH {FORM}, h AS (SELECT r.league, r.day, r.driver_id, coalesce(CASE WHEN r.user_id % 10 <> 0 THEN CAST(r.qualifying_position AS DOUBLE) END, CASE WHEN recent > 0 THEN recent END, count(*) OVER (PARTITION BY r.league, r.day) + 1) AS value, least(greatest(coalesce(rate, 0), 0), 1) AS p_dnf FROM {{results}} r LEFT JOIN v ON v.league = r.league AND v.day = r.day AND v.driver_id = r.driver_id),
q AS (SELECT *, row_number() OVER (PARTITION BY league, day ORDER BY value, driver_id) AS place FROM h)
SELECT league, day, driver_id, round((1 / value) / sum(1 / value) OVER (PARTITION BY league, day), 6) AS p_win, CAST(place <= 3 AS DOUBLE) AS p_podium, round(p_dnf, 6) AS p_dnf, place, 'heuristic' AS model FROM q""")
def _(t):
    d = folds.predicted(folds.baseline(with_form(t), EVENT, ["grid", "recent"], "driver_id", "rate"), EVENT, "driver_id", "heuristic")
    return d.select(*KEY, F.round("p_win", 6).alias("p_win"), "p_podium", F.round("p_dnf", 6).alias("p_dnf"), "place", "model")


@query("F22_observations", f"WITH {FOLDS}, k AS (SELECT league, test, count(*) AS train_events FROM f WHERE n >= 5 GROUP BY ALL) SELECT r.league, r.day, count(*) AS n, count(label_position) AS n_label_position, count(label_dnf) AS n_label_dnf, any_value(train_events) AS train_events FROM {{results}} r JOIN k ON k.league = r.league AND k.test = r.day GROUP BY r.league, r.day")
def _(t):
    return folds.observations(t("results"), rolling(t), ["league"], "day", ["label_position", "label_dnf"])


@query("F22_skipped_cohorts", f"WITH {FOLDS} SELECT s.league, s.day, 'insufficient_prior_labelled_events' AS reason, count(f.train) AS available_train_events FROM {{starts}} s LEFT JOIN f ON f.league = s.league AND f.test = s.day GROUP BY s.league, s.day HAVING count(f.train) < 5")
def _(t):
    every = folds.rolling_folds(t("starts"), ["league"], "day", "cutoff", "label_available_at", 1).groupBy("league", F.col("test").alias("day")).agg(F.count("*").alias("k"))
    d = t("starts").select(*EVENT).join(every, EVENT, "left").withColumn("available_train_events", F.coalesce("k", F.lit(0)))
    return d.filter("available_train_events < 5").select(*EVENT, F.lit("insufficient_prior_labelled_events").alias("reason"), "available_train_events")


@query("F12_normalised", "SELECT league, day, driver_id, round(CASE WHEN sum(v) OVER w > 0 THEN v / sum(v) OVER w ELSE 1 / count(*) OVER w END, 6) AS share FROM (SELECT *, CASE WHEN day % 5 = 0 THEN 0 ELSE n END AS v FROM {results}) WINDOW w AS (PARTITION BY league, day)")
def _(t):
    return t("results").withColumn("v", F.expr("case when day % 5 = 0 then 0 else n end")).select(*KEY, F.round(folds.normalised("v", EVENT), 6).alias("share"))


@query("F17_utilities", "SELECT league, day, driver_id, model, round(ln(least(greatest(p_win, 1e-9), 1)), 6) AS a, CAST(-qualifying_position AS BIGINT) AS b, round(-p_win * entrants, 6) AS c FROM {predictions}")
def _(t):
    return t("predictions").select(*KEY, "model", F.round(folds.utility("probability", "p_win", "entrants"), 6).alias("a"), folds.utility("position", "qualifying_position", "entrants").alias("b"), F.round(folds.utility("fraction", "p_win", "entrants"), 6).alias("c"))


@query("F24_prediction_guards", "SELECT league, day, false AS repeated, day IN (18, 19, 20) AS leaked, (SELECT max(label_available_at) FROM {results} WHERE day BETWEEN 18 AND 20) > min(cutoff) AS late_label FROM {results} WHERE day >= 20 GROUP BY league, day")
def _(t):
    r = t("results")
    return folds.guard(r.filter("day >= 20"), r.filter("day between 18 and 20"), r.filter("day = 19"), EVENT, "driver_id", "cutoff")


@query("B19_contract_dataset", "SELECT r.league, r.day, r.driver_id, c.contract, CASE WHEN c.contract = 'grid' THEN r.qualifying_position END AS grid, r.label_position FROM {results} r CROSS JOIN (SELECT unnest(['weekend', 'grid']) AS contract) c")
def _(t):
    r = t("results")
    weekend = r.select(*KEY, F.lit("weekend").alias("contract"), F.lit(None).cast("long").alias("grid"), "label_position")
    return weekend.unionByName(r.select(*KEY, F.lit("grid").alias("contract"), F.col("qualifying_position").alias("grid"), "label_position"))


CONTRACTS = {"pre_weekend": 48, "qualifying": 4, "grid": 0}  #: hours before the event's cutoff


@query("B19_contract_features", """WITH c AS (SELECT s.league, s.day, s.circuit_id AS target_circuit, k.contract, s.cutoff - k.h * INTERVAL 1 HOUR AS due FROM {starts} s CROSS JOIN (VALUES ('pre_weekend', 48), ('qualifying', 4), ('grid', 0)) k(contract, h)),
p AS (SELECT c.league, c.day, c.contract, c.due, r.driver_id, r.label_position, r.label_dnf, r.label_dnf_available_at, e.circuit_id = c.target_circuit AS here FROM c JOIN {starts} e ON e.league = c.league AND e.day < c.day AND e.label_available_at < c.due JOIN {results} r ON r.league = e.league AND r.day = e.day),
a AS (SELECT league, day, contract, driver_id, round(avg(label_position), 6) AS form, round(avg(CASE WHEN label_dnf_available_at < due THEN CAST(label_dnf AS INT) END), 6) AS dnf_rate, round(avg(label_position) FILTER (WHERE here), 6) AS venue_form, count(*) AS history FROM p GROUP BY ALL)
SELECT r.league, r.day, r.driver_id, c.contract AS cutoff_kind, CAST(c.due AS VARCHAR) AS prediction_timestamp, form, dnf_rate, venue_form, coalesce(history, 0) AS history, CASE WHEN c.contract <> 'pre_weekend' THEN r.qualifying_position END AS qualifying_position,
  CASE WHEN c.contract = 'grid' AND r.user_id % 10 <> 0 THEN r.qualifying_position END AS grid_position, r.label_position, CASE WHEN r.label_available_at > c.due THEN r.label_dnf END AS label_dnf
FROM {results} r JOIN c ON c.league = r.league AND c.day = r.day LEFT JOIN a ON a.league = r.league AND a.day = r.day AND a.contract = c.contract AND a.driver_id = r.driver_id""")
def _(t):
    """Every event under every contract: history as of the contract's own cutoff, weekend values where it has them, and
    labels. All contracts have one schema."""
    r, parts = t("results").withColumn("grid", F.expr("case when user_id % 10 <> 0 then qualifying_position end")), []
    for contract, hours in CONTRACTS.items():
        targets = t("starts").withColumn("cutoff", F.col("cutoff") - F.expr(f"INTERVAL {hours} HOUR"))
        a = running(t, asked(t, events=targets)).select(*KEY, F.round(history.mean("places", "finishes"), 6).alias("form"), F.round(history.mean("out", "judged"), 6).alias("dnf_rate"), F.round(history.mean("venue_places", "venue_finishes"), 6).alias("venue_form"), F.col("rows").alias("history"))
        weekend = {"qualifying_position": contract != "pre_weekend", "grid_position": contract == "grid"}
        own = r.drop("cutoff").join(targets.select(*EVENT, "cutoff"), EVENT).withColumn("grid_position", F.col("grid")).join(a, KEY, "left")
        own = own.withColumns({c: F.when(F.lit(has), F.col(c)) for c, has in weekend.items()})
        own = own.withColumn("label_dnf", F.when(F.col("label_available_at") > F.col("cutoff"), F.col("label_dnf")))
        parts.append(own.select(*KEY, F.lit(contract).alias("cutoff_kind"), F.col("cutoff").cast("string").alias("prediction_timestamp"), "form", "dnf_rate", "venue_form", F.coalesce("history", F.lit(0)).alias("history"), "qualifying_position", "grid_position", "label_position", "label_dnf"))
    return quality.one_schema(parts)


@query("B16_full_snapshot", f"""WITH {LATEST}, m AS (SELECT league, day, driver_id, sum(points) AS total FROM s GROUP BY ALL), l AS (SELECT league, day, max(total) AS lead FROM m GROUP BY ALL), {PRIOR},
o AS (SELECT league, day, driver_id, max_by(constructor_id, available_at) AS team, max_by(position, available_at) AS position FROM {{publications}} WHERE available_at <= cutoff GROUP BY ALL),
b AS (SELECT league, day, driver_id, min(best) AS best FROM {{sessions}} WHERE available_at <= cutoff AND provider = 'a' GROUP BY ALL),
h AS (SELECT league, day, driver_id, round(avg(label_position), 6) AS form, count(label_position) AS finishes, round(avg(label_position) FILTER (WHERE circuit_id = target_circuit), 6) AS venue_finish FROM p GROUP BY ALL),
rate AS (SELECT league, day, round(avg(CAST(label_dnf AS INT)) FILTER (WHERE circuit_id = target_circuit AND label_dnf_available_at < target_cutoff), 6) AS venue_dnf, max(CAST(circuit_id = target_circuit AS BIGINT)) AS seen FROM p GROUP BY league, day),
w AS (SELECT valid_at, precipitation, temperature FROM {{forecast}})
SELECT r.league, r.day, r.driver_id, o.team, o.position, round(b.best, 6) AS best, round(b.best / min(b.best) OVER (PARTITION BY r.league, r.day) - 1, 6) AS gap, h.form, coalesce(h.finishes, 0) AS finishes, h.venue_finish, rate.venue_dnf, coalesce(rate.seen, 0) = 1 AS venue_seen, CASE WHEN g.rounds IS NOT NULL THEN coalesce(m.total, 0) END AS points_before, CASE WHEN g.rounds IS NOT NULL THEN l.lead - m.total END AS points_gap,
  round(w.precipitation, 6) AS precipitation, round(w.temperature, 6) AS temperature, h.form IS NULL AS form_missing, b.best IS NULL AS best_missing, w.precipitation IS NULL AS precipitation_missing
FROM {{results}} r LEFT JOIN o USING (league, day, driver_id) LEFT JOIN b USING (league, day, driver_id) LEFT JOIN h USING (league, day, driver_id) LEFT JOIN rate USING (league, day) LEFT JOIN g USING (league, day) LEFT JOIN m USING (league, day, driver_id) LEFT JOIN l USING (league, day) LEFT JOIN w ON w.valid_at = date_trunc('hour', r.cutoff)""")
def _(t):
    """Entrant rows with every leg as of the event's cutoff: roster, qualifying, practice, history, venue, standings and
    forecast. Each leg is one row per entrant or event before it joins."""
    o = asof.latest(t("publications"), KEY, "available_at", ["constructor_id", "position"], "cutoff").select(*KEY, F.col("constructor_id").alias("team"), "position")
    b = t("sessions").filter(asof.known_by("available_at", "cutoff") & (F.col("provider") == "a")).groupBy(*KEY).agg(F.min("best").alias("best"))
    h = running(t).select(*KEY, F.round(history.mean("places", "finishes"), 6).alias("form"), "finishes")
    own, rate = _venue(t)
    points = ledger.standings(t("points"), t("starts"), t("results"), ["league", "season"], "round", EVENT, "cutoff", "driver_id").select(*KEY, "points_before", F.col("gap").alias("points_gap"))
    w = asof.in_hour(t("starts"), t("forecast"), "cutoff", "valid_at", EVENT, ["precipitation", "temperature"])
    d = t("results").select(*KEY)
    for leg, on in ((o, KEY), (b, KEY), (h, KEY), (own.select(*KEY, "venue_finish"), KEY), (rate, EVENT), (points, KEY), (w, EVENT)):
        d = d.join(leg, on, "left")
    gap = F.round(F.col("best") / F.min("best").over(Window.partitionBy(*EVENT)) - 1, 6)
    d = d.select(*KEY, "team", "position", F.round("best", 6).alias("best"), gap.alias("gap"), "form", F.coalesce("finishes", F.lit(0)).alias("finishes"), "venue_finish", "venue_dnf", (F.coalesce("seen", F.lit(0)) == 1).alias("venue_seen"), "points_before", "points_gap", F.round("precipitation", 6).alias("precipitation"), F.round("temperature", 6).alias("temperature"))
    return d.withColumns({f"{c}_missing": F.col(c).isNull() for c in ("form", "best", "precipitation")})


@query("B20_live_rows", f"WITH {PRIOR} SELECT league, day, driver_id, round(avg(label_position), 6) AS form, CASE WHEN count(label_position) = 0 THEN 'no_known_finish' END AS form_reason FROM p GROUP BY ALL")
def _(t):
    return running(t).select(*KEY, F.round(history.mean("places", "finishes"), 6).alias("form"), F.when(F.col("finishes") == 0, "no_known_finish").alias("form_reason"))


@query("B20_live_features", f"""WITH {PRIOR}, a AS (SELECT league, day, driver_id, avg(label_position) AS form, avg(CASE WHEN label_dnf_available_at < target_cutoff THEN CAST(label_dnf AS INT) END) AS dnf_rate, avg(label_position) FILTER (WHERE circuit_id = target_circuit) AS venue_form, avg(qualifying_position) AS qualifying_form, count(*) AS seen FROM p GROUP BY ALL)
SELECT r.league, r.day, r.driver_id, round(form, 6) AS form, round(dnf_rate, 6) AS dnf_rate, round(venue_form, 6) AS venue_form, round(qualifying_form, 6) AS qualifying_form,
  concat_ws(',', CASE WHEN dnf_rate IS NULL THEN 'dnf_rate=' || CASE WHEN seen IS NULL THEN 'no_prior_event' ELSE 'no_known_label' END END, CASE WHEN form IS NULL THEN 'form=' || CASE WHEN seen IS NULL THEN 'no_prior_event' ELSE 'no_known_finish' END END,
    CASE WHEN qualifying_form IS NULL THEN 'qualifying_form=no_prior_event' END, CASE WHEN venue_form IS NULL THEN 'venue_form=' || CASE WHEN seen IS NULL THEN 'no_prior_event' ELSE 'venue_not_seen' END END) AS reasons
FROM {{results}} r LEFT JOIN a ON a.league = r.league AND a.day = r.day AND a.driver_id = r.driver_id""")
def _(t):
    """All features of the contract without labels, and for each that is null the reason."""
    a = running(t).select(*KEY, history.mean("places", "finishes").alias("form"), history.mean("out", "judged").alias("dnf_rate"), history.mean("venue_places", "venue_finishes").alias("venue_form"), history.mean("grids", "rows").alias("qualifying_form"), F.col("rows").alias("seen"))
    d = t("results").select(*KEY).join(a, KEY, "left")
    why = {"form": "no_known_finish", "dnf_rate": "no_known_label", "venue_form": "venue_not_seen", "qualifying_form": "no_prior_event"}
    reasons = quality.missing_reasons({f: [(F.col("seen").isNull(), "no_prior_event"), (F.lit(True), r)] for f, r in why.items()})
    return d.select(*KEY, *[F.round(f, 6).alias(f) for f in why], F.array_join(F.array_sort(F.transform(F.map_entries(reasons), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("reasons"))


@query("B21_missing_reasons", "SELECT league, day, driver_id, coalesce(CASE WHEN label_position IS NULL THEN 'ledger' END, CASE WHEN label_dnf IS NULL THEN 'constructor' END, CASE WHEN user_id % 4 = 0 THEN 'window' END, 'none') AS reason FROM {results}")
def _(t):
    c = F.expr
    return t("results").select(*KEY, F.coalesce(F.when(c("label_position is null"), "ledger"), F.when(c("label_dnf is null"), "constructor"), F.when(c("user_id % 4 = 0"), "window"), F.lit("none")).alias("reason"))


@query("B23_grid_override", "SELECT r.league, r.day, r.driver_id, coalesce(p.position, r.qualifying_position) AS grid, p.position IS NOT NULL AS overridden FROM {results} r LEFT JOIN {publications} p ON p.league = r.league AND p.day = r.day AND p.driver_id = r.driver_id AND p.version = 2 AND NOT p.recalled")
def _(t):
    audited = t("publications").filter("version = 2 and not recalled").select(*KEY, "position")
    return t("results").join(audited, KEY, "left").select(*KEY, F.coalesce("position", "qualifying_position").alias("grid"), F.col("position").isNotNull().alias("overridden"))


@query("B25_interval_containment", "SELECT a.league, a.day, CASE WHEN count(b.day) = 1 THEN max(b.day) END AS inside, count(b.day) AS matches FROM {starts} a LEFT JOIN {starts} b ON b.league = a.league AND b.cutoff > a.cutoff AND b.cutoff <= a.cutoff + INTERVAL 1 HOUR * (24 * (1 + a.day % 2)) GROUP BY a.league, a.day")
def _(t):
    a = t("starts").select("league", "day", "cutoff", (F.col("cutoff") + F.make_interval(hours=(24 * (1 + F.col("day") % 2)).cast("int"))).alias("until"))
    b = t("starts").select("league", F.col("day").alias("other"), F.col("cutoff").alias("at"))
    j = a.join(b, "league", "left").withColumn("hit", (F.col("at") > F.col("cutoff")) & (F.col("at") <= F.col("until")))
    g = j.groupBy(*EVENT).agg(F.count_if("hit").alias("matches"), F.max(F.when(F.col("hit"), F.col("other"))).alias("other"))
    return g.select(*EVENT, F.when(F.col("matches") == 1, F.col("other")).alias("inside"), "matches")


@query("B26_record_binding", "SELECT r.page_id, r.link_no, count(g.page_id) AS bound, CASE WHEN count(g.page_id) <> 1 THEN 'not_one_row' WHEN bool_or(g.recalled) THEN 'recalled' ELSE 'bound' END AS status FROM {registry} r LEFT JOIN {registry} g ON g.page_id = r.page_id AND g.title = r.title AND g.clock <= r.clock GROUP BY r.page_id, r.link_no")
def _(t):
    g = t("registry").select("page_id", "title", F.col("clock").alias("at"), F.col("recalled").alias("gone"))
    j = t("registry").join(g, ["page_id", "title"], "left").filter("at <= clock")
    b = j.groupBy("page_id", "link_no").agg(F.count("at").alias("bound"), F.bool_or("gone").alias("gone"))
    return b.select("page_id", "link_no", "bound", F.when(F.col("bound") != 1, "not_one_row").when(F.col("gone"), "recalled").otherwise("bound").alias("status"))


@query("B28_same_payload_fallback", "WITH p AS (SELECT league, day, driver_id, position % 3 AS h, captured_at, cutoff FROM {publications}), n AS (SELECT league, day, driver_id, max_by(h, captured_at) AS h, max(captured_at) AS last, max(cutoff) AS cutoff FROM p GROUP BY ALL) SELECT n.league, n.day, n.driver_id, CAST(max(p.captured_at) AS VARCHAR) AS used FROM n LEFT JOIN p ON p.league = n.league AND p.day = n.day AND p.driver_id = n.driver_id AND p.h = n.h AND p.captured_at <= n.cutoff GROUP BY ALL")
def _(t):
    p = t("publications").select(*KEY, F.expr("position % 3").alias("h"), "captured_at", "cutoff")
    newest = p.groupBy(*KEY).agg(F.max_by("h", "captured_at").alias("h"))
    known = p.filter(asof.known_by("captured_at", "cutoff")).groupBy(*KEY, "h").agg(F.max("captured_at").alias("used"))
    return newest.join(known, [*KEY, "h"], "left").select(*KEY, F.col("used").cast("string").alias("used"))


@query("B29_roster_precedence", f"WITH {PRIOR}, l AS (SELECT league, day, driver_id, max_by(constructor_id, prior) AS known FROM p GROUP BY ALL) SELECT r.league, r.day, r.driver_id, coalesce(CASE WHEN r.user_id % 3 = 0 THEN r.constructor_id END, l.known, r.constructor_id) AS team, CASE WHEN r.user_id % 3 = 0 THEN 'session' WHEN l.known IS NOT NULL THEN 'latest_roster' ELSE 'entry' END AS source FROM {{results}} r LEFT JOIN l USING (league, day, driver_id)")
def _(t):
    session = t("results").filter("user_id % 3 = 0").select(*KEY, F.col("constructor_id").alias("own"))
    known = history.known(facts(t), asked(t), ["league", "driver_id"], "label_available_at", "target_cutoff", latest={"h": (1, ["prior", "constructor_id"])}).filter(F.size("h") > 0).select(*KEY, F.col("h")[0]["constructor_id"].alias("known"))
    j = t("results").select(*KEY, "constructor_id").join(session, KEY, "left").join(known, KEY, "left")
    return j.select(*KEY, F.coalesce("own", "known", "constructor_id").alias("team"), F.when(F.col("own").isNotNull(), "session").when(F.col("known").isNotNull(), "latest_roster").otherwise("entry").alias("source"))


@query("B30_sprint_rows", f"WITH {PRIOR} SELECT p.league, p.day, p.driver_id, round(avg(p.label_position), 6) AS form, CASE WHEN max(r.season) < 2025 THEN max(r.qualifying_position) ELSE max(r.qualifying_position) + 1 END AS grid FROM p JOIN {{results}} r ON r.league = p.league AND r.day = p.day AND r.driver_id = p.driver_id WHERE r.round % 4 = 0 GROUP BY ALL")
def _(t):
    r = t("results").filter("round % 4 = 0").select(*KEY, F.expr("case when season < 2025 then qualifying_position else qualifying_position + 1 end").alias("grid"))
    return running(t).select(*KEY, F.round(history.mean("places", "finishes"), 6).alias("form")).join(r, KEY)
