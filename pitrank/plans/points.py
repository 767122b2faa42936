"""Queries of the points ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitrank.operators import ledger
from pitrank.plans.registry import query

EVENT = ["league", "day"]
LATEST = """v AS (SELECT DISTINCT league, season, day, round, version, completed_at, effective_at, status FROM {points}),
c AS (SELECT * FROM (SELECT t.league, t.day, t.season, t.round AS own, v.day AS prior, v.round, v.version, v.status, row_number() OVER (PARTITION BY t.league, t.day, v.round ORDER BY v.effective_at DESC) AS k
  FROM {starts} t JOIN v ON v.league = t.league AND v.season = t.season AND v.round < t.round AND v.completed_at < t.cutoff AND v.effective_at < t.cutoff) WHERE k = 1),
g AS (SELECT league, day, any_value(own) AS own, count(*) AS rounds, count(*) FILTER (WHERE status = 'disputed') AS disputed FROM c GROUP BY league, day HAVING count(*) = any_value(own) - 1),
s AS (SELECT c.league, c.day, p.driver_id, p.constructor_id, p.points, p.position, c.round FROM c JOIN {points} p ON p.league = c.league AND p.season = c.season AND p.round = c.round AND p.version = c.version)"""


@query("D01_rule_lookup", """SELECT s.league, s.day, s.season, s.round, r.points AS win_points, s.round > 12 AS continued FROM {starts} s JOIN {rules} r ON r.season = s.season AND r.place = 1 AND s.round >= r.first_round AND (s.round <= r.last_round OR r.last_round = 12)""")
def _(t):
    rules = t("rules").filter("place = 1").withColumnRenamed("points", "win_points")
    return ledger.rule_for(t("starts").select("league", "day", "season", "round"), rules, "season", "round", ["win_points"])


@query("D02_versions_timeline", """WITH i AS (SELECT DISTINCT league, day, effective_at AS instant FROM {points}) SELECT i.league, i.day, CAST(i.instant AS VARCHAR) AS instant, p.driver_id, max_by(p.points, p.effective_at) AS points, max_by(p.status, p.effective_at) AS status FROM i JOIN {points} p ON p.league = i.league AND p.day = i.day AND p.effective_at <= i.instant GROUP BY ALL""")
def _(t):
    p = t("points")
    at = p.select(*EVENT, F.col("effective_at").alias("instant")).distinct()
    d = ledger.known_versions(p.select(*EVENT, "driver_id", "effective_at", "points", "status"), EVENT, "driver_id", at, "effective_at", ["points", "status"])
    return d.withColumn("instant", F.col("instant").cast("string"))


@query("D03_standings_before", f"""WITH {LATEST}, m AS (SELECT league, day, driver_id, sum(points) AS total FROM s GROUP BY ALL), l AS (SELECT league, day, max(total) AS lead FROM m GROUP BY ALL)
SELECT r.league, r.day, r.driver_id, CASE WHEN g.rounds IS NOT NULL THEN coalesce(m.total, 0) END AS points_before, CASE WHEN g.rounds IS NOT NULL THEN l.lead - m.total END AS gap, CASE WHEN g.rounds IS NULL AND r.round > 1 THEN 'audited_prior_event_missing_or_uncertain' END AS reason
FROM {{results}} r LEFT JOIN g USING (league, day) LEFT JOIN m USING (league, day, driver_id) LEFT JOIN l USING (league, day)""")
def _(t):
    return ledger.standings(t("points"), t("starts"), t("results"), ["league", "season"], "round", EVENT, "cutoff", "driver_id").drop("standing")


@query("D04_countback", f"""WITH {LATEST}, m AS (SELECT league, day, driver_id, sum(points) AS total, list_transform(range(1, 21), lambda i: len(list_filter(list(position), lambda q: q = i))) AS places FROM s GROUP BY ALL),
k AS (SELECT m.*, (SELECT count(*) FROM m o WHERE o.league = m.league AND o.day = m.day AND (o.total > m.total OR (o.total = m.total AND o.places > m.places))) AS above, (SELECT count(*) FROM m o WHERE o.league = m.league AND o.day = m.day AND o.total = m.total AND o.places = m.places) AS same FROM m)
SELECT r.league, r.day, r.driver_id, CASE WHEN g.rounds IS NOT NULL AND k.same = 1 THEN k.above + 1 END AS standing FROM {{results}} r LEFT JOIN g USING (league, day) LEFT JOIN k USING (league, day, driver_id)""")
def _(t):
    return ledger.standings(t("points"), t("starts"), t("results"), ["league", "season"], "round", EVENT, "cutoff", "driver_id").select(*EVENT, "driver_id", "standing")


@query("D05_points_in_last", """SELECT a.league, a.season, a.driver_id, a.round, CASE WHEN a.round > 3 THEN coalesce(sum(b.points), 0) END AS last_points FROM {points} a LEFT JOIN {points} b ON b.version = 1 AND b.league = a.league AND b.season = a.season AND b.driver_id = a.driver_id AND b.round BETWEEN a.round - 3 AND a.round - 1 WHERE a.version = 1 GROUP BY a.league, a.season, a.driver_id, a.round""")
def _(t):
    p = t("points").filter("version = 1").select("league", "season", "driver_id", "round", "points")
    return ledger.points_in_last(p, ["league", "season", "driver_id"], "round", 3).drop("points")


@query("D06_published_standings", """WITH l AS (SELECT league, season, driver_id, day, max_by(points, version) AS points, bool_or(status = 'disputed') AS disputed FROM {points} GROUP BY league, season, driver_id, day), q AS (SELECT DISTINCT league, driver_id FROM {results})
SELECT q.league, s.season, q.driver_id, coalesce(sum(l.points), 0) AS points, count(l.day) FILTER (WHERE l.disputed) AS disputed FROM q CROSS JOIN (SELECT DISTINCT season FROM {results}) s LEFT JOIN l ON l.league = q.league AND l.season = s.season AND l.driver_id = q.driver_id GROUP BY q.league, s.season, q.driver_id""")
def _(t):
    newest = t("points").groupBy("league", "season", "driver_id", "day").agg(F.max_by("points", "version").alias("points"), F.bool_or(F.col("status") == "disputed").alias("disputed"))
    sums = newest.groupBy("league", "season", "driver_id").agg(F.sum("points").alias("points"), F.count_if("disputed").alias("disputed"))
    roster = t("results").select("league", "driver_id").distinct().crossJoin(F.broadcast(t("rules").select("season").distinct()))
    return roster.join(sums, ["league", "season", "driver_id"], "left").na.fill(0, ["points", "disputed"])


@query("D07_award_points", """SELECT r.league, r.day, r.driver_id, CASE WHEN r.user_id % 9 = 0 THEN 0 ELSE coalesce(w.points, 0) END AS points FROM {results} r LEFT JOIN {rules} w ON w.season = r.season AND w.place = r.label_position AND w.first_round = 1""")
def _(t):
    rules = t("rules").filter("first_round = 1").select("season", "place", "points")
    d = ledger.award(t("results").withColumnRenamed("label_position", "place"), rules, ["season"], "place", F.expr("user_id % 9 <> 0"))
    return d.select(*EVENT, "driver_id", "points")


@query("D08_ledger_validation", """SELECT 'duplicate_recipient' AS problem, count(*) AS n FROM (SELECT 1 FROM {points} GROUP BY league, day, version, driver_id HAVING count(*) > 1) UNION ALL SELECT 'award_not_in_schedule', count(*) FROM {points} WHERE points NOT IN (25, 18, 15, 12, 10, 8, 6, 4, 2, 1, 0) UNION ALL
SELECT 'completion_times', count(*) FROM (SELECT 1 FROM {points} GROUP BY league, day HAVING count(DISTINCT completed_at) > 1) UNION ALL SELECT 'overlapping_rules', count(*) FROM {rules} a JOIN {rules} b ON a.season = b.season AND a.place = b.place AND a.first_round < b.first_round AND a.last_round >= b.first_round""")
def _(t):
    p, r = t("points"), t("rules")
    n = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    later = r.select("season", "place", F.col("first_round").alias("f2"))
    parts = [
        n(p.groupBy(*EVENT, "version", "driver_id").count().filter("count > 1"), "duplicate_recipient"),
        n(p.filter(~F.col("points").isin(25, 18, 15, 12, 10, 8, 6, 4, 2, 1, 0)), "award_not_in_schedule"),
        n(p.groupBy(*EVENT).agg(F.countDistinct("completed_at").alias("k")).filter("k > 1"), "completion_times"),
        n(r.join(later, ["season", "place"]).filter("first_round < f2 and last_round >= f2"), "overlapping_rules"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("D09_reconciliation", """WITH o AS (SELECT league, day, constructor_id, sum(points) AS summed FROM {points} WHERE version = 1 GROUP BY ALL) SELECT o.league, o.day, o.constructor_id, o.summed, m.points AS stated FROM o JOIN {team_matrix} m USING (league, day, constructor_id) WHERE o.summed <> m.points""")
def _(t):
    return ledger.reconciled(t("points").filter("version = 1"), t("team_matrix"), [*EVENT, "constructor_id"])


@query("D10_season_checks", """WITH a AS (SELECT league, season, sum(points) AS ledger FROM {points} WHERE version = 1 GROUP BY ALL), b AS (SELECT league, season, sum(points) AS cells FROM {team_matrix} GROUP BY ALL) SELECT league, season, ledger, cells, ledger = cells AS agrees FROM a JOIN b USING (league, season)""")
def _(t):
    a = t("points").filter("version = 1").groupBy("league", "season").agg(F.sum("points").alias("ledger"))
    b = t("team_matrix").groupBy("league", "season").agg(F.sum("points").alias("cells"))
    return a.join(b, ["league", "season"], "full").withColumn("agrees", F.col("ledger").eqNullSafe(F.col("cells")))


@query("D11_timeline_changes", """SELECT league, day, driver_id, 1 + max(CASE WHEN version = 2 AND points <> p1 THEN 1 ELSE 0 END) AS changes, max(CASE WHEN version = 2 AND points <> p1 THEN 2 ELSE 1 END) AS stable_from, max_by(points, version) AS final FROM (SELECT *, first_value(points) OVER (PARTITION BY league, day, driver_id ORDER BY version) AS p1 FROM {points}) GROUP BY league, day, driver_id""")
def _(t):
    d = ledger.change_points(t("points"), [*EVENT, "driver_id"], "version", "points")
    return d.withColumn("stable_from", F.col("stable_from").cast("int")).withColumn("changes", F.col("changes").cast("int"))


@query("D12_remaining_sessions", """SELECT s.league, s.day, count(*) AS remaining, count(*) FILTER (WHERE kind = 'sprint') AS sprints FROM {starts} s JOIN (SELECT league, season, cutoff AS at, 'race' AS kind FROM {starts} UNION ALL SELECT league, season, cutoff - INTERVAL 20 HOUR, 'sprint' FROM {starts} WHERE round % 4 = 0) x ON x.league = s.league AND x.season = s.season AND x.at > s.cutoff GROUP BY s.league, s.day""")
def _(t):
    s = t("starts")
    sprint = F.when(F.col("round") % 4 == 0, F.col("cutoff") - F.expr("INTERVAL 20 HOUR"))
    long = s.select("league", "season", F.col("cutoff").alias("race"), sprint.alias("sprint")).unpivot(["league", "season"], ["race", "sprint"], "kind", "at").filter("at is not null")
    j = s.select("league", "season", "day", "cutoff").join(long, ["league", "season"]).filter("at > cutoff")
    return j.groupBy(*EVENT).agg(F.count("*").alias("remaining"), F.count_if(F.col("kind") == "sprint").alias("sprints"))


@query("D13_first_blocking_round", f"""WITH {LATEST} SELECT t.league, t.day, min(e.round) AS first_blocking FROM {{starts}} t JOIN {{starts}} e ON e.league = t.league AND e.season = t.season AND e.round < t.round WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.league = t.league AND c.day = t.day AND c.round = e.round) GROUP BY t.league, t.day""")
def _(t):
    s = t("starts")
    have = ledger.versions_before(t("points"), s, ["league", "season"], "round", EVENT, "cutoff").select(*EVENT, "round")
    need = s.select("league", "season", "day", F.col("round").alias("own")).join(s.select("league", "season", "round"), ["league", "season"]).filter("round < own")
    return need.join(have, [*EVENT, "round"], "left_anti").groupBy(*EVENT).agg(F.min("round").alias("first_blocking"))


@query("D14_final_standings", """WITH m AS (SELECT league, season, driver_id, sum(points) AS points FROM {points} WHERE version = 1 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY points DESC, driver_id) AS place, count(*) OVER (PARTITION BY league, season, points) > 1 AS tied_on_points FROM m""")
def _(t):
    m = t("points").filter("version = 1").groupBy("league", "season", "driver_id").agg(F.sum("points").alias("points"))
    return ledger.final_order(m, ["league", "season"], "points", "driver_id")


@query("D15_ledger_features", f"""WITH {LATEST} SELECT r.season, count(*) AS n, count(g.rounds) AS covered, count(*) FILTER (WHERE g.rounds IS NULL AND r.round > 1) AS missing, count(*) FILTER (WHERE g.disputed > 0) AS under_appeal FROM {{results}} r LEFT JOIN g USING (league, day) GROUP BY r.season""")
def _(t):
    gate = ledger.open_ledgers(ledger.versions_before(t("points"), t("starts"), ["league", "season"], "round", EVENT, "cutoff"), EVENT)
    d = t("results").join(gate, EVENT, "left")
    return d.groupBy("season").agg(F.count("*").alias("n"), F.count("rounds").alias("covered"), F.count_if(F.col("rounds").isNull() & (F.col("round") > 1)).alias("missing"), F.count_if(F.col("disputed") > 0).alias("under_appeal"))


@query("D16_weekend_split", """WITH x AS (SELECT r.league, r.day, r.driver_id, p.points AS total, CASE WHEN r.round % 4 <> 0 THEN 0 WHEN r.user_id % 3 = 0 THEN least(p.points, 8) WHEN r.user_id % 3 = 1 THEN least(p.points, 4) ELSE 0 END AS sprint, CASE WHEN r.round % 4 <> 0 THEN 'no_sprint' WHEN r.user_id % 3 = 0 THEN 'own_document' WHEN r.user_id % 3 = 1 THEN 'second_source' ELSE 'zero_total' END AS quality FROM {results} r JOIN {points} p ON p.league = r.league AND p.day = r.day AND p.driver_id = r.driver_id AND p.version = 1)
SELECT league, day, driver_id, CAST(sprint AS DOUBLE) AS sprint, total - sprint AS race, quality FROM x""")
def _(t):
    r, key = t("results"), [*EVENT, "driver_id"]
    p = t("points").filter("version = 1").select(*key, F.col("points").alias("total"))
    sprint = r.filter("round % 4 = 0").select(*key, "user_id").join(p, key)
    own = sprint.filter("user_id % 3 = 0").select(*key, F.least("total", F.lit(8.0)).alias("own"))
    second = sprint.filter("user_id % 3 = 1").select(*key, F.least("total", F.lit(4.0)).alias("second"))
    d = r.select(*key, "round").join(p, key).join(own, key, "left").join(second, key, "left")
    quality = F.when(F.col("round") % 4 != 0, "no_sprint").when(F.col("own").isNotNull(), "own_document").when(F.col("second").isNotNull(), "second_source").otherwise("zero_total")
    points = F.coalesce("own", "second", F.lit(0.0))
    return d.select(*key, points.alias("sprint"), (F.col("total") - points).alias("race"), quality.alias("quality"))
