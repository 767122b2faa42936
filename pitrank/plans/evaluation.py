"""Queries of evaluation, selection and draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitrank.operators import draws, evaluate, ledger
from pitrank.plans.pointintime import EVENT
from pitrank.plans.registry import query

def won():
    return F.coalesce(F.col("label_position") == 1, F.lit(False))


CLIP = "least(greatest(p_win, 1e-15), 1 - 1e-15)"
U = "((('0x' || substr(md5({}), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
LOSS = f"l AS (SELECT league, day, model, -ln({CLIP}) AS loss FROM {{predictions}} WHERE label_position = 1)"


def losses(t):
    return t("predictions").filter("label_position = 1").select(*EVENT, "model", (-F.log(evaluate.clipped("p_win"))).alias("loss"))


@query("H01_binary_metrics", f"SELECT model, round(avg(-CASE WHEN coalesce(label_position = 1, false) THEN ln({CLIP}) ELSE ln(1 - {CLIP}) END), 6) AS log_loss, round(avg((p_win - CAST(coalesce(label_position = 1, false) AS INT)) ** 2), 6) AS brier, count(*) AS n, false AS insufficient FROM {{predictions}} GROUP BY model")
def _(t):
    return evaluate.binary_metrics(t("predictions"), ["model"], "p_win", won())


@query("H02_winner_metrics", f"WITH r AS (SELECT *, coalesce(label_position = 1, false) AS won, row_number() OVER (PARTITION BY model, league, day ORDER BY p_win DESC, driver_id) AS r FROM {{predictions}}), e AS (SELECT model, league, day, sum(-ln({CLIP})) FILTER (WHERE won) AS loss, sum((p_win - CAST(won AS INT)) ** 2) AS brier, max(CAST(r = 1 AS INT)) FILTER (WHERE won) AS top1, max(CAST(r <= 3 AS INT)) FILTER (WHERE won) AS top3 FROM r GROUP BY ALL) SELECT model, round(avg(loss), 6) AS loss, round(avg(brier), 6) AS brier, round(avg(top1), 6) AS top1, round(avg(top3), 6) AS top3, count(*) AS events FROM e GROUP BY model")
def _(t):
    e = evaluate.winner_metrics(t("predictions"), ["model"], EVENT, "p_win", won(), "driver_id")
    return e.groupBy("model").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("loss", "brier", "top1", "top3")], F.count("*").alias("events"))


@query("H03_position_mae", "SELECT model, round(avg(abs(place - label_position)), 6) AS mae, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY model, league, day ORDER BY p_win DESC, driver_id) AS place FROM {predictions}) WHERE label_position IS NOT NULL GROUP BY model")
def _(t):
    w = Window.partitionBy("model", *EVENT).orderBy(F.desc("p_win"), "driver_id")
    d = t("predictions").withColumn("place", F.row_number().over(w)).filter("label_position is not null")
    return d.groupBy("model").agg(F.round(F.avg(F.abs(F.col("place") - F.col("label_position"))), 6).alias("mae"), F.count("*").alias("n"))


@query("H04_ranked_probability", "WITH g AS (SELECT league, day, driver_id, label_position AS actual, entrants, unnest(range(1, entrants + 1)) AS place FROM {predictions} WHERE model = 'grid' AND label_position IS NOT NULL) SELECT league, day, driver_id, round(avg((place / entrants - CAST(actual <= place AS INT)) ** 2), 6) AS rps FROM g WHERE place < entrants GROUP BY ALL")
def _(t):
    d = t("predictions").filter("model = 'grid' and label_position is not null").select(*EVENT, "driver_id", "label_position", F.explode(F.expr("sequence(1L, entrants)")).alias("place"), (1 / F.col("entrants")).alias("p"))
    return evaluate.ranked_probability(d, [*EVENT, "driver_id"], "place", "p", "label_position")


@query("H05_pairwise_accuracy", "SELECT a.league, a.day, a.model, round(avg(CASE WHEN a.p_win = b.p_win THEN 0.5 WHEN (a.p_win > b.p_win) = (a.label_position < b.label_position) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS pairs FROM {predictions} a JOIN {predictions} b ON a.league = b.league AND a.day = b.day AND a.model = b.model AND a.driver_id < b.driver_id WHERE a.label_position IS NOT NULL AND b.label_position IS NOT NULL GROUP BY ALL")
def _(t):
    return evaluate.pairwise(t("predictions"), [*EVENT, "model"], "driver_id", "p_win", "label_position")


BINS = "b AS (SELECT model, CAST(least(floor(p_win * 10), 9) AS BIGINT) AS bin, round(avg(p_win), 6) AS mean_p, round(avg(CAST(coalesce(label_position = 1, false) AS INT)), 6) AS share, count(*) AS n FROM {predictions} GROUP BY ALL)"


@query("H06_reliability", f"WITH {BINS} SELECT * FROM b")
def _(t):
    return evaluate.reliability(t("predictions"), ["model"], "p_win", won())


@query("H06_calibration_error", f"WITH {BINS} SELECT model, round(sum(abs(mean_p - share) * n) / sum(n), 6) AS ece FROM b GROUP BY model")
def _(t):
    return evaluate.calibration_error(evaluate.reliability(t("predictions"), ["model"], "p_win", won()), ["model"])


@query("H06_document_scores", "SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS share, count(*) AS n FROM {scores} GROUP BY ALL")
def _(t):
    return evaluate.reliability(t("scores"), [], "p", F.col("y") == 1)


@query("H07_uneven_bins", "SELECT model, CAST(CASE WHEN p_win < 0.02 THEN 0 WHEN p_win < 0.05 THEN 1 WHEN p_win < 0.2 THEN 2 ELSE 3 END AS BIGINT) AS bin, round(avg(p_win), 6) AS mean_p, round(avg(CAST(coalesce(label_position = 1, false) AS INT)), 6) AS share, count(*) AS n FROM {predictions} GROUP BY ALL")
def _(t):
    edges = F.expr("case when p_win < 0.02 then 0 when p_win < 0.05 then 1 when p_win < 0.2 then 2 else 3 end")
    return evaluate.reliability(t("predictions"), ["model"], "p_win", won(), edges)


@query("H07_top_choice", "SELECT model, round(avg(p), 6) AS confidence, round(avg(CAST(won AS INT)), 6) AS accuracy FROM (SELECT model, league, day, max(p_win) AS p, coalesce(arg_max(coalesce(label_position = 1, false), (p_win, driver_id)), false) AS won FROM {predictions} GROUP BY ALL) GROUP BY model")
def _(t):
    top = t("predictions").withColumn("won", won()).groupBy("model", *EVENT).agg(F.max("p_win").alias("p"), F.max_by("won", F.struct("p_win", "driver_id")).alias("won"))
    return top.groupBy("model").agg(F.round(F.avg("p"), 6).alias("confidence"), F.round(F.avg(F.col("won").cast("int")), 6).alias("accuracy"))


@query("H08_confident_errors", "SELECT model, count(*) FILTER (WHERE p_win > 0.25 AND NOT coalesce(label_position = 1, false)) AS errors, count(*) FILTER (WHERE p_win < 0.02 AND label_position = 1) AS unlikely_hits FROM {predictions} GROUP BY model")
def _(t):
    return t("predictions").groupBy("model").agg(F.count_if((F.col("p_win") > 0.25) & ~won()).alias("errors"), F.count_if((F.col("p_win") < 0.02) & won()).alias("unlikely_hits"))


SHARP = "s AS (SELECT model, league, day, sum(-p_win * ln(p_win)) AS h, max(p_win) AS m, avg(CAST(p_win < 0.02 AS INT)) AS sm FROM {predictions} GROUP BY ALL)"


@query("H09_sharpness", f"WITH {SHARP} SELECT model, league, day, round(h, 6) AS entropy, round(exp(h), 6) AS contenders, round(m, 6) AS largest, round(sm, 6) AS small FROM s")
def _(t):
    return evaluate.sharpness(t("predictions"), ["model", *EVENT], "p_win")


@query("H10_sharpness_percentile", f"WITH {SHARP}, e AS (SELECT model, day, league, round(h, 6) AS entropy FROM s) SELECT a.model, a.league, round(avg(CAST(b.entropy <= a.entropy AS INT)), 6) AS percentile, count(*) AS reference FROM e a JOIN e b ON a.model = b.model AND b.day < 30 WHERE a.day = 30 GROUP BY ALL")
def _(t):
    e = evaluate.sharpness(t("predictions"), ["model", *EVENT], "p_win").select("model", *EVENT, "entropy")
    live, past = e.filter("day = 30"), e.filter("day < 30").select("model", F.col("entropy").alias("past"))
    return live.join(past, "model").groupBy("model", "league").agg(F.round(F.avg((F.col("past") <= F.col("entropy")).cast("int")), 6).alias("percentile"), F.count("*").alias("reference"))


@query("H11_paired_losses", f"WITH {LOSS} SELECT a.league, a.day, round(a.loss - b.loss, 6) AS delta FROM l a JOIN l b USING (league, day) WHERE a.model = 'form' AND b.model = 'grid'")
def _(t):
    return evaluate.paired(losses(t), EVENT, "model", "loss", "form", "grid").select(*EVENT, F.round("delta", 6).alias("delta"))


@query("H12_bootstrap", f"""WITH {LOSS}, d AS (SELECT a.league * 100 + a.day AS e, round(a.loss - b.loss, 6) AS delta, row_number() OVER (ORDER BY a.league * 100 + a.day) - 1 AS i FROM l a JOIN l b USING (league, day) WHERE a.model = 'form' AND b.model = 'grid'),
k AS (SELECT b.b, ('0x' || substr(md5('7|' || b.b || '|' || d.i), 1, 8))::BIGINT % (SELECT count(*) FROM d) AS i FROM range(2000) b(b) CROSS JOIN d), m AS (SELECT k.b, avg(d.delta) AS m FROM k JOIN d USING (i) GROUP BY k.b)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(m), 6) AS middle FROM m""")
def _(t):
    d = evaluate.paired(losses(t), EVENT, "model", "loss", "form", "grid").select(F.expr("league * 100 + day").alias("e"), F.round("delta", 6).alias("delta"))
    return evaluate.bootstrap(d, "e", "delta", 2000, 7)


@query("H13_common_cohort", "SELECT league, day FROM {predictions} WHERE model = 'grid' OR day % 2 = 0 GROUP BY league, day HAVING count(DISTINCT model) = 2")
def _(t):
    return evaluate.common(t("predictions").filter("model = 'grid' or day % 2 = 0"), EVENT, "model", 2)


@query("H14_regressions", f"WITH {LOSS}, m AS (SELECT model, league, avg(loss) AS loss FROM l GROUP BY ALL) SELECT a.league, round(a.loss - b.loss, 6) AS delta, a.loss > b.loss + 1e-12 AS regressed FROM m a JOIN m b USING (league) WHERE a.model = 'form' AND b.model = 'grid'")
def _(t):
    m = losses(t).groupBy("league").pivot("model", ["form", "grid"]).agg(F.avg("loss"))
    return m.select("league", F.round(F.col("form") - F.col("grid"), 6).alias("delta"), (F.col("form") > F.col("grid") + 1e-12).alias("regressed"))


@query("H15_task_gate", f"WITH {LOSS}, d AS (SELECT a.league, a.loss - b.loss AS delta FROM l a JOIN l b USING (league, day) WHERE a.model = 'form' AND b.model = 'grid') SELECT league, count(*) AS events, CASE WHEN count(*) < 25 THEN 'too_few_events' WHEN avg(delta) > 0 THEN 'no_selection' ELSE 'provisional' END AS verdict FROM d GROUP BY league")
def _(t):
    d = evaluate.paired(losses(t), EVENT, "model", "loss", "form", "grid")
    verdict = F.when(F.count("*") < 25, "too_few_events").when(F.avg("delta") > 0, "no_selection").otherwise("provisional")
    return d.groupBy("league").agg(F.count("*").alias("events"), verdict.alias("verdict"))


@query("H16_mean_rank", f"WITH {LOSS}, m AS (SELECT league, model, avg(loss) AS loss FROM l GROUP BY ALL), r AS (SELECT model, row_number() OVER (PARTITION BY league ORDER BY loss, model) AS r FROM m), a AS (SELECT model, round(avg(r), 6) AS mean_rank FROM r GROUP BY model) SELECT *, row_number() OVER (ORDER BY mean_rank, model) = 1 AS chosen FROM a")
def _(t):
    return evaluate.mean_rank(losses(t).groupBy("league", "model").agg(F.avg("loss").alias("loss")), "league", "model", "loss")


@query("H17_objective", f"SELECT model, league, day, round(sum(CASE WHEN label_position = 1 THEN -ln({CLIP}) ELSE 0 END) + avg(-CASE WHEN coalesce(label_position <= 3, false) THEN ln(least(greatest(least(3 * p_win, 1), 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(least(3 * p_win, 1), 1e-15), 1 - 1e-15)) END) / 3, 6) AS objective FROM {{predictions}} GROUP BY ALL")
def _(t):
    d = t("predictions").withColumn("p_podium", F.least(3 * F.col("p_win"), F.lit(1.0)))
    podium = F.coalesce(F.col("label_position") <= 3, F.lit(False))
    win = F.sum(F.when(won(), -F.log(evaluate.clipped("p_win"))).otherwise(0.0))
    return d.groupBy("model", *EVENT).agg(F.round(win + F.avg(evaluate.log_loss("p_podium", podium)) / 3, 6).alias("objective"))


GRID = f"g AS (SELECT league, day, cell, -ln(least(greatest((1 - cell * 0.1) * p_win + cell * 0.1 / entrants, 1e-15), 1 - 1e-15)) AS loss FROM {{predictions}} CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS cell) WHERE model = 'form' AND label_position = 1)"


@query("H18_prequential_grid", f"WITH {GRID}, m AS (SELECT a.league, a.day, a.cell, round(avg(b.loss), 9) AS mean, count(b.day) AS k FROM g a LEFT JOIN g b ON a.league = b.league AND a.cell = b.cell AND b.day < a.day GROUP BY ALL) SELECT league, day, CASE WHEN max(k) >= 5 THEN arg_min(cell, (coalesce(mean, 0), cell)) ELSE 0 END AS cell, max(k) AS earlier FROM m GROUP BY league, day")
def _(t):
    p = t("predictions").filter("model = 'form' and label_position = 1").select(*EVENT, "p_win", "entrants", F.explode(F.array(*map(F.lit, range(4)))).alias("cell"))
    p = p.withColumn("q", F.expr("(1 - cell * 0.1D) * p_win + cell * 0.1D / entrants")).withColumn("loss", -F.log(evaluate.clipped("q")))
    return evaluate.best_earlier(p, ["league"], "day", "cell", "loss", 5)


@query("H19_prequential_choice", f"WITH {LOSS}, m AS (SELECT a.league, a.day, a.model, round(avg(b.loss), 9) AS mean FROM l a JOIN l b ON a.league = b.league AND a.model = b.model AND b.day < a.day GROUP BY ALL HAVING count(*) >= 10) SELECT league, day, arg_min(model, (mean, model)) AS chosen FROM m GROUP BY ALL")
def _(t):
    w = Window.partitionBy("league", "model").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    d = losses(t).withColumn("mean", F.round(F.avg("loss").over(w), 9)).withColumn("k", F.count("loss").over(w)).filter("k >= 10")
    return d.groupBy(*EVENT).agg(F.min(F.struct("mean", "model"))["model"].alias("chosen"))


@query("H21_intraclass_correlation", """WITH r AS (SELECT driver_id, season, CAST(qualifying_position - label_position AS DOUBLE) AS x FROM {results} WHERE label_position IS NOT NULL), g AS (SELECT driver_id, season, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM r GROUP BY ALL HAVING count(*) >= 3),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum((n - 1) * v) AS ssw, sum(n * n) AS nn FROM g), q AS (SELECT k, n, (nmm - nm * nm / n) / (k - 1) AS b, ssw / (n - k) AS w, (n - nn / n) / (k - 1) AS z FROM s) SELECT k, CAST(n AS BIGINT) AS n, round((b - w) / (b + (z - 1) * w), 6) AS icc FROM q""")
def _(t):
    d = t("results").filter("label_position is not null").withColumn("x", F.expr("cast(qualifying_position - label_position as double)"))
    return evaluate.intraclass(d, ["driver_id", "season"], "x")


@query("H22_cluster_bootstrap", """WITH c AS (SELECT driver_id, avg(CAST(qualifying_position - label_position AS DOUBLE)) AS x, row_number() OVER (ORDER BY driver_id) - 1 AS i FROM {results} WHERE label_position IS NOT NULL GROUP BY driver_id),
k AS (SELECT b.b, ('0x' || substr(md5('11|' || b.b || '|' || c.i), 1, 8))::BIGINT % (SELECT count(*) FROM c) AS i FROM range(200) b(b) CROSS JOIN c), m AS (SELECT k.b, avg(c.x) AS m FROM k JOIN c USING (i) GROUP BY k.b) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(m), 6) AS middle FROM m""")
def _(t):
    c = t("results").filter("label_position is not null").groupBy("driver_id").agg(F.avg(F.expr("cast(qualifying_position - label_position as double)")).alias("x"))
    return evaluate.bootstrap(c, "driver_id", "x", 200, 11)


@query("H23_outside_training_range", "WITH s AS (SELECT min(score) AS a, max(score) AS b, min(n) AS c, max(n) AS d FROM {results} WHERE season = 2024) SELECT event_id || '/' || driver_id AS row_id, 'score' AS feature FROM {results}, s WHERE season = 2025 AND (score < a OR score > b) UNION ALL SELECT event_id || '/' || driver_id, 'n' FROM {results}, s WHERE season = 2025 AND (n < c OR n > d)")
def _(t):
    r = t("results").withColumn("row_id", F.concat_ws("/", "event_id", "driver_id"))
    return evaluate.outside_range(r.filter("season = 2025"), r.filter("season = 2024"), ["score", "n"], "row_id")


@query("H24_unseen_missingness", "WITH f AS (SELECT event_id || '/' || driver_id AS row_id, season, CAST((label_position IS NULL) AS INT)::VARCHAR || CAST((label_dnf IS NULL OR league = 3) AS INT)::VARCHAR || CAST((user_id = 7 AND season = 2025) AS INT)::VARCHAR AS pattern FROM {results}) SELECT pattern, row_id FROM f WHERE season = 2025 AND pattern NOT IN (SELECT pattern FROM f WHERE season = 2024)")
def _(t):
    r = t("results").withColumn("row_id", F.concat_ws("/", "event_id", "driver_id")).withColumn("label_dnf", F.expr("case when league <> 3 then label_dnf end")).withColumn("score", F.expr("case when not (user_id = 7 and season = 2025) then score end"))
    return evaluate.unseen_patterns(r.filter("season = 2025"), r.filter("season = 2024"), ["label_position", "label_dnf", "score"], "row_id")


@query("H26_predicted_vs_actual", "WITH p AS (SELECT *, row_number() OVER (PARTITION BY league, day ORDER BY p_win DESC, driver_id) AS place FROM {predictions} WHERE model = 'form') SELECT league, day, round(avg(abs(place - label_position)), 6) AS mae, count(*) FILTER (WHERE place = label_position) AS exact, count(*) FILTER (WHERE label_dnf) AS retirements FROM p GROUP BY ALL")
def _(t):
    w = Window.partitionBy(*EVENT).orderBy(F.desc("p_win"), "driver_id")
    p = t("predictions").filter("model = 'form'").withColumn("place", F.row_number().over(w))
    return p.groupBy(*EVENT).agg(F.round(F.avg(F.abs(F.col("place") - F.col("label_position"))), 6).alias("mae"), F.count_if(F.col("place") == F.col("label_position")).alias("exact"), F.count_if("label_dnf").alias("retirements"))


@query("H28_projected_standings", "WITH m AS (SELECT league, driver_id, sum(points) AS points FROM {points} WHERE version = 1 GROUP BY ALL) SELECT league, driver_id, points, row_number() OVER (PARTITION BY league ORDER BY points DESC, driver_id) AS place, points / max(points) OVER (PARTITION BY league) >= 0.8 AS contender FROM m")
def _(t):
    m = t("points").filter("version = 1").groupBy("league", "driver_id").agg(F.sum("points").alias("points"))
    w = Window.partitionBy("league")
    return m.select("*", F.row_number().over(w.orderBy(F.desc("points"), "driver_id")).cast("long").alias("place"), (F.col("points") / F.max("points").over(w) >= 0.8).alias("contender"))


@query("H29_shadow_scores", f"WITH {LOSS} SELECT s.model, round(avg(s.loss - o.loss), 6) AS difference, count(*) AS events FROM l s JOIN l o USING (league, day) WHERE o.model = 'grid' AND s.model <> 'grid' GROUP BY s.model")
def _(t):
    d = losses(t)
    official = d.filter("model = 'grid'").select(*EVENT, F.col("loss").alias("official"))
    return d.filter("model <> 'grid'").join(official, EVENT).groupBy("model").agg(F.round(F.avg(F.col("loss") - F.col("official")), 6).alias("difference"), F.count("*").alias("events"))


@query("H30_stage_attribution", "SELECT a.league, a.day, a.driver_id, round(b.p_win - a.p_win, 6) AS moved FROM {predictions} a JOIN {predictions} b USING (league, day, driver_id) WHERE a.model = 'form' AND b.model = 'grid'")
def _(t):
    p = t("predictions").groupBy(*EVENT, "driver_id").pivot("model", ["form", "grid"]).agg(F.max("p_win"))
    return p.select(*EVENT, "driver_id", F.round(F.col("grid") - F.col("form"), 6).alias("moved"))


@query("H31_worst_events", f"WITH {LOSS}, d AS (SELECT a.league, a.day, round(a.loss - b.loss, 6) AS delta FROM l a JOIN l b USING (league, day) WHERE a.model = 'form' AND b.model = 'grid') SELECT * FROM (SELECT league, day, delta, row_number() OVER (PARTITION BY league ORDER BY delta DESC, day) AS worst FROM d) WHERE worst <= 5")
def _(t):
    d = evaluate.paired(losses(t), EVENT, "model", "loss", "form", "grid").select(*EVENT, F.round("delta", 6).alias("delta"))
    return d.withColumn("worst", F.row_number().over(Window.partitionBy("league").orderBy(F.desc("delta"), "day")).cast("long")).filter("worst <= 5")


@query("H33_subset_comparison", "SELECT model, count(*) AS n, round(avg(p_win), 6) AS mean_p FROM {predictions} WHERE label_position - qualifying_position >= 5 GROUP BY model")
def _(t):
    return t("predictions").filter("label_position - qualifying_position >= 5").groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("p_win"), 6).alias("mean_p"))


@query("H34_latest_run", "SELECT league, day, max(version) AS latest, string_agg(CAST(version AS VARCHAR), ',' ORDER BY version) FILTER (WHERE NOT newest) AS superseded FROM (SELECT DISTINCT league, day, version, version = max(version) OVER (PARTITION BY league, day) AS newest FROM {publications}) GROUP BY ALL")
def _(t):
    v = t("publications").groupBy(*EVENT).agg(F.array_sort(F.collect_set("version")).alias("v"))
    old = F.expr("array_join(transform(slice(v, 1, size(v) - 1), x -> cast(x as string)), ',')")
    return v.select(*EVENT, F.array_max("v").alias("latest"), F.when(F.size("v") > 1, old).alias("superseded"))


RANKED = f"""u AS (SELECT league, league * 100 + day AS ev, driver_id, utility, p_dnf FROM {{utilities}}),
x AS (SELECT u.*, d.draw, {U.format("'5|' || ev || '|' || d.draw || '|' || driver_id || '|dnf'")} < p_dnf AS retired, utility / 1.0 + round(-ln(-ln({U.format("'5|' || ev || '|' || d.draw || '|' || driver_id || '|order'")})), 9) AS key FROM u CROSS JOIN range(32) d(draw)),
r AS (SELECT league, ev, driver_id, draw, retired, row_number() OVER (PARTITION BY ev, draw ORDER BY retired, key DESC, driver_id) AS place FROM x)"""


def utilities(t):
    return t("utilities").select("league", F.expr("league * 100 + day").alias("ev"), "driver_id", "utility", "p_dnf")


def ranked(t):
    return draws.rankings(utilities(t), "ev", "driver_id", "utility", 32, 5, p_dnf="p_dnf")


@query("G01_rankings", f"WITH {RANKED} SELECT ev, driver_id, draw, retired, place FROM r")
def _(t):
    return ranked(t).withColumn("draw", F.col("draw").cast("long"))


@query("G02_marginals", f"WITH {RANKED} SELECT ev, driver_id, round(avg(CAST(place = 1 AS INT)), 6) AS win, round(avg(CAST(place <= 3 AS INT)), 6) AS podium, round(avg(place), 6) AS mean_place, round(avg(CAST(retired AS INT)), 6) AS retirement FROM r GROUP BY ev, driver_id")
def _(t):
    return draws.marginals(ranked(t), "ev", "driver_id")


@query("G02_distribution", f"WITH {RANKED} SELECT ev, driver_id, place, round(count(*) / 32, 9) AS p FROM r GROUP BY ev, driver_id, place")
def _(t):
    return draws.distribution(ranked(t), "ev", "driver_id")


@query("G03_mixture", f"WITH {RANKED}, m AS (SELECT ev, driver_id, avg(CAST(place = 1 AS INT)) AS win FROM r GROUP BY ALL) SELECT ev, driver_id, round(0.9 * win + 0.1 / count(*) OVER (PARTITION BY ev), 6) AS win FROM m")
def _(t):
    m = ranked(t).groupBy("ev", "driver_id").agg(F.avg((F.col("place") == 1).cast("int")).alias("win"))
    return m.select("ev", "driver_id", F.round(F.lit(0.9) * F.col("win") + F.lit(0.1) / F.count("*").over(Window.partitionBy("ev")), 6).alias("win"))


@query("G06_pooled_utility", "SELECT league, day, driver_id, round(avg(ln(raw) / CASE model WHEN 'grid' THEN 1.5 ELSE 0.75 END), 6) AS pooled FROM {predictions} GROUP BY ALL")
def _(t):
    tau = F.when(F.col("model") == "grid", 1.5).otherwise(0.75)
    return t("predictions").groupBy(*EVENT, "driver_id").agg(F.round(F.avg(F.log("raw") / tau), 6).alias("pooled"))


TWO = f"""u AS (SELECT league * 100 + day AS ev, driver_id, utility FROM {{utilities}}), x AS (SELECT u.*, d.draw, utility / 0.8 + round(-ln(-ln({U.format("'9|' || ev || '|' || d.draw || '|' || driver_id || '|win'")})), 9) AS a, utility / 1.2 + round(-ln(-ln({U.format("'9|' || ev || '|' || d.draw || '|' || driver_id || '|rest'")})), 9) AS b FROM u CROSS JOIN range(16) d(draw)),
y AS (SELECT *, row_number() OVER (PARTITION BY ev, draw ORDER BY a DESC, driver_id) = 1 AS wins FROM x), r AS (SELECT ev, driver_id, draw, row_number() OVER (PARTITION BY ev, draw ORDER BY wins DESC, b DESC, driver_id) AS place FROM y)"""


@query("G05_two_stage", f"WITH {TWO} SELECT ev, driver_id, round(avg(CAST(place = 1 AS INT)), 6) AS win, round(avg(place), 6) AS mean_place FROM r GROUP BY ALL")
def _(t):
    d = draws.two_stage(utilities(t), "ev", "driver_id", "utility", 16, 9, 0.8, 1.2)
    return d.groupBy("ev", "driver_id").agg(F.round(F.avg((F.col("place") == 1).cast("int")), 6).alias("win"), F.round(F.avg("place"), 6).alias("mean_place"))


@query("G07_race_table", f"WITH {RANKED}, d AS (SELECT ev, driver_id, place, round(count(*) / 32, 9) AS p FROM r GROUP BY ALL), c AS (SELECT *, round(sum(p) OVER (PARTITION BY ev, driver_id ORDER BY place), 9) AS cum FROM d) SELECT ev, driver_id, arg_min(place, (-p, place)) AS likely, min(place) FILTER (WHERE cum >= 0.1) AS low, min(place) FILTER (WHERE cum >= 0.9) AS high FROM c GROUP BY ALL")
def _(t):
    return draws.interval(draws.distribution(ranked(t), "ev", "driver_id"), "ev", "driver_id")


@query("G08_predicted_order", f"WITH {RANKED}, q AS (SELECT ev, driver_id, draw, row_number() OVER (PARTITION BY ev, draw ORDER BY key DESC, driver_id) AS place FROM x), m AS (SELECT ev, driver_id, avg(place) AS e, avg(CAST(place = 1 AS INT)) AS w FROM q GROUP BY ALL) SELECT ev, driver_id, row_number() OVER (PARTITION BY ev ORDER BY e, w DESC, driver_id) AS predicted FROM m")
def _(t):
    clean = draws.rankings(utilities(t), "ev", "driver_id", "utility", 32, 5)
    m = clean.groupBy("ev", "driver_id").agg(F.avg("place").alias("e"), F.avg((F.col("place") == 1).cast("int")).alias("w"))
    return m.select("ev", "driver_id", F.row_number().over(Window.partitionBy("ev").orderBy("e", F.desc("w"), "driver_id")).cast("long").alias("predicted"))


FINALS = f"""{RANKED}, k AS (SELECT e.league, e.ev, s.scenario, ('0x' || substr(md5('3|' || e.ev || '|' || s.scenario || '|pick'), 1, 8))::BIGINT % 32 AS draw FROM (SELECT DISTINCT league, ev FROM r WHERE ev % 100 > 9) e CROSS JOIN range(16) s(scenario)),
w AS (SELECT k.league, k.scenario, r.driver_id, sum(coalesce(p.points, 0)) AS won FROM k JOIN r ON r.ev = k.ev AND r.draw = k.draw LEFT JOIN (SELECT s.league * 100 + s.day AS ev, place, points FROM {{starts}} s JOIN {{rules}} u ON u.season = s.season AND s.round >= first_round AND (s.round <= last_round OR last_round = 12)) p ON p.ev = r.ev AND p.place = r.place GROUP BY ALL),
c AS (SELECT league, driver_id, sum(points) AS now FROM {{points}} WHERE version = 1 AND day <= 9 GROUP BY ALL), t AS (SELECT w.league, w.scenario, w.driver_id, w.won + c.now AS total FROM w JOIN c USING (league, driver_id)),
z AS (SELECT *, rank() OVER (PARTITION BY league, scenario ORDER BY total DESC) AS place, count(*) OVER (PARTITION BY league, scenario, total) AS same FROM t)"""


def event_points(t):
    """Points by place of every event, by the rule of its round."""
    return ledger.awards(t("starts").select(F.expr("league * 100 + day").alias("ev"), "season", "round"), t("rules"), "season", "round").select("ev", "place", "points")


def remaining(t):
    """Draws of the events after the ninth day, points in effect until then, and the points of each event."""
    r = ranked(t).join(utilities(t).select("league", "ev", "driver_id"), ["ev", "driver_id"]).filter("ev % 100 > 9")
    now = t("points").filter("version = 1 and day <= 9").groupBy("league", "driver_id").agg(F.sum("points").alias("points_now"))
    return r, now, event_points(t)


@query("G09_standings_from_draws", f"""WITH {FINALS}
SELECT league, driver_id, round(avg(CAST(place = 1 AND same = 1 AS INT)), 6) AS sole_title, round(avg(CAST(place = 1 AND same > 1 AS INT)), 6) AS tied_title, round(avg(total), 6) AS mean_points, round(avg(place + (same - 1) / 2), 6) AS mean_place FROM z GROUP BY ALL""")
def _(t):
    return draws.standings(*remaining(t), "league", "ev", "driver_id", 16, 3, 32)


@query("G09_place_distribution", f"""WITH {FINALS}, s AS (SELECT league, driver_id, unnest(range(place, place + same)) AS position, 1.0 / same AS share FROM z)
SELECT league, driver_id, position, round(sum(share) / 16, 6) AS p FROM s GROUP BY ALL""")
def _(t):
    return draws.final_places(draws.finals(*remaining(t), "league", "ev", "driver_id", 16, 3, 32), "league", "driver_id", 16)


@query("G09_unresolved_title", f"WITH {FINALS} SELECT league, round(count(DISTINCT scenario) FILTER (WHERE place = 1 AND same > 1) / 16.0, 6) AS unresolved FROM z GROUP BY league")
def _(t):
    return draws.unresolved(draws.finals(*remaining(t), "league", "ev", "driver_id", 16, 3, 32), "league", 16)


@query("G09_standings_at_cutoff")
def _(t):
    """As of the cutoff of each league's first event from the eighth round of its latest season on: that season's points
    in effect by then, and draws of its events from then on."""
    w = Window.partitionBy("league")
    s = t("starts").withColumn("latest", F.max("season").over(w)).filter("season = latest").withColumn("at", F.min(F.when(F.col("round") >= 8, F.col("cutoff"))).over(w))
    left = s.filter("cutoff >= at").select("league", F.expr("league * 100 + day").alias("ev"))
    p = t("points").join(s.filter("cutoff < at").select(*EVENT, "at"), EVENT).filter("effective_at <= at")
    p = p.groupBy(*EVENT, "driver_id").agg(F.max_by("points", "version").alias("p")).groupBy("league", "driver_id").agg(F.sum("p").alias("n"))
    u = utilities(t).select("league", "ev", "driver_id")
    now = u.join(left, ["league", "ev"]).select("league", "driver_id").union(p.select("league", "driver_id")).distinct()
    now = now.join(p, ["league", "driver_id"], "left").select("league", "driver_id", F.coalesce("n", F.lit(0.0)).alias("points_now"))
    r = ranked(t).join(u, ["ev", "driver_id"]).join(left, ["league", "ev"])
    return draws.standings(r, now, event_points(t), "league", "ev", "driver_id", 16, 3, 32)


@query("G10_draw_validation", f"WITH {RANKED} SELECT ev, count(*) FILTER (WHERE n <> k OR n <> top) AS broken, count(*) AS draws FROM (SELECT ev, draw, count(*) AS n, count(DISTINCT place) AS k, max(place) AS top FROM r GROUP BY ALL) GROUP BY ev")
def _(t):
    d = ranked(t).groupBy("ev", "draw").agg(F.count("*").alias("n"), F.countDistinct("place").alias("k"), F.max("place").alias("top"))
    return d.groupBy("ev").agg(F.count_if(F.expr("n <> k or n <> top")).alias("broken"), F.count("*").alias("draws"))


@query("F13_at_most_k", """WITH r AS (SELECT league, day, driver_id AS ident, p_win AS p, row_number() OVER w - 1 AS i, sum(p_win) OVER (PARTITION BY league, day ORDER BY p_win DESC, driver_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM {predictions} WHERE model = 'grid' WINDOW w AS (PARTITION BY league, day ORDER BY p_win DESC, driver_id)),
m AS (SELECT league, day, min(i) AS m FROM r WHERE p * (3 - i) / tail <= 1 GROUP BY ALL) SELECT r.league, r.day, r.ident, round(CASE WHEN r.i < m.m THEN 1 ELSE r.p * (3 - c.i) / c.tail END, 6) AS capped FROM r JOIN m USING (league, day) JOIN r c ON c.league = r.league AND c.day = r.day AND c.i = m.m""")
def _(t):
    return draws.at_most(t("predictions").filter("model = 'grid'").withColumnRenamed("driver_id", "ident"), EVENT, "p_win", 3)
