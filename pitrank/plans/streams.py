"""Queries of streams and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitrank.operators import calibrate, draws, evaluate, folds, laps, models, orders, trees
from pitrank.plans import datasets
from pitrank.plans.evaluation import RANKED, U, ranked, utilities
from pitrank.plans.pointintime import EVENT
from pitrank.plans.fixtures import with_shapes
from pitrank.plans.registry import ORACLE_SQL, query
from pitrank.sources.store import scratch, settled
from pitrank.streaming import machines
from pitrank.streaming import publications as stream

KEY = [*EVENT, "driver_id"]


FILES = 4  #: files of one step of a feed; a trigger takes as many


def fed(rows: DataFrame, cuts: list[str], closing: DataFrame | None = None, files: int = FILES) -> DataFrame:
    """The rows as a stream of files, a step for each condition, in that order, and a closing row. The rows are settled
    first: each step reads them again, and must not make them again."""
    folder, rows = scratch(rows.sparkSession, "feed"), settled(rows)
    for c in cuts:
        rows.filter(c).repartition(files).write.mode("append").parquet(folder)
    if closing is not None:
        closing.write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def drained(out: DataFrame) -> DataFrame:
    """What a stream has written once all its input is read. State is kept in RocksDB, as timers need it."""
    spark, provider = out.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    folder, state = scratch(spark, "sink"), scratch(spark, "state")
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(folder)
        q.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(out.schema).parquet(folder)


CUTS = ["day <= 10", "day > 10 and day <= 20", "day > 20"]


def feed(t, replays: bool = False) -> DataFrame:
    p = t("publications").select(*KEY, "version", "position", F.col("available_at").cast("timestamp").alias("available_at"), F.col("cutoff").cast("timestamp").alias("cutoff"))
    last = p.limit(1).withColumns({"league": F.lit(-1).cast("long"), "cutoff": F.col("cutoff") + F.expr("INTERVAL 3 YEAR")})
    return fed(p, [*CUTS, CUTS[1]] if replays else CUTS, last)


@query("S01_idempotent_feed", "SELECT league, day, driver_id, version, position FROM {publications}")
def _(t):
    out = stream.idempotent(feed(t, True), [*KEY, "version"], "position", "available_at")
    return drained(out).filter("league >= 0").select(*KEY, "version", "position")


def replayed(t) -> DataFrame:
    """A stream in which some replays, two months later, carry another position than the slot already holds."""
    p = t("publications").select(*KEY, "version", "position", F.col("available_at").cast("timestamp").alias("available_at"), F.lit(1).alias("copy"))
    again = p.filter(CUTS[1]).withColumns({"copy": F.lit(2), "available_at": F.col("available_at") + F.expr("INTERVAL 60 DAY"), "position": F.expr("case when league % 2 = 0 then position + 100 else position end")})
    return fed(p.union(again), [*(f"copy = 1 and {c}" for c in CUTS), "copy = 2"])


@query("S01_slot_collisions", "SELECT league, day, driver_id, version, CAST(2 AS BIGINT) AS contents FROM {publications} WHERE day > 10 AND day <= 20 AND league % 2 = 0")
def _(t):
    out = drained(machines.slots(replayed(t), EVENT, ["driver_id", "version"], "position", "available_at"))
    return out.filter("outcome = 'collision'").groupBy(*KEY, "version").agg((F.countDistinct("position") + 1).alias("contents"))


@query("S01_slot_errors", "SELECT league, day, driver_id, version, position + 100 AS position, sha256(CAST(position AS VARCHAR)) AS accepted_hash FROM {publications} WHERE day > 10 AND day <= 20 AND league % 2 = 0")
def _(t):
    """The error output of the slots: rejected rows, and the hash of what their slot holds."""
    out = drained(machines.slots(replayed(t), EVENT, ["driver_id", "version"], "position", "available_at"))
    return out.filter("outcome = 'collision'").select(*KEY, "version", "position", "accepted_hash")


@query("S02_freeze_at_cutoff", "SELECT league, day, driver_id, version, position FROM (SELECT *, row_number() OVER (PARTITION BY league, day, driver_id ORDER BY available_at DESC) AS k FROM {publications} WHERE available_at <= cutoff) WHERE k = 1")
def _(t):
    return drained(stream.frozen(feed(t), KEY, "available_at", "cutoff", ["version", "position"])).filter("league >= 0").select(*KEY, "version", "position")


@query("S03_late_versions", "SELECT league, day, driver_id, version FROM {publications} WHERE available_at > cutoff")
def _(t):
    return drained(stream.late(feed(t), "available_at", "cutoff")).filter("league >= 0").select(*KEY, "version")


@query("S04_missed_detection", "SELECT s.league, s.day, CASE WHEN EXISTS (SELECT 1 FROM {publications} p WHERE p.league = s.league AND p.day = s.day AND p.version = 2) THEN 'closed' ELSE 'missed' END AS status FROM {starts} s WHERE s.cutoff <= TSLIT '2024-01-20 00:00:00'")
def _(t):
    return stream.missed(t("starts").select(*EVENT, "cutoff"), t("publications").filter("version = 2"), EVENT, "cutoff", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))


@query("S05_rescheduled", "SELECT league, day, 'schedule_changed_review_required' AS status FROM {starts} WHERE day % 5 = 0")
def _(t):
    s = t("starts").select(*EVENT, "cutoff")
    later = s.withColumn("cutoff", F.when(F.col("day") % 5 == 0, F.col("cutoff") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("cutoff")))
    return stream.rescheduled(s.withColumn("v", F.lit(1)).union(later.withColumn("v", F.lit(2))), EVENT, "cutoff", "v")


@query("S06_phase_status", "SELECT league, day, CASE WHEN day % 2 = 0 AND cutoff - INTERVAL 2 HOUR <= TSLIT '2024-01-15 00:00:00' THEN 'captured' WHEN cutoff <= TSLIT '2024-01-15 00:00:00' THEN 'missed' WHEN cutoff - INTERVAL 12 HOUR <= TSLIT '2024-01-15 00:00:00' THEN 'pre_race_window' WHEN cutoff - INTERVAL 48 HOUR <= TSLIT '2024-01-15 00:00:00' THEN 'waiting_for_results' ELSE 'waiting_for_qualifying' END AS phase FROM {starts}")
def _(t):
    s = t("starts").withColumn("captured", F.expr("case when day % 2 = 0 then cutoff - INTERVAL 2 HOUR end")).withColumn("qualifying", F.expr("cutoff - INTERVAL 48 HOUR"))
    return stream.phase(s, "qualifying", "captured", "cutoff", F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"), "12 HOUR").select(*EVENT, "phase")


@query("S07_source_fallback", "SELECT league, day, CASE WHEN day % 3 = 0 THEN entrants WHEN cutoff - INTERVAL 7 HOUR <= TSLIT '2024-01-15 00:00:00' AND TSLIT '2024-01-15 00:00:00' < cutoff AND day % 3 = 1 THEN entrants + 1 END AS value FROM {starts}")
def _(t):
    s = t("starts").withColumns({"first": F.expr("case when day % 3 = 0 then entrants end"), "second": F.expr("case when day % 3 = 1 then entrants + 1 end"), "scheduled": F.expr("cutoff - INTERVAL 9 HOUR")})
    return stream.fallback(s, "first", "second", "scheduled", "cutoff", F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select(*EVENT, "value")


SIGNALS = """WITH e AS (SELECT league, day, cutoff AS s, cutoff - INTERVAL 9 HOUR AS q, cutoff - INTERVAL 7 HOUR AS w, concat('a', CAST(entrants AS VARCHAR)) AS a, concat('b', CAST(entrants AS VARCHAR)) AS b,
  min(seen_at) FILTER (WHERE kind = 'first') AS tf, min(seen_at) FILTER (WHERE kind = 'second') AS ts, min(seen_at) FILTER (WHERE kind = 'schedule' AND start <> cutoff) AS tr FROM {starts} JOIN {signals} USING (league, day) GROUP BY ALL),
c AS (SELECT *, coalesce(tr < s, false) AS rev, coalesce(tf < s AND NOT coalesce(tr < s AND tr <= tf, false), false) AS got, CASE WHEN ts IS NOT NULL THEN greatest(ts, w) END AS tp FROM e),
d AS (SELECT *, coalesce(tp < s AND NOT (got AND tf <= tp) AND NOT (rev AND tr <= tp), false) AS stood FROM c),
x AS (SELECT league, day, s - INTERVAL 48 HOUR AS changed, 'waiting_for_qualifying' AS status, NULL AS value FROM d
UNION ALL SELECT league, day, q, 'waiting_for_qualifying_results', NULL FROM d WHERE NOT (got AND tf <= q) AND NOT (rev AND tr <= q)
UNION ALL SELECT league, day, tp, 'provisional', b FROM d WHERE stood
UNION ALL SELECT league, day, tf, 'captured', a FROM d WHERE got
UNION ALL SELECT league, day, tr, 'schedule_changed_review_required', CASE WHEN got AND tf < tr THEN a WHEN stood AND tp < tr THEN b END FROM d WHERE rev
UNION ALL SELECT league, day, s, CASE WHEN got THEN 'closed' ELSE 'missed' END, CASE WHEN got THEN a WHEN stood THEN b END FROM d)"""


def changes(t) -> DataFrame:
    """Status changes of all events, from a feed whose steps mix early and late rows."""
    d = t("signals").select(*EVENT, "kind", "value", *[F.col(c).cast("timestamp").alias(c) for c in ("scheduled", "start", "seen_at")])
    last = d.limit(1).withColumns({"league": F.lit(-1).cast("long"), "kind": F.lit("tick"), "seen_at": F.col("seen_at") + F.expr("INTERVAL 3 YEAR")})
    return drained(machines.captures(fed(d, [f"(league * 31 + day * 17 + hour(seen_at)) % 3 = {k}" for k in (1, 0, 2)], last), EVENT, "seen_at", "60 days"))


@query("S07_status_changes", f"{SIGNALS} SELECT league, day, strftime(changed, '%Y-%m-%d %H:%M:%S') AS changed_at, status, value FROM x")
def _(t):
    return changes(t).select(*EVENT, F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("changed_at"), "status", "value")


@query("S05_reschedule_reviews", f"{SIGNALS} SELECT league, day, strftime(changed, '%Y-%m-%d %H:%M:%S') AS changed_at FROM x WHERE status = 'schedule_changed_review_required'")
def _(t):
    return changes(t).filter("status = 'schedule_changed_review_required'").select(*EVENT, F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("changed_at"))


def attached(t) -> DataFrame:
    """Late labels of all events, whose frozen versions come in other steps than their labels."""
    p = t("publications").filter("version <= 2").groupBy(*EVENT, "version").agg(F.min("available_at").cast("timestamp").alias("at"), F.min("cutoff").cast("timestamp").alias("start"), F.count("*").alias("roster"))
    labels = t("starts").filter("label_available_at IS NOT NULL").select(*EVENT, F.col("label_available_at").cast("timestamp").alias("label_at"), F.col("entrants").cast("string").alias("value"))
    last = p.limit(1).withColumns({"league": F.lit(-1).cast("long"), "at": F.col("at") + F.expr("INTERVAL 3 YEAR")})
    frozen, late = fed(p, CUTS, last), fed(labels, [CUTS[1], CUTS[2], CUTS[0]])
    return drained(machines.late_labels(frozen, late, EVENT, "version", "start", "at", "value", "label_at", "40 days", roster="roster")).filter("league >= 0")


@query("S08_late_labels", "SELECT s.league, s.day, s.entrants, CASE WHEN s.label_available_at IS NOT NULL THEN 1 END AS labelled, CASE WHEN s.label_available_at <= s.cutoff + INTERVAL 48 HOUR THEN 1 END AS on_time, CASE WHEN s.label_available_at IS NOT NULL THEN s.entrants END AS label, strftime(s.label_available_at, '%Y-%m-%d %H:%M:%S') AS label_at FROM {starts} s")
def _(t):
    """Every frozen event with its field, whether its label has come, however late, whether within 48 hours, and the label."""
    out = machines.labelled(attached(t), EVENT, "48 HOUR")
    return out.select(*EVENT, F.col("roster").cast("long").alias("entrants"), "labelled", "on_time", F.col("label").cast("long").alias("label"), F.date_format("label_at", "yyyy-MM-dd HH:mm:ss").alias("label_at"))


@query("S08_labels_by_version", "SELECT p.league, p.day, p.version, CAST(s.entrants AS VARCHAR) AS value, strftime(s.label_available_at, '%Y-%m-%d %H:%M:%S') AS label_at, CAST((SELECT count(*) FROM range(1, 12) n(n) WHERE s.cutoff + INTERVAL 6 HOUR * (2 ** n - 1) <= s.label_available_at) AS BIGINT) AS attempts FROM (SELECT DISTINCT league, day, version FROM {publications} WHERE version <= 2) p JOIN {starts} s USING (league, day)")
def _(t):
    """Labels at each frozen version, with the retries due until they came."""
    return attached(t).filter("what = 'attached'").select(*EVENT, "version", "value", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("label_at"), "attempts")


FEATURES = ["qualifying_position", "form", "n"]


def matrix(t) -> DataFrame:
    """Rows with features known before the event: own mean finish so far, qualifying, activity."""
    w = Window.partitionBy("league", "driver_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    d = t("results").withColumn("form", F.coalesce(F.avg("label_position").over(w), F.lit(10.0)))
    d = d.select(*KEY, *[F.col(f).cast("double").alias(f) for f in FEATURES], "label_position", "label_dnf", "label_available_at", "label_dnf_available_at", "cutoff")
    t.made["fitted"] = d.repartition("league").persist()
    return t.made["fitted"]


def starts(t) -> DataFrame:
    """The starts' clocks: of the kept rows that a query fits, if it has a matrix, so that its tables are read once."""
    if "fitted" not in t.made:
        return t("starts")
    return t.made["fitted"].groupBy(*EVENT).agg(F.min("cutoff").alias("cutoff"), F.max("label_available_at").alias("label_available_at"))


def cohorts(t) -> DataFrame:
    """all test events with five earlier ones whose labels were known by the cutoff."""
    return folds.rolling_folds(starts(t), ["league"], "day", "cutoff", "label_available_at", 5).persist()


def learners(t, f: DataFrame) -> DataFrame:
    """For each event the test days (folds) that learn from it, each with its cutoff."""
    at = starts(t).select("league", F.col("day").alias("test"), F.col("cutoff").alias("at"))
    return f.join(at, ["league", "test"]).groupBy("league", F.col("train").alias("day")).agg(F.array_sort(F.collect_list(F.struct(F.col("test").alias("fold"), "at"))).alias("own"))


def fold_rows(t, d: DataFrame, f: DataFrame) -> DataFrame:
    """training rows with the folds that learn from them, and those that learn their retirement label as well; a
    fold is a test day over all leagues. No row is repeated."""
    rows = d.drop("cutoff").join(learners(t, f), EVENT)
    return rows.withColumns({"folds": F.col("own.fold"), "dnf_folds": F.filter("own", lambda x: F.col("label_dnf_available_at") <= x["at"])["fold"]}).drop("own")


def tested(d: DataFrame, f: DataFrame) -> DataFrame:
    return d.join(f.select("league", F.col("test").alias("day")).distinct(), EVENT, "left_semi").withColumn("fold", F.col("day"))


def ridge_fits(d: DataFrame, f: DataFrame) -> dict:
    """the ridge fit of every test day, from per-event sums: rows are read once, whatever the number of test days."""
    events = f.select(F.col("test").alias("fold"), "league", F.col("train").alias("day"), F.lit(1).alias("often"))
    sums = models.resampled_sums(events, models.event_sums(d, EVENT, FEATURES, "label_position"), EVENT, ["fold"])
    return {r.fold: models.solved(r.sums, len(FEATURES) + 1) for r in sums.collect()}  # one row for each test day


def oof(t) -> DataFrame:
    d, f = matrix(t), cohorts(t)
    return models.out_of_fold(tested(d, f), fold_rows(t, d, f), "fold", FEATURES, "label_position", "label_dnf", ridge_fits(d, f))


@query("F05_logistic_fits")
def _(t):
    return oof(t).select(*KEY, "fold", *[F.round(p, 4).alias(p) for p in ("p_win", "p_podium", "p_dnf")])


@query("F06_ridge_positions")
def _(t):
    d, f = matrix(t), cohorts(t)
    return models.with_fits(tested(d, f), "fold", FEATURES, {"place": ridge_fits(d, f)}).select(*KEY, "fold", F.round("place", 4).alias("place"))


EDGES = {"qualifying_position": [k + 0.5 for k in range(1, 20)], "form": [1.0137 + 0.6 * k for k in range(31)], "n": [k + 0.5 for k in range(1, 16)]}
BINS = 1 + max(map(len, EDGES.values()))
KINDS = {"share": ("share", None), "dnf": ("label_dnf", "label_dnf_available_at")}


def tree_cells(t, d: DataFrame, f: DataFrame) -> DataFrame:
    """F02 for trees: labels of both kinds (place over field size, retirement) that each test day may learn from."""
    rows = trees.binned(d, EDGES).withColumn("share", F.col("label_position") / F.count("*").over(Window.partitionBy(*EVENT)))
    own, sets = trees.numbered(learners(t, f), "own")
    return trees.cells(rows.join(own, EVENT), "own", KINDS, sets)


def forest_of(t, d: DataFrame, f: DataFrame, number: int = 80):
    table = settled(tree_cells(t, d, f))
    return table, trees.grow(table, {"dnf"}, BINS, number)


@query("F07_boosted_trees")
def _(t):
    """Both trees at all test days: the expected place and the retirement probability."""
    d, f = matrix(t), cohorts(t)
    _, forest = forest_of(t, d, f)
    size = F.count("*").over(Window.partitionBy(*EVENT))
    out = trees.predicted(trees.binned(tested(d, f), EDGES), forest, "fold", list(KINDS))
    return out.select(*KEY, "fold", F.round(F.col("share") * size, 4).alias("place"), F.round("dnf", 4).alias("p_dnf"))


def tree_sql() -> str:
    """The first tree of each test day and kind: three levels of best splits, each from sums by feature and bin."""
    bins = ", ".join(f"(SELECT count(*) FROM (SELECT unnest([{', '.join(map(str, e))}]) AS e) WHERE x.{f} > e) AS b{j}" for j, (f, e) in enumerate(EDGES.items()))
    parts = [
        "q AS (SELECT * FROM (SELECT league, test, train, count(*) OVER (PARTITION BY league, test) AS k FROM f0) WHERE k >= 5)",
        "x AS (SELECT league, day, driver_id, CAST(qualifying_position AS DOUBLE) AS qualifying_position, CAST(n AS DOUBLE) AS n, coalesce(avg(label_position) OVER (PARTITION BY league, driver_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 10) AS form, label_position / count(*) OVER (PARTITION BY league, day) AS share, label_dnf, label_dnf_available_at FROM {results})",
        f"y AS (SELECT x.*, {bins} FROM x)",
        "z AS (SELECT q.test AS fold, 'share' AS kind, b0, b1, b2, share AS y FROM y JOIN q ON q.league = y.league AND q.train = y.day WHERE share IS NOT NULL UNION ALL SELECT q.test, 'dnf', b0, b1, b2, CAST(label_dnf AS INT) FROM y JOIN q ON q.league = y.league AND q.train = y.day JOIN {starts} s ON s.league = q.league AND s.day = q.test WHERE label_dnf IS NOT NULL AND label_dnf_available_at <= s.cutoff)",
        "m AS (SELECT fold, kind, avg(y) AS m FROM z GROUP BY ALL HAVING kind = 'share' OR (min(y) = 0 AND max(y) = 1))",
        "n0 AS (SELECT z.*, m - y AS g, CASE kind WHEN 'dnf' THEN m * (1 - m) ELSE 1 END AS h, 0 AS node FROM z JOIN m USING (fold, kind))",
    ]
    for k in range(3):
        parts += [
            f"h{k} AS (SELECT fold, kind, node, j, b, sum(g) AS g, sum(h) AS h, count(*) AS c FROM (SELECT fold, kind, node, g, h, unnest([0, 1, 2]) AS j, unnest([b0, b1, b2]) AS b FROM n{k}) GROUP BY ALL)",
            f"c{k} AS (SELECT *, sum(g) OVER l AS gl, sum(h) OVER l AS hl, sum(c) OVER l AS cl, sum(g) OVER a AS ga, sum(h) OVER a AS ha, sum(c) OVER a AS ca FROM h{k} WINDOW l AS (PARTITION BY fold, kind, node, j ORDER BY b), a AS (PARTITION BY fold, kind, node, j))",
            f"s{k} AS (SELECT fold, kind, node, arg_min(struct_pack(j := j, b := b), struct_pack(g := -gain, j := j, b := b)) AS s FROM (SELECT *, round(gl * gl / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga * ga / (ha + 1), 9) AS gain FROM c{k} WHERE cl >= 5 AND ca - cl >= 5) WHERE gain > 0 GROUP BY ALL)",
            f"n{k + 1} AS (SELECT n.* EXCLUDE (node), 2 * n.node + CASE WHEN coalesce(CASE s.s.j WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END > s.s.b, false) THEN 1 ELSE 0 END AS node FROM n{k} n LEFT JOIN s{k} s USING (fold, kind, node))",
        ]
    return f"WITH {FOLDS_SQL}, {', '.join(parts)} SELECT fold, kind, CAST(node AS BIGINT) AS leaf, count(*) AS n, round(sum(-g), 6) AS residual FROM n3 GROUP BY ALL"


FOLDS_SQL = "f0 AS (SELECT t.league, t.day AS test, e.day AS train FROM {starts} t JOIN {starts} e ON e.league = t.league AND e.cutoff < t.cutoff AND e.label_available_at <= t.cutoff)"


@query("F07_first_trees", tree_sql())
def _(t):
    """The leaves of the first tree of all test days and both kinds: rows, and what their labels are above the mean."""
    d, f = matrix(t), cohorts(t)
    table, forest = forest_of(t, d, f, 1)
    return trees.leaves(table, forest).withColumn("residual", F.round("residual", 6))


def learning(t, f: DataFrame) -> DataFrame:
    """The test days (folds) that learn from each event."""
    return f.groupBy("league", F.col("train").alias("day")).agg(F.array_sort(F.collect_list("test")).alias("folds"))


def order_fits(t, d: DataFrame, f: DataFrame) -> DataFrame:
    events = orders.packed(d.join(learning(t, f), EVENT), EVENT, "label_position", "driver_id", FEATURES, "folds")
    return orders.fit_orders(events, FEATURES)


@query("F09_order_fit")
def _(t):
    """The order models of all test days."""
    return order_fits(t, matrix(t), cohorts(t)).select("fold", "feature", F.round("weight", 6).alias("weight"), F.round("scale", 6).alias("scale"))


@query("F09_gradient_check", f"WITH {FOLDS_SQL}, q AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY league, test) AS k FROM f0) WHERE k >= 5), e AS (SELECT league, day, count(*) AS n FROM {{results}} GROUP BY ALL HAVING count(label_position) > 0 AND count(*) > 1) SELECT q.test AS fold, count(*) AS events, CAST(sum(n) AS BIGINT) AS rows, true AS converged FROM q JOIN e ON e.league = q.league AND e.day = q.train GROUP BY q.test")
def _(t):
    """At the weights of each test day's fit no component of the gradient, recomputed from the events' fields, exceeds 1e-6."""
    d, f = matrix(t), cohorts(t)
    rows = d.join(learning(t, f), EVENT)
    g = orders.gradients(rows, EVENT, "label_position", "driver_id", FEATURES, "folds", order_fits(t, d, f))
    return g.select("fold", "events", "rows", (F.col("largest") < 1e-6).alias("converged"))


SIGMOID = """WITH RECURSIVE {shapes}p AS (SELECT league, day, driver_id, ln(least(greatest(p_win, 1e-6), 1 - 1e-6) / (1 - least(greatest(p_win, 1e-6), 1 - 1e-6))) AS x, CAST(coalesce(label_position = 1, false) AS INT) AS y FROM predictions WHERE model = 'grid'),
b(k, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT k + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT k, a, b, sum(q - y) AS g0, sum((q - y) * x) + b AS g1, sum(q * (1 - q)) AS h00, sum(q * (1 - q) * x) AS h01, sum(q * (1 - q) * x * x) + 1 AS h11 FROM (SELECT b.*, x, y, 1 / (1 + exp(-(a + b * x))) AS q FROM b, p WHERE k < 25 AND day < 20) GROUP BY k, a, b))
SELECT league, day, driver_id, round(1 / (1 + exp(-(a + b * x))), 4) AS q FROM p, b WHERE day >= 20 AND k = 25"""


@query("F14_sigmoid_calibration")
def _(t):
    p = t("predictions").filter("model = 'grid'").withColumn("won", F.coalesce(F.col("label_position") == 1, F.lit(False)))
    fit, _reason = calibrate.fit_sigmoid(p.filter("day < 20"), "p_win", "won")
    return calibrate.apply_sigmoid(p.filter("day >= 20").select(*KEY, "p_win"), fit, "p_win", "q").select(*KEY, F.round("q", 4).alias("q"))


ORACLE_SQL["F14_sigmoid_calibration"] = SIGMOID.replace("{shapes}", with_shapes("WITH _ AS (SELECT 1 FROM {predictions}) SELECT 1").removeprefix("WITH ").removesuffix("_ AS (SELECT 1 FROM predictions) SELECT 1"))


#: Halves of the rows by crc32, made from its polynomial; then the max-min formula of isotonic regression, where the
#: other half has enough labels.
ISOTONIC = """WITH t AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
s AS (SELECT doc_id, y, least(greatest(p, 1e-6), 1 - 1e-6) AS p, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 2 AS half FROM {scores}, t),
d AS (SELECT half, p, count(*) AS w, sum(y) AS s FROM s GROUP BY half, p),
c AS (SELECT *, sum(w) OVER o AS cw, sum(s) OVER o AS cs FROM d WINDOW o AS (PARTITION BY half ORDER BY p)),
m AS (SELECT a.half, a.p AS i, b.p AS j, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.half, a.p ORDER BY b.p DESC) AS m FROM c a JOIN c b ON a.half = b.half AND b.p >= a.p),
f AS (SELECT half, j AS p, max(m) AS v FROM m GROUP BY half, j),
x AS (SELECT s.doc_id, s.p, max(f.p) FILTER (WHERE f.p <= s.p) AS lo, min(f.p) FILTER (WHERE f.p >= s.p) AS hi FROM s JOIN f ON f.half <> s.half GROUP BY s.doc_id, s.p, s.half),
g AS (SELECT half, count(*) >= 100 AND least(sum(y), count(*) - sum(y)) >= 10 AND count(DISTINCT p) >= 3 AS enough FROM s GROUP BY half),
y AS (SELECT x.*, a.v AS a, b.v AS b, enough FROM x JOIN s USING (doc_id) LEFT JOIN g ON g.half <> s.half LEFT JOIN f a ON a.half <> s.half AND a.p = lo LEFT JOIN f b ON b.half <> s.half AND b.p = hi)
SELECT doc_id, round(CASE WHEN NOT coalesce(enough, false) THEN p ELSE least(greatest(CASE WHEN a IS NULL THEN b WHEN b IS NULL OR hi = lo THEN a ELSE a + (b - a) * (p - lo) / (hi - lo) END, 1e-6), 1 - 1e-6) END, 4) AS q FROM y"""


@query("F15_isotonic_calibration", ISOTONIC)
def _(t):
    """Cross-fitted: each half of the rows, by a hash, is calibrated by the fit on the other half."""
    s = t("scores").withColumn("half", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)))
    done = []
    for half in (0, 1):
        fit, _reason = calibrate.fit_isotonic(s.filter(F.col("half") != half), "p", "y")
        done.append(calibrate.apply_isotonic(s.filter(F.col("half") == half).select("doc_id", "p"), fit, "p", "q"))
    return done[0].union(done[1]).select("doc_id", F.round("q", 4).alias("q"))


def order_utility(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Rows with the utility of their fold's order model."""
    w = fits.groupBy("fold").agg(*[F.max(F.when(F.col("feature") == f, F.col("weight") / F.col("scale"))).alias(f"_{f}") for f in FEATURES])
    d = rows.join(F.broadcast(w), "fold", "left")
    return d.withColumn("order", sum((F.col(f) * F.col(f"_{f}") for f in FEATURES), F.lit(0.0))).drop(*[f"_{f}" for f in FEATURES])


def candidates(t) -> DataFrame:
    """F16: the outputs of every candidate at all test rows: logistic and ridge fits, trees of both kinds, order models."""
    d, f = matrix(t), cohorts(t)
    _, forest = forest_of(t, d, f)
    out = trees.predicted(trees.binned(tested(d, f), EDGES), forest, "fold", list(KINDS)).withColumnRenamed("dnf", "p_dnf_trees")
    out = models.out_of_fold(out, fold_rows(t, d, f), "fold", FEATURES, "label_position", "label_dnf", ridge_fits(d, f))
    out = order_utility(out, order_fits(t, d, f))
    size = F.count("*").over(Window.partitionBy(*EVENT))
    return settled(out.withColumn("place_trees", F.col("share") * size).drop("bins", "share"))


@query("F16_out_of_fold")
def _(t):
    """Every candidate's utility, the baseline's, and the retirement probabilities, at every test row."""
    o = candidates(t)
    plain = folds.baseline(datasets.with_form(t), EVENT, ["grid", "recent"], "driver_id", "rate").select(*KEY, F.log("p_win").alias("heuristic"), F.col("p_dnf").alias("p_dnf_recent"))
    u = {"logistic": folds.utility("probability", "p_win", "n"), "ridge": folds.utility("position", "place_ridge", "n"), "trees": folds.utility("position", "place_trees", "n"), "order": F.col("order"), "heuristic": F.col("heuristic")}
    return o.join(plain, KEY).select(*KEY, "fold", *[F.round(x, 4).alias(name) for name, x in u.items()], *[F.round(p, 4).alias(p) for p in ("p_dnf", "p_dnf_trees", "p_dnf_recent")])


RESAMPLES = 20


def resamples(t, d: DataFrame, f: DataFrame) -> DataFrame:
    """fold, b and the sums of products of each resample of the events that a test day learns from."""
    often = evaluate.resampled(f.select(F.col("test").alias("fold"), "league", F.col("train").alias("day")), EVENT, RESAMPLES, 99, "fold")
    return models.resampled_sums(often, models.event_sums(d, EVENT, FEATURES, "label_position"), EVENT, ["fold", "b"])


@query("F18_resampled_sums", f"""WITH {FOLDS_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY league, train) - 1 AS i, count(*) OVER (PARTITION BY test) AS m FROM (SELECT *, count(*) OVER (PARTITION BY league, test) AS k FROM f0) WHERE k >= 5),
p AS (SELECT test, b, ('0x' || substr(md5('99|' || test || '|' || b || '|' || i), 1, 8))::BIGINT % m AS i FROM q, range({RESAMPLES}) r(b)),
x AS (SELECT league, day, CAST(qualifying_position AS DOUBLE) AS q, CAST(n AS DOUBLE) AS n, label_position AS y, coalesce(avg(label_position) OVER (PARTITION BY league, driver_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 10) AS f FROM {{results}}),
s AS (SELECT league, day, count(y) AS c, sum(q) AS q, sum(f * f) AS ff, sum(f * y) AS fy, sum(y) AS y FROM x WHERE y IS NOT NULL GROUP BY ALL)
SELECT p.test AS fold, CAST(p.b AS INT) AS b, CAST(sum(c) AS BIGINT) AS rows, CAST(sum(s.q) AS BIGINT) AS sum_qualifying, round(sum(ff) / sum(c), 9) AS mean_form_form, round(sum(fy) / sum(c), 9) AS mean_form_place, CAST(sum(y) AS BIGINT) AS sum_place FROM p JOIN q ON q.test = p.test AND q.i = p.i JOIN s ON s.league = q.league AND s.day = q.train GROUP BY ALL""")
def _(t):
    """Some of the sums that the refits are solved from, for each test day and resample."""
    s = resamples(t, matrix(t), cohorts(t)).select("fold", "b", "sums")
    at = lambda i: F.col("sums")[i]
    return s.select("fold", "b", at(0).cast("long").alias("rows"), at(1).cast("long").alias("sum_qualifying"), F.round(at(7) / at(0), 9).alias("mean_form_form"), F.round(at(12) / at(0), 9).alias("mean_form_place"), at(10).cast("long").alias("sum_place"))


@query("F18_bootstrap_spread")
def _(t):
    """Deviation of each entrant's centred utility over the refits, at all test days."""
    d, f = matrix(t), cohorts(t)
    k = len(FEATURES) + 1
    fits = [(r.fold, r.b, models.solved(r.sums, k)) for r in resamples(t, d, f).collect()]  # test days times resamples
    table = t.spark.createDataFrame(fits, "fold long, b int, w array<double>").groupBy("fold").agg(F.collect_list("w").alias("fits"))
    u = tested(d, f).join(F.broadcast(table), "fold").select(*KEY, *FEATURES, F.posexplode("fits").alias("b", "w"))
    u = u.withColumn("place", sum((F.col("w")[i + 1] * F.col(x) for i, x in enumerate(FEATURES)), F.col("w")[0]))
    centred = u.withColumn("u", F.avg("place").over(Window.partitionBy("b", *EVENT)) - F.col("place"))
    return centred.groupBy(*KEY).agg(F.round(F.stddev_pop("u"), 4).alias("spread"))


def predictions_of_all(t) -> DataFrame:
    """The long table of the backtest: every model's prediction of every test row, places held within 1..n and ranked.

    The trees' and the order model's chances to win are those of their utilities in an order model (softmax)."""
    o = candidates(t)
    w = Window.partitionBy(*EVENT)
    softmax = lambda d, u: d.withColumn("_top", u).withColumn("_top", F.max("_top").over(w)).withColumn("_e", F.exp(u - F.col("_top"))).withColumn("share", F.col("_e") / F.sum("_e").over(w))
    none = F.lit(None).cast("double")
    fitted = o.select(*KEY, folds.normalised("p_win", EVENT).alias("p_win"), "p_podium", "p_dnf", F.col("place_ridge").alias("expected"))
    grown = softmax(o, -F.col("place_trees")).select(*KEY, F.col("share").alias("p_win"), none.alias("p_podium"), F.col("p_dnf_trees").alias("p_dnf"), F.col("place_trees").alias("expected"))
    rank = F.row_number().over(w.orderBy(F.desc("order"), "driver_id")).cast("double")
    ordered = softmax(o, F.col("order")).select(*KEY, F.col("share").alias("p_win"), none.alias("p_podium"), "p_dnf", rank.alias("expected"))
    plain = folds.baseline(datasets.with_form(t), EVENT, ["grid", "recent"], "driver_id", "rate").join(o.select(*KEY), KEY, "left_semi")
    parts = [folds.predicted(d, EVENT, "driver_id", name) for name, d in (("linear", fitted), ("trees", grown), ("order", ordered), ("heuristic", plain))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.select(*KEY, "model", *[F.round(c, 4).alias(c) for c in ("p_win", "p_podium", "p_dnf", "expected")], "place")


@query("F22_predictions")
def _(t):
    return predictions_of_all(t)


@query("F22_metrics")
def _(t):
    """Losses of every model of the backtest on the same rows: winner log loss, retirement Brier score, place error."""
    d = predictions_of_all(t).join(t("results").select(*KEY, "label_position", "label_dnf"), KEY)
    won = F.coalesce(F.col("label_position") == 1, F.lit(False))
    return d.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(F.when(won, -F.log(evaluate.clipped("p_win")))), 4).alias("winner_loss"), F.round(F.avg((F.col("p_dnf") - F.col("label_dnf").cast("int")) ** 2), 4).alias("dnf_brier"), F.round(F.avg(F.abs(F.col("place") - F.col("label_position"))), 4).alias("place_mae"))


TEMPERATURES = (0.5, 1.0, 2.0, 4.0)
DRAWS = 64
CHOICE = f"""{FOLDS_SQL}, q AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY league, test) AS k FROM f0) WHERE k >= 5),
u AS (SELECT u.league, u.day, u.league * 100 + u.day AS ev, u.driver_id, utility, p_dnf, coalesce(label_position = 1, false) AS won FROM {{utilities}} u JOIN {{results}} USING (league, day, driver_id)),
x AS (SELECT u.*, d.draw, {U.format("'21|' || ev || '|' || d.draw || '|' || driver_id || '|dnf'")} < p_dnf AS out, round(-ln(-ln({U.format("'21|' || ev || '|' || d.draw || '|' || driver_id || '|order'")})), 9) AS noise FROM u CROSS JOIN range({DRAWS}) d(draw)),
r AS (SELECT *, row_number() OVER (PARTITION BY ev, draw, temperature ORDER BY out, utility / temperature + noise DESC, driver_id) AS place FROM x CROSS JOIN (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS temperature)),
l AS (SELECT league, day, temperature, -ln(greatest(avg(CAST(won AS INT)), 1e-15)) AS loss FROM r WHERE place = 1 AND ev IN (SELECT ev FROM u GROUP BY ev HAVING count(*) FILTER (WHERE won) = 1) GROUP BY ALL),
c AS (SELECT league, test, max(train) AS day FROM q GROUP BY ALL)"""


def calibration_events(t, f: DataFrame) -> DataFrame:
    """the latest training event of each test event."""
    role = folds.calibration_split(f, t("starts"), ["league"], "day", "cutoff", "label_available_at", 1)
    return role.filter("role = 'calibrate'").select("league", "test", F.col("train").alias("day"))


def best_temperature(losses: DataFrame, keys: list[str]) -> DataFrame:
    """The temperature with the least mean loss, the lower one of equals."""
    mean = losses.groupBy(*keys, "temperature").agg(F.round(F.avg("loss"), 9).alias("loss"))
    return mean.groupBy(*keys).agg(F.min(F.struct("loss", "temperature")).alias("m")).select(*keys, "m.temperature", "m.loss")


@query("F21_temperature_choice", f"WITH {CHOICE} SELECT league, test AS day, temperature, loss FROM (SELECT c.league, c.test, temperature, round(loss, 6) AS loss, row_number() OVER (PARTITION BY c.league, c.test ORDER BY round(loss, 9), temperature) AS k FROM c JOIN l USING (league, day)) WHERE k = 1")
def _(t):
    """Each test event's temperature, by draws with retirements of its latest known event, all from the same noise."""
    u = t("utilities").join(t("results").select(*KEY, F.coalesce(F.col("label_position") == 1, F.lit(False)).alias("won")), KEY).withColumn("ev", F.expr("league * 100 + day"))
    loss = draws.temperature_losses(u, "ev", "driver_id", "utility", "won", DRAWS, 21, TEMPERATURES, "p_dnf")
    at = calibration_events(t, cohorts(t)).withColumn("ev", F.expr("league * 100 + day")).select("league", F.col("test").alias("day"), "ev")
    return best_temperature(at.join(loss, "ev"), EVENT).select(*EVENT, "temperature", F.round("loss", 6).alias("loss"))


@query("F21_composed_model")
def _(t):
    """A ridge fit of places and a logistic fit of retirements for every test day; the temperature is the one whose draws,
    with retirements, lose least on the day's calibration events; win shares and places are those of the draws."""
    d, f = matrix(t), cohorts(t)
    role = folds.calibration_split(f, t("starts"), ["league"], "day", "cutoff", "label_available_at", 1)
    place = {"place": ridge_fits(d, role.filter("role = 'fit'"))}
    out = {"logit": {k: b for (k, _), b in models.logistic_by_fold(fold_rows(t, d, f).withColumn("_out", F.col("label_dnf").cast("int")), FEATURES, {"_out": "dnf_folds"}).items()}}

    def composed(x: DataFrame) -> DataFrame:
        x = models.with_fits(x, "fold", FEATURES, place | out)
        return x.withColumns({"ev": F.expr("league * 100 + day"), "utility": F.round(-F.col("place"), 9), "p_dnf": F.round(F.coalesce(1 / (1 + F.exp(-F.col("logit"))), F.lit(0.5)), 9)})

    last = role.filter("role = 'calibrate'").select("league", F.col("test").alias("fold"), F.col("train").alias("day"))
    kept = composed(d.join(last, EVENT)).withColumn("won", F.coalesce(F.col("label_position") == 1, F.lit(False)))
    best = settled(best_temperature(draws.temperature_losses(kept, "ev", "driver_id", "utility", "won", DRAWS, 21, TEMPERATURES, "p_dnf", ["fold"]), ["fold"]))
    o = composed(tested(d, f)).join(F.broadcast(best), "fold", "left").withColumn("u", F.col("utility") / F.coalesce("temperature", F.lit(1.0)))
    m = draws.marginals(draws.rankings(o, "ev", "driver_id", "u", DRAWS, 21, p_dnf="p_dnf"), "ev", "driver_id")
    return o.select(*KEY, "fold", "ev", "temperature", F.round("p_dnf", 4).alias("p_dnf")).join(m, ["ev", "driver_id"]).select(*KEY, "fold", "temperature", "p_dnf", F.col("win").alias("p_win"), "podium", "mean_place")


@query("F22_backtest")
def _(t):
    o = oof(t)
    n = F.count("*").over(Window.partitionBy("fold", *EVENT))
    place = F.row_number().over(Window.partitionBy("fold", *EVENT).orderBy("place_ridge", "driver_id"))
    d = o.withColumn("clamped", F.least(F.greatest("place_ridge", F.lit(1.0)), n)).withColumn("place", place)
    return d.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("clamped") - F.col("label_position"))), 4).alias("mae"), F.round(F.avg(F.abs(F.col("place") - F.col("label_position"))), 4).alias("rank_mae"))


@query("C11_elo_ratings")
def _(t):
    r = t("results").select("league", "day", "season", "driver_id", F.col("label_position").cast("double").alias("label_position"), F.col("cutoff").cast("timestamp").alias("cutoff"), F.col("label_available_at").cast("timestamp").alias("label_available_at"))
    return models.elo(r, "league")


@query("C11_team_ratings")
def _(t):
    """Entrant and team ratings before each event; teams keep half of their distance to the base over a season, and a
    fifth where the rules were reset (2025)."""
    r = t("results").select("league", "day", "season", "driver_id", "constructor_id", F.col("label_position").cast("double").alias("label_position"), F.col("cutoff").cast("timestamp").alias("cutoff"), F.col("label_available_at").cast("timestamp").alias("label_available_at"))
    return models.team_elo(r, "league", resets=(2025,))


#: The temperatures of winners and of the rest, and the shares of equal chances, that are tried.
WINNER_TEMPERATURES = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.15)
REST_TEMPERATURES = (0.7, 0.8, 0.9, 1.0, 1.15, 1.3, 1.5)
SHRINKAGE = (0.0, 0.02, 0.05)
GRID_DRAWS = 32
TWO_STAGE = f"""q AS (SELECT league, day FROM (SELECT league, day, row_number() OVER (PARTITION BY league ORDER BY day) AS k FROM {{starts}}) WHERE k > 5),
u AS (SELECT league, day, league * 100 + day AS ev, driver_id, utility, p_dnf FROM {{utilities}} JOIN q USING (league, day)),
x AS (SELECT u.*, d.draw, {U.format("'20|' || ev || '|' || d.draw || '|' || driver_id || '|dnf'")} < p_dnf AS out, round(-ln(-ln({U.format("'20|' || ev || '|' || d.draw || '|' || driver_id || '|win'")})), 9) AS a, round(-ln(-ln({U.format("'20|' || ev || '|' || d.draw || '|' || driver_id || '|rest'")})), 9) AS b FROM u CROSS JOIN range({GRID_DRAWS}) d(draw)),
w AS (SELECT ev, draw, f AS first, arg_min(driver_id, struct_pack(o := out, k := -(utility / f + a), i := driver_id)) AS w FROM x CROSS JOIN (SELECT unnest([{', '.join(map(str, WINNER_TEMPERATURES))}])::DOUBLE AS f) GROUP BY ALL),
t AS (SELECT * FROM (SELECT ev, draw, r AS rest, driver_id, row_number() OVER (PARTITION BY ev, draw, r ORDER BY out, utility / r + b DESC, driver_id) AS k FROM x CROSS JOIN (SELECT unnest([{', '.join(map(str, REST_TEMPERATURES))}])::DOUBLE AS r)) WHERE k <= 3),
p AS (SELECT ev, first, rest, driver_id, 0 AS wins FROM (SELECT w.ev, w.draw, first, rest, driver_id, row_number() OVER (PARTITION BY w.ev, w.draw, first, rest ORDER BY k) AS k FROM w JOIN t ON t.ev = w.ev AND t.draw = w.draw AND t.driver_id <> w.w) WHERE k <= 2
  UNION ALL SELECT ev, first, r, w, 1 FROM w CROSS JOIN (SELECT unnest([{', '.join(map(str, REST_TEMPERATURES))}])::DOUBLE AS r)),
m AS (SELECT ev, first, rest, driver_id, sum(wins) / {GRID_DRAWS} AS win, count(*) / {GRID_DRAWS} AS podium FROM p GROUP BY ALL),
g AS (SELECT u.ev, u.league, u.day, u.driver_id, f.first, f.rest, s.shrink, count(*) OVER (PARTITION BY u.ev, f.first, f.rest, s.shrink) AS n, coalesce(m.win, 0) AS win, coalesce(m.podium, 0) AS podium FROM u CROSS JOIN (SELECT DISTINCT first, rest FROM p) f CROSS JOIN (SELECT unnest([{', '.join(map(str, SHRINKAGE))}])::DOUBLE AS shrink) s LEFT JOIN m ON m.ev = u.ev AND m.driver_id = u.driver_id AND m.first = f.first AND m.rest = f.rest),
c AS (SELECT *, greatest(least((1 - shrink) * win + shrink / n, 1 - 1e-15), 1e-15) AS pw, greatest(least((1 - shrink) * podium + shrink * least(1, 3 / n), 1 - 1e-15), 1e-15) AS pp FROM g),
l AS (SELECT c.first, c.rest, c.shrink, c.ev, sum(-ln(pw)) FILTER (WHERE label_position = 1) + avg(-ln(CASE WHEN coalesce(label_position <= 3, false) THEN pp ELSE 1 - pp END)) / 3 AS loss FROM c JOIN {{results}} USING (league, day, driver_id) GROUP BY ALL)"""


@query("H20_grid_fit", f"WITH {TWO_STAGE} SELECT first, rest, shrink, round(avg(loss), 6) AS loss, count(loss) AS events, row_number() OVER (ORDER BY round(avg(loss), 6), first, rest, shrink) = 1 AS chosen FROM l GROUP BY first, rest, shrink")
def _(t):
    """The objective of every cell of the two-stage grid over all events that have five earlier ones, and the best cell."""
    k = F.row_number().over(Window.partitionBy("league").orderBy("day"))
    scored = t("starts").select(*EVENT, k.alias("k")).filter("k > 5").select(*EVENT)
    u = t("utilities").join(scored, EVENT, "left_semi").join(t("results").select(*KEY, "label_position"), KEY).withColumn("ev", F.expr("league * 100 + day"))
    m = draws.two_stage_cells(u, "ev", "driver_id", "utility", GRID_DRAWS, 20, WINNER_TEMPERATURES, REST_TEMPERATURES, "p_dnf", ("label_position",))
    m = m.withColumn("shrink", F.explode(F.array(*map(F.lit, SHRINKAGE))))
    keep, equal = 1 - F.col("shrink"), F.col("shrink")
    shares = m.select("ev", "label_position", "first", "rest", "shrink", (keep * F.col("win") + equal / F.col("n")).alias("win"), (keep * F.col("podium") + equal * F.least(F.lit(1.0), 3 / F.col("n"))).alias("podium"))
    won, podium = (F.coalesce(c, F.lit(False)) for c in (F.col("label_position") == 1, F.col("label_position") <= 3))
    grid = evaluate.objective(shares, ["first", "rest", "shrink"], "ev", won, podium)
    return grid.withColumn("chosen", F.row_number().over(Window.orderBy("loss", "first", "rest", "shrink")) == 1)  # one row for each cell


WET_WEIGHTS = (0.0, 0.1, 0.2, 0.4)
WET = f"""g AS (SELECT league, day, driver_id, qualifying_position - label_position AS gain, day % 3 = 0 AS wet FROM {{results}}),
k AS (SELECT a.league, a.day, a.driver_id, round((avg(b.gain) FILTER (WHERE b.wet) - avg(b.gain) FILTER (WHERE NOT b.wet)) * count(b.day) FILTER (WHERE b.wet) / (count(b.day) FILTER (WHERE b.wet) + 5), 6) AS skill FROM g a LEFT JOIN g b ON a.league = b.league AND a.driver_id = b.driver_id AND b.day < a.day GROUP BY ALL),
q AS (SELECT s.league, s.day FROM {{starts}} s WHERE s.day % 3 = 0 AND (SELECT count(*) FROM {{starts}} e WHERE e.league = s.league AND e.day < s.day AND e.day % 3 = 0) >= 3),
u AS (SELECT a.league, a.day, a.league * 100 + a.day AS ev, a.driver_id, c.weight, a.utility + c.weight * coalesce(k.skill, 0) AS utility FROM {{utilities}} a JOIN q USING (league, day) LEFT JOIN k USING (league, day, driver_id) CROSS JOIN (SELECT unnest([0.0, 0.1, 0.2, 0.4]) AS weight) c),
x AS (SELECT u.*, d.draw, utility / 1.0 + round(-ln(-ln({U.format("'9|' || ev || '|' || d.draw || '|' || driver_id || '|order'")})), 9) AS key FROM u CROSS JOIN range(16) d(draw)),
r AS (SELECT *, row_number() OVER (PARTITION BY ev, weight, draw ORDER BY key DESC, driver_id) AS place FROM x),
m AS (SELECT league, day, ev, weight, driver_id, avg(CAST(place = 1 AS INT)) AS w, avg(CAST(place <= 3 AS INT)) AS p FROM r GROUP BY ALL),
c AS (SELECT *, greatest(least(0.9 * w + 0.1 / count(*) OVER (PARTITION BY ev, weight), 1 - 1e-15), 1e-15) AS win, greatest(least(0.9 * p + 0.1 * least(1, 3 / count(*) OVER (PARTITION BY ev, weight)), 1 - 1e-15), 1e-15) AS podium FROM m),
l AS (SELECT c.weight, c.ev, sum(-ln(win)) FILTER (WHERE label_position = 1) + avg(-ln(CASE WHEN coalesce(label_position <= 3, false) THEN podium ELSE 1 - podium END)) / 3 AS loss FROM c JOIN {{results}} USING (league, day, driver_id) GROUP BY c.weight, c.ev)"""


@query("H20_wet_skill_fit", f"WITH {WET} SELECT CAST(weight AS DOUBLE) AS weight, round(avg(loss), 6) AS loss, count(loss) AS events, row_number() OVER (ORDER BY round(avg(loss), 6), weight) = 1 AS chosen FROM l GROUP BY weight")
def _(t):
    """The weight of shrunk wet-weather gains with the least objective over wet events with three wet ones before them."""
    g = t("results").select(*KEY, F.expr("qualifying_position - label_position").alias("gain"), F.expr("day % 3 = 0").alias("wet"))
    skill = laps.wet_gain(g, ["league", "driver_id"], "day", "gain", "wet").select(*KEY, "skill")
    before = F.count(F.when(F.col("day") % 3 == 0, 1)).over(Window.partitionBy("league").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    scored = t("starts").select(*EVENT, before.alias("before")).filter("day % 3 = 0 and before >= 3").select(*EVENT)
    u = t("utilities").join(scored, EVENT, "left_semi").join(skill, KEY, "left").withColumn("ev", F.expr("league * 100 + day"))
    truth = t("results").select(F.expr("league * 100 + day").alias("ev"), "driver_id", "label_position")
    n, parts = F.count("*").over(Window.partitionBy("ev")), []
    for weight in WET_WEIGHTS:
        own = u.select("ev", "driver_id", (F.col("utility") + weight * F.coalesce("skill", F.lit(0.0))).alias("utility"))
        m = draws.rankings(own, "ev", "driver_id", "utility", 16, 9).groupBy("ev", "driver_id").agg(F.avg((F.col("place") == 1).cast("int")).alias("w"), F.avg((F.col("place") <= 3).cast("int")).alias("p"))
        parts.append(m.select("ev", "driver_id", F.lit(weight).alias("weight"), (0.9 * F.col("w") + 0.1 / n).alias("win"), (0.9 * F.col("p") + 0.1 * F.least(F.lit(1.0), 3 / n)).alias("podium")))
    shares = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).join(truth, ["ev", "driver_id"])
    won, podium = (F.coalesce(c, F.lit(False)) for c in (F.col("label_position") == 1, F.col("label_position") <= 3))
    grid = evaluate.objective(shares, ["weight"], "ev", won, podium)
    return grid.withColumn("chosen", F.row_number().over(Window.orderBy("loss", "weight")) == 1)  # one row for each weight


MIX = RANKED.replace("utility / 1.0 +", "CASE WHEN ('0x' || substr(md5('4|' || ev || '|' || d.draw), 1, 8))::BIGINT % 2 = 0 THEN utility ELSE utility / 2 END +")


@query("G04_mixture_draws", f"WITH {MIX} SELECT ev, driver_id, round(avg(CAST(place = 1 AS INT)), 6) AS win FROM r GROUP BY ev, driver_id")
def _(t):
    u = draws.exploded(utilities(t), 32)
    pick = F.pmod(evaluate.hashed(F.lit("4"), F.col("ev").cast("string"), F.col("draw").cast("string")), F.lit(2))
    key = F.when(pick == 0, F.col("utility")).otherwise(F.col("utility") / 2) + draws.gumbel(5, "order", "ev", "draw", "driver_id")
    u = u.withColumn("key", key).withColumn("retired", draws.uniform(5, "dnf", "ev", "draw", "driver_id") < F.col("p_dnf"))
    place = F.row_number().over(Window.partitionBy("ev", "draw").orderBy("retired", F.desc("key"), "driver_id"))
    return u.withColumn("place", place).groupBy("ev", "driver_id").agg(F.round(F.avg((F.col("place") == 1).cast("int")), 6).alias("win"))


@query("G11_calibrated_marginals", f"WITH {RANKED}, m AS (SELECT ev, driver_id, avg(CAST(place = 1 AS INT)) AS win, avg(CAST(place <= 3 AS INT)) AS podium FROM r GROUP BY ALL) SELECT ev, driver_id, round(0.8 * win + 0.2 / count(*) OVER w, 6) AS win, round(0.8 * podium + 0.2 * least(1, 3 / count(*) OVER w), 6) AS podium FROM m WINDOW w AS (PARTITION BY ev)")
def _(t):
    m = ranked(t).groupBy("ev", "driver_id").agg(F.avg((F.col("place") == 1).cast("int")).alias("win"), F.avg((F.col("place") <= 3).cast("int")).alias("podium"))
    n = F.count("*").over(Window.partitionBy("ev"))
    return m.select("ev", "driver_id", F.round(0.8 * F.col("win") + 0.2 / n, 6).alias("win"), F.round(0.8 * F.col("podium") + 0.2 * F.least(F.lit(1.0), 3 / n), 6).alias("podium"))


@query("H25_nearest_distance", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), d AS (SELECT a.vec_id, round(min(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) ** 2)))), 6) AS nearest FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.label >= 8 AND b.label < 8 GROUP BY a.vec_id) SELECT * FROM d")
def _(t):
    v = t("embeddings").select("vec_id", "label", "embedding", (F.col("label") < 8).alias("train"), F.expr("label >= 8 and vec_id % 20 = 0").alias("live"))
    return evaluate.nearest(v, "vec_id", "embedding", "label", "train", ask="live").select("vec_id", F.round("nearest", 6).alias("nearest"))


@query("H25_ood_verdict")
def _(t):
    v = t("embeddings").select("vec_id", "label", "embedding", (F.col("label") < 8).alias("train"))
    return evaluate.out_of_distribution(v, "vec_id", "embedding", "label", "train")


@query("H27_season_forecast_errors", "WITH f AS (SELECT league, season, driver_id, sum(points) AS final FROM {points} WHERE version = 1 GROUP BY ALL), n AS (SELECT league, season, count(*) AS n FROM {starts} GROUP BY ALL), h AS (SELECT league, season, driver_id, sum(points) * any_value(n) / 8.0 AS forecast FROM {points} JOIN n USING (league, season) WHERE version = 1 AND round <= 8 GROUP BY ALL) SELECT league, season, round(avg(abs(final - coalesce(forecast, 0))), 6) AS mae, count(*) AS n FROM f LEFT JOIN h USING (league, season, driver_id) GROUP BY league, season")
def _(t):
    """Each season's totals against a forecast from its first eight rounds."""
    key = ["league", "season"]
    d = t("points").filter("version = 1").groupBy(*key, "driver_id").agg(F.sum("points").alias("final"), F.coalesce(F.sum(F.when(F.col("round") <= 8, F.col("points"))), F.lit(0.0)).alias("half"))
    d = d.join(t("starts").groupBy(*key).agg(F.count("*").alias("rounds")), key)
    return d.groupBy(*key).agg(F.round(F.avg(F.abs(F.col("final") - F.col("half") * F.col("rounds") / 8)), 6).alias("mae"), F.count("*").alias("n"))


@query("H32_ablation_vs_previous", "WITH s AS (SELECT league, day, stage, -ln(least(greatest(p_win * w + (1 - w) / entrants, 1e-15), 1)) AS loss FROM {predictions} CROSS JOIN (VALUES (0, 0.2), (1, 0.6), (2, 1.0)) v(stage, w) WHERE model = 'grid' AND label_position = 1) SELECT CAST(a.stage AS INT) AS stage, round(avg(a.loss - b.loss), 6) AS delta FROM s a JOIN s b ON a.league = b.league AND a.day = b.day AND a.stage = b.stage + 1 GROUP BY a.stage")
def _(t):
    p = t("predictions").filter("model = 'grid' and label_position = 1").select(*EVENT, "p_win", "entrants", F.explode(F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(w).alias("w")) for i, w in enumerate((0.2, 0.6, 1.0))])).alias("s")).select(*EVENT, "p_win", "entrants", "s.*")
    d = p.withColumn("loss", -F.log(F.least(F.greatest(F.expr("p_win * w + (1 - w) / entrants"), F.lit(1e-15)), F.lit(1.0))))
    d = d.withColumn("delta", F.col("loss") - F.lag("loss").over(Window.partitionBy(*EVENT).orderBy("stage"))).filter("delta is not null")
    return d.groupBy("stage").agg(F.round(F.avg("delta"), 6).alias("delta"))


@query("H32_two_runs", f"""WITH o AS (SELECT model, league, day, p_win * 0.6 + 0.4 / entrants AS p FROM {{predictions}} WHERE label_position = 1 AND (league + day) % 17 <> 0), n AS (SELECT model, league, day, p_win AS p FROM {{predictions}} WHERE label_position = 1),
b AS (SELECT coalesce(o.model, n.model) AS model, o.p AS a, n.p AS b FROM o FULL JOIN n ON o.model = n.model AND o.league = n.league AND o.day = n.day)
SELECT model, count(*) FILTER (WHERE a IS NULL) AS only_new, count(*) FILTER (WHERE b IS NULL) AS only_old, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS events, round(avg(ln(greatest(a, 1e-15)) - ln(greatest(b, 1e-15))) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL), 6) AS delta FROM b GROUP BY model""")
def _(t):
    won = t("predictions").filter("label_position = 1")
    old = won.filter("(league + day) % 17 <> 0").select("model", *EVENT, F.expr("p_win * 0.6 + 0.4 / entrants").alias("p"))
    return evaluate.two_runs(old, won.select("model", *EVENT, F.col("p_win").alias("p")), ["model"], EVENT, "p")


@query("H35_run_summary", "SELECT league, string_agg(CAST(day AS VARCHAR) || ':' || CAST(entrants AS VARCHAR), ',' ORDER BY day) AS path, count(*) AS runs FROM {starts} GROUP BY league")
def _(t):
    g = t("starts").groupBy("league").agg(F.array_sort(F.collect_list(F.struct("day", "entrants"))).alias("p"), F.count("*").alias("runs"))
    return g.select("league", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["day"], x["entrants"])), ",").alias("path"), "runs")
