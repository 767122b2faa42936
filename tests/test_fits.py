"""Fits of all folds at once against fits of one fold after another."""

import numpy as np
from pyspark.sql import functions as F

from pitrank.operators import evaluate, models
from pitrank.plans import registry, streams
from pitrank.plans.fixtures import Tables

PENALTY = np.array([0.0, 1.0, 1.0, 1.0])


def design(rows):
    return np.array([[1.0, *[r[f] for f in streams.FEATURES]] for r in rows])


def ridge(rows):
    known = [r for r in rows if r.label_position is not None]
    x = design(known)
    return np.linalg.solve(x.T @ x + np.diag(PENALTY), x.T @ np.array([r.label_position for r in known], float))


def logistic(x, y):
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(PENALTY), x.T @ (p - y) + PENALTY * b)
    return b


def test_out_of_fold_is_one_fit_for_every_eligible_test_day(spark, data):
    t = Tables(spark, data)
    rows, starts = streams.matrix(t).collect(), t("starts").collect()
    got = streams.oof(t).collect()
    events = {}
    for a in starts:
        earlier = [e.day for e in starts if e.league == a.league and e.cutoff < a.cutoff and e.label_available_at <= a.cutoff]
        if len(earlier) >= 5:
            events[a.league, a.day] = (a.cutoff, set(earlier))
    assert len({d for _, d in events}) > 20
    assert sorted((r.league, r.day, r.driver_id) for r in got) == sorted((r.league, r.day, r.driver_id) for r in rows if (r.league, r.day) in events)
    for day in sorted({d for _, d in events})[::6]:
        own = {league: x for (league, d), x in events.items() if d == day}
        train = [r for r in rows if r.league in own and r.day in own[r.league][1]]
        dnf = [r for r in train if r.label_dnf is not None and r.label_dnf_available_at <= own[r.league][0]]
        won, place = logistic(design(train), np.array([r.label_position == 1 for r in train], float)), ridge(train)
        out = logistic(design(dnf), np.array([r.label_dnf for r in dnf], float))
        test = [r for r in got if r.day == day]
        x = design(test)
        assert np.allclose([r.place_ridge for r in test], x @ place, atol=1e-6)
        assert np.allclose([r.p_win for r in test], 1 / (1 + np.exp(-x @ won)), atol=1e-6)
        assert np.allclose([r.p_dnf for r in test], 1 / (1 + np.exp(-x @ out)), atol=1e-6)


def test_weights_of_a_ridge_fit_are_repeated_rows(spark):
    d = spark.createDataFrame([(0, float(i), float(i * i % 7), i % 3) for i in range(12)], "f int, x double, y double, n int")
    again = d.withColumn("k", F.expr("explode(array_repeat(0, n))"))
    assert np.allclose(models.ridge_by_fold(d, "f", ["x"], "y", "n")[0], models.ridge_by_fold(again, "f", ["x"], "y")[0])
    assert not np.allclose(models.ridge_by_fold(d, "f", ["x"], "y", "n")[0], models.ridge_by_fold(d.filter("n > 0"), "f", ["x"], "y")[0])


def test_resamples_take_as_many_events_as_there_are(spark):
    d = spark.range(50).withColumnRenamed("id", "e").repartition(7)
    got = evaluate.resampled(d, ["e"], 20, 1).collect()
    assert {sum(r.often for r in got if r.b == b) for b in range(20)} == {50} and max(r.often for r in got) > 2
    assert sorted(r.i for r in evaluate.numbered(d, ["e"]).collect()) == list(range(50))


def test_bootstrap_and_trees_and_temperatures_cover_their_test_events(spark, data):
    spread = registry.QUERIES["F18_bootstrap_spread"](spark, data).collect()
    assert spread and all(r.spread > 0 for r in spread if sum(x.league == r.league for x in spread) > 1)
    composed = registry.QUERIES["F21_composed_model"](spark, data)
    assert composed.select("day").distinct().count() > 20
    assert all(abs(r.p - 1) < 1e-2 for r in composed.groupBy("league", "day").agg(F.sum("p_win").alias("p")).collect())


def test_backtest_has_every_model_on_every_test_row(spark, data):
    rows = registry.QUERIES["F22_predictions"](spark, data).collect()
    fits = {(r.league, r.day, r.driver_id): r for r in registry.QUERIES["F05_logistic_fits"](spark, data).collect()}
    by = {m: {(r.league, r.day, r.driver_id): r for r in rows if r.model == m} for m in ("linear", "trees", "order", "heuristic")}
    assert all(set(own) == set(fits) for own in by.values()) and len(rows) == 4 * len(fits)
    for own in by.values():
        events = {}
        for (league, day, _), r in own.items():
            events.setdefault((league, day), []).append(r)
        for e in events.values():
            assert sorted(r.place for r in e) == list(range(1, len(e) + 1)) and abs(sum(r.p_win for r in e) - 1) < 0.01
            assert all(1 <= r.expected <= len(e) for r in e)
    for k, r in by["linear"].items():
        assert abs(r.p_podium - fits[k].p_podium) < 1e-3 and 0 <= r.p_dnf <= 1
    assert all(r.p_dnf is not None and 0 <= r.p_dnf <= 1 for r in by["trees"].values())
    metrics = {r.model: r for r in registry.QUERIES["F22_metrics"](spark, data).collect()}
    assert {r.n for r in metrics.values()} == {len(fits)} and len(metrics) == 4 and all(r.winner_loss > 0 for r in metrics.values())
