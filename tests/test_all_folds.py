"""Trees, order models, calibration and refits of all folds at once against plain versions of one fold."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitrank.operators import calibrate, evaluate, models, orders, trees
from pitrank.plans import registry, streams
from pitrank.plans.fixtures import Tables

AT = dt.datetime(2024, 1, 1)


def boosted(x, y, logistic, number, bins, rate=0.05, penalty=1.0, least=5):
    """Plain boosting of depth 3 on binned rows; returns a function of bins."""
    base = math.log(y.mean() / (1 - y.mean())) if logistic else y.mean()
    score, made = np.full(len(y), base), []

    def best(rows, g, h):
        found = None
        for j in range(x.shape[1]):
            for b in range(bins):
                left = rows[x[rows, j] <= b]
                right = rows[x[rows, j] > b]
                if min(len(left), len(right)) >= least:
                    gain = round(g[left].sum() ** 2 / (h[left].sum() + penalty) + g[right].sum() ** 2 / (h[right].sum() + penalty) - g[rows].sum() ** 2 / (h[rows].sum() + penalty), 9)
                    if gain > 0 and (found is None or gain > found[0]):
                        found = gain, j, b
        return found

    def tree(rows, g, h, depth):
        split = best(rows, g, h) if depth else None
        if split is None:
            return -rate * g[rows].sum() / (h[rows].sum() + penalty)
        _, j, b = split
        return j, b, tree(rows[x[rows, j] <= b], g, h, depth - 1), tree(rows[x[rows, j] > b], g, h, depth - 1)

    def value(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for _ in range(number):
        p = 1 / (1 + np.exp(-score)) if logistic else score
        made.append(tree(np.arange(len(y)), p - y, p * (1 - p) if logistic else np.ones(len(y)), 3))
        score = score + np.array([value(made[-1], r) for r in x])
    return lambda row: base + sum(value(n, row) for n in made)


def test_trees_of_all_folds_and_kinds(spark):
    r = random.Random(4)
    edges = {"a": [0.5, 1.5, 2.5, 3.5], "b": [10.0, 20.0, 30.0]}
    rows = []
    for i in range(260):
        a, b = r.randrange(0, 6), r.uniform(0, 40)
        own = [(1, AT + dt.timedelta(days=5))] * (i % 3 > 0) + [(2, AT + dt.timedelta(days=20))] * (i % 5 > 0)
        rows.append((float(a) if i % 40 else None, b, a * 0.3 + math.sin(b / 6) + r.gauss(0, 0.1) if i % 7 else None, (a + b / 10 + r.gauss(0, 2) > 5) if i % 6 else None, AT + dt.timedelta(days=i % 10), own))
    d = spark.createDataFrame(rows, "a double, b double, place double, dnf boolean, at timestamp_ntz, folds array<struct<fold:long,at:timestamp_ntz>>")
    d = trees.binned(d.withColumn("dnf", F.col("dnf").cast("int")), edges).repartition(3)
    table = trees.cells(d, "folds", {"place": ("place", None), "dnf": ("dnf", "at"), "never": ("place", None)})
    forest = trees.grow(table.filter("kind <> 'never'"), {"dnf"}, 5, trees=12)
    got = {(x.fold, x.a, x.b): x for x in trees.predicted(d.select("a", "b", "bins", F.explode(F.array(F.lit(1), F.lit(2))).alias("fold")), forest, "fold", ["place", "dnf", "never"]).collect()}
    bins = lambda x: [sum((x[0] if x[0] is not None else -1) > e for e in edges["a"]), sum(x[1] > e for e in edges["b"])]
    for fold, clock in ((1, AT + dt.timedelta(days=5)), (2, AT + dt.timedelta(days=20))):
        train = [x for x in rows if fold in [f for f, _ in x[5]]]
        for kind, own, logistic in (("place", [x for x in train if x[2] is not None], False), ("dnf", [x for x in train if x[3] is not None and x[4] <= clock], True)):
            f = boosted(np.array([bins(x) for x in own]), np.array([float(x[2] if kind == "place" else x[3]) for x in own]), logistic, 12, 5)
            for x in rows[:60]:
                want = f(bins(x))
                assert abs(got[fold, x[0], x[1]][kind] - (1 / (1 + math.exp(-want)) if logistic else want)) < 1e-9
    assert all(x.never is None for x in got.values())
    assert not trees.grow(table.limit(0), {"dnf"}, 5, trees=2).pairs


def test_order_models_of_all_folds(spark):
    r = random.Random(2)
    rows, by = [], {}
    for e in range(12):
        n, own = r.randrange(1, 9), [f for f in (1, 2, 3) if (e + f) % 3]
        places = r.sample(range(1, n + 1), n)
        for i in range(n):
            place = places[i] if (e + i) % 4 and e != 7 else None
            x = (r.gauss(-(place or 5) / 3, 1), r.gauss(0, 4))
            rows.append((e, f"d{i}", place, *x, own))
            by.setdefault(e, []).append((place is None, place, f"d{i}", x, own))
    d = spark.createDataFrame(rows, "e int, d string, place int, a double, b double, folds array<int>").repartition(3)
    fits = orders.fit_orders(orders.packed(d, ["e"], "place", "d", ["a", "b"], "folds"), ["a", "b"])
    got = {(x.fold, x.feature): x for x in fits.collect()}
    assert max(x.norm for x in got.values()) < 1e-8
    for fold in (1, 2, 3):
        events = [sorted(v, key=lambda x: (x[0], x[1] or 0, x[2])) for v in by.values() if fold in v[0][4]]
        events = [v for v in events if min(sum(not x[0] for x in v), len(v) - 1) > 0]
        scale = np.std(np.array([x[3] for v in events for x in v]), axis=0)
        assert np.allclose([got[fold, c].scale for c in "ab"], scale)

        def loss(beta, events=events, scale=scale):
            total = beta @ beta / 2
            for v in events:
                u = np.array([x[3] for x in v]) / scale @ beta
                for k in range(min(sum(not x[0] for x in v), len(v) - 1)):
                    total += np.log(np.exp(u[k:]).sum()) - u[k]
            return total

        at = np.array([got[fold, c].weight for c in "ab"])
        for step in np.eye(2) * 1e-4:
            assert loss(at) < min(loss(at + step), loss(at - step)) and abs(loss(at + step) - loss(at - step)) < 1e-9
    check = orders.gradients(d, ["e"], "place", "d", ["a", "b"], "folds", fits).collect()
    assert len(check) == 3 and all(x.largest < 1e-8 for x in check)
    moved = fits.withColumn("weight", F.col("weight") + 0.01)
    assert all(x.largest > 1e-4 for x in orders.gradients(d, ["e"], "place", "d", ["a", "b"], "folds", moved).collect())


@pytest.mark.parametrize("kind", ["random", "rising", "falling", "equal"])
def test_isotonic_pools_of_parts_are_the_pools_of_all(spark, kind):
    r = random.Random(7)
    rows = []
    for i in range(400):
        p = round(r.random(), 2)
        y = {"random": r.random() < p, "rising": i % 20 != 3 and p > 0.5, "falling": p < 0.5, "equal": i % 2 == 0}[kind]
        rows.append((p, y if i % 9 else None))
    d = spark.createDataFrame(rows, "p double, y boolean").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        fit, reason = calibrate.fit_isotonic(d, "p", "y")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert reason is None
    known = sorted((min(max(p, 1e-6), 1 - 1e-6), y) for p, y in rows if y is not None)
    scores = sorted({p for p, _ in known})
    mean = lambda a, b: np.mean([y for p, y in known if a <= p <= b])
    for i, p in enumerate(scores):
        want = max(min(mean(a, b) for b in scores[i:]) for a in scores[: i + 1])
        assert abs([s / w for lo, hi, w, s in fit if lo <= p <= hi][0] - want) < 1e-9
    assert sum(b[2] for b in fit) == len(known)
    assert calibrate.fit_isotonic(d.limit(50), "p", "y") == (None, "insufficient_labels")
    assert calibrate.apply_isotonic(d, None, "p", "q").filter("p <> q").count() == 0
    out = calibrate.apply_isotonic(spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (None,)], "p double"), fit, "p", "q").collect()
    assert out[3].q is None and 0 < out[0].q <= out[1].q <= out[2].q < 1


def test_sigmoid_needs_labels_and_penalises_the_slope(spark):
    rows = [(k / 40, k % 3 == 0 or k > 30) for k in range(1, 40)]
    d = spark.createDataFrame(rows, "p double, y boolean")
    (a, b), reason = calibrate.fit_sigmoid(d, "p", "y")
    x, y = np.array([math.log(p / (1 - p)) for p, _ in rows]), np.array([float(v) for _, v in rows])
    q = 1 / (1 + np.exp(-(a + b * x)))
    assert reason is None and abs((q - y).sum()) < 1e-6 and abs(((q - y) * x).sum() + b) < 1e-6
    assert calibrate.fit_sigmoid(d.limit(9), "p", "y") == (None, "insufficient_labels")
    assert calibrate.fit_sigmoid(d.withColumn("y", F.col("p") > 0.95), "p", "y")[0] is None


def test_bootstrap_spread_of_one_test_day(spark, data):
    t = Tables(spark, data)
    d, f = streams.matrix(t), streams.cohorts(t)
    own = f.filter("test = 22").select("league", F.col("train").alias("day"), F.lit(22).alias("fold"))
    often = {}
    for r in evaluate.resampled(f.select(F.col("test").alias("fold"), "league", F.col("train").alias("day")), ["league", "day"], streams.RESAMPLES, 99, "fold").filter("fold = 22").collect():
        often[r.b, r.league, r.day] = r.often
    assert {sum(n for (b, *_), n in often.items() if b == k) for k in range(streams.RESAMPLES)} == {own.count()}
    rows = d.collect()
    test = [r for r in rows if r.day == 22]
    u = []
    for b in range(streams.RESAMPLES):
        train = [r for r in rows if r.label_position is not None for _ in range(often.get((b, r.league, r.day), 0))]
        x = np.array([[1.0, *[r[c] for c in streams.FEATURES]] for r in train])
        w = np.linalg.solve(x.T @ x + np.diag([1e-9, 1, 1, 1]), x.T @ np.array([r.label_position for r in train], float))
        place = {(r.league, r.driver_id): np.array([1.0, *[r[c] for c in streams.FEATURES]]) @ w for r in test}
        u.append({k: np.mean([p for (g, _), p in place.items() if g == k[0]]) - v for k, v in place.items()})
    got = {(r.league, r.driver_id): r.spread for r in registry.QUERIES["F18_bootstrap_spread"](spark, data).filter("day = 22").collect()}
    assert set(got) == {(r.league, r.driver_id) for r in test}
    assert all(abs(v - np.std([x[k] for x in u])) < 2e-4 for k, v in got.items())
    assert models.solved([2.0, 0.0, 3.0, 4.0, 6.0], 2)[0] == pytest.approx(2.0)
