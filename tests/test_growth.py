"""Shapes of plans that keep tasks and shuffles in proportion to the rows, and the results of what they replaced."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitrank.operators import draws, folds, near, orders, trees
from pitrank.plans import streams
from pitrank.plans.fixtures import Tables


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_gradients_never_sort_rows_repeated_by_fold(spark):
    r = random.Random(8)
    rows = [(e, f"d{i}", i + 1 if (e + i) % 5 else None, r.gauss(-i, 2), r.gauss(0, 1), [f for f in (1, 2, 3) if (e + f) % 4]) for e in range(10) for i in range(e % 6 + 1)]
    d = spark.createDataFrame(rows, "e int, d string, place int, a double, b double, folds array<int>")
    fits = spark.createDataFrame([(f, c, 0.1 * f, 1.5) for f in (1, 2, 3) for c in "ab"], "fold int, feature string, weight double, scale double")
    got = orders.gradients(d, ["e"], "place", "d", ["a", "b"], "folds", fits)
    assert "Window" not in plan(got)
    by = {x.fold: x for x in got.collect()}
    for fold in (1, 2, 3):
        total, events, n = [0.1 * fold] * 2, 0, 0
        for e in range(10):
            own = sorted((x for x in rows if x[0] == e and fold in x[5]), key=lambda x: (x[2] is None, x[2] or 0, x[1]))
            stages = min(sum(x[2] is not None for x in own), len(own) - 1)
            events, n = events + (stages > 0), n + len(own) * (stages > 0)
            for k in range(stages):
                e_ = [2.718281828459045 ** (0.1 * fold * (x[3] + x[4]) / 1.5) for x in own[k:]]
                for j in (0, 1):
                    total[j] += (sum(w * x[3 + j] for w, x in zip(e_, own[k:], strict=True)) / sum(e_) - own[k][3 + j]) / 1.5
        assert (by[fold].events, by[fold].rows) == (events, n) and abs(by[fold].largest - max(map(abs, total))) < 1e-9


def test_tasks_of_draws_are_dealt_by_size(spark, monkeypatch):
    d = spark.createDataFrame([(e, f"d{i}", float(i % 3), 0.1 * (i % 2)) for e in range(50) for i in range(4)], "ev int, d string, u double, p double")
    few = draws.rankings(d, "ev", "d", "u", 8, 3, 0.5, "p")
    assert few.rdd.getNumPartitions() == 16
    monkeypatch.setattr(draws, "DRAWN", 32)
    many = draws.rankings(d, "ev", "d", "u", 8, 3, 0.5, "p")
    assert many.rdd.getNumPartitions() == 50 and sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_training_rows_of_logistic_fits_are_not_repeated(spark, data):
    t = Tables(spark, data)
    d, f = streams.matrix(t), streams.cohorts(t)
    rows = streams.fold_rows(t, d, f)
    assert rows.count() == d.join(f.select("league", F.col("train").alias("day")).distinct(), ["league", "day"]).count()
    plain = folds.training_rows(d.drop("cutoff"), f, ["league"], "day", t("starts"), "label_dnf", "label_dnf_available_at")
    want = {(r.test, r.league, r.train, r.driver_id): r.label_dnf for r in plain.collect()}
    got = {(x, r.league, r.day, r.driver_id): r.label_dnf if x in r.dnf_folds else None for r in rows.collect() for x in r.folds}
    assert got == want


def test_feeds_make_their_rows_once(spark):
    d = spark.range(12).withColumn("x", F.col("id") * 2)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    feed = streams.fed(d.mapInArrow(counted, d.schema), ["id < 4", "id >= 4 and id < 8", "id >= 8"], files=1)
    assert feed.isStreaming and made.value == 12


def test_cells_are_summed_before_they_are_dealt_to_folds(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    own = [[(f, day(f)) for f in range(4, 29)], [(f, day(f)) for f in range(9, 29)], []]
    rows = [([i % 3], None if i % 5 == 0 else float(i % 7), i % 4 == 0, day(3 + i % 8) if i % 6 else None, own[i % 10 if i % 10 < 3 else 0]) for i in range(4000)]
    d = spark.createDataFrame(rows, "bins array<int>, place double, dnf boolean, known timestamp_ntz, own array<struct<fold:long,at:timestamp_ntz>>")
    kinds = {"place": ("place", None), "dnf": ("dnf", "known")}
    got = trees.cells(d, "own", kinds)
    dealt = plan(got)
    assert dealt.rindex("Generate explode(own") < dealt.rindex("Aggregate [set")  # the aggregate feeds the explode
    want = {}
    for bins, place, dnf, known, x in rows:
        for f, at in x:
            for kind, y, ok in (("place", place, True), ("dnf", float(dnf), known is None or known <= at)):
                if y is not None and ok:
                    n, total = want.get((f, kind, bins[0]), (0, 0.0))
                    want[f, kind, bins[0]] = n + 1, total + y
    assert {(r.fold, r.kind, r.bins[0]): (r.n, r.y) for r in got.collect()} == want


def test_trees_are_walked_once_for_each_cell(spark):
    d = spark.range(3000).select((F.col("id") % 2).alias("fold"), F.array((F.col("id") % 3).cast("int")).alias("bins"), F.col("id").alias("x"))
    forest = trees.grow(spark.createDataFrame([(f, "place", [b], 10.0, 10.0 * b + f) for f in (0, 1) for b in range(3)], "fold long, kind string, bins array<int>, n double, y double"), set(), 3, trees=2)
    got = trees.predicted(d.union(spark.createDataFrame([(7, [0], -1)], d.schema)), forest, "fold", ["place"])
    shape = plan(got)
    assert "MapInArrow" in shape and "Aggregate [fold" in shape[shape.index("MapInArrow") :]
    by = {}
    for r in got.collect():
        by.setdefault((r.fold, r.bins[0]), []).append(r.place)
    assert {k: len(v) for k, v in by.items()} == {**{(f, b): 500 for f in (0, 1) for b in range(3)}, (7, 0): 1} and by[7, 0] == [None]
    assert all(len(set(v)) == 1 for v in by.values()) and by[0, 0][0] < by[0, 1][0] < by[0, 2][0]


def test_sums_of_many_tasks_are_those_of_few(spark, monkeypatch):
    table = spark.createDataFrame([(f, k, [a, b], 6.0, float((a * 3 + b + f) % 5)) for f in (1, 2) for k in ("place", "dnf") for a in range(4) for b in range(4)], "fold long, kind string, bins array<int>, n double, y double")
    few = trees.grow(table, {"dnf"}, 4, trees=12)
    monkeypatch.setattr(trees, "CELLS", 5)
    monkeypatch.setattr(trees, "ADDED", 3)
    many = trees.grow(table, {"dnf"}, 4, trees=12)
    assert (few.feature == many.feature).all() and (few.bin == many.bin).all() and abs(few.value - many.value).max() < 1e-12


def test_queries_of_fits_read_their_rows_once(spark, data):
    t = Tables(spark, data)
    streams.matrix(t)
    assert streams.learners(t, streams.cohorts(t)).count() and "starts" not in t.made
    assert sorted(streams.starts(t).select("league", "day", "cutoff", "label_available_at").collect()) == sorted(t("starts").select("league", "day", "cutoff", "label_available_at").collect())


def test_asking_rows_leave_python_once(spark):
    g = random.Random(5)
    rows = [(i, [g.gauss(0, 1) for _ in range(24)], i % 3, i % 4 > 0) for i in range(600)]
    d, at, seen = near.dealt(spark.createDataFrame(rows, "id int, v array<double>, e int, t boolean"), "id", "v", "e", "t", 5, None)
    asks = near.asking(d, at, seen)
    assert sorted(r.id for r in asks.select("id").collect()) == list(range(600))  # not once for each block
    assert max(r.n for r in asks.selectExpr("size(to) as n").collect()) <= len(at) + 1
    out = near.needed(d, at, seen)
    blocks = sum(n for n, _ in seen.values())
    assert blocks > 120 and out.count() > 600 * 50 and out.filter("tk = k and tp = part").count() == 0 and out.filter("tk < 0").count() == 600
    want = {(r.id, k, p) for r in asks.collect() for k in r.to if k >= 0 for p in range(seen[k][0]) if (k, p) != (r.k, r.part)}
    assert {(r.id, r.tk, r.tp) for r in out.filter("tk >= 0").select("id", "tk", "tp").collect()} == want
    got = {r.id: r.nearest for r in near.nearest(spark.createDataFrame(rows, "id int, v array<double>, e int, t boolean"), "id", "v", "e", "t", block=5).collect()}
    least = lambda x: min(sum((a - b) ** 2 for a, b in zip(x[1], y[1], strict=True)) ** 0.5 for y in rows if y[3] and y[2] != x[2])
    assert len(got) == 600 and all(abs(got[x[0]] - least(x)) < 1e-9 for x in rows[::7])
