"""History in one pass over clocks, and nearest rows by pivots, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from pitrank.operators import history, near


def test_sums_and_buffers_are_those_of_the_facts_known_before_each_cutoff(spark):
    r = random.Random(3)
    facts = [(k, o, o * 10 + r.choice([1, 5, 9, 27, 60]), r.choice([None, 1, 2, 3, 9])) for k in "abc" for o in range(1, 40) if r.random() < 0.7]
    facts += [("a", 99, None, 5)]
    targets = [(k, o, o * 10, "x") for k in "abd" for o in range(1, 45)]
    f = spark.createDataFrame(facts, "k string, o int, clock int, v int").repartition(3)
    t = spark.createDataFrame(targets, "k string, o int, at int, h string")
    for strict in (True, False):
        d = history.known(f, t.withColumnRenamed("h", "more"), ["k"], "clock", "at", {"n": F.lit(1), "total": F.col("v")}, {"h": (4, ["o", "v"])}, strict)
        got = {(x.k, x.o): x for x in d.collect()}
        assert len(got) == len(targets)
        for k, o, at, _ in targets:
            known = sorted((x for x in facts if x[0] == k and x[2] is not None and (x[2] < at or (x[2] == at and not strict))), key=lambda x: -x[1])
            assert got[k, o].n == len(known) and got[k, o].total == sum(x[3] or 0 for x in known)
            assert [(x.o, x.v) for x in got[k, o].h] == [(x[1], x[3]) for x in known[:4]]


def test_no_fact_is_paired_with_later_cutoffs(spark):
    f = spark.createDataFrame([("a", i, i) for i in range(300)], "k string, o int, clock int")
    t = spark.createDataFrame([("a", i, i) for i in range(300)], "k string, o int, at int")
    plan = history.known(f, t, ["k"], "clock", "at", {"n": F.lit(1)}, {"h": (3, ["o"])})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Expand" not in plan and plan.count("Window") >= 1


def test_nearest_rows_by_pivots(spark):
    g = np.random.default_rng(2)
    centres = g.normal(size=(12, 6)) * 20
    rows = [(i, (centres[i % 12] + g.normal(size=6)).tolist(), int(g.integers(0, 5)), bool(i % 4)) for i in range(1500)]
    rows += [(2000, [500.0] * 6, 3, False), (2001, rows[5][1], 9, True)]
    d = spark.createDataFrame(rows, "id int, v array<double>, e int, t boolean").repartition(4)
    want = {}
    train = [x for x in rows if x[3]]
    for i, v, e, _ in rows:
        gaps = [np.sqrt(((np.array(v) - np.array(x[1])) ** 2).sum()) for x in train if x[2] != e]
        want[i] = min(gaps)
    got = {x.id: x.nearest for x in near.nearest(d, "id", "v", "e", "t", block=60).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    dealt, at, seen = near.dealt(d, "id", "v", "e", "t", 60, None)
    pairs = near.needed(dealt, at, seen).filter("tk >= 0").select("k", "part", "tk", "tp").distinct().count()
    blocks = sum(n for n, _ in seen.values())
    assert blocks >= 20 and 0 < pairs < blocks * (blocks - 1) / 3  # most pairs of blocks are ruled out
    few = near.nearest(d.filter("id < 3"), "id", "v", "e", "t").collect()
    assert len(few) <= 3 and near.nearest(d.limit(0), "id", "v", "e", "t").count() == 0
    lone = near.nearest(d.withColumn("e", F.lit(1)), "id", "v", "e", "t")
    assert lone.count() == 0
