"""Hand-computed cases of ledger, evaluation, draws, quality and folds."""

import math

from pyspark.sql import functions as F

from pitrank.operators import draws, evaluate, folds, ledger, quality


def test_countback_breaks_ties_and_full_ties_are_null(spark):
    d = spark.createDataFrame([("a", 10.0, [1, 0]), ("b", 10.0, [0, 2]), ("c", 5.0, [0, 1]), ("d", 5.0, [0, 1])], "i string, p double, w array<int>").withColumn("k", F.lit(1))
    got = {r.i: r.s for r in d.withColumn("s", ledger.countback(d, ["k"], "p", "w")).collect()}
    assert got == {"a": 1, "b": 2, "c": None, "d": None}


def test_at_most_k_caps_and_keeps_the_sum(spark):
    d = spark.createDataFrame([("a", 0.8), ("b", 0.1), ("c", 0.05), ("d", 0.05)], "ident string, p double").withColumn("k", F.lit(1))
    got = {r.ident: r.capped for r in draws.at_most(d, ["k"], "p", 2).collect()}
    assert got["a"] == 1.0 and math.isclose(sum(got.values()), 2.0, abs_tol=1e-5)


def test_draws_are_permutations_and_do_not_depend_on_partitions(spark):
    d = spark.createDataFrame([(1, f"e{i}", -0.3 * i, 0.1) for i in range(8)], "ev long, ident string, u double, p double")
    f = lambda x: sorted(map(tuple, draws.rankings(x, "ev", "ident", "u", 16, 3, p_dnf="p").collect()))
    got = f(d)
    assert got == f(d.repartition(5))
    assert all(sorted(r[4] for r in got if r[2] == k) == list(range(1, 9)) for k in range(16))


def test_reliability_puts_one_into_the_last_bin(spark):
    d = spark.createDataFrame([(1.0, True), (0.95, False), (0.0, False)], "p double, y boolean")
    got = {r.bin: (r.share, r.n) for r in evaluate.reliability(d, [], "p", F.col("y")).collect()}
    assert got == {9: (0.5, 2), 0: (0.0, 1)}


def test_order_likelihood_of_equal_utilities(spark):
    d = spark.createDataFrame([(1, 0.0, i) for i in (1, 2, 3)], "e int, u double, place int")
    assert math.isclose(folds.order_likelihood(d, ["e"], "u", "place").first().log_likelihood, -math.log(6), abs_tol=1e-6)


def test_folds_need_labels_known_by_the_cutoff(spark):
    d = spark.createDataFrame([(1, i, i * 10, i * 10 + (25 if i == 2 else 5)) for i in range(1, 6)], "l int, day int, cutoff int, label int")
    got = sorted(map(tuple, folds.rolling_folds(d, ["l"], "day", "cutoff", "label", 2).collect()))
    assert (1, 4, 2) not in got and (1, 5, 2) in got and (1, 4, 3) in got


def test_every_candidate_is_in_a_tier_or_excluded(spark):
    d = spark.createDataFrame([("a", 1, False, 1), ("a", 2, False, 1), ("b", 3, True, 1)], "k string, o int, bad boolean, t int")
    got = {r.o: (r.tier, r.reasons) for r in quality.tiered(d, ["k"], "o", {"bad": F.col("bad")}, "t").collect()}
    assert got == {1: (1, []), 2: (None, ["duplicate"]), 3: (None, ["bad"])}


def test_empty_tables_give_empty_results(spark):
    d = spark.createDataFrame([], "e int, u double, place int")
    assert folds.order_likelihood(d, ["e"], "u", "place").count() == 0
    assert evaluate.reliability(spark.createDataFrame([], "p double, y boolean"), [], "p", F.col("y")).count() == 0


def test_ood_verdict_is_brute_force_over_all_rows(spark, data):
    import numpy as np

    from pitrank.plans import registry

    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    v, label = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    gap = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
    gap[:, label >= 8] = np.inf
    gap[label[:, None] == label[None, :]] = np.inf
    best = gap.min(axis=1)
    threshold = np.quantile(best[label < 8], 0.99)
    want = {r.vec_id: (x, x > threshold) for r, x in zip(rows, best, strict=True) if r.label >= 8}
    got = registry.QUERIES["H25_ood_verdict"](spark, data).collect()
    assert {r.vec_id for r in got} == set(want) and len(got) == len(want)
    assert all(math.isclose(r.nearest, want[r.vec_id][0], abs_tol=1e-6) and r.far == want[r.vec_id][1] and math.isclose(r.threshold, threshold, abs_tol=1e-6) for r in got)
    whole = spark.read.parquet(f"{data}/embeddings.parquet").withColumn("train", F.col("label") < 8)
    dealt = {r.vec_id: r.nearest for r in evaluate.nearest(whole, "vec_id", "embedding", "label", "train", 100).collect()}
    assert len(dealt) == len(rows) and all(math.isclose(dealt[r.vec_id], x, abs_tol=1e-9) for r, x in zip(rows, best, strict=True))


def test_summaries_of_the_same_rows_are_equal_in_any_order(spark):
    d = spark.createDataFrame([(1, 1e16), (1, 1.0), (1, -1e16), (2, None), (2, 4.0), (3, None)], "e int, best double")
    f = lambda x: sorted(map(tuple, quality.summarised(x.coalesce(1), ["e"], "best").collect()))
    up, down = f(d.orderBy("best")), f(d.orderBy(F.desc("best")))
    assert up == down == f(d) and up[1:] == [(2, 2, 4.0), (3, 1, None)]
