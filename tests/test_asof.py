"""Point-in-time selection, with the boundary of every clock."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pitrank.operators import asof, form

AT = datetime(2024, 3, 1, 12)
H = timedelta(hours=1)


def versions(spark, *rows):
    return spark.createDataFrame([(k, AT + d * H, AT, v) for k, d, v in rows], "k string, available_at timestamp_ntz, cutoff timestamp_ntz, v int")


def test_version_at_the_cutoff_counts_and_a_later_one_does_not(spark):
    d = versions(spark, ("a", -2, 1), ("a", 0, 2), ("a", 1, 3), ("b", 1, 4))
    assert [(r.k, r.v) for r in asof.latest(d, ["k"], "available_at", ["v"], "cutoff").collect()] == [("a", 2)]
    assert [(r.k, r.v) for r in asof.latest(d, ["k"], "available_at", ["v"], "cutoff", strict=True).collect()] == [("a", 1)]


def test_two_values_at_the_newest_clock_are_ambiguous(spark):
    r = asof.latest(versions(spark, ("a", -1, 1), ("a", -1, 2)), ["k"], "available_at", ["v"], "cutoff").first()
    assert r.ambiguous and r.v is None


def test_recalled_version_does_not_bring_back_an_older_one(spark):
    d = versions(spark, ("a", -3, 1), ("a", -2, 2)).withColumn("recalled", F.col("v") == 2)
    assert asof.not_recalled(d, ["k"], ["available_at", "v"]).count() == 0


def test_value_after_its_cutoff_is_null_with_a_reason(spark):
    rows = versions(spark, ("a", 0, 1), ("b", 1, 2)).select("k", *asof.gated("v", "available_at", "cutoff")).orderBy("k").collect()
    assert [(r.v, r.v_reason) for r in rows] == [(1, None), (None, "published_after_cutoff")]


def rolling(spark, late=False):
    rows, starts = [], []
    for n, place in enumerate([1, 2, 3, 4], 1):
        cutoff = AT + timedelta(days=n)
        label = cutoff + (timedelta(days=9) if late and n == 2 else 18 * H)
        rows.append((1, n, "d", place, n == 1))
        starts.append((1, n, cutoff, label))
    return spark.createDataFrame(rows, "s int, r int, d string, label_position int, label_dnf boolean"), spark.createDataFrame(starts, "s int, r int, cutoff timestamp_ntz, label timestamp_ntz")


def test_contiguous_window_by_hand(spark):
    rows, starts = rolling(spark)
    got = {r.r: r for r in form.contiguous_window(rows, starts, ["s"], "d", "r", "cutoff", "label", 3).collect()}
    assert (got[4].finish_mean, got[4].dnf_rate, got[4].history_count) == (2.0, 0.333333, 3)
    assert got[3].finish_mean is None and got[3].history_count == 0


def test_one_late_label_closes_the_window(spark):
    rows, starts = rolling(spark, late=True)
    got = {r.r: r for r in form.contiguous_window(rows, starts, ["s"], "d", "r", "cutoff", "label", 3).collect()}
    assert got[4].finish_mean is None


def test_row_after_the_cutoff_changes_nothing(spark):
    d = versions(spark, ("a", -2, 1))
    more = d.union(versions(spark, ("a", 5, 9)))
    f = lambda x: asof.latest(x, ["k"], "available_at", ["v"], "cutoff").collect()
    assert f(d) == f(more.repartition(7))
