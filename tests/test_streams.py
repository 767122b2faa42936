"""Freezing of feeds that come out of order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitrank.plans import fixtures, registry
from pitrank.plans.streams import drained, fed
from pitrank.streaming import machines
from pitrank.streaming import publications as stream

DAY = dt.timedelta(days=1)


@pytest.mark.parametrize("delay, kept", [("3 days", {1, 2, 3}), ("0 seconds", {2, 3})])
def test_rows_within_the_delay_are_frozen_and_later_ones_never_change_it(spark, delay, kept):
    at = dt.datetime(2024, 1, 10)
    rows = [(d, v, at + d * DAY, at + d * DAY + dt.timedelta(hours=h)) for d in (1, 2, 3) for v, h in ((1, -5), (2, 0), (3, 1))]
    rows += [(9, 1, at + 400 * DAY, at + 400 * DAY), (10, 1, at + 900 * DAY, at + 900 * DAY)]
    d = spark.createDataFrame(rows, "day int, version int, cutoff timestamp, available_at timestamp")
    feed = fed(d, ["day = 2", "day = 3", "day = 1", "day = 9", "day = 10"], files=1)
    got = {r.day: r.version for r in drained(stream.frozen(feed, ["day"], "available_at", "cutoff", ["version"], delay)).filter(F.col("day") < 9).collect()}
    assert got == {k: 2 for k in kept}  # a version at the cutoff counts, one after it doesn't


def test_slots_keep_the_first_content_and_report_others_on_arrival(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, "a", 5, at, 1), (1, "b", 6, at, 1), (2, "a", 7, at, 1), (1, "a", 5, at + 300 * DAY, 2), (1, "b", 9, at + 300 * DAY, 2), (1, "b", 6, at + 301 * DAY, 3), (1, "c", 1, at - 900 * DAY, 3), (1, "b", 9, at, 3)]
    d = spark.createDataFrame(rows, "event int, slot string, value int, clock timestamp, step int")
    got = drained(machines.slots(fed(d, ["step = 1", "step = 2", "step = 3"], files=1), ["event"], ["slot"], "value", "clock")).collect()
    assert sorted((r.event, r.slot, r.value, r.outcome, r.step) for r in got) == [(1, "a", 5, "accepted", 1), (1, "b", 6, "accepted", 1), (1, "b", 9, "collision", 2), (1, "b", 9, "collision", 3), (1, "c", 1, "accepted", 3), (2, "a", 7, "accepted", 1)]


def hours(n):
    return dt.datetime(2024, 3, 1) + dt.timedelta(hours=n)


def test_captures_follow_clocks_whatever_the_order_of_arrival(spark):
    late = hours(30)
    rows = [
        (1, "first", "A", None, None, hours(23), 1), (1, "schedule", None, hours(12), hours(24), hours(0), 2), (1, "second", "B", None, None, hours(13), 3),  # provisional at 14, captured at 23
        (2, "second", "B", None, None, hours(20), 1), (2, "schedule", None, hours(12), hours(24), hours(0), 1), (2, "first", "A", None, None, hours(24), 1),  # the first source comes at the start: missed
        (3, "schedule", None, hours(12), hours(24), hours(0), 3), (3, "schedule", None, hours(12), hours(48), hours(13), 1), (3, "first", "A", None, None, hours(14), 2),  # under review
        (4, "first", "A", None, None, hours(-2), 1), (4, "schedule", None, hours(12), hours(24), hours(0), 2), (4, "schedule", None, hours(12), hours(24), hours(6), 3),  # source before schedule, same start again
        (9, "tick", None, None, None, hours(500), 4), (10, "tick", None, None, None, hours(900), 5),
    ]
    d = spark.createDataFrame([r for r in rows if r[5] is not None], "event int, kind string, value string, scheduled timestamp, start timestamp, seen timestamp, step int")
    got = drained(machines.captures(fed(d, [f"step = {k}" for k in range(1, 6)], files=1), ["event"], "seen", "100 hours"))
    by = {}
    for r in got.orderBy("at").collect():
        by.setdefault(r.event, []).append(((r["at"] - hours(0)).total_seconds() / 3600, r.status, r.value))
    wait, results = "waiting_for_qualifying", "waiting_for_qualifying_results"
    assert by[1] == [(0, wait, None), (12, results, None), (14, "provisional", "B"), (23, "captured", "A"), (24, "closed", "A")]
    assert by[2] == [(0, wait, None), (12, results, None), (20, "provisional", "B"), (24, "missed", "B")]
    assert by[3] == [(0, wait, None), (12, results, None), (13, "schedule_changed_review_required", None), (24, "missed", None)]
    assert by[4] == [(-2, "captured", "A"), (24, "closed", "A")] and late


def test_labels_meet_frozen_versions_in_either_order_and_are_retried(spark):
    frozen = [(1, 1, hours(0), hours(2), 1), (1, 2, hours(1), hours(2), 1), (2, 1, hours(0), hours(2), 4), (3, 1, hours(0), hours(2), 1), (3, 1, hours(0), hours(2), 4)]
    frozen += [(9, 1, hours(60), hours(99), 2), (9, 2, hours(70), hours(99), 3), (9, 3, hours(999), hours(99), 5)]
    labels = [(1, "x", hours(65), 3), (2, "y", hours(3), 1), (2, "y", hours(3), 2), (1, "x2", hours(66), 4)]
    f = fed(spark.createDataFrame(frozen, "event int, version int, seen timestamp, start timestamp, step int"), [f"step = {k}" for k in range(1, 6)], files=1)
    b = fed(spark.createDataFrame(labels, "event int, value string, at timestamp, step int"), [f"step = {k}" for k in range(1, 6)], files=1)
    got = drained(machines.late_labels(f, b, ["event"], "version", "start", "seen", "value", "at", "1000 hours")).collect()
    assert sorted((r.event, r.version, r.value, r.attempts) for r in got if r.what == "attached") == [(1, 1, "x", 3), (1, 1, "x2", 3), (1, 2, "x", 3), (1, 2, "x2", 3), (2, 1, "y", 0)]
    f = fed(spark.createDataFrame(frozen, "event int, version int, seen timestamp, start timestamp, step int").filter("step < 4 or event = 9"), [f"step = {k}" for k in (1, 2, 3, 5)], files=1)
    b = fed(spark.createDataFrame(labels[:1], "event int, value string, at timestamp, step int"), [f"step = {k}" for k in (1, 2, 3)], files=1)
    got = drained(machines.late_labels(f, b, ["event"], "version", "start", "seen", "value", "at", "0 hours")).collect()
    again = [((r["at"] - hours(2)).total_seconds() / 3600, r.attempts) for r in sorted(got, key=lambda r: r["at"]) if r.what == "retry" and r.event == 3]
    assert again[:4] == [(6, 1), (18, 2), (42, 3), (90, 4)]  # each wait is twice the one before
    assert sorted((r.version, r.value) for r in got if r.what == "attached") == [(1, "x"), (2, "x")]  # 63 hours after the start, behind the watermark


def test_events_stay_without_a_label_and_late_labels_are_told_from_those_on_time(spark):
    rows = [(1, 1, "frozen", "19", 0), (1, 2, "frozen", "20", 1), (1, 1, "attached", "x", 50), (1, 2, "attached", "x", 50), (1, None, "retry", None, 8)]  # 48 hours after the start
    rows += [(2, 1, "frozen", "18", 0), (2, 1, "attached", "z", 80), (2, 1, "attached", "y", 74)]  # 72 and 78 hours
    rows += [(3, 1, "frozen", "17", 0), (3, None, "retry", None, 8)]
    d = spark.createDataFrame([(e, hours(2), w, v, x, hours(h)) for e, v, w, x, h in rows], "event int, start timestamp, what string, version long, value string, at timestamp")
    got = machines.labelled(d, ["event"], "48 HOUR").orderBy("event").collect()
    assert list(map(tuple, got)) == [(1, "20", 1, 1, "x", hours(50)), (2, "18", 1, None, "y", hours(74)), (3, "17", None, None, None, None)]


def test_late_labels_has_all_events_whether_or_when_their_labels_come(spark, data, monkeypatch):
    clock = "CASE (league + day) % 4 WHEN 0 THEN NULL WHEN 1 THEN min(cutoff) + INTERVAL 48 HOUR WHEN 2 THEN min(cutoff) + INTERVAL 49 HOUR ELSE min(cutoff) + INTERVAL 900 HOUR END"
    monkeypatch.setitem(fixtures.SHAPES, "starts", fixtures.SHAPES["starts"].replace("max(label_available_at)", clock))
    starts = fixtures.Tables(spark, data)("starts").collect()
    assert {(s.league + s.day) % 4 for s in starts} == {0, 1, 2, 3}
    after = lambda s: {0: None, 1: 48, 2: 49, 3: 900}[(s.league + s.day) % 4]
    want = {(s.league, s.day): (s.entrants, after(s) and 1, 1 if after(s) == 48 else None, after(s) and s.entrants, after(s) and str(s.cutoff + dt.timedelta(hours=after(s)))) for s in starts}
    got = registry.QUERIES["S08_late_labels"](spark, data).collect()
    assert len(got) == len(want) and {(r.league, r.day): (r.entrants, r.labelled, r.on_time, r.label, r.label_at) for r in got} == want
