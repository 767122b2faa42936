"""Team ratings and other operators of this library by hand and against plain loops."""

import datetime as dt
import math

from pyspark.sql import functions as F

from pitrank.operators import draws, models, quality

BASE = dt.datetime(2024, 1, 1)


def plain_ratings(events, resets):
    """events: (day, season, cutoff, label clock, [(driver, team, place or None)]), by day."""
    rating, team, season, waiting, out = {}, {}, None, [], {}

    def regress(now):
        nonlocal season
        if season is not None and now > season:
            for k in rating:
                rating[k] = 1500 + 0.75 * (rating[k] - 1500)
            for k in team:
                team[k] = 1500 + (0.2 if now in resets else 0.5) * (team[k] - 1500)
        season = now if season is None else max(season, now)

    for day, now, cutoff, label, rows in events:
        due, waiting = [w for w in waiting if w[0] < cutoff], [w for w in waiting if w[0] >= cutoff]
        for _, of, field in due:
            regress(of)
            if len(field) < 2:
                continue
            s = {d: rating.get(d, 1500) + team.get(c, 1500) - 1500 for d, c, _ in field}
            dd, dw, td, tw = dict.fromkeys(s, 0), dict.fromkeys(s, 0), {}, {}
            for d, c, p in field:
                for e, g, q in field:
                    if d == e:
                        continue
                    x = (p < q) - 1 / (1 + 10 ** ((s[e] - s[d]) / 400))
                    w = 2 if c == g else 1
                    dd[d] += w * x
                    dw[d] += w
                    if c != g:
                        td[c] = td.get(c, 0) + x
                        tw[c] = tw.get(c, 0) + 1
            for d, c, _ in field:
                rating[d] = rating.get(d, 1500) + 24 * dd[d] / dw[d]
                team.setdefault(c, 1500)
            for c, x in td.items():
                team[c] += 24 * x / tw[c]
        regress(now)
        out |= {(day, d): (rating.get(d, 1500), team.get(c, 1500)) for d, c, _ in rows}
        waiting.append((label, now, [r for r in rows if r[2] is not None]))
    return out


def test_team_ratings_are_those_of_a_loop(spark):
    events = []
    for day in range(1, 9):
        field = [("a", "x", (day * 3) % 5 + 1), ("b", "x", (day * 2) % 7 + 6), ("c", "y", None if day == 3 else 20 + day), ("d", "z", 30 - day), ("e", "z", 50)]
        at = BASE + dt.timedelta(days=day)
        events.append((day, 2024 if day < 4 else 2025 if day < 7 else 2026, at, at + dt.timedelta(hours=60 if day == 2 else 20), field if day != 5 else field[:1]))
    rows = [(1, day, season, d, c, None if p is None else float(p), cutoff, label) for day, season, cutoff, label, field in events for d, c, p in field]
    df = spark.createDataFrame(rows, "league long, day long, season long, driver_id string, constructor_id string, label_position double, cutoff timestamp, label_available_at timestamp")
    got = {(r.day, r.driver_id): (r.rating, r.team_rating) for r in models.team_elo(df.repartition(3), "league", resets=(2025,)).collect()}
    want = plain_ratings(events, {2025})
    assert set(got) == set(want)
    for k, (a, b) in want.items():
        assert math.isclose(got[k][0], a, abs_tol=1e-5) and math.isclose(got[k][1], b, abs_tol=1e-5), k
    assert got[1, "a"] == (1500.0, 1500.0) and got[8, "a"] != got[2, "a"]
    assert models.team_elo(df.limit(0), "league").count() == 0


def test_tied_totals_share_their_places(spark):
    d = spark.createDataFrame([(1, "a", 0, 10.0, 1, 2), (1, "b", 0, 10.0, 1, 2), (1, "c", 0, 3.0, 3, 1), (1, "a", 1, 9.0, 1, 1), (1, "b", 1, 5.0, 2, 1), (1, "c", 1, 4.0, 3, 1)], "l int, d string, scenario int, total double, place int, same long")
    got = {(r.d, r.position): r.p for r in draws.final_places(d, "l", "d", 2).collect()}
    assert got == {("a", 1): 0.75, ("a", 2): 0.25, ("b", 1): 0.25, ("b", 2): 0.75, ("c", 3): 1.0}
    assert draws.unresolved(d, "l", 2).first().unresolved == 0.5


def test_row_problems_at_their_boundaries(spark):
    rows = [(1, 1, 1.0), (1, 2, 2.0), (2, 0, 1.0), (2, 1, 1.0), (3, 1, float("inf")), (3, 3, 0.0), (4, 1, None), (4, None, None), (5, 1, 0.0), (5, 1, 0.0)]
    d = spark.createDataFrame(rows, "e int, place int, x double")
    flag = F.coalesce(F.col("place") <= 3, F.lit(False))
    got = {r.e: (r.winners, r.positions, r.podium, r.infinite) for r in quality.row_problems(d, ["e"], "place", F.col("place") == 1, flag, ["x"]).collect()}
    assert got == {1: (False, False, False, False), 2: (False, True, False, False), 3: (False, True, False, True), 4: (False, False, False, False), 5: (True, True, False, False)}


def test_distributions_must_sum_to_one_both_ways(spark):
    good = [(1, d, p, 1 / 3) for d in "abc" for p in (1, 2, 3)]
    bad = [(2, "a", 1, 1.0), (2, "b", 1, 1.0)]
    places = spark.createDataFrame(good + bad, "e int, d string, place int, p double")
    marginals = spark.createDataFrame([(1, d, 1 / 3, 1.0) for d in "abc"] + [(2, d, 1.0, 1.0) for d in "ab"], "e int, d string, win double, podium double")
    assert {r.e: r.coherent for r in quality.coherent(places, marginals, ["e"], "d").collect()} == {1: True, 2: False}
    off = marginals.withColumn("win", F.when(F.col("d") == "a", 0.5).otherwise(F.col("win")))
    assert not quality.coherent(places, off, ["e"], "d").filter("e = 1").first().coherent


def test_partitions_are_rewritten_when_rows_or_the_version_change(spark, tmp_path):
    from pitrank.sources import store

    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, x string")
    write = lambda rows, version: sorted(r.k for r in store.write_changed(rows, str(tmp_path), ["k"], version).collect())
    assert write(d, 1) == [1, 2] and write(d, 1) == [] and write(d, 2) == [1, 2]
    assert write(d.filter("k = 2").withColumn("x", F.lit("d")), 2) == [2]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/rows").select("k", "x").collect())) == [(1, "a"), (1, "b"), (2, "d")]


def test_folders_of_several_keys_rewrite_what_changed_and_keep_the_rest(spark, tmp_path):
    from pitrank.sources import store

    frame = lambda rows: spark.createDataFrame(rows, "season long, league long, n long")
    write = lambda rows, version: sorted((r.season, r.league) for r in store.write_changed(frame(rows), str(tmp_path), ["season", "league"], version, ["season"]).collect())
    kept = lambda: sorted((r.season, r.league, r.n) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    first = [(1, 1, 5), (1, 2, 6), (1, 3, 1), (2, 1, 7)]
    assert write(first, 1) == [r[:2] for r in first] and len(list(tmp_path.glob("rows/season=*"))) == 2 and not list(tmp_path.glob("rows/*/league=*"))
    assert write(first, 1) == [] and kept() == first
    assert write([(1, 1, 5), (1, 2, 9), (2, 1, 7)], 1) == [(1, 2)] and kept() == [(1, 1, 5), (1, 2, 9), (1, 3, 1), (2, 1, 7)]
    assert write([(1, 1, 5), (1, 2, 9), (1, 3, 1), (2, 1, 7)], 1) == [] and write([(2, 1, 7)], 2) == [(2, 1)] and len(kept()) == 4
