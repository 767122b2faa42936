"""Draw queries over all days against plain Python."""

import hashlib
import math
from collections import defaultdict

from pitrank.operators import draws
from pitrank.plans import registry
from pitrank.plans.fixtures import Tables


def uniform(*parts):
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def test_draws_cover_all_days_and_all_draws(spark, data):
    field = defaultdict(list)
    for r in Tables(spark, data)("predictions").filter("model = 'form'").collect():
        field[r.league * 100 + r.day].append((r.driver_id, math.log(r.raw), 0.05 + 0.01 * (r.qualifying_position % 10)))
    places, retired = {}, {}
    for ev, own in field.items():
        for draw in range(32):
            out = {d: uniform(5, ev, draw, d, "dnf") < p for d, _, p in own}
            key = {d: u + round(-math.log(-math.log(uniform(5, ev, draw, d, "order"))), 9) for d, u, _ in own}
            for place, d in enumerate(sorted(key, key=lambda d: (out[d], -key[d], d)), 1):
                places[ev, d, draw], retired[ev, d, draw] = place, out[d]
    got = {(r.ev, r.driver_id, r.draw): (r.place, r.retired) for r in registry.QUERIES["G01_rankings_all_days"](spark, data).collect()}
    assert len({ev % 100 for ev, _, _ in got}) == 30 and got == {k: (p, retired[k]) for k, p in places.items()}
    share = defaultdict(float)
    for (ev, d, _), p in places.items():
        share[ev, d] += (p == 1) / 32
    win = {(r.ev, r.driver_id): r.win for r in registry.QUERIES["G02_marginals_all_days"](spark, data).collect()}
    assert set(win) == set(share) and all(abs(win[k] - x) < 1e-5 for k, x in share.items())


def test_standings_take_each_leagues_own_cutoff(spark, data):
    t = Tables(spark, data)
    got = registry.QUERIES["G09_standings_at_cutoff"](spark, data).collect()
    starts = [s for s in t("starts").collect() if s.season == 2025]
    at = {k: min(s.cutoff for s in starts if s.league == k and s.round >= 8) for k in {s.league for s in starts}}
    now = defaultdict(float)
    best = {}
    for p in t("points").collect():
        cut = at[p.league]
        if p.season == 2025 and p.effective_at <= cut and any(s.league == p.league and s.day == p.day and s.cutoff < cut for s in starts):
            key = (p.league, p.day, p.driver_id)
            best[key] = max(best.get(key, (0, 0.0)), (p.version, p.points))
    for (league, _, d), (_, x) in best.items():
        now[league, d] += x
    assert got and all(r.mean_points >= now[r.league, r.driver_id] for r in got)
    assert abs(sum(r.sole_title for r in got) - len(at)) <= len(at)
    left = {s.day for s in starts if s.cutoff >= at[s.league]}
    drivers = {(r.league, r.driver_id) for r in t("utilities").collect() if r.day in left}
    assert drivers == {(r.league, r.driver_id) for r in got}


def test_grid_fit_ranks_every_cell_from_the_same_draws(spark, data):
    t = Tables(spark, data)
    u, rows = defaultdict(list), {}
    for r in t("utilities").collect():
        u[r.league * 100 + r.day].append((r.driver_id, r.utility, r.p_dnf))
    for r in t("results").collect():
        rows[r.league * 100 + r.day, r.driver_id] = r.label_position
    noise = lambda ev, draw, x, salt: round(-math.log(-math.log(uniform(20, ev, draw, x, salt))), 9)
    days = defaultdict(list)
    for ev in sorted(u):
        days[ev // 100].append(ev)
    scored = [ev for own in days.values() for ev in own[5:]]
    assert len(scored) > 10
    got = {(r["first"], r.rest, r.shrink): r for r in registry.QUERIES["H20_grid_fit"](spark, data).collect()}
    assert len(got) == 8 * 7 * 3 and sum(r.chosen for r in got.values()) == 1
    for first, rest, shrink in ((0.4, 1.5, 0.0), (1.0, 0.9, 0.05)):
        losses = []
        for ev in scored:
            wins, podiums, n = defaultdict(int), defaultdict(int), len(u[ev])
            for draw in range(32):
                out = {x: uniform(20, ev, draw, x, "dnf") < p for x, _, p in u[ev]}
                best = min(u[ev], key=lambda e: (out[e[0]], -(e[1] / first + noise(ev, draw, e[0], "win")), e[0]))[0]
                others = sorted((e for e in u[ev] if e[0] != best), key=lambda e: (out[e[0]], -(e[1] / rest + noise(ev, draw, e[0], "rest")), e[0]))
                wins[best] += 1
                for x in [best, *[e[0] for e in others[:2]]]:
                    podiums[x] += 1
            won, lost = None, []
            for x, _, _ in u[ev]:
                place = rows[ev, x]
                p = min(max((1 - shrink) * podiums[x] / 32 + shrink * min(1, 3 / n), 1e-15), 1 - 1e-15)
                lost.append(-math.log(p if place is not None and place <= 3 else 1 - p))
                if place == 1:
                    won = -math.log(min(max((1 - shrink) * wins[x] / 32 + shrink / n, 1e-15), 1 - 1e-15))
            if won is not None:
                losses.append(won + sum(lost) / n / 3)
        assert abs(got[first, rest, shrink].loss - sum(losses) / len(losses)) < 2e-6


def test_number_conflicts_are_found_in_every_event(spark, data):
    of = defaultdict(set)
    for r in Tables(spark, data)("results").collect():
        of[r.league, r.day, r.n % 20].add(r.driver_id)
    got = {(r.league, r.day, r.number): (r.driver_id, r.conflict) for r in registry.QUERIES["A14_number_crosswalk_by_event"](spark, data).collect()}
    assert got == {k: (None, True) if len(x) > 1 else (min(x), False) for k, x in of.items()}


def test_only_entrants_are_shuffled_never_their_draws(spark):
    d = spark.createDataFrame([(ev, f"e{i}", -0.3 * i, 0.1, i == 2) for ev in (1, 2) for i in range(5)], "ev long, ident string, u double, p double, won boolean")
    made = {
        "rankings": draws.rankings(d, "ev", "ident", "u", 8, 3, p_dnf="p").groupBy("ev", "draw").count(),
        "two stages": draws.two_stage(d, "ev", "ident", "u", 8, 3, 0.8, 1.2).groupBy("ev", "ident").count(),
        "losses": draws.temperature_losses(d, "ev", "ident", "u", "won", 8, 3, (0.5, 1.0), "p"),
        "cells": draws.two_stage_cells(d, "ev", "ident", "u", 8, 3, (0.5, 1.0), (0.5, 1.0), "p", ("won",)),
    }
    for name, x in made.items():
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and plan.index("Exchange ") > plan.rindex("Generate"), name  # plans are printed from the top
        assert x.count()
    sums = made["cells"].groupBy("ev", "first", "rest").sum("win", "podium").collect()
    assert len(sums) == 8 and all(r["sum(win)"] == 1 and r["sum(podium)"] == 3 for r in sums)
    assert made["cells"].count() == 8 * 5  # those who never win are listed too
