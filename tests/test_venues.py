"""Venue similarity over all parts against numpy."""

import numpy as np

from pitrank.plans import registry
from pitrank.plans.fixtures import Tables


def test_venue_profiles_take_all_parts_and_neighbours_exist(spark, data):
    t = Tables(spark, data)
    parts = t("part").collect()
    own = [[r for r in parts if r.p_partkey % 7 == i] for i in range(7)]
    x = np.array([[np.mean([r.p_size for r in p]), np.mean([r.p_retailprice for r in p])] for p in own])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    weight = np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2) / 2)
    want = {}
    for i in range(7):
        best = sorted((j for j in range(7) if j != i), key=lambda j: (-round(weight[i, j], 9), j))[:5]
        want |= {(f"c{i}", f"c{j}"): (k, round(weight[i, j], 6)) for k, j in enumerate(best, 1)}
    rows = registry.QUERIES["C12_venue_similarity_all_parts"](spark, data).collect()
    got = {(r.circuit_id, r.other): (r.k, r.weight) for r in rows}
    assert set(got) == set(want) and all(got[a][0] == k and abs(got[a][1] - w) < 2e-6 for a, (k, w) in want.items())
    assert {r.other for r in rows} <= {r.circuit_id for r in t("starts").select("circuit_id").distinct().collect()}
    assert registry.QUERIES["C13_similar_venue_delta_all_parts"](spark, data).filter("delta is not null").count() > 0
