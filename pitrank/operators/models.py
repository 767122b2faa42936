"""Fits of all folds at once from sums, and ratings over time.

Loops here run over a fit's rounds or rating rounds, never over rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ridge_by_fold(rows: DataFrame, fold: str, features: list[str], label: str, weight: str | None = None, penalty: float = 1.0) -> dict:
    """F06 for many folds at once: intercept and weights of the ridge regression of known labels, by fold.

    Only sums of products leave the rows, one row a fold; each fold's equations are solved from them. ``weight`` is how
    often a row counts."""
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    w, k = F.lit(1.0) if weight is None else F.col(weight).cast("double"), len(x)
    sums = [F.sum(w * x[i] * x[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * x[i] * F.col(label)) for i in range(k)]
    got = rows.filter(F.col(label).isNotNull()).groupBy(fold).agg(F.array(*sums).alias("s")).collect()
    return {key: solved(s, k, penalty) for key, s in got}


def solved(s: list[float], k: int, penalty: float = 1.0) -> list[float]:
    """Intercept and weights from sums of products (upper triangle, then with the label)."""
    a = np.diag([1e-9, *[penalty] * (k - 1)])
    a[np.triu_indices(k)] += s[: k * (k + 1) // 2]
    return np.linalg.solve(np.triu(a) + np.triu(a, 1).T, s[k * (k + 1) // 2 :]).tolist()


def event_sums(rows: DataFrame, event: list[str], features: list[str], label: str) -> DataFrame:
    """per event the sums of products of its known rows: all that a ridge regression needs of it."""
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    sums = [F.sum(a * b) for i, a in enumerate(x) for b in x[i:]] + [F.sum(a * F.col(label)) for a in x]
    return rows.filter(F.col(label).isNotNull()).groupBy(*event).agg(F.array(*sums).alias("sums"))


def resampled_sums(often: DataFrame, sums: DataFrame, event: list[str], keys: list[str]) -> DataFrame:
    """the sums of each resample, an event counting as often as it was drawn; no row is repeated. Also rows drawn."""
    first = sums.first()
    size = len(first.sums) if first else 0
    d = often.join(sums, event)
    return d.groupBy(*keys).agg(F.array(*[F.sum(F.col("often") * F.col("sums")[i]) for i in range(size)]).alias("sums"))


def _masks(batch: pa.RecordBatch, names: list[str], number: dict) -> dict[str, np.ndarray]:
    """For each column of folds: 1 where the row (down) belongs to the fold (across)."""
    out = {}
    for name in names:
        column = batch[name]
        mask = np.zeros((batch.num_rows, len(number)))
        at = np.array([number.get(x, -1) for x in column.flatten().dictionary_encode().dictionary.to_pylist()] or [-1])
        if len(column.flatten()):
            fold = at[np.asarray(column.flatten().dictionary_encode().indices)]
            row = np.repeat(np.arange(batch.num_rows), np.asarray(column.value_lengths().fill_null(0)))
            mask[row[fold >= 0], fold[fold >= 0]] = 1.0
        out[name] = mask
    return out


def _logistic_sums(rows: DataFrame, labels: dict[str, str], keys: list, beta: np.ndarray) -> np.ndarray:
    """By label, quantity and fold: sums of known labels and of ones, loss, gradient and curvature (upper triangle)."""
    sent, k = rows.sparkSession.sparkContext.broadcast(beta), beta.shape[1]
    number, upper = {key: i for i, key in enumerate(keys)}, np.triu_indices(k)
    shape = (len(labels), 3 + k + len(upper[0]), len(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        step = max(1, (1 << 18) // max(1, len(keys)))
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                x = np.asarray(batch["x"].flatten()).reshape(-1, k)
                both, masks = x[:, upper[0]] * x[:, upper[1]], _masks(batch, sorted(set(labels.values())), number)
                for i, (y, own) in enumerate(labels.items()):
                    label = batch[y].to_numpy(zero_copy_only=False)
                    known = masks[own] * np.isfinite(label)[:, None]
                    label = np.nan_to_num(label)[:, None]
                    u = x @ sent.value[i]
                    z = np.exp(-np.abs(u))
                    p = np.where(u >= 0, 1.0, z) / (1 + z)
                    loss = known * (np.maximum(u, 0) - u * label + np.log1p(z))
                    total[i] += np.concatenate([known.sum(axis=0)[None], label.T @ known, loss.sum(axis=0)[None], x.T @ (known * (p - label)), both.T @ (known * p * (1 - p))])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["i", "v"])

    out = np.zeros(int(np.prod(shape)))
    for i, v in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    return out.reshape(shape)


def logistic_by_fold(rows: DataFrame, features: list[str], labels: dict[str, str], penalty: float = 1.0, rounds: int = 30) -> dict:
    """F05 for many folds at once: intercept and weights of L2 logistic regressions of known labels (0 or 1), by fold
    and label; a fold without both classes has none. ``labels`` names for each label the column with the folds (an array)
    that learn it from the row, so that rows are not repeated.

    Newton's method: each round is one pass over the rows, of which loss, gradient and curvature of each fold come back,
    added up within a task before they are sent. A step that raises the loss is halved."""
    k, own = len(features) + 1, sorted(set(labels.values()))
    d = rows.dropna(subset=features).select(F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features]).alias("x"), *[F.col(y).cast("double").alias(y) for y in labels], *own).persist()
    keys = sorted({r[0] for c in own for r in d.select(c).distinct().select(F.explode(c)).distinct().collect()})
    upper = np.triu_indices(k)
    beta, step = {(key, y): np.zeros(k) for key in keys for y in labels}, {}
    least, todo, fits = dict.fromkeys(beta, np.inf), set(beta), {}
    for n in range(rounds):
        now = [key for key in keys if any((key, y) in todo for y in labels)]
        if not now:
            break
        got = _logistic_sums(d, labels, now, np.array([[beta[key, y] for key in now] for y in labels]).transpose(0, 2, 1))
        for a in sorted(todo, key=str):
            known, ones, loss, *s = got[list(labels).index(a[1]), :, now.index(a[0])]
            if n == 0:
                if not 0 < ones < known:
                    todo.discard(a)
                    continue
                fits[a] = beta[a]
            penalties = penalty * np.array([0.0, *[1.0] * (k - 1)])
            loss += (penalties * beta[a] ** 2).sum() / 2
            if loss > least[a] + 1e-9 * abs(least[a]):
                step[a] = step[a] / 2
                fits[a] = beta[a] = beta[a] - step[a]
                continue
            h = np.zeros((k, k))
            h[upper] = s[k:]
            h = np.triu(h) + np.triu(h, 1).T + np.diag(penalties)
            step[a] = -np.linalg.solve(h, np.array(s[:k]) + penalties * beta[a])
            if np.abs(step[a]).max() < 1e-8:
                todo.discard(a)
            least[a] = loss
            fits[a] = beta[a] = beta[a] + step[a]
    d.unpersist()
    return {a: b.tolist() for a, b in fits.items()}


def with_fits(rows: DataFrame, fold: str, features: list[str], fits: dict[str, dict]) -> DataFrame:
    """The linear predictor of each named fit at every row, by the row's fold; null where the fold has no fit."""
    keys = sorted({k for f in fits.values() for k in f})
    kind = rows.schema[fold].dataType.simpleString()
    table = rows.sparkSession.createDataFrame([(k, *[f.get(k) for f in fits.values()]) for k in keys], f"{fold} {kind}, " + ", ".join(f"_b_{n} array<double>" for n in fits))
    d = rows.join(F.broadcast(table), fold, "left")
    return d.withColumns({n: sum((F.col(f"_b_{n}")[i + 1] * F.col(f) for i, f in enumerate(features)), F.col(f"_b_{n}")[0]) for n in fits}).drop(*[f"_b_{n}" for n in fits])


def out_of_fold(rows: DataFrame, train: DataFrame, fold: str, features: list[str], position: str, dnf: str, places: dict) -> DataFrame:
    """The models' outputs on test rows (with their fold), fitted on the rows in ``train``, whose ``folds`` learn
    from them, and ``dnf_folds`` from their retirement label; ``places`` are the ridge fits by fold."""
    known = train.withColumn("_won", F.coalesce(F.col(position) == 1, F.lit(False))).withColumn("_podium", F.coalesce(F.col(position) <= 3, F.lit(False))).withColumn("_out", F.col(dnf).cast("int"))
    both = logistic_by_fold(known, features, {"_won": "folds", "_podium": "folds", "_out": "dnf_folds"})
    fits = {"p_podium": {k: b for (k, y), b in both.items() if y == "_podium"}, "p_win": {k: b for (k, y), b in both.items() if y == "_won"}, "place_ridge": places, "p_dnf": {k: b for (k, y), b in both.items() if y == "_out"}}
    return with_fits(rows, fold, features, fits).withColumns({p: 1 / (1 + F.exp(-F.col(p))) for p in ("p_win", "p_podium", "p_dnf")})


def elo(rows: DataFrame, league: str, carry: float = 0.75, k: float = 24.0, scale: float = 400.0) -> DataFrame:
    """C11: ratings before each event, with regression to the base between seasons and a gate on label clocks.

    Ratings depend on their order, so one task takes a whole league; leagues run side by side."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        rating: dict[str, float] = {}
        season, out, waiting = None, [], []
        for day, event in own.sort_values(["day", "driver_id"]).groupby("day"):
            cutoff = event["cutoff"].iloc[0]
            if season is not None and event["season"].iloc[0] != season:
                rating = {d: 1500 + carry * (r - 1500) for d, r in rating.items()}
            season = event["season"].iloc[0]
            due = [w for w in waiting if w[0] < cutoff]
            waiting = [w for w in waiting if not w[0] < cutoff]
            for _, field in due:
                start = {d: rating.get(d, 1500.0) for d, _ in field}
                for d, place in field:
                    others = [(e, q) for e, q in field if e != d]
                    if others:
                        won = sum((place < q) - 1 / (1 + math.pow(10, (start[e] - start[d]) / scale)) for e, q in others)
                        rating[d] = start[d] + k * won / len(others)
            out += [(own["league"].iloc[0], day, d, round(rating.get(d, 1500.0), 6)) for d in event["driver_id"]]
            known = event[event["label_position"].notna()]
            waiting.append((event["label_available_at"].max(), list(zip(known["driver_id"], known["label_position"], strict=True))))
        return pd.DataFrame(out, columns=["league", "day", "driver_id", "rating"])

    return rows.groupBy(league).applyInPandas(run, "league long, day long, driver_id string, rating double")


def team_elo(rows: DataFrame, league: str, resets: tuple[int, ...] = (), carry: float = 0.75, team_carry: float = 0.5, reset_carry: float = 0.2, k: float = 24.0, scale: float = 400.0, mate_weight: float = 2.0) -> DataFrame:
    """C11: entrant and team ratings before each event, and the number of rated events.

    An entrant's strength is its rating plus its team's distance to the base. All pairs of an event's classified entrants
    are compared at once: team mates count ``mate_weight`` for entrants and nothing for teams. Between seasons ratings
    go back towards the base, teams further, and further still before a season in ``resets``. An event counts once all its
    labels are known before a cutoff. Ratings depend on their order, so one task takes a league."""

    def step(names: np.ndarray, teams: np.ndarray, place: np.ndarray, rating: dict[str, float], team: dict[str, float]) -> None:
        strength = np.array([rating.get(d, 1500.0) + team.get(c, 1500.0) - 1500.0 for d, c in zip(names, teams, strict=True)])
        surprise = (place[:, None] < place) - 1 / (1 + np.power(10.0, (strength - strength[:, None]) / scale))
        mates = teams[:, None] == teams
        weight = np.where(mates, mate_weight, 1.0)
        np.fill_diagonal(weight, 0.0)
        own = k * (weight * surprise).sum(axis=1) / weight.sum(axis=1)
        for d, c, x in zip(names, teams, own, strict=True):
            rating[d] = rating.get(d, 1500.0) + x
            team.setdefault(c, 1500.0)
        for c in np.unique(teams):
            of = teams == c
            others = (~of).sum() * of.sum()
            if others:
                team[c] += k * surprise[of][:, ~of].sum() / others

    def run(own: pd.DataFrame) -> pd.DataFrame:
        rating: dict[str, float] = {}
        team: dict[str, float] = {}
        rated: dict[str, int] = {}
        season, out, waiting = None, [], []
        for day, event in own.sort_values(["day", "driver_id"]).groupby("day"):
            cutoff, now = event["cutoff"].iloc[0], event["season"].iloc[0]
            due = [w for w in waiting if w[0] < cutoff]
            waiting = [w for w in waiting if not w[0] < cutoff]
            for _, of, names, teams, place in due:
                season = regress(rating, team, season, of)
                if len(names) > 1:
                    step(names, teams, place, rating, team)
                    for d in names:
                        rated[d] = rated.get(d, 0) + 1
            season = regress(rating, team, season, now)
            for d, c in zip(event["driver_id"], event["constructor_id"], strict=True):
                out.append((own["league"].iloc[0], day, d, c, round(rating.get(d, 1500.0), 6), round(team.get(c, 1500.0), 6), rated.get(d, 0)))
            known = event[event["label_position"].notna()]
            waiting.append((event["label_available_at"].max(), now, *(known[x].to_numpy() for x in ("driver_id", "constructor_id", "label_position"))))
        return pd.DataFrame(out, columns=["league", "day", "driver_id", "constructor_id", "rating", "team_rating", "rated"])

    def regress(rating: dict[str, float], team: dict[str, float], season, now):
        """The season reached, after regression where a later one begins; late labels of an older season don't go back."""
        if season is None or now <= season:
            return now if season is None else season
        for of, share in ((rating, carry), (team, reset_carry if now in resets else team_carry)):
            for name in of:
                of[name] = 1500.0 + share * (of[name] - 1500.0)
        return now

    return rows.groupBy(league).applyInPandas(run, "league long, day long, driver_id string, constructor_id string, rating double, team_rating double, rated long")
