"""Random rankings as data: hashed draws, their marginals, mixtures and standings.

A draw's numbers are hashes of (seed, event, draw, entrant, salt): they don't depend on partitions or engines. Events are
dealt to tasks with their entrants before they are drawn, so draws are made, ranked and counted without being shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitrank.operators.evaluate import hashed


def uniform(seed: int, salt: str, *parts: str | Column) -> Column:
    return (hashed(F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts], F.lit(salt)) + 0.5) / 4294967296.0


def gumbel(seed: int, salt: str, *parts: str | Column) -> Column:
    return F.round(-F.log(-F.log(uniform(seed, salt, *parts))), 9)


def exploded(rows: DataFrame, draws: int) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))


DRAWN = 1 << 20  #: about so many drawn rows are sorted in one task


def dealt(rows: DataFrame, keys: list[str], draws: int, deal: int = 4) -> DataFrame:
    """The rows, by event (``keys``). This is the only exchange of a draw query: it moves entrants before they are drawn,
    and all that follows by event and draw stays in its task. So there are ``deal`` tasks for each shuffle partition, and
    more where a task would have more than ``DRAWN`` drawn rows; rows are counted for that."""
    tasks = deal * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(tasks, -(-rows.count() * draws // DRAWN)), *keys)


def rankings(rows: DataFrame, event: str, ident: str, utility: str, draws: int, seed: int, temperature: float = 1.0, p_dnf: str | None = None, shrink: float = 0.0) -> DataFrame:
    """In each draw entrants by utility / temperature + Gumbel noise; retired ones go last in their own order; with
    probability ``shrink`` a draw ignores the utilities."""
    d = exploded(dealt(rows, [event], draws), draws)
    flat = uniform(seed, "flat", event, "draw") < shrink
    key = F.when(flat, 0.0).otherwise(F.col(utility) / temperature) + gumbel(seed, "order", event, "draw", ident)
    out = F.lit(False) if p_dnf is None else uniform(seed, "dnf", event, "draw", ident) < F.col(p_dnf)
    d = d.withColumn("retired", out).withColumn("key", key)
    w = Window.partitionBy(event, "draw").orderBy("retired", F.desc("key"), ident)
    return d.select(event, ident, "draw", "retired", F.row_number().over(w).cast("long").alias("place"))


def two_stage(rows: DataFrame, event: str, ident: str, utility: str, draws: int, seed: int, first: float, rest: float) -> DataFrame:
    """The winner by its own temperature, all others by another."""
    d = exploded(dealt(rows, [event], draws), draws).withColumn("a", F.col(utility) / first + gumbel(seed, "win", event, "draw", ident)).withColumn("b", F.col(utility) / rest + gumbel(seed, "rest", event, "draw", ident))
    best = F.row_number().over(Window.partitionBy(event, "draw").orderBy(F.desc("a"), ident)) == 1
    d = d.withColumn("wins", best)
    return d.select(event, ident, "draw", F.row_number().over(Window.partitionBy(event, "draw").orderBy(F.desc("wins"), F.desc("b"), ident)).cast("long").alias("place"))


def noisy(rows: DataFrame, event: str, ident: str, draws: int, seed: int, salts: list[str], p_dnf: str | None) -> DataFrame:
    """Draws made once, for any number of temperatures: the noise of each salt, and who retires."""
    d = exploded(rows, draws).withColumns({f"_{s}": gumbel(seed, s, event, "draw", ident) for s in salts})
    return d.withColumn("_out", F.lit(False) if p_dnf is None else uniform(seed, "dnf", event, "draw", ident) < F.col(p_dnf))


def winners_by_temperature(rows: DataFrame, keys: list[str], event: str, ident: str, utility: str, draws: int, seed: int, temperatures: tuple[float, ...], p_dnf: str | None = None) -> DataFrame:
    """per draw the winner at every temperature (columns t0, t1, ...), from the same random numbers."""
    d = noisy(rows, event, ident, draws, seed, ["order"], p_dnf)
    first = [F.min_by(ident, F.struct("_out", -(F.col(utility) / t + F.col("_order")), ident)).alias(f"t{i}") for i, t in enumerate(temperatures)]
    return d.groupBy(*keys, "draw").agg(*first)


def temperature_losses(rows: DataFrame, event: str, ident: str, utility: str, won: str, draws: int, seed: int, temperatures: tuple[float, ...], p_dnf: str | None = None, by: list[str] | None = None) -> DataFrame:
    """temperature and loss (-ln of the winner's share of wins, at least 1e-15) of every event with one winner.

    ``by`` keeps apart rows of one event that are predicted several times, with the same noise."""
    keys = [*(by or []), event]
    w = Window.partitionBy(*keys)
    known = dealt(rows, keys, draws).withColumn("_truth", F.max(F.when(F.col(won), F.col(ident))).over(w)).withColumn("_n", F.count_if(F.col(won)).over(w)).filter("_n = 1")
    d = winners_by_temperature(known, [*keys, "_truth"], event, ident, utility, draws, seed, temperatures, p_dnf)
    share = [F.struct(F.lit(float(t)).alias("temperature"), F.avg((F.col(f"t{i}") == F.col("_truth")).cast("int")).alias("p")) for i, t in enumerate(temperatures)]
    d = d.groupBy(*keys).agg(F.array(*share).alias("s")).select(*keys, F.explode("s").alias("s"))
    return d.select(*keys, "s.temperature", (-F.log(F.greatest("s.p", F.lit(1e-15)))).alias("loss"))


def two_stage_cells(rows: DataFrame, event: str, ident: str, utility: str, draws: int, seed: int, firsts: tuple[float, ...], rests: tuple[float, ...], p_dnf: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Shares of wins and podiums of every (first, rest) pair of temperatures, from draws that are made once, with
    the field's size ``n`` and the carried columns.

    A draw keeps its winner at each first temperature and its first three at each other one; the podium of a pair is the
    winner and the first two of the rest. Retired entrants come last. The first draw lists the whole field as well, so
    that entrants who never come that far count 0. (``outer``: for other explosions Spark infers a filter on the array's
    size, and makes the array once more for it.)"""
    d = noisy(dealt(rows, [event], draws), event, ident, draws, seed, ["win", "rest"], p_dnf).withColumn("_e", F.struct(F.col(ident).alias("i"), *carry))
    won = [F.struct(F.lit(float(t)).alias("first"), F.min_by("_e", F.struct("_out", -(F.col(utility) / t + F.col("_win")), ident)).alias("w")) for t in firsts]
    top = [F.struct(F.lit(float(t)).alias("rest"), F.slice(F.sort_array(F.collect_list(F.struct(F.col("_out").alias("o"), (-(F.col(utility) / t + F.col("_rest"))).alias("k"), F.col(ident).alias("i"), F.col("_e").alias("e")))), 1, 3)["e"].alias("t")) for t in rests]
    g = d.groupBy(event, "draw").agg(F.array(*won).alias("won"), F.array(*top).alias("top"), F.collect_list(F.when(F.col("draw") == 0, F.col("_e"))).alias("all"), F.count("*").alias("n"))
    g = g.select(event, "n", "all", "top", F.explode_outer("won").alias("a")).select(event, "n", "all", "a.*", F.explode_outer("top").alias("b")).select(event, "n", "all", "first", "w", "b.*")
    podium = F.concat(F.array("w"), F.slice(F.filter("t", lambda x: x["i"] != F.col("w.i")), 1, 2))
    g = g.select(event, "n", "first", "rest", F.col("w.i").alias("_w"), "all", podium.alias("_p")).select(event, "n", "first", "rest", "_w", F.size("_p").alias("_k"), F.posexplode_outer(F.concat("_p", "all")).alias("_at", "_e"))
    here = F.col("_at") < F.col("_k")
    g = g.select(event, "n", "first", "rest", "_e.*", (here & (F.col("_e.i") == F.col("_w"))).cast("int").alias("_win"), here.cast("int").alias("_in"))
    g = g.groupBy(event, "n", "first", "rest", "i", *carry).agg((F.sum("_win") / draws).alias("win"), (F.sum("_in") / draws).alias("podium"))
    return g.withColumnRenamed("i", ident)


def marginals(ranked: DataFrame, event: str, ident: str, podium: int = 3) -> DataFrame:
    """Shares of wins, podiums and retirements, and the mean place."""
    return ranked.groupBy(event, ident).agg(
        F.round(F.avg((F.col("place") == 1).cast("int")), 6).alias("win"),
        F.round(F.avg((F.col("place") <= podium).cast("int")), 6).alias("podium"),
        F.round(F.avg("place"), 6).alias("mean_place"),
        F.round(F.avg(F.col("retired").cast("int")), 6).alias("retirement"),
    )


def distribution(ranked: DataFrame, event: str, ident: str) -> DataFrame:
    """Share of each place."""
    return shares(ranked.groupBy(event, ident, "place").agg(F.count("*").alias("c")), event, ident)


def shares(counts: DataFrame, event: str, ident: str) -> DataFrame:
    """Share of each place, from the numbers ``c`` of draws that give it."""
    return counts.select(event, ident, "place", F.round(F.col("c") / F.sum("c").over(Window.partitionBy(event, ident)), 9).alias("p"))


def interval(places: DataFrame, event: str, ident: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """The most likely place (the first of equals) and the central interval from the cumulative shares."""
    c = places.withColumn("cum", F.round(F.sum("p").over(Window.partitionBy(event, ident).orderBy("place")), 9))
    return c.groupBy(event, ident).agg(F.min_by("place", F.struct(-F.col("p"), "place")).alias("likely"), F.min(F.when(F.col("cum") >= low, F.col("place"))).alias("low"), F.min(F.when(F.col("cum") >= high, F.col("place"))).alias("high"))


def at_most(rows: DataFrame, keys: list[str], p: str, places: int) -> DataFrame:
    """probabilities scaled to sum to ``places`` with none above 1: the m largest are 1 for the smallest m at which
    the rest, scaled, stays within 1."""
    w = Window.partitionBy(*keys).orderBy(F.desc(p), "ident")
    d = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("tail", F.sum(p).over(w.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("scale", (places - F.col("i")) / F.col("tail"))
    fits = F.when(F.col(p) * F.col("scale") <= 1, F.struct("i", "scale"))
    d = d.withColumn("cut", F.min(fits).over(Window.partitionBy(*keys)))
    return d.select(*keys, "ident", F.round(F.when(F.col("i") < F.col("cut.i"), 1.0).otherwise(F.col(p) * F.col("cut.scale")), 6).alias("capped"))


def finals(ranked: DataFrame, totals: DataFrame, points: DataFrame, league: str, event: str, ident: str, scenarios: int, seed: int, draws: int) -> DataFrame:
    """Each scenario takes one whole draw of every remaining event, adds the event's points by place to the totals, and ranks:
    total, place and the number of those with the same total."""
    events = ranked.select(league, event).distinct()
    pick = events.select("*", F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))).alias("scenario")).withColumn("draw", F.pmod(hashed(F.lit(str(seed)), F.col(event).cast("string"), F.col("scenario").cast("string"), F.lit("pick")), F.lit(draws)).cast("int"))
    got = pick.join(ranked, [league, event, "draw"]).join(points, [event, "place"], "left").groupBy(league, "scenario", ident).agg(F.sum(F.coalesce("points", F.lit(0.0))).alias("won"))
    d = got.join(totals, [league, ident]).withColumn("total", F.col("won") + F.col("points_now"))
    w = Window.partitionBy(league, "scenario")
    same = F.count("*").over(Window.partitionBy(league, "scenario", "total"))
    return d.withColumn("place", F.rank().over(w.orderBy(F.desc("total")))).withColumn("same", same)


def final_places(finals: DataFrame, league: str, ident: str, scenarios: int) -> DataFrame:
    """Share of each final position; tied entrants share their positions evenly."""
    d = finals.select(league, ident, F.explode(F.expr("sequence(cast(place as long), place + same - 1)")).alias("position"), (1.0 / F.col("same")).alias("share"))
    return d.groupBy(league, ident, "position").agg(F.round(F.sum("share") / scenarios, 6).alias("p"))


def unresolved(finals: DataFrame, league: str, scenarios: int) -> DataFrame:
    """Share of scenarios that end with a tie for the title."""
    return finals.groupBy(league).agg(F.round(F.countDistinct(F.when((F.col("place") == 1) & (F.col("same") > 1), F.col("scenario"))) / scenarios, 6).alias("unresolved"))


def standings(ranked: DataFrame, totals: DataFrame, points: DataFrame, league: str, event: str, ident: str, scenarios: int, seed: int, draws: int) -> DataFrame:
    """Shares of sole and tied titles, mean points, and the mean place with ties split evenly."""
    d = finals(ranked, totals, points, league, event, ident, scenarios, seed, draws)
    first = F.col("place") == 1
    return d.groupBy(league, ident).agg(
        F.round(F.avg((first & (F.col("same") == 1)).cast("int")), 6).alias("sole_title"),
        F.round(F.avg((first & (F.col("same") > 1)).cast("int")), 6).alias("tied_title"),
        F.round(F.avg("total"), 6).alias("mean_points"),
        F.round(F.avg(F.col("place") + (F.col("same") - 1) / 2), 6).alias("mean_place"),
    )
