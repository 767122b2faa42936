"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitrank.llm.blocks import cut


HUBS, SALTS = 200, 64  #: most nodes treated as hubs, and the parts their edges are dealt into


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges(u, v) with m, the least of their u. A node with more than 1 / HUBS of all edges, of which there are fewer
    than HUBS, has its edges dealt into SALTS parts and its least sent to each, so that none fills a task."""
    hubs = [r.u for r in least.filter(F.col("n") * HUBS > total).select("u").collect()]
    if not hubs:
        return edges.join(least.select("u", "m"), "u")
    hot = F.col("u").isin(hubs)
    dealt = edges.withColumn("s", F.when(hot, F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0))
    sent = least.withColumn("s", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(sent.select("u", "s", "m"), ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large and small stars: every round groups by node and joins back, nothing but the names of at most HUBS
    hubs is collected, and the number of rounds grows with the logarithm of a component's diameter. Self loops and
    repeated edges don't matter."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = cut(_with_least(both, least, 2 * now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        e = cut(small.union(least.select("u", "m")).distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
