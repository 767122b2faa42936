"""Maps the given tables to the generic shapes: events, publications, laps, points, predictions.

Each shape is one SELECT in the SQL that Spark and DuckDB share; braces name what it reads, TSLIT a zone-less
timestamp literal. ``Tables`` builds the DataFrames, ``with_shapes`` the same as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SHAPES = {
    "results": """
SELECT league, day, season, round, event_id, user_id, driver_id, constructor_id, circuit_id, score, n, retired,
  CASE WHEN (user_id + day) % 11 = 0 THEN NULL ELSE retired END AS label_dnf,
  CASE WHEN retired THEN NULL ELSE CAST(row_number() OVER (PARTITION BY league, day, retired ORDER BY score DESC, user_id) AS BIGINT) END AS label_position,
  CAST(rank() OVER (PARTITION BY league, day ORDER BY n DESC, user_id) AS BIGINT) AS qualifying_position,
  cutoff, label_available_at,
  CASE WHEN user_id % 5 = 0 THEN label_available_at + INTERVAL 12 HOUR ELSE label_available_at END AS label_dnf_available_at
FROM (SELECT u.*, 2 * err > n AS retired, CAST(floor(user_id / 20.0) AS BIGINT) AS league,
    CAST(2024 + floor((day - 1) / 15.0) AS BIGINT) AS season, CAST((day - 1) % 15 + 1 AS BIGINT) AS round,
    concat('league=', CAST(CAST(floor(user_id / 20.0) AS BIGINT) AS VARCHAR(9)), '/season=', CAST(CAST(2024 + floor((day - 1) / 15.0) AS BIGINT) AS VARCHAR(9)), '/round=', lpad(CAST((day - 1) % 15 + 1 AS VARCHAR(9)), 2, '0')) AS event_id,
    concat('d', CAST(user_id AS VARCHAR(9))) AS driver_id,
    concat('t', CAST(CAST(floor(user_id / 20.0) AS BIGINT) AS VARCHAR(9)), '_', CAST(CAST(floor((user_id % 20) / 2.0) AS BIGINT) AS VARCHAR(9))) AS constructor_id,
    concat('c', CAST(day % 7 AS VARCHAR(9))) AS circuit_id,
    date_trunc_day + INTERVAL 6 HOUR AS cutoff,
    CASE WHEN (CAST(floor(user_id / 20.0) AS BIGINT) + day) % 9 = 0 THEN date_trunc_day + INTERVAL 78 HOUR ELSE date_trunc_day + INTERVAL 24 HOUR END AS label_available_at
  FROM (SELECT user_id, CAST(day(ts) AS BIGINT) AS day, date_trunc('day', min(ts)) AS date_trunc_day, round(sum(value), 2) AS score, count(*) AS n,
      count(*) FILTER (WHERE event_type = 'error') AS err FROM {events} GROUP BY user_id, day(ts)) u) x""",
    "starts": "SELECT league, day, season, round, event_id, min(circuit_id) AS circuit_id, min(cutoff) AS cutoff, max(label_available_at) AS label_available_at, count(*) AS entrants FROM {results} GROUP BY league, day, season, round, event_id",
    "publications": """
SELECT r.league, r.day, r.event_id, r.driver_id, r.constructor_id, r.cutoff, v.version,
  CASE v.version WHEN 1 THEN r.cutoff - INTERVAL 8 HOUR WHEN 2 THEN r.cutoff - INTERVAL 2 HOUR ELSE r.cutoff + INTERVAL 1 HOUR END AS available_at,
  CASE v.version WHEN 1 THEN r.cutoff - INTERVAL 7 HOUR WHEN 2 THEN r.cutoff - INTERVAL 1 HOUR ELSE r.cutoff + INTERVAL 2 HOUR END AS captured_at,
  (r.qualifying_position + v.version - 2) % s.entrants + 1 AS position, (r.league + r.day) % 12 = 0 AND v.version = 2 AS recalled
FROM {results} r JOIN {starts} s ON r.league = s.league AND r.day = s.day
JOIN (SELECT CAST(1 AS BIGINT) AS version UNION ALL SELECT 2 UNION ALL SELECT 3) v
  ON v.version = 1 OR (v.version = 2 AND (r.league + r.day) % 4 = 0) OR (v.version = 3 AND (r.league + r.day) % 6 = 0)""",
    "signals": """
SELECT league, day, 'schedule' AS kind, CAST(NULL AS VARCHAR(9)) AS value, cutoff - INTERVAL 9 HOUR AS scheduled, cutoff AS start, cutoff - INTERVAL 48 HOUR AS seen_at FROM {starts}
UNION ALL SELECT league, day, 'schedule', NULL, cutoff + INTERVAL 15 HOUR, cutoff + INTERVAL 24 HOUR, cutoff - INTERVAL 21 HOUR + INTERVAL '1' HOUR * ((league + 3 * day) % 24) FROM {starts} WHERE (league + day) % 10 = 0
UNION ALL SELECT league, day, 'first', concat('a', CAST(entrants AS VARCHAR(9))), cutoff, cutoff, cutoff - INTERVAL 9 HOUR + INTERVAL '1' HOUR * ((league * 7 + day) % 11) FROM {starts} WHERE (league + 2 * day) % 3 <> 1
UNION ALL SELECT league, day, 'second', concat('b', CAST(entrants AS VARCHAR(9))), cutoff, cutoff, cutoff - INTERVAL 9 HOUR + INTERVAL '1' HOUR * ((league + 5 * day) % 7) FROM {starts} WHERE (league + day) % 2 = 0""",
    "sessions": """
SELECT league, day, event_id, driver_id, constructor_id, cutoff, provider, best,
  CASE provider WHEN 'a' THEN cutoff - INTERVAL 3 HOUR ELSE cutoff - INTERVAL 2 HOUR END AS available_at, CASE provider WHEN 'a' THEN 1 ELSE 2 END AS tier
FROM (SELECT r.league, r.day, r.event_id, r.driver_id, r.constructor_id, r.cutoff, p.provider,
    CASE WHEN p.provider = 'b' AND r.user_id % 13 = 0 THEN (80 + e.low / 100) * 1.03 ELSE 80 + e.low / 100 END AS best
  FROM {results} r JOIN (SELECT user_id, CAST(day(ts) AS BIGINT) AS day, min(value) AS low FROM {events} GROUP BY user_id, day(ts)) e ON e.user_id = r.user_id AND e.day = r.day
  CROSS JOIN (SELECT 'a' AS provider UNION ALL SELECT 'b') p) x""",
    "laps": """
SELECT session, user_id, driver_id, season, lap, round(80 + value / 100, 4) AS duration, lap % 8 = 1 AS out_lap, lap % 8 = 0 AS in_lap
FROM (SELECT user_id, concat('d', CAST(user_id AS VARCHAR(9))) AS driver_id, CAST(2024 + floor((day(ts) - 1) / 15.0) AS BIGINT) AS season,
    concat(CAST(CAST(floor(user_id / 20.0) AS BIGINT) AS VARCHAR(9)), '/', CAST(CAST(2024 + floor((day(ts) - 1) / 15.0) AS BIGINT) AS VARCHAR(9))) AS session, value,
    CAST(row_number() OVER (PARTITION BY user_id, floor((day(ts) - 1) / 15.0) ORDER BY ts, event_id) AS BIGINT) AS lap FROM {events}) x""",
    "stints": """
SELECT session, user_id, driver_id, season, block AS stint, block * 8 + 1 AS lap_start, block * 8 + 8 AS lap_end, block % 3 AS age_at_start,
  CASE block % 4 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HARD' ELSE 'INTERMEDIATE' END AS compound
FROM (SELECT DISTINCT session, user_id, driver_id, season, CAST(floor((lap - 1) / 8.0) AS BIGINT) AS block FROM {laps}) x""",
    "pits": """
SELECT session, user_id, driver_id, season, lap, round(20 + (duration - 80), 4) AS lane, CASE WHEN user_id % 17 = 0 THEN NULL ELSE round(2 + (duration - 80) / 5, 4) END AS stop
FROM {laps} WHERE in_lap""",
    "forecast": """
SELECT valid_at, count(*) FILTER (WHERE event_type = 'error') / 10 AS precipitation, round(avg(value) / 10, 12) AS temperature, round(stddev_pop(value) / 10, 10) AS wind
FROM (SELECT date_trunc('hour', ts) AS valid_at, event_type, value FROM {events}) x GROUP BY valid_at""",
    "rules": """
SELECT s.season, k.first_round, k.last_round, CAST(b.place AS BIGINT) AS place, CAST(b.p * k.scale AS DOUBLE) AS points
FROM (SELECT CAST(2024 AS BIGINT) AS season UNION ALL SELECT 2025) s
CROSS JOIN (SELECT CAST(1 AS BIGINT) AS first_round, CAST(6 AS BIGINT) AS last_round, 1 AS scale UNION ALL SELECT 7, 12, 2) k
CROSS JOIN (VALUES (1, 25), (2, 18), (3, 15), (4, 12), (5, 10), (6, 8), (7, 6), (8, 4), (9, 2), (10, 1)) AS b(place, p)""",
    "points": """
SELECT r.league, r.day, r.season, r.round, r.event_id, r.driver_id, r.constructor_id, r.label_position AS position, v.version,
  r.label_available_at AS completed_at, CASE v.version WHEN 1 THEN r.label_available_at ELSE r.label_available_at + INTERVAL 48 HOUR END AS effective_at,
  CAST(CASE r.label_position WHEN 1 THEN 25 WHEN 2 THEN 18 WHEN 3 THEN 15 WHEN 4 THEN 12 WHEN 5 THEN 10 WHEN 6 THEN 8 WHEN 7 THEN 6 WHEN 8 THEN 4 WHEN 9 THEN 2 WHEN 10 THEN 1 ELSE 0 END
    - CASE WHEN v.version = 2 AND r.label_position = 1 THEN 10 ELSE 0 END AS DOUBLE) AS points,
  CASE WHEN (r.league + r.day) % 10 = 0 THEN 'disputed' WHEN v.version = 2 THEN 'revised' ELSE 'audited' END AS status
FROM {results} r JOIN (SELECT CAST(1 AS BIGINT) AS version UNION ALL SELECT 2) v ON v.version = 1 OR (r.league + r.day) % 8 = 0""",
    "team_matrix": """
SELECT league, day, season, event_id, constructor_id, sum(points) + CASE WHEN league % 5 = 0 AND day = 3 THEN 1 ELSE 0 END AS points
FROM {points} WHERE version = 1 GROUP BY league, day, season, event_id, constructor_id""",
    "registry": """
SELECT page_id, link_no, title, page_id % 23 AS event, CAST(link_no AS BIGINT) + (page_id % 7) * 10 AS clock, page_id % 11 = 0 AND link_no = 2 AS recalled
FROM (SELECT page_id, CAST(k AS BIGINT) AS link_no, split_part(split_part(html, '<a href="', CAST(k + 1 AS INT)), '"', 1) AS title FROM {pages}
  CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) n) x WHERE title <> ''""",
    "predictions": """
SELECT p.*, p.raw / sum(p.raw) OVER (PARTITION BY league, day, model) AS p_win
FROM (SELECT r.league, r.day, r.season, r.event_id, r.driver_id, r.constructor_id, r.circuit_id, r.label_position, r.label_dnf, r.qualifying_position, s.entrants, m.model,
    CASE m.model WHEN 'grid' THEN 1.0 / r.qualifying_position ELSE exp(-0.15 * ((r.user_id * 7 + r.day * 3) % 20 + 1)) END AS raw
  FROM {results} r JOIN {starts} s ON r.league = s.league AND r.day = s.day CROSS JOIN (SELECT 'grid' AS model UNION ALL SELECT 'form') m) p""",
    "utilities": "SELECT league, day, event_id, driver_id, constructor_id, ln(raw) AS utility, 0.05 + 0.01 * (qualifying_position % 10) AS p_dnf FROM {predictions} WHERE model = 'form'",
    "profiles": "SELECT concat('c', CAST(p_partkey % 7 AS VARCHAR(9))) AS circuit_id, round(avg(CAST(p_size AS DOUBLE)), 9) AS a, round(avg(CAST(p_retailprice AS DOUBLE)), 9) AS b FROM {part} GROUP BY p_partkey % 7",
    "scores": "SELECT l.doc_id, l.quality AS y, CAST(least(greatest(d.n_chars / 5000, 0.001), 0.999) AS DOUBLE) AS p FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id",
    "statuses": """
SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'retired' ELSE 'dns' END AS first,
  CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'finished' WHEN o_orderpriority LIKE '3%' THEN 'dsq' ELSE 'retired' END AS second,
  CAST(o_orderkey % 7 AS BIGINT) AS flags, CAST(year(o_orderdate) AS BIGINT) AS season FROM {orders}""",
    "coverage_old": "SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS season, CASE WHEN c_custkey % 9 = 0 THEN 'excluded' ELSE 'gold' END AS state, CAST(round(c_acctbal) AS BIGINT) AS hash FROM {customer} WHERE c_custkey % 10 <> 0",
    "coverage_new": "SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS season, CASE WHEN c_custkey % 8 = 0 THEN 'excluded' ELSE 'gold' END AS state, CAST(round(c_acctbal) AS BIGINT) + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS hash FROM {customer} WHERE c_custkey % 13 <> 0",
}
_NAME = re.compile(r"\{(\w+)\}")


class Tables:
    """DataFrames of shapes and of the given tables, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in SHAPES:
                sql = SHAPES[name].replace("TSLIT", "TIMESTAMP_NTZ")
                self.made[name] = self.spark.sql(sql, **{x: self(x) for x in set(_NAME.findall(sql))})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.made[name]


def with_shapes(body: str) -> str:
    """A query over shapes named in braces, as DuckDB SQL over the given tables."""
    order: list[str] = []

    def need(sql: str) -> None:
        for x in _NAME.findall(sql):
            if x in SHAPES and x not in order:
                need(SHAPES[x])
                order.append(x)

    need(body)
    plain = lambda sql: _NAME.sub(r"\1", sql).replace("TSLIT", "TIMESTAMP")
    shapes = [f"{x} AS MATERIALIZED ({plain(SHAPES[x])})" for x in order]
    body = plain(body).strip()
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join([*shapes, body[5:]])}"
    return f"WITH {', '.join(shapes)} {body}" if shapes else body
