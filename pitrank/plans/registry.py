"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitrank.plans.fixtures import Tables, with_shapes

FLAGSHIP = "C01_contiguous_windows"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = with_shapes(sql)
        return f

    return add


from pitrank.plans import datasets, evaluation, pointintime, points, publications, sessions, streams  # noqa: E402, F401

#: Other names of queries, kept from when these took in only a part of the days or venues.
ALIASES = {
    **{f"{name}_all_days": name for name in ("G01_rankings", "G02_marginals", "G02_distribution", "G03_mixture", "G04_mixture_draws", "G05_two_stage", "G07_race_table", "G08_predicted_order", "G10_draw_validation", "G11_calibrated_marginals")},
    "C12_venue_similarity_all_parts": "C12_venue_similarity", "C13_similar_venue_delta_all_parts": "C13_similar_venue_delta", "A14_number_crosswalk_by_event": "A14_number_crosswalk",
}
QUERIES.update({name: QUERIES[of] for name, of in ALIASES.items()})
ORACLE_SQL.update({name: ORACLE_SQL[of] for name, of in ALIASES.items()})
