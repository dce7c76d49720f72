"""All ready-made queries by name, each a function of (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldtally.plans import banners, fieldwork, links, preparation, tables
from fieldtally.session import tune
from fieldtally.sources.views import SurveyTables

# Names of queries that are not those of their function.
NAMES = {"duration_of_interviews": "duration_seconds", "unused_levels": "observed_levels"}


def _bound(plan: Callable[[SurveyTables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plan(SurveyTables(tune(spark), folder))

    run.__name__ = plan.__name__
    run.__doc__ = plan.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plans = [p for module in (preparation, links, tables, banners, fieldwork) for p in module.QUERIES]
    return {NAMES.get(p.__name__, p.__name__): _bound(p) for p in plans}
