"""The registered queries of the engine and the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import gates, ingestion, listening, texts
from .registry import QUERIES, SQL, Query

__all__ = ["flagship", "oracle_sql", "queries"]
_MODULES = (gates, ingestion, listening, texts)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top artists, tracks and albums of every user who allows it, over seven days."""
    return listening.stats_all_users(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
