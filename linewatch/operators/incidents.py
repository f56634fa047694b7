"""The log of known incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.functions.exprs import elapsed_seconds


def with_duration(incidents: DataFrame) -> DataFrame:
    """Elapsed seconds, NULL while an incident is open."""
    return incidents.withColumn("duration", elapsed_seconds(F.col("started_at"), F.col("completed_at")))


def by_status(incidents: DataFrame, status: str = "running") -> DataFrame:
    return incidents.filter(F.col("status") == status)


def incident_log(incidents: DataFrame, status: str | None = None, limit: int = 10) -> DataFrame:
    """The newest incidents with their duration, optionally of one status."""
    chosen = by_status(incidents, status) if status is not None else incidents
    return with_duration(chosen).orderBy(F.desc("started_at"), "attack_id").limit(limit)


def status_counts(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("status").agg(F.count(F.lit(1)).alias("incidents"))
