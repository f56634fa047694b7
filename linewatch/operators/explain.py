"""Summaries of scored rows and what sets the flagged ones apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.schemas import PAIR_KEYS


def _flagged():
    return F.col("anomaly") == 1


def summarise(scored: DataFrame) -> DataFrame:
    """Total, flagged, rate, mean, population deviation and range of the scores, in one row."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(_flagged()).alias("anomalies_detected"),
        F.try_divide(F.count_if(_flagged()), F.count(F.lit(1))).alias("anomaly_rate"),
        F.avg("anomaly_score").alias("mean_anomaly_score"),
        F.stddev_pop("anomaly_score").alias("std_anomaly_score"),
        F.min("anomaly_score").alias("min_anomaly_score"),
        F.max("anomaly_score").alias("max_anomaly_score"),
    )


def feature_differences(scored: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each feature in flagged and normal rows and their absolute difference in per cent of the normal mean.

    Features with a normal mean of 0 are skipped; without flagged rows there is nothing to explain.
    """
    means = scored.agg(
        *[F.avg(F.when(_flagged(), F.col(c))).alias(f"a_{c}") for c in cols],
        *[F.avg(F.when(~_flagged(), F.col(c))).alias(f"n_{c}") for c in cols],
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"n_{c}").cast("double").alias("normal_mean"),
            F.col(f"a_{c}").cast("double").alias("anomaly_mean"),
        )
        for c in cols
    ]
    normal, odd = F.col("normal_mean"), F.col("anomaly_mean")
    return (
        means.select(F.inline(F.array(*rows)))
        .filter(odd.isNotNull() & (normal != 0))
        .withColumn("pct_diff", F.abs((odd - normal) / normal) * 100)
    )


def explain(scored: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` features that differ most."""
    return feature_differences(scored, cols).orderBy(F.desc("pct_diff"), "feature").limit(k)


def top_anomalies(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` flagged rows with the lowest score."""
    return (
        scored.filter(_flagged())
        .select(*PAIR_KEYS, "anomaly_score")
        .orderBy("anomaly_score", *PAIR_KEYS)
        .limit(k)
    )


def anomalous_windows(scored: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` windows with any flagged row."""
    return scored.filter(_flagged()).select("time_window").distinct().orderBy("time_window").limit(k)
