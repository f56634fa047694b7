"""Queries over stored detections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch.functions.quantiles import exact_quantiles
from linewatch.schemas import PAIR_KEYS
from linewatch.sources.readings import NO_DAY, read_detections, stored_days

MAX_RECENT = 100


def as_detections(flagged: DataFrame, detected_at) -> DataFrame:
    """Flagged scored rows as detection records."""
    rest = [c for c in flagged.columns if c not in (*PAIR_KEYS, "anomaly_score", "anomaly", "detected_at")]
    return flagged.filter("anomaly = 1").select(
        *PAIR_KEYS, "anomaly_score", detected_at.alias("detected_at"), *rest
    )


def counts_by(detections: DataFrame, *keys: str) -> DataFrame:
    return detections.groupBy(*keys).agg(F.count(F.lit(1)).alias("detections"))


def score_stats(detections: DataFrame) -> DataFrame:
    """Count, extremes, mean, median and sample deviation of the scores."""
    plain = detections.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.min("anomaly_score").alias("min_score"),
        F.max("anomaly_score").alias("max_score"),
        F.avg("anomaly_score").alias("mean_score"),
        F.stddev_samp("anomaly_score").alias("std_score"),
    )
    median = exact_quantiles(detections, "anomaly_score", [0.5])
    return plain.withColumn("median_score", median.scalar()).select(
        "total_anomalies", "min_score", "max_score", "mean_score", "median_score", "std_score"
    )


def score_histogram(detections: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width score histogram, non-empty bins only; a constant score fills the first bin."""
    scores = detections.select(F.col("anomaly_score").alias("s")).filter("s is not null")
    ends = scores.agg(F.min("s").alias("low"), F.max("s").alias("high"))  # one row
    placed = scores.join(F.broadcast(ends))
    place = F.floor((F.col("s") - F.col("low")) * float(bins) / (F.col("high") - F.col("low")))
    number = F.when(F.col("high") == F.col("low"), F.lit(0).cast("bigint")).otherwise(F.least(place, F.lit(bins - 1)))
    counts = placed.groupBy(number.alias("bin"), "low", "high").agg(F.count(F.lit(1)).alias("detections"))
    width = (F.col("high") - F.col("low")) / float(bins)
    return counts.select(
        "bin",
        (F.col("low") + F.col("bin") * width).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * width).alias("bin_end"),
        "detections",
    )


def storage_stats(stored: DataFrame) -> DataFrame:
    """Number of detection files and rows of a stored table."""
    return (
        stored.groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count("file").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_anomalies"))
    )


def history(
    detections: DataFrame,
    start=None,
    end=None,
    src: str | None = None,
    dst: str | None = None,
    min_score: float | None = None,
    limit: int = 100,
) -> DataFrame:
    """Newest detections that meet every given condition.

    ``min_score`` keeps scores at or above it, which are the less anomalous ones. Tables stored by ``date`` are pruned
    to the wanted days.
    """
    found = detections
    stored_by_date = "date" in detections.columns
    if start is not None:
        since = F.lit(start).cast("timestamp")
        found = found.filter(F.col("detected_at") >= since)
        if stored_by_date:
            found = found.filter(F.col("date") >= F.to_date(since))
    if end is not None:
        until = F.lit(end).cast("timestamp")
        found = found.filter(F.col("detected_at") <= until)
        if stored_by_date:
            found = found.filter(F.col("date") <= F.to_date(until))
    if src is not None:
        found = found.filter(F.col("src") == src)
    if dst is not None:
        found = found.filter(F.col("dst") == dst)
    if min_score is not None:
        found = found.filter(F.col("anomaly_score") >= min_score)
    return found.orderBy(F.desc("detected_at"), *PAIR_KEYS).limit(limit)


def recent(detections: DataFrame, limit: int = 20) -> DataFrame:
    """The latest detections, at most 100."""
    if not 1 <= limit <= MAX_RECENT:
        raise ValueError(f"limit must be between 1 and {MAX_RECENT}")
    return detections.orderBy(F.desc("detected_at"), *PAIR_KEYS).limit(limit)


def recent_stored(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The latest detections of a table stored by day, reading the newest days only.

    Days are the table's folders. The newest ones are counted, twice as many each time, until they hold ``limit`` rows; every row of
    an older day is older than those. Rows without a stamp stand in a folder of their own and come last.
    """
    if not 1 <= limit <= MAX_RECENT:
        raise ValueError(f"limit must be between 1 and {MAX_RECENT}")
    days = stored_days(spark, path)
    if not days:
        return read_detections(spark, path).limit(0)
    dated = sorted((d for d in days if d != NO_DAY), reverse=True)
    take = 1
    while True:
        last = take >= len(dated)
        chosen = days if last else dated[:take]
        found = read_detections(spark, [f"{path.rstrip('/')}/date={d}" for d in chosen], base=path)
        if last or len(found.select("detected_at").limit(limit).collect()) == limit:  # at most ``limit`` stamps
            return recent(found, limit)
        take *= 2


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of inputs with differing columns; absent ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
