"""Record profile: the online definition of the pair features, over whole register lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.functions import exprs as X
from linewatch.functions.skew import MAX_GROUP_ROWS, Split, chunked_neighbours, join_stats, lay_out, split_hot
from linewatch.schemas import ORDER, PAIR_KEYS, ROLLUP_COLUMNS

Z_LIMIT = 3.0


def record_values(readings: DataFrame, window_seconds: float = 300) -> DataFrame:
    """One row per reading with the statistics of its value list; NULL lists have NULL statistics."""
    values = F.col("response_values")
    base = readings.withColumn("mean", X.list_mean(values)).select(
        X.window_id(F.col("ts"), window_seconds).alias("time_window"),
        "src",
        "dst",
        "ts",
        "seq",
        F.coalesce("register_start", "address").alias("register"),
        "mean",
        X.list_std(values, F.col("mean")).alias("std"),
        X.list_range(values).alias("range"),
        X.list_distinct(values).alias("distinct"),
        X.list_entropy(values).alias("entropy"),
    )
    return X.keyed(base, PAIR_KEYS)


def record_features(
    readings: DataFrame, window_seconds: float = 300, max_group_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """One row per (time_window, src, dst) with the 19 roll-up columns in their online definition."""
    base = record_values(readings, window_seconds)
    # The count needs the keys only; the list statistics are pruned from it.
    split = split_hot(base, PAIR_KEYS, max_group_rows)
    parts = []
    if split.cold is not None:
        parts.append(_one_shuffle(split.cold))
    if split.hot is not None:
        parts.append(_chunked(split))
    measured = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return record_columns(measured)


def _one_shuffle(base: DataFrame) -> DataFrame:
    group = Window.partitionBy(*PAIR_KEYS)
    by_register = group.orderBy("register")
    staged = base.withColumns(
        {
            "_prev_ts": F.lag("ts").over(group.orderBy(*ORDER)),
            "_prev_register": F.lag("register").over(by_register),
            "_center": F.avg("mean").over(group),
            "_spread": F.stddev_samp("mean").over(group),
        }
    )
    gap = F.col("ts") - F.col("_prev_ts")
    fresh = F.col("register").isNotNull() & (
        F.col("_prev_register").isNull() | (F.col("_prev_register") != F.col("register"))
    )
    return staged.groupBy(*PAIR_KEYS).agg(
        *_plain_stats(),
        F.count_if(fresh).alias("registers"),
        F.avg(gap).alias("gap_mean"),
        F.stddev_samp(gap).alias("gap_std"),
        _far().alias("far"),
    )


def _chunked(split: Split) -> DataFrame:
    measures = ["ts", "register", "mean", "std", "range", "distinct", "entropy"]
    hot = lay_out(split.hot, PAIR_KEYS, ORDER, measures, split.chunks)
    stats = hot.groupBy(*PAIR_KEYS).agg(*_plain_stats())
    registers = hot.groupBy(*PAIR_KEYS).agg(F.count_distinct("register").alias("registers"))
    pairs = chunked_neighbours(hot, PAIR_KEYS, ORDER, ["ts"])
    gap = F.col("ts") - F.col("prev_ts")
    gaps = pairs.groupBy(*PAIR_KEYS).agg(F.avg(gap).alias("gap_mean"), F.stddev_samp(gap).alias("gap_std"))
    limits = stats.select(*PAIR_KEYS, F.col("mean_avg").alias("_center"), F.col("mean_std").alias("_spread"))
    placed = join_stats(hot.select(*PAIR_KEYS, "mean"), limits, PAIR_KEYS, split)
    counted = placed.groupBy(*PAIR_KEYS).agg(_far().alias("far"))
    return stats.join(registers, PAIR_KEYS).join(counted, PAIR_KEYS).join(gaps, PAIR_KEYS, "left")


def _plain_stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.count("mean").alias("lists"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
        F.avg("mean").alias("mean_avg"),
        F.stddev_samp("mean").alias("mean_std"),
        F.min("mean").alias("mean_min"),
        F.max("mean").alias("mean_max"),
        F.avg("std").alias("std_avg"),
        F.max("std").alias("std_max"),
        F.avg("range").alias("range_avg"),
        F.max("range").alias("range_max"),
        F.sum("distinct").alias("distinct_sum"),
        F.avg("distinct").alias("distinct_avg"),
        # lists of like shape have one entropy: its mean is that number, without the noise of a sum
        F.greatest(F.least(F.avg("entropy"), F.max("entropy")), F.min("entropy")).alias("entropy_avg"),
    ]


def _far() -> Column:
    spread = F.col("_spread")
    return F.count_if((spread > 0) & (F.abs(F.col("mean") - F.col("_center")) / spread > Z_LIMIT))


def record_columns(measured: DataFrame, keys: Sequence[str] = tuple(PAIR_KEYS)) -> DataFrame:
    """Output columns from the measured group statistics; shared with the streaming form."""
    span = F.col("ts_max") - F.col("ts_min")
    judged = (F.col("n") > 2) & (F.col("lists") > 1) & (F.col("mean_std") > 0)
    widest = F.greatest(F.col("mean_max") - F.col("mean_avg"), F.col("mean_avg") - F.col("mean_min"))
    named = {
        "value_mean_mean": F.col("mean_avg"),
        "value_mean_std": F.col("mean_std"),
        "value_mean_min": F.col("mean_min"),
        "value_mean_max": F.col("mean_max"),
        "value_std_mean": F.col("std_avg"),
        "value_std_max": F.col("std_max"),
        "value_range_mean": F.col("range_avg"),
        "value_range_max": F.col("range_max"),
        "value_changes_sum": F.col("distinct_sum"),
        "value_change_rate_mean": F.col("distinct_avg"),
        "read_count_sum": F.col("n"),
        "read_rate_mean": F.when(span > 0, F.col("n") / span),
        "inter_read_mean_mean": F.col("gap_mean"),
        "inter_read_std_mean": F.col("gap_std"),
        "outlier_count_sum": F.when(judged, F.col("far")),
        "max_z_score_max": F.when(judged, widest / F.col("mean_std")),
        "unique_values_mean": F.col("distinct_avg"),
        "entropy_mean": F.col("entropy_avg"),
        "registers_accessed": F.col("registers"),
    }
    return measured.select(
        *keys, *[F.coalesce(named[c].cast("double"), F.lit(0.0)).alias(c) for c in ROLLUP_COLUMNS]
    )
