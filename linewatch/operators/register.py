"""Register profile: behaviour of each register in a window, rolled up to device pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.functions import exprs as X
from linewatch.functions.skew import MAX_GROUP_ROWS, Split, chunked_neighbours, join_stats, lay_out, split_hot
from linewatch.schemas import ORDER, PAIR_KEYS, REGISTER_KEYS

BINS = 10
Z_LIMIT = 3.0
Z_MIN_COUNT = 10
EPSILON = 1e-6

# Names of one register window, in output order.
REGISTER_COLUMNS = [
    "value_mean", "value_std", "value_min", "value_max", "value_range",
    "value_changes", "value_change_rate", "read_count", "read_rate",
    "inter_read_mean", "inter_read_std", "outlier_count", "max_z_score", "unique_values", "entropy",
]


def register_values(readings: DataFrame, window_seconds: float = 300) -> DataFrame:
    """Readings with their window number and analysed value; rows with a NULL key are left out."""
    base = readings.withColumns(
        {
            "time_window": X.window_id(F.col("ts"), window_seconds),
            "value": X.element_or_zero(F.col("response_values"), 1),
        }
    )
    return X.keyed(base, REGISTER_KEYS)


def register_features(
    readings: DataFrame,
    window_seconds: float = 300,
    min_count: int = 3,
    extra: Mapping[str, Column] | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """One row per (time_window, src, dst, address) with at least ``min_count`` readings.

    ``extra`` adds named aggregate expressions over the reading columns (also ``value`` and ``time_window``).
    """
    base = register_values(readings, window_seconds)
    extra = dict(extra or {})
    split = split_hot(base, REGISTER_KEYS, max_group_rows)
    parts = []
    if split.cold is not None:
        parts.append(_one_shuffle(split.cold, min_count, extra))
    if split.hot is not None:
        parts.append(_chunked(split, min_count, extra))
    measured = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return register_columns(measured, window_seconds, list(extra))


def _one_shuffle(base: DataFrame, min_count: int, extra: Mapping[str, Column]) -> DataFrame:
    """Neighbour and whole-group windows share the group key, so all of it needs one exchange."""
    group = Window.partitionBy(*REGISTER_KEYS)
    in_time = group.orderBy(*ORDER)
    by_value = group.orderBy("value")
    staged = (
        base.withColumns(
            {
                "_next_value": F.lag("value").over(by_value),
                "_prev_value": F.lag("value").over(in_time),
                "_prev_ts": F.lag("ts").over(in_time),
            }
        )
        .withColumns(
            {
                "_n": F.count(F.lit(1)).over(group),
                "_mean": F.avg("value").over(group),
                "_std": F.stddev_pop("value").over(group),
                "_low": F.min("value").over(group),
                "_high": F.max("value").over(group),
            }
        )
        .filter(F.col("_n") >= min_count)
        .withColumn("_bin", X.histogram_bin(F.col("value"), F.col("_low"), F.col("_high"), BINS))
    )
    gap = F.col("ts") - F.col("_prev_ts")
    return staged.groupBy(*REGISTER_KEYS).agg(
        *_plain_stats(),
        (F.count_if(F.col("_next_value") != F.col("value")) + 1).alias("unique_values"),
        F.count_if(F.col("_prev_value") != F.col("value")).alias("changes"),
        F.avg(gap).alias("gap_mean"),
        F.stddev_pop(gap).alias("gap_std"),
        *_row_counts(),
        *[e.alias(name) for name, e in extra.items()],
    )


def _chunked(split: Split, min_count: int, extra: Mapping[str, Column]) -> DataFrame:
    """The same measures for keys too large for one task: partial aggregates before every exchange."""
    hot = lay_out(split.hot, REGISTER_KEYS, ORDER, ["ts", "value"], split.chunks)
    stats = hot.groupBy(*REGISTER_KEYS).agg(*_plain_stats()).filter(F.col("n") >= min_count)
    if extra:
        named = split.hot.groupBy(*REGISTER_KEYS).agg(*[e.alias(name) for name, e in extra.items()])
        stats = stats.join(named, REGISTER_KEYS)
    distinct = hot.groupBy(*REGISTER_KEYS).agg(F.count_distinct("value").alias("unique_values"))
    pairs = chunked_neighbours(hot, REGISTER_KEYS, ORDER, ["ts", "value"])
    gap = F.col("ts") - F.col("prev_ts")
    neighbours = pairs.groupBy(*REGISTER_KEYS).agg(
        F.count_if(F.col("prev_value") != F.col("value")).alias("changes"),
        F.avg(gap).alias("gap_mean"),
        F.stddev_pop(gap).alias("gap_std"),
    )
    limits = stats.select(
        *REGISTER_KEYS,
        F.col("n").alias("_n"),
        F.col("mean").alias("_mean"),
        F.col("std").alias("_std"),
        F.col("low").alias("_low"),
        F.col("high").alias("_high"),
    )
    placed = join_stats(hot.select(*REGISTER_KEYS, "value"), limits, REGISTER_KEYS, split)
    placed = placed.withColumn("_bin", X.histogram_bin(F.col("value"), F.col("_low"), F.col("_high"), BINS))
    counted = placed.groupBy(*REGISTER_KEYS).agg(*_row_counts())
    return (
        stats.join(distinct, REGISTER_KEYS).join(counted, REGISTER_KEYS).join(neighbours, REGISTER_KEYS, "left")
    )


def _plain_stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    ]


def _row_counts() -> list[Column]:
    """Counts per row once the group statistics are known."""
    z = F.abs(F.col("value") - F.col("_mean")) / (F.col("_std") + F.lit(EPSILON))
    far = (F.col("_n") > Z_MIN_COUNT) & (z > Z_LIMIT)
    return [
        F.count_if(far).alias("far"),
        *[F.count_if(F.col("_bin") == i).alias(f"_bin{i}") for i in range(BINS)],
    ]


def register_columns(
    measured: DataFrame,
    window_seconds: float,
    extra: Sequence[str] = (),
    keys: Sequence[str] = tuple(REGISTER_KEYS),
) -> DataFrame:
    """Output columns from the measured group statistics; shared with the streaming form."""
    n, mean, std = F.col("n"), F.col("mean"), F.col("std")
    low, high = F.col("low"), F.col("high")
    widest = F.greatest(high - mean, mean - low) / (std + F.lit(EPSILON))
    return measured.select(
        *keys,
        mean.alias("value_mean"),
        std.alias("value_std"),
        low.alias("value_min"),
        high.alias("value_max"),
        (high - low).alias("value_range"),
        F.coalesce(F.col("changes"), F.lit(0)).alias("value_changes"),
        (F.coalesce(F.col("changes"), F.lit(0)) / n).alias("value_change_rate"),
        n.alias("read_count"),
        (n / F.lit(float(window_seconds))).alias("read_rate"),
        F.coalesce(F.col("gap_mean"), F.lit(0.0)).alias("inter_read_mean"),
        F.coalesce(F.col("gap_std"), F.lit(0.0)).alias("inter_read_std"),
        F.col("far").alias("outlier_count"),
        F.when(n > Z_MIN_COUNT, widest).otherwise(0.0).alias("max_z_score"),
        "unique_values",
        X.entropy_of_counts([F.col(f"_bin{i}") for i in range(BINS)], n).alias("entropy"),
        *extra,
    )


def pair_rollup(
    register_windows: DataFrame, extra: Sequence[str] = (), keys: Sequence[str] = tuple(PAIR_KEYS)
) -> DataFrame:
    """Registers of a device pair in one window become one row; extra measures are averaged."""

    def number(e: Column, name: str) -> Column:
        return e.cast("double").alias(name)

    return register_windows.groupBy(*keys).agg(
        F.avg("value_mean").alias("value_mean_mean"),
        F.stddev_samp("value_mean").alias("value_mean_std"),
        F.min("value_mean").alias("value_mean_min"),
        F.max("value_mean").alias("value_mean_max"),
        F.avg("value_std").alias("value_std_mean"),
        F.max("value_std").alias("value_std_max"),
        F.avg("value_range").alias("value_range_mean"),
        F.max("value_range").alias("value_range_max"),
        number(F.sum("value_changes"), "value_changes_sum"),
        F.avg("value_change_rate").alias("value_change_rate_mean"),
        number(F.sum("read_count"), "read_count_sum"),
        F.avg("read_rate").alias("read_rate_mean"),
        F.avg("inter_read_mean").alias("inter_read_mean_mean"),
        F.avg("inter_read_std").alias("inter_read_std_mean"),
        number(F.sum("outlier_count"), "outlier_count_sum"),
        F.max("max_z_score").alias("max_z_score_max"),
        F.avg("unique_values").alias("unique_values_mean"),
        F.avg("entropy").alias("entropy_mean"),
        # a register is one row here, so its address needs no distinct count
        number(F.count("address"), "registers_accessed"),
        *[F.avg(name).alias(f"{name}_mean") for name in extra],
    )


def extraction_summary(readings: DataFrame, features: DataFrame, window_seconds: float) -> DataFrame:
    """One row: input records, output vectors, output columns and window length."""
    zero = F.lit(0).cast("bigint")
    read = readings.agg(F.count(F.lit(1)).alias("total_records")).withColumn("feature_vectors", zero)
    made = features.agg(F.count(F.lit(1)).alias("feature_vectors")).withColumn("total_records", zero)
    return read.unionByName(made).agg(
        F.sum("total_records").alias("total_records"),
        F.sum("feature_vectors").alias("feature_vectors"),
        F.lit(len(features.columns)).cast("bigint").alias("num_features"),
        F.lit(int(window_seconds)).cast("bigint").alias("time_window_seconds"),
    )
