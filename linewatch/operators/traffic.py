"""Transaction, inter-arrival and connection features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewatch.functions import exprs as X
from linewatch.functions.quantiles import exact_quantiles, quantile_name
from linewatch.functions.skew import MAX_GROUP_ROWS, chunked_neighbours, lay_out, split_hot
from linewatch.schemas import ORDER, PAIR_KEYS

IAT_PERCENTILES = (0.25, 0.50, 0.75, 0.95)
MAX_CODES = 10_000  # columns of a pivot; a function code is one byte in the protocol


def _windowed(readings: DataFrame, window_seconds: float) -> DataFrame:
    return X.keyed(readings.withColumn("time_window", X.window_id(F.col("ts"), window_seconds)), PAIR_KEYS)


def function_codes(readings: DataFrame, most: int = MAX_CODES) -> list[str]:
    """The function codes in use, which become columns; more than ``most`` of them raise an error."""
    found = readings.select("func").filter("func is not null").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} function codes: name those wanted as columns, or use code_counts_long")
    return sorted(r[0] for r in found)


def code_counts_long(readings: DataFrame, window_seconds: float = 60) -> DataFrame:
    """One row per pair-window and function code in it, for any number of codes."""
    rows = _windowed(readings, window_seconds).filter("func is not null")
    return rows.groupBy(*PAIR_KEYS, "func").agg(F.count(F.lit(1)).alias("n"))


def code_counts(readings: DataFrame, window_seconds: float = 60, codes: Sequence[str] | None = None) -> DataFrame:
    """One ``func_<code>_count`` column per function code, 0 where a pair-window has none."""
    codes = function_codes(readings) if codes is None else list(codes)
    counts = [F.count_if(F.col("func") == c).alias(f"func_{c}_count") for c in codes]
    return _windowed(readings, window_seconds).groupBy(*PAIR_KEYS).agg(*counts)


def traffic_features(
    readings: DataFrame,
    window_seconds: float = 60,
    codes: Sequence[str] | None = None,
    pivot: bool = True,
) -> DataFrame:
    """Transaction counts, rate and diversity per pair-window, with the function-code pivot in the same aggregation."""
    if not pivot:
        codes = []
    elif codes is None:
        codes = function_codes(readings)
    counts = [F.count_if(F.col("func") == c).alias(f"func_{c}_count") for c in codes]
    grouped = _windowed(readings, window_seconds).groupBy(*PAIR_KEYS)
    return (
        grouped.agg(
            F.count("ts").alias("ts_count"),
            F.min("ts").alias("ts_min"),
            F.max("ts").alias("ts_max"),
            F.count_distinct("tid").alias("tid_nunique"),
            F.count_distinct("unit").alias("unit_nunique"),
            F.count_distinct("src_port").alias("src_port_nunique"),
            *counts,
        )
        .withColumns(
            {
                "duration": F.col("ts_max") - F.col("ts_min"),
                "transaction_rate": F.col("ts_count") / F.lit(float(window_seconds)),
            }
        )
    )


def _gaps(readings: DataFrame, window_seconds: float, max_group_rows: int | None):
    """Gap to the previous reading of the pair, across windows. Returns ordinary and hot rows apart.

    A pair lives as long as the log, so nothing is partitioned by pair alone. Rows are ordered inside their
    pair-window; only its first row looks back, at the last stamp of the pair's previous window.
    """
    base = _windowed(readings, window_seconds).select(*PAIR_KEYS, "ts", "seq")
    edges = base.groupBy(*PAIR_KEYS).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    earlier = edges.select(
        *PAIR_KEYS,
        "_first",
        F.lag("_last").over(Window.partitionBy("src", "dst").orderBy("time_window")).alias("_before"),
    )
    split = split_hot(base, PAIR_KEYS, max_group_rows)
    cold = hot = None
    if split.cold is not None:
        order = Window.partitionBy(*PAIR_KEYS).orderBy(*ORDER)
        rows = split.cold.withColumn("_prev", F.lag("ts").over(order))
        cold = rows.join(earlier, PAIR_KEYS).select(
            *PAIR_KEYS, (F.col("ts") - F.coalesce("_prev", "_before")).alias("gap")
        )
    if split.hot is not None:
        placed = lay_out(split.hot, PAIR_KEYS, ORDER, ["ts"], split.chunks)
        inner = chunked_neighbours(placed, PAIR_KEYS, ORDER, ["ts"])
        first = earlier
        if split.hot_keys is not None:
            first = earlier.join(F.broadcast(split.hot_keys), PAIR_KEYS, "left_semi")
        hot = inner.select(*PAIR_KEYS, (F.col("ts") - F.col("prev_ts")).alias("gap")).unionByName(
            first.select(*PAIR_KEYS, (F.col("_first") - F.col("_before")).alias("gap"))
        )
    return cold, hot


def gap_features(
    readings: DataFrame,
    window_seconds: float = 60,
    percentiles: Sequence[float] = (),
    approximate: bool = False,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Mean, sample deviation, extremes and optional percentiles of the inter-arrival gaps of each pair-window."""
    cold, hot = _gaps(readings, window_seconds, max_group_rows)
    stats = [
        F.avg("gap").alias("iat_mean"),
        F.stddev_samp("gap").alias("iat_std"),
        F.min("gap").alias("iat_min"),
        F.max("gap").alias("iat_max"),
    ]
    names = {p: f"iat_{quantile_name(p)}" for p in percentiles}
    rank = F.percentile_approx if approximate else F.percentile

    def with_percentiles(gaps: DataFrame) -> DataFrame:
        if not percentiles:
            return gaps.groupBy(*PAIR_KEYS).agg(*stats)
        # one aggregate for all percentiles keeps one value map per group
        ranked = gaps.groupBy(*PAIR_KEYS).agg(*stats, rank("gap", [float(p) for p in percentiles]).alias("_ranks"))
        found = {names[p]: F.get("_ranks", F.lit(i)) for i, p in enumerate(percentiles)}
        return ranked.withColumns(found).drop("_ranks")

    parts = []
    if cold is not None:
        parts.append(with_percentiles(cold))
    if hot is not None:
        if percentiles and not approximate:
            exact = exact_quantiles(hot, "gap", percentiles, PAIR_KEYS, max_group_rows)
            exact = exact.withColumnsRenamed({quantile_name(p): names[p] for p in percentiles})
            parts.append(hot.groupBy(*PAIR_KEYS).agg(*stats).join(exact, PAIR_KEYS, "left"))
        else:
            parts.append(with_percentiles(hot))
    joined = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return joined.fillna(0, subset=["iat_mean", "iat_std", "iat_min", "iat_max", *names.values()])


def window_features(
    readings: DataFrame,
    window_seconds: float = 60,
    codes: Sequence[str] | None = None,
    percentiles: Sequence[float] = (),
    pivot: bool = True,
) -> DataFrame:
    """Traffic features with the gap features of the same pair-window."""
    traffic = traffic_features(readings, window_seconds, codes, pivot)
    gaps = gap_features(readings, window_seconds, percentiles)
    joined = traffic.join(gaps, PAIR_KEYS, "left")
    return joined.fillna(0, subset=[c for c in joined.columns if c not in PAIR_KEYS])


def connection_features(readings: DataFrame) -> DataFrame:
    """Behaviour of each connection."""
    return (
        readings.filter("uid is not null")
        .groupBy("uid")
        .agg(
            F.count("ts").alias("transaction_count"),
            F.min("ts").alias("conn_start"),
            F.max("ts").alias("conn_end"),
            F.count_distinct("tid").alias("unique_tids"),
            F.count_distinct("func").alias("unique_functions"),
            F.count_if(F.col("pdu_type") == "REQ").alias("request_count"),
        )
        .withColumns(
            {
                "conn_duration": F.col("conn_end") - F.col("conn_start"),
                "response_count": F.col("transaction_count") - F.col("request_count"),
            }
        )
        .withColumn("req_resp_ratio", F.col("request_count") / (F.col("response_count") + 1))
    )
