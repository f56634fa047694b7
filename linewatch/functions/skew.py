"""Keeping every task small when one key holds a large share of the rows.

Order-dependent features need the previous row of a key. Partitioning by the key alone would put a flooding key into
one task. Keys above ``max_rows`` are found by a count with map-side combine and handled apart: their rows are laid out
by a range partitioning on (key, order), so one key spans many tasks, and only the seams between chunks are stitched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewatch.session import materialise

MAX_GROUP_ROWS = 2_000_000  # rows of one key that a single task may sort
MAX_HOT_KEYS = 10_000  # upper bound of the broadcast key list


@dataclass
class Split:
    """Rows of ordinary keys, rows of hot keys, and how many chunks the hot rows need."""

    cold: DataFrame | None
    hot: DataFrame | None
    chunks: int = 1
    hot_keys: DataFrame | None = None


def split_hot(df: DataFrame, keys: Sequence[str], max_rows: int | None = MAX_GROUP_ROWS) -> Split:
    """Part ``df`` (keys not NULL) by group size. ``None`` skips the count where groups are known to be small.

    The list of hot keys is broadcast only while it has at most ``MAX_HOT_KEYS`` entries; beyond that every row takes
    the chunked way, which is exact for any group size.
    """
    if max_rows is None:
        return Split(cold=df, hot=None)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.filter(F.col("_n") > max_rows).limit(MAX_HOT_KEYS + 1).collect()
    if not found:
        return Split(cold=df, hot=None)
    if len(found) > MAX_HOT_KEYS:
        return Split(cold=None, hot=df, chunks=math.ceil(df.count() / max_rows) + 1)
    spark = df.sparkSession
    schema = counts.select(*keys).schema
    hot_keys = spark.createDataFrame([tuple(r[k] for k in keys) for r in found], schema)
    chunks = math.ceil(sum(r["_n"] for r in found) / max_rows) + 1
    return Split(
        cold=df.join(F.broadcast(hot_keys), list(keys), "left_anti"),
        hot=df.join(F.broadcast(hot_keys), list(keys), "left_semi"),
        chunks=chunks,
        hot_keys=hot_keys,
    )


def join_stats(rows: DataFrame, stats: DataFrame, keys: Sequence[str], split: Split) -> DataFrame:
    """Give each hot row the statistics of its key. One stats row per hot key: a bounded broadcast."""
    small = F.broadcast(stats) if split.hot_keys is not None else stats
    return rows.join(small, list(keys))


def lay_out(
    hot: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], chunks: int
) -> DataFrame:
    """Rows of hot keys in chunks of (key, order), written once: every later use reads the same chunk borders and does
    not scan the source again."""
    payload = [c for c in dict.fromkeys([*order, *carry]) if c not in keys]
    placed = (
        hot.select(*keys, *payload)
        .repartitionByRange(max(chunks, 2), *keys, *order)
        .withColumn("_chunk", F.spark_partition_id())
    )
    return materialise(placed)


def chunked_neighbours(
    placed: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    """Every laid-out row that has a predecessor in its key, with ``prev_<c>`` for each column in ``carry``."""
    payload = [c for c in dict.fromkeys([*order, *carry]) if c not in keys]
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    inner = placed.select(
        *keys,
        *payload,
        *[F.lag(c).over(within).alias(f"prev_{c}") for c in carry],
        F.row_number().over(within).alias("_rn"),
    ).filter(F.col("_rn") > 1)

    row = F.struct(*payload)
    place = F.struct(*order)
    ends = placed.groupBy(*keys, "_chunk").agg(
        F.min_by(row, place).alias("_first"), F.max_by(row, place).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")  # a few chunks per key
    seams = ends.withColumn("_prev", F.lag("_last").over(across)).filter(F.col("_prev").isNotNull())
    return inner.drop("_rn").unionByName(
        seams.select(
            *keys,
            *[F.col("_first")[c].alias(c) for c in payload],
            *[F.col("_prev")[c].alias(f"prev_{c}") for c in carry],
        )
    )


def neighbour_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    carry: Sequence[str],
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Rows that have a predecessor in their key, next to its values as ``prev_<c>``."""
    split = split_hot(df, keys, max_rows)
    payload = [c for c in dict.fromkeys([*order, *carry]) if c not in keys]
    parts = []
    if split.cold is not None:
        window = Window.partitionBy(*keys).orderBy(*order)
        lagged = split.cold.select(
            *keys, *payload, *[F.lag(c).over(window).alias(f"prev_{c}") for c in carry], F.row_number().over(window).alias("_rn")
        )
        parts.append(lagged.filter(F.col("_rn") > 1).drop("_rn"))
    if split.hot is not None:
        parts.append(chunked_neighbours(lay_out(split.hot, keys, order, carry, split.chunks), keys, order, carry))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
