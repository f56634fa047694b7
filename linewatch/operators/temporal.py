"""History of a device pair: rolling baselines over its earlier windows.

Input has one row per pair and window, so a pair holds at most (time span / window length) rows; sorting one pair in a
task is bounded by the calendar, not by the traffic. Where that is too much, ``max_group_rows`` cuts pairs with more rows into
chunks by range of (pair, time). Every chunk is given the last rows before it, as many as a baseline looks back, so that all
chunks are worked on apart with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.functions.exprs import CLAMP
from linewatch.functions.skew import split_hot
from linewatch.schemas import CONTEXT_SOURCES, PAIR_KEYS
from linewatch.session import materialise

PAIR = ["src", "dst"]


def _pair_order(chunked: bool = False):
    return Window.partitionBy(*PAIR, *(["_chunk"] if chunked else [])).orderBy("time_window")


def in_chunks(pairs: DataFrame, back: int, max_rows: int) -> DataFrame:
    """Rows with ``_chunk``, and copies marked ``_halo``: for each chunk the ``back`` rows of its pair that stand before it."""
    split = split_hot(pairs, PAIR, max_rows)
    plain = {"_chunk": F.lit(-1), "_halo": F.lit(False)}
    if split.hot is None:
        return split.cold.withColumns(plain)
    laid = split.hot.repartitionByRange(max(split.chunks, 2), *PAIR, "time_window").withColumn("_chunk", F.spark_partition_id())
    laid = materialise(laid)
    sizes = laid.groupBy(*PAIR, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*PAIR).orderBy("_chunk"))
    ends = sizes.select(*PAIR, "_chunk", upto.alias("_end"), (upto - F.col("_n")).alias("_begin"))  # a few chunks per pair
    from_end = F.row_number().over(Window.partitionBy(*PAIR, "_chunk").orderBy(F.desc("time_window")))
    tails = laid.withColumn("_r", from_end).filter(F.col("_r") <= back).join(ends.select(*PAIR, "_chunk", "_end"), [*PAIR, "_chunk"])
    later = ends.select(*PAIR, F.col("_chunk").alias("_to"), F.col("_begin"))
    # The r-th row from the end of a chunk is the (begin - end + r)-th before a later chunk of its pair.
    seen = tails.join(later, PAIR).filter((F.col("_to") > F.col("_chunk")) & (F.col("_begin") - F.col("_end") + F.col("_r") <= back))
    halo = seen.withColumn("_chunk", F.col("_to")).select(*pairs.columns, "_chunk", F.lit(True).alias("_halo"))
    whole = laid.withColumn("_halo", F.lit(False)).unionByName(halo)
    return whole if split.cold is None else whole.unionByName(split.cold.withColumns(plain))


def relative_deviation(value: Column, baseline: Column) -> Column:
    """``(x - b) / (b + 1)``, with a signed limit where the denominator is zero."""
    return (
        F.when(baseline.isNull(), 0.0)
        .when(baseline + 1 == 0, F.signum(value - baseline) * CLAMP)
        .otherwise((value - baseline) / (baseline + 1))
    )


def rolling_context(
    pairs: DataFrame, cols: Sequence[str] = tuple(CONTEXT_SOURCES), size: int = 5, max_group_rows: int | None = None
) -> DataFrame:
    """Rolling mean and sample deviation over the last ``size`` rows and the relative deviation from the rows before."""
    if max_group_rows is not None:
        pairs = in_chunks(pairs, size, max_group_rows)
    order = _pair_order(max_group_rows is not None)
    upto, before = order.rowsBetween(-(size - 1), 0), order.rowsBetween(-size, -1)
    added = {}
    for c in cols:
        added[f"{c}_rolling_mean"] = F.avg(c).over(upto)
        added[f"{c}_rolling_std"] = F.stddev_samp(c).over(upto)
        added[f"{c}_deviation"] = relative_deviation(F.col(c).cast("double"), F.avg(c).over(before))
    measured = _own_rows(pairs.withColumns(added))
    features = [c for c in measured.columns if c not in PAIR_KEYS]
    return fill_missing(measured, features).select(*PAIR_KEYS, *features)


def _own_rows(measured: DataFrame) -> DataFrame:
    return measured.filter("not _halo").drop("_chunk", "_halo") if "_halo" in measured.columns else measured


def fill_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL and NaN features become 0 once the vector is complete."""
    return df.fillna(0, subset=list(columns))


def history_context(
    pairs: DataFrame,
    cols: Sequence[str] = tuple(CONTEXT_SOURCES),
    size: int = 10,
    min_windows: int = 3,
    keep: int = 20,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Baseline from up to ``size`` earlier windows once ``min_windows`` exist, else from the row itself.

    The deviation is absolute here. ``keep`` is how many windows a history holds; it only matters below ``size``.
    """
    if max_group_rows is not None:
        pairs = in_chunks(pairs, min(size, keep), max_group_rows)
    before = _pair_order(max_group_rows is not None).rowsBetween(-min(size, keep), -1)
    earlier = F.count(F.lit(1)).over(before)
    added = {}
    for c in cols:
        value = F.col(c).cast("double")
        baseline = F.avg(value).over(before)
        added[f"{c}_rolling_mean"] = F.when(earlier >= min_windows, baseline).otherwise(value)
        added[f"{c}_rolling_std"] = F.when(earlier >= min_windows, F.stddev_pop(value).over(before)).otherwise(0.0)
        added[f"{c}_deviation"] = F.when(earlier >= min_windows, value - baseline).otherwise(0.0)
    measured = _own_rows(pairs.withColumns(added))
    ordered = [c for c in measured.columns if c not in PAIR_KEYS]
    return measured.select(*PAIR_KEYS, *ordered)


