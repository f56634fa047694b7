"""Exact quantiles with linear interpolation that never gather a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.functions.skew import MAX_GROUP_ROWS, MAX_HOT_KEYS
from linewatch.session import materialise

_GRID = 1000
_MAX_ROUNDS = 12  # each round cuts a bracket about 250-fold; the result is exact after any number of rounds


def quantile_name(p: float) -> str:
    """``p05``, ``p50``, ``p99_5``: the percentage with all its decimals."""
    whole, _, rest = f"{p * 100:.10f}".rstrip("0").partition(".")
    return f"p{int(whole):02d}" + (f"_{rest}" if rest else "")


def exact_quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    max_rows: int = MAX_GROUP_ROWS,
    max_broadcast: int = MAX_HOT_KEYS,
) -> DataFrame:
    """One row per group with ``p25``-like columns.

    Small groups use the built-in ``percentile``. If any is larger, a mergeable sketch brackets each wanted rank, rows
    outside the bracket are only counted, and the bracket is narrowed until its rows fit one task. The brackets are broadcast;
    with more than ``max_broadcast`` groups the ranks are found digit by digit instead, by joins.
    """
    by = list(by)
    if len({quantile_name(p) for p in probs}) < len(probs):
        raise ValueError(f"two of {list(probs)} have one name")
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("largest"), F.count(F.lit(1)).alias("groups"))
    largest, groups = sizes.first()
    largest = largest or 0
    if largest <= max_rows:
        ranked = rows.groupBy(*by).agg(F.percentile("_v", [float(p) for p in probs]).alias("_ranks"))
        return ranked.select(*by, *[F.get("_ranks", F.lit(i)).alias(quantile_name(p)) for i, p in enumerate(probs)])
    if groups > max_broadcast:
        return radix_quantiles(rows, probs, by)
    return _select_ranks(rows, probs, by, max_rows)


def order_key(value: Column) -> Column:
    """A 64-bit integer that orders doubles as their values do: sign, exponent and the 52 bits of the mantissa."""
    size = F.abs(value)
    guess = F.greatest(F.floor(F.log2(size)).cast("double"), F.lit(-1022.0))
    # The logarithm may round to the neighbour of the exponent. Two factors keep the powers in range.
    def scaled(e: Column) -> Column:
        half = F.floor(e / 2)
        return size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), e - half)

    exponent = guess + F.when(scaled(guess) >= 2, 1).when((scaled(guess) < 1) & (guess > -1022), -1).otherwise(0)
    whole = ((exponent + 1023).cast("bigint") * F.lit(1 << 52)) + ((scaled(exponent) - 1) * F.lit(float(1 << 52))).cast("bigint")
    whole = F.when(size == float("inf"), F.lit(2047 << 52)).otherwise(whole)
    key = F.when(value > 0, whole).when(value < 0, -whole).otherwise(F.lit(0).cast("bigint"))
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).otherwise(key)


_DIGIT = 16  # bits of a round; 64 bits take four


def radix_quantiles(rows: DataFrame, probs: Sequence[float], by: list[str]) -> DataFrame:
    """Exact quantiles of any number of groups of any size, by selecting ranks digit by digit.

    Rows (``by``, ``_v``) are merged to counts per distinct value. In each round the values that share the digits found so far are
    counted by their next digit, and each wanted rank goes on in the digit where it falls. Counting is pre-aggregated, a group's
    counts are at most 65,536, and ranks meet counts by equality joins on (group, digits): nothing is broadcast.
    """
    keys = [*by, "_one"]
    values = rows.withColumn("_one", F.lit(0)).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    values = materialise(values.withColumn("_key", order_key(F.col("_v"))))
    totals = materialise(values.groupBy(*keys).agg(F.sum("_c").alias("_total")))
    ranks = []
    for i, p in enumerate(probs):
        floor = F.floor(F.lit(float(p)) * (F.col("_total") - 1)).cast("bigint")
        for side, rank in enumerate((floor, F.least(floor + 1, F.col("_total") - 1))):
            ranks.append(F.struct(F.lit(i).alias("_i"), F.lit(side).alias("_side"), rank.alias("_rank")))
    targets = totals.select(*keys, F.inline(F.array(*ranks)), F.lit(0).cast("bigint").alias("_head"))
    ids = [*keys, "_i", "_side"]
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        first = shift == 64 - _DIGIT
        head = F.lit(0).cast("bigint") if first else F.shiftright("_key", shift + _DIGIT)
        left = values.withColumn("_head", head)
        if not first:
            left = left.join(targets.select(*keys, "_head").distinct(), [*keys, "_head"], "left_semi")
        found = left.groupBy(*keys, "_head", F.shiftright("_key", shift).alias("_next")).agg(F.sum("_c").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_head").orderBy("_next"))
        spans = found.select(*keys, "_head", "_next", (upto - F.col("_c")).alias("_from"), upto.alias("_to"))
        met = targets.join(spans, [*keys, "_head"]).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        targets = materialise(met.select(*ids, (F.col("_rank") - F.col("_from")).alias("_rank"), F.col("_next").alias("_head")))
    chosen = targets.join(values.select(*keys, F.col("_key").alias("_head"), "_v"), [*keys, "_head"]).join(totals, keys)
    return _interpolated(chosen, probs, keys)


def _interpolated(chosen: DataFrame, probs: Sequence[float], keys: list[str]) -> DataFrame:
    """One row per group from the two neighbours (``_i``, ``_side``, ``_v``) of each probability's place among ``_total`` values."""

    def value(i: int, p: float) -> Column:
        low = F.max(F.when((F.col("_i") == i) & (F.col("_side") == 0), F.col("_v")))
        high = F.max(F.when((F.col("_i") == i) & (F.col("_side") == 1), F.col("_v")))
        place = F.lit(float(p)) * (F.max("_total") - 1)
        return (low + (high - low) * (place - F.floor(place))).alias(quantile_name(p))

    return chosen.groupBy(*keys).agg(*[value(i, p) for i, p in enumerate(probs)]).drop("_one")


def _select_ranks(rows: DataFrame, probs: Sequence[float], by: list[str], max_rows: int) -> DataFrame:
    keys = [*by, "_one"]
    rows = materialise(rows.withColumn("_one", F.lit(0)))
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    # Two wanted ranks per probability: the neighbours that linear interpolation mixes.
    wanted = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_m") - 1)
        floor = F.floor(place).cast("bigint")
        wanted.append(F.struct(F.lit(i).alias("_i"), F.lit(0).alias("_side"), floor.alias("_rank")))
        upper = F.least(floor + 1, F.col("_m") - 1)
        wanted.append(F.struct(F.lit(i).alias("_i"), F.lit(1).alias("_side"), upper.alias("_rank")))
    totals = materialise(totals)
    targets = totals.select(*keys, "_m", "_lo", "_hi", F.inline(F.array(*wanted)))
    ids = [*keys, "_i", "_side"]

    targets = materialise(targets)
    before = None
    for _ in range(_MAX_ROUNDS):
        wide = targets.filter((F.col("_m") > max_rows) & (F.col("_lo") < F.col("_hi")))
        left = wide.agg(F.sum("_m")).first()[0]
        # A bracket that no longer shrinks holds a few values with many copies, which count as one row each below.
        if left is None or left == before:
            break
        before = left
        targets = materialise(_narrow(rows, targets, keys, ids))

    inside = _inside(rows, targets, keys)
    counts = inside.groupBy(*ids, "_rank", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(
        Window.partitionBy(*ids).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    picked = (
        counts.withColumn("_upto", upto)
        .filter(F.col("_upto") > F.col("_rank"))
        .groupBy(*ids)
        .agg(F.min("_v").alias("_v"))
    )
    chosen = picked.join(F.broadcast(totals.select(*keys, F.col("_m").alias("_total"))), keys)
    return _interpolated(chosen, probs, keys)


def _inside(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(F.broadcast(targets), keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))


def _narrow(rows: DataFrame, targets: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Replace each bracket by one holding about 1/250 of its rows, and move the rank along."""
    grid = [j / _GRID for j in range(_GRID + 1)]
    sketch = _inside(rows, targets, keys).groupBy(*ids).agg(
        F.percentile_approx("_v", grid, 20 * _GRID).alias("_grid")
    )
    step = F.col("_rank") / F.greatest(F.col("_m") - 1, F.lit(1)) * F.lit(float(_GRID))
    lower = F.greatest(F.floor(step).cast("int") - 1, F.lit(0))
    upper = F.least(F.ceil(step).cast("int") + 1, F.lit(_GRID))
    proposed = targets.join(sketch, ids).select(
        *ids,
        "_rank",
        "_m",
        "_lo",
        "_hi",
        F.when(lower == 0, F.col("_lo")).otherwise(F.get("_grid", lower)).alias("_new_lo"),
        F.when(upper == _GRID, F.col("_hi")).otherwise(F.get("_grid", upper)).alias("_new_hi"),
    )
    counted = (
        _inside(rows, proposed, keys)
        .groupBy(*ids)
        .agg(
            F.count_if(F.col("_v") < F.col("_new_lo")).alias("_below"),
            F.count_if(F.col("_v").between(F.col("_new_lo"), F.col("_new_hi"))).alias("_kept"),
        )
    )
    moved = proposed.join(counted, ids)
    rank = F.col("_rank") - F.col("_below")
    good = (rank >= 0) & (rank < F.col("_kept"))
    return moved.select(
        *ids,
        F.when(good, rank).otherwise(F.col("_rank")).alias("_rank"),
        F.when(good, F.col("_kept")).otherwise(F.col("_m")).alias("_m"),
        F.when(good, F.col("_new_lo")).otherwise(F.col("_lo")).alias("_lo"),
        F.when(good, F.col("_new_hi")).otherwise(F.col("_hi")).alias("_hi"),
    )
