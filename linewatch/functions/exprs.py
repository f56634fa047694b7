"""Column expressions used alike by batch jobs and streams."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLAMP = 1e6


def window_id(ts: Column, seconds: float) -> Column:
    """Tumbling window number, aligned to the epoch."""
    return F.floor(ts / F.lit(float(seconds))).cast("bigint")


def numeric_timestamp(ts: Column) -> Column:
    """Epoch seconds, NULL where the input is no number."""
    return ts.try_cast("double")


def to_timestamp(ts: Column) -> Column:
    return F.timestamp_micros(F.round(ts * F.lit(1e6)).cast("bigint"))


def epoch_seconds(stamp: Column) -> Column:
    return F.unix_micros(stamp.cast("timestamp")) / F.lit(1e6)


def element_or_zero(values: Column, index: int) -> Column:
    return F.coalesce(F.get(values, F.lit(index)).cast("double"), F.lit(0.0))


def parse_values(text: Column) -> Column:
    """``"1,2,3"`` to integers. NULL, ``-`` and any bad token give an empty list; blank tokens are skipped."""
    tokens = F.filter(F.split(text, ","), lambda t: F.trim(t) != "")
    numbers = F.transform(tokens, lambda t: F.trim(t).try_cast("bigint"))
    empty = F.array().cast("array<bigint>")
    bad = text.isNull() | (text == "-") | F.exists(numbers, lambda n: n.isNull())
    return F.when(bad, empty).otherwise(numbers)


def integral(text: Column, kind: str = "bigint") -> Column:
    """A whole number, also where it is written with decimals (``3.0``); NULL for anything else."""
    number = text.try_cast("double")
    return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))


def value_list(text: Column) -> Column:
    """A list of numbers from its JSON text or from ``"1,2,3"``; an entry that is no number is NULL in a JSON list."""
    listed = F.transform(F.from_json(text, "array<string>"), lambda v: v.try_cast("double"))
    plain = parse_values(text).cast("array<double>")
    return F.when(F.ltrim(text).startswith("["), listed).when(text.isNotNull(), plain)


# -- statistics of one list ------------------------------------------------------------------------------------------


def list_moments(values: Column) -> Column:
    """``struct(n, mean, m2)`` of a list in one running pass."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(acc: Column, x: Column) -> Column:
        x = x.cast("double")
        n = acc["n"] + 1.0
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(
            n.alias("n"),
            mean.alias("mean"),
            (acc["m2"] + (x - acc["mean"]) * (x - mean)).alias("m2"),
        )

    return F.aggregate(values, start, step)


def list_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def list_mean(values: Column) -> Column:
    """0 for an empty list."""
    return F.when(F.size(values) > 0, list_sum(values) / F.size(values)).when(values.isNotNull(), 0.0)


def list_std(values: Column, mean: Column) -> Column:
    """Population deviation around the given mean of the list, 0 for lists shorter than two."""
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(F.size(values) > 1, F.sqrt(squares / F.size(values))).when(values.isNotNull(), 0.0)


def list_range(values: Column) -> Column:
    return F.when(F.size(values) > 0, (F.array_max(values) - F.array_min(values)).cast("double")).otherwise(
        F.when(values.isNotNull(), 0.0)
    )


def list_distinct(values: Column) -> Column:
    """Number of distinct entries; an empty list counts as one."""
    return F.when(values.isNotNull(), F.greatest(F.size(F.array_distinct(values)), F.lit(1)))


def list_entropy(values: Column) -> Column:
    """Shannon entropy in bits over the exact values of the list."""
    n = F.size(values).cast("double")
    shares = F.transform(
        F.array_distinct(values), lambda v: F.size(F.filter(values, lambda x: x == v)) / n
    )
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p + F.lit(1e-10)))


# -- feature tables --------------------------------------------------------------------------------------------------


def clean_number(value: Column) -> Column:
    """NaN and NULL become 0, infinities become +-1e6."""
    x = value.cast("double")
    return (
        F.when(x == F.lit(float("inf")), CLAMP)
        .when(x == F.lit(float("-inf")), -CLAMP)
        .otherwise(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    )


def feature_vector(df: DataFrame, columns: Sequence[str]) -> Column:
    """Ordered array of the named features, absent ones as 0."""
    have = set(df.columns)
    return F.array(
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in columns]
    )


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def entropy_of_counts(counts: Sequence[Column], total: Column) -> Column:
    """Natural-log entropy of histogram counts, with the small offset inside the logarithm."""
    terms = [(c / total) * F.log(c / total + F.lit(1e-10)) for c in counts]
    return -reduce(lambda a, b: a + b, terms)


def histogram_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin number; the maximum falls into the last bin, a constant group into the middle one."""
    place = F.floor((value - low) * F.lit(float(bins)) / (high - low))
    return F.when(high == low, F.lit(bins // 2)).otherwise(F.least(place.cast("int"), F.lit(bins - 1)))


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is complete; plain null tests reach the file scan."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
