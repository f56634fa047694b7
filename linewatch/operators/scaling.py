"""Standardising feature tables: mean 0, population deviation 1, constant columns left unscaled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch.functions import exprs as X

NOT_FEATURES = ("time_window", "src", "dst", "uid", "timestamp", "anomaly", "anomaly_score", "detected_at")


def _number(column: str) -> Column:
    """Scaling works on cleaned features (see ``prepare``); a missing one counts as 0."""
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class Scaler:
    """Two numbers per feature; small enough for the driver whatever the table size."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    rows: int | None = None  # how many rows it was fitted on

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(range(len(self.columns)), self.columns, self.means, self.scales, strict=True))
        return spark.createDataFrame(rows, "position int, feature string, mean double, scale double")

    @staticmethod
    def from_frame(df: DataFrame) -> Scaler:
        rows = df.orderBy("position").collect()
        return Scaler(
            tuple(r["feature"] for r in rows), tuple(r["mean"] for r in rows), tuple(r["scale"] for r in rows)
        )

    def expressions(self) -> list[Column]:
        return [
            ((_number(c) - F.lit(m)) / F.lit(s)).alias(c)
            for c, m, s in zip(self.columns, self.means, self.scales, strict=True)
        ]


def prepare(features: DataFrame, label: str | None = None) -> tuple[DataFrame, list[str]]:
    """Cleaned features next to their keys and label, and the feature names in order."""
    names = X.numeric_columns(features, exclude=[*NOT_FEATURES, *([label] if label else [])])
    rest = [c for c in features.columns if c not in names]
    return features.select(*rest, *[X.clean_number(F.col(c)).alias(c) for c in names]), names


def scaler_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(position, feature, mean, scale)`` from one aggregation."""
    return _moments(df, cols).select("position", "feature", "mean", "scale")


def _moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(_number(c)).alias(f"m_{c}") for c in cols],
        *[F.stddev_pop(_number(c)).alias(f"s_{c}") for c in cols],
    )
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("feature"),
            F.coalesce(F.col(f"m_{c}"), F.lit(0.0)).alias("mean"),
            F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0).alias("scale"),
        )
        for i, c in enumerate(cols)
    ]
    return stats.select("rows", F.inline(F.array(*rows)))


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> Scaler:
    """One pass over the features; also notes the number of rows."""
    found = sorted(_moments(df, cols).collect(), key=lambda r: r["position"])  # one row per feature
    return Scaler(
        tuple(r["feature"] for r in found),
        tuple(r["mean"] for r in found),
        tuple(r["scale"] for r in found),
        found[0]["rows"],
    )


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Replace the scaler's columns by their standardised values; all others pass."""
    absent = [c for c in scaler.columns if c not in df.columns]
    full = df.withColumns({c: F.lit(0.0) for c in absent}) if absent else df
    scaled = dict(zip(scaler.columns, scaler.expressions(), strict=True))
    return full.select(*[scaled.get(c, F.col(c)) for c in full.columns])


def standardise_table(features: DataFrame) -> DataFrame:
    """Standardise every numeric feature of a table; keys stay as they are."""
    cleaned, names = prepare(features)
    return apply_scaler(cleaned, fit_scaler(cleaned, names))
