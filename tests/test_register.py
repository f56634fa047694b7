from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linewatch.operators import register, temporal
from linewatch.plans import jobs
from linewatch.schemas import CONTEXT_SOURCES, PAIR_FEATURE_COLUMNS, PAIR_KEYS, REGISTER_KEYS, ROLLUP_COLUMNS
from tests.helpers import make_readings, same, same_pandas

W = 100


def restated(rows, window=W):
    """The register definition with NumPy, one group after the other."""
    df = pd.DataFrame(rows, columns=["ts", "src", "dst", "address", "values"])
    df["value"] = [float(v[1]) if v is not None and len(v) > 1 else 0.0 for v in df["values"]]
    df["time_window"] = np.floor(df["ts"] / window).astype("int64")
    out = []
    for key, g in df.dropna(subset=["src", "dst", "address"]).groupby(REGISTER_KEYS):
        g = g.sort_values("ts", kind="stable")
        v, t, n = g["value"].to_numpy(), g["ts"].to_numpy(), len(g)
        if n < 3:
            continue
        z = np.abs(v - v.mean()) / (v.std() + 1e-6)
        share = np.histogram(v, bins=10)[0] / n
        out.append(
            [*key, v.mean(), v.std(), v.min(), v.max(), np.ptp(v), (np.diff(v) != 0).sum(), (np.diff(v) != 0).sum() / n,
             n, n / window, np.diff(t).mean(), np.diff(t).std(), (z > 3).sum() if n > 10 else 0,
             z.max() if n > 10 else 0.0, len(np.unique(v)), -np.sum(share * np.log(share + 1e-10))]
        )
    return pd.DataFrame(out, columns=[*REGISTER_KEYS, *register.REGISTER_COLUMNS])


def sample_rows():
    rng = np.random.default_rng(7)
    rows = []
    for address, n in enumerate([1, 2, 3, 10, 11, 40]):
        stamps = np.sort(rng.uniform(0, W, n).round(2))
        rows += [(float(t), "a", "b", address, [0.0, float(rng.integers(0, 5))]) for t in stamps]
    rows += [(float(t), "a", "b", 20, [1.0, 7.0]) for t in range(12)]  # constant
    rows += [(50.0, "a", "b", 21, [1.0, float(i % 3)]) for i in range(9)]  # equal stamps: arrival order decides
    rows += [(float(t), "a", "c", 1, [1.0, 1000.0 if t == 13 else float(t % 2)]) for t in range(20)]  # one outlier
    rows += [(float(t), "c", "b", 1, None if t % 2 else [4.0]) for t in range(5)]  # short and missing lists
    rows += [(float(t), None, "b", 1, [1.0, 2.0]) for t in range(5)] + [(1.0, "a", "b", None, [1.0, 2.0])] * 4
    return rows


@pytest.mark.parametrize("max_group_rows", [1_000_000, 9, 2])
def test_register_features_equal_numpy(spark, max_group_rows):
    """Whatever number of rows a task may take: one shuffle, part chunked, all chunked."""
    rows = sample_rows()
    got = register.register_features(make_readings(spark, rows), W, max_group_rows=max_group_rows)
    got = got.toPandas().sort_values(REGISTER_KEYS, ignore_index=True)
    want = restated(rows).sort_values(REGISTER_KEYS, ignore_index=True)
    same_pandas(got.astype({c: float for c in register.REGISTER_COLUMNS}), want.astype({c: float for c in register.REGISTER_COLUMNS}))


def test_constant_series_entropy_is_tiny(spark):
    got = register.register_features(make_readings(spark, [(float(t), "a", "b", 1, [0.0, 3.0]) for t in range(5)]), W)
    assert abs(got.first()["entropy"]) < 1e-9


def test_too_many_hot_keys_fall_back_to_chunks(spark, readings, monkeypatch):
    from linewatch.functions import skew

    want = register.register_features(readings, 86_400)
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 1)
    same(register.register_features(readings, 86_400, max_group_rows=5), want, REGISTER_KEYS)


def test_rollup_equals_pandas(spark, readings):
    windows = register.register_features(readings, 86_400)
    got = register.pair_rollup(windows).fillna(0).toPandas().sort_values(PAIR_KEYS, ignore_index=True)
    g = windows.toPandas().groupby(PAIR_KEYS)
    want = g.agg(
        value_mean_mean=("value_mean", "mean"), value_mean_std=("value_mean", "std"), value_mean_min=("value_mean", "min"),
        value_mean_max=("value_mean", "max"), value_std_mean=("value_std", "mean"), value_std_max=("value_std", "max"),
        value_range_mean=("value_range", "mean"), value_range_max=("value_range", "max"),
        value_changes_sum=("value_changes", "sum"), value_change_rate_mean=("value_change_rate", "mean"),
        read_count_sum=("read_count", "sum"), read_rate_mean=("read_rate", "mean"),
        inter_read_mean_mean=("inter_read_mean", "mean"), inter_read_std_mean=("inter_read_std", "mean"),
        outlier_count_sum=("outlier_count", "sum"), max_z_score_max=("max_z_score", "max"),
        unique_values_mean=("unique_values", "mean"), entropy_mean=("entropy", "mean"),
        registers_accessed=("address", "nunique"),
    ).fillna(0).reset_index()
    same_pandas(got, want.sort_values(PAIR_KEYS, ignore_index=True).astype({c: float for c in ROLLUP_COLUMNS}))


def pair_frame(spark, values):
    rows = [(i, "a", "b", *[float(v)] * 3) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "time_window bigint, src string, dst string, " + ", ".join(f"{c} double" for c in CONTEXT_SOURCES))


def test_rolling_context_equals_pandas(spark):
    values = [3, 5, 5, 9, 1, 0, 4, 4, 4, 12]
    got = temporal.rolling_context(pair_frame(spark, values)).toPandas().sort_values("time_window")
    s = pd.Series(values, dtype=float)
    rolling = s.rolling(5, min_periods=1)
    base = rolling.mean().shift(1)
    for c in CONTEXT_SOURCES:
        np.testing.assert_allclose(got[f"{c}_rolling_mean"], rolling.mean())
        np.testing.assert_allclose(got[f"{c}_rolling_std"], rolling.std().fillna(0), atol=1e-12)
        np.testing.assert_allclose(got[f"{c}_deviation"], ((s - base) / (base + 1)).fillna(0))


def test_baseline_of_minus_one_is_limited(spark):
    got = temporal.rolling_context(pair_frame(spark, [-1, 5, -1])).toPandas().sort_values("time_window")
    assert list(got["value_mean_mean_deviation"])[:2] == [0.0, 1e6]
    same_as_base = temporal.rolling_context(pair_frame(spark, [-1, -1])).toPandas()
    assert list(same_as_base["value_mean_mean_deviation"]) == [0.0, 0.0]


def test_history_context_equals_numpy(spark):
    values = list(range(14)) + [3, 3, 50]
    got = temporal.history_context(pair_frame(spark, values)).toPandas().sort_values("time_window")
    for i, v in enumerate(values):
        past = np.array(values[max(0, i - 10) : i], dtype=float)
        want = (past.mean(), past.std(), v - past.mean()) if i >= 3 else (v, 0.0, 0.0)
        row = got.iloc[i]
        have = [row[f"read_count_sum_{s}"] for s in ("rolling_mean", "rolling_std", "deviation")]
        np.testing.assert_allclose(have, want, atol=1e-12)


@pytest.mark.parametrize("profile", ["register", "record"])
def test_pair_features_shape(spark, readings, profile):
    got = jobs.pair_features(readings, 86_400, profile)
    assert got.columns == [*PAIR_KEYS, *PAIR_FEATURE_COLUMNS] and len(got.columns) == 31
    frame = got.toPandas()
    assert len(frame) and np.isfinite(frame[PAIR_FEATURE_COLUMNS].to_numpy(float)).all()


def test_extra_features_join_the_vector(spark, readings):
    got = jobs.pair_features(readings, 86_400, extra={"peak": F.max("value")})
    assert got.columns[-1] == "peak_mean"
    hot = register.register_features(readings, 86_400, extra={"peak": F.max("value")}, max_group_rows=4)
    same(hot, register.register_features(readings, 86_400, extra={"peak": F.max("value")}), REGISTER_KEYS)


def test_summary_counts(spark, readings):
    features = jobs.pair_features(readings, 86_400)
    row = register.extraction_summary(readings, features, 86_400).first()
    assert (row["total_records"], row["feature_vectors"], row["num_features"]) == (1000, features.count(), 31)


def test_one_exchange_per_key_level(spark, readings):
    """Register windows, roll-up and context shuffle once each."""
    plan = jobs.pair_features(readings, 86_400)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
