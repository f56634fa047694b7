from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from linewatch.operators import record, traffic
from linewatch.schemas import PAIR_KEYS, ROLLUP_COLUMNS
from tests.helpers import make_readings, same, same_pandas

W = 100


def restated(rows):
    df = pd.DataFrame(rows, columns=["ts", "src", "dst", "address", "values"])
    df["time_window"] = np.floor(df["ts"] / W).astype("int64")
    out = []
    for key, g in df.dropna(subset=["src", "dst"]).groupby(PAIR_KEYS):
        g = g.sort_values("ts", kind="stable")
        lists = [v for v in g["values"] if v is not None]
        f = dict.fromkeys(ROLLUP_COLUMNS, 0.0)
        if lists:
            m = np.array([np.mean(v) if v else 0.0 for v in lists])
            s = np.array([np.std(v) if len(v) > 1 else 0.0 for v in lists])
            r = np.array([np.ptp(v) if v else 0.0 for v in lists])
            d = np.array([len(set(v)) if v else 1 for v in lists], dtype=float)
            e = []
            for v in lists:
                p = np.unique(v, return_counts=True)[1] / max(len(v), 1)
                e.append(-np.sum(p * np.log2(p + 1e-10)) if len(v) > 1 else 0.0)
            f |= {
                "value_mean_mean": m.mean(), "value_mean_std": m.std(ddof=1) if len(m) > 1 else 0.0,
                "value_mean_min": m.min(), "value_mean_max": m.max(), "value_std_mean": s.mean(), "value_std_max": s.max(),
                "value_range_mean": r.mean(), "value_range_max": r.max(), "value_changes_sum": d.sum(),
                "value_change_rate_mean": d.mean(), "unique_values_mean": d.mean(), "entropy_mean": np.mean(e),
            }
            if len(g) > 2 and len(m) > 1 and m.std(ddof=1) > 0:
                z = np.abs(m - m.mean()) / m.std(ddof=1)
                f |= {"outlier_count_sum": (z > 3).sum(), "max_z_score_max": z.max()}
        t = g["ts"].to_numpy()
        gaps = np.diff(t)
        f["read_count_sum"] = len(g)
        f["read_rate_mean"] = len(g) / (t[-1] - t[0]) if t[-1] > t[0] else 0.0
        f["inter_read_mean_mean"] = gaps.mean() if len(gaps) else 0.0
        f["inter_read_std_mean"] = gaps.std(ddof=1) if len(gaps) > 1 else 0.0
        f["registers_accessed"] = g["address"].nunique()
        out.append([*key, *[float(f[c]) for c in ROLLUP_COLUMNS]])
    return pd.DataFrame(out, columns=[*PAIR_KEYS, *ROLLUP_COLUMNS])


def record_rows():
    rng = np.random.default_rng(11)
    rows = [(float(t), "a", "b", t % 3, [float(x) for x in rng.integers(0, 4, t % 5)]) for t in range(60)]
    rows += [(150.0, "a", "b", 1, [500.0, 500.0])]  # a window of one record
    rows += [(float(200 + t), "a", "b", 1, None) for t in range(4)]  # no lists at all
    rows += [(float(t), "c", "b", None, [1.0, 2.0] if t != 15 else [900.0]) for t in range(20)]
    rows += [(10.0, "d", "b", 1, [1.0]), (20.0, "d", "b", 2, [2.0])]  # two records
    rows += [(5.0, "e", None, 1, [1.0])]
    return rows


@pytest.mark.parametrize("max_group_rows", [1_000_000, 10, 1])
def test_record_features_equal_numpy(spark, max_group_rows):
    rows = record_rows()
    got = record.record_features(make_readings(spark, rows), W, max_group_rows=max_group_rows)
    same_pandas(
        got.toPandas().sort_values(PAIR_KEYS, ignore_index=True), restated(rows).sort_values(PAIR_KEYS, ignore_index=True)
    )


def test_register_start_comes_before_address(spark):
    from pyspark.sql import functions as F

    rows = make_readings(spark, [(float(t), "a", "b", 1, [1.0]) for t in range(4)])
    starts = rows.withColumn("register_start", F.col("seq") % 2)
    assert record.record_features(starts, W).first()["registers_accessed"] == 2.0


@pytest.mark.parametrize("max_group_rows", [1_000_000, 12, 1])
def test_gap_features_equal_pandas(spark, readings, max_group_rows):
    window = 86_400
    got = traffic.gap_features(readings, window, traffic.IAT_PERCENTILES, max_group_rows=max_group_rows)
    df = readings.select("ts", "seq", "src", "dst").toPandas().sort_values(["src", "dst", "ts", "seq"])
    df["time_window"] = np.floor(df["ts"] / window).astype("int64")
    df["gap"] = df.groupby(["src", "dst"])["ts"].diff()
    g = df.groupby(PAIR_KEYS)["gap"]
    want = g.agg(["mean", "std", "min", "max"])
    for q in traffic.IAT_PERCENTILES:
        want[f"p{round(q * 100)}"] = g.quantile(q)
    want = want.fillna(0).reset_index()
    want.columns = [*PAIR_KEYS, "iat_mean", "iat_std", "iat_min", "iat_max", "iat_p25", "iat_p50", "iat_p75", "iat_p95"]
    same_pandas(
        got.toPandas().sort_values(PAIR_KEYS, ignore_index=True), want.sort_values(PAIR_KEYS, ignore_index=True), 1e-7
    )


def test_traffic_and_pivot(spark, readings):
    got = traffic.traffic_features(readings, 86_400).toPandas()
    codes = [c for c in got.columns if c.startswith("func_")]
    assert codes == [f"func_{c}_count" for c in ("click", "error", "purchase", "signup", "view")]
    assert (got[codes].sum(axis=1) == got["ts_count"]).all() and got["ts_count"].sum() == 1000
    same(traffic.code_counts(readings, 86_400), traffic.traffic_features(readings, 86_400).select(*PAIR_KEYS, *codes), PAIR_KEYS)


def test_window_features_have_no_gaps(spark, readings):
    got = traffic.window_features(readings, 3_600, percentiles=[0.5]).toPandas()
    assert not got.isna().any().any()
    assert len(got) == traffic.traffic_features(readings, 3_600).count()


def test_connections(spark, readings):
    got = traffic.connection_features(readings).toPandas()
    assert (got["request_count"] + got["response_count"] == got["transaction_count"]).all()
    assert np.allclose(got["req_resp_ratio"], got["request_count"] / (got["response_count"] + 1))


def test_any_number_of_codes(spark):
    """Two thousand codes: one column each, or one row each in the long form."""
    rows = [(float(i), "a", "b", f"c{i % 2000}") for i in range(4000)]
    logs = spark.createDataFrame(rows, "ts double, src string, dst string, func string")
    assert len(traffic.function_codes(logs)) == 2000
    long = traffic.code_counts_long(logs, 10_000)
    assert long.count() == 2000 and {r["n"] for r in long.collect()} == {2}


def test_approximate_percentiles_stay_in_range(spark, readings):
    got = traffic.gap_features(readings, 86_400, [0.5], approximate=True).toPandas()
    assert ((got["iat_p50"] >= got["iat_min"]) & (got["iat_p50"] <= got["iat_max"])).all()


def test_too_many_codes_for_columns(spark):
    rows = spark.range(300).selectExpr("cast(id as double) as ts", "'a' as src", "'b' as dst", "concat('f', id) as func")
    with pytest.raises(ValueError, match="code_counts_long"):
        traffic.function_codes(rows, most=256)
    assert len(traffic.function_codes(rows, most=300)) == 300
    assert traffic.code_counts(rows, 60, ["f1", "f299"]).columns[-2:] == ["func_f1_count", "func_f299_count"]
    assert traffic.code_counts_long(rows, 60).count() == 300
