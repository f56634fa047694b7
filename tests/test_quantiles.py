"""Rank selection by digits against NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewatch.functions import quantiles as q

PROBS = [0.0, 0.05, 0.25, 0.5, 0.755, 0.95, 1.0]


def test_order_key_orders_doubles(spark):
    rng = np.random.default_rng(1)
    some = np.r_[rng.normal(size=200), 10.0 ** rng.uniform(-320, 308, 200), -(10.0 ** rng.uniform(-320, 308, 200)), np.arange(-20, 20) / 4]
    powers = [s * 2.0**e * f for e in (-1074, -1073, -1023, -1022, -1021, -2, -1, 0, 1, 52, 53, 1022, 1023) for s in (1, -1) for f in (1, 1 + 2**-52)]
    edge = [0.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf]
    values = sorted({float(v) for v in [*some, *powers, *edge, *np.nextafter(some, 9e99)]})
    keys = {r["v"]: r["k"] for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", q.order_key(F.col("v")).alias("k")).collect()}
    found = [keys[v] for v in values]
    assert found == sorted(found) and len(set(found)) == len(values)


@pytest.mark.parametrize("max_broadcast", [10_000, 1])
def test_many_groups_of_all_sizes(spark, max_broadcast):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.normal(0, 1e-3, 3000).round(5), "ties": np.repeat([1.0, -2.0, 7.5], [700, 900, 1]), "one": np.array([3.25]), "wide": 10.0 ** rng.uniform(-30, 30, 500)}
    groups |= {f"g{i}": rng.exponential(5, rng.integers(1, 9)) for i in range(60)}
    rows = [(g, float(v)) for g, found in groups.items() for v in found] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    made = {r["g"]: r for r in q.exact_quantiles(df, "v", PROBS, ["g"], max_rows=50, max_broadcast=max_broadcast).collect()}
    assert set(made) == set(groups)
    for g, found in groups.items():
        assert [made[g][q.quantile_name(p)] for p in PROBS] == pytest.approx([np.quantile(found, p) for p in PROBS], rel=1e-12, abs=1e-300)


def test_nothing_is_broadcast(spark):
    df = spark.createDataFrame([(i % 50, float(i)) for i in range(3000)], "g int, v double")
    plan = q.radix_quantiles(df.select("g", F.col("v").alias("_v")), PROBS, ["g"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
