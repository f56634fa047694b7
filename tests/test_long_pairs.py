"""Pairs with very many windows, cut into chunks; newest detections from the newest days."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewatch.operators import detections as det
from linewatch.operators import temporal
from linewatch.schemas import CONTEXT_SOURCES, PAIR_KEYS
from linewatch.sources import sinks

from .helpers import same


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(int(t), "long", "d") for t in rng.choice(9000, 700, replace=False)]
    rows += [(int(t), "next", "d") for t in rng.choice(900, 150, replace=False)]
    rows += [(t, f"s{i}", "d") for i in range(20) for t in range(i % 7 + 1)]
    rows = [(*r, *map(float, rng.normal(5, 3, 3)), "own") for r in rows]
    columns = ", ".join(f"{c} double" for c in CONTEXT_SOURCES)
    return spark.createDataFrame(rows, f"time_window long, src string, dst string, {columns}, _note string").repartition(5)


@pytest.mark.parametrize("context,size", [(temporal.rolling_context, 5), (temporal.history_context, 10)])
@pytest.mark.parametrize("max_rows", [4, 40, 10_000])
def test_chunks_equal_plain_windows(pairs, context, size, max_rows):
    want = context(pairs.drop("_note"), size=size)
    same(context(pairs.drop("_note"), size=size, max_group_rows=max_rows).select(want.columns), want, PAIR_KEYS, 1e-9)


def test_a_long_pair_is_in_many_chunks(pairs):
    laid = temporal.in_chunks(pairs, 5, 40)
    own = laid.filter("not _halo and src = 'long'").groupBy("_chunk").count().collect()
    assert len(own) > 10 and sum(r["count"] for r in own) == 700
    halos = laid.filter("_halo and src = 'long'").groupBy("_chunk").count().collect()
    assert max(r["count"] for r in halos) == 5 and len(halos) == len(own) - 1


def test_newest_days_are_enough(spark, tmp_path):
    path = str(tmp_path / "stored")
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, "a", "b", -0.6, start + dt.timedelta(hours=7 * i)) for i in range(300)] + [(900 + i, "a", "b", -0.7, None) for i in range(3)]
    found = spark.createDataFrame(rows, "time_window long, src string, dst string, anomaly_score double, detected_at timestamp")
    sinks.write_detections(found, path)
    for limit in (1, 20, 100):
        got = det.recent_stored(spark, path, limit)
        assert [r["time_window"] for r in got.collect()] == [r["time_window"] for r in det.recent(found, limit).collect()]
        days = set(got.inputFiles())
        assert len({f.split("date=")[1].split("/")[0] for f in days}) <= max(1, 2 * limit // 3 + 2)
    few = str(tmp_path / "few")
    sinks.write_detections(found.filter("time_window in (3, 5, 901)"), few)
    assert [r["time_window"] for r in det.recent_stored(spark, few).collect()] == [5, 3, 901]
    with pytest.raises(ValueError, match="limit"):
        det.recent_stored(spark, path, 101)
