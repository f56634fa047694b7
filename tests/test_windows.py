"""Windows and late readings of one stateful step."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewatch.operators import record, register
from linewatch.schemas import PAIR_KEYS
from linewatch.sources import readings as src
from linewatch.streaming import detect as live
from linewatch.streaming import windows as win

from .helpers import same


def line(ts, source="a", address=10, values=(1, 2), seq=0):
    fields = {"ts": ts, "uid": "u", "id.orig_h": source, "id.resp_h": "b", "func": "READ", "address": address, "response_values": list(values), "seq": seq}
    return json.dumps(fields)


def write(folder, name, rows):
    (folder / name).write_text("\n".join(line(*r) for r in rows) + "\n")


def run(spark, folder, tmp_path, seconds, delay, profile, spread=3):
    stream = win.stream_windows(src.stream_readings(spark, str(folder), max_files=1), seconds, delay, profile, spread)
    paths = [str(tmp_path / f"{profile}-{n}") for n in ("windows", "late", "mark")]
    q = win.sink_windows(stream, *paths)
    q.awaitTermination()
    return spark.read.parquet(paths[0]).drop("batch"), spark.read.parquet(paths[1]).drop("batch")


@pytest.mark.parametrize("profile", ["register", "record"])
def test_busy_pair_and_batch_agree(spark, tmp_path, profile):
    """One pair holds nine tenths of the rows; several batches; values with ties; stretches without readings."""
    live.use_rocksdb(spark)
    folder = tmp_path / "logs"
    folder.mkdir()
    rng = np.random.default_rng(3)
    stamps = np.sort(rng.uniform(0, 1000, 900)).round(2)
    rows = []
    for i, t in enumerate(stamps):
        quiet = rng.random() < 0.1
        values = tuple(rng.integers(0, 6, rng.integers(0, 4)).tolist())
        rows.append((float(t), "quiet" if quiet else "busy", int(rng.integers(0, 3)), values, i))
    rows += [(500.0, "lone", 1, (5, 5), 10_000), (float(stamps[-1]), "busy", 1, (1, 1), 10_001)]
    for k in range(3):
        write(folder, f"{k}.log", [r for r in rows if 400 * k <= r[0] < 400 * (k + 1)])
        import os

        os.utime(folder / f"{k}.log", (1e9 + k, 1e9 + k))
    got, late = run(spark, folder, tmp_path, 100, "5 seconds", profile)
    whole = src.read_readings(spark, str(folder))
    if profile == "register":
        want = register.pair_rollup(register.register_features(whole, 100)).fillna(0)
    else:
        want = record.record_features(whole, 100)
    closed = want.filter((F.col("time_window") + 1) * 100 <= float(stamps[-1]) - 5)
    assert got.count() > 15 and late.count() == 0
    same(got, closed.select(got.columns), PAIR_KEYS, 1e-8)


def test_late_readings_are_rows(spark, tmp_path):
    live.use_rocksdb(spark)
    folder = tmp_path / "logs"
    folder.mkdir()
    write(folder, "1.log", [(float(t), "a", 10, (1, t), t) for t in range(0, 1000, 10)])
    got, late = run(spark, folder, tmp_path, 100, "10 seconds", "register")
    assert late.count() == 0
    # 5.0 and 120.0 are late; 975.0 lies before the watermark, but its window is open.
    write(folder, "2.log", [(5.0, "a", 10, (1, 7), 5000)] * 3 + [(120.0, "z", 11, (1, 8), 5001), (975.0, "a", 10, (1, 9), 5002), (1200.0, "a", 10, (1, 1), 6000)])
    got, late = run(spark, folder, tmp_path, 100, "10 seconds", "register")
    found = sorted(tuple(r) for r in late.select("time_window", "src", "ts", "seq", "address", "value").collect())
    assert found == [(0, "a", 5.0, 5000, 10, 7.0)] * 3 + [(1, "z", 120.0, 5001, 11, 8.0)]
    assert {r["time_window"]: r["read_count_sum"] for r in got.collect()} == {w: 11.0 if w == 9 else 10.0 for w in range(10)}


def test_engine_drops_late_readings_if_asked(spark, tmp_path):
    live.use_rocksdb(spark)
    folder = tmp_path / "logs"
    folder.mkdir()
    for extra in ([], [(5.0, "a", 10, (1, 7), 5000)] * 3 + [(975.0, "a", 10, (1, 9), 5002), (1200.0, "a", 10, (1, 1), 6000)]):
        write(folder, f"{len(extra)}.log", extra or [(float(t), "a", 10, (1, t), t) for t in range(0, 1000, 10)])
        stream = win.stream_windows(src.stream_readings(spark, str(folder)), 100, "10 seconds", keep_late=False)
        out = str(tmp_path / "out")
        q = win.windows_of(stream, "register").writeStream.format("parquet").option("checkpointLocation", out + "-ck").trigger(availableNow=True).start(out)
        q.awaitTermination()
    assert sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]) == 3
    assert {r["time_window"]: r["read_count_sum"] for r in spark.read.parquet(out).collect()} == {w: 11.0 if w == 9 else 10.0 for w in range(10)}


class Held:
    """A list state that remembers how it was filled."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, []

    def appendList(self, rows):
        self.rows += rows
        self.calls += 1

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.append(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_group_hands_over_some_windows_at_a_time(monkeypatch):
    """All windows of a pair's stretch, as lists of numbers, used to be one frame; all its readings went to the state at once."""
    import pandas as pd

    monkeypatch.setattr(win, "YIELD_VALUES", 300)
    monkeypatch.setattr(win, "HELD_BYTES", 4000)
    step = win.Stretches("register", 10.0)
    step.held = step.handle = Held()

    def batch(b):
        ts = np.arange(200) + 0.25 + 0.01 * b
        rows = {"time_window": (ts // 10).astype(int), "src": "a", "dst": "b", "ts": ts, "seq": np.arange(200) + 200 * b}
        return pd.DataFrame(rows | {"address": 1, "value": ts * 3 + b})

    assert list(step.handleInputRows(("a", "b", 0), iter([batch(b) for b in range(5)]), Mark(0))) == []
    assert step.held.calls > 1 and step.held.timers == [10_000]
    frames = list(step.handleExpiredTimer(("a", "b", 0), Mark(195_000), None))
    assert len(frames) > 3 and max(len(f) for f in frames) < 5
    made = pd.concat(frames)
    assert sorted(made["time_window"]) == list(range(19)) and sum(x[0] for x in made["n"]) == 19 * 50
    assert {w for w, _ in step.held.rows} == {19} and step.held.timers[-1] == 200_000


def test_parts_are_merged_window_by_window(spark, tmp_path):
    """All windows a batch completed for a pair used to be merged in one group."""
    live.use_rocksdb(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    found = win.stream_windows(src.stream_readings(spark, str(folder)), 10, "5 seconds", "register", 3)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandas [time_window" in plan
