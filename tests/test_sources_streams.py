from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewatch.operators import detections as det
from linewatch.operators import record, register, temporal
from linewatch.plans import catalog, jobs
from linewatch.schemas import DETECTION, PAIR_FEATURE_COLUMNS, PAIR_KEYS, ROLLUP_COLUMNS
from linewatch.sources import readings as src
from linewatch.sources import sinks
from linewatch.streaming import detect as live
from linewatch.streaming.features import stream_pair_features
from tests.helpers import same


def line(ts, a="10.0.0.1", b="10.0.0.2", address=1, values=(0, 1), **more):
    return json.dumps({"ts": ts, "id.orig_h": a, "id.resp_h": b, "address": address, "response_values": list(values), **more})


def test_json_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join([line(1.5), "{broken", line("2.5"), line("nonsense"), ""]))
    (tmp_path / "b.log").write_text(line(3.5, register_start=4, unexpected={"x": 1}))
    got = src.read_readings(spark, str(tmp_path / "*.log")).orderBy("ts").collect()
    assert [r["ts"] for r in got] == [1.5, 2.5, 3.5]
    assert (got[0]["src"], got[0]["dst"], got[0]["response_values"], got[2]["register_start"]) == (
        "10.0.0.1", "10.0.0.2", [0.0, 1.0], 4,
    )
    assert tuple(src.line_counts(spark, str(tmp_path / "*.log")).first()) == (5, 1, 1)


MIXED = [
    {"unit": "x"}, {"response_values": "1,2"}, {"address": 3.5}, {"response_values": [1, "z"]}, {"id.orig_p": 99999999999}, {"address": "7"},
    {"address": 4.0}, {"tid": [1]}, {"uid": 5}, {"func": {"a": 1}}, {"response_values": None}, {"seq": "s"}, {"response_values": "-"},
]


def test_fields_of_another_type_cost_the_field_only(spark, tmp_path):
    rows = [json.dumps({"ts": i, "id.orig_h": "a", "id.resp_h": "b", "address": 1, "response_values": [0, 9], **m}) for i, m in enumerate(MIXED)]
    (tmp_path / "m.log").write_text("\n".join([*rows, '{"ts": 99, "uid": "cut', "[1]", "7"]))
    got = src.read_readings(spark, str(tmp_path / "m.log"))
    found = {int(r["ts"]): r for r in got.collect()}
    assert len(found) == len(MIXED)
    assert [found[i]["response_values"] for i in (0, 1, 3, 10, 12)] == [[0.0, 9.0], [1.0, 2.0], [1.0, None], None, []]
    assert [found[i]["address"] for i in (2, 5, 6)] == [None, 7, 4]
    assert found[0]["unit"] is None and found[4]["src_port"] is None and found[8]["uid"] == "5" and found[7]["tid"] is None
    assert tuple(src.line_counts(spark, str(tmp_path / "m.log")).first()) == (len(MIXED) + 3, 3, 0)
    for c in got.columns:
        assert got.select(c).count() == len(got.select(c).collect()) == got.count() == len(MIXED)


def test_places_follow_file_name_and_position(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for name, start in (("b.log", 1000), ("a.log", 0), ("c.log", 2000)):
            (tmp_path / name).write_text("\n".join(line(5.0, values=(0, start + i)) for i in range(300 if name != "c.log" else 7)))
        got = src.read_readings(spark, str(tmp_path / "*.log")).orderBy("seq").collect()
        values = [r["response_values"][1] for r in got]
        assert values == sorted(values) and len(values) == 607
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quotes_in_tsv_are_plain(spark, tmp_path):
    fields = ["5.5", '"C1', "a", "1000", "b", "502", "tcp", 'T"x', "3", "READ", "REQ", "10", "2", "1,2"]
    (tmp_path / "q.log").write_text("\n".join(["\t".join(fields), "\t".join(["6.5", "C2", *fields[2:]])]))
    got = src.read_readings_tsv(spark, str(tmp_path / "q.log")).orderBy("ts").collect()
    assert [(r["uid"], r["src"], r["func"]) for r in got] == [('"C1', "a", "READ"), ("C2", "a", "READ")]


def test_tail_follows_growth_and_rotation(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()

    def read():
        got, _ = run(spark, src.tail_readings(spark, f"{folder}/*.log", range_bytes=150), tmp_path, "tail")
        return sorted((r["ts"], r["response_values"][1]) for r in got.collect())

    one, two = folder / "one.log", folder / "two.log"
    lines = [line(float(i), values=(0, i)) for i in range(40)]
    one.write_text("\n".join(lines[:10]) + "\n" + lines[10][:20])
    assert read() == [(float(i), float(i)) for i in range(10)]
    with one.open("a") as f:
        f.write(lines[10][20:] + "\n" + "\n".join(lines[11:20]) + "\n{broken\n")
    two.write_text("\n".join(lines[20:30]) + "\n")
    assert read() == [(float(i), float(i)) for i in range(30)]
    assert read() == [(float(i), float(i)) for i in range(30)]
    one.write_text("\n".join(lines[30:33]) + "\n")  # rotated
    assert read() == [(float(i), float(i)) for i in range(33)]


def test_tail_knows_rewritten_and_renamed_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    one, two = folder / "one.log", folder / "two.log"
    lines = [line(float(i), values=(0, i)) + "\n" for i in range(60)]
    expected = []

    def read(*new):
        expected.extend((float(i), float(i)) for i in new)
        got, _ = run(spark, src.tail_readings(spark, f"{folder}/*", range_bytes=150), tmp_path, "rotations")
        assert sorted((r["ts"], r["response_values"][1]) for r in got.collect()) == sorted(expected)

    one.write_text("".join(lines[:10]))
    read(*range(10))
    one.write_text("".join(lines[10:25]))  # rewritten and grown beyond its old size
    read(*range(10, 25))
    one.rename(folder / "one.log.1")  # renamed with lines not yet read, and a new file under its name
    with (folder / "one.log.1").open("a") as f:
        f.write("".join(lines[25:28]))
    one.write_text("".join(lines[28:48]))
    read(*range(25, 48))
    one.rename(folder / "one.log.2")
    read()
    (folder / "one.log.2").write_text(lines[48])  # shrunk
    two.write_text("")
    read(48)
    two.write_text("".join(lines[49:51]))
    read(49, 50)


def test_tail_batches_are_bounded(spark, tmp_path):
    from linewatch.sources.tail import LogTailReader, last_offset

    folder = tmp_path / "logs"
    folder.mkdir()
    texts = {"a": [f"a{i}" * 5 for i in range(40)], "b": ["long" * 200, "b1", "b2"], "c": ["c" * 30, "half"]}
    for name, found in texts.items():
        (folder / f"{name}.log").write_text("\n".join(found) + ("" if name == "c" else "\n"))

    def batches(reader, start):
        while (end := reader.latestOffset()) != start:
            parts = reader.partitions(start, end)
            yield sum(p.end - p.start for p in parts), [text for p in parts for text, _ in reader.read(p)]
            start = end

    with pytest.raises(ValueError, match="checkpoint"):
        LogTailReader({"path": str(folder), "maxBytes": "100"})
    reader = LogTailReader({"path": str(folder), "maxBytes": "100", "rangeBytes": "64", "checkpoint": str(tmp_path / "none")})
    taken = list(batches(reader, reader.initialOffset()))
    assert sorted(t for _, found in taken for t in found) == sorted([*texts["a"], *texts["b"], texts["c"][0]])
    assert [size for size, _ in taken if size > 100] == [801]  # the line that is longer than the bound

    mark = str(tmp_path / "ck")
    stream = src.tail_readings(spark, str(folder), max_bytes=200, checkpoint=mark)
    q = stream.writeStream.format("noop").option("checkpointLocation", mark).start()
    q.processAllAvailable()
    q.stop()
    assert len(q.recentProgress) > 3 and last_offset(mark)[str(folder / "b.log")]["end"] == 807
    again = LogTailReader({"path": str(folder), "maxBytes": "50", "checkpoint": mark})
    assert again.known == last_offset(mark) == again.latestOffset()


def test_tail_orders_equal_stamps_by_place(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(line(5.0, values=(0, i)) for i in range(50)) + "\n")
    got, _ = run(spark, src.tail_readings(spark, str(folder), range_bytes=300), tmp_path, "place")
    assert [r["response_values"][1] for r in got.orderBy("seq").collect()] == [float(i) for i in range(50)]


def test_equal_stamps_keep_arrival_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(line(5.0, values=(0, v)) for v in (1, 1, 2, 2, 1, 3)))
    found = register.register_features(src.read_readings(spark, str(tmp_path / "a.log")), 300).first()
    assert (found["value_changes"], found["unique_values"], found["inter_read_mean"]) == (3, 3, 0.0)


def test_worker_code_travels_by_value():
    from pyspark import cloudpickle

    assert "linewatch" in cloudpickle.list_registry_pickle_by_value()


def test_tsv_logs(spark, tmp_path):
    good = "\t".join(["5.5", "C1", "a", "1000", "b", "502", "tcp", "T", "3", "READ", "REQ", "10", "2", "1,2"])
    dash = "\t".join(["6.5", "C1", "a", "1000", "b", "502", "tcp", "T", "3", "READ", "REQ", "11", "2", "-"])
    (tmp_path / "old.log").write_text("\n".join(["#fields\tts\tuid", good, dash, good + "\textra\tfields", "bad\tstamp"]))
    got = src.read_readings_tsv(spark, str(tmp_path / "old.log")).orderBy("ts").collect()
    assert [(r["ts"], r["response_values"], r["register_start"], r["unit"]) for r in got] == [
        (5.5, [1.0, 2.0], 10, 3), (6.5, [], 11, 3),
    ]


def test_detection_files_merge_and_skip_broken(spark, tmp_path):
    path = str(tmp_path / "det")
    spark.createDataFrame([(1, "a", "b", -0.6)], "time_window long, src string, dst string, anomaly_score double").write.parquet(path)
    spark.createDataFrame(
        [(2, "a", "b", -0.7, 1.0)], "time_window long, src string, dst string, anomaly_score double, extra double"
    ).write.mode("append").parquet(path)
    (tmp_path / "det" / "part-broken.parquet").write_bytes(b"not a table")
    got = src.read_detections(spark, path)
    assert got.count() == 2 and "extra" in got.columns
    assert tuple(det.storage_stats(got).first()) == (2, 2)


def test_feature_files(spark, readings, tmp_path):
    features = jobs.pair_features(readings, 86_400)
    for fmt in ("parquet", "csv"):
        target = sinks.write_features(features, str(tmp_path / fmt), fmt=fmt)
        same(src.read_features(spark, target, fmt).select(features.columns), features, PAIR_KEYS)
    with pytest.raises(ValueError, match="kind"):
        sinks.write_features(features, str(tmp_path), kind="other")


def test_history_prunes_days(spark, tmp_path):
    rows = [(i, "a", "b", -0.6, f"2024-01-{i:02d} 10:00:00") for i in range(1, 11)]
    found = spark.createDataFrame(rows, "time_window long, src string, dst string, anomaly_score double, t string")
    sinks.write_detections(found.select(*PAIR_KEYS, "anomaly_score", F.col("t").cast("timestamp").alias("detected_at")), str(tmp_path / "d"))
    stored = src.read_detections(spark, str(tmp_path / "d"))
    got = det.history(stored, start="2024-01-04 00:00:00", end="2024-01-06 23:00:00")
    assert [r["time_window"] for r in got.collect()] == [6, 5, 4]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_written_summary(spark, tmp_path):
    rows = [(i, "a", "b", -0.4 - i / 10, int(i == 2)) for i in range(3)]
    scored = spark.createDataFrame(rows, "time_window long, src string, dst string, anomaly_score double, anomaly int")
    sinks.write_scored(scored, str(tmp_path / "s"))
    summary = spark.read.json(str(tmp_path / "s" / "summary")).first()
    assert (summary["total_samples"], summary["anomalies_detected"]) == (3, 1)
    assert [r[0] for r in spark.read.json(str(tmp_path / "s" / "windows")).collect()] == [2]


def test_landing_takes_closed_logs_only(spark, tmp_path):
    source = tmp_path / "logs"
    source.mkdir()
    (source / "reads-2024.log").write_text("\n".join([line(1704067200.0), line(1704153600.0)]))
    (source / "reads.log").write_text(line(1704067200.0))
    (source / "reads-2024.txt").write_text(line(1704067200.0))
    sinks.land_logs(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).awaitTermination()
    landed = sorted(str(p.parent.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("part-*"))
    assert landed == ["year=2024/month=01/day=01", "year=2024/month=01/day=02"]


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stream") / "logs"
    catalog.write_lines(catalog.raw_lines(spark, "/root/testdata/sf0.001"), str(folder))
    for age, file in enumerate(sorted(folder.glob("part-*"))):  # taken in by age: oldest stretch of time first
        os.utime(file, (1_700_000_000 + age, 1_700_000_000 + age))
    return str(folder)


def run(spark, stream, tmp_path, name):
    out = str(tmp_path / name)
    q = (
        stream.writeStream.format("parquet").option("checkpointLocation", out + "-ck").queryName(name)
        .trigger(availableNow=True).start(out)
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), q


@pytest.mark.parametrize("profile", ["register", "record"])
def test_stream_equals_batch(spark, readings, logs, tmp_path, profile):
    """Several batches, slices shorter than a window: the completed windows are those of the batch job."""
    live.use_rocksdb(spark)
    stream = src.stream_readings(spark, logs, max_files=1)
    pairs = stream_pair_features(stream, 86_400, "1 hour", profile=profile, slice_seconds=4_800)
    if profile == "record":
        got, _ = run(spark, live.stream_history(pairs), tmp_path, "s")
        want = temporal.history_context(record.record_features(readings, 86_400))
    else:
        got, _ = run(spark, pairs, tmp_path, "s")
        want = register.pair_rollup(register.register_features(readings, 86_400)).fillna(0)
    last = readings.agg(F.max("ts")).first()[0]
    closed = want.filter((F.col("time_window") + 1) * 86_400 <= last - 3_600)
    assert got.count() > 50
    same(got, closed.select(got.columns), PAIR_KEYS, 1e-8)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    live.use_rocksdb(spark)
    first = [line(float(t), seq=t) for t in range(0, 1000, 10)]
    (folder / "1.log").write_text("\n".join(first))
    stream = src.stream_readings(spark, str(folder), max_files=1)
    pairs = stream_pair_features(stream, 100, "10 seconds")
    listener = live.StatusListener(["late"])
    spark.streams.addListener(listener)
    try:
        run(spark, pairs, tmp_path, "late")
        (folder / "2.log").write_text("\n".join([line(5.0, seq=5000)] * 3 + [line(float(t), seq=t) for t in range(1000, 1300, 10)]))
        got, q = run(spark, pairs, tmp_path, "late")
        windows = {r["time_window"]: r["read_count_sum"] for r in got.collect()}
        assert windows[0] == 10.0 and set(windows) == set(range(12))
        dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        assert dropped > 0 and listener.status()["late_rows"] >= dropped
    finally:
        spark.streams.removeListener(listener)


@pytest.mark.parametrize("seconds", [7, 10, 100, 300])
def test_window_lengths(spark, tmp_path, seconds):
    """Slices divide the window exactly, whatever its length: stream and batch agree."""
    live.use_rocksdb(spark)
    folder = tmp_path / "logs"
    folder.mkdir()
    rng = np.random.default_rng(seconds)
    stamps = np.sort(rng.uniform(0, seconds * 12, 400)).round(3)
    (folder / "1.log").write_text("\n".join(line(float(t), seq=i, values=(0, int(v))) for i, (t, v) in enumerate(zip(stamps, rng.integers(0, 9, 400)))))
    got, _ = run(spark, stream_pair_features(src.stream_readings(spark, str(folder)), seconds, "1 second"), tmp_path, "w")
    want = register.pair_rollup(register.register_features(src.read_readings(spark, str(folder)), seconds)).fillna(0)
    closed = want.filter((F.col("time_window") + 1) * seconds <= float(stamps[-1]) - 1)
    assert got.count() > 8
    same(got, closed.select(got.columns), PAIR_KEYS, 1e-8)


def test_slices_must_divide_windows(spark, logs):
    with pytest.raises(ValueError, match="divide"):
        stream_pair_features(src.stream_readings(spark, logs), 100, slice_seconds=7)


def test_late_rows_are_counted_one_by_one(spark, tmp_path):
    live.use_rocksdb(spark)
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "1.log").write_text("\n".join(line(float(t)) for t in range(0, 1000, 10)))
    late = [line(5.0)] * 5 + [line(300.0), line(6.5)]
    for expected in (0, 7):
        stream = live.lateness(src.stream_readings(spark, str(folder)), 100, "10 seconds")
        got, q = run(spark, stream, tmp_path, "late-count")
        assert live.late_rows(q) == expected
        (folder / "2.log").write_text("\n".join([*late, line(1200.0)]))
    assert got.agg(F.sum("rows")).first()[0] == 101


def test_late_rows_outlive_the_recent_progress(spark, tmp_path):
    live.use_rocksdb(spark)
    folder = tmp_path / "logs"
    folder.mkdir()
    key = "spark.sql.streaming.numRecentProgressUpdates"
    old, counted = spark.conf.get(key), live.LateRows()
    spark.conf.set(key, "2")
    spark.streams.addListener(counted)
    try:
        # One batch per file: the late rows come in the fourth of seven batches.
        for number, rows in enumerate([[1000.0], [2000.0], [2100.0], [2200.0, 5.0, 5.0, 6.0], [2300.0], [2400.0], [2500.0]]):
            (folder / f"{number}.log").write_text("\n".join(line(t) for t in rows))
            os.utime(folder / f"{number}.log", (1e9 + number, 1e9 + number))
        stream = live.lateness(src.stream_readings(spark, str(folder), max_files=1), 100, "10 seconds")
        got, q = run(spark, stream, tmp_path, "late-long")
        assert sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]) < 3
        assert live.late_rows(q, counted) == 3
        with pytest.raises(ValueError, match="LateRows"):
            live.late_rows(q)
    finally:
        spark.streams.removeListener(counted)
        spark.conf.set(key, old)


def test_history_follows_the_profile(spark, readings, logs, tmp_path):
    from linewatch.operators.forest import ProfileMismatch

    live.use_rocksdb(spark)
    pairs = stream_pair_features(src.stream_readings(spark, logs), 86_400, "1 hour")
    with pytest.raises(ProfileMismatch):
        live.stream_history(pairs, profile="record")
    with pytest.raises(ProfileMismatch):
        live.stream_history(pairs.select(*[F.col(c).alias(c, metadata={}) for c in pairs.columns]))
    got, _ = run(spark, live.stream_history(pairs), tmp_path, "h")
    want = temporal.rolling_context(register.pair_rollup(register.register_features(readings, 86_400)).fillna(0))
    last = readings.agg(F.max("ts")).first()[0]
    same(got, want.filter((F.col("time_window") + 1) * 86_400 <= last - 3_600).select(got.columns), PAIR_KEYS, 1e-8)


def test_detection_stream_with_status(spark, readings, logs, tmp_path):
    live.use_rocksdb(spark)
    features = jobs.pair_features(readings, 86_400, "record")
    model, _ = jobs.train(features, contamination=0.2, trees=10)
    listener = live.StatusListener()
    spark.streams.addListener(listener)
    try:
        stream = live.count_records(src.stream_readings(spark, logs))
        pairs = live.stream_history(stream_pair_features(stream, 86_400, "1 hour", profile="record"))
        found = live.detect_stream(pairs, model, model.threshold)
        out = str(tmp_path / "det")
        sinks.sink_detections(found.select(*DETECTION.names), out, out + "-ck", availableNow=True).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stored = src.read_detections(spark, out)
        last = readings.agg(F.max("ts")).first()[0]
        batch = jobs.detect(features, model, model.threshold).filter((F.col("time_window") + 1) * 86_400 <= last - 3_600)
        same(stored.select(*PAIR_KEYS, "anomaly_score"), batch.select(*PAIR_KEYS, "anomaly_score"), PAIR_KEYS, 1e-8)
        status = listener.status()
        assert status["anomalies_detected"] == stored.count() > 0
        assert status["current_window"] == stored.agg(F.max("time_window")).first()[0] or status["current_window"] > 0
        assert status["records_processed"] > 0 and status["last_check"]
    finally:
        spark.streams.removeListener(listener)


def test_stream_from_timestamp(spark, logs, tmp_path):
    got, _ = run(spark, src.stream_readings(spark, logs, from_ts=1_705_000_000.0), tmp_path, "from")
    assert got.count() and got.agg(F.min("ts")).first()[0] >= 1_705_000_000.0


def test_feature_names():
    assert len(ROLLUP_COLUMNS) == 19 and len(PAIR_FEATURE_COLUMNS) == 28 and np.unique(PAIR_FEATURE_COLUMNS).size == 28


def test_growing_logs_are_written_line_by_line(tmp_path):
    """The lines of a file used to be collected before their share was cut."""
    from linewatch.plans.catalog import append_share

    held, most = [0], [0]

    class Text(str):
        def __init__(self, _):
            held[0] += 1
            most[0] = max(most[0], held[0])

        def __del__(self):
            held[0] -= 1

    texts = {0: [f"lïne {i}" for i in range(500)], 3: ["x" * 70, "y"]}
    sizes = {f: len(("\n".join(t) + "\n").encode()) for f, t in texts.items()}
    for share in ((0.0, 0.3), (0.3, 0.5), (0.5, 1.0)):
        append_share(({"_file": f, "value": Text(v)} for f, t in texts.items() for v in t), str(tmp_path), share, sizes)
        for f, t in texts.items():
            whole = ("\n".join(t) + "\n").encode()
            assert (tmp_path / f"log-{f}").read_bytes() == whole[: int(len(whole) * share[1])]
    assert most[0] <= 4
