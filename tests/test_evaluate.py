from __future__ import annotations

from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest

from linewatch.operators import detections as det
from linewatch.operators import evaluate as ev
from linewatch.operators import incidents as inc
from linewatch.schemas import INCIDENT

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
W = 300


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def base_window() -> int:
    return int(T0.timestamp()) // W


@pytest.fixture(scope="module")
def incidents(spark):
    rows = [
        ("i1", "flood", "p1", "d1", "completed", at(310), at(900)),  # ends exactly at a window border
        ("i2", "scan", "p2", "d2", "completed", at(600), at(610)),
        ("i3", "scan", "p1", "d1", "completed", at(850), at(1300)),  # overlaps i1
        ("i4", "scan", "p1", "d1", "running", at(100), None),
    ]
    return spark.createDataFrame(rows, INCIDENT)


@pytest.fixture(scope="module")
def detections(spark):
    spots = [(1, "s1", "d1"), (1, "s2", "d1"), (2, "s1", "d1"), (3, "s1", "d1"), (4, "s1", "d1"), (2, "s1", "d3"), (0, "s1", "d2")]
    rows = [(base_window() + w, s, d, -0.5 - i / 100, at((w + 1) * W + i)) for i, (w, s, d) in enumerate(spots)]
    return spark.createDataFrame(rows, "time_window long, src string, dst string, anomaly_score double, detected_at timestamp")


def brute_matches(detections, incidents):
    d, i = detections.toPandas(), incidents.toPandas()
    i = i[i["completed_at"].notna()]
    both = d.merge(i, left_on="dst", right_on="target_ip")
    start = pd.to_datetime(both["time_window"] * W, unit="s")
    return both[(start < both["completed_at"]) & (start + pd.Timedelta(seconds=W) > both["started_at"])]


def test_matches_equal_theta_join(spark, detections, incidents):
    got = ev.match_incidents(detections, incidents, W).toPandas()
    want = brute_matches(detections, incidents)
    keys = ["attack_id", "time_window", "src", "dst"]
    assert sorted(map(tuple, got[keys].to_numpy())) == sorted(map(tuple, want[keys].to_numpy()))
    assert len(got)


def test_windows_of_incidents(spark, incidents):
    got = ev.incident_windows(incidents, W).toPandas().groupby("attack_id")["time_window"].agg(["min", "max"])
    b = base_window()
    assert got.loc["i1"].tolist() == [b + 1, b + 2]  # 310 to 900: window 3 starts at the end and is not touched
    assert got.loc["i2"].tolist() == [b + 2, b + 2]
    assert "i4" not in got.index


def test_quality_scores_and_latency(spark, detections, incidents):
    quality = ev.incident_quality(detections, incidents, W, baseline_seconds=300).toPandas().set_index("attack_id")
    matches = brute_matches(detections, incidents)
    for attack, row in quality.iterrows():
        m = matches[matches["attack_id"] == attack]
        assert row["true_positives"] == len(m)
        # Two sources of one window count once: the rate is a share of windows.
        assert row["detection_rate"] == m["time_window"].nunique() / row["attack_windows"] <= 1
    scores = ev.incident_scores(detections, incidents, W).toPandas().set_index("attack_id")["mean_anomaly_score"]
    want = matches.groupby("attack_id")["anomaly_score"].mean()
    assert scores["i1"] == pytest.approx(want["i1"]) and np.isnan(scores["i2"])
    latency = ev.detection_latency(detections, incidents, W).toPandas().set_index("attack_id")["latency_seconds"]
    first = matches.groupby("attack_id")["detected_at"].min()
    assert latency["i1"] == (first["i1"] - pd.Timestamp(at(310)).tz_localize(None)).total_seconds()
    stats = ev.latency_stats(ev.detection_latency(detections, incidents, W)).first()
    assert stats["median_latency"] == pytest.approx(np.median(latency))


def test_counts_before_and_after(spark, detections, incidents):
    got = ev.before_after(detections, incidents, 400, 700, bucket_seconds=120).toPandas().set_index("attack_id")
    d, i = detections.toPandas(), incidents.toPandas()
    for _, a in i.iterrows():
        own = d[d["dst"] == a["target_ip"]]["detected_at"]
        start = a["started_at"]
        before = ((own >= start - pd.Timedelta(seconds=400)) & (own < start)).sum()
        total = ((own >= start - pd.Timedelta(seconds=400)) & (own < start + pd.Timedelta(seconds=700))).sum()
        row = got.loc[a["attack_id"]]
        assert (row["baseline_detections"], row["total_detections"], row["new_detections"]) == (before, total, total - before)
        assert row["detected"] == int(total > before)


def test_confusion_adds_up(spark, incidents):
    b = base_window()
    rows = [(b + w, s, d, (w + i) % 2) for i, d in enumerate(["d1", "d2", "d3"]) for w in range(6) for s in ("s1", "s2")]
    scored = spark.createDataFrame(rows, "time_window long, src string, dst string, anomaly int")
    got = ev.rates(ev.confusion_by_type(scored, incidents, W)).toPandas().set_index("attack_type")
    assert (got[["tp", "fp", "fn", "tn"]].sum(axis=1) == len(rows)).all()
    touched = ev.incident_windows(incidents, W).toPandas()
    frame = scored.toPandas()
    for kind in ["flood", "scan", "all"]:
        marked = touched if kind == "all" else touched[touched["attack_type"] == kind]
        spots = set(zip(marked["dst"], marked["time_window"], strict=True))
        hit = np.array([(d, w) in spots for d, w in zip(frame["dst"], frame["time_window"], strict=True)])
        flagged = frame["anomaly"].to_numpy() == 1
        assert got.loc[kind, "tp"] == (hit & flagged).sum() and got.loc[kind, "fp"] == (~hit & flagged).sum()
        assert got.loc[kind, "recall"] == got.loc[kind, "tpr"]


def test_labelled_evaluation(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (None, 1)], "t int, p int")
    got = ev.evaluate(df, "t", "p").toPandas()
    assert got["n"].sum() == 3 and got["accuracy"].tolist() == pytest.approx([2 / 3] * 3)
    assert ev.evaluate(df.filter("t is null"), "t", "p").count() == 0


def test_incident_log(spark, incidents):
    rows = inc.incident_log(incidents).collect()
    assert [r["attack_id"] for r in rows] == ["i3", "i2", "i1", "i4"]
    assert [r["duration"] for r in rows] == [450.0, 10.0, 590.0, None]
    assert [r["attack_id"] for r in inc.incident_log(incidents, status="running").collect()] == ["i4"]


def test_history_and_recent(spark, detections):
    newest = det.recent(detections, 2).collect()
    assert [r["time_window"] - base_window() for r in newest] == [4, 3]
    with pytest.raises(ValueError, match="limit"):
        det.recent(detections, 101)
    found = det.history(detections, start=at(900), end=at(1300), src="s1", dst="d1", min_score=-0.53).collect()
    assert [r["time_window"] - base_window() for r in found] == [3, 2]


def test_statistics(spark, detections):
    stats = det.score_stats(detections).first()
    scores = detections.toPandas()["anomaly_score"]
    assert stats["median_score"] == pytest.approx(scores.median()) and stats["std_score"] == pytest.approx(scores.std())
    bins = det.score_histogram(detections, 4).toPandas().set_index("bin")["detections"]
    want = np.histogram(scores, bins=4)[0]
    assert [bins.get(i, 0) for i in range(4)] == list(want)
    constant = det.score_histogram(detections.withColumn("anomaly_score", detections["anomaly_score"] * 0), 4).collect()
    assert [(r["bin"], r["detections"]) for r in constant] == [(0, 7)]
    by_source = {r["src"]: r["detections"] for r in det.counts_by(detections, "src").collect()}
    assert by_source == {"s1": 6, "s2": 1}
    assert ev.timeline(detections).agg({"detections": "sum"}).first()[0] == 7


def test_dyadic_cover(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(a + n)) for a, n in zip(rng.integers(-40, 60, 300), rng.integers(0, 70, 300))] + [(5, 5), (0, 63), (-64, 63)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")
    found = {}
    for r in ev.dyadic_cover(df, "a", "b").collect():
        found.setdefault(r["i"], []).append((r["_level"], r["_node"]))
    for i, (a, b) in enumerate(pairs):
        numbers = [n for level, node in found[i] for n in range(node << level, (node + 1) << level)]
        assert sorted(numbers) == list(range(a, b + 1))
        assert len(found[i]) <= max(1, 2 * (b - a + 1).bit_length())
    held = ev.in_spans(df.select("a"), "a", [0, 3]).collect()
    assert all(r["_node"] == r["a"] >> r["_level"] for r in held) and len(held) == 2 * len(pairs)


def test_incident_of_a_year(spark):
    """Six million windows of five seconds, and short incidents beside it."""
    year = 366 * 86_400
    rows = [
        ("long", "flood", "p1", "d1", "completed", at(2), at(year)),
        ("short", "scan", "p1", "d1", "completed", at(1000), at(1012)),
        ("inside", "flood", "p1", "d1", "completed", at(5000), at(9000)),
    ]
    incidents = spark.createDataFrame(rows, INCIDENT)
    spans = ev.dyadic_cover(ev.incident_spans(incidents, 5), "first_window", "last_window")
    assert spans.filter("attack_id = 'long'").count() <= 2 * 23
    base = int(T0.timestamp()) // 5
    spots = [(0, "d1"), (199, "d1"), (200, "d1"), (1500, "d1"), (year // 5 - 1, "d1"), (year // 5, "d1"), (7, "d2")]
    found = [(base + w, s, d, -0.5, at((w + 1) * 5)) for w, d in spots for s in ("s1", "s2")]
    detections = spark.createDataFrame(found, "time_window long, src string, dst string, anomaly_score double, detected_at timestamp")
    hits = {r["attack_id"]: r for r in ev.incident_hits(detections, incidents, 5).collect()}
    assert [hits["long"][c] for c in ("attack_windows", "detected_windows", "true_positives")] == [year // 5, 5, 10]
    assert [hits["short"][c] for c in ("attack_windows", "detected_windows", "true_positives")] == [3, 1, 2]
    assert ev.match_incidents(detections, incidents, 5).groupBy("attack_id").count().collect() != []
    scored = detections.selectExpr("*", "case when src = 's1' then 1 else 0 end as anomaly")
    table = {r["attack_type"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in ev.confusion_by_type(scored, incidents, 5).collect()}
    assert table == {"flood": (5, 2, 5, 2), "scan": (1, 6, 1, 6), "all": (5, 2, 5, 2)}
