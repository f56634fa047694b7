"""Keyed history, scoring and status of a detection stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from linewatch.functions import exprs as X
from linewatch.functions.exprs import CLAMP
from linewatch.operators.detections import as_detections
from linewatch.operators.forest import (
    DEFAULT_THRESHOLD, ForestModel, ProfileMismatch, flag_fixed, profile_of, score, tag_profile,
)
from linewatch.schemas import CONTEXT_COLUMNS, CONTEXT_SOURCES, PAIR_KEYS, ROLLUP_COLUMNS
from linewatch.streaming.features import slice_length

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed list state needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class PairHistory(StatefulProcessor):
    """Keeps the last windows of one device pair and adds baseline and deviation to each new one, as its profile defines them."""

    def __init__(self, profile: str = "record", size: int = 10, min_windows: int = 3, keep: int = 20) -> None:
        self.profile, self.size, self.min_windows, self.keep = profile, size, min_windows, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField(c, T.DoubleType()) for c in CONTEXT_SOURCES])
        self.windows = handle.getListState("windows", schema)

    def _record(self, past: np.ndarray, value: float) -> list[float]:
        """Mean and deviation of the windows before; the deviation is absolute."""
        if len(past) < self.min_windows:
            return [value, 0.0, 0.0]
        recent = past[-self.size :]
        return [float(recent.mean()), float(recent.std()), value - float(recent.mean())]

    def _register(self, past: np.ndarray, value: float) -> list[float]:
        """Mean and sample deviation with the window itself; the deviation is relative to the windows before."""
        upto = np.append(past[-(self.size - 1) :] if self.size > 1 else past[:0], value)
        spread = float(upto.std(ddof=1)) if len(upto) > 1 else 0.0
        if not len(past):
            return [float(upto.mean()), spread, 0.0]
        baseline = float(past[-self.size :].mean())
        relative = float(np.sign(value - baseline)) * CLAMP if baseline + 1 == 0 else (value - baseline) / (baseline + 1)
        return [float(upto.mean()), spread, relative]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One batch may complete several windows of a pair.
        new = pd.concat(list(rows), ignore_index=True).sort_values("time_window", ignore_index=True)
        past = [tuple(float(v) for v in w) for w in self.windows.get()]
        context = self._record if self.profile == "record" else self._register
        added = []
        for current in new[CONTEXT_SOURCES].itertuples(index=False):
            current = tuple(float(v) for v in current)
            seen = np.array(past, dtype=float).reshape(-1, len(CONTEXT_SOURCES))
            added.append([x for i, value in enumerate(current) for x in context(seen[:, i], value)])
            past = [*past, current][-self.keep :]
        self.windows.put(past)
        out = pd.concat([new, pd.DataFrame(added, columns=CONTEXT_COLUMNS)], axis=1)
        yield out[[*PAIR_KEYS, *ROLLUP_COLUMNS, *CONTEXT_COLUMNS]]

    def close(self) -> None:
        pass


PROFILE_HISTORY = {"record": 10, "register": 5}  # windows of a baseline


def stream_history(
    pairs: DataFrame, size: int | None = None, min_windows: int = 3, keep: int = 20, profile: str | None = None
) -> DataFrame:
    """Streaming form of ``history_context`` (record profile) or ``rolling_context`` (register profile).

    The features say which profile they follow; features that do not need ``profile``, and one that contradicts them is refused.
    """
    found = profile_of(pairs)
    if found and profile and found != profile:
        raise ProfileMismatch(f"features follow the {found} profile, not {profile}")
    profile = found or profile
    if profile not in PROFILE_HISTORY:
        raise ProfileMismatch(f"a history needs features of the record or register profile, not {profile}")
    size = size or PROFILE_HISTORY[profile]
    out = T.StructType(
        [
            T.StructField("time_window", T.LongType()),
            T.StructField("src", T.StringType()),
            T.StructField("dst", T.StringType()),
            *[T.StructField(c, T.DoubleType()) for c in [*ROLLUP_COLUMNS, *CONTEXT_COLUMNS]],
        ]
    )
    tracked = (
        pairs.groupBy("src", "dst")
        .transformWithStateInPandas(
            statefulProcessor=PairHistory(profile, size, min_windows, max(keep, size)),
            outputStructType=out,
            outputMode="Append",
            timeMode="None",
        )
    )
    return tag_profile(tracked, profile)


class _Passing(StatefulProcessor):
    """Counts the rows that come through; keeps nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"rows": [sum(len(r) for r in rows)]})

    def close(self) -> None:
        pass


LATE_SLOTS = 64


def lateness(readings: DataFrame, window_seconds: float, watermark: str, slice_seconds: float | None = None) -> DataFrame:
    """A stream that takes in readings as the feature windows do and counts them one by one; see ``late_rows``.

    A reading is late when the slice it belongs to was closed by the watermark. Nothing is aggregated before that is decided,
    so the engine's own count of dropped rows is the number of readings.
    """
    length = f"{round(slice_length(window_seconds, slice_seconds) * 1_000_000)} microseconds"
    stamped = readings.withColumn("_at", X.to_timestamp(F.col("ts"))).withWatermark("_at", watermark)
    placed = stamped.select(
        F.window_time(F.window("_at", length)).alias("_closes"), F.pmod(F.xxhash64("src", "dst", "ts"), F.lit(LATE_SLOTS)).alias("_slot")
    )
    return placed.groupBy("_slot").transformWithStateInPandas(
        statefulProcessor=_Passing(), outputStructType="rows long", outputMode="Append", timeMode="EventTime"
    )


class LateRows(StreamingQueryListener):
    """Late readings of each run of a query, added up as its progress comes in.

    A query itself remembers its last hundred batches only. Add this to the session before the query starts.
    """

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.counts[run] = self.counts.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(query, counted: LateRows | None = None) -> int:
    """Readings that a started ``lateness`` query has dropped as late, over all its batches if ``counted`` watched them.

    Without it only the query's own progress is there. If that no longer reaches back to the first batch of the run, an error
    says so; no smaller count is returned.
    """
    if counted is not None:
        query._jsq.sparkSession().sparkContext().listenerBus().waitUntilEmpty()
        return counted.counts.get(str(query.runId), 0)
    seen = query.recentProgress
    limit = int(query._jsq.sparkSession().conf().get("spark.sql.streaming.numRecentProgressUpdates", "100"))
    if len(seen) >= limit - 1:  # the engine drops the oldest when the limit is reached
        raise ValueError("the query may have forgotten its first batches: count late rows with LateRows")
    return sum(op["numRowsDroppedByWatermark"] for p in seen for op in p["stateOperators"])


def detect_stream(features: DataFrame, model: ForestModel, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Score each completed window and keep the flagged ones, stamped with the processing time."""
    watched = features.observe(
        "windows", F.count(F.lit(1)).alias("windows"), F.max("time_window").alias("current_window")
    )
    flagged = flag_fixed(score(watched, model), threshold)
    found = as_detections(flagged, F.current_timestamp())
    return found.observe("detections", F.count(F.lit(1)).alias("anomalies"))


def count_records(readings: DataFrame) -> DataFrame:
    """Let the status see how many readings a stream takes in."""
    return readings.observe("records", F.count(F.lit(1)).alias("records"))


class StatusListener(StreamingQueryListener):
    """Running counters of the queries of a session.

    ``late_rows`` is what stateful steps report: exact for a ``lateness`` query, and for feature streams the number of partial
    aggregates dropped, each of which may stand for several readings.
    """

    def __init__(self, names: Sequence[str] = ()) -> None:
        self.names = set(names)
        self.running: set[str] = set()
        self.started_at: str | None = None
        self.records_processed = 0
        self.anomalies_detected = 0
        self.late_rows = 0
        self.current_window: int | None = None
        self.last_check: str | None = None

    def onQueryStarted(self, event) -> None:
        if not self.names or event.name in self.names:
            self.running.add(str(event.id))
            self.started_at = self.started_at or event.timestamp

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.names and p.name not in self.names:
            return
        self.last_check = p.timestamp
        seen = p.observedMetrics
        if "records" in seen:
            self.records_processed += seen["records"]["records"] or 0
        if "detections" in seen:
            self.anomalies_detected += seen["detections"]["anomalies"] or 0
        if "windows" in seen and seen["windows"]["current_window"] is not None:
            self.current_window = max(self.current_window or 0, seen["windows"]["current_window"])
        self.late_rows += sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        self.last_check = event.timestamp

    def onQueryTerminated(self, event) -> None:
        self.running.discard(str(event.id))

    def status(self) -> dict:
        return {
            "running": bool(self.running),
            "started_at": self.started_at,
            "records_processed": self.records_processed,
            "anomalies_detected": self.anomalies_detected,
            "late_rows": self.late_rows,
            "last_check": self.last_check,
            "current_window": self.current_window,
        }
