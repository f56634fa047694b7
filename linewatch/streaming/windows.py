"""Windows of device pairs on a stream in one stateful step, with the late readings as rows of their own.

Readings are keyed by device pair and stretch of the window (``spread`` stretches), so a busy pair is held in many groups. A group keeps
its readings as packed arrays, appended batch by batch, and a timer per open window. When the watermark passes the end of a window the
group reduces its stretch to a *part*: counts, ends, changes, gap moments, sums, and counts per distinct value. All parts of a window
come in one batch, as all timers of a window have one time; a second, stateless step merges them in order of time and works out the
columns. A reading whose window the watermark has passed belongs to no window any more: it is late. Late readings are either dropped
and counted by the engine, or returned as rows next to the windows, by the same step and query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from linewatch.functions import exprs as X
from linewatch.operators import record, register
from linewatch.operators.forest import tag_profile
from linewatch.schemas import PAIR_KEYS, ROLLUP_COLUMNS

SPREAD = 4
WINDOW, LATE = "window", "late"
# What a reading leaves in the state, by profile. The third is what its own group is called: a register, or nothing.
KEPT = {
    "register": ["ts", "seq", "address", "value"],
    "record": ["ts", "seq", "address", "value", "std", "range", "distinct", "entropy"],
}
MEASURES = ["std", "range", "distinct", "entropy"]
_LISTS = {
    "groups": "long", "n": "long", "first_ts": "double", "last_ts": "double", "first_value": "double", "last_value": "double",
    "gap_m2": "double", "changes": "long", "sizes": "long", "values": "double", "counts": "long", "sums": "double", "tops": "double",
    "lows": "double", "registers": "long",
}
_PART = "kind string, time_window long, src string, dst string, stretch int, " + ", ".join(f"{c} array<{t}>" for c, t in _LISTS.items())
_LATE = "ts double, seq long, address long, value double"
_NO_SEQ = np.iinfo(np.int64).min
HELD_BYTES = 4 << 20  # readings gathered before they go to the state
YIELD_VALUES = 1 << 16  # numbers of the parts that are returned at once


def _runs(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def part_of(rows: dict[str, np.ndarray], profile: str) -> dict[str, list]:
    """Reduce the readings of one stretch. Absent numbers are NaN; in the record profile all readings are one group."""
    group = rows["address"].astype(np.int64) if profile == "register" else np.zeros(len(rows["ts"]), np.int64)
    order = np.lexsort((rows["seq"], rows["ts"], group))
    group, ts, value = group[order], rows["ts"][order], rows["value"][order]
    begins = _runs(group)
    ends = np.r_[begins[1:], len(group)]
    n = ends - begins
    gaps = np.diff(ts, prepend=ts[0])
    gaps[begins] = 0.0
    mean = np.divide(ts[ends - 1] - ts[begins], n - 1, out=np.zeros(len(n)), where=n > 1)
    off = gaps - np.repeat(mean, n)
    off[begins] = 0.0
    changed = np.r_[False, value[1:] != value[:-1]]
    changed[begins] = False
    filled = ~np.isnan(value)
    by_value = np.lexsort((value[filled], group[filled]))
    g, v = group[filled][by_value], value[filled][by_value]
    new = np.flatnonzero(np.r_[True, (np.diff(g) != 0) | (np.diff(v) != 0)]) if len(g) else np.zeros(0, np.int64)
    part = {
        "groups": group[begins], "n": n, "first_ts": ts[begins], "last_ts": ts[ends - 1], "first_value": value[begins],
        "last_value": value[ends - 1], "gap_m2": np.add.reduceat(off * off, begins), "changes": np.add.reduceat(changed, begins, dtype=np.int64),
        "sizes": np.array([np.count_nonzero(g[new] == x) for x in group[begins]], np.int64),
        "values": v[new], "counts": np.diff(np.r_[new, len(g)]), "sums": [], "tops": [], "lows": [], "registers": [],
    }
    if profile == "record":
        found = [rows[m][~np.isnan(rows[m])] for m in MEASURES]
        part["sums"] = np.array([x.sum() for x in found])
        part["tops"], part["lows"] = (np.array([f(x) if len(x) else np.nan for x in found]) for f in (np.max, np.min))
        known = rows["address"][~np.isnan(rows["address"])]
        part["registers"] = np.unique(known.astype(np.int64))
    return {k: np.asarray(x).tolist() for k, x in part.items()}


class Group:
    """One register, or one pair in the record profile, over the parts of a window in order of time."""

    def __init__(self) -> None:
        self.n = self.changes = 0
        self.spans: list[tuple[int, float, float, float]] = []  # gaps of a part, their sum, their squares about the mean, and the seam before
        self.first_ts = self.last_ts = self.last_value = None
        self.values: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, n, first_ts, last_ts, first_value, last_value, gap_m2, changes, values, counts) -> None:
        seam = None if self.last_ts is None else first_ts - self.last_ts
        if self.last_ts is None:
            self.first_ts = first_ts
        elif self.last_value != first_value:
            self.changes += 1
        self.spans.append((n - 1, last_ts - first_ts, gap_m2, seam))
        self.n, self.changes, self.last_ts, self.last_value = self.n + n, self.changes + changes, last_ts, last_value
        self.values.append(values)
        self.counts.append(counts)

    def gap_moments(self) -> tuple[float, float]:
        """Mean of the gaps and sum of their squared deviations."""
        if self.n < 2:
            return 0.0, 0.0
        mean, m2 = (self.last_ts - self.first_ts) / (self.n - 1), 0.0
        for k, total, squares, seam in self.spans:
            m2 += squares + (k * (total / k - mean) ** 2 if k else 0.0) + (0.0 if seam is None else (seam - mean) ** 2)
        return mean, m2

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        values, counts = np.concatenate(self.values), np.concatenate(self.counts)
        found, index = np.unique(values, return_inverse=True)
        return found, np.bincount(index, counts, len(found))


def groups_of(parts: list[dict]) -> dict[int, Group]:
    groups: dict[int, Group] = {}
    for part in sorted(parts, key=lambda p: p["stretch"]):
        begin = 0
        for i, g in enumerate(part["groups"]):
            end = begin + part["sizes"][i]
            values, counts = (np.asarray(part[c][begin:end], float) for c in ("values", "counts"))
            own = [part[c][i] for c in ("n", "first_ts", "last_ts", "first_value", "last_value", "gap_m2", "changes")]
            groups.setdefault(g, Group()).add(*own, values, counts)
            begin = end
    return groups


def _mean(values: np.ndarray, counts: np.ndarray) -> float:
    """The mean, taken from the first value on: exact where all values are equal, so that their deviation is zero."""
    return float(values[0] + (values - values[0]) @ counts / counts.sum())


def register_row(parts: list[dict], window_seconds: float, min_count: int = 3) -> list[float] | None:
    """The roll-up columns of the register profile; None if no register has enough readings."""
    rows = []
    for g in groups_of(parts).values():
        if g.n < min_count:
            continue
        v, c = g.distinct()
        mean = _mean(v, c)
        std = float(np.sqrt(c @ (v - mean) ** 2 / g.n))
        low, high = float(v[0]), float(v[-1])
        far, top = 0.0, 0.0
        if g.n > register.Z_MIN_COUNT:
            far = float(c[np.abs(v - mean) / (std + register.EPSILON) > register.Z_LIMIT].sum())
            top = max(high - mean, mean - low) / (std + register.EPSILON)
        if high == low:
            bins = np.array([float(g.n)])
        else:
            place = np.minimum(np.floor((v - low) * float(register.BINS) / (high - low)).astype(int), register.BINS - 1)
            bins = np.bincount(place, c, register.BINS)
        share = bins / g.n
        gap, m2 = g.gap_moments()
        rows.append(
            (
                mean, std, high - low, g.changes, g.changes / g.n, g.n, g.n / window_seconds, gap, np.sqrt(m2 / (g.n - 1)), far, top,
                len(v), -float(share @ np.log(share + 1e-10)),
            )
        )
    if not rows:
        return None
    mean, std, width, changes, rate, n, read_rate, gap, gap_std, far, top, distinct, entropy = np.array(rows, float).T
    return [
        mean.mean(), mean.std(ddof=1) if len(mean) > 1 else 0.0, mean.min(), mean.max(), std.mean(), std.max(), width.mean(), width.max(),
        changes.sum(), rate.mean(), n.sum(), read_rate.mean(), gap.mean(), gap_std.mean(), far.sum(), top.max(), distinct.mean(),
        entropy.mean(), float(len(rows)),
    ]


def record_row(parts: list[dict]) -> list[float]:
    """The roll-up columns of the record profile."""
    (g,) = groups_of(parts).values()
    v, c = g.distinct()
    lists = float(c.sum())
    mean = _mean(v, c) if lists else 0.0
    std = float(np.sqrt(c @ (v - mean) ** 2 / (lists - 1))) if lists > 1 else 0.0
    low, high = (float(v[0]), float(v[-1])) if lists else (0.0, 0.0)
    sums = np.sum([p["sums"] for p in parts], axis=0)
    tops, lows = (np.array([p[k] for p in parts], float) for k in ("tops", "lows"))
    tops = np.where(np.isnan(tops).all(0), 0.0, np.where(np.isnan(tops), -np.inf, tops).max(0))
    averages = sums / lists if lists else np.zeros(len(sums))
    averages[3] = max(min(averages[3], tops[3]), np.where(np.isnan(lows[:, 3]), np.inf, lows[:, 3]).min()) if lists else 0.0
    gap, m2 = g.gap_moments()
    span = g.last_ts - g.first_ts
    judged = g.n > 2 and lists > 1 and std > 0
    far = float(c[np.abs(v - mean) / std > record.Z_LIMIT].sum()) if judged else 0.0
    return [
        mean, std, low, high, averages[0], tops[0], averages[1], tops[1], sums[2], averages[2], float(g.n), g.n / span if span > 0 else 0.0,
        gap, float(np.sqrt(m2 / (g.n - 2))) if g.n > 2 else 0.0, far, max(high - mean, mean - low) / std if judged else 0.0, averages[2],
        averages[3], float(len(set().union(*[p["registers"] for p in parts]))),
    ]


class Stretches(StatefulProcessor):
    """Holds the readings of one device pair and stretch until their window is complete."""

    def __init__(self, profile: str, window_seconds: float) -> None:
        self.profile, self.window_seconds, self.kept = profile, window_seconds, KEPT[profile]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "time_window long, data binary")

    def _end_ms(self, window: int) -> int:
        return int(np.ceil((window + 1) * self.window_seconds * 1000 - 1e-6))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        new: dict[int, list[bytes]] = {}
        first, size = None, 0
        for batch in rows:
            batch["seq"] = batch["seq"].fillna(_NO_SEQ) if batch["seq"].isna().any() else batch["seq"]
            for window, mine in batch.groupby("time_window", sort=False):
                if self._end_ms(int(window)) <= passed:
                    yield self._late(key, int(window), mine)
                else:
                    data = np.column_stack([mine[c].to_numpy(np.float64) for c in self.kept if c != "seq"])
                    packed = len(mine).to_bytes(8, "little") + mine["seq"].to_numpy(np.int64).tobytes() + data.tobytes()
                    new.setdefault(int(window), []).append(packed)
                    first, size = min(int(window), int(window) if first is None else first), size + len(packed)
            if size > HELD_BYTES:
                self.held.appendList([(w, b"".join(found)) for w, found in new.items()])
                new, size = {}, 0
        if new:
            self.held.appendList([(w, b"".join(found)) for w, found in new.items()])
        if first is not None:
            self.handle.registerTimer(self._end_ms(first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All windows that end before the watermark at once; the earliest of the others gets the next timer.

        Every group goes by the watermark, whichever timer called it, so the parts of a window come in one batch.
        """
        passed = timerValues.getCurrentWatermarkInMs()
        done: dict[int, list[bytes]] = {}
        rest = []
        for window, data in self.held.get():
            if self._end_ms(window) < passed:
                done.setdefault(window, []).append(bytes(data))
            else:
                rest.append((window, bytes(data)))
        if rest:
            self.handle.registerTimer(self._end_ms(min(w for w, _ in rest)))
        if not done:
            return
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        src, dst, stretch = key
        names = {"kind": WINDOW, "src": src, "dst": dst, "stretch": stretch}
        parts, size = [], 0
        for window in list(done):  # packed bytes are few; a part lists its numbers, so only some parts are made at a time
            parts.append({**names, "time_window": window, **part_of(self._unpacked(b"".join(done.pop(window))), self.profile)})
            size += sum(len(parts[-1][c]) for c in _LISTS)
            if size > YIELD_VALUES:
                yield self._frame(parts)
                parts, size = [], 0
        if parts:
            yield self._frame(parts)

    def _unpacked(self, data: bytes) -> dict[str, np.ndarray]:
        """The pieces that batches have appended, each a count, the sequence numbers, and the other columns row by row."""
        names = [c for c in self.kept if c != "seq"]
        columns, seqs, at = [], [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            seqs.append(np.frombuffer(data, np.int64, n, at + 8))
            columns.append(np.frombuffer(data, np.float64, n * len(names), at + 8 + 8 * n).reshape(n, len(names)))
            at += 8 + 8 * n + 8 * n * len(names)
        whole = np.concatenate(columns)
        return {"seq": np.concatenate(seqs), **{c: whole[:, i] for i, c in enumerate(names)}}

    def _late(self, key, window: int, rows: pd.DataFrame) -> pd.DataFrame:
        src, dst, stretch = key
        seq = rows["seq"].astype("Int64").where(rows["seq"] != _NO_SEQ)
        found = {"kind": LATE, "time_window": window, "src": src, "dst": dst, "stretch": stretch, "ts": rows["ts"], "seq": seq,
                 "address": rows["address"].astype("Int64"), "value": rows["value"]}
        return self._frame(pd.DataFrame(found).to_dict("records"))

    @staticmethod
    def _frame(rows: list[dict]) -> pd.DataFrame:
        columns = ["kind", "time_window", "src", "dst", "stretch", *_LISTS, "ts", "seq", "address", "value"]
        frame = pd.DataFrame(rows).reindex(columns=columns)
        for c in columns[5:]:
            frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
        return frame

    def close(self) -> None:
        pass


def stream_windows(
    readings: DataFrame,
    window_seconds: float = 300,
    watermark: str = "60 seconds",
    profile: str = "register",
    spread: int = SPREAD,
    keep_late: bool = True,
    min_count: int = 3,
) -> DataFrame:
    """Completed windows and late readings of a stream: ``kind`` (window or late), the pair keys, and the columns of either kind.

    ``spread`` is the number of stretches, and groups, a window is cut into. Without ``keep_late`` the engine drops late readings
    and reports how many. State needs RocksDB (``use_rocksdb``).
    """
    if profile == "register":
        rows = register.register_values(readings, window_seconds)
        kept = rows.select("time_window", "src", "dst", "ts", "seq", "address", "value")
    elif profile == "record":
        rows = record.record_values(readings, window_seconds)
        kept = rows.select(
            "time_window", "src", "dst", "ts", "seq", F.col("register").alias("address"), F.col("mean").alias("value"),
            *[F.col(m).cast("double").alias(m) for m in MEASURES],
        )
    else:
        raise ValueError("profile must be register or record")
    place = F.floor((F.col("ts") / F.lit(float(window_seconds)) - F.col("time_window")) * spread)
    stamped = kept.withColumn("_at", X.to_timestamp(F.col("ts"))).withWatermark("_at", watermark)
    spread_out = stamped.withColumn("stretch", F.least(F.greatest(place, F.lit(0)), F.lit(spread - 1)).cast("int"))
    if not keep_late:
        length = f"{int(round(window_seconds * 1_000_000))} microseconds"
        spread_out = spread_out.withColumn("_closes", F.window_time(F.window("_at", length)))
    parts = spread_out.drop("_at").groupBy("src", "dst", "stretch").transformWithStateInPandas(
        statefulProcessor=Stretches(profile, float(window_seconds)), outputStructType=f"{_PART}, {_LATE}", outputMode="Append", timeMode="EventTime"
    )
    columns = ["kind", *PAIR_KEYS, *ROLLUP_COLUMNS, "ts", "seq", "address", "value"]

    def merged(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        late = found[found["kind"] == LATE].reindex(columns=columns)
        listed = found[found["kind"] == WINDOW].to_dict("records")
        rows = []
        if listed:
            row = register_row(listed, float(window_seconds), min_count) if profile == "register" else record_row(listed)
            if row:
                rows.append([WINDOW, *key, *row, None, None, None, None])
        whole = pd.DataFrame(rows, columns=columns)
        return pd.concat([whole.astype(object), late.astype(object)]) if len(late) else whole

    numbers = ", ".join(f"{c} double" for c in ROLLUP_COLUMNS)
    schema = f"kind string, time_window long, src string, dst string, {numbers}, {_LATE}"
    # A group is one window of a pair, not all windows a batch completes.
    return parts.groupBy("time_window", "src", "dst").applyInPandas(merged, schema)


def windows_of(found: DataFrame, profile: str) -> DataFrame:
    """The completed windows, marked with their profile."""
    return tag_profile(found.filter(F.col("kind") == WINDOW).select(*PAIR_KEYS, *ROLLUP_COLUMNS), profile)


def late_of(found: DataFrame) -> DataFrame:
    """The late readings: what their window missed."""
    return found.filter(F.col("kind") == LATE).select(*PAIR_KEYS, "ts", "seq", "address", "value")


def sink_windows(found: DataFrame, path: str, late_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """One query that stores windows and late readings in two tables.

    Each batch overwrites its own folder, so a batch that is run again after a failure replaces what it had written.
    """

    def store(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        windows = held.filter(F.col("kind") == WINDOW).select(*PAIR_KEYS, *ROLLUP_COLUMNS)
        windows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        late_of(held).write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        held.unpersist()

    trigger = trigger or {"availableNow": True}
    return found.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()
