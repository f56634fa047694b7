"""Pair features on a stream: one result per completed window, by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from linewatch.streaming.windows import SPREAD, stream_windows, windows_of


def slice_length(window_seconds: float, slice_seconds: float | None) -> float:
    """A slice of whole microseconds that divides the window: about a sixtieth of it unless given."""
    window = round(window_seconds * 1_000_000)
    if slice_seconds is None:
        return window / next(k for k in range(60, 0, -1) if window % k == 0) / 1_000_000
    if window % max(1, round(slice_seconds * 1_000_000)):
        raise ValueError(f"slices of {slice_seconds} s do not divide windows of {window_seconds} s")
    return slice_seconds


def stream_pair_features(
    readings: DataFrame,
    window_seconds: float = 300,
    watermark: str = "60 seconds",
    profile: str = "register",
    slice_seconds: float | None = None,
) -> DataFrame:
    """The 19 roll-up columns per completed window and device pair, as a stream in append mode.

    Readings whose window the watermark has passed are dropped by the engine and counted in its progress reports;
    ``windows.stream_windows`` keeps them as rows. A pair's window is held in slices of ``slice_seconds``, by default a quarter of it.
    State needs RocksDB (``detect.use_rocksdb``).
    """
    spread = SPREAD if slice_seconds is None else round(window_seconds / slice_length(window_seconds, slice_seconds))
    return windows_of(stream_windows(readings, window_seconds, watermark, profile, spread, keep_late=False), profile)
