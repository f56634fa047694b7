"""End-to-end jobs: features from logs, a model from features, detections from both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from linewatch.operators import forest, register, scaling, temporal, traffic
from linewatch.operators.detections import as_detections
from linewatch.operators.record import record_features
from linewatch.schemas import CONTEXT_COLUMNS, PAIR_KEYS, ROLLUP_COLUMNS
from linewatch.session import working_path
from linewatch.sources import sinks

PROFILES = ("register", "record")


def pair_features(
    readings: DataFrame,
    window_seconds: float = 300,
    profile: str = "register",
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The full feature vector per device pair and window, tagged with its profile.

    ``register``: register windows, rolled up, with rolling context. ``record``: the online definition with history.
    """
    if profile == "register":
        windows = register.register_features(readings, window_seconds, extra=extra)
        features = temporal.rolling_context(register.pair_rollup(windows, extra=list(extra or {})))
    elif profile == "record":
        if extra:
            raise ValueError("extra features belong to the register profile")
        features = temporal.history_context(record_features(readings, window_seconds))
    else:
        raise ValueError(f"profile must be one of {PROFILES}")
    more = [f"{name}_mean" for name in (extra or {})]
    ordered = features.select(*PAIR_KEYS, *ROLLUP_COLUMNS, *CONTEXT_COLUMNS, *more)
    return forest.tag_profile(ordered, profile)


TRAFFIC_INPUT = ["ts", "src", "dst", "src_port", "tid", "unit", "func", "pdu_type", "uid", "seq"]


def extract_tables(
    readings: DataFrame,
    path: str,
    window_seconds: float = 60,
    codes: Sequence[str] | None = None,
    percentiles: Sequence[float] = (),
    fmt: str = "parquet",
) -> tuple[dict[str, str], DataFrame]:
    """The window and the connection table of one run, from one read of the logs, and the summary of the run.

    The logs are read and parsed once: the few columns both tables need are kept in the shared folder, and counted on their way.
    Returns the places of the tables by kind, and the summary as ``extraction_summary`` gives it for the window table.
    """
    spark = readings.sparkSession
    seen, made = Observation("records"), Observation("vectors")
    kept = working_path(spark, "readings")
    readings.observe(seen, F.count(F.lit(1)).alias("n")).select(*TRAFFIC_INPUT).write.parquet(kept)
    narrow = spark.read.schema(readings.select(*TRAFFIC_INPUT).schema).parquet(kept)
    windows = traffic.window_features(narrow, window_seconds, codes, percentiles)
    places = {
        "windows": sinks.write_features(windows.observe(made, F.count(F.lit(1)).alias("n")), path, "windows", fmt),
        "connections": sinks.write_features(traffic.connection_features(narrow), path, "connections", fmt),
    }
    numbers = (seen.get["n"], made.get["n"], len(windows.columns), int(window_seconds))
    schema = "total_records long, feature_vectors long, num_features long, time_window_seconds long"
    return places, spark.createDataFrame([numbers], schema)


def train(
    features: DataFrame, contamination: float = 0.01, trees: int = 100, seed: int = 42, profile: str | None = None
) -> tuple[forest.ForestModel, DataFrame]:
    """Fit on a stored feature table and score it. Returns the model, with its threshold, and the flagged rows."""
    cleaned, names = scaling.prepare(features)
    profile = profile or forest.profile_of(features) or "register"
    model = forest.fit_forest(cleaned, names, contamination, trees, seed, profile=profile)
    scored = forest.score(cleaned, model)
    limit = forest.contamination_threshold(scored, contamination)
    return replace(model, threshold=limit), forest.flag_fixed(scored, limit)


def detect(
    features: DataFrame,
    model: forest.ForestModel,
    threshold: float = forest.DEFAULT_THRESHOLD,
    detected_at: Column | None = None,
) -> DataFrame:
    """Detection records of the rows scored below a fixed threshold."""
    flagged = forest.flag_fixed(forest.score(features, model), threshold)
    return as_detections(flagged, detected_at if detected_at is not None else F.current_timestamp())


