"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def stream_latency(spark, folder: str, files: int = 10) -> dict[str, float]:
    """Milliseconds from the start of a batch to its stored detections, one log file a batch: readings to scored windows."""
    from linewatch.plans import catalog
    from linewatch.session import working_path
    from linewatch.sources import readings as src
    from linewatch.streaming import detect as live
    from linewatch.streaming.features import stream_pair_features

    live.use_rocksdb(spark)
    path = working_path(spark, "latency-logs")
    lines = catalog.raw_lines(spark, folder)
    lines.repartitionByRange(files, "ts", "seq").sortWithinPartitions("ts", "seq").select("value").write.text(path)
    model = catalog.fixed_model(catalog.records(spark, folder, catalog.HOUR), "record")
    stream = stream_pair_features(src.stream_readings(spark, path, max_files=1), catalog.HOUR, "1 hour", profile="record")
    found = live.detect_stream(stream, model, catalog.THRESHOLD)
    query = (
        found.writeStream.format("parquet").option("checkpointLocation", working_path(spark, "latency-checkpoint"))
        .trigger(availableNow=True).start(working_path(spark, "latency-out"))
    )
    query.awaitTermination()
    took = sorted(p["durationMs"]["triggerExecution"] for p in query.recentProgress if p["numInputRows"])
    return {
        "batches": len(took),
        "mean": round(sum(took) / len(took), 1),
        "p95": float(took[min(len(took) - 1, int(0.95 * len(took)))]),
    }


def main() -> None:
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from linewatch.operators import forest, register, scaling, traffic
    from linewatch.plans import catalog, jobs
    from linewatch.schemas import PAIR_FEATURE_COLUMNS
    from linewatch.session import local_session
    from linewatch.sources import adapters

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")

    def run(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    readings = catalog.readings(spark, folder)
    lines = adapters.readings_from_lineitem(adapters.table(spark, folder, "lineitem"))
    queries = {
        "pair_features": lambda: run(jobs.pair_features(readings, catalog.DAY)),
        "register_features": lambda: run(register.register_features(readings, catalog.DAY)),
        "record_features": lambda: run(jobs.pair_features(readings, catalog.DAY, "record")),
        "pair_features_lineitem": lambda: run(jobs.pair_features(lines, 30 * catalog.DAY)),
        "window_features": lambda: run(
            traffic.window_features(readings, catalog.DAY, catalog.EVENT_TYPES, traffic.IAT_PERCENTILES)
        ),
        "connection_features": lambda: run(traffic.connection_features(readings)),
    }

    # Models work on a stored feature table, as the training job does.
    hourly = jobs.pair_features(readings, catalog.HOUR, "record").cache()
    rows = hourly.count()
    models: dict[str, forest.ForestModel] = {}

    def fit() -> None:
        models["forest"] = forest.fit_forest(hourly, PAIR_FEATURE_COLUMNS)

    queries |= {
        "scale_features": lambda: run(scaling.standardise_table(hourly)),
        "fit_forest": fit,
        "score_forest": lambda: run(forest.score(hourly, models["forest"])),
    }
    catalog_names = [
        "C12_score_distribution", "C9_feature_differences", "E2_incident_quality", "E5_confusion_by_type",
        "E7_latency_statistics", "M8_dbscan", "O4_detection_history", "S1_read_json_logs", "T1_stream_pair_windows",
    ]
    for name in catalog_names:
        queries[name] = lambda name=name: run(catalog.all_queries()[name](spark, folder))

    # Workers are started and code is compiled on the smallest tables first.
    small = str(Path(folder).parent / "sf0.001")
    if os.path.isdir(small):
        for name in catalog_names:
            run(catalog.all_queries()[name](spark, small))
    run(readings.groupBy("src").agg(F.count("*")))
    seconds: dict[str, float] = {}
    for name, call in queries.items():
        start = time.perf_counter()
        call()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    latency = stream_latency(spark, folder)
    report = {
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name,
        "stream_batch_ms": latency,
        "input_records": {"events": readings.count(), "lineitem": lines.count(), "scored_rows": rows},
    }
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    with contextlib.redirect_stderr(open(os.devnull, "w")) if os.environ.get("BENCH_QUIET") else contextlib.nullcontext():
        main()
