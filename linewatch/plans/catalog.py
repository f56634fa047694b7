"""Every operator as a named query over the driver tables. ``linewatch.plans.oracles`` states the same in SQL.

Results are made comparable across engines: doubles rounded, stamps as epoch seconds, integers as 64 bit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewatch.functions import exprs as X
from linewatch.functions.skew import neighbour_rows
from linewatch.operators import (
    cluster, detections as det, evaluate as ev, explain as ex, forest, incidents as inc, pivots, record, register, scaling,
    temporal, traffic,
)
from linewatch.plans import jobs
from linewatch.schemas import (
    CONTEXT_COLUMNS, DETECTION, ORDER, PAIR_FEATURE_COLUMNS, PAIR_KEYS, REGISTER_KEYS, ROLLUP_COLUMNS,
)
from linewatch.session import working_path
from linewatch.sources import adapters, readings as src, sinks
from linewatch.sources.tail import file_store
from linewatch.streaming import detect as live, windows as win
from linewatch.streaming.features import stream_pair_features

DAY = 86_400
QUARTER = 21_600
HOUR = 3_600
CODES = ["f0", "f1", "f2", "f3"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
THRESHOLD = -0.687
CONTAMINATION = 0.1
MODEL_COLUMNS = ["value_mean_mean", "read_count_sum", "inter_read_mean_mean"]
# A small forest stated by hand: (feature number, split, low side, high side), or the path length of a leaf.
TREES = [
    (0, 0.9, (1, -0.6, 5.0, (2, 0.1, 7.5, 8.25)), (1, 0.4, 3.0, 4.5)),
    (1, 1.1, (2, 1.2, (0, -1.0, 4.0, 8.0), 3.5), 2.25),
    (2, -0.3, (0, 0.2, 6.0, 5.5), (1, -1.3, 2.0, (0, 1.4, 7.0, 2.5))),
]
SAMPLE_SIZE = 256
DETECTION_DELAY = 5.0
HISTORY_COLUMNS = ["value_mean_mean_deviation", "read_count_sum_rolling_mean", "value_change_rate_mean_rolling_std"]
HISTORY_THRESHOLD = -0.687
VECTOR_COLUMNS = ["e0", "e1", "e2", "e3"]
WHOLE_VECTOR = [f"e{i}" for i in range(64)]
WHOLE_EPS = 9.4
# Near the median distance to the fifth nearest vector, where core, border and noise points all occur.
PIVOT_EPS = 9.15
PAIR_EPS = 3.5

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[name] = lambda spark, folder: portable(fn(spark, folder))
        return fn

    return add


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(x: Column) -> Column:
    """Six digits; the offset keeps exact ties away from the rounding border."""
    return F.floor(x * 1e6 + 0.501) / 1e6


def portable(df: DataFrame) -> DataFrame:
    def column(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c)
        elif isinstance(f.dataType, T.TimestampType):
            c = rounded(X.epoch_seconds(c))
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        return c.alias(f.name)

    return df.select(*[column(f) for f in df.schema.fields])


# -- inputs ----------------------------------------------------------------------------------------------------------


def readings(spark: SparkSession, folder: str, several_codes: bool = False) -> DataFrame:
    return adapters.readings_from_events(adapters.table(spark, folder, "events"), several_codes)


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.incidents_from_events(adapters.table(spark, folder, "events"))


def registers(spark: SparkSession, folder: str, window: int = DAY) -> DataFrame:
    return register.register_features(readings(spark, folder), window)


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.pair_features(readings(spark, folder), DAY)


def records(spark: SparkSession, folder: str, window: int = DAY) -> DataFrame:
    return record.record_features(readings(spark, folder), window)


def fixed_model(features: DataFrame, profile: str = "register", trees=TREES, columns=MODEL_COLUMNS) -> forest.ForestModel:
    """The hand-written forest with a scaler fitted on the features."""
    rows: list[list] = []

    def add(tree: int, spec) -> int:
        me = sum(r[0] == tree for r in rows)
        rows.append([tree, me, -1, 0.0, -1, -1, 0.0])
        here = rows[-1]
        if isinstance(spec, tuple):
            here[2], here[3] = spec[0], spec[1]
            here[4] = add(tree, spec[2])
            here[5] = add(tree, spec[3])
        else:
            here[6] = spec
        return me

    for number, spec in enumerate(trees):
        add(number, spec)
    nodes = pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "path"])
    return forest.ForestModel(
        profile=profile,
        scaler=scaling.fit_scaler(features, columns),
        nodes=nodes,
        sample_size=SAMPLE_SIZE,
        trees=len(trees),
    )


def wide_trees() -> list:
    """One tree of depth two per four features: splits and leaf paths follow from the feature's number."""
    return [
        (i, 0.1 * (i % 7) - 0.3, (i + 1, 0.05 * i - 0.6, 4.0 + i % 3, 6.5), (i + 2, 0.2, (i + 3, -0.1, 7.25, 8.5), 5.5 + i % 2))
        for i in range(0, len(PAIR_FEATURE_COLUMNS), 4)
    ]


def wide_model(features: DataFrame) -> forest.ForestModel:
    return fixed_model(features, trees=wide_trees(), columns=PAIR_FEATURE_COLUMNS)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Features and scored rows are tables between the jobs: computed once, read by whatever follows."""
    path = working_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    features = stored(pairs(spark, folder), "features")
    return stored(forest.flag_fixed(forest.score(features, fixed_model(features)), THRESHOLD), "scored")


def scored_hourly(spark: SparkSession, folder: str) -> DataFrame:
    features = stored(records(spark, folder, HOUR), "features")
    return stored(forest.flag_fixed(forest.score(features, fixed_model(features, "record")), THRESHOLD), "scored")


def _detected(flagged: DataFrame, window: int) -> DataFrame:
    at = (F.col("time_window") + 1) * float(window) + DETECTION_DELAY + F.col("read_count_sum")
    return det.as_detections(flagged, X.to_timestamp(at))


def detections(spark: SparkSession, folder: str) -> DataFrame:
    return _detected(scored(spark, folder), DAY)


def detections_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return _detected(scored_hourly(spark, folder), HOUR)


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Readings as log lines (one JSON text each), with the day as a column."""
    r = readings(spark, folder)
    record_ = F.struct(
        "ts", "uid", F.col("src").alias("id.orig_h"), F.col("src_port").alias("id.orig_p"),
        F.col("dst").alias("id.resp_h"), "tid", "unit", "func", "pdu_type", "address", "response_values", "seq",
    )
    return r.select(F.to_json(record_).alias("value"), "seq", "ts", X.window_id(F.col("ts"), DAY).alias("day"))


def write_lines(lines: DataFrame, path: str) -> str:
    """Text lines as log files, each file one stretch of time."""
    lines.repartitionByRange(4, "ts", "seq").sortWithinPartitions("ts", "seq").select("value").write.text(path)
    return path


# -- sources and sinks -----------------------------------------------------------------------------------------------

_READING_SHOWN = ["ts", "uid", "src", "src_port", "dst", "tid", "unit", "func", "pdu_type", "address", "seq"]


def _shown(r: DataFrame) -> DataFrame:
    return r.select(
        *_READING_SHOWN,
        X.element_or_zero(F.col("response_values"), 0).alias("value_0"),
        X.element_or_zero(F.col("response_values"), 1).alias("value_1"),
    )


@query("S1_read_json_logs")
def _(spark, folder):
    path = write_lines(raw_lines(spark, folder), working_path(spark, "logs"))
    return _shown(src.read_readings(spark, f"{path}/part-*"))


def _damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth line cut short, and every tenth with an unusable stamp."""
    lines = raw_lines(spark, folder)
    broken = F.expr("substring(value, 1, length(value) - 5)")
    unstamped = F.regexp_replace("value", r'^\{"ts":[^,]*,', '{"ts":"none",')
    tenth = F.col("seq") % 10
    return lines.withColumn("value", F.when(tenth == 0, broken).when(tenth == 1, unstamped).otherwise(F.col("value")))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Well-formed lines, four fifths of them with a field of another type."""
    lines, kind = raw_lines(spark, folder), F.col("seq") % 5
    value = F.col("value")
    return lines.withColumn(
        "value",
        F.when(kind == 0, F.regexp_replace(value, r'"unit":[0-9]+', '"unit":"x"'))
        .when(kind == 1, F.regexp_replace(value, r'"response_values":\[[^\]]*\]', '"response_values":"3,4"'))
        .when(kind == 2, F.regexp_replace(value, r'"address":[0-9]+', '"address":3.5'))
        .when(kind == 3, F.regexp_replace(value, r'"response_values":\[[^\]]*\]', '"response_values":[1,"z"]'))
        .otherwise(value),
    )


@query("S1_mixed_types")
def _(spark, folder):
    """A field of another type costs that field, not the line."""
    path = write_lines(_mixed(spark, folder), working_path(spark, "mixed"))
    return _shown(src.read_readings(spark, path))


@query("S2_mixed_line_counts")
def _(spark, folder):
    """Mismatched fields are not malformed lines."""
    damaged = _damaged(spark, folder).filter("seq % 10 < 2").unionByName(_mixed(spark, folder).filter("seq % 10 >= 2"))
    return src.line_counts(spark, write_lines(damaged, working_path(spark, "damaged")))


@query("S2_skip_malformed_lines")
def _(spark, folder):
    path = write_lines(_damaged(spark, folder), working_path(spark, "damaged"))
    return _shown(src.read_readings(spark, path))


@query("S2_line_counts")
def _(spark, folder):
    path = write_lines(_damaged(spark, folder), working_path(spark, "damaged"))
    return src.line_counts(spark, path)


def _tsv(spark: SparkSession, folder: str, uid: Column) -> DataFrame:
    r = readings(spark, folder)
    values = F.when(F.col("seq") % 10 == 0, "-").otherwise(
        F.concat_ws(",", F.col("src_port").cast("string"), (F.col("seq") % 5).cast("string"))
    )
    text = F.concat_ws(
        "\t", F.format_string("%.6f", "ts"), uid, "src", F.col("src_port").cast("string"), "dst", F.lit("502"),
        F.lit("tcp"), F.lit("t"), F.col("unit").cast("string"), "func", "pdu_type", F.col("address").cast("string"),
        F.lit("1"), values,
    )
    line = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("#"), text)).otherwise(text)
    path = write_lines(r.select(line.alias("value"), "ts", "seq"), working_path(spark, "tsv"))
    got = src.read_readings_tsv(spark, path)
    return got.select(
        "ts", "uid", "src", "src_port", "dst", "dst_port", "unit", "func", "pdu_type", "register_start",
        F.size("response_values").alias("n_values"),
        X.element_or_zero(F.col("response_values"), 1).alias("value_1"),
    )


@query("S3_read_tsv_logs")
def _(spark, folder):
    return _tsv(spark, folder, F.col("uid"))


@query("S3_quotes")
def _(spark, folder):
    """A quote is a character like any other."""
    return _tsv(spark, folder, F.when(F.col("seq") % 3 == 0, F.concat(F.lit('"'), "uid")).otherwise(F.col("uid")))


def _drain(query_) -> None:
    query_.awaitTermination()


def _streamed(spark: SparkSession, stream: DataFrame, name: str, place: tuple[str, str] | None = None) -> DataFrame:
    """Run a stream over all files present and read what it stored, so far if ``place`` (output, checkpoint) was used before."""
    out, mark = place or (working_path(spark, name), working_path(spark, f"{name}-checkpoint"))
    started = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", mark)
        .trigger(availableNow=True).start(out)
    )
    _drain(started)
    return spark.read.schema(stream.schema).parquet(out)


@query("S4_follow_log_files")
def _(spark, folder):
    """Finished logs, each read once."""
    path = write_lines(raw_lines(spark, folder), working_path(spark, "growing"))
    return _shown(_streamed(spark, src.stream_readings(spark, path), "followed"))


def append_share(rows, path: str, share: tuple[float, float], sizes: dict[int, int]) -> None:
    """Append a share of the bytes of each file's lines, line by line: no more is held than a write buffer."""
    store, inner = file_store(path)
    for number, mine in groupby(rows, key=lambda r: r["_file"]):
        begin, end = (int(sizes[number] * s) for s in share)
        at = 0
        with store.open_append_stream(f"{inner}/log-{number}", buffer_size=1 << 20) as file:
            for r in mine:
                data = f"{r['value']}\n".encode()
                file.write(data[max(begin - at, 0) : max(end - at, 0)])
                at += len(data)


def grow_logs(lines: DataFrame, path: str, share: tuple[float, float]) -> None:
    """Append a share of the bytes of four log files, written by the tasks; a cut may fall inside a line."""
    placed = lines.select("value", "ts", "seq", (F.col("day") % 4).cast("int").alias("_file"))
    # One number per file: the bytes of its lines and their line feeds.
    sizes = {r["_file"]: r["n"] for r in placed.groupBy("_file").agg(F.sum(F.octet_length("value") + 1).alias("n")).collect()}
    store, inner = file_store(path)
    store.create_dir(inner)
    ordered = placed.repartition(4, "_file").sortWithinPartitions("_file", "ts", "seq")
    ordered.foreachPartition(lambda rows: append_share(rows, path, share, sizes))


@query("S4_follow_growing_logs")
def _(spark, folder):
    """Half of each file, one run, the rest appended, another run on the same checkpoint."""
    path, lines = working_path(spark, "growing"), raw_lines(spark, folder)
    place = working_path(spark, "followed"), working_path(spark, "followed-checkpoint")
    for share in ((0.0, 0.5), (0.5, 1.0)):
        grow_logs(lines, path, share)
        got = _streamed(spark, src.tail_readings(spark, path), "followed", place)
    return _shown(got)


@query("S5_start_from_timestamp")
def _(spark, folder):
    path = write_lines(raw_lines(spark, folder), working_path(spark, "growing"))
    stream = src.stream_readings(spark, path, from_ts=1_705_000_000.0)
    return _shown(_streamed(spark, stream, "recent"))


@query("S6_feature_table_round_trip")
def _(spark, folder):
    target = sinks.write_features(pairs(spark, folder), working_path(spark, "features"))
    return src.read_features(spark, target)


@query("S7_connection_table_round_trip")
def _(spark, folder):
    r = readings(spark, folder)
    path = working_path(spark, "features")
    sinks.write_features(traffic.traffic_features(r, DAY, EVENT_TYPES), path, "windows")
    target = sinks.write_features(traffic.connection_features(r), path, "connections", fmt="csv")
    return src.read_features(spark, target, fmt="csv")


def _extracted(spark: SparkSession, folder: str):
    return jobs.extract_tables(readings(spark, folder), working_path(spark, "extracted"), DAY, EVENT_TYPES)


@query("S7_one_read_connections")
def _(spark, folder):
    """Both tables of one run from one read of the logs: the connections."""
    return src.read_features(spark, _extracted(spark, folder)[0]["connections"])


@query("S7_one_read_windows")
def _(spark, folder):
    found = src.read_features(spark, _extracted(spark, folder)[0]["windows"])
    return found.drop(*[f"func_{c}_count" for c in EVENT_TYPES])


@query("C6_summary_of_one_read")
def _(spark, folder):
    return _extracted(spark, folder)[1]


@query("S8_write_scored_rows")
def _(spark, folder):
    path = working_path(spark, "scored")
    sinks.write_scored(scored(spark, folder), path)
    return spark.read.parquet(f"{path}/scored").select(*PAIR_KEYS, "anomaly_score", "anomaly")


@query("S9_append_detections_by_day")
def _(spark, folder):
    staged, out, mark = (working_path(spark, n) for n in ("staged", "detections", "detections-checkpoint"))
    detections(spark, folder).select(*DETECTION.names).write.parquet(staged)
    stream = spark.readStream.schema(DETECTION).parquet(staged)
    _drain(sinks.sink_detections(stream, out, mark, availableNow=True))
    return src.read_detections(spark, out).select(*PAIR_KEYS, "anomaly_score", "detected_at")


@query("S10_scan_detection_files")
def _(spark, folder):
    """Files with differing columns are merged."""
    out = working_path(spark, "detections")
    found = detections(spark, folder)
    early = found.filter("src = 'h0'").select(*PAIR_KEYS, "anomaly_score", "detected_at")
    late = found.filter("src = 'h1'").select(*PAIR_KEYS, "anomaly_score", "detected_at", "entropy_mean")
    sinks.write_detections(early, out)
    sinks.write_detections(late, out)
    return src.read_detections(spark, out).select(*PAIR_KEYS, "anomaly_score", "detected_at", "entropy_mean")


@query("S11_land_closed_logs")
def _(spark, folder):
    """Lines land below the date of their event; only closed ``.log`` files are taken."""
    source, out, mark = (working_path(spark, n) for n in ("closing", "landed", "landed-checkpoint"))
    plain = {"extension": "log", "sep": "\x01", "quote": "", "escape": ""}
    raw_lines(spark, folder).select("value").write.options(**plain).csv(source)
    _drain(sinks.land_logs(spark, source, out, mark, availableNow=True))
    landed = spark.read.text(out)
    return landed.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("lines"))


# -- projections -----------------------------------------------------------------------------------------------------


@query("P1_rename_columns")
def _(spark, folder):
    r = readings(spark, folder)
    raw = r.withColumns(
        {"id.orig_h": F.col("src"), "id.orig_p": F.col("src_port"), "id.resp_h": F.col("dst"), "id.resp_p": F.lit(502)}
    ).drop("src", "dst", "src_port", "dst_port")
    return src.normalise(raw).select("ts", "src", "src_port", "dst", "dst_port", "seq")


@query("P2_numeric_timestamp")
def _(spark, folder):
    text = F.when(F.col("seq") % 10 == 0, "n/a").otherwise(F.format_string("%.6f", "ts"))
    stamped = readings(spark, folder).select(X.numeric_timestamp(text).alias("ts"), "seq")
    return stamped.filter("ts is not null")


@query("P3_window_id")
def _(spark, folder):
    return readings(spark, folder).select("seq", X.window_id(F.col("ts"), 300).alias("time_window"))


@query("P4_element_or_zero")
def _(spark, folder):
    values = F.col("response_values")
    return readings(spark, folder).select("seq", *[X.element_or_zero(values, i).alias(f"value_{i}") for i in range(3)])


@query("P5_parse_values")
def _(spark, folder):
    k = F.col("src_port")
    plain = F.concat_ws(",", k.cast("string"), (k % 7).cast("string"), (F.col("seq") % 5).cast("string"))
    text = (
        F.when(k % 10 == 0, "-")
        .when(k % 10 == 1, F.concat(k.cast("string"), F.lit(",x")))
        .when(k % 10 == 2, F.concat(F.lit(" "), plain, F.lit(", ,")))
        .when(k % 10 == 3, F.lit(None).cast("string"))
        .otherwise(plain)
    )
    parsed = readings(spark, folder).select("seq", X.parse_values(text).alias("v"))
    return parsed.select("seq", F.size("v").alias("n_values"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("parsed"))


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of zero to four entries with repetitions."""
    k = F.col("src_port").cast("double")
    full = F.array(k, k % 7, (F.col("seq") % 5).cast("double"), k % 7)
    return readings(spark, folder).select("seq", F.slice(full, F.lit(1), (F.col("seq") % 5).cast("int")).alias("v"))


@query("P6_list_statistics")
def _(spark, folder):
    v = F.col("v")
    return _lists(spark, folder).withColumn("mean", X.list_mean(v)).select(
        "seq", "mean", X.list_std(v, F.col("mean")).alias("std"), X.list_range(v).alias("value_range"),
        X.list_distinct(v).alias("distinct_count"),
    )


@query("P7_list_entropy")
def _(spark, folder):
    return _lists(spark, folder).select("seq", X.list_entropy(F.col("v")).alias("entropy"))


@query("P8_epoch_to_timestamp")
def _(spark, folder):
    return readings(spark, folder).select("seq", X.to_timestamp(F.col("ts")).alias("stamp"))


@query("P9_clean_numbers")
def _(spark, folder):
    k = F.col("src_port") % 10
    dirty = (
        F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf"))
        .when(k == 3, F.lit(None).cast("double")).otherwise(F.get("response_values", F.lit(1)))
    )
    return readings(spark, folder).select("seq", X.clean_number(dirty).alias("value"))


@query("P10_fill_missing")
def _(spark, folder):
    rolled = register.pair_rollup(registers(spark, folder, QUARTER))
    return temporal.fill_missing(rolled, ROLLUP_COLUMNS).select(*PAIR_KEYS, "value_mean_std", "registers_accessed")


@query("P11_split_features")
def _(spark, folder):
    labelled = pairs(spark, folder).withColumn("label", (F.col("time_window") % 2).cast("int"))
    cleaned, names = scaling.prepare(labelled, "label")
    return cleaned.select(*PAIR_KEYS, "label", *names)


@query("P12_feature_vector")
def _(spark, folder):
    """All names of the vector, and one that the table has not."""
    features = pairs(spark, folder)
    vector = X.feature_vector(features, [*PAIR_FEATURE_COLUMNS, "not_there"])
    return features.select(*PAIR_KEYS, F.posexplode(vector).alias("position", "x"))


@query("P13_incident_duration")
def _(spark, folder):
    return inc.with_duration(incidents(spark, folder)).select("attack_id", "started_at", "completed_at", "duration")


@query("P14_running_incidents")
def _(spark, folder):
    return inc.by_status(incidents(spark, folder)).select("attack_id", "attack_type", "target", "started_at")


@query("P14_status_counts")
def _(spark, folder):
    return inc.status_counts(incidents(spark, folder))


# -- register profile ------------------------------------------------------------------------------------------------

_REGISTER_PARTS = {
    "A1_value_statistics": ["value_mean", "value_std", "value_min", "value_max", "value_range"],
    "A2_volatility": ["value_changes", "value_change_rate"],
    "A3_read_frequency": ["read_count", "read_rate"],
    "A4_read_timing": ["inter_read_mean", "inter_read_std"],
    "A5_outliers": ["outlier_count", "max_z_score"],
    "A6_unique_values": ["unique_values"],
    "A7_histogram_entropy": ["entropy"],
}


def _register_part(columns: list[str]) -> Query:
    return lambda spark, folder: registers(spark, folder).select(*REGISTER_KEYS, *columns)


for _name, _columns in _REGISTER_PARTS.items():
    query(_name)(_register_part(_columns))


@query("A8_pair_rollup")
def _(spark, folder):
    rolled = register.pair_rollup(registers(spark, folder))
    return temporal.fill_missing(rolled, ROLLUP_COLUMNS)


@query("U1_extra_features")
def _(spark, folder):
    extra = {"high_share": F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), "units": F.max("unit")}
    found = register.register_features(readings(spark, folder), DAY, extra=extra)
    return register.pair_rollup(found, list(extra)).select(*PAIR_KEYS, "high_share_mean", "units_mean", "read_count_sum")


@query("C6_extraction_summary")
def _(spark, folder):
    return register.extraction_summary(readings(spark, folder), pairs(spark, folder), DAY)


@query("pair_features")
def _(spark, folder):
    return pairs(spark, folder)


# -- windows over rows -----------------------------------------------------------------------------------------------


@query("W1_neighbour_difference")
def _(spark, folder):
    rows = register.register_values(readings(spark, folder), DAY)
    found = neighbour_rows(rows, REGISTER_KEYS, ORDER, ["ts", "value"])
    return found.select(
        *REGISTER_KEYS, "seq", (F.col("ts") - F.col("prev_ts")).alias("gap"),
        (F.col("value") - F.col("prev_value")).alias("value_diff"),
    )


@query("W2_rolling_statistics")
def _(spark, folder):
    return pairs(spark, folder).select(*PAIR_KEYS, *[c for c in CONTEXT_COLUMNS if not c.endswith("deviation")])


@query("W3_relative_deviation")
def _(spark, folder):
    return pairs(spark, folder).select(*PAIR_KEYS, *[c for c in CONTEXT_COLUMNS if c.endswith("deviation")])


@query("W4_history_baseline")
def _(spark, folder):
    return temporal.history_context(records(spark, folder)).select(*PAIR_KEYS, *CONTEXT_COLUMNS)


# -- record profile --------------------------------------------------------------------------------------------------

_RECORD_PARTS = {
    "B1_list_statistics": [
        "value_mean_mean", "value_mean_std", "value_mean_min", "value_mean_max", "value_std_mean", "value_std_max",
        "value_range_mean", "value_range_max", "value_changes_sum", "value_change_rate_mean", "unique_values_mean",
        "entropy_mean",
    ],
    "B2_read_rate": ["read_count_sum", "read_rate_mean"],
    "B3_read_timing": ["inter_read_mean_mean", "inter_read_std_mean"],
    "B4_outliers": ["outlier_count_sum", "max_z_score_max"],
    "B5_registers_accessed": ["registers_accessed"],
}


def _record_part(columns: list[str]) -> Query:
    return lambda spark, folder: records(spark, folder, QUARTER).select(*PAIR_KEYS, *columns)


for _name, _columns in _RECORD_PARTS.items():
    query(_name)(_record_part(_columns))


# -- traffic ---------------------------------------------------------------------------------------------------------


@query("C1_traffic_counts")
def _(spark, folder):
    return traffic.traffic_features(readings(spark, folder), DAY, pivot=False)


@query("C2_function_code_pivot")
def _(spark, folder):
    return traffic.code_counts(readings(spark, folder, True), DAY, CODES)


@query("C2_function_codes_long")
def _(spark, folder):
    return traffic.code_counts_long(readings(spark, folder, True), DAY)


@query("C3_gap_statistics")
def _(spark, folder):
    return traffic.gap_features(readings(spark, folder), QUARTER)


@query("C4_gap_percentiles")
def _(spark, folder):
    found = traffic.gap_features(readings(spark, folder), DAY, traffic.IAT_PERCENTILES)
    return found.select(*PAIR_KEYS, "iat_p25", "iat_p50", "iat_p75", "iat_p95")


@query("C5_connections")
def _(spark, folder):
    return traffic.connection_features(readings(spark, folder, True))


@query("J1_window_features")
def _(spark, folder):
    return traffic.window_features(readings(spark, folder), DAY, pivot=False)


@query("J1_window_features_full")
def _(spark, folder):
    """With function codes and gap percentiles."""
    return traffic.window_features(readings(spark, folder, True), DAY, percentiles=traffic.IAT_PERCENTILES)


@query("J2_traffic_with_codes")
def _(spark, folder):
    return traffic.traffic_features(readings(spark, folder, True), DAY)


# -- scaling, forest, clustering -------------------------------------------------------------------------------------


@query("M1_fit_scaler")
def _(spark, folder):
    return scaling.scaler_table(pairs(spark, folder), PAIR_FEATURE_COLUMNS)


@query("M1_apply_scaler")
def _(spark, folder):
    features = stored(pairs(spark, folder).select(*PAIR_KEYS, *PAIR_FEATURE_COLUMNS), "features")
    return scaling.apply_scaler(features, scaling.fit_scaler(features, PAIR_FEATURE_COLUMNS))


@query("M2_standardise_table")
def _(spark, folder):
    return scaling.standardise_table(stored(pairs(spark, folder), "features"))


@query("M3_fit_forest")
def _(spark, folder):
    """Node table of a forest fitted on all pair features."""
    features = stored(pairs(spark, folder), "features")
    model = forest.fit_forest(features, PAIR_FEATURE_COLUMNS)
    return spark.createDataFrame(model.nodes, forest.NODE_SCHEMA)


@query("M3_train_and_score")
def _(spark, folder):
    target = sinks.write_features(pairs(spark, folder), working_path(spark, "features"))
    _, flagged = jobs.train(src.read_features(spark, target))
    return flagged.select(*PAIR_KEYS, "anomaly_score", "anomaly")


@query("M3_tree_shapes")
def _(spark, folder):
    """Per tree: one root, twice as many nodes as leaves less one, every child used once, and the rows it was grown from."""
    features = stored(pairs(spark, folder), "features")
    nodes = spark.createDataFrame(forest.fit_forest(features, PAIR_FEATURE_COLUMNS).nodes, forest.NODE_SCHEMA)
    leaf = F.col("feature") < 0
    inner = nodes.filter(~leaf).select("tree", F.explode(F.array("left", "right")).alias("node"))
    children = inner.groupBy("tree").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("node").alias("d"), F.min("node").alias("m"))
    shapes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.count_if(leaf).alias("leaves"), F.count_if(F.col("node") == 0).alias("roots"))
    whole = (F.col("n") == 2 * F.col("leaves") - 1) & (F.col("c") == F.col("n") - 1) & (F.col("d") == F.col("c")) & (F.col("m") > 0)
    return shapes.join(children, "tree").select("tree", "roots", whole.alias("whole"))


@query("M3_score_checks")
def _(spark, folder):
    """Per row: the score lies in (-1, 0), and flagged rows are those strictly below the wanted quantile."""
    features = stored(pairs(spark, folder), "features")
    _, flagged = jobs.train(features, contamination=CONTAMINATION)
    kept = stored(flagged.select(*PAIR_KEYS, "anomaly_score", "anomaly"), "scored")
    limit = kept.agg(F.percentile("anomaly_score", F.lit(CONTAMINATION)).alias("_limit"))
    score = F.col("anomaly_score")
    return kept.join(F.broadcast(limit)).select(
        *PAIR_KEYS, ((score > -1) & (score < 0)).alias("in_range"), ((score < F.col("_limit")) == (F.col("anomaly") == 1)).alias("flag_agrees")
    )


@query("M4_score_wide_forest")
def _(spark, folder):
    """A fixed forest that asks for each of the 28 features."""
    features = stored(pairs(spark, folder), "features")
    return forest.score(features, wide_model(features)).select(*PAIR_KEYS, "anomaly_score")


@query("M4_score_fixed_forest")
def _(spark, folder):
    return scored(spark, folder).select(*PAIR_KEYS, "anomaly_score")


@query("M5_flag_contamination")
def _(spark, folder):
    found = forest.flag_contamination(scored_hourly(spark, folder), CONTAMINATION)
    return found.select(*PAIR_KEYS, "anomaly_score", "anomaly")


@query("M6_flag_threshold")
def _(spark, folder):
    return scored(spark, folder).select(*PAIR_KEYS, "anomaly")


@query("M7_model_round_trip")
def _(spark, folder):
    features = stored(pairs(spark, folder), "features")
    path = working_path(spark, "model")
    forest.save_model(spark, fixed_model(features), path)
    return forest.score(features, forest.load_model(spark, path)).select(*PAIR_KEYS, "anomaly_score")


def _vectors(spark: SparkSession, folder: str, columns: Sequence[str] = VECTOR_COLUMNS) -> DataFrame:
    e = adapters.table(spark, folder, "embeddings")
    return e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)])


@query("M8_dbscan")
def _(spark, folder):
    return cluster.dbscan(_vectors(spark, folder), VECTOR_COLUMNS, id_col="vec_id")


@query("M8_cluster_summary")
def _(spark, folder):
    return cluster.cluster_summary(cluster.dbscan(_vectors(spark, folder), VECTOR_COLUMNS, id_col="vec_id"))


@query("M8_dbscan_whole_vectors")
def _(spark, folder):
    """All coordinates; standardised vectors of so many lie further apart, so the distance is wider."""
    return cluster.dbscan(_vectors(spark, folder, WHOLE_VECTOR), WHOLE_VECTOR, WHOLE_EPS, id_col="vec_id")


@query("M8_pivot_whole_vectors")
def _(spark, folder):
    """All coordinates, compared only where distances to pivots allow."""
    return pivots.pivot_dbscan(_vectors(spark, folder, WHOLE_VECTOR), WHOLE_VECTOR, PIVOT_EPS, id_col="vec_id")


def _numbered_pairs(spark: SparkSession, folder: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("dst"))
    number = F.col("time_window") * 100 + F.substring("src", 2, 9).cast("bigint") * 10 + place
    return pairs(spark, folder).withColumn("pair_id", number)


@query("M8_pivot_pair_features")
def _(spark, folder):
    """The standardised 28 features of device pairs."""
    return pivots.pivot_dbscan(_numbered_pairs(spark, folder), PAIR_FEATURE_COLUMNS, PAIR_EPS, id_col="pair_id")


@query("M8_pivot_summary")
def _(spark, folder):
    found = pivots.pivot_dbscan(_numbered_pairs(spark, folder), PAIR_FEATURE_COLUMNS, PAIR_EPS, id_col="pair_id")
    return cluster.cluster_summary(found)


@query("M9_labelled_evaluation")
def _(spark, folder):
    labels = adapters.table(spark, folder, "labels")
    judged = labels.select(F.col("toxic").alias("truth"), (1 - F.col("quality")).alias("guess"))
    return ev.evaluate(judged, "truth", "guess")


# -- summaries and reports -------------------------------------------------------------------------------------------


@query("C7_scoring_summary")
def _(spark, folder):
    return ex.summarise(scored(spark, folder)).drop("std_anomaly_score")


@query("C8_scoring_summary_with_deviation")
def _(spark, folder):
    return ex.summarise(scored(spark, folder)).select(
        "total_samples", "anomalies_detected", "anomaly_rate", "mean_anomaly_score", "std_anomaly_score"
    )


@query("C9_feature_differences")
def _(spark, folder):
    return ex.feature_differences(scored(spark, folder), PAIR_FEATURE_COLUMNS)


@query("O1_most_anomalous")
def _(spark, folder):
    return ex.top_anomalies(scored(spark, folder), 10)


@query("O2_distinguishing_features")
def _(spark, folder):
    return ex.explain(scored(spark, folder), PAIR_FEATURE_COLUMNS, 10)


@query("O3_anomalous_windows")
def _(spark, folder):
    return ex.anomalous_windows(scored(spark, folder), 20)


@query("C10_detections_per_source")
def _(spark, folder):
    return det.counts_by(detections(spark, folder), "src")


@query("C10_detections_per_destination")
def _(spark, folder):
    return det.counts_by(detections(spark, folder), "dst")


@query("C11_detections_per_pair")
def _(spark, folder):
    return det.counts_by(detections(spark, folder), "src", "dst")


@query("C12_score_distribution")
def _(spark, folder):
    return det.score_stats(detections_hourly(spark, folder))


@query("C13_score_histogram")
def _(spark, folder):
    return det.score_histogram(detections_hourly(spark, folder), 20)


@query("C14_storage_statistics")
def _(spark, folder):
    """All detections of a day come from one task, so there is one file per day."""
    out = working_path(spark, "detections")
    sinks.write_detections(detections(spark, folder).repartition(F.to_date("detected_at")), out)
    return det.storage_stats(src.read_detections(spark, out))


HISTORY_START, HISTORY_END = 1_704_500_000, 1_706_000_000


@query("O4_detection_history")
def _(spark, folder):
    """Answered from the table stored by day."""
    out = working_path(spark, "detections")
    sinks.write_detections(detections_hourly(spark, folder), out)
    found = det.history(
        src.read_detections(spark, out),
        start=F.timestamp_seconds(F.lit(HISTORY_START)),
        end=F.timestamp_seconds(F.lit(HISTORY_END)),
        src="h1",
        min_score=-0.7,
        limit=100,
    )
    return found.select(*PAIR_KEYS, "anomaly_score", "detected_at")


@query("O5_recent_detections")
def _(spark, folder):
    return det.recent(detections(spark, folder)).select(*PAIR_KEYS, "anomaly_score", "detected_at")


@query("O5_recent_stored_days")
def _(spark, folder):
    """From a table stored by day, of which only the newest folders are read."""
    path = working_path(spark, "stored")
    sinks.write_detections(detections(spark, folder), path)
    return det.recent_stored(spark, path).select(*PAIR_KEYS, "anomaly_score", "detected_at")


@query("O6_incident_log")
def _(spark, folder):
    return inc.incident_log(incidents(spark, folder)).select(
        "attack_id", "attack_type", "target", "status", "started_at", "completed_at", "duration"
    )


@query("O7_union_differing_columns")
def _(spark, folder):
    r = readings(spark, folder)
    left = r.filter("src = 'h0'").select("ts", "seq", "src", "unit")
    right = r.filter("src = 'h1'").select("ts", "seq", "src", "func")
    return det.union_all([left, right])


# -- evaluation ------------------------------------------------------------------------------------------------------


@query("J3_detections_in_incidents")
def _(spark, folder):
    found = ev.match_incidents(detections_hourly(spark, folder), incidents(spark, folder), HOUR)
    return found.select("attack_id", "attack_type", *PAIR_KEYS, "anomaly_score", "detected_at")


@query("E1_before_and_after")
def _(spark, folder):
    return ev.before_after(detections_hourly(spark, folder), incidents(spark, folder), 3600, 7200)


@query("E2_incident_quality")
def _(spark, folder):
    return ev.incident_quality(detections_hourly(spark, folder), incidents(spark, folder), HOUR, 3600)


@query("E3_incident_scores")
def _(spark, folder):
    return ev.incident_scores(detections_hourly(spark, folder), incidents(spark, folder), HOUR)


@query("E3_type_scores")
def _(spark, folder):
    return ev.type_scores(detections_hourly(spark, folder), incidents(spark, folder), HOUR)


@query("E4_detection_latency")
def _(spark, folder):
    return ev.detection_latency(detections_hourly(spark, folder), incidents(spark, folder), HOUR)


@query("E5_confusion_by_type")
def _(spark, folder):
    return ev.confusion_by_type(scored_hourly(spark, folder), incidents(spark, folder), HOUR)


@query("E6_rates_by_type")
def _(spark, folder):
    return ev.rates(ev.confusion_by_type(scored_hourly(spark, folder), incidents(spark, folder), HOUR))


@query("E7_latency_statistics")
def _(spark, folder):
    return ev.latency_stats(ev.detection_latency(detections_hourly(spark, folder), incidents(spark, folder), HOUR))


@query("E8_detection_timeline")
def _(spark, folder):
    return ev.timeline(detections_hourly(spark, folder), "6 hours")


# -- streams ---------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    path = write_lines(raw_lines(spark, folder), working_path(spark, "stream"))
    live.use_rocksdb(spark)
    return src.stream_readings(spark, path)


@query("T1_stream_pair_windows")
def _(spark, folder):
    """Record profile per completed window."""
    found = stream_pair_features(_stream(spark, folder), QUARTER, "1 hour", profile="record")
    return _streamed(spark, found, "windows")


@query("T3_stream_register_rollup")
def _(spark, folder):
    return _streamed(spark, stream_pair_features(_stream(spark, folder), DAY, "1 hour"), "rollup")


ODD = 5_000  # a window length that sixty does not divide into whole microseconds


@query("T1_odd_window")
def _(spark, folder):
    found = stream_pair_features(_stream(spark, folder), ODD, "1 hour", profile="record")
    return _streamed(spark, found, "windows")


@query("T3_odd_window")
def _(spark, folder):
    return _streamed(spark, stream_pair_features(_stream(spark, folder), ODD, "1 hour"), "rollup")


@query("T4_stream_history")
def _(spark, folder):
    found = live.stream_history(stream_pair_features(_stream(spark, folder), DAY, "1 hour", profile="record"))
    return _streamed(spark, found, "history").select(*PAIR_KEYS, *CONTEXT_COLUMNS)


@query("T4_register_history")
def _(spark, folder):
    """Register windows on a stream with the context of their profile: five windows, relative deviation."""
    found = live.stream_history(stream_pair_features(_stream(spark, folder), DAY, "1 hour"))
    return _streamed(spark, found, "history").select(*PAIR_KEYS, *CONTEXT_COLUMNS)


LATE_EVERY = 50


@query("T2_late_rows")
def _(spark, folder):
    """One run over all readings, then every fiftieth once more: those whose slice was closed are counted as late."""
    path, lines = working_path(spark, "late"), raw_lines(spark, folder)
    place = working_path(spark, "late-out"), working_path(spark, "late-checkpoint")
    live.use_rocksdb(spark)
    dropped, counted = 0, live.LateRows()
    spark.streams.addListener(counted)
    try:
        for number, part in enumerate((lines, lines.filter(F.col("seq") % LATE_EVERY == 0))):
            write_lines(part, f"{path}/{number}")
            stream = live.lateness(src.stream_readings(spark, f"{path}/*"), HOUR, "1 hour")
            query_ = (
                stream.writeStream.format("parquet").option("checkpointLocation", place[1]).trigger(availableNow=True).start(place[0])
            )
            _drain(query_)
            dropped += live.late_rows(query_, counted)
    finally:
        spark.streams.removeListener(counted)
    taken = spark.read.schema("rows long").parquet(place[0]).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return spark.createDataFrame([(int(taken), int(dropped))], "taken long, late long")


def _windows_and_late(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One query over all readings, then every fiftieth once more: windows and late readings, each in a table of its own."""
    path, lines = working_path(spark, "late"), raw_lines(spark, folder)
    place = [working_path(spark, f"late-{n}") for n in ("windows", "rows", "checkpoint")]
    live.use_rocksdb(spark)
    for number, part in enumerate((lines, lines.filter(F.col("seq") % LATE_EVERY == 0))):
        write_lines(part, f"{path}/{number}")
        found = win.stream_windows(src.stream_readings(spark, f"{path}/*"), QUARTER, "1 hour")
        _drain(win.sink_windows(found, *place))
    return tuple(spark.read.parquet(p).drop("batch") for p in place[:2])


@query("T2_late_readings")
def _(spark, folder):
    """The late readings themselves, next to the windows they missed."""
    return _windows_and_late(spark, folder)[1]


@query("T2_windows_beside_late")
def _(spark, folder):
    return _windows_and_late(spark, folder)[0].select(*PAIR_KEYS, "read_count_sum", "value_mean_mean")


@query("T6_status")
def _(spark, folder):
    """The counters after one run: readings taken in, detections, the newest completed window."""
    name = f"status-{working_path(spark, 'x')[-8:]}"
    listener = live.StatusListener([name])
    spark.streams.addListener(listener)
    try:
        model = fixed_model(records(spark, folder, QUARTER), "record")
        features = stream_pair_features(live.count_records(_stream(spark, folder)), QUARTER, "1 hour", profile="record")
        found = live.detect_stream(features, model, THRESHOLD)
        _drain(
            found.writeStream.format("parquet").queryName(name).option("checkpointLocation", working_path(spark, "status-checkpoint"))
            .trigger(availableNow=True).start(working_path(spark, "status"))
        )
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        s = listener.status()
    finally:
        spark.streams.removeListener(listener)
    row = (s["running"], s["records_processed"], s["anomalies_detected"], s["current_window"])
    return spark.createDataFrame([row], "running boolean, records_processed long, anomalies_detected long, current_window long")


@query("T5_history_detections")
def _(spark, folder):
    """Windows with their history scored by a forest that uses it."""
    features = temporal.history_context(records(spark, folder))
    model = fixed_model(features, "record", columns=HISTORY_COLUMNS)
    pairs_ = live.stream_history(stream_pair_features(_stream(spark, folder), DAY, "1 hour", profile="record"))
    found = live.detect_stream(pairs_, model, HISTORY_THRESHOLD)
    return _streamed(spark, found, "flagged").select(*PAIR_KEYS, "anomaly_score")


@query("T5_stream_detections")
def _(spark, folder):
    """Record features of completed windows scored by the fixed forest; only flagged ones are stored."""
    model = fixed_model(records(spark, folder, QUARTER), "record")
    features = stream_pair_features(_stream(spark, folder), QUARTER, "1 hour", profile="record")
    found = live.detect_stream(features, model, THRESHOLD)
    return _streamed(spark, found, "flagged").select(*PAIR_KEYS, "anomaly_score")
