"""The catalog's queries in SQL, written apart from the Spark code to check it."""

from __future__ import annotations

import math

from linewatch.plans.catalog import (
    CODES, CONTAMINATION, DAY, DETECTION_DELAY, HISTORY_COLUMNS, HISTORY_END, HISTORY_START, HISTORY_THRESHOLD, LATE_EVERY, HOUR, MODEL_COLUMNS, ODD, QUARTER,
    EVENT_TYPES, PAIR_EPS, PIVOT_EPS, SAMPLE_SIZE, THRESHOLD, TREES, VECTOR_COLUMNS, WHOLE_EPS, WHOLE_VECTOR, wide_trees,
)
from linewatch.schemas import CONTEXT_COLUMNS, CONTEXT_SOURCES, PAIR_FEATURE_COLUMNS, ROLLUP_COLUMNS

_SQL: dict[str, str] = {}

EVENTS = """
ev AS (
  SELECT epoch_us(ts) / 1e6 AS ts, 'c' || user_id AS uid, 'h' || (user_id % 2) AS src, event_type AS dst,
         k AS src_port, event_id AS tid, k % 3 AS unit, event_type AS func, 'f' || (k % 4) AS code,
         CASE WHEN event_id % 2 = 0 THEN 'REQ' ELSE 'RESP' END AS pdu_type, k % 4 AS address, event_id AS seq,
         k::DOUBLE AS v0, value AS v1, k
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""


def _registers(window: int) -> str:
    bins = " + ".join(
        f"(count(*) FILTER (bin = {i}) / n) * ln(count(*) FILTER (bin = {i}) / n + 1e-10)" for i in range(10)
    )
    return f"""
rg0 AS (SELECT *, CAST(floor(ts / {window}) AS BIGINT) AS time_window FROM ev),
rg1 AS (
  SELECT *, lag(v1) OVER o AS pv, lag(ts) OVER o AS pt, (count(*) OVER g)::DOUBLE AS n, avg(v1) OVER g AS m,
         stddev_pop(v1) OVER g AS s, min(v1) OVER g AS lo, max(v1) OVER g AS hi
  FROM rg0 WINDOW g AS (PARTITION BY time_window, src, dst, address),
                  o AS (PARTITION BY time_window, src, dst, address ORDER BY ts, seq)),
rg2 AS (
  SELECT *, CASE WHEN lo = hi THEN 5 ELSE least(CAST(floor((v1 - lo) * 10.0::DOUBLE / (hi - lo)) AS BIGINT), 9) END AS bin
  FROM rg1 WHERE n >= 3),
reg AS (
  SELECT time_window, src, dst, address, avg(v1) AS value_mean, stddev_pop(v1) AS value_std, min(v1) AS value_min,
         max(v1) AS value_max, max(v1) - min(v1) AS value_range,
         CAST(count(*) FILTER (pv <> v1) AS BIGINT) AS value_changes,
         count(*) FILTER (pv <> v1) / n AS value_change_rate,
         CAST(n AS BIGINT) AS read_count, n / {window} AS read_rate,
         avg(ts - pt) AS inter_read_mean, stddev_pop(ts - pt) AS inter_read_std,
         CAST(count(*) FILTER (n > 10 AND abs(v1 - m) / (s + 1e-6) > 3) AS BIGINT) AS outlier_count,
         CASE WHEN n > 10 THEN max(abs(v1 - m) / (s + 1e-6)) ELSE 0 END AS max_z_score,
         CAST(count(DISTINCT v1) AS BIGINT) AS unique_values, -({bins}) AS entropy,
         avg(CASE WHEN v1 > 50 THEN 1.0 ELSE 0.0 END) AS high_share, max(unit)::DOUBLE AS units
  FROM rg2 GROUP BY time_window, src, dst, address, n)"""


ROLLUP = """
roll AS (
  SELECT time_window, src, dst, avg(value_mean) AS value_mean_mean,
         coalesce(stddev_samp(value_mean), 0) AS value_mean_std, min(value_mean) AS value_mean_min,
         max(value_mean) AS value_mean_max, avg(value_std) AS value_std_mean, max(value_std) AS value_std_max,
         avg(value_range) AS value_range_mean, max(value_range) AS value_range_max,
         sum(value_changes)::DOUBLE AS value_changes_sum, avg(value_change_rate) AS value_change_rate_mean,
         sum(read_count)::DOUBLE AS read_count_sum, avg(read_rate) AS read_rate_mean,
         avg(inter_read_mean) AS inter_read_mean_mean, avg(inter_read_std) AS inter_read_std_mean,
         sum(outlier_count)::DOUBLE AS outlier_count_sum, max(max_z_score)::DOUBLE AS max_z_score_max,
         avg(unique_values) AS unique_values_mean, avg(entropy) AS entropy_mean,
         count(DISTINCT address)::DOUBLE AS registers_accessed, avg(high_share) AS high_share_mean,
         avg(units) AS units_mean
  FROM reg GROUP BY time_window, src, dst)"""


def _context() -> str:
    cols = []
    for c in CONTEXT_SOURCES:
        b = f"avg({c}) OVER (h ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
        cols += [
            f"avg({c}) OVER (h ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS {c}_rolling_mean",
            f"coalesce(stddev_samp({c}) OVER (h ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS {c}_rolling_std",
            f"CASE WHEN {b} IS NULL THEN 0 WHEN {b} + 1 = 0 THEN sign({c} - {b}) * 1e6 "
            f"ELSE ({c} - {b}) / ({b} + 1) END AS {c}_deviation",
        ]
    base = ", ".join(["time_window", "src", "dst", *ROLLUP_COLUMNS])
    return f"feat AS (SELECT {base}, {', '.join(cols)} FROM roll WINDOW h AS (PARTITION BY src, dst ORDER BY time_window))"


def _records(window: int) -> str:
    return f"""
rc0 AS (
  SELECT CAST(floor(ts / {window}) AS BIGINT) AS time_window, src, dst, ts, seq, address, (v0 + v1) / 2 AS m,
         abs(v0 - v1) / 2 AS s, abs(v0 - v1) AS r, CASE WHEN v0 = v1 THEN 1 ELSE 2 END AS d,
         CASE WHEN v0 = v1 THEN -log2(1 + 1e-10) ELSE -log2(0.5 + 1e-10) END AS e
  FROM ev),
rc1 AS (
  SELECT *, lag(ts) OVER (g ORDER BY ts, seq) AS pt, avg(m) OVER g AS mm, stddev_samp(m) OVER g AS ms,
         count(*) OVER g AS n
  FROM rc0 WINDOW g AS (PARTITION BY time_window, src, dst)),
roll AS (
  SELECT time_window, src, dst, avg(m) AS value_mean_mean, coalesce(stddev_samp(m), 0) AS value_mean_std,
         min(m) AS value_mean_min, max(m) AS value_mean_max, avg(s) AS value_std_mean, max(s) AS value_std_max,
         avg(r) AS value_range_mean, max(r) AS value_range_max, sum(d)::DOUBLE AS value_changes_sum,
         avg(d) AS value_change_rate_mean, n::DOUBLE AS read_count_sum,
         CASE WHEN max(ts) > min(ts) THEN n / (max(ts) - min(ts)) ELSE 0 END AS read_rate_mean,
         coalesce(avg(ts - pt), 0) AS inter_read_mean_mean, coalesce(stddev_samp(ts - pt), 0) AS inter_read_std_mean,
         (count(*) FILTER (n > 2 AND ms > 0 AND abs(m - mm) / ms > 3))::DOUBLE AS outlier_count_sum,
         coalesce(max(CASE WHEN n > 2 AND ms > 0 THEN abs(m - mm) / ms END), 0)::DOUBLE AS max_z_score_max,
         avg(d) AS unique_values_mean, avg(e) AS entropy_mean, count(DISTINCT address)::DOUBLE AS registers_accessed
  FROM rc1 GROUP BY time_window, src, dst, n)"""


def _history() -> str:
    cols = []
    for c in CONTEXT_SOURCES:
        w = "OVER (h ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
        enough = f"count(*) {w} >= 3"
        cols += [
            f"CASE WHEN {enough} THEN avg({c}) {w} ELSE {c} END AS {c}_rolling_mean",
            f"CASE WHEN {enough} THEN stddev_pop({c}) {w} ELSE 0 END AS {c}_rolling_std",
            f"CASE WHEN {enough} THEN {c} - avg({c}) {w} ELSE 0 END AS {c}_deviation",
        ]
    return (
        f"hist AS (SELECT time_window, src, dst, {', '.join(cols)} FROM roll "
        "WINDOW h AS (PARTITION BY src, dst ORDER BY time_window))"
    )


def _path(spec) -> str:
    if not isinstance(spec, tuple):
        return f"{spec}::DOUBLE"
    number, split, low, high = spec
    return f"CASE WHEN z{number} <= {split}::DOUBLE THEN {_path(low)} ELSE {_path(high)} END"


def _scored(window: int, trees=TREES, columns=MODEL_COLUMNS, threshold: float = THRESHOLD) -> str:
    n = SAMPLE_SIZE
    normal = 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    scale = ", ".join(f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s{i}" for i, c in enumerate(columns))
    z = ", ".join(f"({c} - m{i}) / s{i} AS z{i}" for i, c in enumerate(columns))
    total = " + ".join(f"({_path(t)})" for t in trees)
    return f"""
scale AS (SELECT {scale} FROM feat),
zed AS (SELECT feat.*, {z} FROM feat, scale),
sc0 AS (SELECT *, -power(2::DOUBLE, -(({total}) / {len(trees)}) / {normal!r}::DOUBLE) AS anomaly_score FROM zed),
scored AS (SELECT *, CASE WHEN anomaly_score < {threshold}::DOUBLE THEN 1 ELSE 0 END AS anomaly FROM sc0),
det AS (
  SELECT time_window, src, dst, anomaly_score, entropy_mean,
         (time_window + 1) * {window}::DOUBLE + {DETECTION_DELAY} + read_count_sum AS detected_at
  FROM scored WHERE anomaly = 1)"""


INCIDENTS = """
inc AS (
  SELECT 'a' || event_id AS attack_id, 't' || (k % 4) AS attack_type,
         ['click', 'view', 'purchase', 'signup', 'error'][CAST(k % 5 AS INT) + 1] AS target,
         CASE WHEN k % 10 = 0 THEN 'running' ELSE 'completed' END AS status, epoch_us(ts) / 1e6 AS started_at,
         CASE WHEN k % 10 <> 0 THEN (epoch_us(ts) + (k + 5) * 60000000) / 1e6 END AS completed_at
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
  WHERE event_type = 'error' AND value > 150)"""

TOUCH = f"""
touch AS (
  SELECT inc.attack_id, inc.attack_type, inc.started_at, w.time_window, inc.target AS dst
  FROM inc JOIN (
    SELECT unnest(range((SELECT CAST(floor(min(started_at) / {HOUR}) AS BIGINT) FROM inc),
                        (SELECT CAST(ceil(max(completed_at) / {HOUR}) AS BIGINT) + 1 FROM inc))) AS time_window) w
  ON w.time_window * {HOUR} < inc.completed_at AND (w.time_window + 1) * {HOUR} > inc.started_at)"""

DAILY = ",".join([EVENTS, _registers(DAY), ROLLUP, _context()])
DAILY_SCORED = ",".join([DAILY, _scored(DAY)])
HOURLY_SCORED = ",".join([EVENTS, _records(HOUR), "feat AS (SELECT * FROM roll)", _scored(HOUR)])
JUDGED = ",".join([HOURLY_SCORED, INCIDENTS, TOUCH])


def add(name: str, ctes: str, select: str, doubles: list[str] = (), integers: list[str] = ()) -> None:
    """Register ``select`` over ``ctes``; doubles are rounded and integers widened as in the catalog."""
    replaced = [f"floor({c} * 1e6 + 0.501) / 1e6 AS {c}" for c in doubles]
    replaced += [f"CAST({c} AS BIGINT) AS {c}" for c in integers]
    body = f"SELECT * REPLACE ({', '.join(replaced)}) FROM ({select})" if replaced else select
    _SQL[name] = f"WITH RECURSIVE {ctes} {body}" if ctes else body


def all_sql() -> dict[str, str]:
    return dict(_SQL)


_KEYS = "time_window, src, dst"
_REG = "time_window, src, dst, address"

# -- sources ---------------------------------------------------------------------------------------------------------

_READ = "ts, uid, src, src_port, dst, tid, unit, func, pdu_type, address, seq, v0 AS value_0, v1 AS value_1"
_READ_DOUBLES = ["ts", "value_0", "value_1"]
add("S1_read_json_logs", EVENTS, f"SELECT {_READ} FROM ev", _READ_DOUBLES)
_MIXED = EVENTS + (
    ", mixed AS (SELECT * REPLACE (CASE WHEN seq % 5 <> 0 THEN unit END AS unit, CASE WHEN seq % 5 <> 2 THEN address END AS address, "
    "CASE seq % 5 WHEN 1 THEN 3 WHEN 3 THEN 1 ELSE v0 END AS v0, CASE seq % 5 WHEN 1 THEN 4 WHEN 3 THEN 0 ELSE v1 END AS v1) FROM ev)"
)
add("S1_mixed_types", _MIXED, f"SELECT {_READ} FROM mixed", _READ_DOUBLES)
add(
    "S2_mixed_line_counts",
    EVENTS,
    "SELECT count(*) AS lines, count(*) FILTER (seq % 10 = 0) AS malformed, "
    "count(*) FILTER (seq % 10 = 1) AS unstamped FROM ev",
)
add("S2_skip_malformed_lines", EVENTS, f"SELECT {_READ} FROM ev WHERE seq % 10 > 1", _READ_DOUBLES)
add(
    "S2_line_counts",
    EVENTS,
    "SELECT count(*) AS lines, count(*) FILTER (seq % 10 = 0) AS malformed, "
    "count(*) FILTER (seq % 10 = 1) AS unstamped FROM ev",
)
for _name, _uid in (("S3_read_tsv_logs", "uid"), ("S3_quotes", "CASE WHEN seq % 3 = 0 THEN '\"' || uid ELSE uid END AS uid")):
    add(
        _name,
        EVENTS,
        f"SELECT ts, {_uid}, src, src_port, dst, 502 AS dst_port, unit, func, pdu_type, address AS register_start, "
        "CASE WHEN seq % 10 = 0 THEN 0 ELSE 2 END AS n_values, "
        "CASE WHEN seq % 10 = 0 THEN 0.0 ELSE (seq % 5)::DOUBLE END AS value_1 FROM ev WHERE seq % 7 <> 0",
        ["ts", "value_1"],
        ["dst_port", "n_values"],
    )
add("S4_follow_log_files", EVENTS, f"SELECT {_READ} FROM ev", _READ_DOUBLES)
add("S4_follow_growing_logs", EVENTS, f"SELECT {_READ} FROM ev", _READ_DOUBLES)
add("S5_start_from_timestamp", EVENTS, f"SELECT {_READ} FROM ev WHERE ts >= 1705000000", _READ_DOUBLES)
add("S6_feature_table_round_trip", DAILY, "SELECT * FROM feat", PAIR_FEATURE_COLUMNS)
_CONNECTIONS = (
    "SELECT uid, count(*) AS transaction_count, min(ts) AS conn_start, max(ts) AS conn_end, "
    "count(DISTINCT tid) AS unique_tids, count(DISTINCT {func}) AS unique_functions, "
    "count(*) FILTER (pdu_type = 'REQ') AS request_count, max(ts) - min(ts) AS conn_duration, "
    "count(*) FILTER (pdu_type <> 'REQ') AS response_count, "
    "count(*) FILTER (pdu_type = 'REQ') / (count(*) FILTER (pdu_type <> 'REQ') + 1) AS req_resp_ratio "
    "FROM ev GROUP BY uid"
)
_CONNECTION_DOUBLES = ["conn_start", "conn_end", "conn_duration", "req_resp_ratio"]
add("S7_connection_table_round_trip", EVENTS, _CONNECTIONS.format(func="func"), _CONNECTION_DOUBLES)
add("S7_one_read_connections", EVENTS, _CONNECTIONS.format(func="func"), _CONNECTION_DOUBLES)
add(
    "S8_write_scored_rows",
    DAILY_SCORED,
    f"SELECT {_KEYS}, anomaly_score, anomaly FROM scored",
    ["anomaly_score"],
    ["anomaly"],
)
_DETECTION = f"SELECT {_KEYS}, anomaly_score, detected_at FROM det"
add("S9_append_detections_by_day", DAILY_SCORED, _DETECTION, ["anomaly_score", "detected_at"])
add(
    "S10_scan_detection_files",
    DAILY_SCORED,
    f"SELECT {_KEYS}, anomaly_score, detected_at, CASE WHEN src = 'h1' THEN entropy_mean END AS entropy_mean FROM det",
    ["anomaly_score", "detected_at", "entropy_mean"],
)
add(
    "S11_land_closed_logs",
    "",
    "SELECT CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day, "
    "count(*) AS lines FROM events GROUP BY ALL",
)

# -- projections -----------------------------------------------------------------------------------------------------

add("P1_rename_columns", EVENTS, "SELECT ts, src, src_port, dst, 502::BIGINT AS dst_port, seq FROM ev", ["ts"])
add("P2_numeric_timestamp", EVENTS, "SELECT ts, seq FROM ev WHERE seq % 10 <> 0", ["ts"])
add("P3_window_id", EVENTS, "SELECT seq, CAST(floor(ts / 300) AS BIGINT) AS time_window FROM ev")
add(
    "P4_element_or_zero",
    EVENTS,
    "SELECT seq, v0 AS value_0, v1 AS value_1, 0::DOUBLE AS value_2 FROM ev",
    ["value_0", "value_1", "value_2"],
)
add(
    "P5_parse_values",
    EVENTS,
    "SELECT seq, CASE WHEN k % 10 IN (0, 1, 3) THEN 0 ELSE 3 END::BIGINT AS n_values, "
    "CASE WHEN k % 10 IN (0, 1, 3) THEN '' ELSE k || ',' || (k % 7) || ',' || (seq % 5) END AS parsed FROM ev",
)
_LISTS = (
    EVENTS
    + ", li AS (SELECT seq, list_slice([k::DOUBLE, (k % 7)::DOUBLE, (seq % 5)::DOUBLE, (k % 7)::DOUBLE], 1, seq % 5) AS v"
    " FROM ev), un AS (SELECT seq, unnest(v) AS x FROM li), "
    "ag AS (SELECT seq, avg(x) AS a, stddev_pop(x) AS s, max(x) - min(x) AS r, count(DISTINCT x) AS d FROM un GROUP BY seq)"
)
add(
    "P6_list_statistics",
    _LISTS,
    "SELECT li.seq, coalesce(a, 0) AS mean, coalesce(s, 0) AS std, coalesce(r, 0) AS value_range, "
    "coalesce(d, 1) AS distinct_count FROM li LEFT JOIN ag ON li.seq = ag.seq",
    ["mean", "std", "value_range"],
)
add(
    "P7_list_entropy",
    _LISTS
    + ", vc AS (SELECT seq, x, count(*)::DOUBLE AS c FROM un GROUP BY seq, x), "
    "sh AS (SELECT seq, c / sum(c) OVER (PARTITION BY seq) AS p FROM vc), "
    "en AS (SELECT seq, -sum(p * log2(p + 1e-10)) AS h FROM sh GROUP BY seq)",
    "SELECT li.seq, coalesce(h, 0) AS entropy FROM li LEFT JOIN en ON li.seq = en.seq",
    ["entropy"],
)
add("P8_epoch_to_timestamp", EVENTS, "SELECT seq, ts AS stamp FROM ev", ["stamp"])
add(
    "P9_clean_numbers",
    EVENTS,
    "SELECT seq, (CASE k % 10 WHEN 0 THEN 0 WHEN 1 THEN 1e6 WHEN 2 THEN -1e6 WHEN 3 THEN 0 ELSE v1 END)::DOUBLE AS value "
    "FROM ev",
    ["value"],
)
add(
    "P10_fill_missing",
    ",".join([EVENTS, _registers(QUARTER), ROLLUP]),
    f"SELECT {_KEYS}, value_mean_std, registers_accessed FROM roll",
    ["value_mean_std", "registers_accessed"],
)
add(
    "P11_split_features",
    DAILY,
    f"SELECT {_KEYS}, time_window % 2 AS label, {', '.join(PAIR_FEATURE_COLUMNS)} FROM feat",
    PAIR_FEATURE_COLUMNS,
)
add(
    "P12_feature_vector",
    DAILY,
    " UNION ALL ".join(
        f"SELECT {_KEYS}, {i}::BIGINT AS position, {c}::DOUBLE AS x FROM feat"
        for i, c in enumerate([*PAIR_FEATURE_COLUMNS, "0"])
    ),
    ["x"],
)
add(
    "P13_incident_duration",
    INCIDENTS,
    "SELECT attack_id, started_at, completed_at, completed_at - started_at AS duration FROM inc",
    ["started_at", "completed_at", "duration"],
)
add(
    "P14_running_incidents",
    INCIDENTS,
    "SELECT attack_id, attack_type, target, started_at FROM inc WHERE status = 'running'",
    ["started_at"],
)
add("P14_status_counts", INCIDENTS, "SELECT status, count(*) AS incidents FROM inc GROUP BY status")

# -- features --------------------------------------------------------------------------------------------------------

_REGISTERS = ",".join([EVENTS, _registers(DAY)])
for _name, _doubles, _integers in [
    ("A1_value_statistics", ["value_mean", "value_std", "value_min", "value_max", "value_range"], []),
    ("A2_volatility", ["value_change_rate"], ["value_changes"]),
    ("A3_read_frequency", ["read_rate"], ["read_count"]),
    ("A4_read_timing", ["inter_read_mean", "inter_read_std"], []),
    ("A5_outliers", ["max_z_score"], ["outlier_count"]),
    ("A6_unique_values", [], ["unique_values"]),
    ("A7_histogram_entropy", ["entropy"], []),
]:
    add(_name, _REGISTERS, f"SELECT {_REG}, {', '.join([*_integers, *_doubles])} FROM reg", _doubles, _integers)
_ROLLED = ",".join([_REGISTERS, ROLLUP])
add("A8_pair_rollup", _ROLLED, f"SELECT {_KEYS}, {', '.join(ROLLUP_COLUMNS)} FROM roll", ROLLUP_COLUMNS)
add(
    "U1_extra_features",
    _ROLLED,
    f"SELECT {_KEYS}, high_share_mean, units_mean, read_count_sum FROM roll",
    ["high_share_mean", "units_mean", "read_count_sum"],
)
add(
    "C6_extraction_summary",
    DAILY,
    "SELECT (SELECT count(*) FROM ev) AS total_records, (SELECT count(*) FROM feat) AS feature_vectors, "
    f"{3 + len(PAIR_FEATURE_COLUMNS)}::BIGINT AS num_features, {DAY}::BIGINT AS time_window_seconds",
)
add("pair_features", DAILY, "SELECT * FROM feat", PAIR_FEATURE_COLUMNS)
add(
    "W1_neighbour_difference",
    _REGISTERS,
    f"SELECT {_REG}, seq, ts - pt AS gap, v1 - pv AS value_diff FROM rg1 WHERE pt IS NOT NULL",
    ["gap", "value_diff"],
)
_ROLLING = [c for c in CONTEXT_COLUMNS if not c.endswith("deviation")]
_DEVIATIONS = [c for c in CONTEXT_COLUMNS if c.endswith("deviation")]
add("W2_rolling_statistics", DAILY, f"SELECT {_KEYS}, {', '.join(_ROLLING)} FROM feat", _ROLLING)
add("W3_relative_deviation", DAILY, f"SELECT {_KEYS}, {', '.join(_DEVIATIONS)} FROM feat", _DEVIATIONS)
_DAILY_RECORDS = ",".join([EVENTS, _records(DAY)])
add("W4_history_baseline", ",".join([_DAILY_RECORDS, _history()]), "SELECT * FROM hist", CONTEXT_COLUMNS)
_QUARTER_RECORDS = ",".join([EVENTS, _records(QUARTER)])
for _name, _doubles in [
    ("B1_list_statistics", [*ROLLUP_COLUMNS[:10], "unique_values_mean", "entropy_mean"]),
    ("B2_read_rate", ["read_count_sum", "read_rate_mean"]),
    ("B3_read_timing", ["inter_read_mean_mean", "inter_read_std_mean"]),
    ("B4_outliers", ["outlier_count_sum", "max_z_score_max"]),
    ("B5_registers_accessed", ["registers_accessed"]),
]:
    add(_name, _QUARTER_RECORDS, f"SELECT {_KEYS}, {', '.join(_doubles)} FROM roll", _doubles)


def _traffic(window: int) -> str:
    return (
        f"tw AS (SELECT *, CAST(floor(ts / {window}) AS BIGINT) AS time_window FROM ev), "
        f"tr AS (SELECT {_KEYS}, count(*) AS ts_count, min(ts) AS ts_min, max(ts) AS ts_max, "
        "count(DISTINCT tid) AS tid_nunique, count(DISTINCT unit) AS unit_nunique, "
        "count(DISTINCT src_port) AS src_port_nunique, max(ts) - min(ts) AS duration, "
        f"count(*) / {window}::DOUBLE AS transaction_rate FROM tw GROUP BY {_KEYS}), "
        "gp AS (SELECT *, ts - lag(ts) OVER (PARTITION BY src, dst ORDER BY ts, seq) AS gap FROM tw), "
        f"ia AS (SELECT {_KEYS}, coalesce(avg(gap), 0) AS iat_mean, coalesce(stddev_samp(gap), 0) AS iat_std, "
        "coalesce(min(gap), 0) AS iat_min, coalesce(max(gap), 0) AS iat_max, "
        + ", ".join(f"coalesce(quantile_cont(gap, {p / 100}), 0) AS iat_p{p}" for p in (25, 50, 75, 95))
        + f" FROM gp GROUP BY {_KEYS})"
    )


_TRAFFIC_DOUBLES = ["ts_min", "ts_max", "duration", "transaction_rate"]
_GAP_DOUBLES = ["iat_mean", "iat_std", "iat_min", "iat_max"]
_PERCENTILES = ["iat_p25", "iat_p50", "iat_p75", "iat_p95"]
_DAY_TRAFFIC = ", ".join([EVENTS, _traffic(DAY)])
_PIVOT = ", ".join(f"count(*) FILTER (code = '{c}') AS func_{c}_count" for c in CODES)
add("C1_traffic_counts", _DAY_TRAFFIC, "SELECT * FROM tr", _TRAFFIC_DOUBLES)
add("C2_function_code_pivot", _DAY_TRAFFIC, f"SELECT {_KEYS}, {_PIVOT} FROM tw GROUP BY {_KEYS}")
add(
    "C3_gap_statistics",
    ", ".join([EVENTS, _traffic(QUARTER)]),
    f"SELECT {_KEYS}, {', '.join(_GAP_DOUBLES)} FROM ia",
    _GAP_DOUBLES,
)
add("C4_gap_percentiles", _DAY_TRAFFIC, f"SELECT {_KEYS}, {', '.join(_PERCENTILES)} FROM ia", _PERCENTILES)
add("C2_function_codes_long", _DAY_TRAFFIC, f"SELECT {_KEYS}, code AS func, count(*) AS n FROM tw GROUP BY ALL")
add("C5_connections", EVENTS, _CONNECTIONS.format(func="code"), _CONNECTION_DOUBLES)
add(
    "J1_window_features",
    _DAY_TRAFFIC,
    f"SELECT tr.*, {', '.join(_GAP_DOUBLES)} FROM tr LEFT JOIN ia USING ({_KEYS})",
    [*_TRAFFIC_DOUBLES, *_GAP_DOUBLES],
)
add(
    "S7_one_read_windows",
    _DAY_TRAFFIC,
    f"SELECT tr.*, {', '.join(_GAP_DOUBLES)} FROM tr LEFT JOIN ia USING ({_KEYS})",
    [*_TRAFFIC_DOUBLES, *_GAP_DOUBLES],
)
add(
    "C6_summary_of_one_read",
    _DAY_TRAFFIC,
    f"SELECT (SELECT count(*) FROM ev) AS total_records, (SELECT count(*) FROM tr) AS feature_vectors, "
    f"{3 + 8 + 5 + len(_GAP_DOUBLES)}::BIGINT AS num_features, "
    f"{DAY}::BIGINT AS time_window_seconds",
)
add(
    "J1_window_features_full",
    _DAY_TRAFFIC + f", pv AS (SELECT {_KEYS}, {_PIVOT} FROM tw GROUP BY {_KEYS})",
    f"SELECT tr.*, pv.* EXCLUDE ({_KEYS}), {', '.join([*_GAP_DOUBLES, *_PERCENTILES])} "
    f"FROM tr LEFT JOIN pv USING ({_KEYS}) LEFT JOIN ia USING ({_KEYS})",
    [*_TRAFFIC_DOUBLES, *_GAP_DOUBLES, *_PERCENTILES],
)
add(
    "J2_traffic_with_codes",
    _DAY_TRAFFIC + f", pv AS (SELECT {_KEYS}, {_PIVOT} FROM tw GROUP BY {_KEYS})",
    f"SELECT tr.*, pv.* EXCLUDE ({_KEYS}) FROM tr LEFT JOIN pv USING ({_KEYS})",
    _TRAFFIC_DOUBLES,
)

add(
    "C14_storage_statistics",
    DAILY_SCORED,
    "SELECT count(DISTINCT floor(detected_at / 86400)) AS files, count(*) AS total_anomalies FROM det",
)

# -- scaling, forest, clustering -------------------------------------------------------------------------------------

add(
    "M1_fit_scaler",
    DAILY,
    " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{c}' AS feature, avg({c}) AS mean, "
        f"CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS scale FROM feat"
        for i, c in enumerate(PAIR_FEATURE_COLUMNS)
    ),
    ["mean", "scale"],
)


def _standardised(columns: list[str]) -> str:
    return ", ".join(
        f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END AS {c}"
        for c in columns
    )


add("M1_apply_scaler", DAILY, f"SELECT {_KEYS}, {_standardised(PAIR_FEATURE_COLUMNS)} FROM feat", PAIR_FEATURE_COLUMNS)
add(
    "M2_standardise_table",
    DAILY,
    f"SELECT {_KEYS}, {_standardised(PAIR_FEATURE_COLUMNS)} FROM feat",
    PAIR_FEATURE_COLUMNS,
)
_SCORE = f"SELECT {_KEYS}, anomaly_score FROM scored"
add("M4_score_fixed_forest", DAILY_SCORED, _SCORE, ["anomaly_score"])
add("M3_tree_shapes", "", "SELECT CAST(range AS BIGINT) AS tree, 1::BIGINT AS roots, true AS whole FROM range(100)")
add("M3_score_checks", DAILY, f"SELECT {_KEYS}, true AS in_range, true AS flag_agrees FROM feat")
add(
    "M4_score_wide_forest",
    ",".join([DAILY, _scored(DAY, wide_trees(), PAIR_FEATURE_COLUMNS)]),
    _SCORE,
    ["anomaly_score"],
)
add(
    "M5_flag_contamination",
    HOURLY_SCORED,
    f"SELECT {_KEYS}, anomaly_score, CASE WHEN anomaly_score < "
    f"(SELECT quantile_cont(anomaly_score, {CONTAMINATION}) FROM scored) THEN 1 ELSE 0 END AS anomaly FROM scored",
    ["anomaly_score"],
    ["anomaly"],
)
add("M6_flag_threshold", DAILY_SCORED, f"SELECT {_KEYS}, anomaly FROM scored", [], ["anomaly"])
add("M7_model_round_trip", DAILY_SCORED, _SCORE, ["anomaly_score"])
_VECTORS = (
    "vc AS (SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(4)) + " FROM embeddings), "
    f"vz AS (SELECT vec_id, {_standardised(VECTOR_COLUMNS)} FROM vc), "
    "nb AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vz a, vz b WHERE sqrt("
    + " + ".join(f"(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})" for i in range(4))
    + ") <= 0.5), "
    "co AS (SELECT a AS p FROM nb GROUP BY a HAVING count(*) >= 5), "
    "ce AS (SELECT a, b FROM nb WHERE a IN (SELECT p FROM co) AND b IN (SELECT p FROM co)), "
    "rt AS (SELECT p AS node, p AS root FROM co UNION SELECT ce.b, rt.root FROM rt JOIN ce ON ce.a = rt.node), "
    "lb AS (SELECT node, min(root) AS label FROM rt GROUP BY node), "
    "bd AS (SELECT nb.a AS node, min(lb.label) AS label FROM nb JOIN lb ON nb.b = lb.node GROUP BY nb.a), "
    "db AS (SELECT vz.vec_id, coalesce(bd.label, -1) AS cluster, CASE WHEN lb.node IS NULL THEN 0 ELSE 1 END AS core, "
    "CASE WHEN bd.label IS NULL THEN 1 ELSE 0 END AS noise "
    "FROM vz LEFT JOIN lb ON vz.vec_id = lb.node LEFT JOIN bd ON vz.vec_id = bd.node)"
)
add("M8_dbscan", _VECTORS, "SELECT * FROM db", [], ["cluster", "core", "noise"])
_COORDINATES, _GAPS = (
    [sep.join(form.format(i=i, j=i + 1) for i in range(n)) for n in (len(VECTOR_COLUMNS), len(WHOLE_VECTOR))]
    for sep, form in ((", ", "embedding[{j}]::DOUBLE AS e{i}"), (" + ", "(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})"))
)
_WHOLE_VECTORS = (
    _VECTORS.replace(_COORDINATES[0], _COORDINATES[1]).replace(_standardised(VECTOR_COLUMNS), _standardised(WHOLE_VECTOR))
    .replace(f"{_GAPS[0]}) <= 0.5", f"{_GAPS[1]}) <= {WHOLE_EPS}")
)
add("M8_dbscan_whole_vectors", _WHOLE_VECTORS, "SELECT * FROM db", [], ["cluster", "core", "noise"])
add(
    "M8_pivot_whole_vectors",
    _WHOLE_VECTORS.replace(f"<= {WHOLE_EPS}", f"<= {PIVOT_EPS}"),
    "SELECT * FROM db",
    [],
    ["cluster", "core", "noise"],
)
_PAIR_VECTORS = ",".join(
    [
        DAILY,
        f"vz AS (SELECT time_window * 100 + CAST(substr(src, 2) AS BIGINT) * 10 + list_position({EVENT_TYPES}, dst) AS pair_id, "
        f"{_standardised(PAIR_FEATURE_COLUMNS)} FROM feat), "
        "nb AS (SELECT a.pair_id AS a, b.pair_id AS b FROM vz a, vz b WHERE sqrt("
        + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in PAIR_FEATURE_COLUMNS)
        + f") <= {PAIR_EPS}), "
        + "co AS (" + _VECTORS.split("co AS (")[1].replace("vec_id", "pair_id"),
    ]
)
add("M8_pivot_pair_features", _PAIR_VECTORS, "SELECT * FROM db", [], ["cluster", "core", "noise"])
add(
    "M8_pivot_summary",
    _PAIR_VECTORS,
    "SELECT count(*) AS points, count(DISTINCT cluster) FILTER (noise = 0) AS clusters, sum(core) AS core_points, "
    "sum(noise) AS outliers, avg(noise) AS outlier_rate FROM db",
    ["outlier_rate"],
    ["core_points", "outliers"],
)
add(
    "M8_cluster_summary",
    _VECTORS,
    "SELECT count(*) AS points, count(DISTINCT cluster) FILTER (noise = 0) AS clusters, sum(core) AS core_points, "
    "sum(noise) AS outliers, avg(noise) AS outlier_rate FROM db",
    ["outlier_rate"],
    ["core_points", "outliers"],
)
add(
    "M9_labelled_evaluation",
    "",
    "SELECT toxic AS y_true, 1 - quality AS y_pred, count(*) AS n, "
    "(SELECT avg(CASE WHEN toxic = 1 - quality THEN 1.0 ELSE 0.0 END) FROM labels) AS accuracy "
    "FROM labels GROUP BY toxic, quality",
    ["accuracy"],
    ["y_true", "y_pred"],
)

# -- summaries and reports -------------------------------------------------------------------------------------------

_SUMMARY = (
    "SELECT count(*) AS total_samples, sum(anomaly) AS anomalies_detected, sum(anomaly) / count(*) AS anomaly_rate, "
    "avg(anomaly_score) AS mean_anomaly_score, {rest} FROM scored"
)
add(
    "C7_scoring_summary",
    DAILY_SCORED,
    _SUMMARY.format(rest="min(anomaly_score) AS min_anomaly_score, max(anomaly_score) AS max_anomaly_score"),
    ["anomaly_rate", "mean_anomaly_score", "min_anomaly_score", "max_anomaly_score"],
    ["anomalies_detected"],
)
add(
    "C8_scoring_summary_with_deviation",
    DAILY_SCORED,
    _SUMMARY.format(rest="stddev_pop(anomaly_score) AS std_anomaly_score"),
    ["anomaly_rate", "mean_anomaly_score", "std_anomaly_score"],
    ["anomalies_detected"],
)
_DIFFERENCES = (
    DAILY_SCORED
    + ", dm AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) FILTER (anomaly = 0) AS normal_mean, "
        f"avg({c}) FILTER (anomaly = 1) AS anomaly_mean FROM scored"
        for c in PAIR_FEATURE_COLUMNS
    )
    + "), fd AS (SELECT *, abs((anomaly_mean - normal_mean) / normal_mean) * 100 AS pct_diff FROM dm "
    "WHERE normal_mean <> 0 AND anomaly_mean IS NOT NULL)"
)
_DIFF_DOUBLES = ["normal_mean", "anomaly_mean", "pct_diff"]
add("C9_feature_differences", _DIFFERENCES, "SELECT * FROM fd", _DIFF_DOUBLES)
add("O2_distinguishing_features", _DIFFERENCES, "SELECT * FROM fd ORDER BY pct_diff DESC, feature LIMIT 10", _DIFF_DOUBLES)
add(
    "O1_most_anomalous",
    DAILY_SCORED,
    f"SELECT {_KEYS}, anomaly_score FROM scored WHERE anomaly = 1 ORDER BY floor(anomaly_score * 1e9), {_KEYS} LIMIT 10",
    ["anomaly_score"],
)
add(
    "O3_anomalous_windows",
    DAILY_SCORED,
    "SELECT DISTINCT time_window FROM scored WHERE anomaly = 1 ORDER BY time_window LIMIT 20",
)
add("C10_detections_per_source", DAILY_SCORED, "SELECT src, count(*) AS detections FROM det GROUP BY src")
add("C10_detections_per_destination", DAILY_SCORED, "SELECT dst, count(*) AS detections FROM det GROUP BY dst")
add("C11_detections_per_pair", DAILY_SCORED, "SELECT src, dst, count(*) AS detections FROM det GROUP BY src, dst")
add(
    "C12_score_distribution",
    HOURLY_SCORED,
    "SELECT count(*) AS total_anomalies, min(anomaly_score) AS min_score, max(anomaly_score) AS max_score, "
    "avg(anomaly_score) AS mean_score, quantile_cont(anomaly_score, 0.5) AS median_score, "
    "stddev_samp(anomaly_score) AS std_score FROM det",
    ["min_score", "max_score", "mean_score", "median_score", "std_score"],
)
add(
    "C13_score_histogram",
    HOURLY_SCORED + ", rg AS (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM det)",
    "SELECT least(CAST(floor((anomaly_score - lo) * 20::DOUBLE / (hi - lo)) AS BIGINT), 19) AS bin, "
    "lo + bin * ((hi - lo) / 20) AS bin_start, lo + (bin + 1) * ((hi - lo) / 20) AS bin_end, count(*) AS detections "
    "FROM det, rg GROUP BY ALL",
    ["bin_start", "bin_end"],
)
add(
    "O4_detection_history",
    HOURLY_SCORED,
    f"{_DETECTION} WHERE detected_at BETWEEN {HISTORY_START} AND {HISTORY_END} AND src = 'h1' "
    f"AND anomaly_score >= -0.7 ORDER BY detected_at DESC, {_KEYS} LIMIT 100",
    ["anomaly_score", "detected_at"],
)
for _name in ("O5_recent_detections", "O5_recent_stored_days"):
    add(_name, DAILY_SCORED, f"{_DETECTION} ORDER BY detected_at DESC, {_KEYS} LIMIT 20", ["anomaly_score", "detected_at"])
add(
    "O6_incident_log",
    INCIDENTS,
    "SELECT attack_id, attack_type, target, status, started_at, completed_at, completed_at - started_at AS duration "
    "FROM inc ORDER BY started_at DESC, attack_id LIMIT 10",
    ["started_at", "completed_at", "duration"],
)
add(
    "O7_union_differing_columns",
    EVENTS,
    "SELECT ts, seq, src, CASE WHEN src = 'h0' THEN unit END AS unit, CASE WHEN src = 'h1' THEN func END AS func FROM ev",
    ["ts"],
)

# -- evaluation ------------------------------------------------------------------------------------------------------

add(
    "J3_detections_in_incidents",
    ",".join([HOURLY_SCORED, INCIDENTS]),
    f"SELECT attack_id, attack_type, {_KEYS}, anomaly_score, detected_at FROM det JOIN inc ON det.dst = inc.target "
    f"AND time_window * {HOUR} < completed_at AND (time_window + 1) * {HOUR} > started_at",
    ["anomaly_score", "detected_at"],
)
add(
    "E1_before_and_after",
    ",".join([HOURLY_SCORED, INCIDENTS])
    + ", ba AS (SELECT attack_id, attack_type, count(det.dst) FILTER (detected_at < started_at) AS baseline_detections, "
    "count(det.dst) AS total_detections FROM inc LEFT JOIN det ON det.dst = inc.target "
    "AND detected_at >= started_at - 3600 AND detected_at < started_at + 7200 GROUP BY attack_id, attack_type)",
    "SELECT *, total_detections - baseline_detections AS new_detections, "
    "CASE WHEN total_detections > baseline_detections THEN 1 ELSE 0 END::BIGINT AS detected FROM ba",
)
_HITS = JUDGED + (
    ", hits AS (SELECT attack_id, attack_type, started_at, count(DISTINCT touch.time_window) AS attack_windows, "
    "count(DISTINCT det.time_window) AS detected_windows, count(det.dst) AS true_positives, avg(anomaly_score) AS mean_anomaly_score, sum(anomaly_score) AS total, "
    "min(detected_at) AS first_at "
    "FROM touch LEFT JOIN det ON det.dst = touch.dst AND det.time_window = touch.time_window "
    "GROUP BY attack_id, attack_type, started_at)"
)
add(
    "E2_incident_quality",
    _HITS
    + ", fp AS (SELECT attack_id, count(det.dst) AS false_positives FROM inc LEFT JOIN det ON det.dst = inc.target "
    "AND detected_at >= started_at - 3600 AND detected_at < started_at GROUP BY attack_id)",
    "SELECT attack_id, attack_type, attack_windows, true_positives, false_positives, "
    "detected_windows / attack_windows AS detection_rate, "
    "CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) END AS precision "
    "FROM hits JOIN fp USING (attack_id)",
    ["detection_rate", "precision"],
)
add(
    "E3_incident_scores",
    _HITS,
    "SELECT attack_id, attack_type, true_positives, mean_anomaly_score FROM hits",
    ["mean_anomaly_score"],
)
add(
    "E3_type_scores",
    _HITS,
    "SELECT attack_type, count(*) AS incidents, CAST(sum(true_positives) AS BIGINT) AS true_positives, "
    "sum(total) / sum(true_positives) AS mean_anomaly_score FROM hits GROUP BY attack_type",
    ["mean_anomaly_score"],
)
_LATENCY = _HITS + (
    ", lat AS (SELECT attack_id, attack_type, first_at - started_at AS latency_seconds FROM hits WHERE first_at IS NOT NULL)"
)
add("E4_detection_latency", _LATENCY, "SELECT * FROM lat", ["latency_seconds"])
add(
    "E7_latency_statistics",
    _LATENCY,
    "SELECT count(*) AS incidents, avg(latency_seconds) AS mean_latency, quantile_cont(latency_seconds, 0.5) AS median_latency, "
    "quantile_cont(latency_seconds, 0.95) AS p95_latency, quantile_cont(latency_seconds, 0.99) AS p99_latency FROM lat",
    ["mean_latency", "median_latency", "p95_latency", "p99_latency"],
)
_CONFUSION = JUDGED + (
    ", kinds AS (SELECT DISTINCT attack_type FROM touch UNION ALL SELECT 'all'), "
    "lb AS (SELECT k.attack_type, s.anomaly, EXISTS (SELECT 1 FROM touch t WHERE t.dst = s.dst "
    "AND t.time_window = s.time_window AND (k.attack_type = 'all' OR t.attack_type = k.attack_type)) AS hit "
    "FROM scored s, kinds k), "
    "cf AS (SELECT attack_type, count(*) FILTER (hit AND anomaly = 1) AS tp, count(*) FILTER (NOT hit AND anomaly = 1) AS fp, "
    "count(*) FILTER (hit AND anomaly = 0) AS fn, count(*) FILTER (NOT hit AND anomaly = 0) AS tn FROM lb GROUP BY attack_type)"
)
add("E5_confusion_by_type", _CONFUSION, "SELECT * FROM cf")
add(
    "E6_rates_by_type",
    _CONFUSION,
    "SELECT *, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr, tp / nullif(tp + fp, 0) AS precision, "
    "tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM cf",
    ["tpr", "fpr", "precision", "recall", "f1"],
)
add(
    "E8_detection_timeline",
    HOURLY_SCORED,
    "SELECT floor(detected_at / 21600) * 21600 AS bucket_start, count(*) AS detections FROM det GROUP BY 1",
    ["bucket_start"],
)

# -- streams: windows that end before the watermark (last stamp minus one hour) --------------------------------------


def _closed(window: int) -> str:
    return f"(time_window + 1) * {window} <= (SELECT floor((max(ts) - 3600) * 1000) / 1000 FROM ev)"


add(
    "T1_stream_pair_windows",
    _QUARTER_RECORDS,
    f"SELECT {_KEYS}, {', '.join(ROLLUP_COLUMNS)} FROM roll WHERE {_closed(QUARTER)}",
    ROLLUP_COLUMNS,
)
add(
    "T3_stream_register_rollup",
    _ROLLED,
    f"SELECT {_KEYS}, {', '.join(ROLLUP_COLUMNS)} FROM roll WHERE {_closed(DAY)}",
    ROLLUP_COLUMNS,
)
add(
    "T1_odd_window",
    ",".join([EVENTS, _records(ODD)]),
    f"SELECT {_KEYS}, {', '.join(ROLLUP_COLUMNS)} FROM roll WHERE {_closed(ODD)}",
    ROLLUP_COLUMNS,
)
add(
    "T3_odd_window",
    ",".join([EVENTS, _registers(ODD), ROLLUP]),
    f"SELECT {_KEYS}, {', '.join(ROLLUP_COLUMNS)} FROM roll WHERE {_closed(ODD)}",
    ROLLUP_COLUMNS,
)
add(
    "T4_stream_history",
    ",".join([_DAILY_RECORDS, _history()]),
    f"SELECT * FROM hist WHERE {_closed(DAY)}",
    CONTEXT_COLUMNS,
)
add(
    "T4_register_history",
    DAILY,
    f"SELECT {_KEYS}, {', '.join(CONTEXT_COLUMNS)} FROM feat WHERE {_closed(DAY)}",
    CONTEXT_COLUMNS,
)
add(
    "T2_late_rows",
    EVENTS,
    f"SELECT (SELECT count(*) FROM ev) + count(*) FILTER (NOT gone) AS taken, count(*) FILTER (gone) AS late FROM "
    f"(SELECT (floor(ts / 60) + 1) * 60 <= (SELECT floor((max(ts) - 3600) * 1000) / 1000 FROM ev) AS gone FROM ev WHERE seq % {LATE_EVERY} = 0)",
)
add(
    "T2_late_readings",
    EVENTS,
    f"SELECT CAST(floor(ts / {QUARTER}) AS BIGINT) AS time_window, src, dst, ts, seq, address, v1 AS value FROM ev "
    f"WHERE seq % {LATE_EVERY} = 0 "
    f"AND (floor(ts / {QUARTER}) + 1) * {QUARTER} <= (SELECT floor((max(ts) - 3600) * 1000) / 1000 FROM ev)",
    ["ts", "value"],
)
add(
    "T2_windows_beside_late",
    ",".join([EVENTS, _registers(QUARTER), ROLLUP]),
    f"SELECT {_KEYS}, read_count_sum, value_mean_mean FROM roll WHERE {_closed(QUARTER)}",
    ["read_count_sum", "value_mean_mean"],
)
add(
    "T6_status",
    ",".join([_QUARTER_RECORDS, "feat AS (SELECT * FROM roll)", _scored(QUARTER)]),
    "SELECT false AS running, (SELECT count(*) FROM ev) AS records_processed, "
    f"(SELECT count(*) FROM det WHERE {_closed(QUARTER)}) AS anomalies_detected, "
    f"(SELECT max(time_window) FROM roll WHERE {_closed(QUARTER)}) AS current_window",
)
add(
    "T5_history_detections",
    ",".join([
        _DAILY_RECORDS, _history(),
        "feat AS (SELECT roll.*, hist.* EXCLUDE (time_window, src, dst) FROM roll JOIN hist USING (time_window, src, dst))",
        _scored(DAY, columns=HISTORY_COLUMNS, threshold=HISTORY_THRESHOLD),
    ]),
    f"SELECT {_KEYS}, anomaly_score FROM det WHERE {_closed(DAY)}",
    ["anomaly_score"],
)
add(
    "T5_stream_detections",
    ",".join([_QUARTER_RECORDS, "feat AS (SELECT * FROM roll)", _scored(QUARTER)]),
    f"SELECT {_KEYS}, anomaly_score FROM det WHERE {_closed(QUARTER)}",
    ["anomaly_score"],
)
