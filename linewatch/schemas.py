"""Table shapes shared by batch jobs, streams and stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

PAIR_KEYS = ["time_window", "src", "dst"]
REGISTER_KEYS = ["time_window", "src", "dst", "address"]
ORDER = ["ts", "seq"]

# The roll-up of one window of a device pair, in the stored column order.
ROLLUP_COLUMNS = [
    "value_mean_mean", "value_mean_std", "value_mean_min", "value_mean_max",
    "value_std_mean", "value_std_max", "value_range_mean", "value_range_max",
    "value_changes_sum", "value_change_rate_mean", "read_count_sum", "read_rate_mean",
    "inter_read_mean_mean", "inter_read_std_mean", "outlier_count_sum", "max_z_score_max",
    "unique_values_mean", "entropy_mean", "registers_accessed",
]
CONTEXT_SOURCES = ["value_mean_mean", "read_count_sum", "value_change_rate_mean"]
CONTEXT_SUFFIXES = ["rolling_mean", "rolling_std", "deviation"]
CONTEXT_COLUMNS = [f"{c}_{s}" for c in CONTEXT_SOURCES for s in CONTEXT_SUFFIXES]
PAIR_FEATURE_COLUMNS = ROLLUP_COLUMNS + CONTEXT_COLUMNS


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


READING = _struct(
    ("ts", T.DoubleType()),
    ("uid", T.StringType()),
    ("src", T.StringType()),
    ("src_port", T.IntegerType()),
    ("dst", T.StringType()),
    ("dst_port", T.IntegerType()),
    ("tid", T.LongType()),
    ("unit", T.IntegerType()),
    ("func", T.StringType()),
    ("pdu_type", T.StringType()),
    ("address", T.LongType()),
    ("register_start", T.LongType()),
    ("response_values", T.ArrayType(T.DoubleType())),
    ("seq", T.LongType()),
)

CORRUPT = "_corrupt"

# What a log line holds before renaming. Every field is read as text and converted afterwards, so that a field of another
# type costs that field, not the line.
RAW_JSON = _struct(
    *[
        (c, T.StringType())
        for c in [
            "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "tid", "unit", "func", "pdu_type", "address",
            "register_start", "response_values", "seq", CORRUPT,
        ]
    ]
)

# Column order of the headerless tab-separated log.
RAW_TSV_COLUMNS = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "track_address",
    "unit_id", "func", "network_direction", "register_start", "register_count", "response_values",
]
EXTRA = "_extra"  # set where a line has more fields than the log format
RAW_TSV = _struct(*[(c, T.StringType()) for c in [*RAW_TSV_COLUMNS, EXTRA]])

_FEATURES = [(c, T.DoubleType()) for c in PAIR_FEATURE_COLUMNS]
DETECTION = _struct(
    ("time_window", T.LongType()),
    ("src", T.StringType()),
    ("dst", T.StringType()),
    ("anomaly_score", T.DoubleType()),
    ("detected_at", T.TimestampType()),
    *_FEATURES,
)
INCIDENT = _struct(
    ("attack_id", T.StringType()),
    ("attack_type", T.StringType()),
    ("target", T.StringType()),
    ("target_ip", T.StringType()),
    ("status", T.StringType()),
    ("started_at", T.TimestampType()),
    ("completed_at", T.TimestampType()),
)
