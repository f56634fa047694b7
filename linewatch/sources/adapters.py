"""Views of general-purpose event tables in the shapes this package works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch.functions import exprs as X


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


def readings_from_events(events: DataFrame, several_codes: bool = False) -> DataFrame:
    """Application events as telemetry: user parity reads from event type, ``k`` picks the register."""
    k = _k()
    func = F.concat(F.lit("f"), (k % 4).cast("string")) if several_codes else F.col("event_type")
    return events.select(
        X.epoch_seconds(F.col("ts")).alias("ts"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("uid"),
        F.concat(F.lit("h"), (F.col("user_id") % 2).cast("string")).alias("src"),
        k.cast("int").alias("src_port"),
        F.col("event_type").alias("dst"),
        F.lit(None).cast("int").alias("dst_port"),
        F.col("event_id").alias("tid"),
        (k % 3).cast("int").alias("unit"),
        func.alias("func"),
        F.when(F.col("event_id") % 2 == 0, "REQ").otherwise("RESP").alias("pdu_type"),
        (k % 4).alias("address"),
        F.lit(None).cast("bigint").alias("register_start"),
        F.array(k.cast("double"), F.col("value")).alias("response_values"),
        F.col("event_id").alias("seq"),
    )


def incidents_from_events(events: DataFrame) -> DataFrame:
    """Large error events as known incidents of ``k + 5`` minutes; every tenth is still running."""
    k = _k()
    targets = F.array(*[F.lit(t) for t in ("click", "view", "purchase", "signup", "error")])
    started = F.col("ts").cast("timestamp")
    ended = F.timestamp_micros(F.unix_micros(started) + (k + 5) * 60_000_000)
    completed = F.when(k % 10 != 0, ended)
    target = F.get(targets, (k % 5).cast("int"))
    return events.filter("event_type = 'error' and value > 150").select(
        F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("attack_id"),
        F.concat(F.lit("t"), (k % 4).cast("string")).alias("attack_type"),
        target.alias("target"),
        target.alias("target_ip"),
        F.when(completed.isNull(), "running").otherwise("completed").alias("status"),
        started.alias("started_at"),
        completed.alias("completed_at"),
    )


def readings_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """A larger scan with many order ties, for timing."""
    return lineitem.select(
        X.epoch_seconds(F.col("l_shipdate")).alias("ts"),
        (F.col("l_suppkey") % 10).cast("string").alias("src"),
        F.col("l_returnflag").alias("dst"),
        F.col("l_linenumber").cast("bigint").alias("address"),
        F.array(F.lit(0.0), F.col("l_quantity")).alias("response_values"),
        F.col("l_orderkey").alias("seq"),
        F.lit(None).cast("bigint").alias("register_start"),
    )
