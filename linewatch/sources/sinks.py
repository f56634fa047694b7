"""Writing feature tables, scored rows, detections and landed logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch.functions import exprs as X
from linewatch.operators.explain import anomalous_windows, summarise

FEATURE_KINDS = ("windows", "connections")


def write_features(
    df: DataFrame, path: str, kind: str = "windows", fmt: str = "parquet", mode: str = "overwrite"
) -> str:
    """One feature table below ``path``, by kind. Returns its location."""
    if kind not in FEATURE_KINDS:
        raise ValueError(f"kind must be one of {FEATURE_KINDS}")
    target = f"{path}/features_{kind}"
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(target)
    return target


def write_scored(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scored rows, their one-row summary and the first windows with anomalies."""
    df.write.mode(mode).parquet(f"{path}/scored")
    stored = df.sparkSession.read.parquet(f"{path}/scored")
    summarise(stored).write.mode(mode).json(f"{path}/summary")
    anomalous_windows(stored).write.mode(mode).json(f"{path}/windows")


def with_date(detections: DataFrame) -> DataFrame:
    return detections.withColumn("date", F.to_date("detected_at"))


def write_detections(detections: DataFrame, path: str, mode: str = "append") -> None:
    with_date(detections).write.mode(mode).partitionBy("date").parquet(path)


def sink_detections(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Append detections exactly once, by day. Returns the started query."""
    return (
        with_date(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("date")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start(path)
    )


def land_logs(spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str, **trigger):
    """Copy lines of closed logs (``.log`` with a dash in the name) below ``year=/month=/day=`` of their event date.

    Lines are kept as text; those without a stamp land under the null date.
    """
    lines = spark.readStream.option("pathGlobFilter", "*-*.log").text(src_dir)
    stamp = X.to_timestamp(X.numeric_timestamp(F.get_json_object("value", "$.ts")))
    dated = lines.select(
        "value",
        F.date_format(stamp, "yyyy").alias("year"),
        F.date_format(stamp, "MM").alias("month"),
        F.date_format(stamp, "dd").alias("day"),
    )
    return (
        dated.writeStream.format("text")
        .outputMode("append")
        .partitionBy("year", "month", "day")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start(out_dir)
    )
