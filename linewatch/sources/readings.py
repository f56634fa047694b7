"""Reading device logs, feature tables and stored detections."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewatch.functions import exprs as X
from linewatch.schemas import CORRUPT, EXTRA, RAW_JSON, RAW_TSV
from linewatch.sources.tail import FILE_SHIFT, RANGE_BYTES, LogTail

PLACE = "_place"


def normalise(raw: DataFrame) -> DataFrame:
    """Raw log columns under their short names and types; rows without a usable stamp are left out.

    Fields are text as the log readers give them; values that are lists already, as of a typed table, are taken as they are.
    """
    values = F.col("response_values")
    listed = isinstance(raw.schema["response_values"].dataType, T.ArrayType)
    renamed = raw.select(
        X.numeric_timestamp(F.col("ts")).alias("ts"),
        "uid",
        F.col("`id.orig_h`").alias("src"),
        X.integral(F.col("`id.orig_p`"), "int").alias("src_port"),
        F.col("`id.resp_h`").alias("dst"),
        X.integral(F.col("`id.resp_p`"), "int").alias("dst_port"),
        X.integral(F.col("tid")).alias("tid"),
        X.integral(F.col("unit"), "int").alias("unit"),
        "func",
        "pdu_type",
        X.integral(F.col("address")).alias("address"),
        X.integral(F.col("register_start")).alias("register_start"),
        (values.cast("array<double>") if listed else X.value_list(values)).alias("response_values"),
        X.integral(F.col("seq")).alias("seq"),
        *[c for c in raw.columns if c == PLACE],
    )
    return renamed.filter("ts is not null")


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Log lines with an explicit schema; only a line that is no JSON object is kept as text in ``_corrupt``."""
    return (
        spark.read.schema(RAW_JSON).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    )


def read_readings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All log files of a path, glob or list. Malformed lines are skipped."""
    raw = _placed(read_raw(spark, path))
    return _in_arrival_order(normalise(raw.filter(F.col(CORRUPT).isNull())))


def _placed(raw: DataFrame) -> DataFrame:
    """The place of every line, rising with file name and position in the file.

    A split's lines count on from the byte where it begins: as a line has two bytes at least, no count reaches the next split.
    """
    files = sorted(raw.inputFiles())
    names = raw.sparkSession.createDataFrame(list(enumerate(files)), "_rank long, _name string")
    within = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    counted = raw.select("*", F.input_file_name().alias("_name"), within.alias(PLACE))
    if len(files) > 1:  # one row per file, as many as the driver has planned for
        counted = counted.join(F.broadcast(names), "_name", "left").withColumn(
            PLACE, F.shiftleft(F.coalesce("_rank", F.lit(0)), FILE_SHIFT) + F.col(PLACE)
        )
    return counted.drop("_name", "_rank")


def _in_arrival_order(readings: DataFrame) -> DataFrame:
    """Lines without a sequence number are ordered among equal stamps by their place."""
    return readings.withColumn("seq", F.coalesce("seq", PLACE)).drop(PLACE)


def line_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """How many lines were read and how many were dropped as malformed or unstamped."""
    raw = read_raw(spark, path)
    bad = F.col(CORRUPT).isNotNull()
    unstamped = ~bad & X.numeric_timestamp(F.col("ts")).isNull()
    return raw.select("ts", CORRUPT).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(bad).alias("malformed"),
        F.count_if(unstamped).alias("unstamped"),
    )


def read_readings_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless tab-separated logs; comment lines and lines with too many fields are skipped, missing ones are NULL."""
    raw = _placed(spark.read.schema(RAW_TSV).option("sep", "\t").option("comment", "#").option("quote", "").csv(path))
    readings = raw.filter(F.col(EXTRA).isNull()).select(
        X.numeric_timestamp(F.col("ts")).alias("ts"),
        "uid",
        F.col("`id.orig_h`").alias("src"),
        F.col("`id.orig_p`").try_cast("int").alias("src_port"),
        F.col("`id.resp_h`").alias("dst"),
        F.col("`id.resp_p`").try_cast("int").alias("dst_port"),
        F.lit(None).cast("bigint").alias("tid"),
        F.col("unit_id").try_cast("int").alias("unit"),
        "func",
        F.col("network_direction").alias("pdu_type"),
        F.lit(None).cast("bigint").alias("address"),
        F.col("register_start").try_cast("bigint").alias("register_start"),
        X.parse_values(F.col("response_values")).cast("array<double>").alias("response_values"),
        F.lit(None).cast("bigint").alias("seq"),
        PLACE,
    )
    return _in_arrival_order(readings.filter("ts is not null"))


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.format(fmt).load(path)


NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a stamp


def read_detections(
    spark: SparkSession, path: str | list[str], base: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """All stored detection files, with columns merged and unreadable files skipped.

    ``base`` is the table's folder where ``path`` lists some of its days. A given ``schema`` saves the look into every file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("ignoreCorruptFiles", True).option("recursiveFileLookup", False)
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", True)
    return (reader.option("basePath", base) if base else reader).parquet(*paths)


def stored_days(spark: SparkSession, path: str) -> list[str]:
    """The days a table stored by ``date`` has folders of, oldest first; files are not looked into."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(folder) if f.isDirectory()]
    return sorted(n.removeprefix("date=") for n in names if n.startswith("date="))


def stream_readings(
    spark: SparkSession, folder: str, from_ts: float | None = None, max_files: int | None = None
) -> DataFrame:
    """Follow a folder of finished logs by its new files. ``from_ts`` ignores older readings.

    A file is read once, when it appears; ``tail_readings`` follows files that grow.
    """
    reader = (
        spark.readStream.schema(RAW_JSON).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.json(folder)
    return _since(normalise(raw.filter(F.col(CORRUPT).isNull())), from_ts)


def tail_readings(
    spark: SparkSession, path: str, from_ts: float | None = None, range_bytes: int = RANGE_BYTES,
    max_bytes: int | None = None, checkpoint: str | None = None,
) -> DataFrame:
    """Follow growing logs: whole lines appended to the files of a path or glob since the last batch, by byte offset.

    The checkpoint keeps how far each file was read and how it begins. A file that was rewritten or has become shorter is read from
    its start, a renamed one goes on where it ended. ``max_bytes`` bounds every batch; it needs ``checkpoint``, the folder of the
    query's checkpoint. An ``availableNow`` run takes one batch.
    """
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format(LogTail.name()).option("path", path).option("rangeBytes", range_bytes)
    reader = reader.option("maxBytes", max_bytes) if max_bytes else reader
    lines = (reader.option("checkpoint", checkpoint) if checkpoint else reader).load()
    parsed = lines.select(
        F.from_json("value", RAW_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("_line"), F.col("place").alias(PLACE)
    )
    raw = parsed.filter(F.col("_line").isNotNull() & F.col(f"_line.{CORRUPT}").isNull()).select("_line.*", PLACE)
    return _since(_in_arrival_order(normalise(raw)), from_ts)


def _since(readings: DataFrame, from_ts: float | None) -> DataFrame:
    return readings if from_ts is None else readings.filter(F.col("ts") >= F.lit(float(from_ts)))


def now_ts() -> float:
    """Epoch seconds of this moment, for ``stream_readings(from_ts=...)``."""
    return datetime.now(timezone.utc).timestamp()
