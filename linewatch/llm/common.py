"""What the corpus operators share: word splitting on bytes, hashing, row identity and Arrow plumbing.

Texts travel to Python as UTF-8 bytes (the column cast to binary), so no batch is decoded and damaged text cannot crash a
task. ``bytes.lower`` changes A-Z only, and ``bytes.split`` cuts at the six ASCII white-space bytes only.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import threading
import time
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch.session import materialise, working_path

# Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank: what is left between blanks are the
# words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def text_bytes(column: str | Column) -> Column:
    """The text as bytes; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string").cast("binary"), F.lit(b""))


BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_READ = "spark.sql.parquet.columnarReaderBatchSize"


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let Arrow batches hold ``most`` bytes in this session: rows here are whole texts, not a few numbers."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= most:
        spark.conf.set(_BATCH, str(most))


def bound_reads(spark: SparkSession, most: int) -> None:
    """Let Parquet be read ``most`` rows at once in this session: a reader holds the texts of all of them, twice as it grows."""
    if int(spark.conf.get(_READ)) > most:
        spark.conf.set(_READ, str(most))


def give_back() -> None:
    """Return freed memory of this worker to the system: its next task may be another operator's, and beside it runs the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, store: str | None = None,
    tidy: bool = False,
) -> DataFrame:
    """``mapInArrow`` with a function made once per task and applied to every batch; ``store`` names the worker store it uses.

    ``tidy`` tasks give their memory back when they end.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_stores(store)
        try:
            each = make()
            for batch in batches:
                out = each(batch)
                if out is not None and out.num_rows:
                    yield out
        finally:
            if tidy:
                each = out = batch = None
                give_back()

    return df.mapInArrow(run, schema)


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hashes of words."""
    import xxhash

    one = xxhash.xxh64_intdigest
    return np.fromiter((one(w, seed) for w in words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


IDLE_SECONDS = 5.0  # a Python worker without work frees its stores


def _worker() -> types.ModuleType:
    name = "_corpus_worker_store"
    if name not in sys.modules:
        held = sys.modules[name] = types.ModuleType(name)
        held.stores, held.used = {}, time.monotonic()

        def expire() -> None:
            while True:
                time.sleep(IDLE_SECONDS / 2)
                if held.stores and time.monotonic() - held.used > IDLE_SECONDS:
                    held.stores.clear()
                    gc.collect()
                    give_back()

        threading.Thread(target=expire, daemon=True).start()
    return sys.modules[name]


def worker_store(name: str) -> dict:
    """A dictionary that outlives a task in its Python worker, for tables that are costly to set up per task.

    It is freed when the worker runs another operator, or nothing for some seconds.
    """
    held = _worker()
    held.used = time.monotonic()
    return held.stores.setdefault(name, {})


def release_stores(keep: str | None = None) -> None:
    """Free what other operators have left in this worker."""
    held = _worker()
    held.used = time.monotonic()
    dropped = [n for n in held.stores if n != keep]
    for name in dropped:
        del held.stores[name]
    if dropped:
        gc.collect()
        give_back()


def numbered(df: DataFrame) -> DataFrame:
    """Fixed row numbers ``_row`` (unique, not dense), written down so that every later use sees the same ones."""
    return materialise(df.withColumn("_row", F.monotonically_increasing_id()))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: cuts lineage like a checkpoint, in less room."""
    path = working_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
