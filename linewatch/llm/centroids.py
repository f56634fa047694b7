"""Exact integer k-means (Lloyd) with vectors cut into column blocks.

Vectors become integers and are laid down in chunks of rows, each chunk cut into blocks of ``width`` columns. A task holds one
column block of one chunk and the matching slice of the centroids. Per round:

* every block gives its exact partial distances to the slices, those of a chunk are brought together and added, and the smallest
  sum names each vector's centroid;
* the labels go back to the blocks of their chunk, and every column block updates its own slice from its own columns.

The blocks stay where they are (partitioned by block, kept in memory or on local disk, rebuilt from the written table if an
executor is lost); partial distances and labels travel. A stage has no more tasks than there are blocks: where partitions outnumber
them, a task takes several. All numbers are integers, so results depend on no order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewatch.llm.common import bound_batches, written

DIMS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
WIDTH = 32  # columns of a block
CHUNK_ROWS = 4096
MOST = 1 << 26  # components beyond this would overflow a 64-bit distance
MAX_CENTROID_NUMBERS = 1 << 23  # centroids x dimensions; they are broadcast, 64 MB at most


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """``(_id, _x)``: the vectors of exactly ``dims`` finite components, each turned into ``floor(SCALE * x)``."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    usable = (F.size(vector_col) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).alias("_id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("_x")
    )


def starting_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of ``seed:id``, in that order; equal ids are ordered by their components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(mark.alias("_mark"), "_x").orderBy("_mark", "_x").limit(k).collect()
    return np.array([r["_x"] for r in rows], np.int64)


def _within(values: np.ndarray) -> np.ndarray:
    if values.size and max(abs(int(values.min())), abs(int(values.max()))) > MOST:
        raise ValueError(f"a component beyond {MOST} would overflow a 64-bit distance")
    return values


def column_blocks(vectors: DataFrame, dims: int = DIMS, width: int = WIDTH, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(chunk, block, ids, cells)``, written down: chunks of rows cut into blocks of columns. Ids go with block 0."""
    bound_batches(vectors.sparkSession)
    id_type = vectors.schema["_id"].dataType

    def cut(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0)
            cells = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            cells = _within(cells).astype(np.int32)
            for at in range(0, len(cells), chunk_rows):
                part = cells[at : at + chunk_rows]
                firsts = range(0, dims, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(task << 32) + number] * len(firsts), pa.int64()),
                        pa.array(range(len(firsts)), pa.int32()),
                        pa.array([ids.slice(at, chunk_rows).to_pylist()] + [None] * (len(firsts) - 1), pa.list_(ids.type)),
                        pa.array([np.ascontiguousarray(part[:, c : c + width]).tobytes() for c in firsts], pa.binary()),
                    ],
                    ["chunk", "block", "ids", "cells"],
                )
                number += 1

    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("cells", T.BinaryType()),
        ]
    )
    return written(vectors.select("_id", "_x").mapInArrow(cut, schema), "column-blocks")


def partial_distances(cells: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances over the columns of a block: one row per vector, one column per centroid."""
    x, c = cells.astype(np.int64), centres.astype(np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # doubles hold every intermediate integer
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        found = ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None]).astype(np.int64)
    else:
        found = np.empty((len(x), len(c)), np.int64)
        for j in range(len(c)):
            found[:, j] = ((x - c[j]) ** 2).sum(1)
    # Few bytes travel where distances are short.
    return found.astype(np.uint32) if int(found.max(initial=0)) < 1 << 30 else found


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) + b


def _nearest(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (ties: the smaller number) and distances."""
    sums = sums.astype(np.int64)
    labels = sums.argmin(1)
    return labels.astype(np.uint8 if sums.shape[1] <= 256 else np.int32), sums[np.arange(len(sums)), labels]


def _column_sums(cells: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(labels, kind="stable")
    counts = np.bincount(labels, minlength=k)
    sums = np.zeros((k, cells.shape[1]), np.int64)
    present = np.flatnonzero(counts)
    if len(present):
        begins = (np.cumsum(counts) - counts)[present]
        sums[present] = np.add.reduceat(cells[order].astype(np.int64), begins, axis=0)
    return sums.astype(object), counts.astype(object)  # whole numbers of any size from here on


def lloyd(blocks: DataFrame, centres: np.ndarray, rounds: int = ROUNDS, width: int = WIDTH):
    """``(labels, centres, cells)``: an RDD of ``(chunk, (labels, distances))`` under the final centroids, those, and the kept blocks."""
    spark = blocks.sparkSession
    context = spark.sparkContext
    k, dims = centres.shape
    if k * dims > MAX_CENTROID_NUMBERS:
        raise ValueError(f"{k} centroids of {dims} numbers are more than a broadcast of {MAX_CENTROID_NUMBERS} allows")
    slices = [(c, min(c + width, dims)) for c in range(0, dims, width)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def block_of(row):
        begin, end = slices[row["block"]]
        return (row["block"], row["chunk"]), np.frombuffer(row["cells"], np.int32).reshape(-1, end - begin)

    count = len(slices)
    tasks = max(1, min(parts, blocks.count()))
    cells = blocks.select("chunk", "block", "cells").rdd.map(block_of).partitionBy(parts).persist(StorageLevel.MEMORY_AND_DISK)

    def assigned(now: np.ndarray):
        shared = context.broadcast([now[:, b:e] for b, e in slices])

        def part(pair):
            (block, chunk), values = pair
            return chunk, partial_distances(values, shared.value[block])

        def whole(pairs):
            held: dict = {}
            for chunk, found in pairs:
                total, seen = held.pop(chunk, (None, 0))
                total = found if total is None else _add(total, found)
                if seen + 1 == count:
                    yield chunk, _nearest(total)
                else:
                    held[chunk] = total, seen + 1

        return cells.coalesce(tasks).map(part).partitionBy(parts).coalesce(tasks).mapPartitions(whole)

    def update(now: np.ndarray) -> np.ndarray:
        def to_blocks(pair):
            chunk, (labels, _) = pair
            return [((block, chunk), labels) for block in range(count)]

        def added(pairs):
            total: dict = {}
            for block, (s, n) in pairs:
                total[block] = (total[block][0] + s, total[block][1] + n) if block in total else (s, n)
            return total.items()

        def sums(pairs):
            waiting: dict = {}  # labels, which come first, and then the columns they belong to

            def matched():
                for key, found in pairs:
                    other = waiting.pop(key, None)
                    if other is None:
                        waiting[key] = found
                    else:
                        values, labels = (found, other) if found.ndim == 2 else (other, found)
                        yield key[0], _column_sums(values, labels, k)

            return added(matched())

        labels = assigned(now).flatMap(to_blocks).partitionBy(parts)
        met = labels.union(cells).partitionBy(parts).coalesce(tasks)  # both lie by block already
        # One entry per column block: together as large as the centroids.
        found = met.mapPartitions(sums).partitionBy(parts).coalesce(min(tasks, count)).mapPartitions(added).collect()
        made = now.astype(object)
        for block, (s, n) in found:
            begin, end = slices[block]
            for j in range(k):
                if n[j]:
                    made[j, begin:end] = [int(v) // int(n[j]) for v in s[j]]
        return made.astype(np.int64)

    for _ in range(rounds):
        made = update(centres)
        if np.array_equal(made, centres):  # a fixed point: further rounds change nothing
            break
        centres = made
    return assigned(centres), centres, cells


def centroid_clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = DIMS,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    chunk_rows: int = CHUNK_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``, one row per kept vector.

    Rows whose vector is null, of another length, or has a null or non-finite component are left out. Repeated rows stay
    separate rows and count each. A null id counts as an empty text in the choice of the starting centroids and is returned as
    null. With fewer than ``k`` vectors every vector starts a centroid; an empty table gives an empty result. Components beyond
    2**26 after scaling raise an error, as a 64-bit distance could not hold them. Other columns are not read.
    """
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, id_col, vector_col, dims)
    id_field = T.StructField(id_col, whole.schema["_id"].dataType)
    centres = starting_centroids(whole, k, seed)
    schema = T.StructType([id_field, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(centres):
        empty = spark.createDataFrame([], schema)
        return empty.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    _within(centres)
    blocks = column_blocks(whole, dims, width, chunk_rows)
    found, centres, cells = lloyd(blocks, centres, rounds, width)

    labelled = spark.createDataFrame(
        found.map(lambda p: (p[0], p[1][0].astype(np.int32).tobytes(), p[1][1].tobytes())), "chunk long, labels binary, distances binary"
    )

    def rows(batches):
        for batch in batches:
            for ids, labels, distances in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(np.frombuffer(labels, np.int32)), pa.array(np.frombuffer(distances, np.int64))],
                    [id_col, "cluster", "distance"],
                )

    joined = blocks.filter("block = 0").select("chunk", "ids").join(labelled, "chunk").select("ids", "labels", "distances")
    assigned = written(joined.mapInArrow(rows, schema), "clusters")
    cells.unpersist()
    per = {r["cluster"]: int(r["n"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    marks = [
        (j, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, centres[j].tolist())).encode()).hexdigest()) for j in sorted(per)
    ]  # at most k rows
    facts = spark.createDataFrame(marks, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
