"""SimHash near-duplicates: 64-bit fingerprints of whole texts, linked where at most a few bits differ.

Fingerprints are compared exactly, tile by tile. Distinct fingerprints are laid out by their population counts and cut into
tiles; two fingerprints whose population counts (of the whole, or summed over its four 16-bit quarters) differ by more than
the radius cannot be linked, so such tile pairs are skipped. The rest are compared with exclusive-or and bit counts. A task
returns no list of pairs but a spanning forest of what it found, at most one edge per fingerprint of its two tiles, and the
components of all forests are the groups.

Cost: the work is the square of the number of distinct fingerprints, over about ten (the share of pairs that survives the
counts). Nothing else grows faster than the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.functions.components import components
from linewatch.llm.common import arrow_map, text_bytes
from linewatch.session import materialise

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 4096
STEP = 1 << 18  # comparisons at once: a few megabytes, also where nearly all of them are links
_QUARTERS = 4


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the hashes of the word shingles, repeats included; 0 without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    one = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return one(b" ".join(words), seed)
    runs = zip(*(words[i:] for i in range(shingle)))
    hashes = np.fromiter((one(b" ".join(r), seed) for r in runs), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, _fp)``: one row per input row, the fingerprint as a signed 64-bit integer."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["_id", "_fp"])

        return each

    source = docs.select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_text"))
    return arrow_map(source, make, "_id long, _fp long", tidy=True)


def quarter_counts(prints: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, as rows of small integers."""
    return np.bitwise_count(np.ascontiguousarray(prints).view(np.uint16)).reshape(-1, _QUARTERS).astype(np.int16)


class _Forest:
    """A growing spanning forest over nodes 0..size-1; ``root`` gives every node's group after ``join``."""

    def __init__(self, size: int):
        self.root = np.arange(size)
        self.a: list[int] = []
        self.b: list[int] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = self._top(i), self._top(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                self.a.append(i)
                self.b.append(j)
        while not np.array_equal(up := root[root], root):
            root = up
        self.root = root

    def _top(self, i: int) -> int:
        while (up := int(self.root[i])) != i:
            i = up
        return i


def linked(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges between two tiles of unsigned fingerprints (``right`` None: within one), reduced to a spanning forest.

    Fingerprints with equal quarter counts form a run; runs whose counts differ by more than the radius are skipped.
    """
    own = right is None
    other = left if own else right
    nodes = left if own else np.concatenate([left, right])
    shift = 0 if own else len(left)
    counts, others = quarter_counts(left), quarter_counts(other)
    order = np.lexsort(counts.T)
    ranked = counts[order]
    starts = np.flatnonzero(np.r_[True, (ranked[1:] != ranked[:-1]).any(axis=1)]) if len(order) else np.array([], int)
    forest = _Forest(len(nodes))
    for begin, end in zip(starts, np.r_[starts[1:], len(order)]):
        near = np.flatnonzero(np.abs(others - ranked[begin]).sum(axis=1) <= radius)
        if not len(near):
            continue
        mine = order[begin:end]
        step = max(1, STEP // len(near))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step]
            a, b = np.nonzero(np.bitwise_count(left[rows][:, None] ^ other[near][None, :]) <= radius)
            a, b = rows[a], near[b] + shift
            while len(a):  # one new link per node and round; pairs inside a known group need no further look
                apart = forest.root[a] != forest.root[b]
                a, b = a[apart], b[apart]
                picked = np.unique(np.r_[np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]])
                forest.join(a[picked], b[picked])
    return nodes[np.array(forest.a, int)], nodes[np.array(forest.b, int)]


def tile_tasks(prints: DataFrame, size: int = TILE) -> tuple[int, int]:
    """How many tasks cut the tiles, one per full tile and one per shuffle partition at most, and the most tiles they can make."""
    full = -(-prints.count() // size)
    tasks = max(1, min(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), full))
    return tasks, full + tasks


def tiles(prints: DataFrame, size: int = TILE) -> DataFrame:
    """Distinct fingerprints ``_fp`` in tiles: ``_tile``, ``_low``, ``_high`` (population counts), ``_box`` and ``_fps`` (bytes).

    A range partitioning by counts brings like fingerprints together; a partition is cut every ``size`` rows. Neighbouring
    partitions that would not fill a tile go through one task, as every pair of tiles costs a comparison.
    """
    quarters = [F.bit_count(F.shiftrightunsigned("_fp", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(_QUARTERS)]
    total = F.bit_count("_fp")
    # Halves before quarters: runs that differ little in total and halves stand next to one another.
    ranks = [total, quarters[0] + quarters[1], quarters[0], quarters[2], F.col("_fp")]
    laid = prints.select("_fp", *[r.alias(f"_k{i}") for i, r in enumerate(ranks)])
    keys = [f"_k{i}" for i in range(len(ranks))]
    parts = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = laid.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("_fp").coalesce(tile_tasks(prints, size)[0])

    def cut(batches):
        held = np.array([], np.int64)
        for batch in batches:
            held = np.concatenate([held, batch.column(0).to_numpy(zero_copy_only=False)])
            while len(held) >= size:
                yield row(held[:size])
                held = held[size:]
        if len(held):
            yield row(held)

    def row(part: np.ndarray) -> pa.RecordBatch:
        part = part.view(np.uint64)
        counts = quarter_counts(part)
        totals = counts.sum(axis=1)
        box = np.r_[counts.min(axis=0), counts.max(axis=0)].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(part[0].view(np.int64))]),  # distinct fingerprints: the first one names its tile
                pa.array([int(totals.min())], pa.int32()),
                pa.array([int(totals.max())], pa.int32()),
                pa.array([box.tolist()], pa.list_(pa.int32())),
                pa.array([part.tobytes()], pa.binary()),
            ],
            ["_tile", "_low", "_high", "_box", "_fps"],
        )

    return laid.mapInArrow(cut, "_tile long, _low int, _high int, _box array<int>, _fps binary")


def tile_pairs(cut: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of tiles (and each tile with itself) that can hold fingerprints within the radius, with the bytes of both.

    Every tile is listed under each population count it holds, and asks for those up to ``radius`` above: an equality join. A
    pair is taken at the first count that brings it together.
    """
    heads = materialise(cut)
    held = heads.select("*", F.explode(F.sequence("_low", "_high")).alias("_at"))
    left = held.select(
        F.col("_tile").alias("a"), F.col("_low").alias("a_low"), F.col("_high").alias("a_high"), F.col("_box").alias("a_box"),
        F.explode(F.sequence(F.col("_at") - radius, F.col("_at") + radius)).alias("_at"),
    ).distinct()
    right = held.select(
        F.col("_tile").alias("b"), F.col("_low").alias("b_low"), F.col("_high").alias("b_high"), F.col("_box").alias("b_box"), "_at"
    )
    gap = None
    for q in range(_QUARTERS):
        apart = F.greatest(
            F.col("a_box")[q] - F.col("b_box")[q + _QUARTERS], F.col("b_box")[q] - F.col("a_box")[q + _QUARTERS], F.lit(0)
        )
        gap = apart if gap is None else gap + apart
    first = F.greatest(F.col("a_low") - radius, F.col("b_low"))
    chosen = (
        left.join(right, "_at")
        .filter((F.col("a") <= F.col("b")) & (F.col("_at") == first) & (gap <= radius))
        .select("a", "b")
    )
    bytes_of = heads.select(F.col("_tile"), F.col("_fps"))
    return chosen.join(bytes_of.select(F.col("_tile").alias("a"), F.col("_fps").alias("_left")), "a").join(
        bytes_of.select(F.col("_tile").alias("b"), F.col("_fps").alias("_right")), "b"
    )


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``(_u, _v)`` between distinct fingerprints that span the same groups as all pairs within ``radius`` bits."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            us, vs = [], []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                u, v = linked(np.frombuffer(x, np.uint64), None if a == b else np.frombuffer(y, np.uint64), radius)
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["_u", "_v"])

        return each

    pairs = tile_pairs(tiles(prints, tile), radius).select("a", "b", "_left", "_right")
    most = tile_tasks(prints, tile)[1]
    parts = min(4 * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), most * (most + 1) // 2)
    return arrow_map(pairs.repartition(parts, "a", "b"), make, "_u long, _v long", tidy=True)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with equal ids stay separate rows. A row
    without an id belongs to its group but never names it; a group of such rows only has a null ``component_id``. Other
    columns are not read. An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, id_col, text_col))
    firsts = materialise(prints.groupBy("_fp").agg(F.min("_id").alias("_first")))
    edges = links(firsts.select("_fp"), radius, tile)
    groups = components(edges.select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    member = firsts.join(groups.select(F.col("node").alias("_fp"), "root"), "_fp", "left").withColumn(
        "root", F.coalesce("root", "_fp")
    )
    names = member.groupBy("root").agg(F.min("_first").alias("component_id"))
    of_print = member.join(names, "root").select("_fp", "component_id")
    return prints.join(of_print, "_fp", "left").select(
        F.col("_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents without near-duplicates: of each group the row with the smallest id stays, with all its columns.

    Of rows that repeat that id one stays; of a group without ids one row stays.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.md5(text_bytes(text_col)).alias("_sum"), text_bytes(text_col).alias("_text")
    )

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["_id", "_sum", "_fp"])

        return each

    prints = materialise(arrow_map(source, make, "_id long, _sum string, _fp long", tidy=True))
    firsts = materialise(
        prints.groupBy("_fp").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_sum").alias("s"))).alias("_first"))
    )
    edges = links(firsts.select("_fp"), radius)
    groups = components(edges.select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    best = (
        firsts.join(groups.select(F.col("node").alias("_fp"), "root"), "_fp", "left")
        .groupBy(F.coalesce("root", "_fp").alias("root"))
        .agg(F.min("_first").alias("_first"))
        .select(F.col("_first.i").alias("_i"), F.col("_first.s").alias("_s"))
    )
    rows = docs.select(
        F.struct("*").alias("_doc"), F.col(id_col).cast("long").alias("_id"), F.md5(text_bytes(text_col)).alias("_sum")
    )
    kept = rows.join(best, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_sum") == F.col("_s")), "left_semi")
    repeats = prints.join(best, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_sum") == F.col("_s")), "left_semi")
    if not repeats.groupBy("_id", "_sum").count().filter("count > 1").isEmpty():
        kept = kept.groupBy("_id", "_sum").agg(F.first("_doc").alias("_doc"))
    return kept.select("_doc.*")
