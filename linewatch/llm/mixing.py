"""Mixing sources to target weights in fixed-length blocks of words.

A source is the sequence of its documents' words, cut into blocks of ``block`` words (the last one may be shorter). A mix is
a number of slots per source, each slot one block: whole passes over the source and one pass over a part of its blocks,
whose last slot is cut so that the words taken equal the target. Slots are dealt to output shards: every shard draws its
sources from a multinomial distribution, and a slot number is mapped to a block through a pseudorandom permutation of the
source's block indexes, so that no list of blocks is shuffled or held anywhere. Blocks then join slots by index.

The draws are independent per shard, so their sums miss the wanted slot counts by chance; slots beyond a source's count are
handed to the sources that fell short, in order. Everything depends on the seed and the data only, not on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewatch.llm.common import bound_batches, give_back, mix64, numbered, release_stores, text_bytes, written
from linewatch.session import materialise

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
MOST = 2.0
BLOCK = 64
SHARD_SLOTS = 4096
SEED = 7
CHUNK_ROWS = 5_000
MAX_SOURCES = 100_000  # sources of one mix; their sizes and targets are worked out on the driver


@dataclass(frozen=True)
class Target:
    """What one source gives: ``passes`` whole passes over its ``blocks`` blocks, then ``rest`` words of a partial pass."""

    source: str | None
    place: int
    size: int
    target: float
    words: int
    blocks: int
    slots: int
    last: int  # words of the last slot


def word_count(text_col: str = "text") -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none. Counted as the places where a word begins."""
    blank = r"[\x20\x09-\x0D]+"
    squeezed = F.trim(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), blank, " "))
    gaps = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(squeezed == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size, the excess shared by weight among the others."""
    targets = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = total
    while open_:
        weight = math.fsum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            return targets
        for i in over:
            targets[i] = most * sizes[i]
        open_ = [i for i in open_ if i not in set(over)]
        left -= math.fsum(targets[i] for i in over)
    return targets


def plan_targets(
    sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST, block: int = BLOCK
) -> list[Target]:
    """Targets of sources given with their sizes; sources are taken by code point, null last, and weigh ``weights`` in turn."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    n = [s for _, s in ordered]
    goal = water_fill(n, [weights[i % len(weights)] for i in range(len(n))], total * sum(n), most)
    plans = []
    for place, ((source, size), target) in enumerate(zip(ordered, goal)):
        words = min(round(target), math.floor(most * size))
        blocks = -(-size // block)
        passes, rest = divmod(words, size) if size else (0, 0)
        extra = min(-(-rest // block), blocks)
        # The short block stands last in every pass, so all slots before the last one are full.
        last = rest - (extra - 1) * block if extra else 0
        plans.append(Target(source, place, size, target, words, blocks, passes * blocks + extra, last))
    return plans


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: a four-round Feistel network, walked until inside the range."""
    if n <= 1:
        return index.copy()
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (mix64(right ^ key) & mask)
        x = (left << np.uint64(half)) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def block_order(index: np.ndarray, blocks: int, short: bool, seed: int) -> np.ndarray:
    """The block at each place of a pass; a short last block stays last."""
    full = blocks - 1 if short else blocks
    out = np.full(len(index), blocks - 1, np.int64)
    inside = index < full
    out[inside] = permuted(index[inside], full, seed)
    return out


def source_sizes(rows: DataFrame) -> list[tuple[str | None, int]]:
    found = rows.groupBy("_source").agg(F.sum("_size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"a mix names its sources: more than {MAX_SOURCES} is no mix")
    return [(r["_source"], int(r["n"])) for r in found]


def packed(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every row's first word in its source's sequence, as ``_begin``; rows of a source lie by chunk, then id.

    A chunk is a hash class of ids of about ``chunk_rows`` rows, so no window sorts a whole source.
    """
    chunks = max(1, rows.count() // chunk_rows + 1)
    held = rows.withColumn("_chunk", F.pmod(F.xxhash64("_id", "_size"), F.lit(chunks)))
    sums = held.groupBy("_place", "_chunk").agg(F.sum("_size").alias("_n"))
    bases = sums.select("_place", "_chunk", (F.sum("_n").over(Window.partitionBy("_place").orderBy("_chunk")) - F.col("_n")).alias("_base"))
    inner = Window.partitionBy("_place", "_chunk").orderBy("_id", "_size", "_row")
    local = held.withColumn("_at", F.sum("_size").over(inner) - F.col("_size"))
    return local.join(bases, ["_place", "_chunk"]).withColumn("_begin", F.col("_base") + F.col("_at")).drop("_chunk", "_at", "_base")


def target_table(spark: SparkSession, plans: Sequence[Target]) -> DataFrame:
    """``_name, _place, _source_size, _target``, from Arrow: a list of tuples would keep a second pool of Python workers alive."""
    columns = [("_name", pa.string(), "source"), ("_place", pa.int64(), "place"), ("_source_size", pa.int64(), "size"), ("_target", pa.float64(), "target")]
    return spark.createDataFrame(pa.table({name: pa.array([getattr(p, field) for p in plans], kind) for name, kind, field in columns}))


def slots(spark, plans: Sequence[Target], block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix: ``shard, slot, _place, _pass, _block, _words``, one row per slot."""
    total = sum(p.slots for p in plans)
    shards = max(1, -(-total // shard_slots))
    active = [p for p in plans if p.slots]
    shared = spark.sparkContext.broadcast(active)
    weights = np.array([p.slots for p in active], float)

    def draw(batches):
        share = weights / weights.sum()
        for batch in batches:
            ids, places, counts, firsts_ = [], [], [], []
            for shard in batch.column(0).to_pylist():
                n = min(shard_slots, total - shard * shard_slots)
                got = np.random.default_rng([seed, shard]).multinomial(n, share)
                some = np.flatnonzero(got)
                ids += [shard] * len(some)
                places += some.tolist()
                counts += got[some].tolist()
                firsts_ += (np.cumsum(got) - got)[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, places, counts, firsts_)], ["shard", "_s", "_n", "_slot"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "shard long, _s long, _n long, _slot long"
    if not active:
        return spark.createDataFrame([], "shard long, slot long, _place long, _pass long, _block long, _words long")
    drawn = materialise(spark.range(0, shards, 1, min(shards, parts)).mapInArrow(draw, schema))
    sums = dict(drawn.groupBy("_s").agg(F.sum("_n")).collect())
    # Slots beyond a source's count, in order, are given to the sources that fell short.
    over, short, at = {}, [], 0
    for k, p in enumerate(active):
        over[k] = at
        at += max(0, sums.get(k, 0) - p.slots)
    at = 0
    for k, p in enumerate(active):
        gap = max(0, p.slots - sums.get(k, 0))
        short.append((at, k, sums.get(k, 0)))
        at += gap
    firsts = np.array([s[0] for s in short], np.int64)
    numbered_ = drawn.withColumn("_from", F.sum("_n").over(Window.partitionBy("_s").orderBy("shard")) - F.col("_n"))

    def place(batches):
        release_stores()
        plan = shared.value
        for batch in batches:
            for shard, s, n, begin, slot in zip(*(c.to_pylist() for c in batch.columns)):
                j = np.arange(begin, begin + n)
                own = j < plan[s].slots
                parts_ = [(s, np.flatnonzero(own), j[own])]
                extra = j[~own]
                if len(extra):
                    t = over[s] + extra - plan[s].slots
                    to = np.searchsorted(firsts, t, side="right") - 1
                    for d in np.unique(to).tolist():
                        which = to == d
                        parts_.append((short[d][1], np.flatnonzero(~own)[which], short[d][2] + t[which] - short[d][0]))
                for k, where, number in parts_:
                    p = plan[k]
                    if not len(number):
                        continue
                    turn, index = np.divmod(number, p.blocks)
                    out = np.empty(len(number), np.int64)
                    tail = p.size % block
                    for one in np.unique(turn).tolist():
                        sel = turn == one
                        out[sel] = block_order(index[sel], p.blocks, bool(tail), seed * 1_000_003 + p.place * 8191 + one)
                    words = np.where((out == p.blocks - 1) & (tail > 0), tail, block)
                    if p.last:
                        words = np.where(number == p.slots - 1, p.last, words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (np.full(len(number), shard), slot + where, np.full(len(number), p.place), turn, out, words)],
                        ["shard", "slot", "_place", "_pass", "_block", "_words"],
                    )

    ready = numbered_.repartition(parts, "shard").select("shard", "_s", "_n", "_from", "_slot")
    return ready.mapInArrow(place, "shard long, slot long, _place long, _pass long, _block long, _words long")


@dataclass
class Mix:
    """``rows``: every document's place in its source; ``slots``: the mix; ``pieces``: what each slot takes of which document."""

    rows: DataFrame
    slots: DataFrame
    pieces: DataFrame
    plans: list[Target]


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    total: float = TOTAL,
    most: float = MOST,
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> Mix:
    """Draw a mix of ``docs``: ``total`` times all words, sources weighing ``weights`` in turn by code point (null last).

    Documents without words belong to their source and give nothing; rows that repeat an id are rows of their own; a null id
    is an id like another. An empty table gives an empty mix. Texts are read for their word counts only.
    """
    spark = docs.sparkSession
    slim = numbered(
        docs.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_source"), word_count(text_col).alias("_size"))
    )
    plans = plan_targets(source_sizes(slim), weights, total, most, block)
    table = target_table(spark, plans)
    placed = slim.join(F.broadcast(table), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    rows = materialise(packed(placed))
    dealt = written(slots(spark, plans, block, shard_slots, seed), "slots")  # a file's size is known to the planner
    cut = rows.filter("_size > 0").select(
        "_row", "_place", "_begin", "_size",
        F.explode(F.sequence(F.floor(F.col("_begin") / block), F.floor((F.col("_begin") + F.col("_size") - 1) / block))).alias("_block"),
    )
    # A block has at most ``block`` pieces and as many slots as passes, so no key of this join is large.
    pieces = cut.join(dealt, ["_place", "_block"]).select(
        "_row", "_place", "_block", "_pass", "shard", "slot",
        F.greatest(F.col("_begin"), F.col("_block") * block).alias("_start"),
        F.least(F.col("_begin") + F.col("_size"), F.col("_block") * block + F.col("_words")).alias("_end"),
        F.col("_begin"),
    ).filter("_end > _start")
    return Mix(rows, dealt, pieces, plans)


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per input row: words taken, repeats counted."""
    made = mix(docs, **options)
    taken = made.pieces.groupBy("_row").agg(F.sum(F.col("_end") - F.col("_start")).alias("_taken"))
    return made.rows.join(taken, "_row", "left").select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = None, **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row per document and pass, holding the words that pass takes.

    Neighbouring words keep the white space between them; stretches that are not neighbours are joined by a line feed. A
    document that a pass takes whole keeps its text as it is. ``length_col``, if given, is set to the new length.
    """
    bound_batches(docs.sparkSession)
    # Row numbers are given once, over written rows, so that the plan and the texts agree.
    held = written(docs.select(F.struct("*").alias("_doc")).withColumn("_key", F.monotonically_increasing_id()), "mix")
    flat = held.select(
        F.col("_key"), F.col(f"_doc.{id_col}").alias("_i"), F.col(f"_doc.{text_col}").alias("_t"), F.col(f"_doc.{source_col}").alias("_s")
    )
    made = mix(flat, "_key", "_t", "_s", **options)
    runs = (
        made.pieces.join(made.rows.select("_row", F.col("_id").alias("_key"), "_size"), "_row")
        .groupBy("_key", "_pass")
        .agg(F.sort_array(F.collect_list(F.struct((F.col("_start") - F.col("_begin")).alias("a"), (F.col("_end") - F.col("_begin")).alias("b")))).alias("_runs"))
    )

    def extract(texts: pa.Array, runs_: pa.Array) -> pa.Array:
        release_stores()
        made = (cut_words(t, [(r["a"], r["b"]) for r in rs]).decode("utf-8", "replace") for t, rs in zip(texts.to_pylist(), runs_.to_pylist()))
        made = pa.array(made, pa.string())
        give_back()
        return made

    joined = held.join(runs, "_key").withColumn("_new", F.arrow_udf(extract, "string")(text_bytes(F.col(f"_doc.{text_col}")), F.col("_runs")))
    fields = [
        F.col("_new").alias(text_col) if c == text_col
        else F.length("_new").cast(docs.schema[c].dataType).alias(c) if c == length_col
        else F.col("_doc").getField(c).alias(c)
        for c in docs.columns
    ]
    return joined.select(*fields)


def cut_words(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The words of the given intervals with their white space; the whole text if one interval covers all words."""
    import re

    joined: list[list[int]] = []
    for a, b in runs:
        if joined and a == joined[-1][1]:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    if len(joined) == 1 and joined[0] == [0, len(places)]:
        return text
    return b"\n".join(text[places[a][0] : places[b - 1][1]] for a, b in joined)
